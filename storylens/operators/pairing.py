"""Greedy contrast pairs, computed exactly in rounds over the lexicon.

Sequential definition: the smaller pole (the low pole on a tie) chooses; in
lexicon order each chooser takes its most similar partner that no earlier
chooser has taken. Ties: similarity descending, then partner position
descending.

What a chooser takes depends on earlier choosers alone, so the choosers of a
dimension are dealt into runs in lexicon order, and a round settles one run of
every dimension for good against the partners that earlier rounds left open. No
pair rows and no preference lists are made, so choosers that want the same
partners (near copies) cost no more rounds than others: there are as many rounds
as runs, ``block * segment`` choosers to a run, however much they contend. The
quadratic part of a round is made by many tasks: each meets the run with one tile
of the open partners and hands on, for each chooser and group of partners, an upper
bound of the similarities (a float32 matrix product and its rounding errors). The
task that lets a dimension's choosers take in order makes exact similarities
for the groups whose bound may still win, a few of hundreds, and each as one sum in
a fixed order, so that equal vectors tie exactly wherever they stand. A dimension
of one run makes its own bounds, ``block`` choosers at a time, and partners that a
block took leave the matrix. A round leaves one row per settled chooser, cut from its
lineage with a reliable checkpoint. Poles of every size take this path.

Words whose vector is null or has a null, NaN or infinite element have no
similarity to anything: they belong to neither pole, and are not counted when
the smaller pole is chosen. Zero vectors have similarity 0 to all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storylens.functions.indexing import sequential_index
from storylens.functions.vectors import as_double, finite, spread, unit
from storylens.session import ensure_checkpoint_dir

# Choosers after which taken partners leave the matrix, and blocks that a round settles.
BLOCK = 512
SEGMENT = 64
# Choosers of a matrix product, of float64 and of float32.
ROWS = 64
BOUND_ROWS = 512
# Partners that share an upper bound, and such groups in a matrix product.
GROUP = 512
GROUPS = 8
# Choosers and partners of one task of the nearest-partner search.
TILE = 16384

_PROPOSAL_SCHEMA = "dim string, cidx long, pidx long, sim double"
_BOUNDS_SCHEMA = "dim string, cidx long, vid long, tile int, bounds binary"
_NEAREST_SCHEMA = "dim string, cidx long, pidx long, sim double, vid long, copies long"


def _matrix(table: pa.Table) -> np.ndarray:
    """Vectors of a group as one matrix, without an object per row."""
    return table["vec"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(table), -1)


def _chosen(dim, cidx, pidx, sim) -> pa.Table:
    return pa.table({"dim": pa.array([dim] * len(cidx), pa.string()), "cidx": pa.array(cidx, pa.int64()),
                     "pidx": pa.array(pidx, pa.int64()), "sim": pa.array(sim, pa.float64())})


def _upper_bounds(cv: np.ndarray, pv: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """For each chooser and group of partners (which begin at ``starts``), a number that
    no similarity exceeds: the largest in float32, and more than its rounding error."""
    out = np.empty((len(cv), len(starts)), np.float32)
    cs, ps = cv.astype(np.float32), pv.astype(np.float32)
    for k in range(0, len(starts), GROUPS):
        own = starts[k:k + GROUPS]
        part = ps[own[0]:starts[k + GROUPS] if k + GROUPS < len(starts) else len(ps)].T
        for i in range(0, len(cs), size):
            out[i:i + size, k:k + GROUPS] = np.maximum.reduceat(cs[i:i + size] @ part, own - own[0], axis=1)
    longest = [max(1.0, float(np.sqrt(np.einsum("ij,ij->i", v, v).max(initial=0.0)))) for v in (cv, pv)]
    out += np.float32((cv.shape[1] + 16) * 2.0**-23 * longest[0] * longest[1])
    return out


def _take(cv: np.ndarray, pv: np.ndarray, pidx: np.ndarray, starts: np.ndarray, bounds: np.ndarray,
          free: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The choosers in order take their best free partner, among ties the one of the
    largest position. Returns its row (-1: none was left) and similarity; uses up ``bounds``."""
    taken, value = np.full(len(cv), -1, np.int64), np.full(len(cv), -np.inf)
    ends = np.append(starts[1:], len(pv))
    for i, (v, b) in enumerate(zip(cv, bounds)):
        best, at = -np.inf, -1
        while True:
            g = b.argmax()
            if b[g] == -np.inf or b[g] < best:
                break
            lo, hi = starts[g], ends[g]
            b[g] = -np.inf
            sims = np.einsum("ij,j->i", pv[lo:hi], v)  # a sum in one order wherever a row stands
            sims[~free[lo:hi]] = -np.inf
            j = lo + sims.argmax()  # the first maximum: the largest position of the group
            top = sims[j - lo]
            if top > best or (top == best and at >= 0 and pidx[j] > pidx[at]):
                best, at = top, j
        if at >= 0:
            free[at] = False
            taken[i], value[i] = at, best
    return taken, value


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors as the bytes of their elements: the JVM moves, sorts and hands on an array by the element."""
    for rb in batches:
        vec, n = rb.column("vec"), len(rb)
        flat = vec.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        ends = np.append(0, np.cumsum(pc.list_value_length(vec).to_numpy(zero_copy_only=False))).astype(np.int32) * 8
        data = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(flat.tobytes())])
        yield rb.set_column(rb.schema.get_field_index("vec"), "vec", data)


def _ordered(table: pa.Table, by: list[tuple[str, str]], idx: str) -> tuple[np.ndarray, np.ndarray]:
    """Positions ``idx`` and packed vectors of a table in the order of ``by``."""
    order = pc.sort_indices(table.select([c for c, _ in by]), sort_keys=by).to_numpy()
    rows = []
    for c in table["vec"].chunks:
        ends = np.frombuffer(c.buffers()[1], np.int32)[c.offset:c.offset + len(c) + 1] if len(c) else (0, 0)
        rows.append(np.frombuffer(c.buffers()[2] or b"", np.uint8)[ends[0]:ends[-1]])
    vectors = np.concatenate(rows).view(np.float64).reshape(len(order), -1)
    return table[idx].to_numpy()[order], vectors[order]


# The order of the choosers and of the partners, of a tile too.
_BY_CHOOSER = [("cidx", "ascending"), ("vid", "ascending")]
_BY_PARTNER = [("pidx", "descending"), ("vid", "ascending")]


def _greedy(dim, cidx, cv, pidx, pv, block: int, size: int, group: int, starts=None, bounds=None) -> pa.Table:
    """The choosers in order take their best partner, ``block`` at a time. Bounds that
    came with them are used until half of the partners are taken; after that, and
    without any, a block makes its own, and taken partners leave the matrix."""
    got, taken, value, free = [], [], [], np.ones(len(pidx), dtype=bool)
    for i in range(0, len(cidx), block):
        if not len(pidx):
            break
        mine = cv[i:i + block]
        if bounds is None:
            starts = np.arange(0, len(pidx), group)
        at, sim = _take(mine, pv, pidx, starts, _upper_bounds(mine, pv, starts, size) if bounds is None else bounds[i:i + block], free)
        has = at >= 0
        got.append(cidx[i:i + block][has])
        taken.append(pidx[at[has]])
        value.append(sim[has])
        if bounds is None or free.sum() * 2 < len(free):
            if bounds is not None:  # tiles stood one after the other
                order = np.argsort(-pidx, kind="stable")
                pidx, pv, free, bounds = pidx[order], pv[order], free[order], None
            pidx, pv, free = pidx[free], pv[free], free[free]
    return _chosen(dim, *(np.concatenate(x) for x in (got, taken, value)))


def _settled(block: int, size: int, group: int):
    """A run's choosers, in lexicon order, each take their best open partner."""

    def run(choosers: pa.Table, partners: pa.Table) -> pa.Table:
        if not len(choosers) or not len(partners):
            return _chosen(None, [], [], [])
        # in a group, the first maximum is the largest position among ties
        return _greedy(choosers["dim"][0].as_py(), *_ordered(choosers, _BY_CHOOSER, "cidx"),
                       *_ordered(partners, _BY_PARTNER, "pidx"), block, size, group)

    return run


def _tile_bounds(size: int, group: int):
    """Bounds of a run's choosers for one tile of the open partners, ``group`` in order at a time."""

    def run(choosers: pa.Table, partners: pa.Table) -> pa.Table:
        if not len(choosers) or not len(partners):
            return choosers.slice(0, 0).select(["dim", "cidx", "vid", "tile"]).append_column("bounds", pa.array([], pa.binary()))
        _, cv = _ordered(choosers, _BY_CHOOSER, "cidx")
        _, pv = _ordered(partners, _BY_PARTNER, "pidx")
        bounds = _upper_bounds(cv, pv, np.arange(0, len(pv), group), size)
        ends = np.arange(len(bounds) + 1, dtype=np.int32) * (bounds.shape[1] * 4)
        lists = pa.Array.from_buffers(pa.binary(), len(bounds), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(bounds.tobytes())])
        return choosers.select(["dim", "cidx", "vid", "tile"]).sort_by(_BY_CHOOSER).append_column("bounds", lists)

    return run


def _settled_by_bounds(block: int, size: int, group: int):
    """``_settled`` for choosers that come with the bounds of each tile: rows of tile -1
    hold the choosers' vectors, the others their bounds."""

    def run(rows: pa.Table, partners: pa.Table) -> pa.Table:
        choosers = rows.filter(pc.equal(rows["tile"], -1))
        if not len(choosers) or not len(partners):
            return _chosen(None, [], [], [])
        pidx, pv = _ordered(partners, [("tile", "ascending"), *_BY_PARTNER], "pidx")
        tiles, counts = np.unique(partners["tile"].to_numpy(), return_counts=True)
        starts = [at + np.arange(0, n, group) for at, n in zip(np.cumsum(counts) - counts, counts)]
        bounds, at = np.empty((len(choosers), sum(map(len, starts))), np.float32), 0
        for t, own in zip(tiles.tolist(), starts):
            some = rows.filter(pc.equal(rows["tile"], t)).select(["cidx", "vid", "bounds"]).sort_by(_BY_CHOOSER)
            bounds[:, at:at + len(own)] = np.frombuffer(b"".join(some["bounds"].to_pylist()), np.float32).reshape(len(choosers), -1)
            at += len(own)
        return _greedy(choosers["dim"][0].as_py(), *_ordered(choosers, _BY_CHOOSER, "cidx"), pidx, pv, block, size, group,
                       np.concatenate(starts), bounds)

    return run


def _nearest(choosers: pa.Table, partners: pa.Table) -> pa.Table:
    """The best partner of each chooser among the partners of one tile."""
    if not len(choosers) or not len(partners):
        out, choosers = _chosen(None, [], [], []), choosers.slice(0, 0)
        return out.append_column("vid", choosers["vid"]).append_column("copies", choosers["copies"])
    partners = partners.sort_by([("pidx", "descending")])
    cv, pv = _matrix(choosers), _matrix(partners)
    pidx = partners["pidx"].to_numpy()
    best, value = np.zeros(len(cv), dtype=np.int64), np.zeros(len(cv))
    for i in range(0, len(cv), ROWS):
        sims = cv[i:i + ROWS] @ pv.T
        top = sims.argmax(axis=1)
        best[i:i + ROWS], value[i:i + ROWS] = pidx[top], sims[np.arange(len(top)), top]
    out = _chosen(choosers["dim"][0].as_py(), choosers["cidx"].to_numpy(), best, value)
    return out.append_column("vid", choosers["vid"]).append_column("copies", choosers["copies"])


def contrast_pairs(low: DataFrame, high: DataFrame, block: int = BLOCK, size: int = BOUND_ROWS,
                   segment: int = SEGMENT, group: int = GROUP, tile: int = TILE) -> DataFrame:
    """Greedy contrast pairs per dimension.

    low, high: ``(dim, word, ord, vec)``. Returns ``(dim, low_word, high_word, sim)``.
    """
    spark = low.sparkSession
    ensure_checkpoint_dir(spark)
    low, high = (spread(x, "dim", "word").filter(finite("vec")) for x in (low, high))
    lo = low.select("dim", "word", "ord", unit(as_double("vec")).alias("vec"), F.lit("low").alias("side"))
    hi = high.select("dim", "word", "ord", unit(as_double("vec")).alias("vec"), F.lit("high").alias("side"))
    both = lo.unionByName(hi)
    packed = ", ".join(f"`{f.name}` {'binary' if f.name == 'vec' else f.dataType.simpleString()}" for f in both.schema.fields)
    both = both.mapInArrow(_packed, packed).withColumn("vid", F.xxhash64("vec")).checkpoint()
    sizes = both.groupBy("dim").agg(
        F.count_if(F.col("side") == "low").alias("n_low"), F.count_if(F.col("side") == "high").alias("n_high"),
    ).filter("n_low > 0 and n_high > 0").withColumn(
        "chooser", F.when(F.col("n_low") <= F.col("n_high"), "low").otherwise("high")).checkpoint()
    # one row for each of the dimensions
    both = both.join(F.broadcast(sizes.select("dim", "chooser")), "dim")
    # the lexicon position is the priority (choosers) and the tie-break (partners)
    choosers = both.filter(F.col("side") == F.col("chooser")).select(
        "dim", F.col("ord").alias("cidx"), F.col("word").alias("cword"), "vec", "vid")
    partners = both.filter(F.col("side") != F.col("chooser")).select(
        "dim", F.col("ord").alias("pidx"), F.col("word").alias("pword"), "vec", "vid")
    # fresh attribute ids for the two sides (same lineage, joined below)
    choosers = choosers.toDF(*choosers.columns)
    partners = partners.toDF(*partners.columns)

    # a dimension of one run needs no ranks
    most = sizes.agg(F.max(F.least("n_low", "n_high"))).first()[0] or 0
    if most <= block * segment:
        n_runs, queued = 1, choosers.select("dim", "cidx", "vec", "vid", F.lit(0).alias("run"))
    else:
        # runs of choosers in lexicon order, from a dense rank in each dimension
        ranks = sequential_index(choosers.select("dim", "cidx").distinct(), ["dim", "cidx"], "rank").checkpoint()
        firsts = ranks.groupBy("dim").agg(F.min("rank").alias("first"))
        runs = ranks.join(F.broadcast(firsts), "dim").select(
            "dim", "cidx", F.expr(f"(rank - first) div {block * segment}").alias("run"))
        queued = choosers.join(runs, ["dim", "cidx"]).select("dim", "cidx", "vec", "vid", "run").checkpoint()
        n_runs = (queued.agg(F.max("run")).first()[0] or 0) + 1

    holders, open_ = None, partners.select("dim", "pidx", "vec", "vid")
    if n_runs > 1:
        # one row for each of the dimensions
        tiles = F.broadcast(sizes.select("dim", F.ceil(F.greatest("n_low", "n_high") / F.lit(tile)).cast("int").alias("tiles")))
        open_ = open_.join(tiles, "dim").withColumn(
            "tile", F.pmod(F.hash("pidx"), "tiles")).drop("tiles")
    for run in range(n_runs):
        mine = queued.filter(F.col("run") == run).drop("run")
        if n_runs == 1:
            holders = mine.groupBy("dim").cogroup(open_.groupBy("dim")).applyInArrow(
                _settled(block, size, group), _PROPOSAL_SCHEMA).checkpoint()
            break
        if holders is not None:
            # a dimension whose choosers are all settled needs no partners
            open_ = open_.join(settled.select("dim", "pidx"), ["dim", "pidx"], "left_anti").join(
                F.broadcast(mine.select("dim").distinct()), "dim", "left_semi")
        # read by the tiles and by the task that settles a dimension
        open_ = open_.checkpoint()
        every = mine.join(tiles, "dim").withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).drop("tiles")
        bounds = every.groupBy("dim", "tile").cogroup(open_.groupBy("dim", "tile")).applyInArrow(
            _tile_bounds(size, group), _BOUNDS_SCHEMA)
        rows = mine.withColumn("tile", F.lit(-1)).unionByName(bounds, allowMissingColumns=True)
        settled = rows.groupBy("dim").cogroup(open_.groupBy("dim")).applyInArrow(
            _settled_by_bounds(block, size, group), _PROPOSAL_SCHEMA).checkpoint()
        holders = settled if holders is None else holders.unionByName(settled)
    holders = holders.withColumnRenamed("cidx", "holder")

    pairs = (
        holders.join(choosers.select("dim", F.col("cidx").alias("holder"), "cword"), ["dim", "holder"])
        .join(partners.select("dim", "pidx", "pword"), ["dim", "pidx"])
        .join(F.broadcast(sizes.select("dim", "chooser")), "dim")
    )
    return pairs.select(
        "dim",
        F.when(F.col("chooser") == "low", F.col("cword")).otherwise(F.col("pword")).alias("low_word"),
        F.when(F.col("chooser") == "low", F.col("pword")).otherwise(F.col("cword")).alias("high_word"),
        "sim",
    )


def nearest_partners(choosers: DataFrame, partners: DataFrame, tile: int = TILE) -> DataFrame:
    """C06 without emitting pairs: for each chooser ``(dim, cidx, vec)`` its most
    similar partner ``(dim, pidx, vec)`` by cosine (ties: larger pidx), from a
    matrix product per dimension in tiles of about ``tile`` choosers and as many
    partners, so that no task holds a pole. Vectors that are not finite are left
    out. Returns ``(dim, cidx, pidx, sim)``."""
    choosers, partners = (spread(x, "dim", i).filter(finite("vec")) for x, i in ((choosers, "cidx"), (partners, "pidx")))
    # a chooser that comes twice is searched once, and is twice in the result
    choosers = choosers.groupBy("dim", "cidx", "vec").agg(F.count(F.lit(1)).alias("copies"))
    c = choosers.select("dim", "cidx", unit(as_double("vec")).alias("vec"), F.xxhash64("vec").alias("vid"), "copies")
    c = c.toDF(*c.columns)
    p = partners.select("dim", "pidx", unit(as_double("vec")).alias("vec")).toDF("dim", "pidx", "vec")

    def tiles(df, name):
        return df.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / F.lit(tile)).cast("int").alias(name))

    def dealt(idx, n):
        return F.pmod(F.hash(idx), F.col(n))

    def every(n):
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    # one row for each of the dimensions
    n = F.broadcast(tiles(c, "n_c").join(tiles(p, "n_p"), "dim"))
    c = c.join(n, "dim").select("dim", "cidx", "vec", "vid", "copies", dealt("cidx", "n_c").alias("ct"), every("n_p").alias("pt"))
    p = p.join(n, "dim").select("dim", "pidx", "vec", every("n_c").alias("ct"), dealt("pidx", "n_p").alias("pt"))
    found = c.groupBy("dim", "ct", "pt").cogroup(p.groupBy("dim", "ct", "pt")).applyInArrow(_nearest, _NEAREST_SCHEMA)
    best = found.groupBy("dim", "cidx", "vid").agg(
        F.max(F.struct("sim", "pidx")).alias("b"), F.max("copies").alias("copies"))
    best = best.select("*", F.explode(F.sequence(F.lit(1), "copies")))
    return best.select("dim", "cidx", F.col("b.pidx").alias("pidx"), F.col("b.sim").alias("sim"))
