"""Scoring: lexicon average (C01-C03), vector axis (C08-C10), seed
similarity (C11-C12), method choice (C13) and the full grid (C14).

Plan shape (rewrites that hold by linearity):
  * ``sim`` and ``axis`` depend only on the word, so every vocabulary word is
    scored once per dimension; stories never meet vectors.
  * mean over seeds of cos(term, seed) = unit(term) . mean(unit(seeds)): one
    centroid per dimension, no term x seed work.
  * attributes meet a table with one row per word and a column for each
    (dim, sm), and are reduced with one ``groupBy``. A table below a fixed size
    is broadcast, so that only sums per story are shuffled; with a larger one,
    attributes are pre-aggregated to ``(s_key, am, word, n)`` and joined by word.
  * attributes that come as a text or a list per story are looked up and summed
    on Arrow batches, so no row and no JVM string of a token is made.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storylens.constants import ATTR_METHODS, DIMENSIONS, SCORE_METHODS
from storylens.functions.text import whitespace_words
from storylens.functions.vectors import as_double, dot, norm, spread, unit, vector_mean
from storylens.operators.lexicon import lexicon_modes, poles, seeds
from storylens.operators.pairing import contrast_pairs
from storylens.session import ensure_checkpoint_dir

# Bytes up to which a table of word scores is broadcast.
BROADCAST_BYTES = 64 << 20
# The same for attributes per story, whose workers hold the table as one matrix.
MATRIX_BYTES = 160 << 20
# Bytes of attributes that such a worker splits at a time (a longer story alone), at least and for
# each word of the table, whose hash table is made anew for them; and words that it adds up at a time.
SPLIT_BYTES = 2 << 20
SPLIT_BYTES_PER_WORD = 24
SUM_WORDS = 1 << 13


def check_score_method(sm: str) -> str:
    """Validated method name (unknown names raise)."""
    if sm not in SCORE_METHODS:
        raise ValueError(f"unknown score method {sm!r}; expected one of {SCORE_METHODS}")
    return sm


def attr_word_counts(attrs: DataFrame) -> DataFrame:
    """``(s_key, am, attr)`` -> ``(s_key, am, w, n)`` with ``w = lower(attr)``."""
    return attrs.groupBy("s_key", "am", F.lower(F.col("attr")).alias("w")).agg(F.count(F.lit(1)).alias("n"))


# --- vector methods -------------------------------------------------------

def axes(lex: DataFrame, vectors: DataFrame, use_contrast: bool = True) -> DataFrame:
    """``(dim, axis)``; axis = mean(high) - mean(low) over the pole
    words, or over the greedy contrast pairs when ``use_contrast``."""
    low, high = poles(lex, vectors)
    both = low.withColumn("side", F.lit("low")).unionByName(high.withColumn("side", F.lit("high")))
    if use_contrast:
        # stored: the pairing and the means read the poles several times
        ensure_checkpoint_dir(lex.sparkSession)
        both = both.checkpoint()
        pairs = contrast_pairs(*(
            both.filter(F.col("side") == s).drop("side").toDF(*low.columns) for s in ("low", "high")))
        chosen = pairs.select("dim", F.explode(F.array(
            *[F.struct(F.lit(s).alias("side"), F.col(f"{s}_word").alias("word")) for s in ("low", "high")])).alias("c"))
        both = both.join(chosen.select("dim", "c.side", "c.word"), ["dim", "side", "word"])
    means = vector_mean(both.select("dim", "side", as_double("vec").alias("vec")), ["dim", "side"], "vec", "mean")
    of = {s: F.max(F.when(F.col("side") == s, F.col("mean"))).alias(s) for s in ("low", "high")}
    # two rows for each of the dimensions
    return means.groupBy("dim").agg(*of.values()).filter("low is not null and high is not null").select(
        "dim", F.zip_with("high", "low", lambda h, l: h - l).alias("axis")
    )


def centroids(lex: DataFrame, vectors: DataFrame) -> DataFrame:
    """``(dim, centroid)`` = mean of the unit seed vectors."""
    s = spread(seeds(lex, vectors), "dim", "word").select("dim", unit(as_double("vec")).alias("vec"))
    return vector_mean(s, ["dim"], "vec", "centroid")


def vector_word_scores(vectors: DataFrame, axis_df: DataFrame | None, centroid_df: DataFrame | None,
                       dims: list[str] = DIMENSIONS) -> DataFrame:
    """``(w, dim, sm, wscore)`` for sm in {axis, sim}: each vocabulary word is
    scored once per dimension. The per-dimension vectors are one row per
    dimension (bounded by the dimension count) and broadcast. Norms and unit
    vectors are made before a word meets the dimensions, once for all of them."""
    v = spread(vectors, "word").select(F.col("word").alias("w"), as_double("vec").alias("vec"))
    every_dim = F.explode(F.array(*[F.lit(d) for d in dims])).alias("dim")
    out = []
    if axis_df is not None:
        a = v.select("w", "vec", norm("vec").alias("n")).select("w", "vec", "n", every_dim)
        a = a.join(F.broadcast(axis_df.withColumn("axis_n", norm("axis"))), "dim")
        cos = F.when((F.col("n") > 0) & (F.col("axis_n") > 0), dot("vec", "axis") / (F.col("n") * F.col("axis_n")))
        out.append(a.select("w", "dim", F.lit("axis").alias("sm"), cos.otherwise(F.lit(0.0)).alias("wscore")))
    if centroid_df is not None:
        c = v.select("w", unit("vec").alias("u")).select("w", "u", every_dim)
        c = c.join(F.broadcast(centroid_df), "dim")
        out.append(c.select("w", "dim", F.lit("sim").alias("sm"), dot("u", "centroid").alias("wscore")))
    res = out[0]
    for o in out[1:]:
        res = res.unionByName(o)
    return res


# --- aggregation ------------------------------------------------------------

def word_score_table(lex: DataFrame, vectors: DataFrame | None = None, dims: list[str] = DIMENSIONS,
                     sms: list[str] = SCORE_METHODS, use_contrast: bool = True) -> DataFrame:
    """``(w, dim, sm, wscore)``: every scorable word once per dimension and
    method (lexicon scores for avg; cosines for axis and sim). Bounded by
    vocabulary x dimensions; it does not grow with the stories."""
    for sm in sms:
        check_score_method(sm)
    parts = []
    if "avg" in sms:
        lx = lex.filter(F.col("dim").isin(dims))
        parts.append(lx.select(F.col("word").alias("w"), "dim", F.lit("avg").alias("sm"),
                               F.col("score").alias("wscore")))
    vec_sms = [s for s in sms if s in ("axis", "sim")]
    if vec_sms:
        if vectors is None:
            raise ValueError("vector methods need a vector table")
        ax = axes(lex, vectors, use_contrast) if "axis" in vec_sms else None
        ce = centroids(lex, vectors) if "sim" in vec_sms else None
        parts.append(vector_word_scores(vectors, ax, ce, dims))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def coordinates(dims: list[str], sms: list[str]) -> list[tuple[str, str]]:
    return [(d, m) for d in dims for m in sms]


def _dims_of(coords: list[tuple[str, str]], sm: str) -> list[str]:
    return [d for d, m in coords if m == sm]


def wide_word_scores(word_scores: DataFrame, coords: list[tuple[str, str]]) -> DataFrame:
    """One row per word, one column ``k<i>`` per (dim, sm) coordinate."""
    cols = [
        F.max(F.when((F.col("dim") == d) & (F.col("sm") == m), F.col("wscore"))).alias(f"k{i}")
        for i, (d, m) in enumerate(coords)
    ]
    return word_scores.filter(F.col("dim").isin([d for d, _ in coords]) & F.col("sm").isin([m for _, m in coords])).groupBy(
        "w").agg(*cols)


def _exact_parts(k: Column) -> tuple[Column, Column]:
    """A multiple of 2^-24, of which sums are exact, and what is left of ``k``."""
    small = F.abs(k) < F.lit(1e8)
    high = F.when(small, F.rint(k * F.lit(2.0**24)) / F.lit(2.0**24)).otherwise(k)
    return high, F.when(small, k - high).when(k.isNotNull(), F.lit(0.0))


def _table_facts(wide: DataFrame, coords: list[tuple[str, str]]) -> tuple[int, list[int], list[bool]]:
    """Of a word table, in one pass: bytes of its rows and of their places in a hash
    table; for each coordinate, one that is null for the same words (the first of its
    method, else itself); and whether any of its values has a second exact part."""
    first = [next(j for j, (_, of) in enumerate(coords) if of == m) for _, m in coords]
    row = wide.agg(
        F.count(F.lit(1)), F.sum(F.octet_length("w")),
        *[F.count_if(F.col(f"k{i}").isNull() != F.col(f"k{j}").isNull()) for i, j in enumerate(first)],
        *[F.count_if(_exact_parts(F.col(f"k{i}"))[1] != 0) for i in range(len(coords))]).first()
    (words, chars), differ, rest = row[:2], row[2:2 + len(coords)], row[2 + len(coords):]
    return (words * 8 * (len(wide.columns) + 5) + (chars or 0),
            [i if differ[i] else j for i, j in enumerate(first)], [n > 0 for n in rest])


def word_matrix(wide: DataFrame, names: list[str], counted: list[str]) -> tuple[pa.Array, np.ndarray]:
    """The words of a word table and a row for each: its values (0 for none), and 1
    or 0 for each of the ``counted`` columns that has one."""
    t = wide.filter(F.col("w").isNotNull()).select("w", *names).toArrow()
    out = np.zeros((len(t), len(names) + len(counted)))
    for i, c in enumerate(names):
        out[:, i] = pc.fill_null(t[c], 0.0).to_numpy()
    for i, c in enumerate(counted, len(names)):
        out[:, i] = pc.is_valid(t[c]).to_numpy()
    return pa.concat_arrays(t["w"].chunks) if t.num_rows else pa.array([], pa.string()), out


def _slices(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Slices of batches, of up to ``most`` bytes of attributes; a longer row comes alone."""
    for rb in batches:
        col = rb.column("attrs")
        size = pc.binary_length(col) if not pa.types.is_list(col.type) else pc.multiply(pc.list_value_length(col), 8)
        ends = np.cumsum(pc.fill_null(size, 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < rb.num_rows:
            before = int(ends[start - 1]) if start else 0
            end = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield rb.slice(start, end - start)
            start = end


def _row_sums(of: np.ndarray, row: np.ndarray, matrix: np.ndarray, n: int, most: int = SUM_WORDS) -> np.ndarray:
    """Sums of the matrix's rows ``row`` (-1: none) for each of ``n`` stories; ``of``: story of each, ascending."""
    out = np.zeros((n, matrix.shape[1]))
    of, row = of[row >= 0], row[row >= 0]
    for at in range(0, len(row), most):
        part = of[at:at + most]
        first = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        out[part[first]] += np.add.reduceat(matrix[row[at:at + most]], first, axis=0)
    return out


def _attr_sums(shared, n_sums: int, most: int = SPLIT_BYTES):
    """Batches ``(s_key, am, attrs)`` -> ``(s_key, am, n_all, sums..., counts...)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, matrix = shared.value
        for rb in _slices(batches, max(most, SPLIT_BYTES_PER_WORD * len(words))):
            attrs = rb.column("attrs")
            text = not pa.types.is_list(attrs.type)
            if text:
                attrs = pc.ascii_split_whitespace(attrs)
            of = np.repeat(np.arange(len(rb)), pc.fill_null(pc.list_value_length(attrs), 0).to_numpy(zero_copy_only=False))
            w = attrs.flatten()
            row = pc.fill_null(pc.index_in(w, value_set=words.cast(w.type)), -1).to_numpy(zero_copy_only=False)
            if text:  # the pieces before and after outer whitespace are no words
                some = pc.greater(pc.binary_length(w), 0).to_numpy(zero_copy_only=False)
                of, row = of[some], row[some]
            sums = _row_sums(of, row, matrix, len(rb))
            yield pa.RecordBatch.from_arrays(
                [rb.column("s_key"), rb.column("am"), pa.array(np.bincount(of, minlength=len(rb)).astype(np.int64)),
                 *[pa.array(sums[:, i] if i < n_sums else sums[:, i].astype(np.int64)) for i in range(sums.shape[1])]],
                names=["s_key", "am", "n_all", *[f"c{i}" for i in range(sums.shape[1])]])

    return run


def _sums_of_lists(tables: list[DataFrame], wide: DataFrame, parts: list[list[str]], same_nulls: list[int]) -> DataFrame:
    """Sums and counts per (story, am) of attributes that come per story. ``parts``:
    columns of ``wide`` whose sums make up a coordinate's."""
    spark = wide.sparkSession
    names, counted = [c for own in parts for c in own], sorted(set(same_nulls))
    shared = spark.sparkContext.broadcast(word_matrix(wide, names, [parts[j][0] for j in counted]))
    sums = None
    for t in tables:
        text = t.schema["attrs"].dataType.typeName() == "string"
        key, low = t.schema["s_key"].dataType.simpleString(), F.lower("attrs") if text else F.transform("attrs", F.lower)
        of = ", ".join([f"s_key {key}, am string, n_all long", *[f"c{i} double" for i in range(len(names))],
                        *[f"c{i + len(names)} long" for i in range(len(counted))]])
        one = t.filter(F.col("attrs").isNotNull()).select("s_key", "am", low.alias("attrs")).mapInArrow(
            _attr_sums(shared, len(names)), of)
        sums = one if sums is None else sums.unionByName(one)
    # a key may come in several rows
    return sums.groupBy("s_key", "am").agg(
        F.sum("n_all").alias("n_all"),
        *[reduce(add, [F.sum(f"c{names.index(c)}") for c in own]).alias(f"num{i}") for i, own in enumerate(parts)],
        *[F.sum(f"c{len(names) + counted.index(j)}").alias(f"den{i}") for i, j in enumerate(same_nulls)])


def exploded_attrs(tables: list[DataFrame]) -> DataFrame:
    """``(s_key, am, attr)`` of attributes that come per story, as texts or as lists."""
    rows = [t.select("s_key", "am", F.explode(
        whitespace_words("attrs") if t.schema["attrs"].dataType.typeName() == "string" else F.col("attrs")).alias("attr"))
        for t in tables]
    return reduce(DataFrame.unionByName, rows)


def score_with_table(stories: DataFrame, attrs: DataFrame | list[DataFrame], word_scores: DataFrame, modes: DataFrame,
                     dims: list[str] = DIMENSIONS, ams: list[str] = ATTR_METHODS,
                     sms: list[str] = SCORE_METHODS, coords: list[tuple[str, str]] | None = None,
                     broadcast_bytes: int | None = None) -> DataFrame:
    """Score stories against a prepared word-score table; every story gets
    every coordinate (``coords``: some pairs of dims x sms).

    avg: graded lexicon -> mean score of found words, none found -> 0;
    unipolar lexicon -> sum of found scores / number of attributes, empty -> 0.
    axis/sim: mean word score over attributes with a vector, none -> null.

    Plan: the word-score table is pivoted to one row per word. Up to
    ``broadcast_bytes`` of it are broadcast to the attributes, whose scores are
    summed per (story, am). A larger one joins counts per (story, am, word)
    without a hint (AQE splits skewed words), and the products are summed.

    attrs: ``(s_key, am, attr)``, or a list of tables ``(s_key, am, attrs)`` with
    the attributes of a story, or some of them, as a text with whitespace between
    them or as an array: these are not exploded if the table is broadcast.
    """
    coords = coords or coordinates(dims, sms)
    wide = wide_word_scores(word_scores, coords).checkpoint()
    per_story_lists = isinstance(attrs, list)
    attrs = [t.filter(F.col("am").isin(ams)) for t in (attrs if per_story_lists else [attrs])]
    n_bytes, same_nulls, has_rest = _table_facts(wide, coords)
    if broadcast_bytes is None:
        broadcast_bytes = MATRIX_BYTES if per_story_lists else BROADCAST_BYTES
    if n_bytes <= broadcast_bytes:
        # means of lexicon scores are often ties of the rounding, so their sums must not
        # depend on the order of a story's words; means of cosines are none
        parts = [_exact_parts(F.col(f"k{i}"))[:1 + has_rest[i]] if m == "avg" else (F.col(f"k{i}"),)
                 for i, (_, m) in enumerate(coords)]
        wide = wide.select("w", *[p.alias(f"k{i}_{j}") for i, ps in enumerate(parts) for j, p in enumerate(ps)])
    if n_bytes <= broadcast_bytes and per_story_lists:
        per_story = _sums_of_lists(
            attrs, wide, [[f"k{i}_{j}" for j in range(len(ps))] for i, ps in enumerate(parts)], same_nulls)
    elif n_bytes <= broadcast_bytes:
        words = attrs[0].select("s_key", "am", F.lower(F.col("attr")).alias("w"))
        per_story = words.join(F.broadcast(wide), "w", "left").groupBy("s_key", "am").agg(
            F.count(F.lit(1)).alias("n_all"),
            *[reduce(add, [F.sum(f"k{i}_{j}") for j in range(len(ps))]).alias(f"num{i}") for i, ps in enumerate(parts)],
            # coordinates that are null for the same words share one count
            *[F.count(f"k{j}_0").alias(f"den{i}") for i, j in enumerate(same_nulls)])
    else:
        j = attr_word_counts(exploded_attrs(attrs) if per_story_lists else attrs[0]).join(wide, "w", "left")
        n = F.col("n")
        aggs = [F.sum(n).alias("n_all")]
        for i in range(len(coords)):
            k = F.col(f"k{i}")
            aggs.append(F.sum(n * k).alias(f"num{i}"))
            aggs.append(F.sum(F.when(k.isNotNull(), n)).alias(f"den{i}"))
        per_story = j.groupBy("s_key", "am").agg(*aggs)
    keep = [c for c in stories.columns if c not in ("s_key", "text")]
    base = stories.select("s_key", *keep, F.explode(F.array(*[F.lit(x) for x in ams])).alias("am"))
    g = base.join(per_story, ["s_key", "am"], "left")
    long = g.select(
        "s_key", *keep, "am", "n_all",
        F.explode(F.array(*[
            F.struct(F.lit(d).alias("dim"), F.lit(m).alias("sm"), F.col(f"num{i}").alias("num"),
                     F.col(f"den{i}").alias("den"))
            for i, (d, m) in enumerate(coords)
        ])).alias("c"),
    ).select("s_key", *keep, "am", "n_all", "c.*")
    res = long.join(F.broadcast(modes), "dim", "left")
    avg_score = F.when(
        F.col("unipolar"), F.coalesce(F.try_divide(F.col("num"), F.col("n_all")), F.lit(0.0))
    ).otherwise(F.coalesce(F.try_divide(F.col("num"), F.col("den")), F.lit(0.0)))
    vec_score = F.try_divide(F.col("num"), F.col("den"))
    score = F.when(F.col("sm") == "avg", avg_score).otherwise(vec_score)
    return res.withColumn("score", score.cast("double")).drop("num", "den", "n_all", "unipolar")


def score_stories(stories: DataFrame, attrs: DataFrame | list[DataFrame], lex: DataFrame, vectors: DataFrame | None = None,
                  dims: list[str] = DIMENSIONS, ams: list[str] = ATTR_METHODS, sms: list[str] = SCORE_METHODS,
                  use_contrast: bool = True, coords: list[tuple[str, str]] | None = None) -> DataFrame:
    """C14: one row per (story, am, dim, sm). With ``coords``, some pairs of
    dims x sms, nothing is computed for other pairs.

    stories: ``(s_key, ...)`` - every story gets every coordinate.
    attrs: ``(s_key, am, attr)`` exploded attribute lists (duplicates kept), or
    tables ``(s_key, am, attrs)`` as ``score_with_table`` takes them.
    lex: ``(dim, word, score, ord)``; vectors: ``(word, vec)``.
    """
    coords = coords or coordinates(dims, sms)
    parts = []
    for sm in dict.fromkeys(m for _, m in coords):
        own = _dims_of(coords, sm)
        parts.append(word_score_table(lex.filter(F.col("dim").isin(own)), vectors, own, [sm], use_contrast))
    ws = parts[0]
    for p in parts[1:]:
        ws = ws.unionByName(p)
    return score_with_table(stories, attrs, ws, lexicon_modes(lex), ams=ams, coords=coords)


def blank_meaningless(scores: DataFrame) -> DataFrame:
    """appearance/intellect with the axis method -> null (both writers)."""
    from storylens.constants import BLANK_DIMS_FOR_AXIS

    return scores.withColumn(
        "score",
        F.when(F.col("dim").isin(BLANK_DIMS_FOR_AXIS) & (F.col("sm") == "axis"), F.lit(None).cast("double"))
        .otherwise(F.col("score")),
    )
