"""Matched-prompt sampling, split-half control and bootstrap intervals
(N08, N18-N26).

Randomness is a seeded hash: a row's position in a draw is
``md5(concat_ws(':', s_id, trial, seed))``, so results do not depend on
partitioning or re-execution, and a recomputed task draws the same rows.
Draws use a rank filter that Spark limits per group before the shuffle, and
split ranks a range-partitioned global order, so a prompt holding a third of
all stories is still spread over many tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storylens.constants import (
    BEST_AM,
    BOOTSTRAP_RESAMPLES,
    SAMPLE_SIZE,
    SAMPLE_TRIALS,
    SPLIT_MIN_STORIES,
)
from storylens.functions.indexing import sequential_index
from storylens.functions.stats import grouped_quantiles
from storylens.operators.analysis import at_best_sm

DEFAULT_SEED = 7


def _trials(n: int):
    return F.explode(F.sequence(F.lit(1), F.lit(n))).alias("trial")


def _draw_key(seed: int):
    return F.md5(F.concat_ws(":", F.col("s_id"), F.col("trial").cast("string"), F.lit(str(seed))))


def draw_k(d: DataFrame, keys: list[str], k: int, seed: int) -> DataFrame:
    """The first `k` rows per (group, trial) in ``(md5 key, s_id)`` order. A
    rank filter becomes a group limit before the shuffle: each task sends `k`
    rows of a group at most, however many the group has."""
    w = Window.partitionBy(*keys, "trial").orderBy(_draw_key(seed), "s_id")
    return d.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k).drop("_rn")


def sample_group_stats(z: DataFrame, keys: list[str], n_samples: int = SAMPLE_SIZE,
                       n_trials: int = SAMPLE_TRIALS, seed: int = DEFAULT_SEED) -> DataFrame:
    """For each group with at least `n_samples` stories, draw
    `n_samples` without replacement `n_trials` times; mean and population std
    of each draw, averaged over the trials."""
    d = z.filter(F.col("z_score").isNotNull()).select(*keys, "s_id", "z_score")
    big = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= n_samples).drop("_n")
    d = d.join(big, keys, "left_semi").select(*keys, "s_id", "z_score", _trials(n_trials))
    drawn = draw_k(d, keys, n_samples, seed)
    per_trial = drawn.groupBy(*keys, "trial").agg(
        F.avg("z_score").alias("m"), F.stddev_pop("z_score").alias("s")
    )
    return per_trial.groupBy(*keys).agg(F.avg("m").alias("mean"), F.avg("s").alias("std"))


def comet_best(z: DataFrame, am: str = BEST_AM) -> DataFrame:
    return at_best_sm(z).filter(F.col("am") == am)


def matched_differences(z: DataFrame, by_pov: bool, seed: int = DEFAULT_SEED) -> DataFrame:
    """N18/N19 per writer + N20 match on (POV, prompt) or prompt + N21 differences."""
    base = comet_best(z).withColumnRenamed("s_pov", "pov").withColumnRenamed("p_ind", "pid")
    keys = ["writer", "dim", "pov", "pid"] if by_pov else ["writer", "dim", "pid"]
    st = sample_group_stats(base, keys, seed=seed).filter(F.col("mean").isNotNull() & F.col("std").isNotNull())
    mkeys = [k for k in keys if k != "writer"]
    h = st.filter(F.col("writer") == "human").select(*mkeys, F.col("mean").alias("human_mean"), F.col("std").alias("human_std"))
    m = st.filter(F.col("writer") == "gpt-3.5").select(*mkeys, F.col("mean").alias("gpt_mean"), F.col("std").alias("gpt_std"))
    j = h.join(m, mkeys)
    return j.withColumn("mean_diff", F.col("human_mean") - F.col("gpt_mean")).withColumn(
        "std_diff", F.col("human_std") - F.col("gpt_std")
    )


def difference_summary(by_pov: DataFrame) -> DataFrame:
    """Mean and sample std of ``mean_diff`` by (dim, pov) and by dim in one
    aggregation with grouping sets (``pov`` null on the dim level)."""
    return by_pov.rollup("dim", "pov").agg(
        F.avg("mean_diff").alias("diff_mean"), F.stddev_samp("mean_diff").alias("diff_std"),
        F.count(F.lit(1)).alias("n"),
    ).filter(F.col("dim").isNotNull())


def box_stats(df: DataFrame, keys: list[str], value: str = "mean_diff") -> DataFrame:
    """Quartiles (linear interpolation), whiskers at the last datum within
    1.5 IQR of the box, and the outlier count."""
    q = grouped_quantiles(df, keys, value, {"q1": 0.25, "med": 0.5, "q3": 0.75})
    # one quartile row per group: the group count is bounded by the report keys
    j = df.join(F.broadcast(q), keys)
    lo_f = F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))
    hi_f = F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))
    v = F.col(value)
    return j.groupBy(*keys, "q1", "med", "q3").agg(
        F.min(F.when(v >= lo_f, v)).alias("whisker_lo"),
        F.max(F.when(v <= hi_f, v)).alias("whisker_hi"),
        F.count_if((v < lo_f) | (v > hi_f)).alias("n_outliers"),
    )


def split_halves(z: DataFrame, n_trials: int = SAMPLE_TRIALS, seed: int = DEFAULT_SEED,
                 min_stories: int = SPLIT_MIN_STORIES) -> DataFrame:
    """Per trial, prompts with >= `min_stories` scored human stories are
    shuffled and split: floor(n/2) to half 1, the rest to half 2.

    The shuffle order is a rank inside each (trial, dim, prompt) taken from a
    range-partitioned global order (no window over a prompt)."""
    h = comet_best(z).filter((F.col("writer") == "human") & F.col("z_score").isNotNull())
    h = h.select("dim", "p_ind", "s_id", "z_score")
    n = h.groupBy("dim", "p_ind").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= min_stories)
    h = h.join(n, ["dim", "p_ind"]).select("dim", "p_ind", "s_id", "z_score", "_n", _trials(n_trials))
    h = h.withColumn("_h", _draw_key(seed))
    g = sequential_index(h, ["trial", "dim", "p_ind", "_h", "s_id"], "_g")
    g0 = g.groupBy("trial", "dim", "p_ind").agg(F.min("_g").alias("_g0"))
    g = g.join(g0, ["trial", "dim", "p_ind"]).withColumn("_rn", F.col("_g") - F.col("_g0") + 1)
    return g.select(
        "trial", "dim", "p_ind", "s_id", "z_score",
        F.when(F.col("_rn") <= F.floor(F.col("_n") / 2), F.lit(1)).otherwise(F.lit(2)).alias("half"),
    )


def control_differences(z: DataFrame, n_trials: int = SAMPLE_TRIALS, seed: int = DEFAULT_SEED) -> DataFrame:
    """Per trial and dim, mean over prompts of (half 1 - half 2) and of
    (half 1 - machine), as ``(trial, dim, type, diff)``."""
    halves = split_halves(z, n_trials, seed)
    hm = halves.groupBy("trial", "dim", "p_ind", "half").agg(F.avg("z_score").alias("zm"))
    h1 = hm.filter(F.col("half") == 1).select("trial", "dim", "p_ind", F.col("zm").alias("h1"))
    h2 = hm.filter(F.col("half") == 2).select("trial", "dim", "p_ind", F.col("zm").alias("h2"))
    mach = comet_best(z).filter((F.col("writer") == "gpt-3.5") & F.col("z_score").isNotNull())
    mm = mach.groupBy("dim", "p_ind").agg(F.avg("z_score").alias("mz"))
    ctrl = h1.join(h2, ["trial", "dim", "p_ind"]).groupBy("trial", "dim").agg(
        F.avg(F.col("h1") - F.col("h2")).alias("diff")
    ).withColumn("type", F.lit("control"))
    vs = h1.join(mm, ["dim", "p_ind"]).groupBy("trial", "dim").agg(
        F.avg(F.col("h1") - F.col("mz")).alias("diff")
    ).withColumn("type", F.lit("gpt-3.5"))
    return ctrl.unionByName(vs).select("trial", "dim", "type", "diff")


# --- bootstrap ----------------------------------------------------------------

# A resample draws n of a group's n rows with replacement. Rows are dealt to
# blocks by a hash of their key, and a block orders its own. The n draws of a
# replicate go down a binary tree over the blocks' counts: a node with m draws
# hands a binomial share to its left half, by a generator that is seeded with the
# group, the node and the seed, so all blocks under a node agree without meeting.
# A block with m draws takes them from number streams of its rows (row k,
# replicate r: seed(k) * STEP^r mod PRIME; more draws than rows go on with the
# seeds times MORE), and such a number modulo the block's rows is the row drawn.
PRIME = 2**31 - 1
STEP = 48271
MORE = 69621
# Rows of a block, about, and blocks of a group at most.
BLOCK = 1 << 15
MAX_BLOCKS = 1 << 16


def steps(resamples: int) -> np.ndarray:
    """STEP^r mod PRIME for r = 1 .. resamples."""
    out, x = [], 1
    for _ in range(resamples):
        x = x * STEP % PRIME
        out.append(x)
    return np.array(out, np.int64)


def tree_path(sizes: np.ndarray, block: int) -> list[tuple[int, int, int, int]]:
    """The way down to a block: for each node ``(first, last, rows on the left,
    rows)``; ``sizes``: rows of each block."""
    before = np.concatenate([[0], np.cumsum(sizes)])
    lo, hi, out = 0, len(sizes), []
    while hi - lo > 1:
        mid = (lo + hi) // 2
        out.append((lo, hi, int(before[mid] - before[lo]), int(before[hi] - before[lo])))
        lo, hi = (lo, mid) if block < mid else (mid, hi)
    return out


def dealt_draws(group: str, block: int, path: list[tuple[int, int, int, int]], n: int, resamples: int, seed: int) -> np.ndarray:
    """Draws of each replicate that go to a block of a group of n rows."""
    m = np.full(resamples, n, np.int64)
    for lo, hi, left, rows in path:
        key = int.from_bytes(hashlib.md5(f"{group}:{seed}:{lo}:{hi}".encode()).digest())
        share = np.random.Generator(np.random.Philox(key=key)).binomial(m, left / rows)
        m = share if block < (lo + hi) // 2 else m - share
    return m


def block_sums(seeds: np.ndarray, values: np.ndarray, m: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Sum of the values that each replicate draws: m[r] of the block's rows."""
    total, n, most = np.zeros(len(m)), len(seeds), int(m.max(initial=0))
    for at in range(0, most, 256):
        draw = np.arange(at, min(at + 256, most))
        own = seeds[draw % n]
        for turn in np.unique(draw // n).tolist():
            own = np.where(draw // n == turn, own * pow(MORE, turn, PRIME) % PRIME, own)
        row = own[:, None] * step[None, :] % PRIME % n
        total += np.where(draw[:, None] < m[None, :], values[row], 0.0).sum(0)
    return total


def _paths(keys: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*keys, "_b", "_at", "_n", "_path"]
        for b in batches:
            for row in b.to_pylist():
                sizes = np.array([x["_c"] for x in row["_sizes"]], np.int64)
                blocks = [x["_b"] for x in row["_sizes"]]
                many = len(blocks)
                ways = [[dict(zip(("lo", "hi", "left", "rows"), x, strict=True)) for x in tree_path(sizes, i)] for i in range(many)]
                kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("lo", "hi", "left", "rows")]))
                yield pa.RecordBatch.from_arrays(
                    [*[pa.array([row[k]] * many, pa.string()) for k in keys], pa.array(blocks, pa.int64()),
                     pa.array(range(many), pa.int64()), pa.array([int(sizes.sum())] * many), pa.array(ways, kind)], names)

    return run


def _block(keys: list[str], resamples: int, seed: int):
    step = steps(resamples)

    def run(rows: pa.Table, way: pa.Table) -> pa.Table:
        rows = rows.sort_by([("_seed", "ascending"), ("_k", "ascending")])
        first = way.slice(0, 1).to_pylist()[0]
        path = [(x["lo"], x["hi"], x["left"], x["rows"]) for x in first["_path"]]
        m = dealt_draws("|".join(map(str, (first[k] for k in keys))), first["_at"], path, first["_n"], resamples, seed)
        total = block_sums(rows.column("_seed").to_numpy(), rows.column("_v").to_numpy(), m, step)
        return pa.Table.from_arrays(
            [*[pa.array([first[k]] * resamples, pa.string()) for k in keys], pa.array(np.arange(1, resamples + 1)),
             pa.array(m), pa.array(total)], [*keys, "_r", "_m", "_s"])

    return run


def replicate_sums(df: DataFrame, keys: list[str], value: str, row_key: str, resamples: int = BOOTSTRAP_RESAMPLES,
                   seed: int = DEFAULT_SEED, block: int = BLOCK) -> DataFrame:
    """``keys, _r, _m, _s``: draws and sum of the drawn values for each block and
    replicate. A group's draws add up to its rows in every replicate."""
    number = F.conv(F.substring(F.md5(F.concat_ws(":", F.col(row_key).cast("string"), F.lit(str(seed))).cast("binary")), 1, 7), 16, 10)
    d = df.filter(F.col(value).isNotNull()).select(
        *[F.col(k).cast("string").alias(k) for k in keys], (number.cast("long") + 1).alias("_seed"),
        F.col(row_key).cast("string").alias("_k"), F.col(value).cast("double").alias("_v"))
    many = F.least(F.ceil(F.count(F.lit(1)) / F.lit(block)), F.lit(MAX_BLOCKS)).cast("int")
    groups = d.groupBy(*keys).agg(many.alias("_many")).select(*[F.col(k).alias(f"_g{i}") for i, k in enumerate(keys)], "_many")
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_g{i}")) for i, k in enumerate(keys)))
    dealt = d.join(groups, same).select(*keys, "_seed", "_k", "_v", F.pmod(
        F.xxhash64("_k"), F.col("_many")).cast("long").alias("_b"))
    # MAX_BLOCKS counts of a group at most
    sizes = dealt.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_c")).groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("_b", "_c"))).alias("_sizes"))
    kind = "array<struct<lo: long, hi: long, left: long, rows: long>>"
    ways = sizes.mapInArrow(_paths(keys), ", ".join([*[f"{k} string" for k in keys], f"_b long, _at long, _n long, _path {kind}"]))
    schema = ", ".join([*[f"{k} string" for k in keys], "_r long, _m long, _s double"])
    return dealt.groupBy(*keys, "_b").cogroup(ways.groupBy(*keys, "_b")).applyInArrow(_block(keys, resamples, seed), schema)


def bootstrap_mean(df: DataFrame, keys: list[str], value: str, row_key: str,
                   resamples: int = BOOTSTRAP_RESAMPLES, seed: int = DEFAULT_SEED,
                   level: float = 0.95, block: int = BLOCK) -> DataFrame:
    """Group mean with a percentile bootstrap interval, from resamples
    of n of n rows. Draws depend on row keys, the group and the seed alone, not
    on partitioning."""
    d = df.filter(F.col(value).isNotNull()).select(*[F.col(k).cast("string").alias(k) for k in keys],
                                                   F.col(value).cast("double").alias("_v"))
    mean = d.groupBy(*keys).agg(F.avg("_v").alias("mean"), F.count(F.lit(1)).alias("n"))
    sums = replicate_sums(df, keys, value, row_key, resamples, seed, block)
    rep = sums.groupBy(*keys, "_r").agg((F.sum("_s") / F.sum("_m")).alias("_mean"))
    lo, hi = (1 - level) / 2, 1 - (1 - level) / 2
    ci = rep.groupBy(*keys).agg(
        F.percentile(F.col("_mean"), F.lit(lo)).alias("ci_lo"), F.percentile(F.col("_mean"), F.lit(hi)).alias("ci_hi"))
    return mean.join(ci, keys, "left")


def pov_writer_intervals(z: DataFrame, use_z: bool = True, **kw) -> DataFrame:
    """Mean and 95 % bootstrap interval by (dim, POV, writer) for the
    three plotted coordinates: all/avg, comet/best, sub/best."""
    from storylens.operators.analysis import best_sm

    value = "z_score" if use_z else "score"
    sel = z.filter(
        ((F.col("am") == "all") & (F.col("sm") == "avg"))
        | (F.col("am").isin("comet", "sub") & (F.col("sm") == best_sm()))
    )
    sel = sel.withColumn("row_key", F.concat_ws("|", "writer", "s_id"))
    return bootstrap_mean(sel, ["dim", "am", "sm", "s_pov", "writer"], value, "row_key", **kw)


def trial_summary(diffs: DataFrame, **kw) -> DataFrame:
    """Mean and bootstrap interval of N25 per (dim, type)."""
    return bootstrap_mean(diffs, ["dim", "type"], "diff", "trial", **kw)
