"""SimHash near-duplicates with the generalised pigeonhole principle.

Fingerprints of a bounded sample show which of the 64 bits go together:
correlated bits are grouped into one partition. If two fingerprints differ in
at most t bits and n partitions have thresholds that sum to t - n + 1 (-1: the
partition is not probed), some partition differs by no more than its
threshold. Dynamic programming allots the thresholds that cost least by the
candidate counts estimated on the sample. The sample decides costs alone: any
allotment finds all links.

Equal fingerprints are one class. Each class is indexed under its value in
every probed partition and, for a threshold over 0, under the values near it.
Members of a bucket are compared bit by bit. A bucket of more than
``BUCKET`` classes is split again by the same principle over its unused bits
(t + 1 parts, one of which must agree), which ends since a bucket with r
unused bits has at most 2^r classes of one value; no bucket is cut off. A
bucket hands on a spanning forest of its links, not all pairs, and the forests
are joined to connected components.

Texts of fewer words than a shingle are one shingle; texts without words have
fingerprint zero. Null texts are empty ones. Repeated rows have equal
fingerprints and fall into one component; null doc_ids never name a component
unless all its rows have none (null then). An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storylens.llm.common import prepare, staged, texts
from storylens.llm.components import components
from storylens.llm.words import spaced_words

BITS = 64
SHINGLE = 3
DISTANCE = 2
SEED = 42
# Fingerprints of the sample that the partitions are planned on, at most.
SAMPLE = 2000
# Numbers of partitions that the plan chooses from.
PARTITIONS = (2, 3, 4)
# Classes of a bucket that are compared with one another; more split it.
BUCKET = 2048
# Shingles whose bits are summed at a time.
BLOCK = 1 << 15


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """A bit is 1 if it is set in over half the XXH64 values of the shingles."""
    import xxhash

    words = spaced_words(text)
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]])
    k = min(shingle, len(words))
    digest, n = xxhash.xxh64_intdigest, len(words) - k + 1
    total = np.zeros(BITS, np.int64)
    for at in range(0, n, BLOCK):
        to = min(at + BLOCK, n)
        h = np.array([digest(joined[s:e], SEED) for s, e in
                      zip(starts[at:to].tolist(), (ends[at + k - 1:to + k - 1] - 1).tolist(), strict=True)], np.uint64)
        total += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(
            0, dtype=np.int64)
    return int(sum(1 << i for i in np.flatnonzero(2 * total > n).tolist()))


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(text: Column, shingle: int = SHINGLE) -> Column:
    """Fingerprint of a text column as a (signed) long."""

    @F.pandas_udf("long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([signed(fingerprint(t, shingle)) for t in s], dtype="int64")

    return run.asNondeterministic()(text)


def bit_groups(bits: np.ndarray, n: int) -> list[list[int]]:
    """``n`` groups of nearly equal size; each grows by the free bit that goes
    best with those it has. ``bits``: sample x 64 of 0 and 1."""
    x = bits - bits.mean(0)
    scale = np.sqrt((x * x).sum(0))
    c = np.abs(x.T @ x) / np.maximum(np.outer(scale, scale), 1e-12)
    free, groups = set(range(BITS)), []
    for k in range(n):
        left = sorted(free)
        group = [max(left, key=lambda i: (c[i, left].sum(), -i))]
        free.discard(group[0])
        while len(group) < (BITS - sum(map(len, groups))) // (n - k):
            best = max(sorted(free), key=lambda i: (c[i, group].mean(), -i))
            group.append(best)
            free.discard(best)
        groups.append(sorted(group))
    return groups


def allot(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds from -1 up, one for each partition, that sum to ``total`` at
    least cost; ``costs[i][e + 1]``: cost of threshold e in partition i."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for s, (cost, given) in best.items():
            for at, c in enumerate(row):
                new = (cost + c, [*given, at - 1])
                if s + at - 1 not in step or new < step[s + at - 1]:
                    step[s + at - 1] = new
        best = step
    return best[total]


def plan(sample: np.ndarray, size: int, distance: int = DISTANCE) -> list[tuple[int, int]]:
    """``(mask, threshold)`` of each probed partition, for ``size`` distinct
    fingerprints of which ``sample`` (uint64) are some."""
    bits = np.unpackbits(sample.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(float)
    if len(sample) < 2:
        bits = np.zeros((2, BITS))
    pairs = max(1, len(sample) * (len(sample) - 1) // 2)
    choices = []
    for n in PARTITIONS:
        groups = bit_groups(bits, n)
        costs = []
        for g in groups:
            x = bits[:, g]
            differ = x.sum(1)[:, None] + x.sum(1)[None, :] - 2 * x @ x.T
            upper = differ[np.triu_indices(len(x), 1)]
            row = [0.0]
            for e in range(distance + 1):
                keys = sum(comb(len(g), j) for j in range(e + 1))
                share = ((upper <= e).sum() + keys / 2 ** len(g)) / pairs
                row.append(float(size) * keys + share * size * (size - 1) / 2)
            costs.append(row)
        cost, given = allot(costs, distance - n + 1)
        choices.append((cost, [(sum(1 << b for b in g), e) for g, e in zip(groups, given, strict=True) if e >= 0]))
    return min(choices)[1]


def keys_near(mask: int, threshold: int) -> list[int]:
    """What to flip in a value to get all values within the threshold."""
    bits = [1 << b for b in range(BITS) if mask >> b & 1]
    return [sum(c) for e in range(threshold + 1) for c in combinations(bits, e)]


def _split_rest(distance: int):
    """Buckets too large to compare: each member goes to a bucket for each of
    distance + 1 parts of the bits that its bucket's mask does not use."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list[int]] = {}
        for b in batches:
            masks, values, fps = (b.column(i).to_pylist() for i in range(3))
            out: list[list[int]] = [[], [], []]
            for m, v, f in zip(masks, values, fps, strict=True):
                if m not in parts:
                    rest = [i for i in range(BITS) if not m >> i & 1]
                    parts[m] = [sum(1 << i for i in rest[k::distance + 1]) for k in range(distance + 1)]
                for p in parts[m]:
                    out[0].append(signed((m | p) & (1 << 64) - 1))
                    out[1].append(signed((v & m | f & p) & (1 << 64) - 1))
                    out[2].append(f)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["mask", "value", "fp"])

    return run


def forest(members: list[int], distance: int) -> list[tuple[int, int]]:
    """Links (fingerprint, its root) of a spanning forest of the members that
    differ in at most ``distance`` bits."""
    root = {m: m for m in members}

    def top(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    if len(members) < 32:
        for i, a in enumerate(members):
            for b in members[:i]:
                if ((a ^ b) & (1 << 64) - 1).bit_count() <= distance:
                    root[top(a)] = top(b)
    else:
        x = np.array(members, np.int64).view(np.uint64)
        for i in range(1, len(x)):
            for j in np.flatnonzero(np.bitwise_count(x[:i] ^ x[i]) <= distance).tolist():
                root[top(members[i])] = top(members[j])
    return [(m, top(m)) for m in members if top(m) != m]


def _links(distance: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [x for members in b.column(0).to_pylist() for x in forest(members, distance)]
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in got], pa.int64()),
                                              pa.array([c for _, c in got], pa.int64())], ["a", "b"])

    return run


def links(classes: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Links ``a, b`` that connect all fingerprints (distinct longs ``fp``) of
    which some chain of pairs within ``distance`` bits consists."""
    spark = classes.sparkSession
    size = classes.count()
    some = classes.orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).toPandas()["fp"].to_numpy(np.int64).view(np.uint64)
    parts = []
    for mask, threshold in plan(some, size, distance):
        flips = F.array(*[F.lit(signed(x)) for x in keys_near(mask, threshold)])
        own = F.col("fp").bitwiseAND(F.lit(signed(mask)))
        rows = classes.select(F.lit(signed(mask)).alias("mask"), own.alias("own"), "fp", F.explode(flips).alias("flip"))
        parts.append(rows.select("mask", F.col("own").bitwiseXOR(F.col("flip")).alias("value"), "fp"))
    level = parts[0]
    for p in parts[1:]:
        level = level.union(p)
    found = None
    for _ in range(BITS):
        level = staged(level, "buckets")
        large = staged(level.groupBy("mask", "value").count().where(F.col("count") > BUCKET).select("mask", "value"),
                       "large")
        n_large = large.count()
        small = level.join(large, ["mask", "value"], "left_anti") if n_large else level
        # a bucket has BUCKET members at most here
        met = small.groupBy("mask", "value").agg(F.collect_set("fp").alias("members")).where(F.size("members") > 1)
        got = met.select("members").mapInArrow(_links(distance), "a long, b long")
        found = got if found is None else found.union(got)
        if not n_large:
            break
        hot = level.join(large, ["mask", "value"], "left_semi").select("mask", "value", "fp")
        level = hot.mapInArrow(_split_rest(distance), "mask long, value long, fp long").distinct()
    return spark.createDataFrame([], "a long, b long") if found is None else found


def components_of(classes: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """``classes`` (distinct ``fp``, and ``first``, the least row of each) with
    ``least``, the smallest ``first`` of the connected component."""
    classes = staged(classes, "classes")
    parts = staged(components(links(classes.select("fp"), distance)), "components")
    joined = classes.join(parts, classes["fp"] == parts["node"], "left").select(
        "fp", "first", F.coalesce("component", "fp").alias("component"))
    least = joined.groupBy("component").agg(F.min("first").alias("least"))
    return joined.join(least, "component").select("fp", "first", "least")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row of ``docs``."""
    prepare(docs.sparkSession)
    rows = staged(texts(docs).select("doc_id", fingerprints(F.col("text"), shingle).alias("fp")), "fingerprints")
    named = components_of(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), distance).select(
        F.col("fp").alias("key"), F.col("least").alias("component_id"))
    return rows.join(named, rows["fp"] == named["key"]).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """One row of each component, with all its columns: that of the smallest
    doc_id (a null one counts as larger than any), of repeated rows the first."""
    prepare(docs.sparkSession)
    # the rows' own columns stand in a struct, so none of their names can clash
    rows = staged(docs.select(F.struct(*docs.columns).alias("own"), F.monotonically_increasing_id().alias("at"),
                              fingerprints(F.col("text"), shingle).alias("fp")), "fingerprints")
    order = F.struct(F.col("own.doc_id").isNull().alias("none"), F.col("own.doc_id").alias("id"), F.col("at").alias("row"))
    kept = components_of(rows.groupBy("fp").agg(F.min(order).alias("first")), distance)
    kept = kept.where(F.col("first") == F.col("least")).select(F.col("least.row").alias("at"))
    return rows.join(kept, "at", "left_semi").select("own.*")
