"""Quality classifier: ridge regression on random Fourier features of document
statistics, with isotonic calibration.

Statistics of a text (bytes, words, lines) are standardised and mapped by
``cos(x W + b)``, whose inner products approximate a Gaussian kernel. Each
partition sums its normal equations ``Z'Z, Z'y``; the sums give the ridge
weights. Raw scores of other labelled rows are counted in fixed bins,
and pool-adjacent-violators over the bins gives the calibration.

The model is fitted on at most ``MAX_ROWS`` labelled documents: those with the
smallest hash of their doc_id, so the choice does not depend on file order.
Labels, language, source and doc_id never enter a score.

Null and empty texts have all statistics 0 and a score like any other. Rows
without label are not learned from; a document with several equal labels
counts once, one with differing labels as each of them. With no labelled row,
or with one class alone, the score is the share of good labels (0.5 without
any). Repeated rows each get their score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storylens.llm.common import crc_remainder, prepare, staged

# Labelled documents that a model is fitted on, at most.
MAX_ROWS = 40_000
# Random features, kernel width in standard deviations, ridge, seed.
FEATURES = 384
WIDTH = 4.0
RIDGE = 1e-2
SEED = 20240229
# Bins of raw scores for the calibration, and the range they cover.
BINS = 2048
LOW, HIGH = -0.5, 1.5
# One labelled row in so many calibrates; the others fit the weights.
CALIBRATE = 4
# Rows of the fit are dealt to so many partial sums.
PARTS = 8
# A document is accepted from this score on.
ACCEPT = 0.3

_UPPER = np.arange(65, 91)
_LOWER = np.arange(97, 123)
_DIGIT = np.arange(48, 58)
_SPACE = np.array([9, 10, 11, 12, 13, 32])
_COMMON = np.array([39, 44, 45, 46])  # ' , - .
_ODD = np.array([35, 36, 37, 38, 42, 124, 60, 62, 64, 94, 95, 126, 33, 63, 92, 123, 125])
NAMES = ("log_bytes", "upper", "digit", "space", "high", "common_punctuation", "odd_punctuation", "bars", "exclaims",
         "control", "log_words", "word_length", "word_length_spread", "distinct_words", "top_word", "repeated_pairs",
         "log_lines", "repeated_lines", "line_words", "capital_words", "stops_a_word", "entropy", "longest_word")


def statistics(text: str | None) -> list[float]:
    """Document statistics, by ``NAMES``."""
    raw = (text or "").encode()
    if not raw:
        return [0.0] * len(NAMES)
    n = len(raw)
    hist = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = raw.split()
    m = max(1, len(words))
    sizes = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    counts: dict = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    pairs = len(set(zip(words, words[1:], strict=False)))
    lines = [x for x in raw.split(b"\n") if x]
    p = hist[hist > 0] / n
    upper = hist[_UPPER].sum()
    return [np.log1p(n), upper / n, hist[_DIGIT].sum() / n, hist[_SPACE].sum() / n, hist[128:].sum() / n,
            hist[_COMMON].sum() / n, hist[_ODD].sum() / n, hist[124] / n, hist[33] / n,
            (hist[:9].sum() + hist[14:32].sum() + hist[127]) / n, np.log1p(len(words)), sizes.mean(), sizes.std(),
            len(counts) / m, max(counts.values(), default=0) / m, 1 - pairs / max(1, m - 1) if m > 1 else 0.0,
            np.log1p(len(lines)), 1 - len(set(lines)) / max(1, len(lines)), np.log1p(m / max(1, len(lines))),
            upper / m, hist[46] / m, float(-(p * np.log(p)).sum()), np.log1p(sizes.max())]


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    levels: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        return fourier((x - self.mean) / self.scale)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), self.knots, self.levels)


def fourier(x: np.ndarray, features: int = FEATURES, width: float = WIDTH, seed: int = SEED) -> np.ndarray:
    """Random Fourier features of a Gaussian kernel of that width, the
    statistics themselves, and a constant."""
    rng = np.random.default_rng(seed)
    w = rng.normal(0, 1 / width, (x.shape[1], features))
    x = np.clip(x, -8, 8)
    return np.hstack([np.sqrt(2 / features) * np.cos(x @ w + rng.uniform(0, 2 * np.pi, features)), x / 8,
                      np.ones((len(x), 1))])


def isotonic(n: np.ndarray, good: np.ndarray) -> np.ndarray:
    """Pool adjacent violators: the non-decreasing fit of good / n over bins
    with n > 0, one level for each bin."""
    blocks: list[list[float]] = []
    for k, g in zip(n, good, strict=True):
        blocks.append([float(k), float(g), 1])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            k1, g1, c1 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + k1, blocks[-1][1] + g1, blocks[-1][2] + c1]
    return np.concatenate([np.full(int(c), g / k) for k, g, c in blocks]) if blocks else np.zeros(0)


def _sums(rows: DataFrame, of, width: int) -> np.ndarray:
    """Sum over ``PARTS`` partial arrays, each summed where its rows are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for b in batches:
            if b.num_rows:
                x = np.array(b.column(0).to_pylist(), float)
                total += of(x, np.array(b.column(1).to_pylist(), float))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["total"])

    parts = rows.select("stats", "label").mapInArrow(run, "total binary").collect()
    return np.sum([np.frombuffer(p[0]) for p in parts], axis=0)


def labelled(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """``stats, label, calibrates`` of at most ``max_rows`` documents."""
    spark = docs.sparkSession
    known = labels.select(F.col("doc_id").cast("long").alias("key"), F.col("quality").cast("int").alias("label")).where(
        "key is not null and label is not null").distinct()
    known = known.select("*", F.xxhash64("key").alias("h")).orderBy("h", "key", "label").limit(max_rows)
    # at most max_rows ids: the bound of this broadcast
    some = F.broadcast(staged(known, "labels"))
    stats = docs.join(some, docs["doc_id"] == some["key"]).select(
        statistics_of(docs["text"]).alias("stats"), some["label"], (F.pmod(some["h"], F.lit(CALIBRATE)) == 0).alias("calibrates"))
    return staged(stats.repartition(PARTS), "quality")


def statistics_of(text: Column) -> Column:
    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([statistics(t) for t in s])

    return run.asNondeterministic()(text)


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    """Learn from the rows of ``docs`` that ``labels`` (doc_id, quality) has."""
    prepare(docs.sparkSession)
    rows = labelled(docs, labels, max_rows)
    d = len(NAMES)
    moments = _sums(rows, lambda x, y: np.concatenate([[len(y), y.sum()], x.sum(0), (x * x).sum(0)]), 2 + 2 * d)
    n, good = moments[:2]
    mean = moments[2:2 + d] / max(n, 1)
    var = moments[2 + d:] / max(n, 1) - mean**2
    model = Model(mean, np.sqrt(np.where(var > 1e-12, var, 1.0)), np.zeros(FEATURES + d + 1), np.zeros(1),
                  np.array([good / n if n else 0.5]))
    if not 0 < good < n:
        return model
    k = len(model.weights)

    def normal(x, y):
        z = model.features(x)
        return np.concatenate([(z.T @ z).ravel(), z.T @ y])

    fitted = rows.where("not calibrates") if rows.where("not calibrates").limit(1).count() else rows
    eq = _sums(fitted, normal, k * k + k)
    lam = RIDGE * np.eye(k)
    lam[-1, -1] = 1e-9
    model.weights = np.linalg.solve(eq[:k * k].reshape(k, k) + lam, eq[k * k:])

    def binned(x, y):
        at = np.clip(((model.raw(x) - LOW) / (HIGH - LOW) * BINS).astype(int), 0, BINS - 1)
        return np.concatenate([np.bincount(at, minlength=BINS), np.bincount(at, y, BINS)])

    held = rows.where("calibrates") if rows.where("calibrates").limit(1).count() else rows
    hist = _sums(held, binned, 2 * BINS)
    full = np.flatnonzero(hist[:BINS])
    # a half count of either class keeps the levels inside (0, 1)
    level = isotonic(hist[full] + 1e-3, hist[BINS + full] + 5e-4)
    centre = LOW + (full + 0.5) * (HIGH - LOW) / BINS
    model.knots = np.concatenate([[LOW - 1], centre, [HIGH + 1]])
    # a slope of 1e-3 inside level stretches keeps the order of raw scores
    model.levels = np.concatenate([level[:1], level, level[-1:]]) * (1 - 1e-3) + 1e-3 * (
        (model.knots - LOW + 1) / (HIGH - LOW + 2))
    return model


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``quality_score``, from 0 to 1."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(shared.value.score(np.array([statistics(t) for t in s]).reshape(len(s), len(NAMES))))

    return docs.withColumn("quality_score", run.asNondeterministic()(F.col("text")))


def training_labels(labels: DataFrame) -> DataFrame:
    """Labels that may be learned from: crc32(doc_id as text) mod 5 is not 0."""
    return labels.where(crc_remainder(F.col("doc_id"), 5) != 0)
