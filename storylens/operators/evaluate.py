"""Evaluation of score methods on held-out lexicon words.

Trials are a key column, so all trials and dimensions run in one plan (the
pairing rounds of ``axis_with_con`` are keyed by dimension and trial too).
Per-(dim, trial) groups are lexicon-sized: they do not grow with the corpus.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storylens.constants import EVAL_METHODS, EVAL_SEED, EVAL_TRIALS, TEST_RATIO
from storylens.functions.stats import spearman, spearman_t, t_p_value
from storylens.functions.vectors import as_double, cosine, dot, unit, vector_mean
from storylens.operators.pairing import contrast_pairs


def check_eval_method(method: str) -> str:
    if method not in EVAL_METHODS:
        raise ValueError(f"invalid method {method!r}; expected one of {EVAL_METHODS}")
    return method


def train_test_split(lex: DataFrame, trials: int = EVAL_TRIALS, seed: int = EVAL_SEED,
                     test_ratio: float = TEST_RATIO, fixed_seed: bool = False) -> DataFrame:
    """Per (dim, trial) shuffle the words by a seeded hash and put the
    first ceil(ratio * n) in the test part. The seed varies by trial unless
    `fixed_seed` (then every trial is the same split)."""
    t = lex.select("dim", "word", "score", "ord", F.explode(F.sequence(F.lit(1), F.lit(trials))).alias("trial"))
    s = F.lit(seed) if fixed_seed else F.lit(seed) + F.col("trial")
    key = F.md5(F.concat_ws(":", F.col("word"), s.cast("string")))
    w = Window.partitionBy("dim", "trial").orderBy(key, F.col("word"))
    n = F.count(F.lit(1)).over(Window.partitionBy("dim", "trial"))
    t = t.withColumn("_rn", F.row_number().over(w)).withColumn("_n", n)
    # test size = ceil(ratio * n), in exact integer arithmetic
    frac = Fraction(test_ratio).limit_denominator(1000)
    n_test = F.expr(f"(_n * {frac.numerator} + {frac.denominator - 1}) div {frac.denominator}")
    return t.select(
        "dim", F.col("trial").cast("bigint").alias("trial"), "word", "score", "ord",
        F.when(F.col("_rn") <= n_test, F.lit("test")).otherwise(F.lit("train")).alias("part"),
    )


def in_vocabulary(split: DataFrame, vectors: DataFrame) -> DataFrame:
    """Keep words present in the vector table (as written), after the split."""
    return split.join(vectors.select("word"), "word", "left_semi")


def _fetch(df: DataFrame, vectors: DataFrame) -> DataFrame:
    v = vectors.select(F.col("word").alias("_lw"), as_double("vec").alias("vec"))
    return df.join(v, F.lower(F.col("word")) == F.col("_lw")).drop("_lw")


def _test_spearman(pred: DataFrame, method: str) -> DataFrame:
    # held-out words of one lexicon: a bounded group per (dim, trial)
    r = spearman(pred, ["dim", "trial"], "score", "pred", ["word"], bounded_groups=True)
    return r.select("dim", "trial", F.lit(method).alias("method"), "n", "sp_corr")


def eval_sim(split: DataFrame, vectors: DataFrame) -> DataFrame:
    """seeds = train words at or above the train p75; each test word is
    scored alone (cosine to the seed centroid); Spearman to the true scores."""
    train = split.filter(F.col("part") == "train")
    ub = train.groupBy("dim", "trial").agg(F.percentile("score", F.lit(0.75)).alias("ub"))
    seeds = _fetch(train.join(ub, ["dim", "trial"]).filter(F.col("score") >= F.col("ub")), vectors)
    cen = vector_mean(seeds.select("dim", "trial", unit("vec").alias("vec")), ["dim", "trial"], "vec", "centroid")
    test = _fetch(split.filter(F.col("part") == "test"), vectors)
    pred = test.join(cen, ["dim", "trial"]).select("dim", "trial", "word", "score",
                                                   dot(unit("vec"), "centroid").alias("pred"))
    return _test_spearman(pred, "sim")


def eval_axis(split: DataFrame, vectors: DataFrame, use_contrast: bool) -> DataFrame:
    """Axis from the train part's percentile poles (with or without
    contrast pairs); each test word scored by cosine to the axis."""
    train = split.filter(F.col("part") == "train")
    b = train.groupBy("dim", "trial").agg(
        F.percentile("score", F.lit(0.25)).alias("lb"), F.percentile("score", F.lit(0.75)).alias("ub"))
    tb = train.join(b, ["dim", "trial"])
    key = F.concat_ws("#", F.col("dim"), F.col("trial").cast("string"))

    def pole(cond):
        p = _fetch(tb.filter(cond), vectors)
        return p.select(key.alias("dim"), "word", "ord", "vec").toDF("dim", "word", "ord", "vec")

    low, high = pole(F.col("score") <= F.col("lb")), pole(F.col("score") >= F.col("ub"))
    if use_contrast:
        pairs = contrast_pairs(low, high)
        low = pairs.select("dim", F.col("low_word").alias("word")).join(low, ["dim", "word"])
        high = pairs.select("dim", F.col("high_word").alias("word")).join(high, ["dim", "word"])
    lm = vector_mean(low.select("dim", "vec"), ["dim"], "vec", "lm")
    hm = vector_mean(high.select("dim", "vec"), ["dim"], "vec", "hm")
    ax = lm.join(hm, "dim").select("dim", F.zip_with("hm", "lm", lambda h, l: h - l).alias("axis"))
    test = _fetch(split.filter(F.col("part") == "test"), vectors).withColumn("_k", key)
    pred = test.join(ax.withColumnRenamed("dim", "_k"), "_k").select(
        "dim", "trial", "word", "score", cosine("vec", "axis").alias("pred"))
    return _test_spearman(pred, "axis_with_con" if use_contrast else "axis_no_con")


def with_spearman_p(res: DataFrame) -> DataFrame:
    """Two-sided p from t = r sqrt((n-2)/(1-r^2)) with n-2 d.f.; |r| = 1 -> 0."""
    t = spearman_t(F.col("sp_corr"), F.col("n"))
    return res.withColumn(
        "sp_p",
        F.when(F.abs(F.col("sp_corr")) >= 1.0, F.lit(0.0)).otherwise(t_p_value(t, (F.col("n") - 2).cast("double"))),
    )


def evaluate_methods(lex: DataFrame, vectors: DataFrame, methods=EVAL_METHODS, trials: int = EVAL_TRIALS,
                     seed: int = EVAL_SEED, fixed_seed: bool = False) -> DataFrame:
    """Every method x trial x dimension: ``(dim, method, trial, n, sp_corr, sp_p)``."""
    for m in methods:
        check_eval_method(m)
    # lexicon-sized: written once, read by every method
    split = in_vocabulary(train_test_split(lex, trials, seed, fixed_seed=fixed_seed), vectors).checkpoint()
    out = []
    if "sim" in methods:
        out.append(eval_sim(split, vectors))
    if "axis_with_con" in methods:
        out.append(eval_axis(split, vectors, True))
    if "axis_no_con" in methods:
        out.append(eval_axis(split, vectors, False))
    res = out[0]
    for o in out[1:]:
        res = res.unionByName(o)
    return with_spearman_p(res)
