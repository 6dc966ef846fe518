"""The global index under the default adaptive settings, with wide rows."""

from pyspark.sql import functions as F

from storylens.functions.indexing import sequential_index
from storylens.functions.stats import average_ranks, grouped_quantiles
from storylens.operators.matched import split_halves


def test_index_is_dense_on_wide_rows(spark):
    pad = F.concat(*[F.md5(F.concat_ws(":", "id", F.lit(i)).cast("binary")) for i in range(8)])
    df = spark.range(0, 400_000, 1, 16).select(F.md5(F.col("id").cast("string").cast("binary")).alias("k"), pad.alias("pad"))
    got = sequential_index(df, ["k"], "i")
    n, distinct, top, bad = got.agg(
        F.count("*"), F.countDistinct("i"), F.max("i"), F.count_if(F.length("pad") != 256)).first()
    assert (n, distinct, top, bad) == (400_000, 400_000, 399_999, 0)
    ends = {r["i"]: r["k"] for r in got.where("i in (0, 399999)").select("i", "k").collect()}
    assert ends == {0: df.agg(F.min("k")).first()[0], 399_999: df.agg(F.max("k")).first()[0]}


def test_index_descending_and_null_keys(spark):
    df = spark.createDataFrame([(1, "a"), (None, "b"), (3, "c")], "k long, v string")
    got = sequential_index(df, ["k", "v"], "i", descending=("k",))
    assert [r["v"] for r in got.orderBy("i").collect()] == ["c", "a", "b"]


def test_average_ranks_with_a_large_tie(spark):
    df = spark.range(0, 3000).select(F.lit("g").alias("g"), F.col("id"), F.when(F.col("id") < 1000, 0.0).otherwise(
        F.col("id").cast("double")).alias("x"))
    got = {r["id"]: r["rank"] for r in average_ranks(df, ["g"], "x", ["id"]).collect()}
    assert got[0] == got[999] == 500.5 and got[1000] == 1001.0 and got[2999] == 3000.0


def test_split_is_even_everywhere(spark):
    n = 40_000
    z = spark.range(0, n).select(
        F.lit("human").alias("writer"), F.lit("valence").alias("dim"), (F.col("id") / 10).cast("long").alias("p_ind"),
        F.concat_ws("-", "id").alias("s_id"), F.lit("comet").alias("am"), F.lit("axis").alias("sm"),
        F.lit("sim").alias("_"), F.rand(1).alias("z_score"))
    z = z.unionByName(z.withColumn("sm", F.lit("sim")))
    h = split_halves(z, n_trials=2, min_stories=10).groupBy("trial", "p_ind", "half").count()
    assert h.count() == 2 * n // 10 * 2 and h.where("count <> 5").count() == 0


def test_grouped_quantiles(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    data = {"a": rng.integers(0, 9, 500).astype(float), "b": rng.normal(size=7), "c": np.array([3.0])}
    rows = [(g, float(x)) for g, xs in data.items() for x in xs] + [("a", None)]
    got = grouped_quantiles(spark.createDataFrame(rows, "g string, x double"), ["g"], "x", {"lo": 0.25, "mid": 0.5, "hi": 0.9})
    for r in got.collect():
        assert np.allclose([r["lo"], r["mid"], r["hi"]], np.percentile(data[r["g"]], [25, 50, 90]))
