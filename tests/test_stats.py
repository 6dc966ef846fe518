"""Statistics: ranks with ties, constant series, t-distribution p-values,
seeded sampling and split-half properties."""

import math

import pytest
from pyspark.sql import functions as F

from storylens.functions.stats import average_ranks, spearman, t_p_value
from storylens.operators import matched as M


def test_average_ranks_ties(spark):
    df = spark.createDataFrame([("g", i, v) for i, v in enumerate([3.0, 1.0, 3.0, 2.0, 3.0])],
                               "g string, k int, v double")
    got = {r["k"]: r["rank"] for r in average_ranks(df, ["g"], "v", ["k"]).collect()}
    assert got == {0: 4.0, 1: 1.0, 2: 4.0, 3: 2.0, 4: 4.0}


def test_spearman_constant_and_perfect(spark):
    df = spark.createDataFrame([("a", i, float(i), float(i * i)) for i in range(6)] +
                               [("b", i, 1.0, float(i)) for i in range(6)], "g string, k int, x double, y double")
    got = {r["g"]: r["sp_corr"] for r in spearman(df, ["g"], "x", "y", ["k"]).collect()}
    assert got["a"] == pytest.approx(1.0) and got["b"] is None


def _p(spark, cases):
    df = spark.createDataFrame([(i, t, d) for i, (t, d) in enumerate(cases)], "i int, t double, dof double")
    return [r["p"] for r in df.withColumn("p", t_p_value(F.col("t"), F.col("dof"))).orderBy("i").collect()]


def test_t_p_values_known_points(spark):
    # published two-sided critical values: t(0.05, 10) = 2.228, t(0.01, 20) = 2.845, t(0.05, 1) = 12.706
    got = _p(spark, [(2.228, 10.0), (2.845, 20.0), (12.706, 1.0), (0.0, 5.0), (float("inf"), 3.0)])
    assert got == pytest.approx([0.05, 0.01, 0.05, 1.0, 0.0], abs=2e-4)
    assert _p(spark, [(float("nan"), 5.0), (None, 5.0), (1.0, 0.0), (1.0, None), (1.0, -2.0)]) == [None] * 5


def test_t_p_values_against_integration(spark):
    """Twice the tail of the density by Simpson's rule, in the angle t = sqrt(dof) tan(u)."""
    cases = [(t, d) for t in (1e-6, 0.1, 0.8, 1.0, 2.5, 6.0, 30.0) for d in (1.0, 2.0, 3.5, 30.0, 199.0, 201.0, 5000.0, 2e6)]

    def tail(t, d):
        n, low = 4000, math.atan(t / math.sqrt(d))
        # beyond this the integrand is under 1e-40 of its largest value
        high = min(math.pi / 2, low + 14 / math.sqrt(d))
        h = (high - low) / n
        f = [max(math.cos(low + i * h), 0.0) ** (d - 1) for i in range(n + 1)]
        total = h / 3 * (f[0] + f[-1] + 4 * sum(f[1::2]) + 2 * sum(f[2:-1:2]))
        ratio = math.lgamma((d + 1) / 2) - math.lgamma(d / 2)
        return 2 * math.exp(ratio) / math.sqrt(math.pi) * total

    for (t, d), p in zip(cases, _p(spark, cases), strict=True):
        want = tail(t, d)
        assert p == pytest.approx(want, rel=1e-6, abs=1e-280), (t, d)


def test_t_p_value_runs_without_python(spark):
    plan = spark.range(1).select(t_p_value(F.lit(1.0), F.col("id") + 3.0))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan


def _z(spark, rows):
    return spark.createDataFrame(rows, "writer string, dim string, s_pov string, p_ind long, s_id string, z_score double")


def test_sampling_group_of_two_is_deterministic(spark):
    rows = [("human", "d", "FP", 1, "1-0", 0.2), ("human", "d", "FP", 1, "1-1", 1.0),
            ("human", "d", "FP", 2, "2-0", 5.0)]  # group of one is skipped
    for seed in (1, 2):
        out = M.sample_group_stats(_z(spark, rows), ["writer", "dim", "s_pov", "p_ind"], seed=seed).collect()
        assert len(out) == 1
        assert out[0]["mean"] == pytest.approx(0.6) and out[0]["std"] == pytest.approx(0.4)


def test_sampling_draws_two_distinct(spark):
    rows = [("human", "d", "FP", 1, f"1-{i}", float(i)) for i in range(5)]
    z = _z(spark, rows)
    d = z.select("s_id", "z_score", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("trial"))
    from pyspark.sql import Window

    w = Window.partitionBy("trial").orderBy(M._draw_key(7), F.col("s_id"))
    drawn = d.withColumn("rn", F.row_number().over(w)).filter("rn <= 2").groupBy("trial").agg(
        F.count_distinct("s_id").alias("n")).collect()
    assert all(r["n"] == 2 for r in drawn)


def test_split_halves_cover_and_disjoint(spark):
    rows = []
    for p, n in ((1, 3), (2, 4), (3, 5)):
        rows += [("human", "valence", "FP", p, f"{p}-{i}", float(i), "comet", "axis") for i in range(n)]
    z = spark.createDataFrame(rows, "writer string, dim string, s_pov string, p_ind long, s_id string, "
                                    "z_score double, am string, sm string")
    h = M.split_halves(z).collect()
    assert {r["p_ind"] for r in h} == {2, 3}  # prompts with >= 4 stories only
    for t in range(1, 6):
        for p, n in ((2, 4), (3, 5)):
            halves = [r["half"] for r in h if r["trial"] == t and r["p_ind"] == p]
            assert len(halves) == n and halves.count(1) == n // 2  # odd: the extra story goes to half 2


def test_zscores_mean_zero_std_one(spark):
    from storylens.operators.analysis import zscores

    rows = [("human", f"{i}", "d", "all", "avg", float(i)) for i in range(7)] + [("gpt-3.5", "9", "d", "all", "avg", None)]
    s = spark.createDataFrame(rows, "writer string, s_id string, dim string, am string, sm string, score double")
    z = [r["z_score"] for r in zscores(s).collect() if r["z_score"] is not None]
    assert sum(z) / len(z) == pytest.approx(0.0, abs=1e-12)
    assert (sum(v * v for v in z) / len(z)) == pytest.approx(1.0)


@pytest.mark.parametrize("block", [1 << 15, 8])
def test_resamples_draw_n_of_n(spark, block):
    """Draws of every replicate add up to the group's rows, in one block and over
    a tree of many; and every drawn value is one of the group's."""
    sizes = {"one": 1, "five": 5, "many": 101, None: 7}
    rows = [(g, f"{g}-{i}", float(2 ** (i % 40))) for g, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(rows, "g string, k string, v double")
    got = M.replicate_sums(df, ["g"], "v", "k", resamples=50, block=block).groupBy("g", "_r").agg(
        F.sum("_m").alias("m"), F.sum("_s").alias("s"), F.count(F.lit(1)).alias("blocks")).collect()
    assert len(got) == 50 * len(sizes) and all(r["m"] == sizes[r["g"]] for r in got)
    assert {r["s"] for r in got if r["g"] == "one"} == {1.0}
    assert all(bin(int(r["s"])).count("1") <= 5 for r in got if r["g"] == "five") and len({r["s"] for r in got if r["g"] == "five"}) > 10
    assert max(r["blocks"] for r in got if r["g"] == "many") == (1 if block > 100 else 13)


def test_resamples_do_not_depend_on_partitioning(spark):
    df = spark.range(300).select(F.lit("g").alias("g"), F.col("id").cast("string").alias("k"), F.rand(3).alias("v")).checkpoint()
    a, b = ({(r["_r"], r["_m"], round(r["_s"], 9)) for r in M.replicate_sums(x, ["g"], "v", "k", 20, block=40).collect()}
            for x in (df.repartition(1), df.repartition(7)))
    assert a == b


def test_bootstrap_spread_is_that_of_the_mean(spark):
    """Standard deviation of replicate means: that of the mean of n draws; one row has no spread."""
    import numpy as np

    values = [float(x) for x in np.random.default_rng(2).normal(size=200)]
    df = spark.createDataFrame([("g", str(i), v) for i, v in enumerate(values)] + [("h", "0", 4.0)], "g string, k string, v double")
    for block in (1 << 15, 16):
        rep = M.replicate_sums(df, ["g"], "v", "k", 1000, block=block).groupBy("g", "_r").agg(
            (F.sum("_s") / F.sum("_m")).alias("m")).groupBy("g").agg(F.avg("m").alias("a"), F.stddev("m").alias("s")).collect()
        g = {r["g"]: r for r in rep}
        want = np.std(values) / math.sqrt(200)
        assert abs(g["g"]["a"] - np.mean(values)) < 4 * want / math.sqrt(1000) and abs(g["g"]["s"] / want - 1) < 0.1
        assert g["h"]["s"] == 0
    ci = {r["g"]: r for r in M.bootstrap_mean(df, ["g"], "v", "k").collect()}
    assert ci["h"]["ci_lo"] == ci["h"]["ci_hi"] == 4.0 and ci["g"]["ci_lo"] < np.mean(values) < ci["g"]["ci_hi"]


def test_histograms_read_their_rows_once_a_pass(spark):
    """Both kinds of values were taken in scans of their own, and rounded for the range too."""
    import random

    from storylens.operators.analysis import histograms

    rng = random.Random(2)
    rows = [("human", "d", "all", "avg", z, s) for z, s in
            [(0.0, 0.1), (1.0, 0.1), (0.3 + 1e-12, None), (None, 0.1), (0.3, 0.1 + 1e-13)]]
    rows += [("gpt-3.5", "d", "all", "avg", rng.gauss(0, 1), rng.random()) for _ in range(300)]
    z = spark.createDataFrame(rows, "writer string, dim string, am string, sm string, z_score double, score double")
    out = histograms(z)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan
    got = {(r["writer"], r["kind"], r["bin"]): r["cnt"] for r in out.collect()}
    want = {}
    for i, kind in ((4, "z"), (5, "raw")):
        for writer in ("human", "gpt-3.5"):
            x = [round(r[i], 9) for r in rows if r[0] == writer and r[i] is not None]
            lo, hi = (min(x), max(x)) if min(x) < max(x) else (min(x) - 0.5, max(x) + 0.5)
            for v in x:
                key = writer, kind, min(int((v - lo) * 10 / (hi - lo)) + 1, 10)
                want[key] = want.get(key, 0) + 1
    assert got == want


def test_rank_correlations_store_what_they_reread(spark):
    """Each of a correlation's passes made the joins and the pivot of its source again."""
    import numpy as np
    import pandas as pd

    from storylens.operators import analysis as N

    rng = np.random.default_rng(3)
    rows = [("human" if i % 5 else "gpt-3.5", f"s{i}", d, am, sm, None if rng.random() < 0.1 else float(rng.integers(0, 8)))
            for i in range(60) for d in ("appearance", "intellect") for am in ("all", "sub", "comet") for sm in ("avg", "sim")]
    cols = ["writer", "s_id", "dim", "am", "sm", "score"]
    z = spark.createDataFrame(rows, "writer string, s_id string, dim string, am string, sm string, score double")
    wide = pd.DataFrame(rows, columns=cols)
    wide = wide[wide.writer == "human"].pivot(index=["dim", "sm", "s_id"], columns="am", values="score")
    got = N.attr_method_agreement(z)
    assert "pivotfirst" not in got._jdf.queryExecution().optimizedPlan().toString().lower()
    found = {(r["dim"], r["sm"], r["pair"]): (r["n"], r["sp_corr"]) for r in got.collect()}
    assert len(found) == 12
    for (dim, sm, pair), (n, corr) in found.items():
        x, y = pair.split("-")
        own = wide.loc[(dim, sm)][[x, y]].dropna()
        assert n == len(own) and corr == pytest.approx(own[x].rank().corr(own[y].rank()))
    a = spark.createDataFrame([("g", i, float(i % 7)) for i in range(40)], "g string, k int, x double")
    b = spark.createDataFrame([("g", i, float(i % 5)) for i in range(40)], "g string, k int, y double")
    r = spearman(a.filter("k > -1717").join(b, ["g", "k"]), ["g"], "x", "y", ["k"])
    assert "-1717" not in r._jdf.queryExecution().optimizedPlan().toString()  # the source is not made again
    assert r.collect()[0]["n"] == 40
