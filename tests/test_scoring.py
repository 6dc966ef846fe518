"""Golden rows for lexicon and vector scoring, pairing properties."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from storylens.functions.vectors import unit
from storylens.operators import lexicon as L
from storylens.operators import score as S
from storylens.operators.pairing import contrast_pairs, nearest_partners


def _lex(spark, rows):
    return spark.createDataFrame(rows, "dim string, word string, score double, ord long")


def _scores(df):
    return {(r["s_key"], r["dim"], r["sm"]): r["score"] for r in df.collect()}


def test_lexicon_average_graded_and_unipolar(spark):
    lex = _lex(spark, [("g", "good", 1.0, 0), ("g", "bad", 0.0, 1), ("g", "ok", 0.5, 2),
                       ("u", "pretty", 1.0, 0), ("u", "ugly", 1.0, 1)])
    stories = spark.createDataFrame([(1,), (2,), (3,)], "s_key long")
    attrs = spark.createDataFrame(
        [(1, "all", "Good"), (1, "all", "bad"), (1, "all", "zzz"), (1, "all", "pretty"),
         (2, "all", "nothing")], "s_key long, am string, attr string")
    out = _scores(S.score_stories(stories, attrs, lex, None, dims=["g", "u"], ams=["all"], sms=["avg"]))
    assert out[(1, "g", "avg")] == pytest.approx(0.5)       # mean of found (upper-case attribute lower-cased)
    assert out[(1, "u", "avg")] == pytest.approx(1 / 4)     # density: missing words count as 0
    assert out[(2, "g", "avg")] == 0.0 and out[(2, "u", "avg")] == 0.0
    assert out[(3, "g", "avg")] == 0.0 and out[(3, "u", "avg")] == 0.0  # empty attribute list


def test_lexicon_last_duplicate_wins(spark):
    lex = _lex(spark, [("d", "w", 0.1, 0), ("d", "x", 0.2, 1), ("d", "w", 0.9, 2)])
    got = {r["word"]: (r["score"], r["ord"]) for r in L.dedupe_last_wins(lex).collect()}
    assert got == {"w": (0.9, 0), "x": (0.2, 1)}


def test_percentiles_linear(spark):
    lex = _lex(spark, [("d", f"w{i}", float(v), i) for i, v in enumerate([1, 2, 3, 4, 10])])
    b = L.percentile_bounds(lex).first()
    assert b["lb"] == pytest.approx(np.percentile([1, 2, 3, 4, 10], 25))
    assert b["ub"] == pytest.approx(np.percentile([1, 2, 3, 4, 10], 75))


def test_vectors_zero_and_missing(spark):
    lex = _lex(spark, [("d", "hi", 1.0, 0), ("d", "lo", 0.0, 1), ("d", "mid", 0.5, 2)])
    vec = spark.createDataFrame([("hi", [1.0, 0.0]), ("lo", [-1.0, 0.0]), ("mid", [0.0, 1.0]), ("zero", [0.0, 0.0])],
                                "word string, vec array<float>")
    stories = spark.createDataFrame([(1,), (2,), (3,)], "s_key long")
    attrs = spark.createDataFrame([(1, "all", "HI"), (1, "all", "zero"), (2, "all", "unknown"), (3, "all", "mid")],
                                  "s_key long, am string, attr string")
    out = _scores(S.score_stories(stories, attrs, lex, vec, dims=["d"], ams=["all"], sms=["axis", "sim"],
                                  use_contrast=False))
    # axis = hi - lo = (2, 0): cos(hi)=1, cos(zero)=0 -> mean 0.5
    assert out[(1, "d", "axis")] == pytest.approx(0.5)
    assert out[(2, "d", "axis")] is None and out[(2, "d", "sim")] is None  # no scorable attribute
    # seeds: score >= p75 (0.75) -> hi only; centroid (1, 0)
    assert out[(1, "d", "sim")] == pytest.approx(0.5)
    assert out[(3, "d", "sim")] == pytest.approx(0.0)


def test_centroid_equals_double_mean(spark):
    rng = np.random.default_rng(3)
    seeds = rng.normal(size=(7, 5))
    term = rng.normal(size=5)
    lex = _lex(spark, [("d", f"s{i}", 1.0, i) for i in range(7)] + [("d", "t", 0.0, 7)])
    vec = spark.createDataFrame([(f"s{i}", seeds[i].tolist()) for i in range(7)] + [("t", term.tolist())],
                                "word string, vec array<double>")
    ce = S.centroids(lex, vec).first()["centroid"]
    unit = seeds / np.linalg.norm(seeds, axis=1, keepdims=True)
    double_mean = np.mean(unit @ (term / np.linalg.norm(term)))
    assert np.dot(term / np.linalg.norm(term), ce) == pytest.approx(double_mean)


@pytest.mark.parametrize("seed,n_low,n_high", [(1, 5, 8), (2, 9, 4), (3, 6, 6), (4, 1, 3)])
def test_pairing_equals_sequential(spark, seed, n_low, n_high):
    rng = np.random.default_rng(seed)
    lo = rng.normal(size=(n_low, 4)).round(1)
    hi = rng.normal(size=(n_high, 4)).round(1)
    lo_rows = [("d", f"l{i}", i, lo[i].tolist()) for i in range(n_low)]
    hi_rows = [("d", f"h{j}", j, hi[j].tolist()) for j in range(n_high)]
    schema = "dim string, word string, ord long, vec array<double>"
    low, high = spark.createDataFrame(lo_rows, schema), spark.createDataFrame(hi_rows, schema)
    lu = lo / np.linalg.norm(lo, axis=1, keepdims=True)
    hu = hi / np.linalg.norm(hi, axis=1, keepdims=True)
    # definition: blank out what is taken and look for the last maximum of a row
    sim = lu @ hu.T if n_low <= n_high else hu @ lu.T
    want = set()
    for i in range(len(sim)):
        j = len(sim[i]) - 1 - int(np.argmax(sim[i][::-1]))
        want.add((f"l{i}", f"h{j}") if n_low <= n_high else (f"l{j}", f"h{i}"))
        sim[:, j] = -np.inf
    # one block, and several that contend for partners; long lists, and lists that are used up
    for block, size, segment in ((512, 32, 32), (2, 1, 1)):
        got = {(r["low_word"], r["high_word"]) for r in contrast_pairs(low, high, block, size, segment).collect()}
        assert got == want


def test_pairing_of_equal_vectors(spark):
    """All lists are alike, so each partner is asked for by every chooser."""
    schema = "dim string, word string, ord long, vec array<double>"
    low = spark.createDataFrame([("d", f"l{i}", i, [0.0, 0.0] if i % 3 == 0 else [1.0, 1.0]) for i in range(9)], schema)
    high = spark.createDataFrame([("d", f"h{i}", i, [1.0, 1.0]) for i in range(9)], schema)
    got = {(r["low_word"], r["high_word"]) for r in contrast_pairs(low, high, block=4, size=2).collect()}
    assert got == {(f"l{i}", f"h{8 - i}") for i in range(9)}


def test_vector_scores_use_every_partition(spark):
    """Words in one partition are scored by many tasks."""
    vec = spark.createDataFrame([(f"w{i}", [float(i), 1.0]) for i in range(200)], "word string, vec array<double>").coalesce(1)
    centre = spark.createDataFrame([("d", [0.6, 0.8])], "dim string, centroid array<double>")
    out = S.vector_word_scores(vec, None, centre, ["d"])
    assert out.select(F.spark_partition_id().alias("p")).distinct().count() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    got = {r["w"]: r["wscore"] for r in out.collect()}
    assert len(got) == 200 and got["w2"] == pytest.approx(2.0 / 5 ** 0.5)


def _jobs(spark, name, run):
    spark.sparkContext.setJobGroup(name, name)
    try:
        out = run()
        return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_pairing_of_near_copies_takes_no_more_rounds(spark):
    """Choosers that all want the same partners cost as many jobs as others."""
    schema = "dim string, word string, ord long, vec array<double>"
    rng = np.random.default_rng(5)
    spread = rng.normal(size=(2, 60, 16))
    near = np.ones(16) + 0.01 * rng.normal(size=(2, 60, 16))
    jobs = {}
    for name, (lo, hi) in (("spread", spread), ("near", near)):
        low = spark.createDataFrame([("d", f"l{i}", i, v.tolist()) for i, v in enumerate(lo)], schema)
        high = spark.createDataFrame([("d", f"h{i}", i, v.tolist()) for i, v in enumerate(hi)], schema)
        got, jobs[name] = _jobs(spark, name, lambda: contrast_pairs(low, high, block=6, size=2, segment=5).collect())
        sim = (lo / np.linalg.norm(lo, axis=1, keepdims=True)) @ (hi / np.linalg.norm(hi, axis=1, keepdims=True)).T
        want = set()
        for i in range(60):
            want.add((f"l{i}", f"h{sim[i].argmax()}"))
            sim[:, sim[i].argmax()] = -np.inf
        assert {(r["low_word"], r["high_word"]) for r in got} == want
    assert jobs["near"] <= jobs["spread"] + 3


def test_nearest_partners_in_tiles(spark):
    """Tiles of a pole give what the whole pole gives; among ties the larger position."""
    rng = np.random.default_rng(6)
    lo, hi = rng.normal(size=(23, 5)), rng.normal(size=(31, 5))
    hi[30] = hi[2]
    low = spark.createDataFrame([("d", i, v.tolist()) for i, v in enumerate(lo)], "dim string, cidx long, vec array<double>")
    high = spark.createDataFrame([("d", i, v.tolist()) for i, v in enumerate(hi)], "dim string, pidx long, vec array<double>")
    sim = (lo / np.linalg.norm(lo, axis=1, keepdims=True)) @ (hi / np.linalg.norm(hi, axis=1, keepdims=True)).T
    want = {i: 30 - int(sim[i, ::-1].argmax()) for i in range(23)}
    got = nearest_partners(low, high, tile=4).collect()
    assert {r["cidx"]: r["pidx"] for r in got} == want and len(got) == 23
    assert all(r["sim"] == pytest.approx(sim[r["cidx"], r["pidx"]]) for r in got)
    # a row that comes twice is in the result twice
    twice = nearest_partners(low.union(low.filter("cidx < 3")), high, tile=4).collect()
    assert sorted((r["cidx"], r["pidx"]) for r in twice) == sorted([*want.items(), *[(i, want[i]) for i in range(3)]])


@pytest.mark.parametrize("bad", [[float("nan"), 1.0], None])
def test_pairing_leaves_out_vectors_that_are_not_finite(spark, bad):
    """In either pole, and in both: the rest is paired as without them."""
    schema = "dim string, word string, ord long, vec array<double>"
    good_low = [("d", "a", 0, [1.0, 0.0]), ("d", "b", 2, [0.0, 1.0])]
    good_high = [("d", "x", 0, [1.0, 0.1]), ("d", "y", 2, [0.2, 1.0]), ("d", "z", 3, [-1.0, 0.0])]
    for low, high in ((good_low + [("d", "bad", 1, bad)], good_high),
                      (good_low, good_high + [("d", "bad", 1, bad), ("e", "only", 0, [float("inf"), 0.0])])):
        got = {(r["low_word"], r["high_word"]) for r in contrast_pairs(
            spark.createDataFrame(low, schema), spark.createDataFrame(high, schema)).collect()}
        assert got == {("a", "x"), ("b", "y")}
    # with two good partners and three choosers the good ones choose: the poles are counted without the bad
    got = {(r["low_word"], r["high_word"]) for r in contrast_pairs(
        spark.createDataFrame(good_low + [("d", "bad", 1, bad)], schema), spark.createDataFrame(good_high[:2], schema)).collect()}
    assert got == {("a", "x"), ("b", "y")}
    assert contrast_pairs(spark.createDataFrame([("d", "bad", 1, bad)], schema),
                          spark.createDataFrame(good_high, schema)).count() == 0
    near = nearest_partners(spark.createDataFrame(good_low, schema).selectExpr("dim", "ord cidx", "vec"),
                            spark.createDataFrame(good_high + [("d", "bad", 1, bad)], schema).selectExpr("dim", "ord pidx", "vec"))
    assert {(r["cidx"], r["pidx"]) for r in near.collect()} == {(0, 0), (2, 2)}


def test_pairing_ties(spark):
    # identical partners: the later partner wins a tie
    schema = "dim string, word string, ord long, vec array<double>"
    low = spark.createDataFrame([("d", "a", 0, [1.0, 0.0])], schema)
    high = spark.createDataFrame([("d", "x", 0, [1.0, 0.0]), ("d", "y", 1, [1.0, 0.0])], schema)
    got = [(r["low_word"], r["high_word"]) for r in contrast_pairs(low, high).collect()]
    assert got == [("a", "y")]


def test_unknown_methods_raise():
    with pytest.raises(ValueError):
        S.check_score_method("median")
    from storylens.operators.attrs import check_attr_method

    assert check_attr_method(None) == "all" and check_attr_method("full") == "all"
    with pytest.raises(ValueError):
        check_attr_method("verbs")
    assert math.isfinite(1.0)


def _story_case(spark, n=40):
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(30)]
    lex = _lex(spark, [(d, w, float(v), i) for d in ("g", "h") for i, (w, v) in enumerate(zip(words, rng.integers(0, 5, 30)))])
    vec = spark.createDataFrame([(w, rng.normal(size=4).tolist()) for w in words[5:]], "word string, vec array<double>")
    stories = spark.createDataFrame([(i,) for i in range(n)], "s_key long")
    attrs = spark.createDataFrame([(i, "all", w) for i in range(1, n) for w in [*rng.choice(words, 12), "W3", "none", None]],
                                  "s_key long, am string, attr string")
    return stories, attrs, lex, vec


def test_small_word_tables_are_not_shuffled_to(spark):
    """Attributes are not shuffled by word, nor counted per word; a table over the limit gives the same scores."""
    stories, attrs, lex, vec = _story_case(spark)
    ws = S.word_score_table(lex, vec, ["g", "h"]).checkpoint()
    score = lambda **kw: S.score_with_table(stories, attrs, ws, L.lexicon_modes(lex), ["g", "h"], ["all"], **kw)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        small, large = score(), score(broadcast_bytes=0)
        plan = small._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(w" not in plan and "hashpartitioning(s_key" in plan
        assert "hashpartitioning(w" in large._jdf.queryExecution().executedPlan().toString()
        a, b = _scores(small), _scores(large)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(a) == 40 * 6 and a.keys() == b.keys()
    assert all(a[k] == (None if b[k] is None else pytest.approx(b[k])) for k in a)


def test_axis_takes_few_jobs(spark):
    """The driver keeps plans and broadcasts of each job: poles are made once, and one run of choosers needs no ranks."""
    _, _, lex, vec = _story_case(spark)
    want = {}
    low, high = (x.collect() for x in L.poles(lex, vec))
    pairs = contrast_pairs(*L.poles(lex, vec)).collect()
    for d in ("g", "h"):
        of = [{r["word"]: np.array(r["vec"]) for r in side if r["dim"] == d} for side in (low, high)]
        mine = [p for p in pairs if p["dim"] == d]
        want[d] = np.mean([of[1][p["high_word"]] for p in mine], axis=0) - np.mean([of[0][p["low_word"]] for p in mine], axis=0)
    sc = spark.sparkContext
    sc.setJobGroup("axis", "axis")
    try:
        got = {r["dim"]: r["axis"] for r in S.axes(lex, vec).collect()}
    finally:
        sc._jsc.clearJobGroup()
    assert got.keys() == want.keys() and all(np.allclose(got[d], want[d]) for d in want)
    assert len(sc.statusTracker().getJobIdsForGroup("axis")) <= 40


def test_lexicon_means_do_not_depend_on_the_order_of_words(spark):
    """Ninths that add up to a whole number: the mean is its quotient, so that a tie of the rounding stays one."""
    rng = np.random.default_rng(2)
    lex = _lex(spark, [("g", f"n{i}", i / 9.0, i) for i in range(10)])
    picks = []
    while len(picks) < 30:
        p = rng.integers(0, 10, 128)
        p[-1] = (int(p[-1]) - int(p.sum())) % 9
        picks.append(p)
    attrs = spark.createDataFrame([(k, "all", f"n{i}") for k, p in enumerate(picks) for i in p], "s_key long, am string, attr string")
    stories = spark.createDataFrame([(k,) for k in range(30)], "s_key long")
    got = _scores(S.score_stories(stories, attrs, lex, None, dims=["g"], ams=["all"], sms=["avg"]))
    assert got == {(k, "g", "avg"): int(p.sum()) // 9 / 128 for k, p in enumerate(picks)}


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_unit_vectors_make_their_norm_once(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), (None,)], "v array<double>").select(
        "v", unit("v").alias("u"))
    assert _plan(df).count("aggregate(") == 1  # not once more for each element
    assert [r["u"] for r in df.collect()] == [[0.6, 0.8], [0.0, 0.0], None]


def test_coordinates_that_miss_the_same_words_share_a_count(spark):
    rows = [(w, d, "avg", s) for w, s in (("a", 1 / 9), ("b", 0.5)) for d in ("p", "q")]
    rows += [("a", "r", "avg", 1.0), ("a", "p", "sim", 0.25), ("c", "p", "sim", 0.5), ("c", "q", "sim", 0.5)]
    words = spark.createDataFrame(rows, "w string, dim string, sm string, wscore double")
    coords = [("p", "avg"), ("q", "avg"), ("r", "avg"), ("p", "sim"), ("q", "sim")]
    wide = S.wide_word_scores(words, coords).cache()
    n_bytes, same_nulls, has_rest = S._table_facts(wide, coords)
    assert n_bytes == 3 * 8 * (6 + 5) + 3
    assert same_nulls == [0, 0, 2, 3, 4] and has_rest[:3] == [True, True, False]
    stories = spark.createDataFrame([(1,), (2,)], "s_key long")
    attrs = spark.createDataFrame([(1, "all", x) for x in "abbc"] + [(2, "all", "c")], "s_key long, am string, attr string")
    modes = spark.createDataFrame([("p", False), ("q", False), ("r", True)], "dim string, unipolar boolean")

    def scored(**kw):
        return S.score_with_table(stories, attrs, words, modes, ams=["all"], coords=coords, **kw)

    # all rows, p/q avg, r avg, p sim, q sim
    assert len(set(re.findall(r"count\((\w+)", _plan(scored()).split("Aggregate")[1]))) == 5
    got = _scores(scored())
    assert got[(1, "p", "avg")] == pytest.approx((1 / 9 + 1) / 3) and got[(1, "r", "avg")] == 1 / 4
    assert got[(1, "p", "sim")] == 0.375 and got[(2, "q", "sim")] == 0.5 and got[(2, "p", "avg")] == 0.0
    assert got == pytest.approx(_scores(scored(broadcast_bytes=0)))


def test_words_are_scored_by_norms_made_before_the_dimensions(spark):
    vec = spark.createDataFrame([("x", [3.0, 4.0]), ("o", [0.0, 0.0])], "word string, vec array<double>")
    per_dim = spark.createDataFrame([("p", [1.0, 0.0]), ("q", [0.0, 2.0])], "dim string, axis array<double>")
    df = S.vector_word_scores(vec, per_dim, per_dim.withColumnRenamed("axis", "centroid"), ["p", "q"])
    got = {(r["w"], r["dim"], r["sm"]): r["wscore"] for r in df.collect()}
    assert got == pytest.approx({("x", "p", "axis"): 0.6, ("x", "q", "axis"): 0.8, ("x", "p", "sim"): 0.6, ("x", "q", "sim"): 1.6,
                                 ("o", "p", "axis"): 0.0, ("o", "q", "axis"): 0.0, ("o", "p", "sim"): 0.0, ("o", "q", "sim"): 0.0})
    above = [line for line in _plan(df).splitlines() if "wscore" in line]
    assert above and not any("SQRT" in line for line in above)
