"""Attributes that come as one text or list per story are scored like rows of them, without a row for a token."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from storylens.operators import attrs as A
from storylens.operators import score as S
from storylens.plans import common as C
from storylens.sources import fixtures as fx

COORDS = [("p", "avg"), ("q", "avg"), ("r", "avg"), ("p", "sim"), ("q", "sim")]


def _case(spark):
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(20)] + ["σς", "i̇x"]
    rows = [(w, d, "avg", float(v)) for w in words[:12] + words[20:] for d, v in zip("pq", rng.integers(0, 9, 2) / 9)]
    rows += [(w, "r", "avg", 1.0) for w in words[3:8]] + [(w, d, "sim", float(rng.normal())) for w in words[6:] for d in "pq"]
    rows += [(None, "p", "avg", 5.0), ("nan", "p", "sim", float("nan")), ("", "p", "avg", 7.0)]
    ws = spark.createDataFrame(rows, "w string, dim string, sm string, wscore double")
    modes = spark.createDataFrame([("p", False), ("q", False), ("r", True)], "dim string, unipolar boolean")
    seps = [" ", "\t", "\n ", "\x0b", "\f\r", " "]
    texts = []
    for k in range(30):
        w = rng.choice([*words, "W3", "none", "ΣΣ", "İX"], int(rng.integers(1, 40)))
        texts.append((k // 2 if k % 7 else None, "all" if k % 3 else "sub", "".join(str(x) + str(rng.choice(seps)) for x in w)))
    texts += [(40, "all", None), (41, "all", ""), (42, "all", " \n "), (43, "all", "nan w7"), (44, "other", "w7")]
    stories = spark.createDataFrame([(k,) for k in [*range(16), 3, None, 40, 41, 42, 43, 44]], "s_key long")
    return stories, spark.createDataFrame(texts, "s_key long, am string, attrs string"), ws, modes


def _rows(df):
    out = [tuple("nan" if x != x else round(x, 12) if isinstance(x, float) else x for x in r) for r in
           df.select("s_key", "am", "dim", "sm", "score").collect()]
    return sorted(out, key=str)


def test_texts_and_lists_score_like_rows(spark):
    stories, texts, ws, modes = _case(spark)
    lists = texts.select("s_key", "am", S.whitespace_words("attrs").alias("attrs"))
    rows = lists.select("s_key", "am", F.explode("attrs").alias("attr"))

    def scored(attrs, **kw):
        return S.score_with_table(stories, attrs, ws, modes, ams=["all", "sub"], coords=COORDS, **kw)

    want = _rows(scored(rows))
    half = [texts.filter("am = 'all'"), lists.filter("am <> 'all'")]
    for attrs in ([texts], [lists], half):
        got = scored(attrs)
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInArrow" in plan and "Generate explode(split" not in plan and "attr#" not in plan.replace("attrs#", "")
        assert _rows(got) == want
    assert _rows(scored(half, broadcast_bytes=0)) == want  # a table over the limit
    assert any(r[4] not in (None, 0.0) for r in want) and ("nan" in {r[4] for r in want})


def test_lists_that_hold_nulls_and_empty_words(spark):
    stories, _, ws, modes = _case(spark)
    lists = spark.createDataFrame([(1, "all", ["w1", None, "", "W1"]), (2, "all", []), (3, "all", None), (5, "all", [None])],
                                  "s_key long, am string, attrs array<string>")
    rows = lists.select("s_key", "am", F.explode("attrs").alias("attr"))
    a, b = (_rows(S.score_with_table(stories, x, ws, modes, ams=["all"], coords=COORDS)) for x in (rows, [lists]))
    assert a == b


def test_slices_of_any_size_give_the_same_sums():
    rng = np.random.default_rng(1)
    words = pa.array([f"w{i}" for i in range(50)])
    matrix = np.column_stack([rng.integers(0, 100, 50).astype(float), np.ones(50)])

    class Shared:
        value = words, matrix

    texts = [" ".join(rng.choice([f"w{i}" for i in range(60)], int(n))) for n in rng.integers(0, 300, 25)]
    rb = pa.RecordBatch.from_arrays([pa.array(range(25)), pa.array(["all"] * 25), pa.array(texts)], ["s_key", "am", "attrs"])
    place = {w: i for i, w in enumerate(words.to_pylist())}
    want = [[k, "all", len(t.split()), sum(matrix[place[w], 0] for w in t.split() if w in place), sum(w in place for w in t.split())]
            for k, t in enumerate(texts)]
    for most in (1, 700, 1 << 20):
        assert len(list(S._slices([rb], most))) == {1: 25, 1 << 20: 1}.get(most, len(list(S._slices([rb], most))))
        got = pa.Table.from_batches(S._attr_sums(Shared, 1, most)([rb])).to_pylist()
        assert [list(r.values()) for r in got] == want
    of, row = np.repeat(np.arange(3), 5), np.tile([-1, 3, 4, 3, -1], 3)
    assert np.array_equal(S._row_sums(of, row, matrix, 4, most=2), S._row_sums(of, row, matrix, 4))


@pytest.fixture
def documents(spark, tmp_path):
    rows = [(1, "The cat. of (la) View, view. " * 40), (2, ""), (3, None), (3, " The  end\tof it "), (2**40, "de. it's " * 70),
            (5, "x y z\u0085 abc\u0085 ÄB straSSe İ ΟΔΟΣ. ΟΔΟΣ")]
    spark.createDataFrame([(*r, "en") for r in rows], "doc_id long, text string, lang string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def test_operators_give_the_same_attributes_unexploded(spark, documents):
    rows = C.attrs_for(spark, documents)
    lists = S.exploded_attrs(C.attr_tables(spark, documents, exploded=False))
    count = lambda df: sorted(map(str, df.groupBy("s_key", "am", F.lower("attr").alias("w")).count().collect()))
    assert count(rows) == count(lists) and {r["am"] for r in rows.select("am").distinct().collect()} == {"all", "sub", "comet"}


def test_lists_of_a_key_that_is_null(spark):
    s = spark.createDataFrame([(k, 0, [0, 1, 2], ["x", "the", "y"], ["JJ", "NN", "NN"], ["ROOT", "nsubj", "amod"], [0, 0, 1])
                               for k in (7, None, 2**53 + 1)], "s_key long, base int, pos array<int>, text array<string>, "
                              "tag array<string>, dep array<string>, head array<int>")
    rows = A.sub_attrs_from_sentences(s, ["the"]).select("s_key", "attr").collect()
    lists = A.sub_attrs_from_sentences(s, ["the"], exploded=False).select("s_key", F.explode("attrs").alias("attr")).collect()
    assert sorted(map(str, rows)) == sorted(map(str, lists)) and len(rows) == 6


def test_words_are_counted_without_a_row_for_each(spark, documents):
    want = fx.words(spark, documents).groupBy("word").agg(F.count(F.lit(1)).alias("cnt"))
    got = fx.word_counts(spark, documents)
    assert "explode" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(want.collect()) == sorted(got.collect()) and got.schema["cnt"].dataType == want.schema["cnt"].dataType
    t = pa.RecordBatch.from_arrays([pa.array(["a b a", None, "", "c  a"])], ["text"])
    for most in (1, 100):
        n = {}
        for r in (r for b in fx._counted([t], most) for r in b.to_pylist()):
            n[r["word"]] = n.get(r["word"], 0) + r["n"]
        assert {k: v for k, v in n.items() if k} == {"a": 3, "b": 1, "c": 1}
