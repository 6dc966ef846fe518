"""The pipeline's stages against brute-force versions of their decisions."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from storylens.llm import decontaminate, quality
from storylens.llm import tokenizers as T
from tests.llm.test_dedup import brute_components, brute_cut, brute_fingerprint
from tests.llm.test_search import brute_hits


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """documents, labels and benchmark tables with planted cases."""
    rng = random.Random(8)

    def text(k):
        return " ".join("".join(rng.choices("aeioustnrl", k=rng.randint(2, 8))) for _ in range(k)) + "."

    item, passage, near = text(30), text(60), text(300).split()
    docs, labels = [], []
    for i in range(150):
        t = text(rng.randint(30, 90))
        good = i % 3 > 0 or i >= 100
        if not good:
            t = t.upper().replace(" ", "!! ")
        elif i >= 140:
            t = " ".join([*near[:i - 100], "changed", *near[i - 100:]])
        elif i >= 130:
            t = t + " " + passage + " " + text(20)
        elif i >= 125:
            t = t + " " + item
        docs.append((i, t, "en", f"src{i % 4}", len(t)))
        if i < 100:
            labels.append((i, int(good), 0))
    docs += [(150, docs[101][1], "en", "src0", docs[101][4]), (151, "", "en", "src0", 0), (152, None, None, None, None)]
    top = str(tmp_path_factory.mktemp("pipeline"))
    for name, rows, schema in (
            ("documents", docs, "doc_id long, text string, lang string, source string, n_chars long"),
            ("labels", labels, "doc_id long, quality int, toxic int"),
            ("benchmark", [(1, item)], "item_id long, text string")):
        spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{top}/{name}.parquet")
    return top


def rows_of(df):
    return sorted((r["doc_id"], r["text"]) for r in df.collect())


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    by = dict(P.STAGES)
    assert list(by) == ["quality", "near-copies", "repeats", "decontamination", "sentencepiece"]
    kept = by["quality"](spark, docs, folder).cache()
    assert kept.columns == P.COLUMNS
    ids = {r["doc_id"] for r in kept.collect()}
    assert not ids & {i for i in range(100) if i % 3 == 0} and set(range(100, 151)) <= ids
    model = quality.fit(docs, quality.training_labels(spark.read.parquet(f"{folder}/labels.parquet")))
    scores = {r["doc_id"]: r["quality_score"] for r in quality.scored(docs, model).collect()}
    assert ids == {i for i, s in scores.items() if s >= quality.ACCEPT}

    apart = by["near-copies"](spark, kept, folder).cache()
    texts = {r["doc_id"]: r["text"] for r in kept.collect()}
    want = brute_components({i: brute_fingerprint(t) for i, t in texts.items()})
    assert {r["doc_id"] for r in apart.collect()} == set(want.values()) and apart.columns == P.COLUMNS
    assert 150 not in set(want.values()) and len(set(want.values()) & set(range(140, 150))) < 10

    cut = by["repeats"](spark, apart, folder).cache()
    before = rows_of(apart.where("text is not null"))
    brute = {r[0]: r for r in brute_cut(before)}
    after = dict(rows_of(cut))
    for i, t in before:
        n, gone = brute[i][1], brute[i][2]
        assert (i in after) == (gone < n or gone == 0)
        assert i not in after or len(after[i].encode()) == n - gone
    assert cut.columns == P.COLUMNS and cut.where("n_chars <> char_length(text)").count() == 0

    clean = by["decontamination"](spark, cut, folder).cache()
    item = spark.read.parquet(f"{folder}/benchmark.parquet").first()["text"]
    bad = {i for i, t in after.items() for n, hit, _ in [brute_hits(t, [(1, item)])]
           if hit and decontaminate.RATE * hit >= n}
    assert bad and {r["doc_id"] for r in clean.collect()} == set(after) - bad and clean.columns == P.COLUMNS

    last = by["sentencepiece"](spark, clean, folder)
    m = T.piece_model(T.PIECE_MODEL)
    for r in last.collect():
        assert r["piece_ids"] == m.encode(r["text"]) and r["decoded_text"] == m.decode(r["piece_ids"])
    assert rows_of(P.run(spark, folder)) == rows_of(last)


def test_stages_take_an_empty_table(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("false").withColumn("extra", F.lit(1))
    for _, stage in P.STAGES:
        docs = stage(spark, docs, folder)
        assert docs.count() == 0
