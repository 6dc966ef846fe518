"""Steps whose memory must not follow the size of a batch, a file or a prompt."""

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from storylens.operators import attrs as A
from storylens.plans import q_incremental
from storylens.sources import fixtures, io


def test_parser_holds_a_bounded_number_of_tokens():
    """One large Arrow batch comes out in chunks, with the rows of a whole parse."""
    texts = [" ".join(f"w{i}_{k}" for k in range(n)) for i, n in enumerate([70, 0, 3, 33, 64, 500, 1, 12])] + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], ["s_key", "text"])
    parts = list(fixtures._sentence_parser([batch], most=100))
    assert len(parts) > 3
    tokens = [sum(map(len, p.column("pos").to_pylist())) for p in parts]
    assert all(n <= 100 or len(set(p.column("s_key").to_pylist())) == 1 for n, p in zip(tokens, parts))
    whole = pa.Table.from_batches(fixtures._sentence_parser([batch], most=10**6)).to_pylist()
    assert pa.Table.from_batches(parts).to_pylist() == whole
    assert sum(tokens) == sum(len((t or "").split()) for t in texts)


def test_attributes_are_taken_from_bounded_slices():
    texts = [" ".join(np.random.default_rng(i).choice(["the", "of", "cat", "dog"], 90)) for i in range(40)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(40), pa.int64()), pa.array(texts)], ["s_key", "text"])
    sentences = pa.Table.from_batches(fixtures._sentence_parser([batch])).select(
        ["s_key", "base", "pos", "text", "tag", "dep", "head"]).combine_chunks().to_batches()
    sizes = [int(s["pos"].map(len).sum()) for s in A._sentence_slices(sentences, rows=5, most=70)]
    assert max(sizes) <= 70 and sum(sizes) == 40 * 90
    assert [len(s) for s in A._sentence_slices(sentences, rows=5, most=1)] == [1] * sentences[0].num_rows
    got = pa.Table.from_batches(A._sub_batch(["the", "of"])(sentences)).to_pylist()
    one = [r for s in range(sentences[0].num_rows) for b in A._sub_batch(["the", "of"])([sentences[0].slice(s, 1)]) for r in b.to_pylist()]
    key = lambda r: tuple(r.values())
    assert sorted(got, key=key) == sorted(one, key=key) and {r["rule"] for r in got} == {"E02", "E03"}


def test_attributes_are_taken_without_an_object_for_a_token(monkeypatch):
    """Strings stay in Arrow; a large key beside a null one is whole."""
    monkeypatch.setattr(A, "_sentence_slices", None)
    batch = pa.RecordBatch.from_arrays([
        pa.array([2**53 + 1, None], pa.int64()), pa.array([0, 0], pa.int32()), pa.array([[0, 1], [0, 1]], pa.list_(pa.int32())),
        pa.array([["runs", "the"], ["the", None]]), pa.array([["VBZ", None], [None, "NN"]]),
        pa.array([["ROOT", "nsubj"], [None, "amod"]]), pa.array([[0, 0], [0, 0]], pa.list_(pa.int32()))],
        ["s_key", "base", "pos", "text", "tag", "dep", "head"])
    assert pa.Table.from_batches(A._sub_batch(["the"])([batch])).to_pylist() == [
        {"s_key": 2**53 + 1, "ord": 1, "attr": "runs", "rule": "E02"}, {"s_key": None, "ord": 1, "attr": None, "rule": "E03"}]


def test_mapping_objects_are_written_story_by_story(spark, tmp_path):
    """No line of an object file, so no row, holds more than one story."""
    rows = [(p, s, f'p"{p}', f'story \\ "{p}" {s}\n' if s % 3 else None if s else "") for p in (0, 1, 2, 3, 4) for s in range(9)]
    rows.append((7, 0, "last", "x"))
    path = str(tmp_path / "m")
    io.write_story_mapping_objects(spark.createDataFrame(rows, "p_ind long, s_ind long, prompt string, story string").orderBy(F.rand(1)),
                                   path, prompts_per_file=2)
    files = sorted((tmp_path / "m").glob("_file=*/part-*"))
    assert [f.parent.name for f in files] == [f"_file={i:09d}" for i in (0, 1, 2, 3)]
    got = [(prompt, story) for f in files for prompt, stories in json.loads(f.read_text()).items() for story in stories]
    assert got == [(r[2], r[3]) for r in rows]
    assert sum(len(f.read_text().splitlines()) for f in files) == len(rows)


def test_source_files_stay_small(spark):
    """Files, not batches or their size, grow in number with the texts."""
    import glob

    df = spark.createDataFrame([(str(i), "x" * 100) for i in range(200)], "s_id string, text string")
    for chars, per_batch in ((1 << 25, 1), (1000, 5)):
        path, n = q_incremental._write_source(spark, df, "bounded", chars)
        assert n == per_batch
        assert spark.read.parquet(path).count() == 200
        assert len(glob.glob(path.removeprefix("file:") + "/part-*")) == 4 * n


def test_long_tokens_are_shuffled_as_plain_lists(spark):
    """Attributes of a long token table in any order, with nulls, are those of its sentences; no structs of all columns."""
    rng = np.random.default_rng(5)
    rows = []
    for s in range(30):
        n = int(rng.integers(1, 20))
        for p in range(n):
            rows.append((s % 7, s, 40 + p, str(rng.choice(["the", "of", "cat", "dog"])) if rng.random() > 0.1 else None,
                         [None, "VBD", "JJ", "NN", "VBZ"][rng.integers(0, 5)], [None, "nsubj", "amod", "dep"][rng.integers(0, 4)],
                         40 + int(rng.integers(0, p + 1))))
    rng.shuffle(rows)
    rows = [tuple(x if isinstance(x, str) or x is None else int(x) for x in r) for r in rows]
    tokens = spark.createDataFrame(rows, "s_key long, sent_id int, pos int, text string, tag string, dep string, head_pos int")
    out = A.sub_attrs(tokens, ["the", "of"])
    want = A.sub_attrs_from_sentences(A.sentences(tokens), ["the", "of"])
    key = lambda r: tuple(map(str, r))
    assert sorted(out.collect(), key=key) == sorted(want.collect(), key=key) and {r["rule"] for r in want.collect()} == {"E02", "E03"}
    assert "struct(" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_rules_read_a_parser_in_its_own_task(spark, tmp_path):
    """Attributes of the grid went through the JVM as tokens between parser and rules."""
    from storylens.plans import common as C

    rows = [(1, "the cat of la view " * 40), (2, ""), (3, None), (3, "The  end\tof it"), (2**40, "de " * 70)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = C.attrs_for(spark, str(tmp_path), ["sub"])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
    want = A.sub_attrs_from_sentences(fixtures.sentences(spark, str(tmp_path)), fixtures.FIXTURE_PROTAGONIST)
    assert sorted((r["s_key"], r["attr"]) for r in got.collect()) == sorted((r["s_key"], r["attr"]) for r in want.collect())
    assert got.count() > 5
