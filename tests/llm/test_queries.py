"""Registered queries on the smallest tables: the columns they derive from
their operators, against the libraries and brute force."""

import hashlib
import re
import zlib

import numpy as np
import pytest

from storylens.llm import quality, queries
from tests.llm import odd
from tests.llm.test_models import labelled_docs

WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@pytest.fixture(scope="module")
def texts(spark, sf_small):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()}


def rows(spark, sf, name):
    return {r["doc_id"]: r.asDict() for r in queries.QUERIES[name](spark, sf).collect()}


def words(text):
    return WORDS.findall(text.encode().lower())


def test_op1_columns(spark, sf_small, texts):
    got = rows(spark, sf_small, "op1_quality_classifier")
    assert got.keys() == texts.keys()
    for i, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)


def test_op3_op6_counts(spark, sf_small, texts):
    import public_tokenizers
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    counts, coded = rows(spark, sf_small, "op3_token_counts"), rows(spark, sf_small, "op6_sentencepiece")
    for i, t in texts.items():
        ids = lib.encode(t)
        assert (counts[i]["n_bytes"], counts[i]["n_tokens"], counts[i]["over_limit"]) == (len(t.encode()), len(ids), len(ids) > 4096)
        assert coded[i] == {"doc_id": i, "n_tokens": len(ids), "ids_sha256": hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                            "decoded_sha256": hashlib.sha256(lib.decode(ids).encode()).hexdigest()}


def test_op4_base_columns(spark, sf_small, texts):
    base = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
    for i, r in rows(spark, sf_small, "op4_license_scan").items():
        w = words(texts[i])
        places = {p: [k for k in range(len(w)) if w[k:k + len(p.split())] == p.encode().split()] for p in base}
        found = sorted(k for v in places.values() for k in v)
        labels = sorted(base[p] for p, v in places.items() if v)
        assert (r["n_words"], r["n_base"]) == (len(w), len(found))
        assert (r["first_word"], r["last_word"]) == ((found[0], found[-1]) if found else (None, None))
        assert r["base_labels"] == ",".join(labels) and set(labels) <= set(r["labels"].split(",")) | {""}
        assert r["labels"].split(",") == sorted(set(r["labels"].split(","))) and 0 <= r["score"] <= 1


def test_op5_columns(spark, sf_small, texts):
    items = {r["item_id"]: words(r["text"] or "") for r in spark.read.parquet(f"{sf_small}/benchmark.parquet").collect()}
    windows = {}
    for i, w in items.items():
        for k in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[k:k + 13]), set()).add(i)
    sizes = {len(w) for w in windows}
    for i, r in rows(spark, sf_small, "op5_decontaminate").items():
        w, hit, seen = words(texts[i]), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if tuple(w[k:k + n]) in windows:
                    hit |= set(range(k, k + n))
                    seen |= windows[tuple(w[k:k + n])]
        digest = hashlib.sha256(",".join(sorted(map(str, seen))).encode()).hexdigest()
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"]) == (len(w), len(hit), len(seen), digest)
        assert r["contaminated"] == (len(hit) > 0 and 20 * len(hit) >= len(w))


def test_op8_columns(spark, sf_small, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    lib, start = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0
    got = rows(spark, sf_small, "op8_token_files")
    for i in sorted(texts):
        ids = [*lib.encode(texts[i], add_special_tokens=False).ids, 2]
        assert (got[i]["start"], got[i]["n_tokens"]) == (start, len(ids))
        assert got[i]["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)


def test_op10_columns(spark, sf_small, texts):
    got = rows(spark, sf_small, "op10_simhash_near_dedup")
    assert got.keys() == texts.keys()
    fps = {i: int(r["fingerprint"], 16) for i, r in got.items()}
    least = {i: i for i in fps}
    for _ in range(len(fps)):
        new = {i: min(least[j] for j in fps if (fps[i] ^ fps[j]).bit_count() <= 2) for i in fps}
        if new == least:
            break
        least = new
    assert {i: r["component_id"] for i, r in got.items()} == least


def test_ridge_weights_and_scores_against_a_direct_solve(spark):
    """Moments, normal equations and scores from all rows at once."""
    docs, labels = labelled_docs(spark, 240)
    docs = docs.select("doc_id", "text")
    known = quality.training_labels(labels)
    model = quality.fit(docs, known)
    got = quality.labelled(docs, known).collect()
    x = np.array([r["stats"] for r in got])
    y = np.array([r["label"] for r in got], float)
    late = np.array([r["calibrates"] for r in got])
    assert np.allclose(model.mean, x.mean(0))
    sd = x.std(0)
    assert np.allclose(model.scale[sd > 1e-3], sd[sd > 1e-3], rtol=1e-6)
    z = model.features(x[~late])
    lam = quality.RIDGE * np.eye(z.shape[1])
    lam[-1, -1] = 1e-9
    # the ridge problem as least squares with rows for the penalty
    direct = np.linalg.lstsq(np.vstack([z, np.sqrt(lam)]), np.concatenate([y[~late], np.zeros(len(lam))]), rcond=None)[0]
    assert np.allclose(z @ model.weights, z @ direct, atol=1e-6)
    scored = {r["doc_id"]: r["quality_score"] for r in quality.scored(docs, model).collect()}
    every = docs.select("doc_id", "text").collect()
    raw = np.array([quality.statistics(r["text"]) for r in every])
    want = np.interp(model.features(raw) @ direct, model.knots, model.levels)
    assert np.allclose([scored[r["doc_id"]] for r in every], want, atol=1e-5)
    assert odd.frame(spark, []).count() == 0
