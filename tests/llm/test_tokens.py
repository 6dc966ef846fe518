"""Token counts, piece encoding and token files against the libraries."""

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from storylens.llm import pieces, token_count, token_files
from storylens.llm import tokenizers as T
from tests.llm import odd


def test_marked_words_join_to_library_ids():
    m = T.piece_model(T.PIECE_MODEL)
    assert T.splits_at_markers(T.PIECE_MODEL)
    for t in [x or "" for x in odd.make_texts()]:
        ids = [i for w in T.piece_ids(T.PIECE_MODEL, T.marked_words(t)) for i in w]
        assert ids == m.encode(t), t


@pytest.mark.parametrize("share", [token_count.HEAD_SHARE, 4])
def test_token_counts(spark, docs, rows, share):
    """With few hot pre-tokens too, so that most meet their counts by shuffle."""
    m = T.piece_model(T.PIECE_MODEL)
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in token_count.token_counts(docs, share=share).collect()}
    assert got == {r[0]: (len((r[1] or "").encode()), len(m.encode(r[1] or ""))) for r in rows}


def test_token_counts_repeated_and_empty(spark):
    got = token_count.token_counts(odd.repeated(spark)).collect()
    assert sorted((r["doc_id"] or -1, r["n_tokens"] > 0) for r in got) == [(-1, True)] * 2 + [(1, True)] * 3 + [(2, False)]
    assert token_count.token_counts(odd.empty(spark)).count() == 0


def test_piece_digests_and_round_trip(spark, docs, rows):
    m = T.piece_model(T.PIECE_MODEL)
    got = {r["doc_id"]: r for r in docs.select("doc_id", pieces.digests(F.col("text")).alias("d")).select(
        "doc_id", "d.*").collect()}
    full = {r["doc_id"]: r for r in pieces.encode(docs).select("doc_id", "piece_ids", "decoded_text", "score").collect()}
    for i, t, *_ in rows:
        ids = m.encode(t or "")
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(m.decode(ids).encode()).hexdigest()
        assert full[i]["piece_ids"] == ids and full[i]["decoded_text"] == m.decode(ids) and full[i]["score"] == "clash"


def test_pieces_of_repeated_and_empty(spark):
    assert pieces.encode(odd.repeated(spark)).count() == 6
    assert pieces.encode(odd.empty(spark)).count() == 0


def test_piece_table_is_bounded(monkeypatch):
    monkeypatch.setattr(pieces, "TABLE_WORDS", 3)
    chunks = pieces._Chunks(T.PIECE_MODEL)
    texts = [t or "" for t in odd.make_texts()]
    m = T.piece_model(T.PIECE_MODEL)
    for t in texts:
        ids = m.encode(t)
        assert chunks.texts([t]) == [(",".join(map(str, ids)), len(ids), m.decode(ids))]


def _want_files(rows):
    k = T.byte_model(T.BYTE_MODEL)
    out, start = {}, 0
    for i, t, *_ in sorted(rows):
        ids = k.encode(t or "", add_special_tokens=False).ids + [2]
        out[i] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids)
        start += len(ids)
    return out


@pytest.mark.parametrize("file_bytes", [token_files.FILE_BYTES, 2000])
def test_token_files_round_trip(spark, docs, rows, file_bytes):
    folder = token_files.shared_folder(spark)
    manifest = token_files.write_ids(docs, folder, file_bytes=file_bytes)
    assert len(manifest) > (file_bytes == 2000)
    got = token_files.read_ids(spark, folder, manifest, with_ids=True).collect()
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"], r["ids"]) for r in got} == _want_files(rows)


def test_token_files_ignore_files_of_lost_attempts(spark, docs, rows):
    folder = token_files.shared_folder(spark)
    token_files.write_ids(docs, folder)  # files that no manifest names
    manifest = token_files.write_ids(docs, folder)
    got = token_files.read_ids(spark, folder, manifest).collect()
    assert {r["doc_id"]: (r["start"], r["n_tokens"]) for r in got} == {i: v[:2] for i, v in _want_files(rows).items()}


def test_token_files_of_repeated_and_empty(spark):
    folder = token_files.shared_folder(spark)
    got = token_files.read_ids(spark, folder, token_files.write_ids(odd.repeated(spark), folder)).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None, None, 1, 1, 1, 2] and got[-1]["n_tokens"] == 1
    assert token_files.read_ids(spark, folder, token_files.write_ids(odd.empty(spark), folder)).count() == 0


def test_encoder_slices(monkeypatch):
    monkeypatch.setattr(token_files, "SLICE_WORDS", 5)
    e, k = token_files._Encoder(T.BYTE_MODEL, 2), T.byte_model(T.BYTE_MODEL)
    texts = [t or "" for t in odd.make_texts()]
    got = [x.tolist() for n, f in e.group(pa.array(texts, pa.large_string())) for x in np.split(f, np.cumsum(n)[:-1])]
    assert got == [k.encode(t, add_special_tokens=False).ids + [2] for t in texts]
