"""Suffix-array dedup and SimHash components against brute force."""

import hashlib
import random
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
import xxhash

from storylens.llm import components as C
from storylens.llm import simhash as S
from storylens.llm import suffix_dedup as D
from tests.llm import odd


def brute_cut(rows):
    """``{row: (n_bytes, n_removed, n_spans, sha256)}`` of (doc_id, text)."""
    low = {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - D.LENGTH + 1):
            s = b[p:p + D.LENGTH]
            k = D.NULL_ID if i is None else i
            low[s] = min(low.get(s, k), k)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - D.LENGTH + 1):
            if low[b[p:p + D.LENGTH]] < (D.NULL_ID if i is None else i):
                gone[p:p + D.LENGTH] = b"\1" * D.LENGTH
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and not (k and gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


COLUMNS = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]


def cut(df):
    return sorted((tuple(r) for r in D.cut_repeats(df).select(*COLUMNS).collect()), key=str)


def test_anchor_of_a_string_depends_on_it_alone():
    rng = np.random.default_rng(3)
    s = rng.integers(97, 101, D.LENGTH).astype(np.uint8)
    seen = set()
    for pad in (0, 1, 77):
        x = np.concatenate([rng.integers(97, 101, pad), s, rng.integers(97, 101, 40)]).astype(np.uint8)
        first, count, place, h = D.anchors(x, np.array([len(x)]))
        k = int(np.flatnonzero((first <= pad) & (pad < first + count))[0])
        seen.add((int(place[k]) - pad, int(h[k])))
    assert len(seen) == 1


def test_anchor_runs_cover_each_string_once(monkeypatch):
    monkeypatch.setattr(D, "BLOCK", 64)
    rng = np.random.default_rng(4)
    ends = np.cumsum([0, 10, 49, 50, 51, 300, 0, 120])
    x = rng.integers(97, 100, ends[-1]).astype(np.uint8)
    first, count, place, _ = D.anchors(x, ends)
    got = np.concatenate([np.arange(f, f + c) for f, c in zip(first, count, strict=True)])
    starts = np.concatenate([[0], ends[:-1]])
    want = [p for s, e in zip(starts, ends, strict=True) for p in range(s, e - D.LENGTH + 1)]
    assert got.tolist() == want
    assert ((place >= first + count - 1) & (place <= first + D.LENGTH - D.GRAM)).all()


@pytest.mark.parametrize("letters", ["ab", "abcdefgh"])
def test_deep_shallow_order(letters):
    rng = random.Random(len(letters))
    base = "".join(rng.choices(letters, k=200))
    text = base + base[:150] + "".join(rng.choices(letters, k=100)) + base[40:140] + "a" * 120
    raw = text.encode()
    starts = np.array(rng.sample(range(len(raw) - D.LENGTH + 1), 300))
    order, new = D.sorted_strings(np.frombuffer(raw, np.uint8), starts)
    got = [raw[starts[i]:starts[i] + D.LENGTH] for i in order]
    assert got == sorted(got) and sorted(order.tolist()) == list(range(300))
    assert [bool(x) for x in new] == [k == 0 or got[k] != got[k - 1] for k in range(300)]


def test_blind_trie_orders_and_groups():
    rng = random.Random(9)
    strings = ["".join(rng.choices("ab\0", k=6)).encode() for _ in range(400)]
    trie = D.BlindTrie(6)
    for i, s in enumerate(strings):
        trie.insert(s, i)
    leaves = [[strings[i] for i in items] for items in trie.leaves()]
    assert [x[0] for x in leaves] == sorted(set(strings)) and all(len(set(x)) == 1 for x in leaves)


@pytest.mark.parametrize("chunk", [D.CHUNK, 700])
def test_cut_repeats(spark, docs, rows, monkeypatch, chunk):
    """With all documents in few chunks, and with a chunk for each or so."""
    monkeypatch.setattr(D, "CHUNK", chunk)
    assert cut(docs) == brute_cut([(r[0], r[1]) for r in rows])


def test_cut_one_common_passage(spark):
    """A passage in every document, and texts that repeat themselves."""
    rng = random.Random(2)
    p = "".join(rng.choices("abcdef ", k=80))
    rows = [(i, "".join(rng.choices("abcdef ", k=rng.randint(0, 60))) + p + "x" * (i % 90), "l", "s", 1) for i in range(120)]
    assert cut(odd.frame(spark, rows, 7)) == brute_cut([(r[0], r[1]) for r in rows])


def phrase_rows(n):
    """One phrase with other text around it in each row, and some equal rows."""
    rng = random.Random(6)
    around = ["".join(rng.choices("abcdefgh ", k=70)) for _ in range(2 * n)]
    rows = [(i, around[2 * i] + "the footer of every page here" + around[2 * i + 1]) for i in range(n)]
    return rows + [(n + i, "x" * i + t) for i, (_, t) in enumerate(rows[:9])]


def test_cut_one_common_phrase(spark, monkeypatch):
    monkeypatch.setattr(D, "HOT", 8)
    rows = phrase_rows(60)
    assert cut(odd.frame(spark, [(*r, "l", "s", 1) for r in rows], 5)) == brute_cut(rows)


def test_stretches_of_one_anchor_are_spread():
    """No bucket gets most of what a common phrase's anchors send."""
    buckets, raw = 40, [t.encode() for _, t in phrase_rows(400)]
    ends = np.cumsum([len(r) for r in raw])
    data = D.pack(np.arange(len(raw)), ends, np.frombuffer(b"".join(raw), np.uint8))
    chunk = D.Chunk(data, buckets)
    several, n = chunk.several(), chunk.stretches()
    assert n.max() > 100
    sent = pd.DataFrame([(k, 0, D.pack(np.diff((chunk.keys[s] & np.uint64(0xFFFFFFFF)).astype(np.int64), prepend=0).astype("<u4"),
                                       np.packbits(several[s]), n[s].astype("<u4"))) for k, s in chunk.slices(buckets)],
                        columns=["bucket", "chunk", "data"])
    largest = {}
    for hot in (8, 1 << 30):
        replies = pd.concat([D._shared_anchors(hot)(g) for _, g in sent.groupby("bucket")])
        out = D._send_stretches(buckets)((0,), pd.DataFrame({"data": [data]}), replies)
        sizes = [len(D.unpack(x)[0]) for x in out["data"]]
        largest[hot] = max(sizes) / sum(sizes)
    assert largest[8] < 0.1 < largest[1 << 30]


def test_cut_of_repeated_null_ids_and_empty(spark):
    text = "a passage of more than fifty bytes that some rows have in common"
    rows = [(5, text, "l", "s", 1), (5, text, "l", "s", 1), (None, text, "l", "s", 1), (7, "short", "l", "s", 1)]
    assert cut(odd.frame(spark, rows)) == brute_cut([(r[0], r[1]) for r in rows])
    assert cut(odd.repeated(spark)) == brute_cut([(1, "one two three four five")] * 3 + [(None, "no id here at all")] * 2 + [(2, None)])
    assert cut(odd.empty(spark)) == []


def test_kept_texts_and_columns(spark):
    text = "Ünïcödé passage of more than fifty bytes that is in two rows, "
    rows = [(1, text + "one", "de", "s1", 1), (2, "é" + text + "two", "fr", "s2", None)]
    got = {r["doc_id"]: r for r in D.cut_repeats(odd.frame(spark, rows), ["lang", "data", "n_chars"]).collect()}
    assert got[1]["kept"] == text + "one" and got[2]["kept"] == "étwo"
    assert (got[2]["own_lang"], got[2]["own_data"], got[2]["own_n_chars"]) == ("fr", "clash", None)


# --- SimHash ---------------------------------------------------------------------

def brute_fingerprint(t):
    w = (t or "").encode().lower().split()
    if not w:
        return 0
    s = [b" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or [b" ".join(w)]
    h = [xxhash.xxh64_intdigest(x, seed=42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps: dict, distance=2):
    root = {i: i for i in fps}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(fps, 2):
        if (fps[a] ^ fps[b]).bit_count() <= distance:
            x, y = top(a), top(b)
            root[max(x, y)] = min(x, y)
    return {i: top(i) for i in fps}


def test_near_duplicates(spark, docs, rows):
    fps = {r[0]: brute_fingerprint(r[1]) for r in rows}
    want = brute_components(fps)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in S.near_duplicates(docs).collect()}
    assert got == {i: (f"{fps[i]:016x}", want[i]) for i in fps}
    kept = S.deduplicated(docs)
    assert {r["doc_id"] for r in kept.collect()} == set(want.values()) and kept.columns == docs.columns


@pytest.mark.parametrize("bucket", [S.BUCKET, 3])
def test_links_of_dense_fingerprints(spark, monkeypatch, bucket):
    """Clusters far larger than a bucket, chains, and far-off ones."""
    monkeypatch.setattr(S, "BUCKET", bucket)
    rng = random.Random(6)
    fps = set()
    for _ in range(6):
        x = rng.getrandbits(64)
        for _ in range(40):
            fps.add(x)
            x ^= (1 << rng.randrange(64)) | (1 << rng.randrange(64)) if rng.random() < 0.8 else rng.getrandbits(64)
    fps |= {1 << i for i in range(20)}
    df = spark.createDataFrame([(S.signed(x),) for x in sorted(fps)], "fp long")
    part = {r["node"]: r["component"] for r in C.components(S.links(df)).collect()}
    got = {}
    for x in fps:
        got.setdefault(part.get(S.signed(x), S.signed(x)), set()).add(x)
    want = {}
    for x, c in brute_components({x: x for x in fps}).items():
        want.setdefault(c, set()).add(x)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_plan_keeps_the_pigeonhole_sum():
    rng = np.random.default_rng(1)
    sample = rng.integers(0, 1 << 63, 300).astype(np.uint64)
    for size in (10, 10**5, 10**9):
        for distance in (0, 1, 2, 3):
            parts = S.plan(sample, size, distance)
            masks = [m for m, _ in parts]
            assert all(a & b == 0 for a, b in combinations(masks, 2)) and parts
    cost, given = S.allot([[0, 1, 5, 50], [0, 9, 20, 60], [0, 2, 3, 70]], -1)
    assert sum(given) == -1 and cost == min(
        c for c, s in ((a + b + d, i + j + k - 3) for i, a in enumerate([0, 1, 5, 50])
                       for j, b in enumerate([0, 9, 20, 60]) for k, d in enumerate([0, 2, 3, 70])) if s == -1)


def test_long_chain_of_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 500), (900, 800)], "a long, b long")
    got = {r["node"]: r["component"] for r in C.components(edges).collect()}
    assert got == {**{i: 0 for i in range(1, 201)}, 900: 800}


def test_near_duplicates_of_repeated_and_empty(spark):
    got = sorted(((r["doc_id"] or -1, r["component_id"]) for r in S.near_duplicates(odd.repeated(spark)).collect()), key=str)
    assert got == [(-1, None), (-1, None), (1, 1), (1, 1), (1, 1), (2, 2)]
    assert sorted(r["doc_id"] or -1 for r in S.deduplicated(odd.repeated(spark)).collect()) == [-1, 1, 2]
    assert S.near_duplicates(odd.empty(spark)).count() == 0 and S.deduplicated(odd.empty(spark)).count() == 0


@pytest.mark.parametrize("deep", [1, 2, 3])
def test_multikey_quicksort(deep):
    """Order and borders against sorted tuples: few and many different characters, all equal, one, none."""
    rng = np.random.default_rng(deep)
    for n, high in ((0, 2), (1, 2), (2, 1), (50, 1), (500, 2), (500, 3), (500, 2**62), (3000, 20)):
        chars = rng.integers(0, high, (deep, n)).astype(np.uint64)
        order, new = D.multikey_quicksort(chars)
        assert sorted(order.tolist()) == list(range(n))
        rows = [tuple(chars[:, i].tolist()) for i in order]
        assert rows == sorted(rows)
        assert new.tolist() == [i == 0 or rows[i] != rows[i - 1] for i in range(n)]
