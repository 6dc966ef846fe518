"""Merkle manifest against the rule's own wording."""

import hashlib
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from storylens.llm import merkle, queries
from tests.llm import odd


def H(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text):
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def climb(nodes):
    """Root, and of each node its siblings with the side they stand on."""
    paths, level, own = [[] for _ in nodes], list(nodes), list(range(len(nodes)))
    while len(level) > 1:
        runs = [level[i:i + 8] for i in range(0, len(level), 8)]
        for k, path in enumerate(paths):
            at = own[k]
            path.append((runs[at // 8][:at % 8], runs[at // 8][at % 8 + 1:]))
            own[k] = at // 8
        level = [H("".join(r)) for r in runs]
    return level[0], paths


def brute(rows):
    """rows: (doc_id, text, lang, source, n_chars)."""
    trees = {}
    for d, t, lang, s, n in rows:
        tampered = zlib.crc32(b"" if d is None else str(d).encode()) % 3 == 0
        low = t if t is None or not tampered else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
        trees.setdefault(lang, []).append(((d is not None, d), leaf(d, s, lang, n, t), leaf(d, s, lang, n, low), d))
    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    done = {}
    for lang in langs:
        trees[lang].sort(key=lambda x: x[:3])
        done[lang] = climb([x[1] for x in trees[lang]])
    root, top = climb([done[x][0] for x in langs])
    out = []
    for at, lang in enumerate(langs):
        for (_, own, seen, d), path in zip(trees[lang], done[lang][1], strict=True):
            proof, h = path + top[at], seen
            for left, right in proof:
                h = H("".join(left) + h + "".join(right))
            out.append((d, own, done[lang][0], root, H("".join("".join(a) + "".join(b) for a, b in proof)), h, h == root))
    return sorted(out, key=str)


def got(spark, docs):
    tampered = queries.crc_remainder(F.col("doc_id"), 3) == 0
    seen = F.when(tampered, merkle.lowered(F.col("text"))).otherwise(F.col("text"))
    return sorted(map(tuple, merkle.proofs(merkle.leaves(docs, seen), False).select(
        "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=str)


def many(n):
    langs = ["en"] * 6 + ["de", "fr", None, "", "é"]
    return [(i * 7 % 1009, f"Text {i} Of {i % 13}", langs[i % len(langs)], "s", i) for i in range(n)]


@pytest.mark.parametrize("levels", [1, 4])
def test_proofs_equal_the_rule(spark, monkeypatch, levels):
    """With blocks of 8 leaves there are several rounds, and last subtrees that
    are not full."""
    monkeypatch.setattr(merkle, "BLOCK_LEVELS", levels)
    rows = many(700)
    if levels == 1:
        # the workers' copy of the module keeps its own number of levels
        blocks = [(f"t{n}", b, n, H(f"{n}.{b}")) for n in (8 * 70, 9, 8, 1, 8 * 65 + 3) for b in range(-(-n // 8))]
        df = spark.createDataFrame(blocks, "tree string, block long, size long, digest string")
        out = {(r["tree"], r["block"]): r for r in merkle.butterfly(df).collect()}
        assert len(out) == len(blocks)
        for n in {x[2] for x in blocks}:
            own = [x[3] for x in blocks if x[2] == n]
            root, paths = climb(own)
            for b, path in enumerate(paths):
                assert out[f"t{n}", b]["root"] == root
                assert out[f"t{n}", b]["proof"] == [h for left, right in path for h in left + right]
    else:
        assert got(spark, odd.frame(spark, rows)) == brute(rows)


def test_several_blocks(spark):
    rows = [(i, f"T{i}", "en" if i % 50 else None, None, 1) for i in range(9000)]
    assert got(spark, odd.frame(spark, rows)) == brute(rows)


def test_odd_rows(spark, docs, rows):
    assert got(spark, docs) == brute(rows)
    repeated = [(1, "one two three four five", "en", "s", 1)] * 3 + [(None, "no id here at all", None, None, None)] * 2 + [
        (2, None, None, None, None)]
    assert got(spark, odd.repeated(spark)) == brute(repeated)
    assert got(spark, odd.empty(spark)) == []


def test_siblings_verify_and_tampering_shows(spark):
    docs = odd.frame(spark, many(100))
    out = merkle.proofs(merkle.leaves(docs, F.concat("text", F.lit("!")))).collect()
    assert all(not r["verified"] and r["folded_root"] != r["root"] for r in out)
    for r in merkle.proofs(merkle.leaves(docs)).collect():
        assert r["verified"] and merkle.digest(*r["siblings"]) == r["proof_sha256"]


def test_query_equals_its_twin(spark, sf_small):
    a = queries.QUERIES["op11_merkle_manifest"](spark, sf_small).toPandas()
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf_small}/documents.parquet'")
    b = con.sql(queries.ORACLE["op11_merkle_manifest"]).df()
    key = sorted(a.columns)
    assert a[key].sort_values("leaf").values.tolist() == b[key].sort_values("leaf").values.tolist()
    assert 0 < a["verified"].sum() < len(a)
