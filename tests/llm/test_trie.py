"""Conversation trie against nested dictionaries, and the radix tree itself."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest

from storylens.llm import art, conversation_trie, queries

SCHEMA = "conv_id long, turn long, role string, text string, node string, parent string, key string, ends string"


def words(text):
    return len(text.encode().split())


def brute(rows):
    """rows: (conv_id, turn, role, text)."""
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            tie = hashlib.sha256(f"{len(r.encode())}:{r}{x}".encode()).hexdigest()[:32]
            own[c].append(((t is not None, t), tie, r, x))
    turns = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, v in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        built[c] = turns.get(base, [])[:h] + v[h:]
    members = defaultdict(list)
    for c, v in built.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    kids = defaultdict(list)
    for n in members:
        if n:
            kids[n[:-1]].append(n)
    leaves, saved = defaultdict(int), defaultdict(int)
    for n in sorted(members, key=len, reverse=True):
        leaves[n] += not kids[n]
        saved[n] += (len(members[n]) - 1) * words(n[-1][1]) if n else 0
        if n:
            leaves[n[:-1]] += leaves[n]
            saved[n[:-1]] += saved[n]
    out = []
    for n, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(built[c]) == len(n))))
        out.append((min(m), len(n), min(members[n[:-1]]) if n else None, len(m), len(kids[n]), leaves[n], saved[n],
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def got(spark, rows, **how):
    df = spark.createDataFrame([(*r, *["clash"] * 4) for r in rows], SCHEMA).repartition(3)
    nodes = conversation_trie.trie(conversation_trie.rebuilt(conversation_trie.turns(df)), **how)
    return sorted(map(tuple, nodes.drop("turn_id").collect()), key=str)


def many(seed, n=160):
    rng = random.Random(seed)
    said = ["hello there", "a b\tc", "", None, "ünï", "one word", "long " * 300]
    rows = []
    for c in rng.sample(range(-60, 300), n):
        rows += [(c, t if rng.random() < 0.9 else None, rng.choice(["user", "assistant", None]), rng.choice(said[:rng.randint(1, 7)]))
                 for t in range(rng.choice([1, 2, 2, 3, 5, 9]))]
    return rows


@pytest.mark.parametrize(("seed", "keys"), [(1, 1), (2, 5), (3, 50_000)])
def test_nodes_equal_brute_force(spark, seed, keys):
    """From a tree for each conversation to one for all."""
    rows = many(seed)
    assert got(spark, rows, keys=keys) == brute(rows)


def test_hot_first_turns_and_prefixes(spark):
    """A third of all conversations are equal, others are prefixes of them."""
    rows = [(c, t, "user", f"turn {t}") for c in range(300, 400) for t in range(6)]
    rows += [(c, t, "user", f"turn {t}") for c in range(400, 460) for t in range(1 + c % 5)]
    rows += [(c, t, "user", f"turn {t}" if t < 3 else f"own {c}") for c in range(460, 520) for t in range(5)]
    assert got(spark, rows, keys=1) == brute(rows)


def test_odd_tables(spark):
    assert got(spark, []) == []
    rows = [(None, 1, "user", "nobody"), (7, None, None, None), (7, 1, "a", "b"), (7, 1, "a", "b"), (7, 1, "b", "a")]
    assert got(spark, rows) == brute(rows)
    # a conversation of one turn whose base is missing is turnless if h is over 0
    alone = [(c, 0, "user", "x") for c in range(21, 40)]
    assert got(spark, alone) == brute(alone)
    long = [(5, t, "user", f"t{t % 7}") for t in range(5000)] + [(6, t, "user", f"t{t % 7}") for t in range(4000)]
    assert got(spark, long, keys=1) == brute(long)


def test_packed_ends(spark, monkeypatch):
    """The ids of a node in several packed texts give the same hash."""
    rows = [(c, 0, "u", "same") for c in range(-5000, 20_000, 20)] + [(1, 0, "u", "other")]
    own = conversation_trie.turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    for pack in (3, 4096):
        monkeypatch.setattr(conversation_trie, "PACK", pack)
        members = list(conversation_trie._packed(iter([_batch(own)])))
        assert sum(b.num_rows for b in members) >= (1250 // pack)
        (hashed,) = [x for b in conversation_trie._hashed(iter(members)) for x in b.to_pylist()]
        assert hashed["ends"] == hashlib.sha256(",".join(str(c) for c in range(-5000, 20_000, 20)).encode()).hexdigest()


def _batch(own):
    import pyarrow as pa

    ids = sorted(r["conv_id"] for r in own.select("conv_id").collect() if r["conv_id"] % 20 == 0)
    return pa.RecordBatch.from_arrays([pa.array(["n"] * len(ids)), pa.array(ids, pa.int64())], ["node", "conv_id"])


def test_radix_tree_holds_every_string_in_order():
    rng = random.Random(3)
    keys = {bytes(rng.choices(range(256) if rng.random() < 0.4 else b"\0\1\xff", k=rng.randint(0, 9))) for _ in range(4000)}
    keys |= {bytes([b]) + b"tail" for b in range(256)} | {b"deep" + bytes([b]) for b in range(0, 120, 4)}
    order = list(keys)
    rng.shuffle(order)
    root = art.built(order)
    found, layouts = [], set()
    stack = [(root, b"")]
    while stack:
        node, before = stack.pop()
        layouts.add(node.layout)
        kids = node.children()
        assert len(kids) <= node.layout and all(node.child(k.path[0]) is k for k in kids)
        assert node is root or node.value is not None or len(kids) > 1  # paths are compressed
        if node.value is not None:
            found.append(before + node.path)
            assert order[node.value] == found[-1]
        stack += [(k, before + node.path) for k in reversed(kids)]
    assert found == sorted(keys) and layouts == set(art.LAYOUTS)


def test_aligned_places_are_the_prefixes():
    rng = random.Random(4)
    keys = sorted({b"".join(rng.choices([b"\0\0\0\1", b"\0\0\0\2", b"\0\1\0\1", b"\1\0\0\1"], k=rng.randint(0, 5))) for _ in range(300)})
    places = list(art.aligned(art.built(keys), 4))
    want = sorted({k[:d] for k in keys for d in range(0, len(k) + 1, 4)})
    assert [keys[some][:4 * d] for d, _, some, _ in places] == want
    assert all(v is None or keys[v] == keys[s][:4 * d] for d, _, s, v in places)
    assert sum(v is not None for *_, v in places) == len(keys)
    assert all(p == -1 or want[p] == want[t][:-4] for t, (_, p, _, _) in enumerate(places))


def test_query_equals_its_twin(spark, sf_small):
    a = queries.QUERIES["op12_conversation_trie"](spark, sf_small).toPandas()
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{sf_small}/conversations.parquet'")
    b = con.sql(queries.ORACLE["op12_conversation_trie"]).df()
    key = sorted(a.columns)
    left, right = (x[key].fillna(-1).astype({"parent_conv_id": "int64"}).astype(str).values.tolist() for x in (a, b))
    assert sorted(left) == sorted(right)
