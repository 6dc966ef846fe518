"""Prefix trie of conversations by adaptive radix trees.

A turn (role, text) has a fixed-width big-endian id: the first 128 bits of a
SHA-256 (among n different turns two share an id with probability n^2 / 2^129),
so no dictionary is joined and a turn that a third of all conversations begin
with is no hot key. A conversation is the string of its ids. Equal strings are
pre-aggregated to one row; distinct ones are sorted by range into partitions,
and each partition builds an adaptive radix tree, of which turn-aligned byte
depths alone are nodes.

Nodes inside a partition are complete there. Those on the paths of its first
and last string may go on in its neighbours: it knows from the neighbours'
border strings how many, and hands on additive parts of them (members, children
and childless nodes that begin here, tokens), which are summed by node: a row
for each partition and shared node, the root included.

The ids that end in one node are hashed in order. They are packed to texts of
``PACK`` ids where a range sort puts them; the texts of one node, that much
fewer, pass through one task as a stream.

A conversation is one value, of 16 bytes a turn, like a document's text.
Rows without conv_id belong to no conversation and are left out. Null turns
come first; rows with equal turns follow by their ids; repeated rows are turns
of their own. Null roles and texts are empty ones. An empty table has no nodes.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storylens.llm import art
from storylens.llm.common import prepare, shuffle_width, staged

# Bytes of a turn's id.
WIDTH = 16
# Distinct conversations of one tree, about.
KEYS = 50_000
# Ids of one packed text.
PACK = 4096
NOBODY = sha256(b"").hexdigest()


def turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, turns``: ``id, words`` of each turn of a conversation in order."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    each = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.substring(F.sha2(whole.cast("binary"), 256), 1, 2 * WIDTH).alias("id"),
        F.size(F.array_remove(F.split(text, "[\\x20\\x09-\\x0D]+"), "")).cast("long").alias("words"))
    in_order = F.sort_array(F.collect_list(F.struct("turn", "id", "words")))
    return each.groupBy("conv_id").agg(
        F.transform(in_order, lambda x: F.struct(x["id"].alias("id"), x["words"].alias("words"))).alias("turns"))


def rebuilt(own: DataFrame, group: int = 20, most: int = 4) -> DataFrame:
    """Conversations whose first h turns (crc32 of the id modulo ``most``) are
    those of the first conversation of their group of ``group`` ids."""
    first = own.where(F.col("conv_id") % group == 0).select(
        F.col("conv_id").alias("base"), F.slice("turns", 1, most - 1).alias("head"))
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(most)).cast("int")
    with_base = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % group).withColumn("h", h).join(first, "base", "left")
    none = F.array().cast(own.schema["turns"].dataType)
    head = F.slice(F.coalesce("head", none), F.lit(1), F.col("h"))
    rest = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1)))
    return with_base.select("conv_id", F.concat(head, rest).alias("turns"))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted ``node, conv_id`` to texts of at most ``PACK`` ids of one node."""
    node, ids = None, []

    def text():
        return node, ids[0], ",".join(map(str, ids))

    for b in batches:
        out = []
        for to, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if ids and (to != node or len(ids) == PACK):
                out.append(text())
                ids = []
            node = to
            ids.append(c)
        yield _texts(out)
    if ids:
        yield _texts([text()])


def _texts(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in
                                       enumerate((pa.string(), pa.int64(), pa.string()))], ["node", "first", "ids"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted texts to the hash of each node's, joined by commas, as a stream."""
    node, state = None, None
    for b in batches:
        out = []
        for to, ids in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
            if state is not None and to == node:
                state.update(b",")
            else:
                if state is not None:
                    out.append((node, state.hexdigest()))
                node, state = to, sha256()
            state.update(ids.encode())
        yield _ends(out)
    if state is not None:
        yield _ends([(node, state.hexdigest())])


def _ends(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.string()) for i in (0, 1)], ["node", "ends"])


def ends(members: DataFrame) -> DataFrame:
    """``node, ends``: the hash of each node's conv_ids, ascending."""
    width = shuffle_width(members.sparkSession)
    packed = members.repartitionByRange(width, "node", "conv_id").sortWithinPartitions("node", "conv_id").mapInArrow(
        _packed, "node string, first long, ids string")
    return packed.repartition(width, "node").sortWithinPartitions("node", "first").mapInArrow(
        _hashed, "node string, ends string")


NODES = ("shared boolean, node binary, parent binary, conv_id long, depth long, parent_conv_id long, n_convs long, "
         "n_children long, n_leaves long, saved_tokens long, ends string, turn_id binary")
_TYPES = (pa.bool_(), pa.binary(), pa.binary(), *[pa.int64()] * 7, pa.string(), pa.binary())


def partial_trie(keys: list[bytes], words: list[list[int]], n: list[int], first: list[int], end: list[str],
                 before: bytes | None, after: bytes | None) -> list[tuple]:
    """Rows of ``NODES`` for sorted distinct strings between two neighbours'
    border strings (None: there is no neighbour)."""
    low = -1 if before is None else art.common(before, keys[0]) // WIDTH
    high = -1 if after is None else art.common(after, keys[-1]) // WIDTH
    places = list(art.aligned(art.built(keys), WIDTH))
    size = len(places)
    convs, least, kids, leaves, saved = [0] * size, [None] * size, [0] * size, [0] * size, [0] * size
    last = next(t for t in range(size - 1, -1, -1) if places[t][3] is not None)
    shared = [False] * size  # with a neighbour
    for t in range(min(low + 1, size)):  # the first string's path comes first
        shared[t] = True
    up = last
    while up >= 0:
        shared[up] = shared[up] or places[up][0] <= high
        up = places[up][1]
    for t in range(size - 1, -1, -1):
        depth, parent, some, value = places[t]
        if value is not None:
            convs[t] += n[value]
            least[t] = first[value] if least[t] is None else min(least[t], first[value])
            if not kids[t] and not (t == last and high >= depth):
                leaves[t] += 1
        begins = t > low
        if depth:
            saved[t] += (convs[t] - begins) * words[some][depth - 1]
        if parent >= 0:
            convs[parent] += convs[t]
            least[parent] = least[t] if least[parent] is None else min(least[parent], least[t])
            kids[parent] += begins
            leaves[parent] += leaves[t]
            saved[parent] += saved[t]
    rows, ids = [], {}
    for t, (depth, parent, some, value) in enumerate(places):
        turn = keys[some][(depth - 1) * WIDTH:depth * WIDTH] if depth else None
        if shared[t]:  # ancestors of a shared node are shared
            ids[t] = sha256(ids[parent] + turn).digest()[:WIDTH] if depth else b""
        over = ids.get(parent)
        rows.append((shared[t], ids.get(t), over, least[t], depth,
                     least[parent] if parent >= 0 and over is None else None, convs[t], kids[t], leaves[t], saved[t],
                     None if value is None else end[value], turn))
    return rows


def _trie(keys: pa.Table, bounds: pa.Table) -> pa.Table:
    if not keys.num_rows:
        return pa.Table.from_arrays([pa.array([], t) for t in _TYPES], [x.split()[0] for x in NODES.split(", ")])
    keys = keys.sort_by("key")
    got = partial_trie(*(keys.column(c).to_pylist() for c in ("key", "words", "n", "first", "ends")),
                       bounds.column("before")[0].as_py(), bounds.column("after")[0].as_py())
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*got, strict=True), _TYPES, strict=True)],
                                [x.split()[0] for x in NODES.split(", ")])


def _string(ids: Column) -> Column:
    return F.unhex(F.array_join(F.transform(ids, lambda x: x["id"]), ""))


def trie(conversations: DataFrame, keys: int = KEYS) -> DataFrame:
    """Nodes of the trie of ``conv_id, turns``: ``conv_id`` (smallest member),
    ``depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256``, and ``turn_id`` of the last turn."""
    spark = conversations.sparkSession
    prepare(spark)
    string = _string(F.col("turns"))
    members = staged(conversations.select("conv_id", string.alias("key"), F.sha2(string, 256).alias("node"), F.transform(
        "turns", lambda x: x["words"]).alias("words")), "members")
    distinct = members.groupBy("node").agg(F.first("key").alias("key"), F.first("words").alias("words"),
                                           F.count("*").alias("n"), F.min("conv_id").alias("first"))
    distinct = staged(distinct.join(ends(members.select("node", "conv_id")), "node").drop("node"), "strings")
    parts = max(shuffle_width(spark), -(-distinct.count() // keys))
    dealt = staged(distinct.repartitionByRange(parts, "key").withColumn("pid", F.spark_partition_id()), "dealt")
    # a row for each partition
    w = Window.orderBy("pid")
    bounds = dealt.groupBy("pid").agg(F.min("key").alias("least"), F.max("key").alias("most")).select(
        "pid", F.lag("most").over(w).alias("before"), F.lead("least").over(w).alias("after"))
    rows = staged(dealt.groupBy("pid").cogroup(bounds.groupBy("pid")).applyInArrow(_trie, NODES), "nodes")
    shared = staged(rows.where("shared").groupBy("node").agg(
        F.max("parent").alias("parent"), F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"),
        F.lit(None).cast("long").alias("parent_conv_id"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
        F.max("ends").alias("ends"), F.max("turn_id").alias("turn_id")), "shared")
    columns = [c for c in shared.columns if c != "node"]
    nodes = rows.where("not shared").select(*columns).union(shared.select(*columns))
    over = shared.select(F.col("node").alias("parent"), F.col("conv_id").alias("shared_conv_id"))
    below = nodes.where("parent is not null").join(over, "parent").withColumn("parent_conv_id", F.col("shared_conv_id"))
    return nodes.where("parent is null").select(*columns).union(below.select(*columns)).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends", F.lit(NOBODY)).alias("ends_sha256"), "turn_id")


def oracle(crc: str) -> str:
    """DuckDB twin of the trie of rebuilt conversations; ``crc``: SQL for the
    unsigned crc32 of ``conv_id`` as text."""
    return f"""
WITH t AS (SELECT conv_id, turn, text, substr(sha256(strlen(role) || ':' || role || text), 1, 32) AS id
           FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations)
           WHERE conv_id IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, id) AS k FROM t),
c AS (SELECT conv_id, {crc} % 4 AS h FROM (SELECT DISTINCT conv_id FROM t)),
b AS (SELECT c.conv_id, h, count(o.k) AS taken FROM c LEFT JOIN o ON o.conv_id = c.conv_id - c.conv_id % 20 AND o.k <= h
      GROUP BY c.conv_id, h),
r AS (SELECT b.conv_id, o.k AS d, o.id, o.text FROM b JOIN o ON o.conv_id = b.conv_id - b.conv_id % 20 AND o.k <= b.h
      UNION ALL SELECT b.conv_id, o.k - b.h + b.taken, o.id, o.text FROM b JOIN o ON o.conv_id = b.conv_id AND o.k > b.h),
p AS (SELECT conv_id, d, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS w,
             string_agg(id, '') OVER (PARTITION BY conv_id ORDER BY d) AS path FROM r
      UNION ALL SELECT conv_id, 0, 0, '' FROM c),
n AS (SELECT path, d, min(conv_id) AS conv_id, count(*) AS n_convs, min(w) AS w FROM p GROUP BY path, d),
e AS (SELECT path, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends
      FROM (SELECT conv_id, max_by(path, d) AS path FROM p GROUP BY conv_id) GROUP BY path),
k AS (SELECT left(path, 32 * (d - 1)::INT) AS path, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1),
m AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (path)),
s AS (SELECT left(path, 32 * up::INT) AS path, sum((n_convs - 1) * w)::BIGINT AS saved_tokens,
             count(*) FILTER (n_children = 0) AS n_leaves
      FROM (SELECT *, unnest(range(0, d + 1)) AS up FROM m) GROUP BY 1)
SELECT m.conv_id, m.d::BIGINT AS depth, a.conv_id AS parent_conv_id, m.n_convs, m.n_children, s.n_leaves, s.saved_tokens,
       coalesce(e.ends, sha256('')) AS ends_sha256
FROM m JOIN s USING (path) LEFT JOIN e USING (path) LEFT JOIN n AS a ON m.d > 0 AND a.path = left(m.path, 32 * (m.d - 1)::INT)"""
