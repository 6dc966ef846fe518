"""Merkle manifest of a dataset, with upper proofs by a butterfly exchange.

Rows are leaves; each language is a tree of fan-out 8 over its leaves in
doc_id order, and the subroots of the languages, in their order, are the
leaves of one more tree. Leaves are numbered in one range-partitioned sort and
dealt to aligned blocks of 8^4, so each block is a subtree. Blocks then swap
subtree roots round by round: in round r, a block meets those that differ from
it in digit r (to the base 8) alone, hashes their common ancestor itself, and
keeps the other digests as its proof of that level. After log8(blocks) rounds
each block has the subroot and all of its upper proof; nothing is sent down.

A last subtree that is not full has fewer blocks than partners to serve: its
blocks serve them in turn (offset modulo its size). A block gets 8 digests a
round at most, whatever the corpus or the share of one language.

Null columns count as ``-``; a null language is a tree of its own, before all
others. Null doc_ids come first in their tree and have the crc32 of the empty
text. Rows of one language and doc_id follow by their leaf; repeated rows are
leaves of their own, with their own proofs. Empty texts are leaves of zero
bytes, long ones are read once. Other columns of the table are left behind.
An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storylens.llm.common import crc_sql, prepare, staged

FANOUT = 8
# A block is a subtree of so many levels.
BLOCK_LEVELS = 4
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def digest(*parts: str) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def leaf_of(*columns: Column) -> Column:
    """H of the columns: ``-`` for null, else UTF-8 byte count, colon, value."""

    def field(c: Column) -> Column:
        s = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))

    return F.sha2(F.concat(*[field(c) for c in columns]).cast("binary"), 256)


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``at``, the place of each in its ``tree`` by ``order``, and
    the tree's ``size``. Sorted by range and written with their partition and
    place; all that is derived reads the written rows."""
    place = F.monotonically_increasing_id()
    tied = rows.withColumn("tie", place)  # repeated rows are spread too
    tagged = staged(tied.orderBy("tree", *order, "tie").drop("tie").select(
        "*", F.spark_partition_id().alias("pid"), place.bitwiseAND(F.lit((1 << 33) - 1)).alias("row")), "leaves")
    # a row for each partition, and one more for each tree that starts inside one
    runs = tagged.groupBy("tree", "pid").agg(F.count("*").alias("n"), F.min("row").alias("from"))
    all_parts = Window.partitionBy("tree")
    before = all_parts.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("tree", "pid", "from", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"),
                       F.sum("n").over(all_parts).alias("size"))
    return tagged.join(runs, ["tree", "pid"]).withColumn(
        "at", F.col("before") + F.col("row") - F.col("from")).drop("pid", "row", "from", "before")


def levels(size: int) -> int:
    n = 0
    while size > 1:
        size, n = -(-size // FANOUT), n + 1
    return n


def subtree(leaves: list[str], height: int) -> list[list[str]]:
    """Digests of each level, from the leaves up to the one at ``height``."""
    found = [leaves]
    for _ in range(height):
        low = found[-1]
        found.append([digest(*low[i:i + FANOUT]) for i in range(0, len(low), FANOUT)])
    return found


def fold(own: str, at: int, size: int, siblings: list[str]) -> str:
    """The root that a node and its siblings, level by level, lead to."""
    used = 0
    while size > 1:
        first = at // FANOUT * FANOUT
        many = min(FANOUT, size - first) - 1
        run = siblings[used:used + many]
        own = digest(*run[:at - first], own, *run[at - first:])
        used, at, size = used + many, at // FANOUT, -(-size // FANOUT)
    return own


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each block, of its leaves."""
    for b in batches:
        sizes, leaves = b.column("size").to_pylist(), b.column("leaves").to_pylist()
        got = [subtree([x["leaf"] for x in own], min(BLOCK_LEVELS, levels(n)))[-1][0]
               for n, own in zip(sizes, leaves, strict=True)]
        yield pa.RecordBatch.from_arrays([b.column("tree"), b.column("block"), b.column("size"), pa.array(got, pa.string())],
                                         ["tree", "block", "size", "digest"])


def butterfly(blocks: DataFrame) -> DataFrame:
    """``tree, block, proof, root`` from each block's own ``digest``: ``proof``
    has the siblings of all levels over the block."""
    size = F.ceil(F.col("size") / F.lit(FANOUT**BLOCK_LEVELS)).cast("long")
    state = staged(blocks.select("tree", "block", size.alias("blocks"), "digest",
                                 F.array().cast("array<string>").alias("proof")), "round")
    most, group = state.agg(F.max("blocks")).first()[0] or 0, 1
    while group < most:
        of = F.floor(F.col("block") / F.lit(group)).cast("long")
        first = (of - of % FANOUT) * group  # the run of subtrees that meet
        offset = F.col("block") % group
        served = F.least(F.lit(group).cast("long"), F.col("blocks") - of * group)
        offsets = F.sequence(offset, F.lit(group - 1).cast("long"), served)
        sent = state.where(F.col("blocks") > group).select(
            "tree", "block", "blocks", "digest", "proof", (of % FANOUT).alias("slot"), first.alias("first"),
            F.explode(offsets).alias("offset")).select(
            "*", F.explode(F.sequence(F.lit(0), F.lit(FANOUT - 1))).alias("to"))
        to = F.col("first") + F.col("to") * group + F.col("offset")
        sent = sent.withColumn("receiver", to).where("receiver < blocks")
        own = F.col("receiver") == F.col("block")
        met = sent.groupBy("tree", "receiver").agg(
            F.array_sort(F.collect_list(F.struct("slot", "digest"))).alias("run"),
            F.max("blocks").alias("blocks"), F.max(F.when(own, F.col("proof"))).alias("proof"),
            F.max(F.when(own, F.col("slot"))).alias("slot"))
        others = F.transform(F.filter("run", lambda x: x["slot"] != F.col("slot")), lambda x: x["digest"])
        up = F.sha2(F.array_join(F.transform("run", lambda x: x["digest"]), "").cast("binary"), 256)
        met = met.select("tree", F.col("receiver").alias("block"), "blocks", up.alias("digest"),
                         F.concat("proof", others).alias("proof"))
        state = staged(met.union(state.where(F.col("blocks") <= group)), "round")
        group *= FANOUT
    return state.select("tree", "block", "proof", F.col("digest").alias("root"))


def climbed(nodes: DataFrame, columns: list[str]) -> DataFrame:
    """One row for each block of nodes (``tree, at, size, leaf`` and
    ``columns``): ``leaves`` in order, ``proof`` over the block, and the tree's
    ``root``."""
    width = FANOUT**BLOCK_LEVELS
    dealt = nodes.withColumn("block", F.floor(F.col("at") / F.lit(width)).cast("long"))
    # a block has 8^4 leaves at most
    blocks = staged(dealt.groupBy("tree", "block", "size").agg(
        F.array_sort(F.collect_list(F.struct("at", "leaf", *columns))).alias("leaves")), "blocks")
    digests = blocks.select("tree", "block", "size", "leaves").mapInArrow(
        _roots, "tree string, block long, size long, digest string")
    return blocks.join(butterfly(digests), ["tree", "block"])


def _siblings(low: list[list[str]], i: int) -> list[str]:
    """The others of each run on the way up inside a block."""
    found = []
    for level in low[:-1]:
        first = i // FANOUT * FANOUT
        found += level[first:i] + level[i + 1:first + FANOUT]
        i //= FANOUT
    return found


def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each node of the top tree with its siblings."""
    for b in batches:
        out: list[tuple] = []
        for n, leaves, proof, root in zip(*(b.column(c).to_pylist() for c in ("size", "leaves", "proof", "root")), strict=True):
            low = subtree([x["leaf"] for x in leaves], min(BLOCK_LEVELS, levels(n)))
            out += [(x["name"], x["leaf"], x["at"], n, _siblings(low, i) + proof, root) for i, x in enumerate(leaves)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
            list(zip(*out, strict=True)) or [[]] * 6,
            (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.string()), strict=True)],
            ["tree", "subroot", "top_at", "top_size", "top_proof", "top_root"])


PROOF = ("doc_id long, tree string, at long, size long, leaf string, subroot string, root string, proof_sha256 string, "
         "folded_root string, verified boolean, siblings array<string>")


def _proofs(with_siblings: bool):
    types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 5, pa.bool_(), pa.list_(pa.string()))
    names = [x.split()[0] for x in PROOF.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.to_pylist():
                low = subtree([x["leaf"] for x in b["leaves"]], min(BLOCK_LEVELS, levels(b["size"])))
                out: list[tuple] = []
                for i, x in enumerate(b["leaves"]):
                    to_subroot = _siblings(low, i) + b["proof"]
                    up = fold(x["seen"], x["at"], b["size"], to_subroot)
                    folded = fold(up, b["top_at"], b["top_size"], b["top_proof"])
                    siblings = to_subroot + b["top_proof"]
                    out.append((x["doc_id"], b["tree"], x["at"], b["size"], x["leaf"], b["subroot"], b["top_root"],
                                digest(*siblings), folded, folded == b["top_root"], siblings if with_siblings else None))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)],
                                                 names)

    return run


def proofs(leaves: DataFrame, with_siblings: bool = True) -> DataFrame:
    """Proof of each row of ``leaves`` (``tree, doc_id, leaf``, and ``seen``, the
    leaf that is to be verified): columns of ``PROOF``."""
    prepare(leaves.sparkSession)
    nodes = numbered(leaves.select("tree", "doc_id", "leaf", "seen"), ["doc_id", "leaf", "seen"])
    blocks = staged(climbed(nodes, ["doc_id", "seen"]), "climbed")
    roots = blocks.where("block = 0").select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("root").alias("leaf"))
    top = climbed(numbered(roots, ["name"]), ["name"]).mapInArrow(
        _subtrees, "tree string, subroot string, top_at long, top_size long, top_proof array<string>, top_root string")
    each = blocks.join(staged(top, "top"), "tree").select(
        "tree", "size", "leaves", "proof", "subroot", "top_at", "top_size", "top_proof", "top_root")
    return each.mapInArrow(_proofs(with_siblings), PROOF)


def leaves(docs: DataFrame, seen_text: Column | None = None) -> DataFrame:
    """Leaves of ``documents`` rows by language; ``seen`` is the leaf with
    ``seen_text`` in place of the text."""
    own = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    # after all other languages' texts stands nothing below "-"
    tree = F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("-"))
    leaf = leaf_of(*own, F.col("text"))
    seen = leaf if seen_text is None else leaf_of(*own, seen_text)
    return docs.select(tree.alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), leaf.alias("leaf"),
                       seen.alias("seen"))


def lowered(text: Column) -> Column:
    return F.translate(text, _UPPER, _UPPER.lower())


_CRC = crc_sql("doc_id")


def _field(c: str) -> str:
    return f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"


_OWN = " || ".join(map(_field, ("doc_id", "source", "lang", "n_chars")))
_LOW = f"translate(text, '{_UPPER}', '{_UPPER.lower()}')"
ORACLE = f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce('=' || lang, '-') AS tree, sha256({_OWN} || {_field('text')}) AS leaf,
       sha256({_OWN} || {_field(f"CASE WHEN {_CRC} % 3 = 0 THEN {_LOW} ELSE text END")}) AS seen FROM documents),
f AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id, leaf) - 1 AS pos,
             count(*) OVER (PARTITION BY tree) AS size FROM d),
t AS (SELECT tree, 0 AS lvl, pos, size, leaf AS h FROM f
      UNION ALL SELECT tree, lvl + 1, pos // 8, (size + 7) // 8, sha256(string_agg(h, '' ORDER BY pos)) FROM t
      WHERE size > 1 GROUP BY tree, lvl, pos // 8, size),
sub AS (SELECT tree, h AS subroot, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS size
        FROM t WHERE size = 1),
u AS (SELECT 0 AS lvl, pos, size, subroot AS h FROM sub
      UNION ALL SELECT lvl + 1, pos // 8, (size + 7) // 8, sha256(string_agg(h, '' ORDER BY pos)) FROM u
      WHERE size > 1 GROUP BY lvl, pos // 8, size),
root AS (SELECT h AS root FROM u WHERE size = 1),
sides AS (SELECT *, coalesce(string_agg(h, '') OVER (PARTITION BY tree, lvl, pos // 8 ORDER BY pos
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
                 coalesce(string_agg(h, '') OVER (PARTITION BY tree, lvl, pos // 8 ORDER BY pos
                    ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM t WHERE size > 1),
top AS (SELECT *, coalesce(string_agg(h, '') OVER (PARTITION BY lvl, pos // 8 ORDER BY pos
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
                 coalesce(string_agg(h, '') OVER (PARTITION BY lvl, pos // 8 ORDER BY pos
                    ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM u WHERE size > 1),
walk AS (SELECT f.tree, f.pos AS own, f.seen AS h, '' AS proof, 0 AS lvl, f.pos, f.size FROM f
         UNION ALL SELECT w.tree, w.own, sha256(s.l || w.h || s.r), w.proof || s.l || s.r, w.lvl + 1, w.pos // 8,
                          (w.size + 7) // 8
         FROM walk AS w JOIN sides AS s ON s.tree = w.tree AND s.lvl = w.lvl AND s.pos = w.pos),
up AS (SELECT w.tree, w.own, w.h, w.proof, 0 AS lvl, sub.pos, sub.size FROM walk AS w JOIN sub USING (tree) WHERE w.size = 1
       UNION ALL SELECT w.tree, w.own, sha256(s.l || w.h || s.r), w.proof || s.l || s.r, w.lvl + 1, w.pos // 8,
                        (w.size + 7) // 8
       FROM up AS w JOIN top AS s ON s.lvl = w.lvl AND s.pos = w.pos)
SELECT f.doc_id, f.leaf, sub.subroot, root.root, sha256(up.proof) AS proof_sha256, up.h AS folded_root,
       up.h = root.root AS verified
FROM f JOIN sub USING (tree) CROSS JOIN root JOIN up ON up.tree = f.tree AND up.own = f.pos AND up.size = 1"""
