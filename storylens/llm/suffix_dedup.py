"""Suffix-array dedup: remove every byte covered by a string of ``LENGTH``
bytes that also starts in a document with a smaller doc_id.

1. Documents are packed into chunks of some megabytes, compressed and written.
2. Each string of LENGTH bytes has one anchor: the leftmost of its
   ``GRAM``-byte substrings with the smallest hash. Equal strings have equal
   anchors at equal places, and consecutive strings mostly share theirs. Each
   chunk sends 32 bits for each of its distinct anchors to the bucket of the
   anchor's hash; back comes a bit: does another document have it too.
3. For anchors that do, the chunk sends the distinct stretches that its strings
   of that anchor cover, with their smallest doc_id. Equal stretches meet as
   one entry for each chunk, so a passage that a third of all documents share
   is a row for each chunk, not for each document. An anchor with over ``HOT``
   stretches (a common phrase with other text around it each time) would fill
   one bucket: its strings are sent one by one, to the buckets of their own
   hashes, where equal ones meet.
4. A bucket sorts the suffixes of its stretches by deep-shallow sorting:
   multikey quicksort by characters of 8 bytes, all open groups parted at
   once, to ``SHALLOW`` bytes, then blind tries put the remaining groups in
   order. Neighbours that agree on LENGTH
   bytes are one string; its smallest doc_id goes back to the chunks.
5. Each chunk marks and cuts its documents.

Strings are judged on the input, overlaps count, and no match crosses
documents. Null texts are empty ones. A null doc_id counts as smaller than any
other; rows with equal doc_ids do not cut one another. Each input row, repeated
ones too, gives one result row.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storylens.llm.common import prepare, shuffle_width, staged

LENGTH = 50
GRAM = 20
SHALLOW = 16
# Bytes of texts in a chunk, and of all texts to a bucket.
CHUNK = 4 << 20
BUCKET = 8 << 20
# Stretches of one anchor (distinct ones of each chunk) that may meet in a
# bucket; this bit of a place marks a string of an anchor with more.
HOT = 1 << 15
ALONE = 128
# Positions hashed at a time; their number fits the low bits of a key.
_LOW = 23
BLOCK = 1 << 20
LEVEL = 6
NULL_ID = -(2**63)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x5851F42D4C957F2D


# --- arrays as compressed bytes ------------------------------------------------

def pack(*arrays: np.ndarray) -> bytes:
    head = np.array([len(arrays), *[len(a) for a in arrays]], "<i8").tobytes()
    raw = head + b"".join(a.dtype.str.encode().ljust(4) for a in arrays) + b"".join(a.tobytes() for a in arrays)
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", compression_level=LEVEL).compress(raw, asbytes=True)


def unpack(data: bytes) -> list[np.ndarray]:
    raw = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    sizes = np.frombuffer(raw, "<i8", n, 8)
    at, out = 8 + 12 * n, []
    for k, size in enumerate(sizes.tolist()):
        kind = np.dtype(raw[8 + 8 * n + 4 * k:12 + 8 * n + 4 * k].decode().strip())
        out.append(np.frombuffer(raw, kind, size, at))
        at += size * kind.itemsize
    return out


# --- anchors -------------------------------------------------------------------

def _rolled(x: np.ndarray, gram: int) -> np.ndarray:
    """Hash of the ``gram`` bytes from each position: polynomials of 1, 2, 4,
    ... bytes are doubled and joined to the length."""
    size, power, have = 1, _BASE, (x.astype(np.uint64) + np.uint64(1)) * _MIX
    out, out_size = None, 0
    while True:
        if gram & size:
            if out is None:
                out, out_size = have, size
            else:
                n = len(have) - out_size
                out = out[:n] * np.uint64(power) + have[out_size:]
                out_size += size
        if size * 2 > gram:
            break
        have = have[:-size] * np.uint64(power) + have[size:]
        power, size = power * power % 2**64, size * 2
    out ^= out >> np.uint64(31)
    out *= _MIX
    out ^= out >> np.uint64(29)
    return out


def anchors(x: np.ndarray, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Runs of consecutive strings with one anchor: first start, number of
    starts, anchor's place, anchor's hash. ``ends``: ends of documents in x."""
    span = length - gram + 1
    firsts, counts, places, hashes = [], [], [], []
    starts_of = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    valid = np.zeros(len(x) + 1, np.int8)
    long = ends - starts_of >= length
    np.add.at(valid, starts_of[long], 1)
    np.add.at(valid, ends[long] - length + 1, -1)
    valid = np.cumsum(valid[:-1], dtype=np.int8).astype(bool)
    for at in range(0, max(0, len(x) - length + 1), BLOCK):
        part = x[at:at + BLOCK + length - 1]
        h = _rolled(part, gram)
        key = h >> np.uint64(_LOW) << np.uint64(_LOW) | np.arange(len(h), dtype=np.uint64)
        least, size = key, 1
        while size * 2 <= span:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        if size < span:
            least = np.minimum(least[:len(least) - span + size], least[span - size:])
        ok = np.flatnonzero(valid[at:at + len(least)])
        place = (least[ok] & np.uint64((1 << _LOW) - 1)).astype(np.int64)
        new = np.ones(len(ok), bool)
        new[1:] = (place[1:] != place[:-1]) | (np.diff(ok) != 1)
        run = np.flatnonzero(new)
        firsts.append(ok[run] + at)
        counts.append(np.diff(np.append(run, len(ok))))
        places.append(place[run] + at)
        hashes.append(h[place[run]])
    if not firsts:
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.uint64)
    g = np.concatenate(hashes) * np.uint64(0xD6E8FEB86659FD93)
    return np.concatenate(firsts), np.concatenate(counts), np.concatenate(places), g ^ g >> np.uint64(32)


def _bucket(h: np.ndarray, n: int) -> np.ndarray:
    return (h >> np.uint64(32)).astype(np.int64) % n


class Chunk:
    """A chunk's bytes, documents and anchor runs."""

    def __init__(self, row, buckets: int):
        self.ids, self.ends, self.x = unpack(row)
        self.first, self.count, self.place, self.hash = anchors(self.x, self.ends)
        self.doc = np.searchsorted(self.ends, self.first, "right")
        self.bucket = _bucket(self.hash, buckets)
        key = self.hash & np.uint64(0xFFFFFFFF)
        # distinct (bucket, 32 bits of the hash), in that order
        both = self.bucket.astype(np.uint64) << np.uint64(32) | key
        self.keys, self.key_of = np.unique(both, return_inverse=True)

    def several(self) -> np.ndarray:
        """Keys that more than one document id of the chunk has."""
        d = self.ids[self.doc]
        low = np.full(len(self.keys), np.iinfo(np.int64).max)
        high = np.full(len(self.keys), NULL_ID)
        np.minimum.at(low, self.key_of, d)
        np.maximum.at(high, self.key_of, d)
        return low != high

    def stretches(self) -> np.ndarray:
        """Distinct stretches of each key, told apart by 64 bits."""
        padded = np.lib.stride_tricks.sliding_window_view(np.concatenate([self.x, np.zeros(8, np.uint8)]), 8)
        h = self.count.astype(np.uint64)
        for start in (self.first, self.first + self.count - 1):
            for at in [*range(0, LENGTH - 8, 8), LENGTH - 8]:
                word = np.ascontiguousarray(padded[start + at]).view("<u8").ravel()
                h = (h ^ word) * _MIX
                h ^= h >> np.uint64(29)
        return np.bincount(self.key_of[np.unique(h, return_index=True)[1]], minlength=len(self.keys))

    def slices(self, buckets: int) -> Iterator[tuple[int, slice]]:
        cuts = np.searchsorted(self.keys, np.arange(buckets + 1, dtype=np.uint64) << np.uint64(32))
        for k in range(buckets):
            if cuts[k] < cuts[k + 1]:
                yield k, slice(cuts[k], cuts[k + 1])


# --- 1, 2: chunks and their anchors ---------------------------------------------

def _pack_chunks(chunk_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        ids, raw, rest, size = [], [], [], 0
        schema = None

        def flush():
            ends = np.cumsum([len(r) for r in raw], dtype=np.int64)
            data = pack(np.array(ids, np.int64), ends, np.frombuffer(b"".join(raw), np.uint8))
            return pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int64()), pa.array([int(ends[-1])], pa.int64()), pa.array([data], pa.binary()),
                 pa.array([rest], pa.list_(schema))], ["chunk", "size", "data", "rest"])

        for b in batches:
            schema = b.schema.field(2).type
            for d, t, r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                ids.append(NULL_ID if d is None else d)
                raw.append((t or "").encode())
                rest.append(r)
                size += len(raw[-1])
                if size >= chunk_bytes:
                    yield flush()
                    ids, raw, rest, size = [], [], [], 0
                    number += 1
        if ids:
            yield flush()

    return run


def _send_anchors(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for number, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                c = Chunk(data, buckets)
                several, n = c.several(), c.stretches().astype("<u4")
                rows = []
                for k, s in c.slices(buckets):
                    low = (c.keys[s] & np.uint64(0xFFFFFFFF)).astype(np.int64)
                    rows.append((k, pack(np.diff(low, prepend=0).astype("<u4"), np.packbits(several[s]), n[s])))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k for k, _ in rows], pa.int32()), pa.array([number] * len(rows), pa.int64()),
                     pa.array([p for _, p in rows], pa.binary())], ["bucket", "chunk", "data"])

    return run


def _shared_anchors(hot: int):
    """Of each chunk's anchors in a bucket: a bit for those that documents of
    several chunks, or several of one chunk, have; one for those with more than
    ``hot`` stretches."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        keys, several, stretches = [], [], []
        for data in rows["data"]:
            d, s, n = unpack(data)
            keys.append(np.cumsum(d.astype(np.int64)))
            several.append(np.unpackbits(s, count=len(d)))
            stretches.append(n)
        u, at, n = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
        shared = n > 1
        shared[at[np.concatenate(several) > 0]] = True
        many = np.bincount(at, np.concatenate(stretches), len(u)) > hot
        cuts = np.cumsum([len(k) for k in keys])[:-1]
        bits = zip(np.split(shared[at], cuts), np.split(many[at], cuts), strict=True)
        return pd.DataFrame({"chunk": rows["chunk"], "bucket": rows["bucket"],
                             "data": [pack(np.packbits(x), np.packbits(y)) for x, y in bits]})

    return run


# --- 3: stretches of shared anchors ----------------------------------------------

def _send_stretches(buckets: int):
    def run(key, chunk: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        out = []
        for data in chunk["data"]:
            c = Chunk(data, buckets)
            shared, hot = np.zeros(len(c.keys), bool), np.zeros(len(c.keys), bool)
            by_bucket = dict(zip(replies["bucket"], replies["data"], strict=True))
            for k, s in c.slices(buckets):
                shared[s], hot[s] = (np.unpackbits(x, count=s.stop - s.start) for x in unpack(by_bucket[k]))
            runs = np.flatnonzero(shared[c.key_of])
            raw = c.x.tobytes()
            members: dict[int, tuple[dict, list, list, list]] = {}

            def add(k: int, entry: tuple[int, bytes], first: int, doc: int) -> None:
                if k not in members:
                    members[k] = ({}, [], [], [])
                entries, least, own, firsts = members[k]
                e = entries.get(entry)
                if e is None:
                    e = entries[entry] = len(least)
                    least.append(doc)
                elif doc < least[e]:
                    least[e] = doc
                own.append(e)
                firsts.append(first)

            for first, n, place, doc, k, many in zip(
                    c.first[runs].tolist(), c.count[runs].tolist(), c.place[runs].tolist(),
                    c.ids[c.doc[runs]].tolist(), c.bucket[runs].tolist(), hot[c.key_of[runs]].tolist(), strict=True):
                if many:
                    for at in range(first, first + n):
                        string = raw[at:at + LENGTH]
                        add(zlib.crc32(string) % buckets, (place - at | ALONE, string), at, doc)
                else:
                    add(k, (place - first, raw[first:first + n + LENGTH - 1]), first, doc)
            for k, (entries, least, own, firsts) in members.items():
                sizes = np.array([len(s) for _, s in entries], np.uint8)
                out.append((k, key[0], pack(np.array([p for p, _ in entries], np.uint8), sizes, np.array(least, "<i8"),
                                            np.frombuffer(b"".join(s for _, s in entries), np.uint8)),
                            pack(np.array(own, "<u4"), np.array(firsts, "<i8"))))
        return pd.DataFrame(out, columns=["bucket", "chunk", "data", "members"])

    return run


# --- 4: deep-shallow suffix sorting -----------------------------------------------

class BlindTrie:
    """Suffixes of one group in order: inner nodes know the byte where their
    suffixes part, leaves one suffix and what equals it."""

    __slots__ = ("root", "width")

    def __init__(self, width: int):
        self.root, self.width = None, width

    def insert(self, suffix: bytes, item: int) -> None:
        if self.root is None:
            self.root = (suffix, [item])
            return
        node, path = self.root, []
        while type(node[0]) is int:  # blind descent: only branching bytes are looked at
            path.append(node)
            kids = node[1]
            node = kids.get(suffix[node[0]]) or next(iter(kids.values()))
        if node[0] == suffix:
            node[1].append(item)
            return
        differ = int.from_bytes(node[0]) ^ int.from_bytes(suffix)
        at = self.width - (differ.bit_length() + 7) // 8
        old = node[0][at]
        keep = len(path)
        while keep and path[keep - 1][0] >= at:
            keep -= 1
        leaf = (suffix, [item])
        if keep < len(path) and path[keep][0] == at:
            path[keep][1][suffix[at]] = leaf
            return
        below = path[keep] if keep < len(path) else node
        inner = (at, {old: below, suffix[at]: leaf})
        if keep:
            up = path[keep - 1]
            up[1][suffix[up[0]]] = inner
        else:
            self.root = inner

    def leaves(self) -> Iterator[list[int]]:
        """Items of equal suffixes, suffixes in order."""
        stack = [self.root] if self.root else []
        while stack:
            node = stack.pop()
            if type(node[0]) is int:
                stack.extend(node[1][b] for b in sorted(node[1], reverse=True))
            else:
                yield node[1]


def multikey_quicksort(chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of strings of a few characters (``chars``: depth x string), and for
    each place of it whether the string differs from the one before.

    All open groups are parted at once: each takes the median of three of its
    characters as pivot, one stable counting pass puts its strings that are less,
    equal and greater there behind one another, and the equal ones move one
    character on. A group is closed when it has one string or no character left."""
    deep, n = chars.shape
    order, new = np.arange(n), np.zeros(n, bool)
    new[:1] = True
    if n < 2:
        return order, new
    # open strings, their places in ``order``, and where each group begins among them
    own, place, first, depth = order.copy(), np.arange(n), np.zeros(1, np.int64), np.zeros(1, np.int64)
    while len(first):
        size = np.diff(np.append(first, len(own)))
        group = np.repeat(np.arange(len(first)), size)
        key = chars[depth[group], own]
        a, b, c = key[first], key[first + size // 2], key[first + size - 1]
        pivot = np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), c))[group]
        kind = (key >= pivot).astype(np.int8) + (key > pivot)
        counts = np.empty((len(first), 3), np.int64)
        to = np.empty(len(own), np.int64)
        before = first.copy()  # where the next kind of each group goes
        for k in range(3):
            mine = kind == k
            seen = np.cumsum(mine)
            at_start = seen[first] - mine[first]
            counts[:, k] = seen[np.append(first[1:], len(own)) - 1] - at_start
            to[mine] = (before - at_start)[group[mine]] + seen[mine] - 1
            before = before + counts[:, k]
        moved = np.empty_like(own)
        moved[to] = own
        order[place] = moved
        begins = first[:, None] + np.cumsum(counts, 1) - counts
        new[place[begins[counts > 0]]] = True
        deeper = depth[:, None] + np.array([0, 1, 0])
        open_ = (counts > 1) & (deeper < deep)
        left = _flat(begins[open_], counts[open_])
        own, place, depth = moved[left], place[left], deeper[open_]
        first = np.cumsum(counts[open_]) - counts[open_]
    return order, new


def sorted_strings(text: np.ndarray, starts: np.ndarray, length: int = LENGTH, shallow: int = SHALLOW,
                   ) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of the ``length``-byte strings at ``starts``: their order,
    and for each place of it whether the string differs from the one before.
    Multikey quicksort orders them to ``shallow`` bytes, by characters of 8 bytes;
    blind tries order what is still together."""
    n = len(starts)
    if not n:
        return np.arange(0), np.zeros(0, bool)
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    words = np.lib.stride_tricks.sliding_window_view(padded, 8)
    chars = np.stack([np.ascontiguousarray(words[starts + d]).view(">u8").ravel().astype(np.uint64) for d in range(0, shallow, 8)])
    order, new = multikey_quicksort(chars)
    raw = text.tobytes()
    edges = np.append(np.flatnonzero(new), n)
    for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        if hi - lo < 2:
            continue
        trie = BlindTrie(length - shallow)
        for i in order[lo:hi].tolist():
            at = int(starts[i])
            trie.insert(raw[at + shallow:at + length], i)
        at = lo
        for items in trie.leaves():
            order[at:at + len(items)] = items
            new[at] = True
            at += len(items)
    return order, new


def _flat(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first, first + 1, ... (count of them) for each pair, one after another."""
    ends = np.cumsum(count)
    return np.repeat(first - ends + count, count) + np.arange(int(ends[-1]) if len(ends) else 0)


def _smallest(rows: pd.DataFrame) -> pd.DataFrame:
    """For each stretch that a chunk sent to the bucket: the smallest doc_id
    that has each of its strings. Where the chunk has them goes back with it."""
    ids: dict[tuple, int] = {}
    least: list[int] = []
    sent = []
    for data in rows["data"]:
        place, size, doc, text = unpack(data)
        raw, at, own = text.tobytes(), 0, []
        for p, n, d in zip(place.tolist(), size.tolist(), doc.tolist(), strict=True):
            entry = (p, raw[at:at + n])
            at += n
            e = ids.get(entry)
            if e is None:
                e = ids[entry] = len(least)
                least.append(d)
            elif d < least[e]:
                least[e] = d
            own.append(e)
        sent.append(own)
    text = np.frombuffer(b"".join(s for _, s in ids), np.uint8)
    size = np.array([len(s) for _, s in ids], np.int64)
    low = np.array(least, np.int64)
    first = np.cumsum(size) - size
    count = size - LENGTH + 1
    # strings are equal only around equal anchors: a stretch whose anchor no
    # other stretch has is sorted already, and so are strings sent one by one
    grams = pd.factorize(np.array([s[p:p + GRAM] if p < ALONE else s for p, s in ids], object))[0]
    several = (np.bincount(grams)[grams] > 1) & np.array([p < ALONE for p, _ in ids], bool)
    minima = np.repeat(low, count)
    base = np.cumsum(count) - count
    at = _flat(base[several], count[several])
    starts = _flat(first[several], count[several])
    order, new = sorted_strings(text, starts)
    if len(order):
        doc = minima[at][order]
        edge = np.flatnonzero(new)
        per = np.minimum.reduceat(doc, edge)
        minima[at[order]] = np.repeat(per, np.diff(np.append(edge, len(order))))
    out = []
    for own in sent:
        own = np.array(own, np.int64)
        out.append(pack(count[own].astype(np.uint8), minima[_flat(base[own], count[own])]))
    return pd.DataFrame({"chunk": rows["chunk"], "members": rows["members"], "data": out})


# --- 5: cutting ---------------------------------------------------------------------

def _cut(names: list[str]):
    def run(key, chunk: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        frames = []
        for data, rest in zip(chunk["data"], chunk["rest"], strict=True):
            ids, ends, x = unpack(data)
            edge = np.zeros(len(x) + 1, np.int32)
            for members, reply in zip(replies["members"], replies["data"], strict=True):
                own, first = unpack(members)
                count, minima = unpack(reply)
                base = np.cumsum(count.astype(np.int64)) - count
                n = count[own].astype(np.int64)
                at = _flat(first, n)
                doc = np.repeat(ids[np.searchsorted(ends, first, "right")], n)
                bad = at[minima[_flat(base[own], n)] < doc]
                np.add.at(edge, bad, 1)
                np.add.at(edge, bad + LENGTH, -1)
            gone = np.cumsum(edge[:-1]) > 0
            rows, lo = [], 0
            for d, hi in zip(ids.tolist(), ends.tolist(), strict=True):
                g = gone[lo:hi]
                kept = x[lo:hi][~g].tobytes()
                spans = int(g[:1].sum() + (g[1:] & ~g[:-1]).sum())
                rows.append((None if d == NULL_ID else d, hi - lo, int(g.sum()), spans,
                             hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore")))
                lo = hi
            frame = pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            for name in names:
                frame[name] = [r[name] for r in rest]
            frames.append(frame)
        return pd.concat(frames) if frames else pd.DataFrame()

    return run


def cut_repeats(docs: DataFrame, columns: list[str] = (), with_kept: bool = True) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of each row of
    ``docs``, the remaining text as ``kept`` (without the rests of characters
    that were cut in the middle), and ``columns`` of ``docs`` under the names
    ``own_<column>``."""
    spark = docs.sparkSession
    prepare(spark)
    names = [f"own_{c}" for c in columns]
    rest = F.struct(F.lit(True).alias("own"), *[F.col(c).alias(n) for c, n in zip(columns, names, strict=True)])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"), rest.alias("rest"))
    kind = rows.schema["rest"].dataType.simpleString()
    chunks = staged(rows.mapInArrow(_pack_chunks(CHUNK), f"chunk long, size long, data binary, rest array<{kind}>"),
                    "chunks")
    total = chunks.agg(F.sum("size")).first()[0] or 0
    buckets = max(2 * shuffle_width(spark), total // BUCKET)
    # a chunk of a few megabytes is a row: few rows to a batch
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    sent = chunks.select("chunk", "data").mapInArrow(_send_anchors(buckets), "bucket int, chunk long, data binary")
    reply = "chunk long, bucket int, data binary"
    shared = sent.groupBy("bucket").applyInPandas(_shared_anchors(HOT), reply)
    plain = chunks.select("chunk", "data")
    stretches = plain.groupBy("chunk").cogroup(shared.groupBy("chunk")).applyInPandas(
        _send_stretches(buckets), "bucket int, chunk long, data binary, members binary")
    marks = stretches.groupBy("bucket").applyInPandas(_smallest, "chunk long, members binary, data binary")
    kinds = [f"{n} {rows.schema['rest'].dataType[n].dataType.simpleString()}" for n in names]
    out = ", ".join(["doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string", *kinds])
    cut = chunks.select("chunk", "data", "rest").groupBy("chunk").cogroup(marks.groupBy("chunk")).applyInPandas(
        _cut(names), out)
    return cut if with_kept else cut.drop("kept")
