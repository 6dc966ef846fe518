"""LM scoring by context-tree weighting over bytes.

Every byte is eight binary decisions. Each decision has a tree of contexts:
the bytes before it, none to ``DEPTH`` of them. A context's zeros and ones
give a Krichevsky-Trofimov estimate; bottom-up, the weighted probability of a
context is half its own estimate and half the product of its children's.
Trained, the tree is fixed: the probability of a byte mixes the estimates of
all depths on the path of its context, with the weights that the training
counts leave them. Texts are lowered (A-Z) and end with a byte that UTF-8 has
not; the same byte stands before them.

Counts: all (DEPTH + 1)-byte strings of all training texts, summed by Spark.
Every context that occurs is a node, so the tree grows with the corpus. It is
never in one place: contexts of ``SPLIT`` bytes are dealt to buckets by hash,
each with all longer ones that end in it (65,792 at most). A first pass weighs
these subtrees; Spark sums their weighted probabilities by parent. The top, of
at most 65,793 contexts of fewer bytes, is weighed in the driver and broadcast.
Texts are packed into chunks; each chunk sends its distinct strings to their
buckets, whose second pass answers with the log10 probability of each string's
last byte. The chunk adds them up by document. ``fit`` builds the same tree in
one process, for small corpora; there contexts can be kept by their share.

Base score: add-one word probabilities. Words with one in ``HEAD`` of all
occurrences (``HEAD`` at most) are broadcast; the other (row, word, frequency)
rows join the word counts on the word.

Null and empty texts are one end token and one end byte. Repeated rows are
counted and scored each. With no training text all counts are zero: base
probabilities are 1, and each decision has one half.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storylens.llm.common import prepare, shuffle_width, staged, texts
from storylens.llm.suffix_dedup import pack, unpack
from storylens.llm.words import spaced_words

DEPTH = 5
# Bytes of the contexts that are dealt to buckets.
SPLIT = 3
# Bytes of texts in a chunk, and of all scored texts to a bucket.
CHUNK = 8 << 20
BUCKET = 8 << 20
# Longest contexts of a bucket that are weighed at a time, more if they end in
# one context of SPLIT bytes.
SLICE = 1 << 13
# Strings that chunks ask for, held before equal ones are joined.
ASKED = 1 << 21
HEAD = 1 << 21
HEAD_BYTES = 64
END = 0xFF
# Stands for the end token among words: no word has a space.
END_WORD = b" "
FLUSH = 400_000
# Decisions whose trees are held at a time.
COLUMNS = 16
# Bytes whose strings are counted at a time.
BLOCK = 1 << 23
# Bytes of a chunk's texts that are coded at a time (a longer text alone).
CODED = 1 << 20
# Counts below this have their log gammas in a table.
TABLE = 1 << 14


def byte_rows(batch: list[str | bytes | None], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts as one byte array with ``depth`` marks before each and one
    after; positions that are scored; index of each text's first such one."""
    raw = [(t if isinstance(t, bytes) else (t or "").encode()).lower() for t in batch]
    mark = bytes([END])
    joined = np.frombuffer(b"".join(mark * depth + r + mark for r in raw), np.uint8)
    sizes = np.array([len(r) + 1 for r in raw], np.int64)
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    keep = np.ones(len(joined), bool)
    heads = first + np.arange(len(raw)) * depth
    for d in range(depth):
        keep[heads + d] = False
    return joined, np.flatnonzero(keep), first


def _strings(depth: int):
    """(depth + 1)-byte strings of a task with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, keys, counts = [], 0, np.zeros(0, np.uint64), np.zeros(0, np.int64)

        def fold():
            # sorted in place: a block is many megabytes, and a second copy of it as many again
            block = np.concatenate(held)
            held.clear()
            block.sort()
            first = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
            k, n = block[first], np.diff(first, append=len(block))
            del block, first
            both = np.concatenate([keys, k.astype(np.uint64)])
            u, at = np.unique(both, return_inverse=True)
            return u, np.bincount(at, np.concatenate([counts, n]), len(u)).astype(np.int64)

        for b in batches:
            if not b.num_rows:
                continue
            x, at, _ = byte_rows(b.column(0).to_pylist(), depth)
            code = np.zeros(len(at), np.uint32 if depth < 4 else np.uint64)
            for d in range(depth, -1, -1):
                code = code << 8 | x[at - d]
            held.append(code)
            size += len(code)
            if size >= BLOCK:
                keys, counts = fold()
                size = 0
        if held:
            keys, counts = fold()
        for at in range(0, len(keys), 1 << 16):
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[at:at + (1 << 16)].astype(np.int64)), pa.array(counts[at:at + (1 << 16)])], ["s", "n"])

    return run


def string_counts(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """``s, n``: counts of all strings of depth + 1 bytes, packed in a long."""
    return texts(docs).select("text").mapInArrow(_strings(depth), "s long, n long").groupBy("s").agg(
        F.sum("n").alias("n"))


@dataclass
class Tree:
    """``step[state, byte]``: next state, from the last byte of a context to
    the first; ``log10p[state, byte]`` where the context ends."""

    depth: int
    step: np.ndarray
    log10p: np.ndarray

    def score(self, batch: list[str | None]) -> np.ndarray:
        x, at, first = byte_rows(batch, self.depth)
        state = np.zeros(len(at), np.int64)
        flat = self.step.ravel()
        for d in range(1, self.depth + 1):
            state = flat[state << 8 | x[at - d]]
        each = self.log10p.ravel()[state.astype(np.int64) << 8 | x[at]]
        return np.add.reduceat(each.astype(float), first) if len(first) else np.zeros(0)


def _log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """log of the Krichevsky-Trofimov block probability of a zeros, b ones."""
    return _log_gamma(a, 0.5) + _log_gamma(b, 0.5) - 2 * math.lgamma(0.5) - _log_gamma(a + b, 1.0)


@cache
def _gamma_table(more: float) -> np.ndarray:
    return _lgamma(np.arange(TABLE) + more)


def _log_gamma(n: np.ndarray, more: float) -> np.ndarray:
    """log gamma of ``n + more`` for counts ``n``; most are small."""
    large = n >= TABLE
    out = _gamma_table(more)[np.where(large, 0, n)]
    if large.any():
        out[large] = _lgamma(n[large] + more)
    return out


def _lgamma(x: np.ndarray) -> np.ndarray:
    """log gamma for x >= 0.5: recurrence up to 8, then Stirling's series."""
    x = np.array(x, float)
    shift = np.zeros_like(x)
    for _ in range(8):
        low = x < 8
        shift = np.where(low, shift + np.log(np.where(low, x, 1.0)), shift)
        x = np.where(low, x + 1, x)
    return (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (
        1260 * x**5) - shift


def decisions(width: int = COLUMNS) -> Iterator[tuple[int, np.ndarray]]:
    """Blocks of decisions of one bit: bytes on each side of a decision, and
    the first byte below each."""
    for bit in range(8):
        half = 128 >> bit
        firsts = np.arange(0, 256, 2 * half)
        for at in range(0, len(firsts), width):
            yield half, firsts[at:at + width]


def _pairs(counts: np.ndarray, half: int, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Zeros and ones of some decisions, from byte counts (n x 256)."""
    block = counts[:, firsts[0]:firsts[-1] + 2 * half].reshape(len(counts), len(firsts), 2, half)
    both = block.sum(3, dtype=np.int64)
    return both[:, :, 0], both[:, :, 1]


def build(counts: list[tuple[np.ndarray, np.ndarray]], depth: int) -> Tree:
    """``counts[d]``: contexts of d bytes (packed, last byte lowest), their
    byte counts (n x 256); contexts of depth d extend kept ones of d - 1."""
    contexts = [c for c, _ in counts]
    parents = [np.searchsorted(contexts[d - 1], contexts[d] & ((1 << 8 * (d - 1)) - 1)) if d else None
               for d in range(depth + 1)]
    kids = [np.bincount(parents[d + 1], minlength=len(contexts[d])) > 0 if d < depth else
            np.zeros(len(contexts[d]), bool) for d in range(depth + 1)]
    # states: nodes by depth, then for each node with children one for the rest
    bases = np.concatenate([[0], np.cumsum([len(c) for c in contexts])])
    others = np.concatenate(kids)
    other_state = int(bases[-1]) + np.cumsum(others) - 1
    n = int(bases[-1]) + int(others.sum())
    step = np.repeat(np.arange(n, dtype=np.int32)[:, None], 256, 1)
    for d in range(depth):
        nodes = np.arange(bases[d], bases[d + 1])
        step[nodes[kids[d]]] = other_state[nodes][kids[d]][:, None]
        step[bases[d] + parents[d + 1], (contexts[d + 1] >> 8 * d) & 255] = np.arange(bases[d + 1], bases[d + 2])
    logs = np.zeros((n, 256), np.float32)
    for half, firsts in decisions():
        pairs = [_pairs(c, half, firsts) for _, c in counts]
        own = [_log_kt(*p) for p in pairs]
        rest, weight, below = [None] * (depth + 1), [None] * (depth + 1), None
        for d in range(depth, -1, -1):  # bottom-up: weighted probabilities
            total, weight[d] = own[d], np.ones_like(own[d])
            if d < depth:
                # counts of the unkept children, as one child
                rest[d] = [x - _summed(y, parents[d + 1], len(x)) for x, y in zip(pairs[d], pairs[d + 1], strict=True)]
                split = _log_kt(*rest[d]) + below
                k = kids[d][:, None]
                total = np.where(k, np.logaddexp(own[d], split) + math.log(0.5), own[d])
                weight[d] = np.where(k, np.minimum(np.exp(math.log(0.5) + own[d] - total), 1.0), 1.0)
            if d:
                below = _summed(total, parents[d], len(contexts[d - 1]))
        mixed, left = np.zeros((1, len(firsts))), np.ones((1, len(firsts)))
        for d in range(depth + 1):  # top-down: mixtures along each path
            if d:
                mixed, left = mixed[parents[d]], left[parents[d]]
            mixed = mixed + left * weight[d] * _kt(*pairs[d])
            left = left * (1 - weight[d])
            nodes = slice(int(bases[d]), int(bases[d + 1]))
            _add(logs, nodes, mixed, half, firsts)
            if d < depth and kids[d].any():
                k = kids[d]
                _add(logs, other_state[nodes][k], mixed[k] + left[k] * _kt(*[x[k] for x in rest[d]]), half, firsts)
    return Tree(depth, step, logs)


def _kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return (ones + 0.5) / (zeros + ones + 1)


def _summed(rows: np.ndarray, parent: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows of each of ``n`` parents."""
    out = np.zeros((n, rows.shape[1]), rows.dtype)
    if len(rows):
        order = np.argsort(parent, kind="stable")
        there = parent[order]
        first = np.flatnonzero(np.diff(there, prepend=-1))
        out[there[first]] = np.add.reduceat(rows[order], first)
    return out


def _add(logs: np.ndarray, states, p_one: np.ndarray, half: int, firsts: np.ndarray) -> None:
    """Add the decisions' log10 probabilities to those of the bytes below."""
    p = np.clip(p_one, 1e-15, 1 - 1e-15)
    both = np.repeat(np.stack([np.log10(1 - p), np.log10(p)], 2).reshape(len(p), 2 * len(firsts)), half, 1)
    logs[states, firsts[0]:firsts[-1] + 2 * half] += both


def fit(docs: DataFrame, depth: int = DEPTH, share: int | None = None) -> Tree:
    """Context tree of the texts of ``docs``, in the driver: of all contexts,
    or of those that have one in ``share`` of all bytes, the rarer siblings
    being one child."""
    prepare(docs.sparkSession)
    s = staged(string_counts(docs, depth), "strings")
    total = s.agg(F.sum("n")).first()[0] or 0
    counts, kept = [], None
    for d in range(depth + 1):
        mask = (1 << 8 * (d + 1)) - 1
        cut = s.select(F.col("s").bitwiseAND(F.lit(mask)).alias("s"), "n")
        rows = cut.groupBy("s").agg(F.sum("n").alias("n")).withColumn("c", F.shiftrightunsigned("s", 8))
        often = rows.groupBy("c").agg(F.sum("n").alias("k")).where(F.lit(True) if share is None else F.col("k") * share >= total)
        got = rows.join(often, "c").select("c", F.col("s").bitwiseAND(F.lit(255)).alias("b"), "n").toArrow()
        c, b, n = (np.asarray(got.column(i).to_numpy(zero_copy_only=False), np.int64) for i in range(3))
        context = np.unique(c) if d else np.zeros(1, np.int64)
        table = np.zeros((len(context), 256), np.uint32 if total < 1 << 32 else np.int64)
        table[np.searchsorted(context, c), b] = n
        counts.append((context, table))
    return build(counts, depth)


# --- the tree in buckets ----------------------------------------------------------

def _mask(d: int) -> int:
    return (1 << 8 * d) - 1


def _levels(s: np.ndarray, n: np.ndarray, low: int, high: int) -> tuple[list, list, list]:
    """Contexts of low to high bytes in strings ``s`` with counts ``n``, their
    byte counts, and each one's place among the contexts a byte shorter."""
    contexts, tables, parents = [], [], []
    for d in range(low, high + 1):
        c, at = np.unique(s >> 8 & _mask(d), return_inverse=True)
        if not d:
            c, at = np.zeros(1, np.int64), np.zeros(len(s), np.int64)
        table = np.zeros((len(c), 256), np.int64)
        np.add.at(table.ravel(), at << 8 | s & 255, n)
        parents.append(np.searchsorted(contexts[-1], c & _mask(d - 1)) if contexts else None)
        contexts.append(c)
        tables.append(table)
    return contexts, tables, parents


def _columns(half: int, firsts: np.ndarray) -> slice:
    """Places of some decisions among all 255."""
    at = 128 // half - 1 + int(firsts[0]) // (2 * half)
    return slice(at, at + len(firsts))


def _weighed(tables: list, parents: list, below: np.ndarray | None = None) -> Iterator[tuple]:
    """For blocks of decisions, bottom-up: zeros and ones and the weight of the
    own estimate at each level, and the first level's weighted probabilities.
    ``below``: summed ones of the last level's children, if it has any."""
    for half, firsts in decisions():
        pairs = [_pairs(t, half, firsts) for t in tables]
        weights: list = [None] * len(tables)
        split = None if below is None else below[:, _columns(half, firsts)]
        for d in range(len(tables) - 1, -1, -1):
            a, b = pairs[d]
            total, met = np.zeros(a.shape), a + b > 0
            total[met] = _log_kt(a[met], b[met])
            weights[d] = np.ones_like(total)
            if split is not None:
                own = total
                total = np.logaddexp(own, split) + math.log(0.5)
                weights[d] = np.minimum(np.exp(math.log(0.5) + own - total), 1.0)
            if d:
                split = _summed(total, parents[d], len(tables[d - 1]))
        yield half, firsts, pairs, weights, total


def _find(sorted_: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each key, and whether it is there."""
    if not len(sorted_):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(sorted_, keys), len(sorted_) - 1)
    return at, sorted_[at] == keys


def _looked_up(keys: np.ndarray, contexts: list, logs: list, low: int) -> np.ndarray:
    """log10 probability of each string's last byte in its longest context
    among ``contexts``; NaN without one."""
    out = np.full(len(keys), np.nan, np.float32)
    for d, (c, log) in enumerate(zip(contexts, logs, strict=True), low):
        at, there = _find(c, keys >> 8 & _mask(d))
        out[there] = log[at[there], keys[there] & 255]
    return out


@dataclass
class Top:
    """Contexts of fewer than ``split`` bytes. ``logs[d]``: log10 of each byte
    after a context whose next longer one never occurred; of the last level,
    ``mixed`` and ``left`` are the estimates so far and the weight that is left
    for longer contexts, by decision."""

    split: int
    depth: int
    contexts: list
    logs: list
    mixed: np.ndarray
    left: np.ndarray


def _mixed_down(weighed: Iterator[tuple], parents: list, sizes: list, start, closed: bool) -> tuple[list, np.ndarray, np.ndarray]:
    """Mixtures along each path: log10 by byte for each level, and the last
    level's mixtures and left weights. ``start``: those above the first level,
    by decision; ``closed``: the last level has no children."""
    logs = [np.zeros((n, 256), np.float32) for n in sizes]
    mixed_all, left_all = (np.zeros((0 if closed else sizes[-1], 255)) for _ in range(2))
    for half, firsts, pairs, weights, _ in weighed:
        columns = _columns(half, firsts)
        mixed, left = (x[:, columns] for x in start)
        for d, ((a, b), weight) in enumerate(zip(pairs, weights, strict=True)):
            if d:
                mixed, left = mixed[parents[d]], left[parents[d]]
            mixed, left = mixed + left * weight * _kt(a, b), left * (1 - weight)
            # a context that never occurred has one half at every depth
            _add(logs[d], slice(None), mixed + left * 0.5, half, firsts)
        if not closed:
            mixed_all[:, columns], left_all[:, columns] = mixed, left
    return logs, mixed_all, left_all


def _slices(s: np.ndarray, split: int, depth: int) -> Iterator[np.ndarray]:
    """Places of the strings, by whole subtrees."""
    longest = np.unique(s >> 8 & _mask(depth))
    roots, size = np.unique(longest & _mask(split), return_counts=True)
    part = (np.cumsum(size) - size) // SLICE
    of = part[np.searchsorted(roots, s >> 8 & _mask(split))]
    order = np.argsort(of, kind="stable")
    yield from np.split(order, np.flatnonzero(np.diff(of[order])) + 1)


def _bucket(keys: np.ndarray, split: int, buckets: int) -> np.ndarray:
    return ((keys >> 8 & _mask(split)) * 2654435761 >> 8 & 0xFFFFFF) % buckets


def _bucket_column(split: int, buckets: int):
    root = F.shiftright("s", 8).bitwiseAND(F.lit(_mask(split)))
    mixed = F.shiftright(root * F.lit(2654435761), 8).bitwiseAND(F.lit(0xFFFFFF))
    return (mixed % F.lit(buckets)).cast("int")


def _numbers(table: pa.Table, *names: str) -> list[np.ndarray]:
    return [np.asarray(table.column(c).to_numpy(), np.int64) for c in names]


def _totals(split: int, depth: int):
    """Weighted probabilities (logs) of a bucket's subtrees, summed by parent."""

    def run(rows: pa.Table) -> pa.Table:
        s, n = _numbers(rows, "s", "n")
        out = []
        for at in _slices(s, split, depth):
            contexts, tables, parents = _levels(s[at], n[at], split, depth)
            parent, of = np.unique(contexts[0] & _mask(split - 1), return_inverse=True)
            total = np.zeros((len(parent), 255))
            for half, firsts, *_, block in _weighed(tables, parents):
                total[:, _columns(half, firsts)] = _summed(block, of, len(parent))
            i, k = np.nonzero(total)
            out.append((parent[i], k, total[i, k]))
        c, k, t = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.table({"c": pa.array(c, pa.int64()), "k": pa.array(k, pa.int32()), "total": pa.array(t, pa.float64())})

    return run


def fit_top(strings: DataFrame, depth: int) -> Top:
    """Top of the tree of ``strings`` (``s, n, bucket``). The driver gets the
    byte counts of contexts of fewer than ``SPLIT`` bytes, and 255 sums for
    each of the longest of these."""
    split = min(SPLIT, depth)
    totals = strings.groupBy("bucket").applyInArrow(_totals(split, depth), "c long, k int, total double")
    sums = totals.groupBy("c", "k").agg(F.sum("total").alias("total")).toArrow()
    short = strings.groupBy(F.col("s").bitwiseAND(F.lit(_mask(split))).alias("s")).agg(F.sum("n").alias("n")).toArrow()
    contexts, tables, parents = _levels(*_numbers(short, "s", "n"), 0, split - 1)
    c, k = _numbers(sums, "c", "k")
    below = np.zeros((len(contexts[-1]), 255))
    below[np.searchsorted(contexts[-1], c), k] = sums.column("total").to_numpy()
    start = np.zeros((1, 255)), np.ones((1, 255))
    logs, mixed, left = _mixed_down(_weighed(tables, parents, below), parents, [len(x) for x in contexts], start, False)
    return Top(split, depth, contexts, logs, mixed, left)


def _answers(shared):
    """For the strings that chunks ask a bucket for: log10 probabilities."""

    def run(rows: pa.Table, asks: pa.Table) -> pa.Table:
        top: Top = shared.value[0]
        held = asks.column("data").to_pylist()
        some, size = [np.zeros(0, np.int64)], 0
        for data in held:
            some.append(np.cumsum(unpack(data)[0]))
            size += len(some[-1])
            if size >= ASKED:
                some, size = [np.unique(np.concatenate(some))], 0
        asked = np.unique(np.concatenate(some))
        s, n = _numbers(rows, "s", "n")
        value = _looked_up(asked, top.contexts, top.logs, 0)
        root = asked >> 8 & _mask(top.split)
        for at in _slices(s, top.split, top.depth) if len(s) and len(asked) else ():
            contexts, tables, parents = _levels(s[at], n[at], top.split, top.depth)
            wanted = np.flatnonzero(_find(contexts[0], root)[1])
            if not len(wanted):
                continue
            above = np.searchsorted(top.contexts[-1], contexts[0] & _mask(top.split - 1))
            logs, _, _ = _mixed_down(_weighed(tables, parents), parents, [len(x) for x in contexts],
                                     (top.mixed[above], top.left[above]), True)
            value[wanted] = _looked_up(asked[wanted], contexts, logs, top.split)
        out = [pack(value[np.searchsorted(asked, np.cumsum(unpack(data)[0]))]) for data in held]
        return pa.table({"chunk": asks.column("chunk"), "bucket": asks.column("bucket"), "data": pa.array(out, pa.binary())})

    return run


def _pack_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts by chunk: number of its first row, doc_ids, which are null, ends
    and bytes."""
    from pyspark import TaskContext

    number, ids, raw, size = TaskContext.get().partitionId() << 33, [], [], 0

    def flush():
        data = pack(np.array([i or 0 for i in ids], np.int64), np.array([i is None for i in ids], np.uint8),
                    np.cumsum([len(r) for r in raw], dtype=np.int64), np.frombuffer(b"".join(raw), np.uint8))
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([size], pa.int64()),
                                           pa.array([data], pa.binary())], ["chunk", "size", "data"])

    for b in batches:
        for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            ids.append(i)
            raw.append((t or "").encode())
            size += len(raw[-1])
            if size >= CHUNK:
                yield flush()
                number, ids, raw, size = number + len(ids), [], [], 0
    if ids:
        yield flush()


class Strings:
    """A chunk's documents and distinct strings, by bucket and value."""

    def __init__(self, data: bytes, depth: int, split: int, buckets: int):
        ids, null, ends, x = unpack(data)
        self.ids = [None if z else i for i, z in zip(ids.tolist(), null.tolist(), strict=True)]
        raw = x.tobytes()
        self.raw = [raw[a:b] for a, b in zip([0, *ends.tolist()[:-1]], ends.tolist(), strict=True)]
        # some texts at a time: an array of strings is 8 times as large as their bytes
        codes, self.first = [], []
        part = np.cumsum([0, *map(len, self.raw)])[:-1] // CODED
        for some in np.split(np.arange(len(self.raw)), np.flatnonzero(np.diff(part)) + 1):
            x, at, first = byte_rows(self.raw[some[0]:some[-1] + 1], depth)
            code = np.zeros(len(x) - depth, np.int64)
            for d in range(depth, -1, -1):
                code <<= 8
                code |= x[depth - d:len(x) - d]
            at -= depth
            codes.append(pa.array(code[at]))
            self.first.append(first)
        # all parts are coded by one dictionary
        coded = pa.chunked_array(codes).dictionary_encode()
        del codes
        keys = coded.chunk(0).dictionary.to_numpy()
        self.place = [c.indices.to_numpy() for c in coded.chunks]
        bucket = _bucket(keys, split, buckets)
        self.order = np.lexsort((keys, bucket))
        self.keys, self.bucket = keys[self.order], bucket[self.order]

    def asks(self) -> Iterator[tuple[int, bytes]]:
        for part in np.split(np.arange(len(self.keys)), np.flatnonzero(np.diff(self.bucket)) + 1):
            yield int(self.bucket[part[0]]), pack(np.diff(self.keys[part], prepend=0))

    def sums(self, values: np.ndarray) -> list[float]:
        """Of each document, with the values of the strings as asked for."""
        by_place = np.zeros(len(values))
        by_place[self.order] = values
        return [s for place, first in zip(self.place, self.first, strict=True)
                for s in np.add.reduceat(by_place[place], first).tolist()]


def _ask(depth: int, split: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for number, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows = list(Strings(data, depth, split, buckets).asks())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k for k, _ in rows], pa.int32()), pa.array([number] * len(rows), pa.int64()),
                     pa.array([p for _, p in rows], pa.binary())], ["bucket", "chunk", "data"])

    return run


def _word_rows():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()),
                                               pa.array(list(seen.values()), pa.int64())], ["word", "n"])

        for b in batches:
            for t in b.column(0).to_pylist():
                seen.update(spaced_words(t))
            seen[END_WORD] += b.num_rows
            if len(seen) > FLUSH:
                yield flush()
                seen.clear()
        yield flush()

    return run


def word_counts(docs: DataFrame) -> DataFrame:
    """``word, n`` over all tokens, the end token as a single space."""
    return texts(docs).select("text").mapInArrow(_word_rows(), "word binary, n long").where("n > 0").groupBy(
        "word").agg(F.sum("n").alias("n"))


def _scores(shared, buckets: int):
    """Per document a row with its sums over broadcast words, under a key that
    no word has, and a row for each other distinct word."""

    def run(chunks: pa.Table, replies: pa.Table) -> pa.Table:
        top, logs = shared.value
        key, row, ids, base, known, tokens, model, size = ([] for _ in range(8))
        more_words: list[bytes] = []
        more_rows: list[int] = []
        more_freq: list[int] = []
        answers = dict(zip(replies.column("bucket").to_pylist(), replies.column("data").to_pylist(), strict=True))
        for number, data in zip(chunks.column("chunk").to_pylist(), chunks.column("data").to_pylist(), strict=True):
            chunk = Strings(data, top.depth, top.split, buckets)
            model += chunk.sums(np.concatenate([unpack(answers[k])[0] for k in sorted(answers)]))
            ids += chunk.ids
            for r, t in enumerate(chunk.raw, number):
                words = t.lower().split()
                words.append(END_WORD)
                total, hits = 0.0, 0
                for w, c in Counter(words).items():
                    p = logs.get(w)
                    if p is None:
                        more_words.append(w)
                        more_rows.append(r)
                        more_freq.append(c)
                    else:
                        total += c * p
                        hits += c
                key.append(b" %d" % r)
                row.append(r)
                base.append(total)
                known.append(hits)
                tokens.append(len(words))
                size.append(len(t))
        none = [None] * len(more_words)
        return pa.Table.from_arrays(
            [pa.array(key + more_words, pa.binary()), pa.array(row + more_rows, pa.int64()),
             pa.array([None] * len(key) + more_freq, pa.int64()), pa.array(ids + none, pa.int64()),
             pa.array(base + none, pa.float64()), pa.array(known + none, pa.int64()),
             pa.array(tokens + none, pa.int64()), pa.array(model + none, pa.float64()),
             pa.array(size + none, pa.int64())],
            ["word", "row", "freq", "doc_id", "base", "known", "tokens", "model", "n_bytes"])

    return run


def scores(docs: DataFrame, training: DataFrame, depth: int = DEPTH) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, n_known, train_tokens, base_score, score,
    bits_per_byte`` of every row of ``docs``, learned from ``training``."""
    spark = docs.sparkSession
    prepare(spark)
    chunks = staged(texts(docs).mapInArrow(_pack_chunks, "chunk long, size long, data binary"), "chunks")
    buckets = max(2 * shuffle_width(spark), (chunks.agg(F.sum("size")).first()[0] or 0) // BUCKET)
    strings = staged(string_counts(training, depth), "strings")
    strings = strings.withColumn("bucket", _bucket_column(min(SPLIT, depth), buckets))
    top = fit_top(strings, depth)
    words = staged(word_counts(training), "words")
    n_all, n_distinct = (x or 0 for x in words.agg(F.sum("n"), F.count("*")).first())
    often = words.where((F.col("n") * HEAD >= n_all) & (F.octet_length("word") <= HEAD_BYTES)).toArrow()
    space = math.log10(n_all + n_distinct + 1)
    logs = {w: math.log10(n + 1) - space for w, n in zip(often.column(0).to_pylist(), often.column(1).to_pylist(), strict=True)}
    shared = spark.sparkContext.broadcast((top, logs))
    # a chunk of a few megabytes is a row: few rows to a batch
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    plain = chunks.select("chunk", "data")
    asks = plain.mapInArrow(_ask(depth, top.split, buckets), "bucket int, chunk long, data binary")
    replies = strings.groupBy("bucket").cogroup(asks.groupBy("bucket")).applyInArrow(
        _answers(shared), "chunk long, bucket int, data binary")
    parts = plain.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(
        _scores(shared, buckets),
        "word binary, row long, freq long, doc_id long, base double, known long, tokens long, model double, n_bytes long")
    met = parts.join(words, "word", "left")
    n = F.coalesce(F.col("n"), F.lit(0))
    base = F.coalesce(F.col("base"), F.col("freq") * (F.log10(n + 1) - F.lit(space)))
    known = F.coalesce(F.col("known"), F.when(n > 0, F.col("freq")).otherwise(0))
    out = met.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), F.max("tokens").alias("n_tokens"),
        F.sum(known).alias("n_known"), F.lit(n_all).cast("long").alias("train_tokens"), F.sum(base).alias("base_score"),
        F.max("model").alias("score"))
    bits = -F.col("score") / F.lit(math.log10(2)) / (F.col("n_bytes") + 1)
    return out.withColumn("bits_per_byte", bits).drop("row")
