"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

A window is ``WINDOW`` consecutive words of a benchmark item; an item of fewer
words, but not none, is one window. Windows of like length are searched
together. Per such set, with m its shortest length and b the block of words:
the shift table says how far the search may jump from a document block that
ends at a position (m-b+1 for blocks of no window), blocks that may end a
window's first m words select a bucket, and the bucket's windows are compared
word by word with the document.

The benchmark is the query set. Its items are dealt into blocks of a bounded
number of windows; each block is collected and broadcast by itself and run
over all documents, so no broadcast grows with the benchmark.

Null and empty texts have no words and no hits, items without words have no
window, equal windows of several items count for each of them; every input
row, repeated ones too, is kept with its columns; one called ``contamination``
is replaced, and ``__all`` and ``__hits1``, ``__hits2``, ... are lost.
"""

from __future__ import annotations

import hashlib
import uuid
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storylens.llm.common import prepare, staged
from storylens.llm.words import alnum_words

WINDOW = 13
# A document is contaminated from one hit word in so many on.
RATE = 20
BLOCK_WORDS = 3
# Words of benchmark items in one broadcast block: as many windows at most.
ITEM_WORDS = 400_000
# Window lengths that share a search, so that short items don't shorten the
# jumps of the others.
BANDS = ((1, 1), (2, 2), (3, 4), (5, 8), (9, WINDOW - 1), (WINDOW, WINDOW))


def windows(text: str | None, size: int = WINDOW) -> list[tuple[bytes, ...]]:
    w = alnum_words(text)
    if len(w) <= size:
        return [tuple(w)] if w else []
    return [tuple(w[i:i + size]) for i in range(len(w) - size + 1)]


class Search:
    """Shift and bucket tables of one set of windows."""

    def __init__(self, patterns: list[tuple[bytes, ...]]):
        self.m = min(map(len, patterns))
        self.b = b = min(BLOCK_WORDS, self.m)
        self.far = self.m - b + 1
        self.shift: dict[tuple, int] = {}
        self.bucket: dict[tuple, list[tuple]] = defaultdict(list)
        for p in patterns:
            for end in range(b, self.m + 1):
                block = p[end - b:end]
                self.shift[block] = min(self.shift.get(block, self.far), self.m - end)
            self.bucket[p[self.m - b:self.m]].append(p)

    def find(self, words: list[bytes]) -> Iterator[tuple[int, tuple]]:
        """``(start, window)`` of each occurrence."""
        m, b, far, shift, n = self.m, self.b, self.far, self.shift, len(words)
        end = m
        while end <= n:
            block = tuple(words[end - b:end])
            jump = shift.get(block, far)
            if jump:
                end += jump
                continue
            start = end - m
            for p in self.bucket[block]:
                if words[start] == p[0] and tuple(words[start:start + len(p)]) == p:
                    yield start, p
            end += 1


class Benchmark:
    """The searches of one block of items."""

    def __init__(self, items: list[tuple], size: int):
        self.owners: dict[tuple, list[str]] = defaultdict(list)
        for item, text in items:
            for w in dict.fromkeys(windows(text, size)):
                self.owners[w].append(str(item))
        bands = [(lo, min(hi, size)) for lo, hi in BANDS if lo <= size]
        bands[-1] = (bands[-1][0], size)
        sets = [[p for p in self.owners if lo <= len(p) <= hi] for lo, hi in bands]
        self.searches = [Search(s) for s in sets if s]

    def hits(self, words: list[bytes]) -> tuple[list[int], list[int], set[str]]:
        """Starts and ends of hit runs, and items with occurring windows."""
        spans, items = [], set()
        for s in self.searches:
            for start, p in s.find(words):
                spans.append((start, start + len(p)))
                items.update(self.owners[p])
        return *merged(spans), items


def merged(spans) -> tuple[list[int], list[int]]:
    starts, ends = [], []
    for s, e in sorted(spans):
        if ends and s <= ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    return starts, ends


_TABLES: dict = {}


def _search(block, size: int):
    key = uuid.uuid4().hex  # a worker keeps the tables of the block it used last

    @F.pandas_udf("n_words long, starts array<long>, ends array<long>, items array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        if key not in _TABLES:
            _TABLES.clear()
            _TABLES[key] = Benchmark(block.value, size)
        table = _TABLES[key]
        for s in batches:
            rows = []
            for t in s:
                w = alnum_words(t)
                starts, ends, items = table.hits(w)
                rows.append((len(w), starts, ends, sorted(items)))
            yield pd.DataFrame(rows, columns=["n_words", "starts", "ends", "items"])

    return run.asNondeterministic()


def _join():
    """Runs and items of all blocks of the benchmark."""

    @F.pandas_udf("n_hit long, starts array<long>, ends array<long>, items array<string>, items_sha256 string")
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for starts, ends, items in batches:
            rows = []
            for s, e, i in zip(starts, ends, items, strict=True):
                s, e = merged((a, b) for x, y in zip(s, e, strict=True) for a, b in zip(x, y, strict=True))
                i = sorted({x for part in i for x in part})
                rows.append((sum(e) - sum(s), s, e, i, hashlib.sha256(",".join(i).encode()).hexdigest()))
            yield pd.DataFrame(rows, columns=["n_hit", "starts", "ends", "items", "items_sha256"])

    return run.asNondeterministic()


def item_blocks(benchmark: DataFrame, item_words: int = ITEM_WORDS) -> list[list[tuple]]:
    """The benchmark in blocks of a bounded number of words, one at a time on
    the driver. An item's bytes bound its words."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text")).where(
        F.col("text").isNotNull()).distinct()
    words = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-words // (2 * item_words)))
    for k in range(n):
        part = items.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k) if n > 1 else items
        yield [tuple(r) for r in part.collect()]


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, rate: int = RATE,
                  text: str = "text", item_words: int = ITEM_WORDS) -> DataFrame:
    """``docs`` with a struct ``contamination``: ``n_words, n_hit, starts,
    ends`` (hit word runs), ``items`` (ids as strings, sorted),
    ``items_sha256, contaminated``."""
    spark = docs.sparkSession
    prepare(spark)
    got, n = docs, 0
    for n, items in enumerate(item_blocks(benchmark, item_words), 1):  # noqa: B007
        if n > 1:  # one block's tables at a time in a worker
            got = staged(got, "contamination")
        got = got.withColumn(f"__hits{n}", _search(spark.sparkContext.broadcast(items), size)(F.col(text)))
    hits = [F.col(f"__hits{k}") for k in range(1, n + 1)]

    def each(name: str) -> Column:
        return F.array(*[h[name] for h in hits])

    got = got.withColumn("__all", _join()(each("starts"), each("ends"), each("items")))
    words, hit = hits[0]["n_words"], F.col("__all.n_hit")
    out = F.struct(words.alias("n_words"), F.col("__all.*"),
                   ((hit > 0) & (F.lit(rate) * hit >= words)).alias("contaminated"))
    return got.withColumn("contamination", out).drop("__all", *[f"__hits{k}" for k in range(1, n + 1)])
