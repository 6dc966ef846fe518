"""Token counts: pieces are counted once per distinct pre-token and joined to
per-document pre-token frequencies; ids are never kept.

A pre-token is a marker run with its word. Frequent pre-tokens are the hot
keys of that join: those with at least one in ``HEAD_SHARE`` of all
occurrences are at most ``HEAD_SHARE`` by arithmetic, whatever the corpus, so
their counts are broadcast and applied where the documents are read. All
other (row, pre-token, frequency) rows are shuffled by pre-token, sorted, and
meet their count there, computed once per run of equal pre-tokens.

Null and empty texts have 0 tokens; each input row, repeated ones too, gives
one result row; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storylens.llm import tokenizers as T
from storylens.llm.common import prepare, shuffle_width, staged, texts

# A pre-token is hot from one in so many occurrences on; so many at most are.
HEAD_SHARE = 1 << 21
# Longer pre-tokens are never broadcast (characters).
HEAD_CHARS = 64
# Distinct pre-tokens that a task counts before it hands them on.
FLUSH = 400_000


def _local_heads(share: int):
    """Per flush of a task: pre-tokens that may be hot, and the flush's total
    under a null word. What is hot in all occurrences is hot in some flush,
    and a flush hands on ``share`` rows at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def flush():
            total = sum(seen.values())
            rows = [(k, n) for k, n in seen.items() if n * share >= total and n > 1 and len(k) <= HEAD_CHARS]
            return pa.RecordBatch.from_arrays(
                [pa.array([k for k, _ in rows] + [None], pa.string()),
                 pa.array([n for _, n in rows] + [total], pa.int64())], ["word", "n"])

        for b in batches:
            for t in b.column(0).to_pylist():
                seen.update(T.marked_words(t))
            if len(seen) >= FLUSH:
                yield flush()
                seen.clear()
        if seen:
            yield flush()

    return run


def _count_pieces(model: str):
    """word -> word, pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = b.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(x) for x in T.piece_ids(model, words)], pa.int64())], ["word", "pieces"])

    return run


def head_counts(docs: DataFrame, model: str, share: int = HEAD_SHARE) -> dict[str, int]:
    """The hot pre-tokens with their piece counts, ``share`` at most. Which
    pre-tokens are hot decides the route of a row, never a result."""
    local = texts(docs).select("text").mapInArrow(_local_heads(share), "word string, n long")
    found = staged(local.groupBy("word").agg(F.sum("n").alias("n")), "heads")
    total = found.where(F.col("word").isNull()).agg(F.sum("n")).first()[0] or 0
    hot = found.where(F.col("word").isNotNull() & (F.col("n") * share >= total)).select("word")
    got = hot.mapInArrow(_count_pieces(model), "word string, pieces long").toArrow()
    return dict(zip(got.column(0).to_pylist(), got.column(1).to_pylist(), strict=True))


def _frequencies(model: str, heads):
    """Per document one row with its sums over hot pre-tokens, and a row for
    each other distinct pre-token. The first kind has the key NUL + row
    number: no pre-token is met twice under it, and it spreads evenly. If the
    model's merges can cross markers, the first kind has all of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, by_word = heads.value, T.splits_at_markers(model)
        for b in batches:
            rows, ids = b.column(0).to_pylist(), b.column(1).to_pylist()
            key, row, doc, size, n = [], [], [], [], []
            for r, d, t in zip(rows, ids, b.column(2).to_pylist(), strict=True):
                rest = []
                if by_word:
                    freq = Counter(T.marked_words(t))
                    total = 0
                    for w, c in freq.items():
                        k = known.get(w)
                        if k is None:
                            rest.append((w, c))
                        else:
                            total += k * c
                else:
                    total = len(T.piece_model(model).encode(t))
                key.append(f"\0{r}")
                n.append(total)
                size.append(len(t.encode()))
                doc.append(d)
                row.append(r)
                key += [" " + w for w, _ in rest]
                n += [c for _, c in rest]
                size += [None] * len(rest)
                doc += [None] * len(rest)
                row += [r] * len(rest)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key, pa.string()), pa.array(row, pa.int64()), pa.array(doc, pa.int64()),
                 pa.array(size, pa.int64()), pa.array(n, pa.int64())], ["word", "row", "doc_id", "n_bytes", "n"])

    return run


def _meet_counts(model: str):
    """Rows sorted by pre-token: its pieces are counted once per run of equal
    pre-tokens, also across batches, and multiplied with each frequency."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, pieces = None, 0
        for b in batches:
            words = pc.run_end_encode(b.column(0)).values.to_pylist()
            new = [w for w in words if w != last and w[0] != "\0"]
            count = dict(zip(new, map(len, T.piece_ids(model, [w[1:] for w in new])), strict=True)) if new else {}
            if last is not None:
                count[last] = pieces
            n = [c if w[0] == "\0" else c * count[w]
                 for w, c in zip(b.column(0).to_pylist(), b.column(4).to_pylist(), strict=True)]
            if words and words[-1][0] != "\0":
                last, pieces = words[-1], count[words[-1]]
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), b.column(3), pa.array(n, pa.int64())],
                                             ["row", "doc_id", "n_bytes", "n"])

    return run


def token_counts(docs: DataFrame, model: str = T.PIECE_MODEL, share: int = HEAD_SHARE) -> DataFrame:
    """``doc_id, n_bytes, n_tokens`` of every row of ``docs``."""
    spark = docs.sparkSession
    prepare(spark)
    heads = spark.sparkContext.broadcast(head_counts(docs, model, share))
    rows = texts(docs).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    freq = rows.mapInArrow(_frequencies(model, heads), "word string, row long, doc_id long, n_bytes long, n long")
    met = freq.repartition(shuffle_width(spark), "word").sortWithinPartitions("word").mapInArrow(
        _meet_counts(model), "row long, doc_id long, n_bytes long, n long")
    return met.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"),
                                  F.sum("n").alias("n_tokens")).drop("row")
