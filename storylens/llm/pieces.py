"""SentencePiece encoding and decoding by a distinct-chunk table.

No piece of the model has a whitespace marker after another character, so no
merge crosses the start of a marker run: each distinct marked word of an
Arrow batch is segmented and decoded once by the library, and ids and texts
are joined back by position. The table stays with its task from batch to
batch and is bounded. A model whose pieces do cross markers is applied to
whole texts. One pass, no shuffle.

Null texts count as empty ones: no ids, empty decoded text. Every input row,
repeated ones too, keeps its columns; ``piece_ids`` and ``decoded_text`` are
replaced, and one called ``__pieces`` is lost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storylens.llm import tokenizers as T
from storylens.llm.common import prepare

# Words that a task's table holds before it starts anew, and their length.
TABLE_WORDS = 300_000
WORD_CHARS = 256


class _Chunks:
    """Word -> (ids as text, number of ids, decoded text)."""

    def __init__(self, model: str):
        self.model, self.sp, self.table = model, T.piece_model(model), {}

    def segment(self, words) -> dict:
        """Entries for ``words``, each distinct new one segmented once."""
        if len(self.table) > TABLE_WORDS:
            self.table = {}
        table = self.table
        new = list(dict.fromkeys(w for w in words if w not in table))
        ids = T.piece_ids(self.model, new)
        got = {w: (",".join(map(str, x)), len(x), d)
               for w, x, d in zip(new, ids, self.sp.decode(ids) if ids else [], strict=True)}
        table.update((w, v) for w, v in got.items() if len(w) <= WORD_CHARS)
        return table if len(got) <= TABLE_WORDS and all(len(w) <= WORD_CHARS for w in new) else {**table, **got}

    def texts(self, texts: list[str]) -> list[tuple[str, int, str]]:
        """Per text: ids joined by commas, their number, decoded text."""
        if not T.splits_at_markers(self.model):
            ids = [self.sp.encode(t) for t in texts]
            return [(",".join(map(str, x)), len(x), self.sp.decode(x)) for x in ids]
        split = [T.marked_words(t) for t in texts]
        table = self.segment(dict.fromkeys(w for words in split for w in words))
        out = []
        for words in split:
            rows = [table[w] for w in words]
            out.append((",".join([r[0] for r in rows]), sum([r[1] for r in rows]), " ".join([r[2] for r in rows])))
        return out


def encoded(text: Column, model: str = T.PIECE_MODEL) -> Column:
    """Struct ``ids`` (array of int), ``decoded`` (string) of a text column."""

    @F.pandas_udf("ids array<int>, decoded string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        chunks = _Chunks(model)
        for s in batches:
            rows = chunks.texts([t or "" for t in s])
            yield pd.DataFrame({"ids": [[int(i) for i in r[0].split(",")] if r[0] else [] for r in rows],
                                "decoded": [r[2] for r in rows]})

    return run.asNondeterministic()(text)


def digests(text: Column, model: str = T.PIECE_MODEL) -> Column:
    """Struct ``n_tokens, ids_sha256, decoded_sha256`` of a text column."""

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        chunks = _Chunks(model)
        for s in batches:
            rows = chunks.texts([t or "" for t in s])
            yield pd.DataFrame({
                "n_tokens": [r[1] for r in rows],
                "ids_sha256": [hashlib.sha256(r[0].encode()).hexdigest() for r in rows],
                "decoded_sha256": [hashlib.sha256(r[2].encode()).hexdigest() for r in rows]})

    return run.asNondeterministic()(text)


def encode(docs: DataFrame, model: str = T.PIECE_MODEL) -> DataFrame:
    """``docs`` with ``piece_ids`` and ``decoded_text``."""
    prepare(docs.sparkSession)
    e = docs.withColumn("__pieces", encoded(F.col("text"), model))
    return e.withColumn("piece_ids", F.col("__pieces.ids")).withColumn(
        "decoded_text", F.col("__pieces.decoded")).drop("__pieces")
