"""Annotate stories with a caller-supplied model.

``annotate`` hands Arrow batches of ``(s_key, text)`` to a function.
``annotate_with_model`` also manages the model: it is loaded once in each Python
worker, not once a task or a row, and kept while the worker lives; stories are
sent to it in batches of similar length, whose padded size is bounded; a story on
which it fails does not take its batch along; and the stage can ask for
resources (a GPU) that the rest of the job does not need.

A story that fails yields no rows (or one row with the error, if asked for),
and the replacement step (A07) turns it into ``''``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.resource import ResourceProfile
from pyspark.sql import DataFrame
from pyspark.sql.types import _parse_datatype_string

TOKENS_SCHEMA = "s_key long, sent_id int, pos int, text string, tag string, dep string, head_pos int"
MENTIONS_SCHEMA = "s_key long, cluster_id int, mention_no int, start int, end int, surface string"
ENTITIES_SCHEMA = "s_key long, text string, label string"

# Characters that a task gathers before it makes batches of them, and of a
# batch with all its texts padded to the longest.
GATHER_CHARS = 1 << 22
BATCH_CHARS = 1 << 18

# Models of this worker process, by name.
_LOADED: dict = {}


def annotate(stories: DataFrame, fn: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]],
             schema: str, text_col: str = "text", profile: ResourceProfile | None = None) -> DataFrame:
    """Run `fn` over batches of ``(s_key, text)`` in every task."""
    return stories.select("s_key", stories[text_col].alias("text")).mapInPandas(fn, schema, profile=profile)


def loaded(name: str, load: Callable[[], object]) -> object:
    """The worker's model of that name, loaded on first use."""
    if name not in _LOADED:
        _LOADED[name] = load()
    return _LOADED[name]


def length_batches(rows: list[tuple[object, str]], most: int) -> Iterator[list[tuple[object, str]]]:
    """Rows (key, text) by length, in batches of at most ``most`` characters
    with padding; a longer text is a batch by itself."""
    batch: list[tuple[object, str]] = []
    for row in sorted(rows, key=lambda r: len(r[1])):
        if batch and (len(batch) + 1) * len(row[1]) > most:
            yield batch
            batch = []
        batch.append(row)
    if batch:
        yield batch


def _tried(model, run, batch: list[tuple[object, str]]) -> Iterator[tuple[object, list[tuple] | None, str | None]]:
    """Key, rows and error of each story; if a batch fails, its halves are
    tried, so one bad story costs a logarithm of calls."""
    try:
        got = run(model, [t for _, t in batch])
        if len(got) != len(batch):
            raise ValueError(f"{len(got)} results for {len(batch)} stories")
        for (key, _), rows in zip(batch, got, strict=True):
            yield key, rows, None
    except Exception as e:  # whatever the model raises
        if len(batch) == 1:
            yield batch[0][0], None, f"{type(e).__name__}: {e}"
            return
        half = len(batch) // 2
        yield from _tried(model, run, batch[:half])
        yield from _tried(model, run, batch[half:])


def annotate_with_model(stories: DataFrame, name: str, load: Callable[[], object],
                        run: Callable[[object, list[str]], list[list[tuple]]], schema: str, text_col: str = "text",
                        batch_chars: int = BATCH_CHARS, gather_chars: int = GATHER_CHARS, error_col: str | None = None,
                        profile: ResourceProfile | None = None) -> DataFrame:
    """Rows of ``schema`` (``s_key`` first) of each story. ``load()`` makes the
    model, ``run(model, texts)`` gives for each text a list of rows without the
    key. Null texts are empty ones. With ``error_col`` there is one more column:
    a story that fails has one row, of its key and the error alone."""
    fields = _parse_datatype_string(schema + (f", {error_col} string" if error_col else "")).fields
    names = [f.name for f in fields]
    width = len(names) - 1 - bool(error_col)

    def annotated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        model = loaded(name, load)
        types = [to_arrow_type(f.dataType) for f in fields]

        def made(rows):
            for batch in length_batches(rows, batch_chars):
                out = []
                for key, got, error in _tried(model, run, batch):
                    tail = (None,) if error_col else ()
                    out += [(key, *r, *tail) for r in got or ()]
                    if error is not None and error_col:
                        out.append((key, *[None] * width, error))
                columns = list(zip(*out, strict=True)) or [[] for _ in names]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

        held, size = [], 0
        for b in batches:
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                held.append((key, text or ""))
                size += len(held[-1][1])
                if size >= gather_chars:
                    yield from made(held)
                    held, size = [], 0
        yield from made(held)

    out = schema + (f", {error_col} string" if error_col else "")
    return stories.select("s_key", stories[text_col].alias("text")).mapInArrow(annotated, out, profile=profile)
