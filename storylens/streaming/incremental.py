"""Resumable and incremental processing.

* T01: finished stories are skipped with a ``left_anti`` join on their key.
* T02: results are committed per micro-batch with Structured Streaming
  (file source, ``trigger(availableNow=True)``, ``foreachBatch``) to a commit
  log (``commits.py``). A batch writes a folder of its own, and one manifest
  makes it visible and names the source files it was made of. Files that a
  manifest names are done: a replayed batch, a run with a new checkpoint folder
  or another batch size adds only what is missing.
* T03: new story files are scored against static lexicon/vector word scores
  (prepared once, written to the shared folder) inside ``foreachBatch``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from storylens.constants import ATTR_METHODS, DIMENSIONS, SCORE_METHODS
from storylens.operators.attrs import all_attrs
from storylens.operators.score import score_with_table
from storylens.streaming.commits import CommitLog


def skip_finished(df: DataFrame, done: DataFrame, keys: tuple[str, ...] = ("writer", "p_ind")) -> DataFrame:
    """Rows whose key is not in the done list. The unit of work is a prompt of one writer."""
    return df.join(done.select(*keys).distinct(), list(keys), "left_anti")


def done_stories(spark: SparkSession, out_path: str, keys: tuple[str, ...] = ("writer", "p_ind", "s_ind")) -> DataFrame:
    """The done list of a job that does not stream, from a table that
    ``run_batches`` committed; empty if nothing is committed yet. A store that
    cannot be read raises."""
    schema = ", ".join(f"{k} {'string' if k == 'writer' else 'long'}" for k in keys)
    return CommitLog(spark, out_path).read(spark.createDataFrame([], schema).schema).distinct()


_FILE = "_source_file"


def committing_writer(log: CommitLog, fn: Callable[[DataFrame, int], DataFrame]):
    """A ``foreachBatch`` function for batches with their source file in
    ``_source_file``. Files that a commit names are left out, so a batch that is
    replayed after a crash between its commit and the checkpoint adds nothing,
    and one that crashed before its commit was never seen."""

    def write(batch: DataFrame, batch_id: int) -> None:
        # one row for each file of the batch
        files = [r[0] for r in batch.select(_FILE).distinct().collect()]
        done = log.done()
        new = [f for f in files if f not in done]
        if not new:
            return
        if len(new) < len(files):
            batch = batch.where(F.col(_FILE).isin(new))
        log.commit(log.write(fn(batch.drop(_FILE), batch_id)), new)

    return write


def run_batches(spark: SparkSession, source_path: str, schema: StructType | str, out_path: str,
                checkpoint_path: str, fn: Callable[[DataFrame, int], DataFrame],
                files_per_batch: int | None = None, fmt: str = "parquet") -> DataFrame:
    """Process every file of `source_path` that no commit of `out_path`
    names, batch by batch, and return the committed table. The checkpoint folder
    only spares finding out what is done: with a new one, or another batch size,
    nothing is added twice. An empty source, or one of empty files, gives an
    empty table of the columns of `fn`."""
    reader = spark.readStream.schema(schema).format(fmt)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    log = CommitLog(spark, out_path)
    q = (
        reader.load(source_path).select("*", F.col("_metadata.file_path").alias(_FILE)).writeStream
        .foreachBatch(committing_writer(log, fn))
        .option("checkpointLocation", checkpoint_path)
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    empty = spark.createDataFrame([], schema)
    return log.read(fn(empty, 0).schema)


def scoring_batch(word_scores: DataFrame, modes: DataFrame, dims=DIMENSIONS, sms=SCORE_METHODS):
    """The per-batch step: extract the all-token attributes of the new
    files' stories and score them against the static word-score table. The
    streaming checkpoint is the done list, so the step is a function of its
    batch alone: a replay writes the same rows, and nothing committed is read."""

    def fn(batch: DataFrame, batch_id: int) -> DataFrame:
        stories = batch.withColumn("s_key", F.col("s_key").cast("long"))
        attrs = all_attrs(stories).select("s_key", F.lit("all").alias("am"), "attr")
        keep = [c for c in stories.columns if c != "text"]
        return score_with_table(stories.select(*keep, "text"), attrs, word_scores, modes, list(dims), ["all"],
                                list(sms))

    return fn


__all__ = ["ATTR_METHODS", "committing_writer", "done_stories", "run_batches", "scoring_batch", "skip_finished"]
