"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storylens.session import ensure_checkpoint_dir, ship_package
from storylens.sources.tables import read_table

# Rows of one Arrow batch: a batch of long texts must fit in a worker.
BATCH_ROWS = 512


def prepare(spark: SparkSession) -> None:
    """Checkpoint folder, package on the workers, bounded Arrow batches."""
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return read_table(spark, sf_dir, name)


def texts(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` with null texts as empty ones. Other columns are left
    behind, so their names cannot clash with a result's. A doc_id that is text
    is read as a whole number; one that is none is an error."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text"), F.lit("")).alias("text"))


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the folder all executors share and read it again: cuts
    lineage, and a lost executor takes nothing with it."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc_remainder(doc_id: Column, mod: int) -> Column:
    """crc32(doc_id as text) mod ``mod``; a null id counts as the text ''."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(mod))


def crc_sql(number: str) -> str:
    """DuckDB SQL for the unsigned crc32 of a number as text, bit by bit."""
    return (f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({number}::VARCHAR, ''), "
            "lambda c: ascii(c)::BIGINT)), lambda s, c: list_reduce([xor(s, c), 0, 0, 0, 0, 0, 0, 0, 0], "
            "lambda v, b: xor(v >> 1, CASE WHEN v % 2 = 1 THEN 3988292384 ELSE 0 END))), 4294967295)")
