"""Corpus pipeline: ``run(spark, sf_dir)`` applies ``STAGES`` to ``documents``,
each written as Parquet and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storylens.llm import decontaminate, pieces, quality, simhash, suffix_dedup
from storylens.llm.common import prepare, staged, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def by_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    docs = docs.select(*COLUMNS)
    model = quality.fit(docs, quality.training_labels(table(spark, sf_dir, "labels")))
    return quality.scored(docs, model).where(F.col("quality_score") >= quality.ACCEPT).select(*COLUMNS)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of SimHash near-duplicates."""
    return simhash.deduplicated(docs.select(*COLUMNS)).select(*COLUMNS)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes that repeat strings of earlier documents. A
    document of which nothing is left goes; one that was empty stays."""
    cut = suffix_dedup.cut_repeats(docs.select(*COLUMNS), ["lang", "source", "n_chars"])
    cut = cut.where("n_removed < n_bytes or n_removed = 0")
    n_chars = F.when(F.col("n_removed") == 0, F.col("own_n_chars")).otherwise(F.char_length("kept"))
    return cut.select("doc_id", F.col("kept").alias("text"), F.col("own_lang").alias("lang"),
                      F.col("own_source").alias("source"), n_chars.cast("long").alias("n_chars"))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    found = decontaminate.contamination(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))
    return found.where(~F.col("contamination.contaminated")).select(*COLUMNS)


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each kept document."""
    prepare(spark)
    return pieces.encode(docs.select(*COLUMNS)).select(*COLUMNS, "piece_ids", "decoded_text")


STAGES = [
    ("quality", by_quality),
    ("near-copies", without_near_copies),
    ("repeats", without_repeats),
    ("decontamination", decontaminated),
    ("sentencepiece", tokenized),
]

# The stages learn a classifier and sort suffixes; SQL has no words for them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
