"""Lexicon operators: mode choice (C03), percentile poles (C04), vocabulary
filter (C05) and similarity seeds (C11).

A lexicon is a DataFrame ``(dim, word, score, ord)`` unique on ``(dim, word)``;
``ord`` is the lexicon order. Several dimensions are handled at once with
``dim`` as a grouping key. Lexicons are curated word lists: their size does
not grow with the story corpus.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lexicon_modes(lex: DataFrame) -> DataFrame:
    """``(dim, unipolar)``; unipolar when the lexicon has one distinct score."""
    return lex.groupBy("dim").agg((F.count_distinct("score") == 1).alias("unipolar"))


def percentile_bounds(lex: DataFrame, low: float = 0.25, high: float = 0.75) -> DataFrame:
    """Exact percentiles with linear interpolation over the lexicon scores."""
    return lex.groupBy("dim").agg(
        F.percentile(F.col("score"), F.lit(low)).alias("lb"),
        F.percentile(F.col("score"), F.lit(high)).alias("ub"),
    )


def poles(lex: DataFrame, vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """C04 + C05: low (score <= p25) and high (score >= p75) pole words that
    have a vector. Presence is tested on the word as written; the vector is
    fetched for the lower-cased word.

    Returns two DataFrames ``(dim, word, ord, vec)``.
    """
    b = percentile_bounds(lex)
    lx = lex.join(F.broadcast(b), "dim")
    present = vectors.select(F.col("word").alias("_w"))
    fetched = vectors.select(F.col("word").alias("_lw"), F.col("vec"))

    def side(cond):
        s = lx.filter(cond).join(present, F.col("word") == F.col("_w"), "left_semi")
        s = s.join(fetched, F.lower(F.col("word")) == F.col("_lw"))
        # fresh attribute ids: the two poles share lineage and are joined later
        return s.select("dim", "word", "ord", "vec").toDF("dim", "word", "ord", "vec")

    return side(F.col("score") <= F.col("lb")), side(F.col("score") >= F.col("ub"))


def seeds(lex: DataFrame, vectors: DataFrame) -> DataFrame:
    """C11: lexicon words with score >= p75 whose lower-cased form has a vector.
    Returns ``(dim, word, ord, vec)``."""
    b = percentile_bounds(lex)
    hi = lex.join(F.broadcast(b), "dim").filter(F.col("score") >= F.col("ub"))
    fetched = vectors.select(F.col("word").alias("_lw"), F.col("vec"))
    return hi.join(fetched, F.lower(F.col("word")) == F.col("_lw")).select("dim", "word", "ord", "vec")


def dedupe_last_wins(lex: DataFrame, order_col: str = "ord") -> DataFrame:
    """Keep one row per (dim, word): the score of the last occurrence, at the
    position of the first one (the order a Python dict keeps)."""
    from pyspark.sql import Window

    w = Window.partitionBy("dim", "word")
    last = F.max_by(F.col("score"), F.col(order_col)).over(w)
    first = F.min(F.col(order_col)).over(w)
    return (
        lex.select("dim", "word", last.alias("score"), first.alias("ord"), F.col(order_col).alias("_o"))
        .filter(F.col("_o") == F.col("ord"))
        .drop("_o")
    )
