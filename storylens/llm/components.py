"""Connected components of an edge table by alternating large and small
stars: every round links each node's neighbours to its smallest one, with
grouped minima and joins; rounds are written tables, and the number of rounds
grows with the logarithm of the longest path."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storylens.llm.common import staged


def _are_stars(edges: DataFrame) -> bool:
    """True if every node has one link down at most, and none has one both up
    and down: then each component is a star around its smallest node."""
    ends = edges.select(F.col("a").alias("x"), F.lit(1).alias("down")).union(
        edges.select(F.col("b").alias("x"), F.lit(0).alias("down")))
    found = ends.groupBy("x").agg(F.sum("down").alias("down"), F.count("*").alias("n"))
    return found.where("down > 1 or (down = 1 and n > 1)").isEmpty()


def _linked(edges: DataFrame, only_larger: bool) -> DataFrame:
    """Neighbours b of each node a, linked to the smallest of them and a."""
    least = edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
    near = edges.join(least, edges["a"] == least["k"])
    if only_larger:
        return near.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return near.select(F.col("b").alias("a"), F.col("m").alias("b")).union(
        least.select(F.col("k").alias("a"), F.col("m").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` (its smallest node) of each node of ``edges`` (a, b)
    that is not the smallest of its own component."""
    now = staged(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(),
                 "edges")
    while not _are_stars(now):
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _linked(both, True).where("a != b")
        now = staged(_linked(large, False).where("a > b").distinct(), "edges")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
