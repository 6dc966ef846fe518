"""Shared plan pieces for registered queries: fixture inputs, attribute
tables, the score grid and z-scores, plus output rounding."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from storylens.constants import ATTR_METHODS, BEST_SM, DIMENSIONS, SCORE_METHODS
from storylens.operators import attrs as A
from storylens.operators.analysis import zscores
from storylens.operators.score import blank_meaningless, coordinates, score_stories
from storylens.session import shared_dir
from storylens.sources import fixtures as fx

DIGITS = 6


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Round every floating column half-to-even (results are compared across
    engines; the DuckDB twins use ``round_even``)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (DoubleType, FloatType)):
            cols.append(F.bround(F.col(f.name).cast("double"), digits).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def attr_tables(spark: SparkSession, sf: str, ams: list[str] = ATTR_METHODS, exploded: bool = True) -> list[DataFrame]:
    """``(s_key, am, attr)`` of each requested attribute method, or unexploded ``(s_key, am, attrs)``."""
    parts = []
    if "all" in ams:
        parts.append(("all", A.all_attrs(fx.stories(spark, sf), exploded=exploded)))
    if "sub" in ams:
        parts.append(("sub", A.sub_attrs_from_sentences(
            fx.parser_input(spark, sf), fx.FIXTURE_PROTAGONIST, fx._sentence_parser, exploded)))
    if "comet" in ams:
        parts.append(("comet", A.normalise_phrases(fx.phrases(spark, sf), exploded=exploded)))
    return [p.select("s_key", F.lit(am).alias("am"), "attr" if exploded else "attrs") for am, p in parts]


def attrs_for(spark: SparkSession, sf: str, ams: list[str] = ATTR_METHODS) -> DataFrame:
    """``(s_key, am, attr)`` for the requested attribute methods."""
    out, *more = attr_tables(spark, sf, ams)
    for p in more:
        out = out.unionByName(p)
    return out


# The best score method of each dimension.
BEST = [(d, BEST_SM[d]) for d in DIMENSIONS]


def grid_scores(spark: SparkSession, sf: str, dims=DIMENSIONS, ams=ATTR_METHODS, sms=SCORE_METHODS,
                use_contrast: bool = True, blank: bool = True, parts: list | None = None) -> DataFrame:
    """C14 over the fixture stories with P11 applied:
    ``(s_key, p_ind, s_ind, writer, s_id, s_pov, p_pov, am, dim, sm, score)``.

    ``parts``: ``(ams, [(dim, sm), ...])``, the coordinates that are asked for;
    others are not computed. The score table is the analysis input: written
    once, as Parquet by (am, sm) in the shared folder, and read by every later
    step, which prunes partitions and columns."""
    asked = parts or [(list(ams), coordinates(list(dims), list(sms)))]
    stories, lex = fx.stories(spark, sf), fx.lexicon(spark, sf)
    path = shared_dir(spark, f"grid-{uuid.uuid4().hex}")
    for own, coords in asked:
        vec = fx.vectors(spark, sf) if any(m in ("axis", "sim") for _, m in coords) else None
        attrs = attr_tables(spark, sf, own, exploded=False)
        s = score_stories(stories, attrs, lex, vec, ams=own, use_contrast=use_contrast, coords=coords)
        s = blank_meaningless(s) if blank else s
        s.write.partitionBy("am", "sm").mode("append").parquet(path)
    return spark.read.schema(s.schema).parquet(path).select(*s.columns)


def grid_z(spark: SparkSession, sf: str, **kw) -> DataFrame:
    return zscores(grid_scores(spark, sf, **kw))


def best_z(spark: SparkSession, sf: str, ams=("comet",)) -> DataFrame:
    """Z-scores at each dimension's best method. They are pooled inside a
    coordinate, so other coordinates are not needed."""
    return grid_z(spark, sf, parts=[(list(ams), BEST)])
