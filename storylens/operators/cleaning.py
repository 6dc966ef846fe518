"""Cleaning, projection and filters (P01-P13) as DataFrame -> DataFrame steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storylens.constants import GENERATION_INSTRUCTION, GENERATION_ROLE, POV_LABEL_MAP
from storylens.functions import text as T
from storylens.functions.indexing import sequential_index


def clean_prompts(df: DataFrame, col: str = "prompt") -> DataFrame:
    """Strip ``[ WP ]``-style tags and trim."""
    return df.withColumn(col, T.strip_tags(col))


def combine(df: DataFrame, prompt: str = "prompt", story: str = "story", out: str = "line") -> DataFrame:
    """``prompt <endprompt> story``."""
    return df.withColumn(out, T.combine_prompt_story(prompt, story))


def index_stories(lines: DataFrame) -> DataFrame:
    """Group stories by prompt in first-seen order.

    ``(line_no, prompt, story)`` -> ``(p_ind, s_ind, prompt, story, line_no)``.
    ``p_ind`` numbers prompts by their first line; ``s_ind`` numbers a
    prompt's stories by line. Both come from dense global indexes over a
    range-partitioned sort (no window over one prompt), so a prompt holding a
    third of all lines is still numbered by many tasks.
    """
    firsts = lines.groupBy("prompt").agg(F.min("line_no").alias("first_line"))
    p = sequential_index(firsts, ["first_line"], "p_ind").select("prompt", "p_ind")
    g = sequential_index(lines.select("prompt", "line_no"), ["prompt", "line_no"], "_g")
    g0 = g.groupBy("prompt").agg(F.min("_g").alias("_g0")).join(p, "prompt")
    s = g.join(g0, "prompt").select("line_no", (F.col("_g") - F.col("_g0")).alias("s_ind"), "p_ind")
    return lines.join(s, "line_no").select("p_ind", "s_ind", "prompt", "story", "line_no")


def prompt_window(df: DataFrame, start: int, window: int) -> DataFrame:
    """Prompts ``start .. start + window - 1``."""
    return df.filter(F.col("p_ind").between(start, start + window - 1))


def truncate_story(df: DataFrame, col: str = "story", out: str | None = None) -> DataFrame:
    """P05 then P06: word-limit truncation, then newline markers to line breaks."""
    return df.withColumn(out or col, T.normalise_newlines(T.truncate_words(col)))


def generation_requests(prompts: DataFrame, done: DataFrame | None, start: int, window: int) -> DataFrame:
    """``(p_ind, role, full_prompt)`` for not-yet-done prompts of the window."""
    w = prompt_window(prompts, start, window)
    if done is not None:
        w = w.join(done.select("p_ind"), "p_ind", "left_anti")
    return w.select(
        "p_ind",
        F.lit(GENERATION_ROLE).alias("role"),
        F.concat(F.lit(GENERATION_INSTRUCTION), F.trim("prompt")).alias("full_prompt"),
    )


def with_story_id(df: DataFrame) -> DataFrame:
    """``s_id = p-s``."""
    return df.withColumn("s_id", T.story_id("p_ind", "s_ind"))


def project_info(df: DataFrame) -> DataFrame:
    """The four info columns used before merging."""
    return df.select("p_ind", "s_ind", "s_id", "s_pov")


def drop_missing(df: DataFrame, cols: list[str]) -> DataFrame:
    """P10: drop rows with a missing value (NaN counts as missing) in `cols`."""
    out = df
    for c in cols:
        dt = dict(df.dtypes)[c]
        if dt in ("double", "float"):
            out = out.withColumn(c, F.nanvl(F.col(c), F.lit(None).cast(dt)))
    return out.dropna(subset=cols)


def map_pov_label(df: DataFrame, col: str = "pov", out: str = "s_pov") -> DataFrame:
    """Rule label -> analysis label (male TP-M, female TP-F, first FP,
    second SP, unknown Other)."""
    expr = None
    for k, v in POV_LABEL_MAP.items():
        expr = F.when(F.col(col) == k, F.lit(v)) if expr is None else expr.when(F.col(col) == k, F.lit(v))
    return df.withColumn(out, expr)
