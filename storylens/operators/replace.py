"""Character replacement.

Input contract: ``tokens(s_key, pos, text, dep)``, ``mentions(s_key,
cluster_id, mention_no, start, end, surface)`` (inclusive ends),
``entities(s_key, text, label)``.

A01-A03 are joins and aggregations. The rewrite (A04-A06) walks a story's
positions, where each step's jump depends on the previous one, so it runs
per story in ``mapInPandas``: one row per story holds its token array and its
surviving spans (a story is small and bounded; stories are spread over all
tasks). Inside, the per-position step is vectorised with numpy and the walk
itself is linear.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from storylens.constants import CHARACTER_PRONOUNS, PLACEHOLDER_PREFIX, POSSESSIVE_DEPS


def person_entities(entities: DataFrame) -> DataFrame:
    """Distinct PERSON entity texts per story."""
    return entities.filter(F.col("label") == "PERSON").select("s_key", "text").distinct()


def character_clusters(spark: SparkSession, mentions: DataFrame, entities: DataFrame,
                       variant: str = "narrow") -> DataFrame:
    """A02 + A03: clusters with a mention equal to a PERSON entity of the story
    or to a listed pronoun, numbered in cluster order from 0 with their
    placeholder ``Protagonist`` + chr(65 + n)."""
    pron = spark.createDataFrame([(w,) for w in CHARACTER_PRONOUNS[variant]], "surface string")
    chars = person_entities(entities).select("s_key", F.col("text").alias("surface"))
    by_entity = mentions.join(chars, ["s_key", "surface"], "left_semi").select("s_key", "cluster_id")
    by_pron = mentions.join(F.broadcast(pron), "surface", "left_semi").select("s_key", "cluster_id")
    keep = by_entity.unionByName(by_pron).distinct()
    # clusters per story are few: the window is per story
    w = Window.partitionBy("s_key").orderBy("cluster_id")
    ranked = keep.withColumn("letter_no", (F.row_number().over(w) - 1).cast("int"))
    return ranked.withColumn("label", F.concat(F.lit(PLACEHOLDER_PREFIX), F.char(F.lit(65) + F.col("letter_no"))))


# --- A04-A06: the walk -------------------------------------------------------------

def step_table(n: int, clusters: list[list[tuple[int, int]]]):
    """A04 for every position at once.

    clusters: surviving clusters in order, each a list of (start, end) spans
    in list order (inclusive ends). Returns (final position, cluster index
    or -1) for positions 0..n-1. Inside a cluster the first matching span
    decides: ``start <= p < end`` moves p to ``end``; a span with ``start == p``
    keeps p. Later clusters are tested at the moved position; the label is
    the first cluster that reached the final position.
    """
    size = n + 1
    for spans in clusters:
        for s, e in spans:
            size = max(size, s + 2, e + 2)
    cur = np.arange(n, dtype=np.int64)
    lab = np.full(n, -1, dtype=np.int64)
    labpos = np.full(n, -1, dtype=np.int64)
    for ci, spans in enumerate(clusters):
        target = np.full(size, -1, dtype=np.int64)
        for s, e in reversed(spans):  # earlier spans overwrite later ones
            if s < e:
                target[s:e] = e
            elif s >= 0:
                target[s] = s
        t = target[cur]
        m = t >= 0
        cur = np.where(m, t, cur)
        newer = m & (cur > labpos)
        lab = np.where(newer, ci, lab)
        labpos = np.where(newer, cur, labpos)
    return cur, lab


def rewrite(tokens: list[str], deps: list[str], clusters: list[list[tuple[int, int]]],
            labels: list[str]) -> str | None:
    """A05 + A06: the rewritten story, or None when a jump leaves the token
    array (the story fails)."""
    n = len(tokens)
    final, lab = step_table(n, clusters)
    out = []
    p = 0
    while p < n:
        if lab[p] >= 0:
            f = int(final[p])
            if f >= n:
                return None
            label = labels[int(lab[p])]
            out.append(label + "'s" if deps[f] in POSSESSIVE_DEPS else label)
            p = f + 1
        else:
            out.append(tokens[p])
            p += 1
    return " ".join(out) + "\n"


def _rewrite_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        texts = []
        for toks, deps, spans in zip(pdf["toks"], pdf["deps"], pdf["spans"]):
            toks = list(toks) if toks is not None else []
            deps = list(deps) if deps is not None else []
            by_cluster: dict[int, list] = {}
            labels: dict[int, str] = {}
            if spans is not None:
                for sp in spans:
                    by_cluster.setdefault(int(sp["letter_no"]), []).append(
                        (int(sp["mention_no"]), int(sp["start"]), int(sp["end"])))
                    labels[int(sp["letter_no"])] = sp["label"]
            order = sorted(by_cluster)
            clusters = [[(s, e) for _, s, e in sorted(by_cluster[c])] for c in order]
            try:
                texts.append(rewrite(toks, deps, clusters, [labels[c] for c in order]))
            except Exception:  # any failure of one story -> empty text (A07)
                texts.append(None)
        yield pd.DataFrame({"s_key": pdf["s_key"], "text": texts})


def _step_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        keys, poss, finals, labs = [], [], [], []
        for key, n, spans in zip(pdf["s_key"], pdf["n"], pdf["spans"]):
            by_cluster: dict[int, list] = {}
            if spans is not None:
                for sp in spans:
                    by_cluster.setdefault(int(sp["letter_no"]), []).append(
                        (int(sp["mention_no"]), int(sp["start"]), int(sp["end"])))
            order = sorted(by_cluster)
            clusters = [[(s, e) for _, s, e in sorted(by_cluster[c])] for c in order]
            final, lab = step_table(n, clusters)
            keys.append(np.full(n, key, dtype=np.int64))
            poss.append(np.arange(n, dtype=np.int32))
            finals.append(final.astype(np.int64))
            labs.append(np.array([order[i] if i >= 0 else -1 for i in lab], dtype=np.int32))
        if keys:
            yield pd.DataFrame({"s_key": np.concatenate(keys), "pos": np.concatenate(poss),
                                "final": np.concatenate(finals), "letter_no": np.concatenate(labs)})


def token_arrays(tokens: DataFrame) -> DataFrame:
    """Long tokens ``(s_key, pos, text, dep)`` -> ``(s_key, toks, deps)`` (one shuffle)."""
    toks = tokens.groupBy("s_key").agg(F.array_sort(F.collect_list(F.struct("pos", "text", "dep"))).alias("_t"))
    return toks.select("s_key", F.col("_t.text").alias("toks"), F.col("_t.dep").alias("deps"))


def _per_story(spark: SparkSession, tokens: DataFrame, mentions: DataFrame, entities: DataFrame, variant: str):
    """tokens: the long table, or already one row per story ``(s_key, toks, deps)``."""
    toks = tokens if "toks" in tokens.columns else token_arrays(tokens)
    return toks.join(_spans(spark, mentions, entities, variant, "label"), "s_key", "left")


def _spans(spark: SparkSession, mentions: DataFrame, entities: DataFrame, variant: str, *more: str) -> DataFrame:
    """``(s_key, spans)``: the spans of a story's character clusters."""
    cl = character_clusters(spark, mentions, entities, variant)
    return mentions.drop("surface").join(cl, ["s_key", "cluster_id"]).groupBy("s_key").agg(
        F.collect_list(F.struct("letter_no", *more, "mention_no", "start", "end")).alias("spans"))


def span_steps(spark: SparkSession, tokens: DataFrame, mentions: DataFrame, entities: DataFrame,
               variant: str = "narrow") -> DataFrame:
    """A04 as a table: ``(s_key, pos, final, letter_no)`` for every token
    position (``letter_no`` -1 when no cluster matches). Of a story's tokens the
    steps need their number alone."""
    sizes = (tokens.select("s_key", F.greatest(F.size("toks"), F.lit(0)).alias("n")) if "toks" in tokens.columns
             else tokens.groupBy("s_key").agg(F.count(F.lit(1)).cast("int").alias("n")))
    return sizes.join(_spans(spark, mentions, entities, variant), "s_key", "left").mapInPandas(
        _step_batches, "s_key long, pos int, final long, letter_no int")


def replace_characters(spark: SparkSession, stories: DataFrame, tokens: DataFrame, mentions: DataFrame,
                       entities: DataFrame, variant: str = "narrow") -> DataFrame:
    """``(s_key, text)`` for every story; failed or unannotated
    stories get ``''``.

    Token and span arrays are built with one shuffle each on ``s_key``; the two
    per-story rows join co-partitioned.
    """
    per_story = _per_story(spark, tokens, mentions, entities, variant)
    out = per_story.mapInPandas(_rewrite_batches, "s_key long, text string")
    return stories.select("s_key").join(out, "s_key", "left").select(
        "s_key", F.coalesce(F.col("text"), F.lit("")).alias("text"))
