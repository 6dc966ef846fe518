"""Point of view.

Input contract: ``mentions(s_key, cluster_id, mention_no, start, end, surface)``
from a coreference model (cluster order = ``cluster_id``), and a pronoun
table ``(cls, surface)`` with classes first, second, male, female. Everything
is aggregation and joins; the pronoun table is a handful of rows (broadcast).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storylens.constants import POV_PRONOUNS, WORD_LIMIT
from storylens.functions.text import strip_ws, whitespace_words


def pronoun_table(spark: SparkSession, variant: str = "extended", lists: dict | None = None) -> DataFrame:
    """``(cls, surface)`` rows for a pronoun variant (or explicit lists)."""
    lists = lists or POV_PRONOUNS[variant]
    rows = [(cls, w) for cls, words in lists.items() for w in words]
    return spark.createDataFrame(rows, "cls string, surface string")


def largest_cluster(mentions: DataFrame) -> DataFrame:
    """``(s_key, cluster_id, n)``: the cluster with most mentions, the
    first one (lowest id) on a tie. Stories without clusters have no row."""
    sizes = mentions.groupBy("s_key", "cluster_id").agg(F.count(F.lit(1)).alias("n"))
    best = sizes.groupBy("s_key").agg(
        F.max_by(F.struct("cluster_id", "n"), F.struct(F.col("n"), -F.col("cluster_id"))).alias("b")
    )
    return best.select("s_key", F.col("b.cluster_id").alias("cluster_id"), F.col("b.n").alias("n"))


def mention_surfaces(tokens: DataFrame, mentions: DataFrame) -> DataFrame:
    """Surface of each mention = tokens ``start..end`` (inclusive) joined
    by one space, plus the half-open span (``(s, s)`` for one token, else
    ``(s, e + 1)``). A story's tokens and its spans are one row each; they meet
    on the story, and each span is sliced out of the token array by its offsets
    (stories whose positions have gaps are searched instead). A mention without
    tokens has an empty surface."""
    # positions and words as two plain lists in the same order, half the bytes of a list of
    # structs; a token without a position or a word is in no surface
    t = tokens.filter(F.col("pos").isNotNull() & F.col("text").isNotNull()).groupBy("s_key").agg(
        F.collect_list("pos").alias("_p"), F.collect_list("text").alias("_w"))
    t = t.select("s_key", F.array_sort(F.arrays_zip(F.col("_p").alias("pos"), F.col("_w").alias("text"))).alias("_t"))
    spans = mentions.groupBy("s_key").agg(
        F.collect_list(F.struct("cluster_id", "mention_no", "start", "end")).alias("_m"))
    first, last = F.col("_t")[0]["pos"], F.element_at("_t", -1)["pos"]
    g = spans.join(t, "s_key", "left").withColumn("_dense", F.size("_t") == last - first + 1).withColumn("_first", first).select(
        "s_key", "_t", "_dense", "_first", F.explode("_m").alias("_s")).select(
        "s_key", "_t", "_dense", "_first", "_s.*")
    # a span may begin before the first token or end after the last
    at = F.greatest(F.col("start") - F.col("_first"), F.lit(0))
    many = F.greatest(F.col("end") - F.greatest("start", "_first") + 1, F.lit(0))
    sliced = F.slice("_t", (at + 1).cast("int"), many.cast("int"))
    searched = F.filter("_t", lambda x: x["pos"].between(F.col("start"), F.col("end")))
    g = g.withColumn("_t", F.when(F.col("_dense"), sliced).otherwise(F.coalesce(searched, F.array())))
    return g.select(
        "s_key", "cluster_id", "mention_no", "start", "end",
        F.array_join(F.col("_t.text"), " ").alias("surface"),
        F.col("start").alias("span_start"),
        F.when(F.col("start") == F.col("end"), F.col("start")).otherwise(F.col("end") + 1).alias("span_end"),
    )


def pov_labels(units: DataFrame, mentions: DataFrame, pronouns: DataFrame, key: str = "s_key") -> DataFrame:
    """The POV rule over the largest cluster of each unit.

    With n mentions: first_person if first-person mentions > n div 2; else
    second_person likewise; else male if a male and no female pronoun occurs;
    else female in the mirrored case; else unknown. Whole-mention, case-
    sensitive matches. Units without clusters are unknown.
    """
    m = mentions.withColumnRenamed(key, "_k") if key != "_k" else mentions
    big = largest_cluster(m.withColumnRenamed("_k", "s_key")).withColumnRenamed("s_key", "_k")
    lm = m.join(big.select("_k", "cluster_id"), ["_k", "cluster_id"])
    lm = lm.join(F.broadcast(pronouns), "surface", "left")
    agg = lm.groupBy("_k").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("cls") == "first").alias("n_first"),
        F.count_if(F.col("cls") == "second").alias("n_second"),
        F.max((F.col("cls") == "male").cast("int")).alias("has_male"),
        F.max((F.col("cls") == "female").cast("int")).alias("has_female"),
    )
    half = F.floor(F.col("n") / 2)
    label = (
        F.when(F.col("n_first") > half, "first_person")
        .when(F.col("n_second") > half, "second_person")
        .when((F.col("has_male") == 1) & (F.coalesce(F.col("has_female"), F.lit(0)) == 0), "male")
        .when((F.col("has_female") == 1) & (F.coalesce(F.col("has_male"), F.lit(0)) == 0), "female")
        .otherwise("unknown")
    )
    lab = agg.select("_k", label.alias("pov"))
    u = units.select(F.col(key).alias("_k")).distinct()
    return u.join(lab, "_k", "left").select(
        F.col("_k").alias(key), F.coalesce(F.col("pov"), F.lit("unknown")).alias("pov")
    )


def cached_pov(stories: DataFrame, cache: DataFrame, label: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Reuse a cached label when the prompt (or space + prompt) is in the
    cache and the cached story at the same index equals this story after
    stripping; the others alone, truncated, go to ``label``.

    stories: ``(s_key, prompt, s_ind, story)``; cache: ``(prompt, s_ind, story, pov)``;
    label: ``(s_key, story)`` -> ``(s_key, pov)``, V04 on the text it gets.
    Returns ``(s_key, pov, source)``.
    """
    keys = cache.select(F.col("prompt").alias("_ck")).distinct()
    st = stories.join(keys.withColumnRenamed("_ck", "prompt").withColumn("_exact", F.lit(True)), "prompt", "left")
    st = st.join(
        keys.select(F.col("_ck").alias("_sp")).withColumn("_spaced", F.lit(True)),
        F.concat(F.lit(" "), F.col("prompt")) == F.col("_sp"), "left",
    )
    st = st.withColumn(
        "_key", F.when(F.col("_exact"), F.col("prompt")).when(F.col("_spaced"), F.concat(F.lit(" "), F.col("prompt")))
    )
    c = cache.select(F.col("prompt").alias("_key"), "s_ind", F.col("story").alias("_cstory"), F.col("pov").alias("_cpov"))
    j = st.join(c, ["_key", "s_ind"], "left")
    hit = F.col("_cstory").isNotNull() & (strip_ws(F.col("story")) == strip_ws(F.col("_cstory")))
    j = j.select("s_key", "story", "_cpov", hit.alias("_hit"))
    found = j.filter(F.col("_hit")).select("s_key", F.col("_cpov").alias("pov"), F.lit("cache").alias("source"))
    misses = j.filter(~F.col("_hit")).select("s_key", truncated_for_pov(F.col("story")).alias("story"))
    computed = label(misses).select(F.col("s_key").alias("_k"), "pov")
    fresh = misses.join(computed, F.col("s_key") == F.col("_k"), "left").select(
        "s_key", F.coalesce("pov", F.lit("unknown")).alias("pov"), F.lit("computed").alias("source"))
    return found.unionByName(fresh)


def truncated_for_pov(col) -> "F.Column":
    """The story text the fallback labels: first 500 whitespace words."""
    w = whitespace_words(col)
    return F.when(F.size(w) > WORD_LIMIT, F.array_join(F.slice(w, 1, WORD_LIMIT), " ")).otherwise(col)
