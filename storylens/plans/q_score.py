"""Queries for lexicon and vector scoring (C01-C12, C14) and the score
blanking / missing-value steps (P10, P11)."""

from __future__ import annotations

from pyspark.sql import functions as F

from storylens.constants import ATTR_METHODS, SCORE_METHODS
from storylens.functions.vectors import unit as unit_vec
from storylens.operators import cleaning as P
from storylens.operators import lexicon as L
from storylens.operators import score as S
from storylens.operators.pairing import contrast_pairs, nearest_partners
from storylens.plans import common as C
from storylens.plans.oracle_fixtures import with_ctes
from storylens.plans.registry import query
from storylens.plans.sqlparts import (
    SQL_ATTRS_ALL,
    SQL_ATTRS_COMET,
    SQL_ATTRS_SUB,
    SQL_E02,
    SQL_E03,
    SQL_E03_ANC,
    SQL_E06,
    SQL_PAIRS,
    SQL_SIM_BASE,
    SQL_VECTOR_BASE,
    SQL_VFOUND,
    sql_avg_scores,
    sql_axis,
    sql_vector_scores,
    sql_word_scores,
)
from storylens.sources import fixtures as fx

GRADED = ["valence", "arousal", "dominance", "power"]
UNIPOLAR = ["appearance", "intellect"]
LEX_FX = ["fx_stories", "fx_lexicon"]


def _in(xs):
    return ", ".join(f"'{x}'" for x in xs)


def _story_scores(spark, sf, dims, sms, ams=("all",), use_contrast=True):
    s = C.grid_scores(spark, sf, dims=dims, ams=list(ams), sms=sms, use_contrast=use_contrast, blank=False)
    return s.select("writer", "s_id", "am", "dim", "sm", "score")


@query("c01_lexicon_avg_graded", with_ctes(LEX_FX, f"""
SELECT writer, s_id, am, dim, sm, score FROM scores WHERE dim IN ({_in(GRADED)})""",
                                          [("attrs", SQL_ATTRS_ALL), *sql_avg_scores(["all"])]), floats=["score"])
def c01(spark, sf):
    """Mean lexicon score of the found attributes (graded lexicons),
    0 when none is found; attribute lower-cased, lexicon key as is."""
    return _story_scores(spark, sf, GRADED, ["avg"])


@query("c02_lexicon_density_unipolar", with_ctes(LEX_FX, f"""
SELECT writer, s_id, am, dim, sm, score FROM scores WHERE dim IN ({_in(UNIPOLAR)})""",
                                                [("attrs", SQL_ATTRS_ALL), *sql_avg_scores(["all"])]), floats=["score"])
def c02(spark, sf):
    """Unipolar lexicons: missing words count as 0 (a density), empty -> 0."""
    return _story_scores(spark, sf, UNIPOLAR, ["avg"])


@query("c03_lexicon_modes", with_ctes(["fx_lexicon"], "SELECT dim, count(DISTINCT score) = 1 AS unipolar FROM fx_lexicon GROUP BY dim"))
def c03(spark, sf):
    """Unipolar when a lexicon has exactly one distinct score."""
    return L.lexicon_modes(fx.lexicon(spark, sf))


@query("c04_percentile_poles", with_ctes(["fx_lexicon"], """
SELECT b.dim, b.lb, b.ub, count(*) FILTER (WHERE l.score <= b.lb) AS n_low, count(*) FILTER (WHERE l.score >= b.ub) AS n_high
FROM (SELECT dim, quantile_cont(score, 0.25) AS lb, quantile_cont(score, 0.75) AS ub FROM fx_lexicon GROUP BY dim) b
JOIN fx_lexicon l ON l.dim = b.dim GROUP BY b.dim, b.lb, b.ub"""), floats=["lb", "ub"])
def c04(spark, sf):
    """Exact p25/p75 with linear interpolation, and the pole sizes."""
    lex = fx.lexicon(spark, sf)
    b = L.percentile_bounds(lex)
    j = lex.join(F.broadcast(b), "dim")
    return j.groupBy("dim", "lb", "ub").agg(
        F.count_if(F.col("score") <= F.col("lb")).alias("n_low"),
        F.count_if(F.col("score") >= F.col("ub")).alias("n_high"),
    )


@query("c05_pole_vocabulary", with_ctes(["fx_lexicon", "fx_vocab"], "SELECT dim, side, word FROM poles",
                                       SQL_VECTOR_BASE[:3]))
def c05(spark, sf):
    """Pole words that have a vector (presence as written, fetch lower-cased)."""
    low, high = L.poles(fx.lexicon(spark, sf), fx.vectors(spark, sf))
    return low.select("dim", F.lit("low").alias("side"), "word").unionByName(
        high.select("dim", F.lit("high").alias("side"), "word"))


@query("c06_nearest_high_word", with_ctes(["fx_lexicon", "fx_vocab"], """
SELECT dim, low_word, high_word, sim FROM (
  SELECT l.dim, l.word AS low_word, h.word AS high_word, list_dot_product(l.u, h.u) AS sim,
         row_number() OVER (PARTITION BY l.dim, l.word ORDER BY list_dot_product(l.u, h.u) DESC, h.ord DESC) AS rk
  FROM upoles l JOIN upoles h ON h.dim = l.dim AND h.side = 'high' WHERE l.side = 'low') WHERE rk = 1""",
                                          SQL_VECTOR_BASE), floats=["sim"])
def c06(spark, sf):
    """Cosine of low x high pole words, reduced to each low word's most
    similar high word inside a blocked matrix product (no pair rows)."""
    low, high = L.poles(fx.lexicon(spark, sf), fx.vectors(spark, sf))
    best = nearest_partners(low.select("dim", F.col("ord").alias("cidx"), "vec"),
                            high.select("dim", F.col("ord").alias("pidx"), "vec"))
    return (
        best.join(low.select("dim", F.col("ord").alias("cidx"), F.col("word").alias("low_word")), ["dim", "cidx"])
        .join(high.select("dim", F.col("ord").alias("pidx"), F.col("word").alias("high_word")), ["dim", "pidx"])
        .select("dim", "low_word", "high_word", "sim")
    )


@query("c07_contrast_pairs", with_ctes(["fx_lexicon", "fx_vocab"], "SELECT dim, low_word, high_word, sim FROM pairs",
                                      SQL_VECTOR_BASE + SQL_PAIRS, recursive=True), floats=["sim"])
def c07(spark, sf):
    """Greedy contrast pairs, exact, in parallel proposal rounds."""
    low, high = L.poles(fx.lexicon(spark, sf), fx.vectors(spark, sf))
    return contrast_pairs(low, high)


def _axis_rows(ax):
    return ax.select("dim", F.posexplode("axis").alias("i", "a")).select(
        "dim", F.col("i").cast("bigint").alias("i"), "a")


@query("c08_axis_contrast", with_ctes(["fx_lexicon", "fx_vocab"], "SELECT dim, i, a FROM axc",
                                     SQL_VECTOR_BASE + SQL_PAIRS + sql_axis("axc", True), recursive=True), floats=["a"])
def c08(spark, sf):
    """axis = mean(high partners) - mean(low partners), per element."""
    return _axis_rows(S.axes(fx.lexicon(spark, sf), fx.vectors(spark, sf), use_contrast=True))


@query("c09_axis_no_contrast", with_ctes(["fx_lexicon", "fx_vocab"], "SELECT dim, i, a FROM axn",
                                        SQL_VECTOR_BASE + sql_axis("axn", False)), floats=["a"])
def c09(spark, sf):
    """axis = mean(high pole) - mean(low pole), per element."""
    return _axis_rows(S.axes(fx.lexicon(spark, sf), fx.vectors(spark, sf), use_contrast=False))


def _vec_story_sql(sms, axis_name, contrast, ams=("all",), attrs_sql=SQL_ATTRS_ALL):
    extra = list(SQL_VECTOR_BASE)
    if contrast:
        extra += SQL_PAIRS
    if axis_name:
        extra += sql_axis(axis_name, contrast)
    if "sim" in sms:
        extra += SQL_SIM_BASE
    extra += sql_word_scores(axis_name, "sim" in sms)
    extra += [("attrs", attrs_sql), ("counts", "SELECT s_key, am, lower(attr) AS w, count(*) AS n FROM attrs GROUP BY s_key, am, lower(attr)"),
              ("vfound", SQL_VFOUND), ("vscores", sql_vector_scores(list(ams), sms))]
    return extra


@query("c10_axis_score", with_ctes(["fx_stories", "fx_lexicon", "fx_vocab"],
                                  "SELECT writer, s_id, am, dim, sm, score FROM vscores",
                                  _vec_story_sql(["axis"], "axc", True), recursive=True), floats=["score"])
def c10(spark, sf):
    """Mean cosine of the story's in-vocabulary attributes to the
    contrast axis; none -> null."""
    return _story_scores(spark, sf, list(fx_dims()), ["axis"])


@query("c11_sim_seeds", with_ctes(["fx_lexicon", "fx_vocab"], "SELECT dim, word FROM seeds",
                                 SQL_VECTOR_BASE[:2] + SQL_SIM_BASE[:1]))
def c11(spark, sf):
    """C11: lexicon words at or above p75 whose lower-cased form has a vector."""
    return L.seeds(fx.lexicon(spark, sf), fx.vectors(spark, sf)).select("dim", "word")


@query("c12_sim_score", with_ctes(["fx_stories", "fx_lexicon", "fx_vocab"],
                                 "SELECT writer, s_id, am, dim, sm, score FROM vscores",
                                 _vec_story_sql(["sim"], None, False)), floats=["score"])
def c12(spark, sf):
    """Mean over attributes of the mean cosine to all seeds, as
    unit(term) . centroid of unit seeds; no seed or no term -> null."""
    return _story_scores(spark, sf, list(fx_dims()), ["sim"])


def fx_dims():
    from storylens.constants import DIMENSIONS

    return DIMENSIONS


def grid_sql(body: str, after: list[tuple[str, str]] | None = None) -> str:
    attrs = (f"{SQL_ATTRS_ALL}\nUNION ALL {SQL_ATTRS_SUB.format(e02=SQL_E02, e03=SQL_E03)}"
             f"\nUNION ALL {SQL_ATTRS_COMET.format(e06=SQL_E06)}")
    extra = [("anc", SQL_E03_ANC)] + _vec_story_sql(["axis", "sim"], "axc", True, ATTR_METHODS, attrs)
    avg = sql_avg_scores(ATTR_METHODS)
    # the avg pieces reuse counts; drop their duplicate counts CTE
    avg = [(n, s) for n, s in avg if n != "counts"]
    avg = [(n if n != "scores" else "ascores", s) for n, s in avg]
    extra += avg
    extra += [("scores", """
SELECT s_key, p_ind, s_ind, writer, s_id, s_pov, p_pov, am, dim, sm,
       CASE WHEN dim IN ('appearance', 'intellect') AND sm = 'axis' THEN NULL ELSE score END AS score
FROM (SELECT * FROM ascores UNION ALL BY NAME SELECT * FROM vscores)""")]
    extra += after or []
    return with_ctes(["fx_stories", "fx_lexicon", "fx_vocab", "fx_tokens", "fx_phrases"], body, extra, recursive=True)


@query("c14_score_grid", grid_sql("SELECT writer, s_id, am, dim, sm, score FROM scores"), floats=["score"])
def c14(spark, sf):
    """C14: every story x 6 dims x 3 attribute methods x 3 score methods in one
    plan (P11 applied)."""
    s = C.grid_scores(spark, sf)
    return s.select("writer", "s_id", "am", "dim", "sm", "score")


@query("p11_blank_meaningless", grid_sql("""
SELECT dim, am, sm, count(*) AS n, count(score) AS n_scored FROM scores GROUP BY dim, am, sm"""))
def p11(spark, sf):
    """appearance/intellect x axis blanked for both writers; per-cell
    counts of rows and of non-null scores."""
    s = C.grid_scores(spark, sf)
    return s.groupBy("dim", "am", "sm").agg(F.count(F.lit(1)).alias("n"), F.count("score").alias("n_scored"))


@query("p10_drop_missing", grid_sql("SELECT writer, s_id, am, dim, sm, score FROM scores WHERE score IS NOT NULL"),
       floats=["score"])
def p10(spark, sf):
    """P10: rows with a missing (null or NaN) score dropped from the grid."""
    s = C.grid_scores(spark, sf).select("writer", "s_id", "am", "dim", "sm", "score")
    return P.drop_missing(s, ["score"])


__all__ = ["SCORE_METHODS", "unit_vec"]


@query("u02_vector_mean", """
SELECT label, CAST(i AS BIGINT) AS i, avg(CAST(x AS DOUBLE)) AS m
FROM (SELECT label, unnest(embedding) AS x, unnest(range(len(embedding))) AS i FROM embeddings)
GROUP BY label, i""", floats=["m"])
def u02(spark, sf):
    """Element-wise mean vector per label over the whole vector table
    (partial aggregation per element, no Python)."""
    from storylens.functions.vectors import vector_mean

    e = fx.read_table(spark, sf, "embeddings")
    vm = vector_mean(e.select("label", "embedding"), ["label"], "embedding", "m")
    return vm.select("label", F.posexplode("m").alias("i", "m")).select(
        "label", F.col("i").cast("bigint").alias("i"), "m")


@query("c13_score_method_choice", grid_sql("""
SELECT sm, dim, count(score) AS n_scored, count(*) AS n FROM scores WHERE am = 'all' GROUP BY sm, dim"""))
def c13(spark, sf):
    """Every score method name validated by the method check, then the
    scored and total story counts per (method, dim) of the all-token grid."""
    sms = [S.check_score_method(m) for m in SCORE_METHODS]
    g = C.grid_scores(spark, sf, ams=["all"], sms=sms)
    return g.groupBy("sm", "dim").agg(F.count("score").alias("n_scored"), F.count(F.lit(1)).alias("n"))
