"""Queries for the evaluation of score methods."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from storylens.operators import evaluate as X
from storylens.plans.oracle_fixtures import with_ctes
from storylens.plans.q_analysis import _sp_sql
from storylens.plans.registry import query
from storylens.plans.sqlparts import SQL_PAIRS, _unit, sql_axis, sql_t_p
from storylens.session import shared_dir
from storylens.sources import fixtures as fx
from storylens.sources import io

SQL_SPLIT = """
SELECT dim, trial, word, score, ord, CASE WHEN rn <= (n * 3 + 9) // 10 THEN 'test' ELSE 'train' END AS part FROM (
  SELECT dim, word, score, ord, trial,
         row_number() OVER (PARTITION BY dim, trial ORDER BY md5(concat_ws(':', word, CAST(42 + trial AS VARCHAR))), word) AS rn,
         count(*) OVER (PARTITION BY dim, trial) AS n
  FROM (SELECT *, unnest(range(1, 6)) AS trial FROM fx_lexicon))"""

EVAL_BASE = [
    ("vecs", "SELECT word, CAST(vec AS DOUBLE[]) AS vec FROM fx_vocab"),
    ("split", SQL_SPLIT),
    ("sp", "SELECT * FROM split WHERE word IN (SELECT word FROM vecs)"),
]


def _lex(spark, sf):
    return fx.lexicon(spark, sf)


@query("x01_train_test_split", with_ctes(["fx_lexicon"], "SELECT dim, trial, word, part FROM split",
                                        [("split", SQL_SPLIT)]))
def x01(spark, sf):
    """30 % test part per (dim, trial) by a seeded hash shuffle; the seed
    varies by trial."""
    return X.train_test_split(_lex(spark, sf)).select("dim", "trial", "word", "part")


@query("x02_oov_filter", with_ctes(["fx_lexicon", "fx_vocab"], "SELECT dim, trial, part, word FROM sp", EVAL_BASE))
def x02(spark, sf):
    """Both parts restricted to words with a vector, after the split."""
    return X.in_vocabulary(X.train_test_split(_lex(spark, sf)), fx.vectors(spark, sf)).select(
        "dim", "trial", "part", "word")


SQL_X03 = [
    ("ub", "SELECT dim, trial, quantile_cont(score, 0.75) AS ub FROM sp WHERE part = 'train' GROUP BY dim, trial"),
    ("seeds", f"""SELECT s.dim, s.trial, {_unit('v.vec')} AS u FROM sp s JOIN ub USING (dim, trial)
JOIN vecs v ON v.word = lower(s.word) WHERE s.part = 'train' AND s.score >= ub.ub"""),
    ("cen", """SELECT dim, trial, list(c ORDER BY i) AS centroid FROM (
  SELECT dim, trial, i, avg(x) AS c FROM (SELECT dim, trial, unnest(u) AS x, unnest(range(len(u))) AS i FROM seeds)
  GROUP BY dim, trial, i) GROUP BY dim, trial"""),
    ("pred_sim", f"""SELECT s.dim, s.trial, s.word, s.score AS x, list_dot_product({_unit('v.vec')}, c.centroid) AS y
FROM sp s JOIN vecs v ON v.word = lower(s.word) JOIN cen c USING (dim, trial) WHERE s.part = 'test'"""),
]


@query("x03_eval_sim", with_ctes(["fx_lexicon", "fx_vocab"], f"""
SELECT dim, trial, 'sim' AS method, n, sp_corr FROM ({_sp_sql('SELECT * FROM pred_sim', 'dim, trial')})""",
                                EVAL_BASE + SQL_X03), floats=["sp_corr"])
def x03(spark, sf):
    """The sim method on held-out words, Spearman per (dim, trial)."""
    split = X.in_vocabulary(X.train_test_split(_lex(spark, sf)), fx.vectors(spark, sf))
    return X.eval_sim(split, fx.vectors(spark, sf))


def _axis_eval_ctes(contrast: bool, name: str):
    ctes = [
        ("bnd", """SELECT dim, trial, quantile_cont(score, 0.25) AS lb, quantile_cont(score, 0.75) AS ub
FROM sp WHERE part = 'train' GROUP BY dim, trial"""),
        ("poles", """
SELECT s.dim || '#' || CAST(s.trial AS VARCHAR) AS dim, 'low' AS side, s.word, s.ord, v.vec
FROM sp s JOIN bnd b USING (dim, trial) JOIN vecs v ON v.word = lower(s.word) WHERE s.part = 'train' AND s.score <= b.lb
UNION ALL
SELECT s.dim || '#' || CAST(s.trial AS VARCHAR) AS dim, 'high' AS side, s.word, s.ord, v.vec
FROM sp s JOIN bnd b USING (dim, trial) JOIN vecs v ON v.word = lower(s.word) WHERE s.part = 'train' AND s.score >= b.ub"""),
        ("upoles", f"SELECT dim, side, word, ord, vec, {_unit('vec')} AS u FROM poles"),
    ]
    if contrast:
        ctes += SQL_PAIRS
    ctes += sql_axis(name, contrast)
    den = "sqrt(list_dot_product(v.vec, v.vec)) * sqrt(list_dot_product(a.axis, a.axis))"
    ctes += [(f"pred_{name}", f"""
SELECT s.dim, s.trial, s.word, s.score AS x,
       CASE WHEN list_dot_product(v.vec, v.vec) > 0 AND list_dot_product(a.axis, a.axis) > 0
            THEN list_dot_product(v.vec, a.axis) / ({den}) ELSE 0.0 END AS y
FROM sp s JOIN vecs v ON v.word = lower(s.word)
JOIN {name}_vec a ON a.dim = s.dim || '#' || CAST(s.trial AS VARCHAR) WHERE s.part = 'test'""")]
    return ctes


@query("x04_eval_axis", with_ctes(["fx_lexicon", "fx_vocab"], f"""
SELECT dim, trial, 'axis_with_con' AS method, n, sp_corr FROM ({_sp_sql('SELECT * FROM pred_axc', 'dim, trial')})""",
                                 EVAL_BASE + _axis_eval_ctes(True, "axc"), recursive=True), floats=["sp_corr"])
def x04(spark, sf):
    """The axis method with contrast pairs on held-out words."""
    split = X.in_vocabulary(X.train_test_split(_lex(spark, sf)), fx.vectors(spark, sf)).checkpoint()
    return X.eval_axis(split, fx.vectors(spark, sf), use_contrast=True)


@query("x04_eval_axis_no_contrast", with_ctes(["fx_lexicon", "fx_vocab"], f"""
SELECT dim, trial, 'axis_no_con' AS method, n, sp_corr FROM ({_sp_sql('SELECT * FROM pred_axn', 'dim, trial')})""",
                                             EVAL_BASE + _axis_eval_ctes(False, "axn")), floats=["sp_corr"])
def x04n(spark, sf):
    """The axis method without contrast pairs on held-out words."""
    split = X.in_vocabulary(X.train_test_split(_lex(spark, sf)), fx.vectors(spark, sf))
    return X.eval_axis(split, fx.vectors(spark, sf), use_contrast=False)


def _p_sql(src: str) -> tuple[str, list[tuple[str, str]]]:
    """Rows of ``src`` (dim, trial, method, n, sp_corr) with their p-values."""
    t = """SELECT dim, method, trial, sp_corr * sqrt((n - 2) / (1 - sp_corr * sp_corr)) AS t, CAST(n - 2 AS DOUBLE) AS dof
FROM ev WHERE abs(sp_corr) < 1 AND n > 2"""
    body = """SELECT ev.dim, ev.trial, ev.method, ev.n, ev.sp_corr, CASE WHEN abs(ev.sp_corr) >= 1 THEN 0.0 ELSE tp.p END AS sp_p
FROM ev LEFT JOIN tp USING (dim, method, trial)"""
    return body, [("ev", src), *sql_t_p(t, "dim, method, trial")]


SQL_SIM = f"SELECT dim, trial, 'sim' AS method, n, sp_corr FROM ({_sp_sql('SELECT * FROM pred_sim', 'dim, trial')})"
P_SIM, P_SIM_CTES = _p_sql(SQL_SIM)


@query("x05_spearman_p_values", with_ctes(["fx_lexicon", "fx_vocab"], P_SIM, EVAL_BASE + SQL_X03 + P_SIM_CTES, recursive=True),
       floats=["sp_corr", "sp_p"])
def x05(spark, sf):
    """Spearman correlation with its two-sided p (t distribution, n-2
    d.f.) for the sim method."""
    split = X.in_vocabulary(X.train_test_split(_lex(spark, sf)), fx.vectors(spark, sf))
    return X.with_spearman_p(X.eval_sim(split, fx.vectors(spark, sf)))


P_ALL, P_ALL_CTES = _p_sql(f"""{SQL_SIM}
UNION ALL SELECT dim, trial, 'axis_with_con' AS method, n, sp_corr FROM ({_sp_sql('SELECT * FROM pred_axc', 'dim, trial')})
UNION ALL SELECT dim, trial, 'axis_no_con' AS method, n, sp_corr FROM ({_sp_sql('SELECT * FROM pred_axn', 'dim, trial')})""")
_AXN = [c for c in _axis_eval_ctes(False, "axn") if c[0] not in ("bnd", "poles", "upoles")]


@query("x06_s16_method_trials", with_ctes(
    ["fx_lexicon", "fx_vocab"], P_ALL, EVAL_BASE + SQL_X03 + _axis_eval_ctes(True, "axc") + _AXN + P_ALL_CTES, recursive=True),
    floats=["sp_corr", "sp_p"])
def x06(spark, sf):
    """X06 + S16: all methods x 5 trials x dims, written one folder per
    (dim, method) and read back."""
    res = X.evaluate_methods(_lex(spark, sf), fx.vectors(spark, sf))
    path = shared_dir(spark, f"eval-{uuid.uuid4().hex}")
    io.write_eval_results(res, path)
    return spark.read.parquet(path).select("dim", "method", "trial", "n", "sp_corr", "sp_p")


__all__ = ["F"]
