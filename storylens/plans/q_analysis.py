"""Queries for the comparative analysis."""

from __future__ import annotations

from pyspark.sql import functions as F

from storylens.constants import ATTR_METHODS, BOOTSTRAP_RESAMPLES, DIMENSIONS
from storylens.operators import analysis as N
from storylens.operators import matched as M
from storylens.operators.analysis import LABEL_COLS
from storylens.plans import common as C
from storylens.plans.oracle_fixtures import with_ctes
from storylens.plans.q_score import grid_sql
from storylens.plans.registry import query
from storylens.plans.sqlparts import SQL_Z, sql_t_p
from storylens.sources import fixtures as fx

BEST = "CASE WHEN dim IN ('appearance', 'intellect') THEN 'sim' ELSE 'axis' END"
LABELS = ["TP-M", "TP-F", "FP", "SP", "Other"]
SEED = M.DEFAULT_SEED


def zsql(body: str, more: list[tuple[str, str]] | None = None) -> str:
    return grid_sql(body, [("z", SQL_Z)] + (more or []))


def _info(spark, sf):
    return fx.story_info(spark, sf)


# --- N01-N04: POV cross-tabs -----------------------------------------------------

SQL_CROSSTAB = "SELECT writer AS \"group\", p_pov, " + ", ".join(
    f"NULLIF(count(*) FILTER (WHERE s_pov = '{l}'), 0) / count(*) AS {LABEL_COLS[l]}" for l in LABELS
) + " FROM fx_stories WHERE s_pov IS NOT NULL AND p_pov IS NOT NULL GROUP BY writer, p_pov"


@query("n01_pov_crosstab", with_ctes(["fx_stories"], SQL_CROSSTAB), floats=[LABEL_COLS[x] for x in LABELS])
def n01(spark, sf):
    """Share of each story POV inside each prompt POV, per writer group;
    a missing combination is null."""
    return N.pov_crosstab(_info(spark, sf))


@query("n02_stack_writers", with_ctes(["fx_stories"], """
SELECT writer AS "group", s_pov, count(*) AS n FROM fx_stories GROUP BY writer, s_pov"""))
def n02(spark, sf):
    """The two writers' story tables stacked with a group label."""
    info = _info(spark, sf)
    h = info.filter(F.col("writer") == "human").withColumn("group", F.lit("human"))
    m = info.filter(F.col("writer") == "gpt-3.5").withColumn("group", F.lit("gpt-3.5"))
    return h.unionByName(m).groupBy("group", "s_pov").agg(F.count(F.lit(1)).alias("n"))


@query("n03_prompts_per_pov", with_ctes(["fx_stories"], """
SELECT writer, p_pov, count(DISTINCT p_ind) AS n_prompts FROM fx_stories GROUP BY writer, p_pov
UNION ALL
SELECT writer, NULL AS p_pov, CAST(sum(n) AS BIGINT) AS n_prompts
FROM (SELECT writer, p_pov, count(DISTINCT p_ind) AS n FROM fx_stories GROUP BY writer, p_pov) GROUP BY writer"""))
def n03(spark, sf):
    """Distinct prompts per prompt POV and their sum over POVs."""
    return N.prompts_per_pov(_info(spark, sf)).withColumn("n_prompts", F.col("n_prompts").cast("bigint"))


@query("n04_pov_report", with_ctes(["fx_stories"], f"SELECT * FROM ({SQL_CROSSTAB}) ORDER BY p_pov DESC, \"group\" DESC"),
       floats=[LABEL_COLS[x] for x in LABELS])
def n04(spark, sf):
    """The cross-tab ordered by prompt POV and group, both descending."""
    return N.pov_report(_info(spark, sf))


# --- N05-N07 -----------------------------------------------------------------------

@query("n06_zscores", zsql("SELECT writer, s_id, dim, am, sm, z_score FROM z"), floats=["z_score"])
def n06(spark, sf):
    """Pooled z-score per (dim, am, sm) over both writers, population std."""
    return C.grid_z(spark, sf).select("writer", "s_id", "dim", "am", "sm", "z_score")


@query("n07_histograms", zsql("""
SELECT writer, dim, am, sm, kind, CAST(least(floor((x - lo) * 10 / (hi - lo)) + 1, 10) AS INTEGER) AS bin, count(*) AS cnt
FROM (SELECT v.*, CASE WHEN r.lo = r.hi THEN r.lo - 0.5 ELSE r.lo END AS lo, CASE WHEN r.lo = r.hi THEN r.hi + 0.5 ELSE r.hi END AS hi
      FROM v JOIN (SELECT writer, dim, am, sm, kind, min(x) AS lo, max(x) AS hi FROM v GROUP BY ALL) r
      USING (writer, dim, am, sm, kind))
GROUP BY ALL""", [("v", """
SELECT writer, dim, am, sm, 'z' AS kind, round_even(z_score, 9) AS x FROM z WHERE z_score IS NOT NULL
UNION ALL SELECT writer, dim, am, sm, 'raw' AS kind, round_even(score, 9) AS x FROM z WHERE score IS NOT NULL""")]))
def n07(spark, sf):
    """10 equal bins over each writer's own range, z and raw scores."""
    return N.histograms(C.grid_z(spark, sf))


def _bootstrap_sql(src: str, keys: str, seed: int) -> str:
    """Bootstrap intervals of ``src`` (keys, _k: row key as text, _v), for groups
    of one block."""
    k = keys.split(", ")
    same = " AND ".join(f"x.{c} IS NOT DISTINCT FROM d.{c}" for c in k)
    return f"""
SELECT {", ".join("m." + c for c in k)}, m.mean, m.n, c.ci_lo, c.ci_hi
FROM (SELECT {keys}, avg(_v) AS mean, count(*) AS n FROM ({src}) GROUP BY {keys}) m
LEFT JOIN (
  SELECT {keys}, quantile_cont(_m, 0.025) AS ci_lo, quantile_cont(_m, 0.975) AS ci_hi FROM (
    SELECT {", ".join("d." + c for c in k)}, d.r, avg(x._v) AS _m FROM (
      SELECT {keys}, s.r, u * s.a % {M.PRIME} % n AS i FROM ({_numbered_sql(src, keys, seed)}) CROSS JOIN stream s WHERE s.r >= 1) d
    JOIN ({_numbered_sql(src, keys, seed)}) x ON x.i = d.i AND {same}
    GROUP BY {", ".join("d." + c for c in k)}, d.r) GROUP BY {keys}) c
ON {" AND ".join(f"c.{c} = m.{c}" for c in k)}"""


def _numbered_sql(src: str, keys: str, seed: int) -> str:
    """Rows of one block: number stream seed ``u``, place ``i`` and rows ``n``."""
    return f"""
SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY u, _k) - 1 AS i, count(*) OVER (PARTITION BY {keys}) AS n
FROM (SELECT {keys}, _k, _v, 1 + CAST('0x' || substr(md5(_k || ':{seed}'), 1, 7) AS BIGINT) AS u FROM ({src}))"""


SQL_STREAM = ("stream(r, a)", f"""
SELECT CAST(0 AS BIGINT), CAST(1 AS BIGINT) UNION ALL
SELECT r + 1, a * {M.STEP} % {M.PRIME} FROM stream WHERE r < {BOOTSTRAP_RESAMPLES}""")


@query("n08_bootstrap_intervals", zsql(_bootstrap_sql(f"""
SELECT dim, am, sm, s_pov, writer, concat_ws('|', writer, s_id) AS _k, z_score AS _v FROM z
WHERE z_score IS NOT NULL AND ((am = 'all' AND sm = 'avg') OR (am IN ('comet', 'sub') AND sm = {BEST}))""",
    "dim, am, sm, s_pov, writer", M.DEFAULT_SEED), [SQL_STREAM]), floats=["mean", "ci_lo", "ci_hi"])
def n08(spark, sf):
    """Mean and 95 % bootstrap interval (1000 resamples of n of n) by
    (dim, am, sm, POV, writer) for all/avg, comet/best and sub/best z-scores."""
    return M.pov_writer_intervals(C.grid_z(spark, sf, parts=[(["all"], [(d, "avg") for d in DIMENSIONS]), (["comet", "sub"], C.BEST)]))


# --- N09-N17: correlations, t-tests, tables -------------------------------------

def _sp_sql(src: str, keys: str) -> str:
    return f"""
SELECT {keys}, count(*) AS n,
       CASE WHEN var_pop(rx) > 0 AND var_pop(ry) > 0 THEN corr(rx, ry) END AS sp_corr
FROM (SELECT {keys},
             rank() OVER (PARTITION BY {keys} ORDER BY x) + (count(*) OVER (PARTITION BY {keys}, x) - 1) / 2.0 AS rx,
             rank() OVER (PARTITION BY {keys} ORDER BY y) + (count(*) OVER (PARTITION BY {keys}, y) - 1) / 2.0 AS ry
      FROM (SELECT * REPLACE (round_even(x, 9) AS x, round_even(y, 9) AS y) FROM ({src})
            WHERE x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)))
GROUP BY {keys}"""


@query("n09_method_agreement", zsql(_sp_sql(f"""
SELECT a.dim, a.am, a.s_id, a.score AS x, b.score AS y FROM z a JOIN z b
  ON b.writer = a.writer AND b.s_id = a.s_id AND b.dim = a.dim AND b.am = a.am
WHERE a.writer = 'human' AND a.sm = 'avg' AND b.sm = {BEST.replace('dim', 'b.dim')}""", "dim, am")),
       floats=["sp_corr"])
def n09(spark, sf):
    """Spearman between the avg and the best score method, human stories."""
    return N.method_agreement(C.grid_scores(spark, sf, parts=[(ATTR_METHODS, [(d, "avg") for d in DIMENSIONS] + C.BEST)]))


def _n10_src(x: str, y: str) -> str:
    return f"""
SELECT a.dim, a.sm, '{x}-{y}' AS pair, a.s_id, a.score AS x, b.score AS y FROM z a JOIN z b
  ON b.s_id = a.s_id AND b.writer = a.writer AND b.dim = a.dim AND b.sm = a.sm
WHERE a.writer = 'human' AND a.dim IN ('appearance', 'intellect') AND a.sm IN ('avg', 'sim')
  AND a.am = '{x}' AND b.am = '{y}'"""


@query("n10_attr_method_agreement", zsql(" UNION ALL ".join(
    f"SELECT * FROM ({_sp_sql(_n10_src(x, y), 'dim, sm, pair')})"
    for x, y in (("all", "sub"), ("all", "comet"), ("sub", "comet")))), floats=["sp_corr"])
def n10(spark, sf):
    """Spearman between attribute methods for appearance and intellect."""
    return N.attr_method_agreement(C.grid_z(spark, sf, dims=["appearance", "intellect"], sms=["avg", "sim"])).select("dim", "sm", "pair", "n", "sp_corr")


def _t_sql(where: str, gcol: str, a: str, b: str) -> str:
    return f"""
SELECT dim, am, n1, n2,
       CASE WHEN n1 + n2 - 2 > 0 AND n1 > 0 AND n2 > 0 AND ((n1 - 1) * v1 + (n2 - 1) * v2) > 0
            THEN (m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1.0 / n1 + 1.0 / n2)) END AS t,
       CAST(n1 + n2 - 2 AS DOUBLE) AS dof
FROM (SELECT dim, am,
             count(*) FILTER (WHERE {gcol} = '{a}') AS n1, avg(z_score) FILTER (WHERE {gcol} = '{a}') AS m1,
             var_samp(z_score) FILTER (WHERE {gcol} = '{a}') AS v1,
             count(*) FILTER (WHERE {gcol} = '{b}') AS n2, avg(z_score) FILTER (WHERE {gcol} = '{b}') AS m2,
             var_samp(z_score) FILTER (WHERE {gcol} = '{b}') AS v2
      FROM z WHERE z_score IS NOT NULL AND sm = {BEST} {where} GROUP BY dim, am)"""


@query("n11_ttest_writers", zsql(_t_sql("", "writer", "human", "gpt-3.5")), floats=["t", "dof"])
def n11(spark, sf):
    """Equal-variance t-test, human vs machine z-scores at the best method."""
    return N.ttest_writers(C.best_z(spark, sf, ATTR_METHODS))


SQL_PROMPT_MEANS = f"""
SELECT writer, dim, am, p_ind, avg(z_score) AS z_mean FROM z
WHERE z_score IS NOT NULL AND sm = {BEST} GROUP BY writer, dim, am, p_ind"""


@query("n12_prompt_means", zsql(SQL_PROMPT_MEANS), floats=["z_mean"])
def n12(spark, sf):
    """Per-prompt mean z-score per writer at the best method."""
    return N.prompt_means(C.best_z(spark, sf, ATTR_METHODS))


@query("n13_paired_ttest", zsql(f"""
SELECT dim, am, count(*) AS n,
       CASE WHEN count(*) > 1 AND stddev_samp(d) > 0 THEN avg(d) / (stddev_samp(d) / sqrt(count(*))) END AS t,
       CAST(count(*) - 1 AS DOUBLE) AS dof
FROM (SELECT h.dim, h.am, h.z_mean - m.z_mean AS d
      FROM ({SQL_PROMPT_MEANS}) h JOIN ({SQL_PROMPT_MEANS}) m
        ON m.dim = h.dim AND m.am = h.am AND m.p_ind = h.p_ind AND m.writer = 'gpt-3.5'
      WHERE h.writer = 'human')
GROUP BY dim, am"""), floats=["t", "dof"])
def n13(spark, sf):
    """Paired t-test of per-prompt means over prompts on both sides."""
    return N.paired_ttest(C.best_z(spark, sf, ATTR_METHODS))


@query("n14_ttest_female_male_human", zsql(_t_sql("AND writer = 'human'", "s_pov", "TP-F", "TP-M")),
       floats=["t", "dof"])
def n14(spark, sf):
    """TP-F vs TP-M t-test within human stories."""
    return N.ttest_female_male(C.best_z(spark, sf, ATTR_METHODS), "human")


@query("n15_ttest_female_male_machine", zsql(_t_sql("AND writer = 'gpt-3.5'", "s_pov", "TP-F", "TP-M")),
       floats=["t", "dof"])
def n15(spark, sf):
    """TP-F vs TP-M t-test within machine stories."""
    return N.ttest_female_male(C.best_z(spark, sf, ATTR_METHODS), "gpt-3.5")


def _table_sql(am: str, cell: bool = True) -> str:
    c = ", printf('%.2f (%.2f)', avg(z_score), stddev_samp(z_score)) AS cell" if cell else ""
    return zsql(f"""
SELECT dim, writer, s_pov, avg(z_score) AS z_mean, stddev_samp(z_score) AS z_std{c}
FROM z WHERE am = '{am}' AND sm = {BEST} AND s_pov IN ('TP-M', 'TP-F', 'FP', 'Other')
GROUP BY dim, writer, s_pov""")


@query("n16_pov_table_comet", _table_sql("comet"), floats=["z_mean", "z_std"])
def n16(spark, sf):
    """Mean and sample std of z by POV and writer at comet/best."""
    return N.pov_table(C.best_z(spark, sf), "comet")


@query("n17_pov_table_sub", _table_sql("sub"), floats=["z_mean", "z_std"])
def n17(spark, sf):
    """The same table at sub/best."""
    return N.pov_table(C.best_z(spark, sf, ["sub"]), "sub")


@query("p12_mean_std_cell", zsql(f"""
SELECT dim, writer, s_pov, printf('%.2f (%.2f)', avg(z_score), stddev_samp(z_score)) AS cell
FROM z WHERE am = 'comet' AND sm = {BEST} AND s_pov IN ('TP-M', 'TP-F', 'FP', 'Other')
GROUP BY dim, writer, s_pov"""))
def p12(spark, sf):
    """The ``mean (std)`` cell text with two decimals."""
    return N.pov_table(C.best_z(spark, sf), "comet").select("dim", "writer", "s_pov", "cell")


SQL_N11 = _t_sql("", "writer", "human", "gpt-3.5")


@query("u03_ttest_p_values", zsql("SELECT n.*, tp.p FROM n11 n JOIN tp USING (dim, am)",
                                  [("n11", SQL_N11), *sql_t_p("SELECT dim, am, t, dof FROM n11", "dim, am")]),
       floats=["t", "dof", "p"])
def u03(spark, sf):
    """Two-sided p-values of the N11 t statistics (t distribution by the
    incomplete beta function, a column expression)."""
    return N.with_p_value(N.ttest_writers(C.best_z(spark, sf, ATTR_METHODS)))


# --- N18-N26: matched sampling and control ---------------------------------------

def _draw(keys: str) -> str:
    return (f"row_number() OVER (PARTITION BY {keys}, trial ORDER BY "
            f"md5(concat_ws(':', s_id, CAST(trial AS VARCHAR), '{SEED}')), s_id)")


SQL_COMET_BEST = f"SELECT * FROM z WHERE am = 'comet' AND sm = {BEST} AND z_score IS NOT NULL"


def _sample_sql(keys: str, sel: str) -> str:
    return f"""
SELECT {keys}, avg(m) AS mean, avg(s) AS std FROM (
  SELECT {keys}, trial, avg(z_score) AS m, stddev_pop(z_score) AS s FROM (
    SELECT *, {_draw(keys)} AS rn FROM (
      SELECT *, unnest(range(1, 6)) AS trial FROM (
        SELECT *, count(*) OVER (PARTITION BY {keys}) AS n
        FROM (SELECT {sel}, s_id, z_score FROM ({SQL_COMET_BEST})))
      WHERE n >= 2))
  WHERE rn <= 2 GROUP BY {keys}, trial)
GROUP BY {keys}"""


POV_KEYS = "writer, dim, pov, pid"
PID_KEYS = "writer, dim, pid"
SQL_N18 = _sample_sql(POV_KEYS, "writer, dim, s_pov AS pov, p_ind AS pid")
SQL_N19 = _sample_sql(PID_KEYS, "writer, dim, p_ind AS pid")


@query("n18_sample_pov_prompt", zsql(SQL_N18), floats=["mean", "std"])
def n18(spark, sf):
    """5 draws of 2 stories per (POV, prompt) and writer; mean and
    population std per draw, averaged over draws (seeded hash order)."""
    base = M.comet_best(C.best_z(spark, sf)).withColumnRenamed("s_pov", "pov").withColumnRenamed("p_ind", "pid")
    return M.sample_group_stats(base, ["writer", "dim", "pov", "pid"], seed=SEED)


@query("n19_sample_prompt", zsql(SQL_N19), floats=["mean", "std"])
def n19(spark, sf):
    """The same sampling within prompts, POV ignored."""
    base = M.comet_best(C.best_z(spark, sf)).withColumnRenamed("p_ind", "pid")
    return M.sample_group_stats(base, ["writer", "dim", "pid"], seed=SEED)


def _match_sql(src: str, keys: list[str]) -> str:
    on = " AND ".join(f"m.{k} = h.{k}" for k in keys)
    ks = ", ".join(f"h.{k}" for k in keys)
    return f"""
SELECT {ks}, h.mean AS human_mean, h.std AS human_std, m.mean AS gpt_mean, m.std AS gpt_std,
       h.mean - m.mean AS mean_diff, h.std - m.std AS std_diff
FROM ({src}) h JOIN ({src}) m ON {on} AND m.writer = 'gpt-3.5'
WHERE h.writer = 'human' AND h.mean IS NOT NULL AND h.std IS NOT NULL AND m.mean IS NOT NULL AND m.std IS NOT NULL"""


SQL_N20 = _match_sql(SQL_N18, ["dim", "pov", "pid"])
SQL_N21 = _match_sql(SQL_N19, ["dim", "pid"])
MATCH_FLOATS = ["human_mean", "human_std", "gpt_mean", "gpt_std", "mean_diff", "std_diff"]


@query("n20_match_pov_prompt", zsql(SQL_N20), floats=MATCH_FLOATS)
def n20(spark, sf):
    """N20 + N21: writers matched on (POV, prompt), stacked over dims, with
    the human - machine differences."""
    return M.matched_differences(C.best_z(spark, sf), by_pov=True, seed=SEED)


@query("n21_match_prompt_differences", zsql(SQL_N21), floats=MATCH_FLOATS)
def n21(spark, sf):
    """N20 + N21 matched on prompt only: ``mean_diff``, ``std_diff``."""
    return M.matched_differences(C.best_z(spark, sf), by_pov=False, seed=SEED)


@query("n22_difference_summary", zsql(f"""
SELECT dim, pov, avg(mean_diff) AS diff_mean, stddev_samp(mean_diff) AS diff_std, count(*) AS n
FROM ({SQL_N20}) GROUP BY ROLLUP (dim, pov) HAVING dim IS NOT NULL"""), floats=["diff_mean", "diff_std"])
def n22(spark, sf):
    """Mean and sample std of the differences by (dim, POV) and by dim,
    one grouping-sets aggregation."""
    return M.difference_summary(M.matched_differences(C.best_z(spark, sf), by_pov=True, seed=SEED))


def _box_sql(keys: str, src: str, pov_null: bool) -> str:
    pov = ", NULL AS pov" if pov_null else ""
    return f"""
SELECT {keys}{pov}, q1, med, q3,
       min(mean_diff) FILTER (WHERE mean_diff >= q1 - 1.5 * (q3 - q1)) AS whisker_lo,
       max(mean_diff) FILTER (WHERE mean_diff <= q3 + 1.5 * (q3 - q1)) AS whisker_hi,
       count(*) FILTER (WHERE mean_diff < q1 - 1.5 * (q3 - q1) OR mean_diff > q3 + 1.5 * (q3 - q1)) AS n_outliers
FROM (SELECT d.*, b.q1, b.med, b.q3 FROM ({src}) d JOIN (
        SELECT {keys}, quantile_cont(mean_diff, 0.25) AS q1, quantile_cont(mean_diff, 0.5) AS med,
               quantile_cont(mean_diff, 0.75) AS q3 FROM ({src}) GROUP BY {keys}) b USING ({keys}))
GROUP BY {keys}, q1, med, q3"""


@query("n23_box_stats", zsql(f"{_box_sql('dim, pov', SQL_N20, False)} UNION ALL {_box_sql('dim', SQL_N21, True)}"),
       floats=["q1", "med", "q3", "whisker_lo", "whisker_hi"])
def n23(spark, sf):
    """Box-plot statistics of the matched differences by (dim, POV) and,
    for the prompt-matched table, by dim (``pov`` null)."""
    z = C.best_z(spark, sf)
    a = M.box_stats(M.matched_differences(z, by_pov=True, seed=SEED), ["dim", "pov"])
    b = M.box_stats(M.matched_differences(z, by_pov=False, seed=SEED), ["dim"]).withColumn(
        "pov", F.lit(None).cast("string"))
    return a.unionByName(b)


SQL_N24 = f"""
SELECT trial, dim, p_ind, s_id, z_score, CASE WHEN rn <= n // 2 THEN 1 ELSE 2 END AS half FROM (
  SELECT *, row_number() OVER (PARTITION BY trial, dim, p_ind ORDER BY
            md5(concat_ws(':', s_id, CAST(trial AS VARCHAR), '{SEED}')), s_id) AS rn
  FROM (SELECT *, unnest(range(1, 6)) AS trial FROM (
          SELECT dim, p_ind, s_id, z_score, count(*) OVER (PARTITION BY dim, p_ind) AS n
          FROM ({SQL_COMET_BEST}) WHERE writer = 'human')
        WHERE n >= 4))"""


@query("n24_split_halves", zsql(f"SELECT trial, dim, p_ind, s_id, half FROM ({SQL_N24})"))
def n24(spark, sf):
    """Prompts with >= 4 scored human stories, shuffled and split in halves."""
    return M.split_halves(C.best_z(spark, sf), seed=SEED).select(
        F.col("trial").cast("bigint"), "dim", "p_ind", "s_id", "half")


SQL_N25 = f"""
SELECT trial, dim, 'control' AS type, avg(h1 - h2) AS diff FROM (
  SELECT a.trial, a.dim, a.p_ind, a.zm AS h1, b.zm AS h2 FROM hm a JOIN hm b
    ON b.trial = a.trial AND b.dim = a.dim AND b.p_ind = a.p_ind AND b.half = 2 WHERE a.half = 1)
GROUP BY trial, dim
UNION ALL
SELECT a.trial, a.dim, 'gpt-3.5' AS type, avg(a.zm - m.mz) AS diff FROM hm a
JOIN (SELECT dim, p_ind, avg(z_score) AS mz FROM ({SQL_COMET_BEST}) WHERE writer = 'gpt-3.5' GROUP BY dim, p_ind) m
  ON m.dim = a.dim AND m.p_ind = a.p_ind
WHERE a.half = 1 GROUP BY a.trial, a.dim"""


SQL_HM = ("hm", f"""
SELECT trial, dim, p_ind, half, avg(z_score) AS zm FROM ({SQL_N24}) GROUP BY trial, dim, p_ind, half""")


@query("n25_control_differences", zsql(SQL_N25, [SQL_HM]),
       floats=["diff"])
def n25(spark, sf):
    """Per trial and dim, mean over prompts of half1 - half2 (control) and
    of half1 - machine."""
    return M.control_differences(C.best_z(spark, sf), seed=SEED).withColumn("trial", F.col("trial").cast("bigint"))


@query("n26_trial_summary", zsql(_bootstrap_sql(
    f"SELECT dim, type, CAST(trial AS VARCHAR) AS _k, diff AS _v FROM ({SQL_N25}) WHERE diff IS NOT NULL", "dim, type", SEED),
    [SQL_STREAM, SQL_HM]), floats=["mean", "ci_lo", "ci_hi"])
def n26(spark, sf):
    """Mean and bootstrap interval of the N25 differences per (dim, type)."""
    return M.trial_summary(M.control_differences(C.best_z(spark, sf), seed=SEED))


# --- score files: S12 sink -> S11 scan -> N05 attach ----------------------------

def _grid_roundtrip(spark, sf, drop_missing: bool):
    import uuid

    from storylens.session import shared_dir
    from storylens.sources import io

    g = C.grid_scores(spark, sf).select(
        "writer", "dim", "am", "sm", F.col("p_ind").cast("int"), F.col("s_ind").cast("int"), "score")
    if drop_missing:
        g = g.filter(F.col("score").isNotNull())
    else:  # the score files hold nan where a method has no scorable word
        g = g.withColumn("score", F.coalesce("score", F.lit(float("nan"))))
    path = shared_dir(spark, f"scores-{uuid.uuid4().hex}")
    io.write_score_grid(g, path, fmt="csv")
    roots = {w: f"{path}/writer={w}" for w in ("human", "gpt-3.5")}
    return io.read_score_grid(spark, roots, layout="hive")


@query("s12_s11_score_files_roundtrip", zsql("""
SELECT writer, dim, am, sm, CAST(p_ind AS INTEGER) AS p_ind, CAST(s_ind AS INTEGER) AS s_ind, s_id, score FROM z"""),
       floats=["score"])
def s12_s11(spark, sf):
    """S12 then S11: the grid written one folder per (writer, dim, am, sm)
    with ``nan`` for missing scores, read back with coordinates from the
    paths (NaN folded to null)."""
    return _grid_roundtrip(spark, sf, drop_missing=False)


@query("n05_attach_scores", zsql("SELECT writer, s_id, p_ind, s_ind, s_pov, dim, am, sm, score FROM z"),
       floats=["score"])
def n05(spark, sf):
    """Every story of the info table kept for every coordinate, scores
    attached from score files that hold only the scored rows (unscored ->
    null)."""
    scores = _grid_roundtrip(spark, sf, drop_missing=True)
    info = _info(spark, sf).select("writer", "s_id", "p_ind", "s_ind", "s_pov")
    return N.attach_scores(info, scores)
