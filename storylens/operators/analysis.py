"""Comparative analysis over the long score table.

Input shapes:
  info:   ``(writer, p_ind, s_ind, s_id, p_pov, s_pov)``
  scores: ``(writer, s_id, p_ind, s_ind, s_pov, dim, am, sm, score)``
  z:      scores + ``z_score`` (N06)

Every loop over dimensions/methods of the notebook is a grouping key here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storylens.constants import (
    ATTR_METHODS,
    BEST_SM,
    DIMENSIONS,
    POV_LABELS,
    POV_TABLE_LABELS,
    SCORE_METHODS,
)
from storylens.functions.stats import paired_t, spearman, t_p_value, two_sample_t
from storylens.functions.text import mean_std_cell
from storylens.session import ensure_checkpoint_dir

LABEL_COLS = {"TP-M": "tp_m", "TP-F": "tp_f", "FP": "fp", "SP": "sp", "Other": "other"}


def best_sm() -> Column:
    expr = None
    for d, sm in BEST_SM.items():
        expr = F.when(F.col("dim") == d, F.lit(sm)) if expr is None else expr.when(F.col("dim") == d, F.lit(sm))
    return expr


def at_best_sm(df: DataFrame) -> DataFrame:
    # the list of methods prunes partitions of a stored grid, which the choice by dimension cannot
    return df.filter(F.col("sm").isin(sorted(set(BEST_SM.values()))) & (F.col("sm") == best_sm()))


def pov_crosstab(info: DataFrame, labels: list[str] = POV_LABELS) -> DataFrame:
    """N01 (+N02 via the writer column): share of each story POV inside each
    prompt POV; a missing combination is null; null labels are excluded."""
    d = info.filter(F.col("s_pov").isNotNull() & F.col("p_pov").isNotNull())
    counts = d.groupBy(F.col("writer").alias("group"), "p_pov").pivot("s_pov", labels).count()
    total = sum((F.coalesce(F.col(l), F.lit(0)) for l in labels), F.lit(0))
    return counts.select(
        "group", "p_pov",
        *[(F.col(l) / total).alias(LABEL_COLS[l]) for l in labels],
    )


def pov_report(info: DataFrame) -> DataFrame:
    """The cross-tab sorted by prompt POV and group, both descending."""
    t = pov_crosstab(info)
    return t.orderBy(F.col("p_pov").desc(), F.col("group").desc()).select(
        "p_pov", "group", *[LABEL_COLS[l] for l in POV_LABELS]
    )


def prompts_per_pov(info: DataFrame) -> DataFrame:
    """Distinct prompts per prompt POV, and their sum over POVs
    (``p_pov`` null on the total row)."""
    per = info.groupBy("writer", "p_pov").agg(F.count_distinct("p_ind").alias("n_prompts"))
    tot = per.groupBy("writer").agg(F.sum("n_prompts").alias("n_prompts")).select(
        "writer", F.lit(None).cast("string").alias("p_pov"), "n_prompts"
    )
    return per.unionByName(tot)


def attach_scores(info: DataFrame, scores: DataFrame, dims=DIMENSIONS, ams=ATTR_METHODS,
                  sms=SCORE_METHODS) -> DataFrame:
    """Every story of `info` kept for every grid coordinate; unscored -> null.
    The coordinates are a fixed parameter list (54 by default), exploded per story."""
    coords = F.explode(F.array(*[
        F.struct(F.lit(d).alias("dim"), F.lit(a).alias("am"), F.lit(m).alias("sm"))
        for d in dims for a in ams for m in sms
    ]))
    grid = info.select("*", coords.alias("_c")).select("*", "_c.*").drop("_c")
    return grid.join(scores.select("writer", "s_id", "dim", "am", "sm", "score"),
                     ["writer", "s_id", "dim", "am", "sm"], "left")


def zscores(scores: DataFrame) -> DataFrame:
    """Pooled z-score per (dim, am, sm) over both writers: mean ignoring
    missing values, population std; NaN is folded to null first."""
    s = scores.withColumn("score", F.nanvl(F.col("score"), F.lit(None).cast("double")))
    stats = s.groupBy("dim", "am", "sm").agg(
        F.avg("score").alias("z_mean"), F.stddev_pop("score").alias("z_std")
    )
    return s.join(F.broadcast(stats), ["dim", "am", "sm"]).withColumn(
        "z_score", F.try_divide(F.col("score") - F.col("z_mean"), F.col("z_std"))
    ).drop("z_mean", "z_std")


def histograms(z: DataFrame, bins: int = 10) -> DataFrame:
    """10 equal bins over each writer's own range, for z and raw scores.
    The maximum falls in the last bin; a constant range is widened by 0.5."""
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("x"))
                                for k, c in (("z", "z_score"), ("raw", "score"))])).alias("v")
    long = z.select("writer", "dim", "am", "sm", kinds).select("writer", "dim", "am", "sm", "v.*").filter(
        F.col("x").isNotNull())
    # bins are cut on values rounded to 9 decimals, so float noise cannot move
    # a value across an edge; rounding keeps order, so the range needs it but twice
    keys = ["writer", "dim", "am", "sm", "kind"]
    rng = long.groupBy(*keys).agg(F.bround(F.min("x"), 9).alias("lo"), F.bround(F.max("x"), 9).alias("hi"))
    long = long.withColumn("x", F.bround("x", 9))
    rng = rng.select(
        *keys,
        F.when(F.col("lo") == F.col("hi"), F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
        F.when(F.col("lo") == F.col("hi"), F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"),
    )
    b = F.least(F.floor((F.col("x") - F.col("lo")) * bins / (F.col("hi") - F.col("lo"))) + 1, F.lit(bins))
    return long.join(F.broadcast(rng), keys).groupBy(*keys, b.cast("int").alias("bin")).agg(
        F.count(F.lit(1)).alias("cnt")
    )


def method_agreement(scores: DataFrame, writer: str = "human") -> DataFrame:
    """Spearman between the avg method and the best method per (dim, am)."""
    s = scores.filter(F.col("writer") == writer)
    a = s.filter(F.col("sm") == "avg").select("dim", "am", "s_id", F.col("score").alias("x"))
    b = at_best_sm(s).select("dim", "am", "s_id", F.col("score").alias("y"))
    return spearman(a.join(b, ["dim", "am", "s_id"]), ["dim", "am"], "x", "y", ["s_id"])


def attr_method_agreement(z: DataFrame, writer: str = "human", dims=("appearance", "intellect"),
                          sms=("avg", "sim")) -> DataFrame:
    """Spearman between attribute methods (all-sub, all-comet, sub-comet)
    for the given dims and score methods; each pair omits its own missing rows."""
    s = z.filter((F.col("writer") == writer) & F.col("dim").isin(*dims) & F.col("sm").isin(*sms))
    # stored: each pair of methods reads it, and its shuffle has every score of the writer
    ensure_checkpoint_dir(z.sparkSession)
    p = s.groupBy("dim", "sm", "s_id").pivot("am", ["all", "sub", "comet"]).agg(F.first("score")).checkpoint()
    out = None
    for x, y in (("all", "sub"), ("all", "comet"), ("sub", "comet")):
        r = spearman(p, ["dim", "sm"], x, y, ["s_id"]).select(
            "dim", "sm", F.lit(f"{x}-{y}").alias("pair"), "n", "sp_corr"
        )
        out = r if out is None else out.unionByName(r)
    return out


def _moments(df: DataFrame, keys: list[str], group_col: str, a: str, b: str, value: str = "z_score") -> DataFrame:
    v = F.col(value)
    return df.filter(v.isNotNull()).groupBy(*keys).agg(
        F.count_if(F.col(group_col) == a).alias("n1"),
        F.avg(F.when(F.col(group_col) == a, v)).alias("m1"),
        F.var_samp(F.when(F.col(group_col) == a, v)).alias("v1"),
        F.count_if(F.col(group_col) == b).alias("n2"),
        F.avg(F.when(F.col(group_col) == b, v)).alias("m2"),
        F.var_samp(F.when(F.col(group_col) == b, v)).alias("v2"),
    )


def ttest_groups(z: DataFrame, group_col: str, a: str, b: str, keys=("dim", "am")) -> DataFrame:
    """Equal-variance two-sample t of z-scores, group `a` minus group `b`."""
    m = _moments(z, list(keys), group_col, a, b)
    t, dof = two_sample_t(F.col("n1"), F.col("m1"), F.col("v1"), F.col("n2"), F.col("m2"), F.col("v2"))
    return m.select(*keys, "n1", "n2", t.alias("t"), dof.alias("dof"))


def ttest_writers(z: DataFrame) -> DataFrame:
    """Human vs machine at the best score method; t > 0: human higher."""
    return ttest_groups(at_best_sm(z), "writer", "human", "gpt-3.5")


def ttest_female_male(z: DataFrame, writer: str) -> DataFrame:
    """TP-F vs TP-M within one writer; t > 0: TP-F higher."""
    return ttest_groups(at_best_sm(z).filter(F.col("writer") == writer), "s_pov", "TP-F", "TP-M")


def prompt_means(z: DataFrame) -> DataFrame:
    """Per-prompt mean z-score per writer at the best method, missing dropped."""
    return at_best_sm(z).filter(F.col("z_score").isNotNull()).groupBy("writer", "dim", "am", "p_ind").agg(
        F.avg("z_score").alias("z_mean")
    )


def paired_ttest(z: DataFrame) -> DataFrame:
    """Paired t of per-prompt means over prompts present for both writers."""
    pm = prompt_means(z)
    h = pm.filter(F.col("writer") == "human").select("dim", "am", "p_ind", F.col("z_mean").alias("h"))
    m = pm.filter(F.col("writer") == "gpt-3.5").select("dim", "am", "p_ind", F.col("z_mean").alias("m"))
    d = h.join(m, ["dim", "am", "p_ind"]).withColumn("d", F.col("h") - F.col("m"))
    a = d.groupBy("dim", "am").agg(F.count(F.lit(1)).alias("n"), F.avg("d").alias("mean_d"),
                                   F.stddev_samp("d").alias("sd_d"))
    t, dof = paired_t(F.col("n"), F.col("mean_d"), F.col("sd_d"))
    return a.select("dim", "am", "n", t.alias("t"), dof.alias("dof"))


def with_p_value(df: DataFrame) -> DataFrame:
    """U03 on result rows: two-sided p from (t, dof)."""
    return df.withColumn("p", t_p_value(F.col("t"), F.col("dof")))


def pov_table(z: DataFrame, am: str, labels: list[str] = POV_TABLE_LABELS, sm: str | None = None) -> DataFrame:
    """Mean and sample std of z by (dim, writer, s_pov) for one
    attribute method at the best score method (or the given one), plus the
    ``mean (std)`` cell (P12)."""
    base = at_best_sm(z) if sm is None else z.filter(F.col("sm") == sm)
    s = base.filter((F.col("am") == am) & F.col("s_pov").isin(*labels))
    a = s.groupBy("dim", "writer", "s_pov").agg(
        F.avg("z_score").alias("z_mean"), F.stddev_samp("z_score").alias("z_std")
    )
    return a.withColumn("cell", mean_std_cell("z_mean", "z_std"))
