"""Statistics: average ranks, Spearman correlation (X05), t statistics and
two-sided t-distribution p-values (U03).

Ranks are computed without a window over a whole group: rows are numbered
along a range-partitioned global sort of (group, value, row key), tied values
take the mean of their first and last number, and the group's first number is
subtracted. A group holding a third of all rows is still spread over many
tasks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storylens.functions.indexing import cumulative_sum, sequential_index
from storylens.session import ensure_checkpoint_dir


def average_ranks(df: DataFrame, group_cols: list[str], value_col: str, key_cols: list[str],
                  out: str = "rank") -> DataFrame:
    """1-based average rank of `value_col` inside each group (ties share the mean rank)."""
    keys = [*group_cols, value_col, *key_cols]
    # places of each distinct value: a tie, however large, is one row
    tie = sequential_index(df.select(*keys), keys, "_g").groupBy(*group_cols, value_col).agg(
        F.min("_g").alias("_lo"), F.max("_g").alias("_hi"))
    first = tie.groupBy(*group_cols).agg(F.min("_lo").alias("_g0"))
    mid = tie.join(first, group_cols).select(
        *group_cols, value_col, ((F.col("_lo") + F.col("_hi")) / 2.0 - F.col("_g0") + 1.0).alias(out))
    return df.join(mid, [*group_cols, value_col])


def grouped_quantiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Quantiles per group by linear interpolation, one column for each entry
    of ``shares``. Distinct values are counted and ranked in a global order, so
    no task holds a group."""
    v = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    v = cumulative_sum(v, [*keys, value], "_c", "_before")
    # one row for each group, on distinct values alone
    size = v.groupBy(*keys).agg(F.min("_before").alias("_g0"), F.sum("_c").alias("_n"))
    v = v.join(size, keys).withColumn("_lo", F.col("_before") - F.col("_g0")).withColumn(
        "_hi", F.col("_lo") + F.col("_c") - 1)

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("_lo") <= rank) & (rank <= F.col("_hi")), F.col(value)))

    place = {name: (F.col("_n") - 1) * q for name, q in shares.items()}
    parts = v.groupBy(*keys).agg(
        F.max("_n").alias("_n"), *[at(F.floor(h)).alias(f"_f_{c}") for c, h in place.items()],
        *[at(F.ceil(h)).alias(f"_c_{c}") for c, h in place.items()])
    return parts.select(*keys, *[
        (F.col(f"_f_{c}") + (F.col(f"_c_{c}") - F.col(f"_f_{c}")) * (h - F.floor(h))).alias(c) for c, h in place.items()])


TIE_DIGITS = 9


def window_average_ranks(df: DataFrame, group_cols: list[str], value_col: str, out: str = "rank") -> DataFrame:
    """Average ranks with a window per group: for groups of a known small
    bound (e.g. held-out lexicon words), where one task per group is fine."""
    from pyspark.sql import Window

    w = Window.partitionBy(*group_cols).orderBy(value_col)
    ties = Window.partitionBy(*group_cols, value_col)
    return df.withColumn(out, F.rank().over(w) + (F.count(F.lit(1)).over(ties) - 1) / 2.0)


def spearman(df: DataFrame, group_cols: list[str], x: str, y: str, key_cols: list[str],
             bounded_groups: bool = False) -> DataFrame:
    """Spearman rank correlation per group over rows where both x and y
    are present. Returns ``(group..., n, sp_corr)``; constant series -> null.
    Values equal to 9 decimals are ties (float noise does not split ties).

    Ranks come from a range-partitioned global order (a group may hold any
    share of the rows); ``bounded_groups`` uses a window per group instead,
    for groups whose size has a fixed bound (lexicon words)."""
    d = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(x) & ~F.isnan(y))
    d = d.select(*group_cols, *key_cols, F.bround(F.col(x), TIE_DIGITS).alias(x),
                 F.bround(F.col(y), TIE_DIGITS).alias(y))
    if bounded_groups:
        r = window_average_ranks(window_average_ranks(d, group_cols, x, "_rx"), group_cols, y, "_ry")
        return pearson(r, group_cols, "_rx", "_ry", "sp_corr")
    # stored: both ranks sort it, each after a pass for the borders, and both are joined to it
    ensure_checkpoint_dir(d.sparkSession)
    d = d.checkpoint()
    rx = average_ranks(d, group_cols, x, key_cols, "_rx")
    ry = average_ranks(d.select(*group_cols, *key_cols, y), group_cols, y, key_cols, "_ry")
    r = rx.join(ry.select(*group_cols, *key_cols, "_ry"), [*group_cols, *key_cols])
    return pearson(r, group_cols, "_rx", "_ry", "sp_corr")


def pearson(df: DataFrame, group_cols: list[str], x: str, y: str, out: str) -> DataFrame:
    """Pearson correlation per group from stable partial aggregates
    (``covar_pop``, ``stddev_pop``); null when a side is constant (no
    division error under ANSI mode)."""
    a = df.groupBy(*group_cols).agg(
        F.count(F.lit(1)).alias("n"),
        F.covar_pop(x, y).alias("_c"),
        (F.stddev_pop(x) * F.stddev_pop(y)).alias("_s"),
    )
    r = F.try_divide(F.col("_c"), F.col("_s"))
    # greatest/least skip nulls, so clamp only defined values
    clamped = F.when(F.col("_s") > 0, F.least(F.greatest(r, F.lit(-1.0)), F.lit(1.0)))
    return a.select(*group_cols, "n", clamped.alias(out))


def spearman_t(r: Column, n: Column) -> Column:
    """t = r sqrt((n-2)/(1-r^2)) with n-2 degrees of freedom."""
    return r * F.sqrt(F.try_divide(n - 2.0, 1.0 - r * r))


# --- t distribution ---------------------------------------------------------

# Coefficients of the Lanczos approximation for g = 7.
LANCZOS = [0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059,
           12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7]


def log_gamma(x: Column) -> Column:
    """ln Gamma(x) for x >= 1/2."""
    z = x - 1.0
    total = F.lit(LANCZOS[0])
    for i, c in enumerate(LANCZOS[1:], 1):
        total = total + F.lit(c) / (z + float(i))
    t = z + 7.5
    return F.lit(0.5 * math.log(2 * math.pi)) + (z + 0.5) * F.log(t) - t + F.log(total)


def log_beta_half(a: Column) -> Column:
    """ln B(a, 1/2) for a >= 1/2; for large a by the expansion of the ratio of
    the gamma functions, whose difference would cancel."""
    far = 0.5 * F.log(a) - 1.0 / (8.0 * a) + 1.0 / (192.0 * a * a * a)
    return F.lit(0.5 * math.log(math.pi)) - F.when(a > 100.0, far).otherwise(log_gamma(a + 0.5) - log_gamma(a))


def beta_fraction(a: Column, b: Column, x: Column) -> Column:
    """Continued fraction of the incomplete beta function by the modified Lentz
    recurrence over a fixed sequence of steps: 60 and four times the root of
    the larger parameter, which it needs by then where x < (a+1) / (a+b+2)."""
    n = 60 + F.ceil(4.0 * F.sqrt(F.greatest(a, b))).cast("int")

    def kept(v: Column) -> Column:  # off zero
        return F.when(F.abs(v) < 1e-300, F.lit(1e-300)).otherwise(v)

    def half(s: Column, k: Column) -> Column:
        """``s`` with c and d after the coefficient k."""
        d = 1.0 / kept(1.0 + k * s["d"])
        c = kept(1.0 + k / s["c"])
        return F.struct(s["a"].alias("a"), s["b"].alias("b"), s["x"].alias("x"), c.alias("c"), d.alias("d"),
                        (s["h"] * d * c).alias("h"))

    def even(s: Column, m: Column) -> Column:
        return half(s, m * (s["b"] - m) * s["x"] / ((s["a"] - 1.0 + 2.0 * m) * (s["a"] + 2.0 * m)))

    def odd(s: Column, m: Column) -> Column:
        return half(s, -(s["a"] + m) * (s["a"] + s["b"] + m) * s["x"] / ((s["a"] + 2.0 * m) * (s["a"] + 1.0 + 2.0 * m)))

    first = 1.0 / kept(1.0 - (a + b) * x / (a + 1.0))
    start = F.struct(a.alias("a"), b.alias("b"), x.alias("x"), F.lit(1.0).alias("c"), first.alias("d"), first.alias("h"))
    # steps 2m and 2m + 1 have coefficients of two forms
    steps = F.sequence(F.lit(2), 2 * n + 1)
    return F.aggregate(steps, start, lambda s, k: F.when(k % 2 == 0, even(s, (k / 2).cast("double"))).otherwise(
        odd(s, F.floor(k / 2).cast("double"))), lambda s: s["h"])


def t_p_value(t: Column, dof: Column) -> Column:
    """Two-sided p of Student's t, I_x(dof/2, 1/2) at x = dof / (dof + t^2).
    Null without t or a positive dof; 0 for an infinite t."""
    a, b = dof / 2.0, F.lit(0.5)
    y = t * t / (dof + t * t)  # 1 - x, without cancellation
    scale = F.exp(-a * F.log1p(t * t / dof) + 0.5 * F.log(y) - log_beta_half(a))
    below = 1.0 - y < (a + 1.0) / (a + 2.5)
    p = F.when(below, scale * beta_fraction(a, b, 1.0 - y) / a).otherwise(1.0 - scale * 2.0 * beta_fraction(b, a, y))
    known = t.isNotNull() & ~F.isnan(t) & (dof > 0)
    return F.when(known, F.when(t == 0, F.lit(1.0)).when(F.abs(t) == F.lit(float("inf")), F.lit(0.0)).otherwise(p))


def two_sample_t(n1: Column, m1: Column, v1: Column, n2: Column, m2: Column, v2: Column) -> tuple[Column, Column]:
    """Equal-variance two-sample t and its degrees of freedom."""
    dof = n1 + n2 - 2
    sp2 = F.try_divide((n1 - 1) * v1 + (n2 - 1) * v2, dof.cast("double"))
    se = F.sqrt(sp2 * (F.try_divide(F.lit(1.0), n1) + F.try_divide(F.lit(1.0), n2)))
    return F.try_divide(m1 - m2, se), dof.cast("double")


def paired_t(n: Column, mean_d: Column, sd_d: Column) -> tuple[Column, Column]:
    return F.try_divide(mean_d, sd_d / F.sqrt(n.cast("double"))), (n - 1).cast("double")
