"""Registered queries: one per operator of the inventory, each with (when
SQL-expressible) a DuckDB twin over the same driver tables. Importing this
module registers every query family.
"""

from __future__ import annotations

from storylens.operators import analysis as N
from storylens.plans import common as C
from storylens.plans.oracle_fixtures import with_ctes
from storylens.plans.registry import ORACLE, QUERIES, query
from storylens.plans.sqlparts import SQL_ATTRS_ALL, SQL_Z, sql_avg_scores

__all__ = ["QUERIES", "ORACLE"]


# --- flagship -----------------------------------------------------------------

@query(
    "n16_pov_table_all_avg",
    with_ctes(
        ["fx_stories", "fx_lexicon"],
        """
SELECT dim, writer, s_pov, avg(z_score) AS z_mean, stddev_samp(z_score) AS z_std,
       printf('%.2f (%.2f)', avg(z_score), stddev_samp(z_score)) AS cell
FROM z WHERE s_pov IN ('TP-M', 'TP-F', 'FP', 'Other')
GROUP BY dim, writer, s_pov""",
        [("attrs", SQL_ATTRS_ALL), *sql_avg_scores(["all"]), ("z", SQL_Z)],
    ),
    floats=["z_mean", "z_std"],
)
def q_flagship(spark, sf):
    """documents -> stories -> all tokens (E01) -> lexicon average for six
    dimensions (C01/C02) -> pooled z-scores (N06) -> mean (sample std) by
    story POV and writer (N16)."""
    z = C.grid_z(spark, sf, ams=["all"], sms=["avg"])
    return N.pov_table(z, "all", sm="avg")


# register the other families
from storylens.plans import (  # noqa: E402,F401
    q_analysis,
    q_attrs,
    q_eval,
    q_incremental,
    q_pov,
    q_score,
    q_text,
)
