"""Query registry: ``QUERIES[name] = fn(spark, sf_dir)`` and ``ORACLE[name] = sql``.

Floating outputs are rounded to 6 decimals in both engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from storylens.plans.common import rounded

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def round_sql(sql: str, floats: list[str]) -> str:
    """Wrap an oracle query so its floating columns are rounded like Spark's
    ``bround(x, 6)``."""
    if not floats:
        return sql
    rep = ", ".join(f"round_even({c}, 6) AS {c}" for c in floats)
    return f"SELECT * REPLACE ({rep}) FROM (\n{sql}\n) AS q"


def query(name: str, sql: str | None = None, floats: list[str] | None = None):
    def deco(fn):
        def run(spark, sf):
            return rounded(fn(spark, sf))

        run.__doc__ = fn.__doc__
        run.__name__ = name
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = round_sql(sql, floats or [])
        return fn

    return deco
