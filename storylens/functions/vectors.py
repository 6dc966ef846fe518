"""Vector arithmetic on ``array<float|double>`` columns with higher-order functions.

Everything stays inside whole-stage codegen; arithmetic is done in double.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def as_double(vec) -> Column:
    return F.transform(_c(vec), lambda x: x.cast("double"))


def finite(vec) -> Column:
    """True if the vector is there and has no null, NaN or infinite element."""
    good = F.forall(_c(vec), lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    return F.coalesce(good, F.lit(False))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by their keys to the session's full number of partitions. Vector
    arithmetic takes time by the row, while partitions coalesced by bytes hold
    thousands of short vectors each."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def norm(a) -> Column:
    return F.sqrt(F.aggregate(_c(a), F.lit(0.0), lambda acc, x: acc + x * x))


def unit(a) -> Column:
    """Unit vector; the zero vector stays zero (so its cosine is 0).

    The norm is the variable of an outer lambda, which makes it once: an
    expression inside a lambda is evaluated anew for each element."""
    return F.transform(F.array(norm(a)), lambda n: F.when(n > 0, F.transform(_c(a), lambda x: x / n)).otherwise(
        F.transform(_c(a), lambda x: x * 0.0)))[0]


def cosine(a, b) -> Column:
    """Cosine similarity; 0 when either side is the zero vector."""
    na, nb = norm(a), norm(b)
    return F.when((na > 0) & (nb > 0), dot(a, b) / (na * nb)).otherwise(F.lit(0.0))


def vector_mean(df: DataFrame, keys: list[str], vec: str, out: str = "vec") -> DataFrame:
    """Element-wise mean of vectors per key.

    ``posexplode`` + ``avg`` per (key, element) is a plain partial aggregation
    (map-side combine), then the elements are reassembled in order.
    """
    exploded = df.select(*keys, F.posexplode(_c(vec)).alias("_i", "_x"))
    per_elem = exploded.groupBy(*keys, "_i").agg(F.avg(F.col("_x").cast("double")).alias("_m"))
    return per_elem.groupBy(*keys).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("_i", "_m"))), lambda s: s["_m"]
        ).alias(out)
    )
