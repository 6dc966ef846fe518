"""Dense global index over a total order, without a single-partition window.

``row_number().over(Window.orderBy(...))`` moves every row into one task. Here
the unique order keys alone are range-partitioned and sorted, numbered inside
each partition, and that table is checkpointed **before** anything is derived
from it: counts, offsets and the result all read the same stored partitions.
(Deriving them from the lazy sort instead runs it twice, with other range
bounds each time, and loses rows.) Offsets are one row per partition. The
other columns are joined back on the key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storylens.session import ensure_checkpoint_dir


def _numbered(tagged: DataFrame, name: str, start: int) -> DataFrame:
    """Number the rows of a checkpointed table that carries its partition
    (``_pid``) and the row's place in it (``_local``)."""
    # one row per partition: a tiny window is fine here
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n")).select(
        "_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    # one row per partition, so the broadcast is bounded by the partition count
    return tagged.join(F.broadcast(offsets), "_pid").withColumn(
        name, F.col("_off") + F.col("_local") + F.lit(start)).drop("_pid", "_local", "_off")


def _tagged(df: DataFrame) -> DataFrame:
    """Add partition and place, and store the rows with them."""
    ensure_checkpoint_dir(df.sparkSession)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return df.withColumn("_pid", F.spark_partition_id()).withColumn("_local", place).checkpoint()


def sequential_index(df: DataFrame, keys: list[str], name: str = "idx", start: int = 0,
                     descending: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with the dense 0-based (``start``) rank of each row in the order of
    ``keys``, which identify a row; those in ``descending`` count down."""
    order = [F.col(k).desc() if k in descending else F.col(k).asc() for k in keys]
    index = _numbered(_tagged(df.select(*keys).orderBy(*order)), name, start)
    if set(df.columns) == set(keys):
        return index.select(*df.columns, name)
    index = index.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], name)
    same = reduce(lambda a, b: a & b, (df[k].eqNullSafe(index[f"_k{i}"]) for i, k in enumerate(keys)))
    return df.join(index, same).select(*[df[c] for c in df.columns], name)


def scan_order_index(df: DataFrame, name: str = "line_no", start: int = 0) -> DataFrame:
    """Number rows in scan order (partition order, then row order) without a
    sort. Meant directly on the scan of one file."""
    return _numbered(_tagged(df), name, start)


def cumulative_sum(df: DataFrame, keys: list[str], weight: str, name: str = "before") -> DataFrame:
    """``df`` (unique by ``keys``) with the sum of ``weight`` over all rows
    before each in the order of ``keys``."""
    tagged = _tagged(df.orderBy(*keys))
    # one row per partition, and a running sum inside each partition
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = tagged.groupBy("_pid").agg(F.sum(weight).alias("_n")).select(
        "_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    inside = Window.partitionBy("_pid").orderBy("_local").rowsBetween(Window.unboundedPreceding, -1)
    return tagged.withColumn("_in", F.coalesce(F.sum(weight).over(inside), F.lit(0))).join(
        F.broadcast(offsets), "_pid").withColumn(name, F.col("_off") + F.col("_in")).drop("_pid", "_local", "_off", "_in")
