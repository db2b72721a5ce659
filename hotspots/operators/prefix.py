"""Distributed running totals and dense indexes (W5, PF3).

A window ``ORDER BY`` without ``PARTITION BY`` moves every row into one task.
Instead the rows are range-partitioned along the order key and written to the
shared checkpoint folder, which fixes the partition of every row; each partition
gets what all partitions before it hold as an offset, joined by the partition
number (one row per partition, so the plan does not grow with them), and inside
a partition the window is an ordinary partitioned one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _ranged(df: DataFrame, order_cols: list[str], buckets: int | None) -> DataFrame:
    """``df`` range-partitioned, checkpointed, with the partition as ``_bucket``."""
    n = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (df.repartitionByRange(n, *order_cols).withColumn("_bucket", F.spark_partition_id()).checkpoint(eager=True))


def _offsets(ranged: DataFrame, total, out: str) -> DataFrame:
    """(_bucket, out): what the partitions before each hold. At most one row per partition."""
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    return (ranged.groupBy("_bucket").agg(total.alias("_n"))
            .select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias(out)))


def running_total(df: DataFrame, order_col: str, value_col: str, out: str = "cum",
                  buckets: int | None = None) -> DataFrame:
    """``out`` = sum of ``value_col`` over rows with order key <= this row's key.

    ``order_col`` must be unique (group by it first); then the result equals a
    global ``ROWS UNBOUNDED PRECEDING`` window.
    """
    ranged = _ranged(df, [order_col], buckets)
    offsets = _offsets(ranged, F.sum(value_col), "_off")
    w = Window.partitionBy("_bucket").orderBy(order_col).rowsBetween(Window.unboundedPreceding, 0)
    return (ranged.withColumn("_own", F.sum(value_col).over(w)).join(F.broadcast(offsets), "_bucket")
            .withColumn(out, F.col("_off") + F.col("_own")).drop("_bucket", "_off", "_own"))


def dense_index(df: DataFrame, order_cols: list[str], out: str = "row_id",
                buckets: int | None = None) -> DataFrame:
    """0..n-1 along a total order of ``order_cols`` (PF3)."""
    ranged = _ranged(df, order_cols, buckets)
    offsets = _offsets(ranged, F.count(F.lit(1)), "_off")
    w = Window.partitionBy("_bucket").orderBy(*order_cols)
    numbered = ranged.withColumn("_r", F.row_number().over(w))
    return (numbered.join(F.broadcast(offsets), "_bucket")
            .withColumn(out, (F.col("_off") + F.col("_r") - 1).cast("bigint")).drop("_bucket", "_off", "_r"))
