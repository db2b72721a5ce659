"""Join helpers: size-checked broadcast and the interval lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hotspots.config import LIMITS


def _fixed_width(t: T.DataType) -> int | None:
    """Bytes of a type without variable parts, else None."""
    if isinstance(t, (T.StringType, T.BinaryType, T.ArrayType, T.MapType)):
        return None
    if isinstance(t, T.StructType):
        parts = [_fixed_width(f.dataType) for f in t.fields]
        return None if None in parts else 8 + sum(parts)
    return 16 if isinstance(t, T.DecimalType) else 8


def _value_bytes(c: Column, t: T.DataType) -> Column:
    """Bytes of one value: measured for texts and collections, 8 and up else."""
    width = _fixed_width(t)
    if width is not None:
        return F.lit(width)
    if isinstance(t, (T.StringType, T.BinaryType)):
        size = 16 + F.octet_length(c)
    elif isinstance(t, T.ArrayType):
        each = _fixed_width(t.elementType)
        size = 24 + (F.size(c) * each if each is not None else F.aggregate(
            c, F.lit(0).cast("long"), lambda n, x: n + _value_bytes(x, t.elementType).cast("long")))
    elif isinstance(t, T.MapType):
        size = 16 + _value_bytes(F.map_keys(c), T.ArrayType(t.keyType)) + _value_bytes(
            F.map_values(c), T.ArrayType(t.valueType))
    else:
        size = F.lit(8)
        for f in t.fields:
            size = size + _value_bytes(c[f.name], f.dataType)
    return F.coalesce(size, F.lit(8))


def measured_bytes(df: DataFrame) -> Column:
    """Estimated bytes of a row, from its own values."""
    total = F.lit(16).cast("long")
    for f in df.schema.fields:
        total = total + _value_bytes(F.col(f"`{f.name}`"), f.dataType)
    return total


def broadcast_if_small(df: DataFrame, max_rows: int | None = None,
                       max_bytes: int | None = None) -> DataFrame:
    """Broadcast ``df`` only after measuring it (up to the row bound): rows and
    the bytes of its own values. Above either bound the plain frame is returned
    and the planner (AQE) chooses a shuffle join at run time."""
    rows = LIMITS.broadcast_rows if max_rows is None else max_rows
    nbytes = LIMITS.broadcast_bytes if max_bytes is None else max_bytes
    n, size = df.limit(rows + 1).agg(F.count(F.lit(1)), F.sum(measured_bytes(df))).first()
    return F.broadcast(df) if n <= rows and (size or 0) <= nbytes else df


def _interval_days(intervals: DataFrame, start_col: str, end_col: str, day: str = "_day") -> DataFrame:
    """One row per (interval, day it covers): a date range join becomes an
    equi-join on the day. Intervals with start > end cover no day."""
    return (intervals.filter(F.col(start_col) <= F.col(end_col))
            .withColumn(day, F.explode(F.sequence(F.col(start_col).cast("date"),
                                                  F.col(end_col).cast("date"),
                                                  F.expr("INTERVAL 1 DAY")))))


def first_interval_match(points: DataFrame, intervals: DataFrame, point_key: list[str],
                         day_col: str, start_col: str = "start_date", end_col: str = "end_date",
                         order_col: str = "pos") -> DataFrame:
    """For each point the first interval (by ``order_col``) with start <= day <= end,
    NULL columns when none matches (J8).

    Intervals are expanded to their days and reduced to the first interval of
    each day (a small aggregation on the interval side); points then meet one
    row per day in an equi-join (broadcast after a size check, else a shuffle
    join that AQE can split). ``point_key`` is kept for callers; no window over
    the points is needed.
    """
    cols = intervals.columns
    days = _interval_days(intervals, start_col, end_col)
    first = (days.groupBy("_day").agg(F.min_by(F.struct(*cols), F.col(order_col)).alias("_iv"))
             .select("_day", *[F.col(f"_iv.{c}").alias(c) for c in cols]))
    iv = broadcast_if_small(first)
    return points.join(iv, F.col(day_col) == F.col("_day"), "left").drop("_day")


def within_windows(points: DataFrame, windows: DataFrame, day_col: str = "acq_date",
                   start_col: str = "start_date", end_col: str = "end_date") -> DataFrame:
    """Every point inside every window that contains its day (J9); windows may
    overlap. Same day-expansion equi-join as ``first_interval_match``."""
    w = broadcast_if_small(_interval_days(windows, start_col, end_col))
    return points.join(w, F.col(day_col) == F.col("_day")).drop("_day")
