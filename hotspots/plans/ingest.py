"""Incremental ingest (E3): high-water mark, catch-up windows, overlap
re-read, hourly resampling and the keep-last upsert.

The network clients of the original are out of scope: new data arrives as
landed files (see ``hotspots.streaming`` for the streaming form).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hotspots.functions.calendar import date_lit


def newest_date(landed: DataFrame, col: str = "acq_date") -> Column:
    """High-water mark of a landed folder as a scalar subquery (A3)."""
    return landed.select(F.max(F.col(col).cast("date"))).scalar()


def request_windows(spark, newest, today, max_days: int = 10) -> DataFrame:
    """Catch-up request windows from ``newest`` (inclusive) to ``today`` (TS3).

    n = days(today - newest) + 1. Above ``max_days`` the period is cut into
    windows of ``max_days`` days starting at newest, newest + 10, ...; else one
    window of n days.
    """
    nd, td = date_lit(newest), date_lit(today)
    n = F.datediff(td, nd) + 1
    starts = F.when(n > max_days, F.sequence(nd, td, F.expr(f"INTERVAL {max_days} DAYS"))).otherwise(
        F.array(nd))
    return spark.range(1).select(F.explode(starts).alias("window_start"),
                                 F.when(n > max_days, F.lit(max_days)).otherwise(n).alias("n_days"))


def overlap_rows(landed: DataFrame, days: int = 7) -> DataFrame:
    """Rows from ``days`` before the newest date on: the re-read overlap (TS4)."""
    return landed.filter(F.col("acq_date") >= F.date_sub(newest_date(landed), days))


def hourly_to_daily(hourly: DataFrame, region: str = "oblast_id", ts: str = "ts",
                    value: str = "cloud_cover") -> DataFrame:
    """Daily mean per region on the UTC day; NULL readings are skipped and days
    without readings inside a region's range are NULL (A4). The per-region day
    range is expanded per region row, no cross join."""
    daily = (hourly.withColumn("acq_date", F.col(ts).cast("date"))
             .groupBy(region, "acq_date").agg(F.avg(value).alias(value)))
    span = daily.groupBy(region).agg(F.min("acq_date").alias("_lo"), F.max("acq_date").alias("_hi"))
    days = span.select(region, F.explode(F.sequence("_lo", "_hi", F.expr("INTERVAL 1 DAY"))).alias("acq_date"))
    return days.join(daily, [region, "acq_date"], "left")


def merge_daily_hourly(daily: DataFrame, hourly_daily: DataFrame) -> DataFrame:
    """Daily weather left-joined with the daily mean of the hourly series."""
    return daily.join(hourly_daily, ["oblast_id", "acq_date"], "left")


def label_periods(df: DataFrame, periods, col: str = "acq_date") -> DataFrame:
    """Chronological split column train / calibration / test; rows outside all
    periods are dropped (TS5)."""
    d = F.col(col)
    split = (F.when(d.between(date_lit(periods.train[0]), date_lit(periods.train[1])), F.lit("train"))
             .when(d.between(date_lit(periods.calibration[0]), date_lit(periods.calibration[1])),
                   F.lit("calibration"))
             .when(d.between(date_lit(periods.test[0]), date_lit(periods.test[1])), F.lit("test")))
    return df.withColumn("split", split).filter(F.col("split").isNotNull())
