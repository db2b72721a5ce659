"""Cell-day series: snap (PF4/PF5), count (W1/W3), densify (TS1, J10), zero-fill (TS2)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hotspots.functions import geo
from hotspots.functions.calendar import date_lit


def snap_points(points: DataFrame, resolution: str = "50km", lat_col: str = "latitude",
                lon_col: str = "longitude") -> DataFrame:
    """Keep the original position as *_original and add the snapped cell."""
    return (points
            .withColumnRenamed(lat_col, "latitude_original")
            .withColumnRenamed(lon_col, "longitude_original")
            .withColumn("latitude", geo.snap("latitude_original", resolution))
            .withColumn("longitude", geo.snap("longitude_original", resolution))
            .withColumn("grid_cell", geo.cell_key("latitude", "longitude")))


def cell_day_counts(snapped: DataFrame) -> DataFrame:
    """Fires per (cell, day) plus the day's first original position; one
    partially aggregated pass over the detections (the only shuffle of the raw
    points in the series)."""
    return (snapped.groupBy("grid_cell", "acq_date")
            .agg(F.count(F.lit(1)).cast("bigint").alias("fire_count"),
                 F.first("latitude").alias("latitude"), F.first("longitude").alias("longitude"),
                 F.min(F.struct("latitude_original", "longitude_original")).alias("_first")))


def with_cell_day_count(points: DataFrame, out: str = "fire_count_cell") -> DataFrame:
    """Every detection with the count of its (cell, day) (W1): a partially
    aggregated count joined back, so the detections of a hot cell-day stay
    spread (adaptive execution splits the join's skewed side)."""
    key = ["grid_cell", "acq_date"]
    counts = points.groupBy(*key).agg(F.count(F.lit(1)).cast("bigint").alias(out)).select(
        *[F.col(c).alias(f"_{c}") for c in key], out)
    same = F.col("grid_cell").eqNullSafe(F.col("_grid_cell")) & F.col("acq_date").eqNullSafe(F.col("_acq_date"))
    return points.join(counts, same).drop("_grid_cell", "_acq_date")


def constants_from_daily(daily: DataFrame) -> DataFrame:
    """Per cell: the snapped position and the original position of its first
    fire by (date, latitude, longitude) (W2), from the per-day table - a cell
    holding a third of all fires is already reduced to one row per day."""
    first = F.min(F.struct("acq_date", F.col("_first.latitude_original").alias("lat"),
                           F.col("_first.longitude_original").alias("lon")))
    return (daily.groupBy("grid_cell")
            .agg(F.first("latitude").alias("latitude"), F.first("longitude").alias("longitude"),
                 first.alias("_f"))
            .select("grid_cell", "latitude", "longitude",
                    F.col("_f.lat").alias("latitude_original"),
                    F.col("_f.lon").alias("longitude_original")))


def cell_constants(snapped: DataFrame) -> DataFrame:
    return constants_from_daily(cell_day_counts(snapped))


def densify(snapped: DataFrame, start, end) -> DataFrame:
    """Every cell that burned in the window gets every day of [start, end];
    days without fires count 0 (TS1). Fires outside the window (or without a
    date) take no part.

    Two shuffles and no join: the detections are aggregated per (cell, day)
    (partial aggregation), then per cell into its constants and a day -> count
    map. The map holds at most one entry per calendar day of the window, so a
    cell with a third of all fires is still a bounded row. The calendar is then
    generated per cell with ``explode(sequence(..))`` and looked up in the map.
    """
    daily = cell_day_counts(snapped.filter(F.col("acq_date").between(date_lit(start), date_lit(end))))
    first = F.min(F.struct("acq_date", F.col("_first.latitude_original").alias("lat"),
                           F.col("_first.longitude_original").alias("lon")))
    cells = daily.groupBy("grid_cell").agg(
        F.first("latitude").alias("latitude"), F.first("longitude").alias("longitude"),
        first.alias("_f"),
        F.map_from_entries(F.collect_list(F.struct("acq_date", "fire_count"))).alias("_counts"))
    days = F.explode(F.sequence(date_lit(start), date_lit(end), F.expr("INTERVAL 1 DAY")))
    return (cells.select("*", days.alias("acq_date"))
            .select("grid_cell", "acq_date", "latitude", "longitude",
                    F.col("_f.lat").alias("latitude_original"),
                    F.col("_f.lon").alias("longitude_original"),
                    F.dayofyear("acq_date").alias("day_of_year"),
                    F.coalesce(F.try_element_at("_counts", F.col("acq_date")),
                               F.lit(0).cast("bigint")).alias("fire_count")))


def zero_fill_daily(counts: DataFrame, day_col: str, count_col: str, start, end) -> DataFrame:
    """A daily series over [start, end] with 0 on missing days (TS2)."""
    spark = counts.sparkSession
    days = spark.range(1).select(
        F.explode(F.sequence(date_lit(start), date_lit(end), F.expr("INTERVAL 1 DAY"))).alias(day_col))
    return (days.join(counts, day_col, "left")
            .select(day_col, F.coalesce(F.col(count_col), F.lit(0).cast("bigint")).alias(count_col)))
