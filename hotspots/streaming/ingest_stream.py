"""Incremental ingest with Structured Streaming.

The batch updater of the original polls services; here new extracts land as
CSV files and a file-source stream picks them up:

* ``start_upsert_stream`` - every micro-batch is merged into the
  year-partitioned table with the keep-last upsert (weather: newest row per
  (acq_date, oblast_id); fires: append + distinct). The stream's checkpoint
  and the upsert's lineage cuts live in the shared checkpoint folder, so a
  restarted query resumes where it stopped.
* ``daily_cell_counts_stream`` - fires per (cell, day) as a watermarked event
  time aggregation; late detections within the watermark still update their
  day.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from hotspots.functions import geo
from hotspots.session import ensure_checkpoint_dir
from hotspots.sinks.writers import upsert_yearly
from hotspots.sources.landing import KIND_SCHEMA

KEYS = {"weather": ["acq_date", "oblast_id"], "fire": None}


def landed_stream(spark: SparkSession, landing_dir: str, kind: str) -> DataFrame:
    return (spark.readStream.schema(KIND_SCHEMA[kind]).option("header", True)
            .csv(landing_dir))


def start_upsert_stream(spark: SparkSession, landing_dir: str, table_root: str, kind: str,
                        name: str | None = None, available_now: bool = True) -> StreamingQuery:
    base = ensure_checkpoint_dir(spark)
    ckpt = f"{base.rstrip('/')}/streams/{name or kind}"

    def merge(batch: DataFrame, epoch: int) -> None:
        if batch.isEmpty():
            return
        upsert_yearly(batch, table_root, kind, KEYS[kind])

    w = landed_stream(spark, landing_dir, kind).writeStream.foreachBatch(merge).option(
        "checkpointLocation", ckpt)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()


def daily_cell_counts_stream(fires: DataFrame, resolution: str = "50km",
                             watermark: str = "2 days") -> DataFrame:
    """Streaming fires per (cell, day); emits a day once the watermark passes it."""
    ts = F.col("acq_date").cast("timestamp")
    lat, lon = geo.snap("latitude", resolution), geo.snap("longitude", resolution)
    return (fires.withColumn("event_time", ts).withWatermark("event_time", watermark)
            .groupBy(F.window("event_time", "1 day"), geo.cell_key(lat, lon).alias("grid_cell"))
            .agg(F.count(F.lit(1)).alias("fire_count"))
            .select(F.col("window.start").cast("date").alias("acq_date"), "grid_cell", "fire_count"))
