"""Sinks: scored fires (SK1), year-partitioned keep-last upsert (SK4), and
plain table writers for neighbours and explanations (SK2, SK3)."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hotspots.sources.landing import COMMITS, MANIFEST, committed, read_kind
from hotspots.sources.paths import exists, write_new_text


def write_scored_fires(scored: DataFrame, path: str, fmt: str = "csv") -> None:
    """Scored fires, partitioned by day so readers prune by date."""
    w = scored.write.mode("overwrite").partitionBy("acq_date")
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.format(fmt).save(path)


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    df.write.mode("overwrite").format(fmt).save(path)


def write_nn_results(nearest_fire: DataFrame, nearest_nofire: DataFrame, originals: DataFrame,
                     prefix: str, fmt: str = "parquet") -> None:
    """The three outputs of a nearest-day search (SK2): nearest fire days,
    nearest no-fire days and the rows they were found for."""
    for name, df in (("nn_firedays", nearest_fire), ("nn_nofiredays", nearest_nofire),
                     ("originals", originals)):
        df.write.mode("overwrite").format(fmt).save(f"{prefix.rstrip('/')}/{name}")


def keep_last(old: DataFrame, new: DataFrame, keys: list[str] | None,
              order: list[str] | None = None) -> DataFrame:
    """Old rows (distinct) then new rows, only the columns both share (old
    order). With ``keys`` the newest row per key wins; without keys the batches
    are appended. The result is distinct (SK4 merge).

    Of several new rows of a key the last one wins: by the columns ``order`` of
    ``new``, or else by file name and position as the batch was read."""
    shared = [c for c in old.columns if c in set(new.columns)]
    place = F.struct(*(order or [F.input_file_name(), F.monotonically_increasing_id()]))
    o = old.distinct().select(*shared, F.lit(0).alias("_batch"))
    n = new.select(*shared, F.lit(1).alias("_batch"), place.alias("_place"))
    u = o.unionByName(n, allowMissingColumns=True)
    if keys and all(k in shared for k in keys):
        # partially aggregated: one row per key leaves each map task, however many came
        row = F.struct(*shared)
        u = (u.groupBy(*[F.col(k).alias(f"_key_{k}") for k in keys])
             .agg(F.max_by(row, F.struct("_batch", "_place")).alias("_row")).select("_row.*"))
    else:
        u = u.drop("_batch", "_place")
    return u.distinct()


def upsert_yearly(new: DataFrame, root: str, kind: str, keys: list[str] | None,
                  order: list[str] | None = None) -> DataFrame:
    """Merge ``new`` into the years of ``<root>/<kind>`` that it touches; rows
    without a date are a year of their own. The merged years are written beside
    the table, as one commit, and become visible together when the next manifest
    is: a job that dies before leaves every old year as it was. Only a table that
    is not there counts as a first load (keys hold there, too): any read error is
    raised before anything is written. Two writers that started from the same
    manifest cannot both commit: the later one gets an error."""
    spark = new.sparkSession
    new = new.withColumn("acq_date", F.col("acq_date").cast("date"))
    base = f"{root.rstrip('/')}/{kind}"
    touched = [r[0] for r in new.select(F.year("acq_date")).distinct().collect()]  # a few years
    number, years = committed(spark, root, kind)
    old = new.limit(0)
    if exists(spark, base):
        own = F.col("year").isin([y for y in touched if y is not None])
        old = (read_kind(spark, root, kind)
               .filter(own | F.col("year").isNull() if None in touched else own).drop("year"))
    merged = keep_last(old, new, keys, order).withColumn("year", F.year("acq_date"))
    commit = uuid.uuid4().hex
    (merged.repartition("year").sortWithinPartitions("acq_date").write.partitionBy("year")
     .option("header", True).csv(f"{base}/{COMMITS}/commit={commit}"))
    names = ["null" if y is None else str(y) for y in touched]
    _switch(spark, f"{base}/{MANIFEST}-{number + 1:09d}.json", {**years, **dict.fromkeys(names, commit)})
    return read_kind(spark, root, kind).drop("year")


def _switch(spark: SparkSession, path: str, years: dict[str, str]) -> None:
    write_new_text(spark, path, json.dumps(years, sort_keys=True))
