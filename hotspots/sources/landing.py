"""Landed files: yearly detection / weather CSVs, static layer CSVs, polygon text.

Layout of a landing root (written by ``land_yearly`` and the upsert sink)::

    <root>/<kind>/year=<YYYY>/part-*.csv      kind = fire | weather
    <root>/<kind>/_commits/commit=<id>/year=<YYYY>/part-*.csv, years an upsert wrote
    <root>/<kind>/_manifest-<n>.json          which commit holds each of those years

``year`` is a partition column, so a date window prunes whole years before
any file is opened (SC1, SC2). Static layers are folders whose names end with
the grid resolution (``<layer>_<res>.csv``), matched with a path glob (SC3).
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hotspots.functions.calendar import as_date, date_lit
from hotspots.functions.scoring import nan_to_null
from hotspots.sources.paths import glob, read_text

FIRE_SCHEMA = T.StructType([
    T.StructField("latitude", T.DoubleType()),
    T.StructField("longitude", T.DoubleType()),
    T.StructField("acq_date", T.DateType()),
])

WEATHER_SCHEMA = T.StructType([
    T.StructField("oblast_id", T.StringType()),
    T.StructField("acq_date", T.DateType()),
    T.StructField("t_mean", T.DoubleType()),
    T.StructField("cloud_cover", T.DoubleType()),
])

COMMITS, MANIFEST = "_commits", "_manifest"
KIND_SCHEMA = {"fire": FIRE_SCHEMA, "weather": WEATHER_SCHEMA}


def land_yearly(df: DataFrame, root: str, kind: str, mode: str = "append") -> None:
    """Write rows under ``<root>/<kind>/year=YYYY/`` as CSV with a header."""
    (df.withColumn("year", F.year("acq_date"))
     .write.mode(mode).partitionBy("year").option("header", True)
     .csv(f"{root.rstrip('/')}/{kind}"))


def committed(spark: SparkSession, root: str, kind: str) -> tuple[int, dict[str, str]]:
    """Number of the newest manifest (0: none) and, per year that an upsert has
    written, the commit that holds it. The year of rows without a date is ``null``."""
    found = glob(spark, f"{root.rstrip('/')}/{kind}/{MANIFEST}-*.json")
    if not found:
        return 0, {}
    return int(found[-1].rsplit("-", 1)[1].split(".")[0]), json.loads(read_text(spark, found[-1]))


def year_folder(year: str) -> str:
    return f"year={'__HIVE_DEFAULT_PARTITION__' if year == 'null' else year}"


def read_kind(spark: SparkSession, root: str, kind: str) -> DataFrame:
    """All landed rows of one kind, with the ``year`` partition column. Years that
    the newest manifest names are read from their commits, all others as landed."""
    base = f"{root.rstrip('/')}/{kind}"
    year = T.StructField("year", T.IntegerType())
    schema = T.StructType([*KIND_SCHEMA[kind].fields, year])
    _, years = committed(spark, root, kind)
    read = lambda: spark.read.option("header", True)  # noqa: E731  a reader keeps its options
    if not years:
        return nan_to_null(read().schema(schema).csv(base))
    parts = [read().schema(T.StructType([*schema.fields, T.StructField("commit", T.StringType())]))
             .option("basePath", f"{base}/{COMMITS}")
             .csv([f"{base}/{COMMITS}/commit={c}/{year_folder(y)}" for y, c in sorted(years.items())]).drop("commit")]
    if glob(spark, f"{base}/year=*"):
        known = [int(y) for y in years if y != "null"]
        as_landed = F.col("year").isNull() if "null" not in years else F.lit(False)
        parts.append(read().schema(schema).csv(base).filter(~F.col("year").isin(known) | as_landed))
    return nan_to_null(reduce(DataFrame.unionByName, parts))


def scan_years(spark: SparkSession, root: str, kind: str, start, end) -> DataFrame:
    """Rows of the years touching [start, end] (partition pruning), distinct."""
    s, e = as_date(start), as_date(end)
    df = read_kind(spark, root, kind).filter(F.col("year").between(s.year, e.year))
    return df.drop("year").distinct()


def scan_dynamic(spark: SparkSession, root: str, start, end) -> tuple[DataFrame, DataFrame]:
    """Fires and weather of [start, end]: year pruning, full-row distinct, then
    the inclusive date filter (SC1). A window without any fire, or without any
    weather, is an error."""
    out = []
    for kind in ("fire", "weather"):
        d = scan_years(spark, root, kind, start, end)
        d = d.filter(F.col("acq_date").between(date_lit(start), date_lit(end)))
        if d.isEmpty():
            raise ValueError(f"no {kind} rows between {start} and {end}")
        out.append(d)
    return out[0], out[1]


def scan_weather(spark: SparkSession, root: str, start, end) -> DataFrame:
    """Weather only (SC2)."""
    return scan_years(spark, root, "weather", start, end).filter(
        F.col("acq_date").between(date_lit(start), date_lit(end)))


def year_from_file_name(col) -> "F.Column":
    """Year of a flat file named ``<anything>_<YYYY>....csv``: the first four
    characters of the last ``_`` token (F15)."""
    last = F.element_at(F.split(col, "_"), -1)
    return F.substring(last, 1, 4).cast("int")


def scan_flat_yearly(spark: SparkSession, folder: str, kind: str, start, end) -> DataFrame:
    """Flat folders of yearly files (``fire_data_2021.csv``...): a path glob
    lists only the years of [start, end] (pruning before any read) and the
    year of each row's file is checked exactly from ``_metadata.file_name``.
    Files named with ``fire`` are fires, others weather."""
    s, e = as_date(start), as_date(end)
    years = ",".join(str(y) for y in range(s.year, e.year + 1))
    token = "*fire*" if kind == "fire" else "*"
    df = (nan_to_null(spark.read.schema(KIND_SCHEMA[kind]).option("header", True)
                      .csv(f"{folder.rstrip('/')}/{token}_{{{years}}}*.csv"))
          .withColumn("_file", F.col("_metadata.file_name")))
    if kind != "fire":
        df = df.filter(~F.col("_file").contains("fire"))
    return (df.filter(year_from_file_name(F.col("_file")).between(s.year, e.year))
            .drop("_file").distinct()
            .filter(F.col("acq_date").between(date_lit(start), date_lit(end))))


def land_layer(df: DataFrame, folder: str, name: str, resolution: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(
        f"{folder.rstrip('/')}/{name}_{resolution}.csv")


#: Text columns of static layers; every other column is a number.
STATIC_TEXT = ("oblast_id", "city", "name")


def scan_static(spark: SparkSession, folders: list[str], resolution: str = "50km") -> list[DataFrame]:
    """The layer named ``*_<resolution>.csv`` of every folder, lower-case headers.

    Each folder holds one layer per resolution, with its own columns. The files
    are listed first: a folder without a layer at this resolution is skipped,
    any other storage error is raised. Columns are read as text and cast by
    name (no pass to infer types).
    """
    layers = []
    for folder in folders:
        paths = glob(spark, f"{folder.rstrip('/')}/*_{resolution}.csv")
        if not paths:
            continue
        df = spark.read.option("header", True).csv(paths)
        layers.append(nan_to_null(df.select(*[
            (F.col(f"`{c}`") if c.lower() in STATIC_TEXT else F.col(f"`{c}`").cast("double")).alias(c.lower())
            for c in df.columns])))
    if not layers:
        raise FileNotFoundError(f"no static layers for resolution {resolution}")
    return layers


def normalise_feeds(feeds: list[DataFrame]) -> DataFrame:
    """Feeds with any header case and extra columns -> (latitude, longitude,
    acq_date), union all (SC9, SE1)."""
    norm = []
    for f in feeds:
        f = f.toDF(*[c.lower() for c in f.columns])
        norm.append(f.select(F.col("latitude").cast("double"), F.col("longitude").cast("double"),
                             F.col("acq_date").cast("date")))
    return reduce(lambda a, b: a.unionByName(b), norm)


# ---------------------------------------------------------------- polygons (SC4)
_RING_RE = r"\(([^()]+)\)"


def rings_from_wkt(df: DataFrame, wkt_col: str = "wkt", id_col: str = "poly_id") -> DataFrame:
    """POLYGON / MULTIPOLYGON text (lon lat pairs) -> one row per ring:
    (poly_id, ring_no, ring array<struct<lat,lon>>). Holes and parts stay
    rings of the same polygon; the even-odd rule treats them correctly."""
    rings = F.regexp_extract_all(F.col(wkt_col), F.lit(_RING_RE), 1)
    exploded = df.select(id_col, F.posexplode(rings).alias("ring_no", "_txt"))
    pts = F.transform(F.split(F.trim("_txt"), r"\s*,\s*"),
                      lambda p: F.struct(
                          F.split(F.trim(p), r"\s+")[1].cast("double").alias("lat"),
                          F.split(F.trim(p), r"\s+")[0].cast("double").alias("lon")))
    return exploded.select(id_col, "ring_no", pts.alias("ring"))


def rings_to_wkt(rings: DataFrame, id_col: str = "poly_id") -> DataFrame:
    """(poly_id, ring) -> (poly_id, 'POLYGON ((lon lat, ...))') with the ring closed."""
    closed = F.concat(F.col("ring"), F.slice("ring", 1, 1))
    txt = F.array_join(F.transform(closed, lambda v: F.concat_ws(" ", v["lon"].cast("string"),
                                                                 v["lat"].cast("string"))), ", ")
    return rings.select(id_col, F.concat(F.lit("POLYGON (("), txt, F.lit("))")).alias("wkt"))
