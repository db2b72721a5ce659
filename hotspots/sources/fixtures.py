"""Adapters: the study's inputs derived from the driver tables.

Every adapter is a projection of a driver table, so its size follows the scale
factor of that table (fires and hourly readings follow ``events``, weather
follows ``nation`` x days, control vertices follow ``supplier``). The static
layers (grid, land use), the polygons, event windows and overlays have a fixed
extent by definition, like the real layers they stand for; they are still
built from whole tables (every part row is aggregated onto its lattice cell).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hotspots.sources.tables import Tables


def _d(x) -> Column:
    return F.lit(x).cast("double")


def fires(t: Tables) -> DataFrame:
    """Point detections: (event_id, latitude, longitude, acq_date), 4 decimals."""
    ev = t.events
    lat = (F.lit(460000) + (F.col("user_id") % 10) * 5000
           + (F.col("event_id") * 7919) % 7000 - 3500).cast("double") / 10000
    lon = (F.lit(240000) + (F.col("user_id") % 15) * 5000
           + (F.col("event_id") * 104729) % 7000 - 3500).cast("double") / 10000
    return ev.select("event_id", lat.alias("latitude"), lon.alias("longitude"),
                     F.col("ts").cast("date").alias("acq_date"))


def fire_feeds(t: Tables) -> DataFrame:
    """Fires with the satellite feed they came from (the event type)."""
    ev = t.events.select("event_id", F.col("event_type").alias("feed"))
    return fires(t).join(ev, "event_id")


def _lattice(key: Column, rows: int, cols: int):
    """Position of a key on a rows x cols lattice of 0.5 degree cells."""
    lat = (F.lit(91) + key % rows).cast("double") / 2
    lon = (F.lit(47) + F.floor(key / rows).cast("bigint") % cols).cast("double") / 2
    return lat, lon


def grid(t: Tables) -> DataFrame:
    """Region grid with population on an 11 x 16 lattice of 0.5 degree cells.

    Every part lands on the cell of its key; a cell takes the region of its
    smallest key and the largest retail price as population density, so the
    layer is built from the whole table. Fire cells north of 50.5 or east of
    31.0 have no grid row, on purpose.
    """
    k = F.col("p_partkey")
    lat, lon = _lattice(k, 11, 16)
    return (t.part.select(lat.alias("latitude"), lon.alias("longitude"), k, "p_retailprice")
            .groupBy("latitude", "longitude")
            .agg(F.concat(F.lit("UA"), (F.min("p_partkey") % 25).cast("string")).alias("oblast_id"),
                 F.max("p_retailprice").alias("pop_density")))


def land_use(t: Tables) -> DataFrame:
    """Land-use fractions on a 12 x 15 lattice (overlaps the grid only partly).
    A cell uses its smallest key and that part's size."""
    k, s = F.col("p_partkey"), F.col("p_size")
    lat, lon = _lattice(k, 12, 15)
    cell = (t.part.select(lat.alias("latitude"), lon.alias("longitude"), k, s)
            .groupBy("latitude", "longitude")
            .agg(F.min("p_partkey").alias("k"), F.min_by("p_size", "p_partkey").alias("s")))
    raw = cell.select("latitude", "longitude",
                      *[(F.lit(1) + (F.col("k") * m + F.col("s")) % 20).alias(f"a{i}")
                        for i, m in enumerate((3, 5, 7, 11, 13))])
    total = sum((F.col(f"a{i}") for i in range(5)), F.lit(0))
    return raw.select("latitude", "longitude",
                      *[(F.col(f"a{i}").cast("double") / total).alias(f"c{i}") for i in range(5)])


def event_days(t: Tables) -> Column:
    """Scalar subquery: sorted array of the distinct days that carry events."""
    return t.events.select(F.sort_array(F.collect_set(F.col("ts").cast("date")))).scalar()


def weather(t: Tables) -> DataFrame:
    """Daily weather per region with holes: one row per (region, event day)
    unless (nation + day of month) % 13 == 0."""
    n = t.nation
    w = n.select(F.concat(F.lit("UA"), F.col("n_nationkey").cast("string")).alias("oblast_id"),
                 "n_nationkey", F.explode(event_days(t)).alias("acq_date"))
    w = w.filter((F.col("n_nationkey") + F.dayofmonth("acq_date")) % 13 != 0)
    return w.select(
        "oblast_id", "acq_date",
        ((F.col("n_nationkey") * 37 + F.dayofmonth("acq_date") * 11) % 300).cast("double") / 10 - 10,
        ((F.col("n_nationkey") * 17 + F.dayofmonth("acq_date") * 29) % 101).cast("double"),
    ).toDF("oblast_id", "acq_date", "t_mean", "cloud_cover")


def polygon_rings(t: Tables) -> DataFrame:
    """25 convex quadrilaterals as rings: (poly_id, ring array<struct<lat,lon>>)."""
    n = t.nation
    cy = (F.lit(46) + F.col("n_nationkey") % 5).cast("double")
    cx = _d(24) + F.floor(F.col("n_nationkey") / 5).cast("double") * _d(1.5)
    # Fixed vertex offsets (dy, dx) in ring order.
    offsets = [(-0.6, -0.2), (-0.1, 0.9), (0.6, 0.3), (0.1, -0.8)]
    ring = F.array(*[F.struct((cy + _d(dy)).alias("lat"), (cx + _d(dx)).alias("lon"))
                     for dy, dx in offsets])
    return n.select(F.col("n_nationkey").alias("poly_id"), ring.alias("ring"))


def event_windows(t: Tables) -> DataFrame:
    """Five overlapping 10-day windows named after the regions."""
    start = F.date_add(F.lit("2024-01-01").cast("date"), F.col("r_regionkey") * 5)
    end = F.date_add(F.lit("2024-01-01").cast("date"), F.col("r_regionkey") * 5 + 9)
    return t.region.select(F.col("r_name").alias("event"), start.alias("start_date"),
                           end.alias("end_date"))


def overlays(t: Tables) -> DataFrame:
    """One image overlay per nation, with gaps and overlaps; ``pos`` is file order."""
    k = F.col("n_nationkey")
    bounds = F.concat(F.lit("[["), (_d(52.5) - k).cast("string"), F.lit(", 20.4], [44.0, "),
                      (_d(42.5) + k).cast("string"), F.lit("]]"))
    return t.nation.select(
        k.alias("pos"), F.col("n_name").alias("url"), bounds.alias("bounds"),
        F.date_add(F.lit("2024-01-01").cast("date"), k * 2).alias("start_date"),
        F.date_add(F.lit("2024-01-01").cast("date"), k * 2 + k % 3).alias("end_date"))


def hourly_regions(t: Tables) -> DataFrame:
    """Hourly cloud readings keyed like the weather regions (UA0..UA24)."""
    return t.events.select(F.concat(F.lit("UA"), (F.col("user_id") % 25).cast("string")).alias("oblast_id"),
                           "ts", F.col("value").alias("cloud_cover"))


def weather_locations(t: Tables) -> DataFrame:
    """One weather location (city) per region, at the centre of its polygon."""
    k = F.col("n_nationkey")
    return t.nation.select(F.concat(F.lit("UA"), k.cast("string")).alias("oblast_id"),
                           F.col("n_name").alias("city"),
                           (F.lit(46) + k % 5).cast("double").alias("latitude"),
                           (_d(24) + F.floor(k / 5).cast("double") * _d(1.5)).alias("longitude"))


def mercator_vertices(t: Tables) -> DataFrame:
    """Control-zone vertices in Web Mercator metres."""
    k = F.col("s_suppkey")
    return t.supplier.select(k.alias("id"), (F.lit(2500000) + k * 15000).cast("double").alias("x"),
                             (F.lit(5500000) + (k * 7919) % 1400000).cast("double").alias("y"))
