"""Ingest and feature queries: snap, spatial join, densify, static layers, features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hotspots.config import FIXTURE_END, FIXTURE_START
from hotspots.functions import geo
from hotspots.operators import densify as D
from hotspots.operators.quantiles import exact_percentiles
from hotspots.operators.spatial import points_in_polygons, ring_edges
from hotspots.operators.static import merge_layers, static_layers
from hotspots.plans.catalog import register
from hotspots.plans.feature_plan import DataPipeline
from hotspots.plans.oracle_sql import with_adapters as W
from hotspots.sources import fixtures as X
from hotspots.sources.tables import Tables


def r6(c):
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


# ---------------------------------------------------------------- PF4 / PF5
def _exact_sql(x: str, k: int) -> str:
    """DuckDB restatement of the exact half-even scaled rounding."""
    p = f"({x}*{k}.0)"
    big = f"({x}*134217729.0)"
    hi = f"({big} - ({big} - {x}))"
    err = f"(({hi}*{k}.0 - {p}) + ({x} - {hi})*{k}.0)"
    fl = f"floor({p})"
    return (f"(CASE WHEN {p} - {fl} = 0.5 AND {err} > 0 THEN {fl} + 1 "
            f"WHEN {p} - {fl} = 0.5 AND {err} < 0 THEN {fl} ELSE round_even({p}, 0) END)")


@register("pf4_snap_grid", W(["fires"], f"""
SELECT event_id,
  round_even(latitude*2,0)/2 + 0.0 AS lat_50km, round_even(longitude*2,0)/2 + 0.0 AS lon_50km,
  round({_exact_sql('latitude', 10)}/10 + 0.0, 6) AS lat_10km, round({_exact_sql('longitude', 10)}/10 + 0.0, 6) AS lon_10km,
  round({_exact_sql('latitude', 100)}/100 + 0.0, 6) AS lat_1km, round({_exact_sql('longitude', 100)}/100 + 0.0, 6) AS lon_1km
FROM fires"""))
def q_pf4(spark: SparkSession, sf: str) -> DataFrame:
    f = X.fires(Tables(spark, sf))
    cols = [F.col("event_id")]
    for res in ("50km", "10km", "1km"):
        cols += [r6(geo.snap("latitude", res)).alias(f"lat_{res}"),
                 r6(geo.snap("longitude", res)).alias(f"lon_{res}")]
    return f.select(*cols)


@register("pf5_grid_cell", W(["snapped"], "SELECT event_id, grid_cell FROM snapped"))
def q_pf5(spark, sf):
    return D.snap_points(X.fires(Tables(spark, sf))).select("event_id", "grid_cell")


# ---------------------------------------------------------------- TS1 / W1 / W2
@register("ts1_densify", W(["series"], "SELECT * FROM series"))
def q_ts1(spark, sf):
    snapped = D.snap_points(X.fires(Tables(spark, sf)))
    return D.densify(snapped, FIXTURE_START, FIXTURE_END)


@register("w1_fire_count_per_cell_day", W(["snapped"], """
SELECT event_id, grid_cell, acq_date, COUNT(*) OVER (PARTITION BY grid_cell, acq_date) AS fire_count_cell
FROM snapped"""))
def q_w1(spark, sf):
    s = D.snap_points(X.fires(Tables(spark, sf))).select("event_id", "grid_cell", "acq_date")
    return D.with_cell_day_count(s)


@register("w2_cell_constants", W(["cells"], "SELECT * FROM cells"))
def q_w2(spark, sf):
    return D.cell_constants(D.snap_points(X.fires(Tables(spark, sf))))


@register("a14_distinct_cells", W(["snapped"], "SELECT DISTINCT grid_cell FROM snapped"))
def q_a14(spark, sf):
    return D.snap_points(X.fires(Tables(spark, sf))).select("grid_cell").distinct()


# ---------------------------------------------------------------- J1
J1_SQL = W(["fires", "edges"], """
SELECT p.event_id, p.latitude, p.longitude, p.acq_date, e.poly_id
FROM fires p JOIN edges e
  ON (e.y1 > p.latitude) <> (e.y2 > p.latitude)
 AND p.longitude < e.x1 + (p.latitude - e.y1) * (e.x2 - e.x1) / (e.y2 - e.y1)
GROUP BY p.event_id, p.latitude, p.longitude, p.acq_date, e.poly_id
HAVING COUNT(*) % 2 = 1""")


@register("j1_point_in_polygon", J1_SQL)
def q_j1(spark, sf):
    t = Tables(spark, sf)
    edges = ring_edges(X.polygon_rings(t))
    return points_in_polygons(X.fires(t), edges, keep_poly=True)


# ---------------------------------------------------------------- J2 / A1 / static
@register("j2_merge_static_layers", W(["grid", "land_use"], """
SELECT COALESCE(g.longitude,l.longitude) AS longitude, COALESCE(g.latitude,l.latitude) AS latitude,
  g.oblast_id, g.pop_density, l.c0, l.c1, l.c2, l.c3, l.c4
FROM grid g FULL OUTER JOIN land_use l ON g.longitude=l.longitude AND g.latitude=l.latitude"""))
def q_j2(spark, sf):
    t = Tables(spark, sf)
    return merge_layers(X.grid(t), X.land_use(t))


@register("a1_winsorise_population", W(["static"], """
SELECT latitude, longitude, oblast_id, pop_density, c0, c1, c2, c3, c4 FROM static"""))
def q_a1(spark, sf):
    t = Tables(spark, sf)
    return static_layers(X.grid(t), X.land_use(t)).select(
        "latitude", "longitude", "oblast_id", "pop_density", "c0", "c1", "c2", "c3", "c4")


@register("a1_population_p95", W(["grid", "land_use"], """
SELECT round(quantile_cont(pop_density, 0.95), 6) AS p95 FROM (
SELECT g.pop_density FROM grid g FULL OUTER JOIN land_use l ON g.longitude=l.longitude AND g.latitude=l.latitude) m"""))
def q_a1p(spark, sf):
    t = Tables(spark, sf)
    m = merge_layers(X.grid(t), X.land_use(t))
    found = exact_percentiles(m.select(F.lit("pop_density").alias("feature"), F.col("pop_density").alias("x")), [0.95])
    value = found.get("pop_density", [None])[0]
    return spark.range(1).select(r6(F.lit(value).cast("double")).alias("p95"))


# ---------------------------------------------------------------- M15 flagship
FEATURE_COLS = ["grid_cell", "acq_date", "latitude", "longitude", "latitude_original",
                "longitude_original", "day_of_year", "fire_count", "oblast_id", "pop_density",
                "c0", "c1", "c2", "c3", "c4", "t_mean", "cloud_cover"]


def _round_features(df: DataFrame) -> DataFrame:
    doubles = {"pop_density", "c0", "c1", "c2", "c3", "c4", "t_mean", "cloud_cover"}
    return df.select(*[r6(c).alias(c) if c in doubles else F.col(c) for c in FEATURE_COLS])


def features_no_border(spark, sf) -> DataFrame:
    """Features without the border filter (the probe chain of the fixtures)."""
    t = Tables(spark, sf)
    pipe = DataPipeline().fit(X.grid(t), X.land_use(t))
    return pipe.transform(X.fires(t), X.weather(t), FIXTURE_START, FIXTURE_END)


def features_in_borders(spark, sf) -> DataFrame:
    t = Tables(spark, sf)
    pipe = DataPipeline().fit(X.grid(t), X.land_use(t))
    edges = ring_edges(X.polygon_rings(t))
    return pipe.transform(X.fires(t), X.weather(t), FIXTURE_START, FIXTURE_END, edges=edges)


@register("j3_j4_cell_day_features", W(["features"], """
SELECT grid_cell, acq_date, latitude, longitude, latitude_original, longitude_original, day_of_year,
  fire_count, oblast_id, round(pop_density,6) AS pop_density, round(c0,6) AS c0, round(c1,6) AS c1,
  round(c2,6) AS c2, round(c3,6) AS c3, round(c4,6) AS c4, round(t_mean,6) AS t_mean,
  round(cloud_cover,6) AS cloud_cover FROM features"""))
def q_features(spark, sf):
    return _round_features(features_no_border(spark, sf))


M15_SQL = W(["fires", "edges", "cal", "static", "weather"], """
, inside AS (
  SELECT p.latitude, p.longitude, p.acq_date
  FROM (SELECT DISTINCT latitude, longitude, acq_date FROM fires WHERE acq_date BETWEEN DATE '2024-01-01' AND DATE '2024-01-30') p
  JOIN edges e ON (e.y1 > p.latitude) <> (e.y2 > p.latitude)
   AND p.longitude < e.x1 + (p.latitude - e.y1) * (e.x2 - e.x1) / (e.y2 - e.y1)
  GROUP BY p.latitude, p.longitude, p.acq_date, e.poly_id HAVING COUNT(*) % 2 = 1),
snapped AS (SELECT acq_date, latitude AS latitude_original, longitude AS longitude_original,
  round_even(latitude*2,0)/2 + 0.0 AS latitude, round_even(longitude*2,0)/2 + 0.0 AS longitude,
  CAST(round_even(latitude*2,0)/2 + 0.0 AS VARCHAR) || '_' || CAST(round_even(longitude*2,0)/2 + 0.0 AS VARCHAR) AS grid_cell
  FROM inside),
cells AS (SELECT grid_cell, any_value(latitude) AS latitude, any_value(longitude) AS longitude,
  arg_min(latitude_original, (acq_date, latitude_original, longitude_original)) AS latitude_original,
  arg_min(longitude_original, (acq_date, latitude_original, longitude_original)) AS longitude_original
  FROM snapped GROUP BY grid_cell),
counts AS (SELECT grid_cell, acq_date, COUNT(*) AS fire_count FROM snapped GROUP BY grid_cell, acq_date),
series AS (SELECT c.grid_cell, cal.d AS acq_date, c.latitude, c.longitude, c.latitude_original,
  c.longitude_original, CAST(dayofyear(cal.d) AS INTEGER) AS day_of_year,
  CAST(COALESCE(n.fire_count,0) AS BIGINT) AS fire_count
  FROM cells c CROSS JOIN cal LEFT JOIN counts n ON n.grid_cell=c.grid_cell AND n.acq_date=cal.d)
SELECT s.grid_cell, s.acq_date, s.latitude, s.longitude, s.latitude_original, s.longitude_original,
  s.day_of_year, s.fire_count, st.oblast_id, round(st.pop_density,6) AS pop_density,
  round(st.c0,6) AS c0, round(st.c1,6) AS c1, round(st.c2,6) AS c2, round(st.c3,6) AS c3,
  round(st.c4,6) AS c4, round(w.t_mean,6) AS t_mean, round(w.cloud_cover,6) AS cloud_cover
FROM series s LEFT JOIN static st ON s.latitude=st.latitude AND s.longitude=st.longitude
LEFT JOIN weather w ON w.oblast_id=st.oblast_id AND w.acq_date=s.acq_date""").replace("\n\n,", ",", 1)


@register("m15_cell_day_features", M15_SQL)
def q_m15(spark, sf):
    return _round_features(features_in_borders(spark, sf))

