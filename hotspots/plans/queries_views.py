"""Analysis-view queries over scored fires (A5-A10, J7-J9, PF10, PF12, F16, F17, SC7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from hotspots.plans import views as V
from hotspots.plans.catalog import register
from hotspots.plans.oracle_sql import with_adapters as W
from hotspots.plans.queries_scoring import scored_fire_frame, sfires_sql
from hotspots.sources import fixtures as X
from hotspots.sources.tables import Tables

_EXTRA = ("weather", "event_windows", "overlays", "grid")


def r6(c):
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def vsql(body: str) -> str:
    return sfires_sql(body, _EXTRA)


@register("a5_abnormal_per_day", vsql("""
, rng AS (SELECT MIN(acq_date) AS lo, MAX(acq_date) AS hi FROM sfires),
days AS (SELECT CAST(unnest(generate_series((SELECT lo FROM rng), (SELECT hi FROM rng), INTERVAL 1 DAY)) AS DATE) AS acq_date),
cnt AS (SELECT acq_date, COUNT(*) AS n FROM sfires WHERE abnormal_label_decay = 1 GROUP BY acq_date)
SELECT d.acq_date, CAST(COALESCE(cnt.n, 0) AS BIGINT) AS n_abnormal FROM days d LEFT JOIN cnt ON cnt.acq_date = d.acq_date"""))
def q_a5(spark, sf):
    return V.abnormal_per_day(scored_fire_frame(spark, sf))


@register("a6_class_counts_per_day", vsql("""
SELECT acq_date, COUNT(*) FILTER (WHERE abnormal_label_decay = 1) AS n_abnormal,
  COUNT(*) FILTER (WHERE abnormal_label_decay = 0) AS n_normal FROM sfires GROUP BY acq_date"""))
def q_a6(spark, sf):
    return V.class_counts_per_day(scored_fire_frame(spark, sf))


@register("a7_global_ranges", vsql("""
, rng AS (SELECT MIN(acq_date) AS lo, MAX(acq_date) AS hi FROM sfires)
SELECT (SELECT lo FROM rng) AS min_date, (SELECT hi FROM rng) AS max_date,
  round(MIN(t_mean), 6) AS min_temp, round(MAX(t_mean), 6) AS max_temp
FROM weather WHERE acq_date BETWEEN (SELECT lo FROM rng) AND (SELECT hi FROM rng)"""))
def q_a7(spark, sf):
    t = Tables(spark, sf)
    g = V.global_ranges(scored_fire_frame(spark, sf), X.weather(t))
    return g.select("min_date", "max_date", r6("min_temp").alias("min_temp"), r6("max_temp").alias("max_temp"))


@register("a8_colour_range_per_event", vsql("""
, ins AS (SELECT w.event, f.significance_score_decay AS s FROM sfires f JOIN event_windows w
    ON f.acq_date BETWEEN w.start_date AND w.end_date WHERE f.abnormal_label_decay = 1),
ag AS (SELECT event, MIN(s) AS mn, MAX(s) AS mx FROM ins GROUP BY event)
SELECT w.event, w.start_date, w.end_date,
  round(CASE WHEN ag.mn IS NULL OR ag.mn > 0 THEN CAST(0 AS DOUBLE) ELSE ag.mn END, 6) AS vmin,
  round(CASE WHEN ag.mx IS NULL OR ag.mx < 0 THEN CAST(0 AS DOUBLE) ELSE ag.mx END, 6) AS vmax
FROM event_windows w LEFT JOIN ag ON ag.event = w.event"""))
def q_a8(spark, sf):
    t = Tables(spark, sf)
    c = V.colour_range_per_event(scored_fire_frame(spark, sf), X.event_windows(t))
    return c.select("event", "start_date", "end_date", r6("vmin").alias("vmin"), r6("vmax").alias("vmax"))


@register("j9_fires_in_event_windows", vsql("""
SELECT w.event, f.acq_date, f.latitude, f.longitude, f.abnormal_label_decay,
  round(f.significance_score_decay, 6) AS significance_score_decay
FROM sfires f JOIN event_windows w ON f.acq_date BETWEEN w.start_date AND w.end_date"""))
def q_j9(spark, sf):
    t = Tables(spark, sf)
    j = V.fires_in_windows(scored_fire_frame(spark, sf), X.event_windows(t))
    return j.select("event", "acq_date", "latitude", "longitude", "abnormal_label_decay",
                    r6("significance_score_decay").alias("significance_score_decay"))


@register("a9_score_histogram", vsql("""
, hs AS (SELECT CASE WHEN abnormal_label_decay = 1 THEN 'abnormal' ELSE 'normal' END AS class,
    significance_score_decay AS x FROM sfires WHERE significance_score_decay IS NOT NULL),
rg AS (SELECT class, MIN(x) AS lo, MAX(x) AS hi FROM hs GROUP BY class),
nb AS (SELECT GREATEST(CAST(floor((hi - lo) / CAST(0.05 AS DOUBLE)) AS BIGINT), 1) AS n FROM rg WHERE class = 'normal'),
p AS (SELECT rg.class, rg.lo, rg.hi, nb.n, (rg.hi - rg.lo) / CAST(nb.n AS DOUBLE) AS step FROM rg, nb),
b0 AS (SELECT hs.class, hs.x, p.lo, p.hi, p.n, p.step,
    CASE WHEN p.step > 0 THEN LEAST(GREATEST(CAST(floor((hs.x - p.lo) * (CAST(p.n AS DOUBLE) / (p.hi - p.lo))) AS BIGINT), 0), p.n - 1)
         ELSE 0 END AS b FROM hs JOIN p ON p.class = hs.class),
b1 AS (SELECT *, CASE WHEN step > 0 AND x < (CASE WHEN b = n THEN hi ELSE CAST(b AS DOUBLE) * step + lo END) THEN b - 1 ELSE b END AS b1 FROM b0),
b2 AS (SELECT class, CASE WHEN step > 0 AND x >= (CASE WHEN b1 + 1 = n THEN hi ELSE CAST(b1 + 1 AS DOUBLE) * step + lo END) AND b1 <> n - 1
    THEN b1 + 1 ELSE b1 END AS bin FROM b1),
cnt AS (SELECT class, bin, COUNT(*) AS n FROM b2 GROUP BY class, bin),
allb AS (SELECT p.class, CAST(k AS INTEGER) AS bin,
    CASE WHEN k = p.n THEN p.hi ELSE CAST(k AS DOUBLE) * p.step + p.lo END AS lo,
    CASE WHEN k + 1 = p.n THEN p.hi ELSE CAST(k + 1 AS DOUBLE) * p.step + p.lo END AS hi
  FROM p, LATERAL (SELECT unnest(range(p.n)) AS k) r)
SELECT a.class, a.bin, round(a.lo, 6) AS lo, round(a.hi, 6) AS hi, CAST(COALESCE(cnt.n, 0) AS BIGINT) AS n
FROM allb a LEFT JOIN cnt ON cnt.class = a.class AND cnt.bin = a.bin"""))
def q_a9(spark, sf):
    h = V.score_histogram(scored_fire_frame(spark, sf))
    return h.select("class", "bin", r6("lo").alias("lo"), r6("hi").alias("hi"), "n")


@register("a10_cluster_summary", W(["series", "snapped"], __import__(
    "hotspots.plans.queries_scoring", fromlist=["SCORE_CTES"]).SCORE_CTES + """
, sfc AS (SELECT s.grid_cell AS cluster, s.acq_date, s.latitude_original AS latitude,
    s.longitude_original AS longitude, f.significance_score_decay, f.abnormal_label_decay
  FROM snapped s LEFT JOIN final f ON f.grid_cell = s.grid_cell AND f.acq_date = s.acq_date),
cg AS (SELECT acq_date, CASE WHEN abnormal_label_decay = 1 THEN 'abnormal' ELSE 'normal' END AS label, cluster,
    SUM(CAST(round_even(latitude * 1e6, 0) AS BIGINT)) / COUNT(*) / 1e6 AS clat,
    SUM(CAST(round_even(longitude * 1e6, 0) AS BIGINT)) / COUNT(*) / 1e6 AS clon,
    AVG(significance_score_decay) AS ms, COUNT(*) AS size
  FROM sfc GROUP BY ALL),
cs AS (SELECT *, CASE WHEN label = 'normal' THEN -ms ELSE ms END AS sm FROM cg)
SELECT acq_date, label, cluster, clat AS center_lat, clon AS center_lon,
  'Lat: ' || CAST(CAST(format('{:.4f}', clat) AS DOUBLE) AS VARCHAR) AS lat_text,
  'Lon: ' || CAST(CAST(format('{:.4f}', clon) AS DOUBLE) AS VARCHAR) AS lon_text,
  round(sm * 100, 2) AS significance_pct, 'Significance: ' || CAST(CAST(format('{:.2f}', sm * 100) AS DOUBLE) AS VARCHAR) || '%' AS significance_text, size, round(5 + ln(1 + CAST(size AS DOUBLE)) * 2, 6) AS marker_size,
  CASE WHEN label = 'abnormal' THEN 'War-related' ELSE 'Non war-related' END AS fire_type,
  CASE WHEN size > 1 THEN 'Cluster of ' || CAST(size AS VARCHAR) || ' fires' ELSE 'Single fire' END AS cluster_size
FROM cs""").replace("\n\n,", ",", 1))
def q_a10(spark, sf):
    f = scored_fire_frame(spark, sf, keep_cell=True).withColumnRenamed("grid_cell", "cluster")
    c = V.cluster_summary(f)
    # score in percent with 2 places (display precision); centres are exact micro-degree means
    return c.select("acq_date", "label", "cluster", "center_lat", "center_lon", "lat_text", "lon_text",
                    "significance_pct", "significance_text", "size", r6("marker_size").alias("marker_size"), "fire_type", "cluster_size")


@register("j7_region_day_layers", vsql("""
, rng AS (SELECT MIN(acq_date) AS lo, MAX(acq_date) AS hi FROM sfires),
regions AS (SELECT DISTINCT oblast_id FROM grid),
days AS (SELECT CAST(unnest(generate_series((SELECT lo FROM rng), (SELECT hi FROM rng), INTERVAL 1 DAY)) AS DATE) AS acq_date),
w AS (SELECT * FROM weather WHERE acq_date BETWEEN (SELECT lo FROM rng) AND (SELECT hi FROM rng)),
tr AS (SELECT MIN(t_mean) AS tmin, MAX(t_mean) AS tmax FROM w),
w1 AS (SELECT oblast_id, acq_date, arg_min(cloud_cover, (cloud_cover, t_mean)) AS cloud_cover,
    arg_min(t_mean, (cloud_cover, t_mean)) AS t_mean FROM w GROUP BY oblast_id, acq_date),
j AS (SELECT r.oblast_id, d.acq_date, w1.cloud_cover, COALESCE(w1.t_mean, CAST(0 AS DOUBLE)) AS temp
  FROM regions r CROSS JOIN days d LEFT JOIN w1 ON w1.oblast_id = r.oblast_id AND w1.acq_date = d.acq_date)
SELECT oblast_id, acq_date, round(COALESCE(cloud_cover / 100, CAST(0 AS DOUBLE)), 6) AS cloud_opacity,
  round(temp, 6) AS mean_temperature,
  round(CASE WHEN tr.tmax = tr.tmin THEN NULL ELSE (temp - tr.tmin) / (tr.tmax - tr.tmin) END, 6) AS temperature_scaled
FROM j, tr"""))
def q_j7(spark, sf):
    t = Tables(spark, sf)
    scored = scored_fire_frame(spark, sf)
    lo, hi = V.date_range_of(scored)
    regions = X.grid(t).select("oblast_id").distinct()
    r = V.region_day_layers(regions, X.weather(t), lo, hi)
    return r.select("oblast_id", "acq_date", r6("cloud_opacity").alias("cloud_opacity"),
                    r6("mean_temperature").alias("mean_temperature"),
                    r6("temperature_scaled").alias("temperature_scaled"))


@register("j8_overlay_per_day", vsql("""
, rng AS (SELECT MIN(acq_date) AS lo, MAX(acq_date) AS hi FROM sfires),
days AS (SELECT CAST(unnest(generate_series((SELECT lo FROM rng), (SELECT hi FROM rng), INTERVAL 1 DAY)) AS DATE) AS acq_date),
m AS (SELECT d.acq_date, o.pos, o.url, CAST(o.bounds AS DOUBLE[][]) AS b,
    row_number() OVER (PARTITION BY d.acq_date ORDER BY o.pos NULLS LAST) AS rn
  FROM days d LEFT JOIN overlays o ON d.acq_date BETWEEN o.start_date AND o.end_date)
SELECT acq_date, pos, url, b[1][1] AS lat1, b[1][2] AS lon1, b[2][1] AS lat2, b[2][2] AS lon2
FROM m WHERE rn = 1"""))
def q_j8(spark, sf):
    t = Tables(spark, sf)
    scored = scored_fire_frame(spark, sf)
    lo, hi = V.date_range_of(scored)
    days = spark.range(1).select(F.explode(F.sequence(lo, hi, F.expr("INTERVAL 1 DAY"))).alias("acq_date"))
    o = V.overlay_per_day(days, X.overlays(t))
    b = F.col("bounds")
    return o.select("acq_date", "pos", "url", b[0][0].alias("lat1"), b[0][1].alias("lon1"),
                    b[1][0].alias("lat2"), b[1][1].alias("lon2"))


@register("sc7_overlays", W(["overlays"], """
SELECT pos, url, b[1][1] AS lat1, b[1][2] AS lon1, b[2][1] AS lat2, b[2][2] AS lon2, start_date, end_date
FROM (SELECT *, CAST(bounds AS DOUBLE[][]) AS b FROM overlays)"""))
def q_sc7(spark, sf):
    o = V.parse_overlays(X.overlays(Tables(spark, sf)))
    b = F.col("bounds")
    return o.select("pos", "url", b[0][0].alias("lat1"), b[0][1].alias("lon1"), b[1][0].alias("lat2"),
                    b[1][1].alias("lon2"), "start_date", "end_date")


@register("pf10_capped_population", W(["grid"], """
SELECT latitude, longitude, round(CASE WHEN pop_density > 250 THEN CAST(250 AS DOUBLE) ELSE pop_density END, 6) AS pop_density
FROM grid"""))
def q_pf10(spark, sf):
    c = V.capped_population(X.grid(Tables(spark, sf)))
    return c.select("latitude", "longitude", r6("pop_density").alias("pop_density"))


@register("pf12_dominant_land_use", W(["land_use"], """
SELECT latitude, longitude, CAST(CASE WHEN c0 = greatest(c0,c1,c2,c3,c4) THEN 0 WHEN c1 = greatest(c0,c1,c2,c3,c4) THEN 1
  WHEN c2 = greatest(c0,c1,c2,c3,c4) THEN 2 WHEN c3 = greatest(c0,c1,c2,c3,c4) THEN 3 ELSE 4 END AS INTEGER) AS land_use_class
FROM land_use"""))
def q_pf12(spark, sf):
    return V.dominant_land_use(X.land_use(Tables(spark, sf)))


@register("f17_mercator_to_lonlat", W(["merc"], """
SELECT id, round(degrees(x / 6378137.0), 6) AS lon,
  round(degrees(2 * atan(exp(y / 6378137.0)) - pi() / 2), 6) AS lat FROM merc"""))
def q_f17(spark, sf):
    v = V.reproject_vertices(X.mercator_vertices(Tables(spark, sf)))
    return v.select("id", r6("lon").alias("lon"), r6("lat").alias("lat"))
