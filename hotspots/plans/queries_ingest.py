"""Source, sink and ingest queries (SC1-SC10, SK1, SK4, A2-A4, J5, TS3-TS5,
PF1-PF3, SE1, SE2, SL3, F1-F5).

Scan queries first land their adapter as files in a fresh folder under the
shared checkpoint location and then read them back lazily.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from hotspots.config import FIXTURE_END, FIXTURE_PERIODS, FIXTURE_START
from hotspots.functions.calendar import DATE_FORMATS, to_date_any
from hotspots.operators import densify as D
from hotspots.operators.prefix import dense_index
from hotspots.operators.spatial import ring_edges
from hotspots.operators.static import static_layers
from hotspots.plans import ingest as I
from hotspots.plans.catalog import register
from hotspots.plans.oracle_sql import with_adapters as W
from hotspots.plans.queries_scoring import scored_fire_frame, sfires_sql
from hotspots.session import scratch_dir
from hotspots.sinks.writers import upsert_yearly, write_scored_fires
from hotspots.sources import fixtures as X
from hotspots.sources import landing as L
from hotspots.sources.tables import Tables


def r6(c):
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def _fire3(t):
    return X.fires(t).select("latitude", "longitude", "acq_date")


def _year_back(df):
    return df.withColumn("acq_date", F.add_months("acq_date", -12))


def _landed(spark, sf, fires=True, weather=True):
    """Land fires (one extra overlapping feed, one earlier year) and weather."""
    t = Tables(spark, sf)
    root = scratch_dir(spark, "landing")
    if fires:
        f = _fire3(t)
        L.land_yearly(f, root, "fire")
        L.land_yearly(X.fire_feeds(t).filter(F.col("feed") == "click")
                      .select("latitude", "longitude", "acq_date"), root, "fire")
        L.land_yearly(_year_back(f), root, "fire")
    if weather:
        w = X.weather(t)
        L.land_yearly(w, root, "weather")
        L.land_yearly(_year_back(w), root, "weather")
    return root


# ---------------------------------------------------------------- SC1 / SC2 / A2 / A3
@register("sc1_yearly_fire_scan", W(["fires"], """
SELECT DISTINCT latitude, longitude, acq_date FROM fires
WHERE acq_date BETWEEN DATE '2024-01-01' AND DATE '2024-01-30'"""))
def q_sc1(spark, sf):
    root = _landed(spark, sf)
    fires, _ = L.scan_dynamic(spark, root, FIXTURE_START, FIXTURE_END)
    return fires


@register("sc2_weather_scan", W(["weather"], """
SELECT DISTINCT * FROM weather WHERE acq_date BETWEEN DATE '2024-01-05' AND DATE '2024-01-25'"""))
def q_sc2(spark, sf):
    root = _landed(spark, sf, fires=False)
    return L.scan_weather(spark, root, "2024-01-05", "2024-01-25")


@register("a2_distinct_fires", W(["fires"], "SELECT DISTINCT latitude, longitude, acq_date FROM fires"))
def q_a2(spark, sf):
    return _fire3(Tables(spark, sf)).distinct()


@register("a3_newest_date", W(["fires"], "SELECT MAX(acq_date) AS newest FROM fires"))
def q_a3(spark, sf):
    root = _landed(spark, sf, weather=False)
    landed = L.read_kind(spark, root, "fire")
    return spark.range(1).select(I.newest_date(landed).alias("newest"))


# ---------------------------------------------------------------- SC3
@register("sc3_static_scan", W(["static"], """
SELECT latitude, longitude, oblast_id, round(pop_density, 6) AS pop_density, round(c0, 6) AS c0,
  round(c1, 6) AS c1, round(c2, 6) AS c2, round(c3, 6) AS c3, round(c4, 6) AS c4 FROM static"""))
def q_sc3(spark, sf):
    t = Tables(spark, sf)
    root = scratch_dir(spark, "static")
    folders = [f"{root}/oblasts", f"{root}/land_use", f"{root}/pop_density"]
    g = X.grid(t)
    L.land_layer(g.select("latitude", "longitude", "oblast_id"), folders[0], "oblasts", "50km")
    L.land_layer(X.land_use(t), folders[1], "land_use", "50km")
    L.land_layer(X.land_use(t).limit(0), folders[1], "land_use", "10km")  # other resolution: ignored
    L.land_layer(g.select("latitude", "longitude", "pop_density"), folders[2], "pop_density", "50km")
    st = static_layers(*L.scan_static(spark, folders, "50km"))
    return st.select("latitude", "longitude", "oblast_id", r6("pop_density").alias("pop_density"),
                     *[r6(f"c{i}").alias(f"c{i}") for i in range(5)])


# ---------------------------------------------------------------- SC4 / SC5
@register("sc4_polygon_source", W(["edges"], """
SELECT poly_id, round(y1, 6) AS y1, round(x1, 6) AS x1, round(y2, 6) AS y2, round(x2, 6) AS x2 FROM edges"""))
def q_sc4(spark, sf):
    t = Tables(spark, sf)
    path = scratch_dir(spark, "borders") + "/borders.json"
    L.rings_to_wkt(X.polygon_rings(t)).write.mode("overwrite").json(path)
    wkt = spark.read.schema("poly_id int, wkt string").json(path)
    e = ring_edges(L.rings_from_wkt(wkt))
    return e.select("poly_id", *[r6(c).alias(c) for c in ("y1", "x1", "y2", "x2")])


@register("sc5_control_zone_source", W(["merc"], """
SELECT id, round(degrees(x / 6378137.0), 6) AS lon,
  round(degrees(2 * atan(exp(y / 6378137.0)) - pi() / 2), 6) AS lat FROM merc"""))
def q_sc5(spark, sf):
    from hotspots.plans.views import reproject_vertices
    t = Tables(spark, sf)
    path = scratch_dir(spark, "control") + "/control.csv"
    (X.mercator_vertices(t).withColumn("CreationDa", F.current_date())
     .withColumn("EditDate", F.current_date())
     .write.mode("overwrite").option("header", True).csv(path))
    raw = spark.read.schema("id bigint, x double, y double, CreationDa date, EditDate date").option(
        "header", True).csv(path)
    v = reproject_vertices(raw.drop("CreationDa", "EditDate"))
    return v.select("id", r6("lon").alias("lon"), r6("lat").alias("lat"))


# ---------------------------------------------------------------- SC6 / SC10
@register("sc6_event_window_source", W(["event_windows"], "SELECT * FROM event_windows"))
def q_sc6(spark, sf):
    t = Tables(spark, sf)
    path = scratch_dir(spark, "events") + "/events.csv"
    (X.event_windows(t).select(F.col("event").alias("EVENT"),
                               F.date_format("start_date", "yyyy-MM-dd").alias("START_DATE"),
                               F.date_format("end_date", "dd-MM-yyyy").alias("END_DATE"))
     .write.mode("overwrite").option("header", True).csv(path))
    raw = spark.read.option("header", True).schema("EVENT string, START_DATE string, END_DATE string").csv(path)
    return raw.select(F.col("EVENT").alias("event"), to_date_any("START_DATE").alias("start_date"),
                      to_date_any("END_DATE").alias("end_date"))


@register("sc10_reference_tables", W(["weather_locations"], "SELECT * FROM weather_locations"))
def q_sc10(spark, sf):
    path = scratch_dir(spark, "ref") + "/locations.csv"
    X.weather_locations(Tables(spark, sf)).write.mode("overwrite").option("header", True).csv(path)
    return spark.read.option("header", True).schema(
        "oblast_id string, city string, latitude double, longitude double").csv(path)


# ---------------------------------------------------------------- SC8 / SK1
@register("sc8_scored_fire_source", sfires_sql("""
SELECT acq_date, longitude, latitude, abnormal_label, round(significance_score, 6) AS significance_score,
  abnormal_label_decay, round(significance_score_decay, 6) AS significance_score_decay FROM sfires"""))
def q_sc8(spark, sf):
    path = scratch_dir(spark, "scored") + "/scored_fires"
    write_scored_fires(scored_fire_frame(spark, sf), path)
    back = spark.read.option("header", True).schema(
        "longitude double, latitude double, abnormal_label int, significance_score double, "
        "abnormal_label_decay int, significance_score_decay double, acq_date date").csv(path)
    return back.select("acq_date", "longitude", "latitude", "abnormal_label",
                       r6("significance_score").alias("significance_score"), "abnormal_label_decay",
                       r6("significance_score_decay").alias("significance_score_decay"))


# ---------------------------------------------------------------- SC9 / SE1 / SE2
def _feeds(spark, sf):
    t = Tables(spark, sf)
    root = scratch_dir(spark, "feeds")
    f = X.fire_feeds(t).join(t.events.select("event_id", "value"), "event_id")
    a = f.filter(F.col("feed").isin("view", "click", "error")).select(
        F.col("latitude").alias("LATITUDE"), F.col("longitude").alias("LONGITUDE"),
        F.col("acq_date").alias("ACQ_DATE"), F.col("value").alias("BRIGHTNESS"), "feed")
    b = f.filter(~F.col("feed").isin("view", "click", "error")).select(
        F.col("latitude").alias("Latitude"), F.col("longitude").alias("Longitude"),
        F.col("acq_date").alias("Acq_Date"), (F.col("event_id") % 100).alias("CONFIDENCE"), "feed")
    a.write.mode("overwrite").partitionBy("feed").option("header", True).csv(f"{root}/a")
    b.write.mode("overwrite").partitionBy("feed").option("header", True).csv(f"{root}/b")
    ra = spark.read.option("header", True).schema(
        "LATITUDE double, LONGITUDE double, ACQ_DATE date, BRIGHTNESS double, feed string").csv(f"{root}/a")
    rb = spark.read.option("header", True).schema(
        "Latitude double, Longitude double, Acq_Date date, CONFIDENCE bigint, feed string").csv(f"{root}/b")
    return ra, rb


@register("sc9_multi_feed_union", W(["fires"], "SELECT latitude, longitude, acq_date FROM fires"))
def q_sc9(spark, sf):
    return L.normalise_feeds(list(_feeds(spark, sf)))


@register("se1_union_all_by_name", W(["fires"], """
SELECT f.latitude, f.longitude, f.acq_date,
  CASE WHEN e.event_type IN ('view','click','error') THEN e.value END AS brightness,
  CASE WHEN e.event_type IN ('view','click','error') THEN NULL ELSE f.event_id % 100 END AS confidence
FROM fires f JOIN events e ON e.event_id = f.event_id"""))
def q_se1(spark, sf):
    ra, rb = _feeds(spark, sf)
    a = ra.drop("feed").toDF("latitude", "longitude", "acq_date", "brightness")
    b = rb.drop("feed").toDF("latitude", "longitude", "acq_date", "confidence")
    return a.unionByName(b, allowMissingColumns=True)


@register("se2_union_distinct", W(["fires"], """
SELECT latitude, longitude, acq_date FROM fires WHERE acq_date <= DATE '2024-01-20'
UNION SELECT latitude, longitude, acq_date FROM fires WHERE acq_date >= DATE '2024-01-10'"""))
def q_se2(spark, sf):
    f = _fire3(Tables(spark, sf))
    early = f.filter(F.col("acq_date") <= F.lit("2024-01-20").cast("date"))
    late = f.filter(F.col("acq_date") >= F.lit("2024-01-10").cast("date"))
    return early.union(late).distinct()


# ---------------------------------------------------------------- SK4 / TS4 / TS3
UPSERT_SQL = W(["weather"], """
, u AS (SELECT oblast_id, acq_date, t_mean, cloud_cover, 0 AS b FROM weather WHERE acq_date < DATE '2024-01-20'
  UNION ALL SELECT oblast_id, acq_date, t_mean, cloud_cover + 1, 1 FROM weather WHERE acq_date >= DATE '2024-01-15')
SELECT DISTINCT oblast_id, acq_date, t_mean, cloud_cover FROM (
  SELECT *, row_number() OVER (PARTITION BY acq_date, oblast_id ORDER BY b DESC) AS rn FROM u) WHERE rn = 1""").replace(
    "\n\n,", ",", 1)


def _upserted(spark, sf):
    t = Tables(spark, sf)
    root = scratch_dir(spark, "upsert")
    w = X.weather(t)
    cut_old = F.lit("2024-01-20").cast("date")
    cut_new = F.lit("2024-01-15").cast("date")
    upsert_yearly(w.filter(F.col("acq_date") < cut_old), root, "weather", ["acq_date", "oblast_id"])
    new = w.filter(F.col("acq_date") >= cut_new).withColumn("cloud_cover", F.col("cloud_cover") + 1)
    return upsert_yearly(new, root, "weather", ["acq_date", "oblast_id"])


@register("sk4_upsert_keep_last", UPSERT_SQL)
def q_sk4(spark, sf):
    return _upserted(spark, sf)


@register("sk4_streaming_upsert", UPSERT_SQL)
def q_sk4s(spark, sf):
    """The same keep-last merge driven by a file-source stream: the old batch
    lands, the stream runs, the new batch lands, the stream resumes from its
    checkpoint and merges only the new files."""
    from hotspots.streaming.ingest_stream import start_upsert_stream
    t = Tables(spark, sf)
    landing = scratch_dir(spark, "stream-landing")
    root = scratch_dir(spark, "stream-table")
    name = root.rstrip("/").rsplit("/", 1)[-1]
    w = X.weather(t)
    batches = [w.filter(F.col("acq_date") < F.lit("2024-01-20").cast("date")),
               w.filter(F.col("acq_date") >= F.lit("2024-01-15").cast("date"))
               .withColumn("cloud_cover", F.col("cloud_cover") + 1)]
    for b in batches:
        b.write.mode("append").option("header", True).csv(landing)
        q = start_upsert_stream(spark, landing, root, "weather", name=name)
        q.awaitTermination()
        if q.exception() is not None:
            raise q.exception()
    return L.read_kind(spark, root, "weather").drop("year")


@register("sk4_fire_append", W(["fires"], "SELECT DISTINCT latitude, longitude, acq_date FROM fires"))
def q_sk4f(spark, sf):
    t = Tables(spark, sf)
    root = scratch_dir(spark, "append")
    f = _fire3(t)
    upsert_yearly(f.filter(F.col("acq_date") < F.lit("2024-01-20").cast("date")), root, "fire", None)
    return upsert_yearly(f.filter(F.col("acq_date") >= F.lit("2024-01-15").cast("date")), root, "fire", None)


@register("ts4_overlap_reread", W(["weather"], """
SELECT * FROM weather WHERE acq_date >= (SELECT MAX(acq_date) FROM weather) - INTERVAL 7 DAY"""))
def q_ts4(spark, sf):
    return I.overlap_rows(X.weather(Tables(spark, sf)), 7)


@register("ts3_request_windows", W(["fires"], """
, nw AS (SELECT MAX(acq_date) AS newest, DATE '2024-02-24' AS today FROM fires),
nd AS (SELECT newest, today, date_diff('day', newest, today) + 1 AS n FROM nw)
SELECT CAST(unnest(CASE WHEN n > 10 THEN generate_series(newest, today, INTERVAL 10 DAY)
  ELSE [CAST(newest AS TIMESTAMP)] END) AS DATE) AS window_start,
  CAST(CASE WHEN n > 10 THEN 10 ELSE n END AS INTEGER) AS n_days FROM nd""").replace("\n\n,", ",", 1))
def q_ts3(spark, sf):
    newest = I.newest_date(_fire3(Tables(spark, sf)))
    return I.request_windows(spark, newest, "2024-02-24")


# ---------------------------------------------------------------- A4 / J5
A4_CTES = """
, hd AS (SELECT oblast_id, CAST(ts AS DATE) AS acq_date, AVG(cloud_cover) AS cloud_cover FROM hourly_regions GROUP BY ALL),
sp AS (SELECT oblast_id, MIN(acq_date) AS lo, MAX(acq_date) AS hi FROM hd GROUP BY oblast_id),
dd AS (SELECT oblast_id, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS acq_date FROM sp),
daily AS (SELECT dd.oblast_id, dd.acq_date, hd.cloud_cover FROM dd LEFT JOIN hd
  ON hd.oblast_id = dd.oblast_id AND hd.acq_date = dd.acq_date)
"""


@register("a4_hourly_to_daily", W(["hourly_regions"], A4_CTES + """
SELECT oblast_id, acq_date, round(cloud_cover, 6) AS cloud_cover FROM daily""").replace("\n\n,", ",", 1))
def q_a4(spark, sf):
    d = I.hourly_to_daily(X.hourly_regions(Tables(spark, sf)))
    return d.select("oblast_id", "acq_date", r6("cloud_cover").alias("cloud_cover"))


@register("j5_daily_hourly_merge", W(["hourly_regions", "weather"], A4_CTES + """
SELECT w.oblast_id, w.acq_date, round(w.t_mean, 6) AS t_mean, round(d.cloud_cover, 6) AS cloud_cover
FROM weather w LEFT JOIN daily d ON d.oblast_id = w.oblast_id AND d.acq_date = w.acq_date""").replace("\n\n,", ",", 1))
def q_j5(spark, sf):
    t = Tables(spark, sf)
    daily = X.weather(t).select("oblast_id", "acq_date", "t_mean")
    m = I.merge_daily_hourly(daily, I.hourly_to_daily(X.hourly_regions(t)))
    return m.select("oblast_id", "acq_date", r6("t_mean").alias("t_mean"), r6("cloud_cover").alias("cloud_cover"))


# ---------------------------------------------------------------- TS5 / SL3
@register("ts5_period_split", W(["series"], """
SELECT grid_cell, acq_date, CASE WHEN acq_date <= DATE '2024-01-16' THEN 'train'
  WHEN acq_date <= DATE '2024-01-23' THEN 'calibration' ELSE 'test' END AS split FROM series"""))
def q_ts5(spark, sf):
    s = D.densify(D.snap_points(X.fires(Tables(spark, sf))), FIXTURE_START, FIXTURE_END)
    return I.label_periods(s, FIXTURE_PERIODS).select("grid_cell", "acq_date", "split")


@register("sl3_first_rows", W(["series"], """
SELECT grid_cell, acq_date, fire_count FROM series ORDER BY acq_date, grid_cell LIMIT 10"""))
def q_sl3(spark, sf):
    s = D.densify(D.snap_points(X.fires(Tables(spark, sf))), FIXTURE_START, FIXTURE_END)
    return s.orderBy("acq_date", "grid_cell").limit(10).select("grid_cell", "acq_date", "fire_count")


# ---------------------------------------------------------------- PF1 / PF2 / PF3
@register("pf1_date_filter", W(["fires"], """
SELECT * FROM fires WHERE acq_date BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'"""))
def q_pf1(spark, sf):
    from hotspots.plans.feature_plan import filter_dates
    return filter_dates(X.fires(Tables(spark, sf)), "2024-01-05", "2024-01-20")


@register("pf2_day_of_year", W(["fires"], """
SELECT event_id, acq_date, CAST(dayofyear(acq_date) AS INTEGER) AS day_of_year FROM fires"""))
def q_pf2(spark, sf):
    return X.fires(Tables(spark, sf)).select("event_id", "acq_date", F.dayofyear("acq_date").alias("day_of_year"))


@register("pf3_dense_fire_id", W(["fires"], """
SELECT event_id, CAST(row_number() OVER (ORDER BY acq_date, latitude, longitude, event_id) - 1 AS BIGINT) AS fire_id
FROM fires"""))
def q_pf3(spark, sf):
    f = X.fires(Tables(spark, sf))
    return dense_index(f, ["acq_date", "latitude", "longitude", "event_id"], "fire_id").select(
        "event_id", "fire_id")


# ---------------------------------------------------------------- F1-F5
@register("f1_parse_dates", W(["fires"], """
SELECT event_id, acq_date AS d_iso, acq_date AS d_dmy, acq_date AS d_slash FROM fires"""))
def q_f1(spark, sf):
    f = X.fires(Tables(spark, sf))
    return f.select("event_id",
                    to_date_any(F.date_format("acq_date", "yyyy-MM-dd")).alias("d_iso"),
                    to_date_any(F.date_format("acq_date", "dd-MM-yyyy")).alias("d_dmy"),
                    to_date_any(F.date_format("acq_date", "yyyy/MM/dd")).alias("d_slash"))


@register("f1_mixed_dates", W(["fires"], """
SELECT event_id, CASE WHEN event_id % 7 = 6 THEN NULL ELSE acq_date END AS parsed, event_id % 7 = 5 AS refused FROM fires"""))
def q_f1m(spark, sf):
    """Dates as texts of all accepted formats in one column: those that parse,
    and the invalid ones that the strict form would raise an error for."""
    f = X.fires(Tables(spark, sf))
    d = F.col("acq_date")
    kind = F.col("event_id") % 7
    text = F.coalesce(*[F.when(kind == i, F.date_format(d, form)) for i, form in enumerate(DATE_FORMATS)])
    valid = F.when(kind < 5, text)
    checked = F.coalesce(to_date_any(valid), F.when(kind == 5, d))
    spoilt = F.when(kind == 5, F.concat(F.lit("day "), F.date_format(d, "D")))
    return f.select("event_id", checked.alias("parsed"),
                    (spoilt.isNotNull() & to_date_any(spoilt, strict=False).isNull()).alias("refused"))


@register("f2_f5_date_functions", W(["fires"], """
SELECT event_id, CAST(year(acq_date) AS INTEGER) AS year, CAST(dayofyear(acq_date) AS INTEGER) AS day_of_year,
  CAST(date_diff('day', DATE '2024-01-01', acq_date) AS DOUBLE) AS days_since_start,
  CAST(acq_date + INTERVAL 7 DAY AS DATE) AS week_later, strftime(acq_date, '%d-%m-%Y') AS dmy_text FROM fires"""))
def q_f2(spark, sf):
    from hotspots.functions.calendar import date_lit, days_between
    f = X.fires(Tables(spark, sf))
    return f.select("event_id", F.year("acq_date").alias("year"), F.dayofyear("acq_date").alias("day_of_year"),
                    days_between("acq_date", date_lit("2024-01-01")).alias("days_since_start"),
                    F.date_add("acq_date", 7).alias("week_later"),
                    F.date_format("acq_date", "dd-MM-yyyy").alias("dmy_text"))
