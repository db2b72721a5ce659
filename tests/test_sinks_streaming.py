import datetime as dt

from pyspark.sql import functions as F

from hotspots.session import scratch_dir
from hotspots.sinks.writers import upsert_yearly
from hotspots.sources import landing as L
from hotspots.streaming.ingest_stream import start_upsert_stream


def _w(spark, rows):
    return spark.createDataFrame(rows, "oblast_id string, acq_date date, t_mean double, cloud_cover double")


def test_upsert_keep_last_and_new_year(spark):
    root = scratch_dir(spark, "t-upsert")
    d = dt.date
    upsert_yearly(_w(spark, [("A", d(2023, 12, 31), 1.0, 1.0), ("A", d(2024, 1, 1), 1.0, 1.0),
                             ("A", d(2024, 1, 1), 1.0, 1.0)]), root, "weather", ["acq_date", "oblast_id"])
    out = upsert_yearly(_w(spark, [("A", d(2024, 1, 1), 2.0, 2.0), ("B", d(2025, 1, 1), 3.0, 3.0)]),
                        root, "weather", ["acq_date", "oblast_id"])
    got = sorted((r.oblast_id, r.acq_date, r.t_mean) for r in out.collect())
    assert got == [("A", d(2023, 12, 31), 1.0), ("A", d(2024, 1, 1), 2.0), ("B", d(2025, 1, 1), 3.0)]
    years = sorted(r[0] for r in L.read_kind(spark, root, "weather").select("year").distinct().collect())
    assert years == [2023, 2024, 2025]


def test_streaming_upsert(spark):
    landing = scratch_dir(spark, "t-landing")
    root = scratch_dir(spark, "t-table")
    d = dt.date
    _w(spark, [("A", d(2024, 1, 1), 1.0, 10.0)]).write.mode("append").option("header", True).csv(landing)
    q = start_upsert_stream(spark, landing, root, "weather", name="t1")
    q.awaitTermination(120)
    _w(spark, [("A", d(2024, 1, 1), 5.0, 50.0), ("A", d(2024, 1, 2), 6.0, 60.0)]).write.mode(
        "append").option("header", True).csv(landing)
    q = start_upsert_stream(spark, landing, root, "weather", name="t1")
    q.awaitTermination(120)
    got = sorted((r.acq_date, r.t_mean) for r in L.read_kind(spark, root, "weather").collect())
    assert got == [(d(2024, 1, 1), 5.0), (d(2024, 1, 2), 6.0)]


def test_scan_prunes_years(spark):
    root = scratch_dir(spark, "t-scan")
    d = dt.date
    rows = [(46.0, 24.0, d(2023, 5, 1)), (46.0, 24.0, d(2024, 5, 1)), (46.0, 24.0, d(2024, 5, 1))]
    L.land_yearly(spark.createDataFrame(rows, "latitude double, longitude double, acq_date date"), root, "fire")
    f = L.scan_years(spark, root, "fire", "2024-01-01", "2024-12-31")
    assert f.count() == 1
    plan = f._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan or "year" in plan
    assert f.filter(F.year("acq_date") == 2023).count() == 0


def test_flat_yearly_files(spark, tmp_path):
    d = tmp_path
    (d / "fire_data_2023.csv").write_text("latitude,longitude,acq_date\n46.0,24.0,2023-05-01\n")
    (d / "fire_data_2024.csv").write_text(
        "latitude,longitude,acq_date\n46.0,24.0,2024-05-01\n46.0,24.0,2024-05-01\n47.0,25.0,2024-12-31\n")
    (d / "weather_2024.csv").write_text("oblast_id,acq_date,t_mean,cloud_cover\nUA1,2024-05-01,1.0,2.0\n")
    f = L.scan_flat_yearly(spark, f"file://{d}", "fire", "2024-01-01", "2024-06-30")
    assert [(r.latitude, r.acq_date) for r in f.collect()] == [(46.0, dt.date(2024, 5, 1))]
    w = L.scan_flat_yearly(spark, f"file://{d}", "weather", "2024-01-01", "2024-12-31")
    assert w.count() == 1


def test_streaming_daily_counts(spark):
    from hotspots.streaming.ingest_stream import daily_cell_counts_stream, landed_stream
    landing = scratch_dir(spark, "t-fire-landing")
    d = dt.date
    rows = [(46.1, 24.1, d(2024, 1, 1)), (46.2, 24.2, d(2024, 1, 1)), (47.0, 25.0, d(2024, 1, 2)),
            (46.1, 24.1, d(2024, 1, 9))]
    spark.createDataFrame(rows, "latitude double, longitude double, acq_date date").write.mode(
        "append").option("header", True).csv(landing)
    counts = daily_cell_counts_stream(landed_stream(spark, landing, "fire"))
    q = (counts.writeStream.outputMode("append").format("memory").queryName("daily_counts_t")
         .option("checkpointLocation", scratch_dir(spark, "t-stream-ckpt")).trigger(availableNow=True).start())
    q.awaitTermination(120)
    got = sorted((r.acq_date, r.grid_cell, r.fire_count) for r in spark.sql("SELECT * FROM daily_counts_t").collect())
    # days at least two days older than the newest event time are final
    assert (d(2024, 1, 1), "46.0_24.0", 2) in got
    assert (d(2024, 1, 2), "47.0_25.0", 1) in got


def test_static_scan_by_resolution(spark, tmp_path):
    a = tmp_path / "oblasts"
    b = tmp_path / "land_use"
    a.mkdir()
    b.mkdir()
    (a / "ukr_oblasts_50km.csv").write_text("LATITUDE,LONGITUDE,OBLAST_ID\n46.0,24.0,UA1\n")
    (a / "ukr_oblasts_10km.csv").write_text("LATITUDE,LONGITUDE,OBLAST_ID\n46.1,24.1,UA1\n")
    (b / "land_use_10km.csv").write_text("LATITUDE,LONGITUDE,C0\n46.1,24.1,1.0\n")
    layers = L.scan_static(spark, [f"file://{a}", f"file://{b}", f"file://{tmp_path}/missing"], "50km")
    assert len(layers) == 1
    assert layers[0].columns == ["latitude", "longitude", "oblast_id"]
    assert layers[0].count() == 1


def test_hourly_to_daily_keeps_empty_days_as_null(spark):
    from hotspots.plans.ingest import hourly_to_daily
    rows = [("A", dt.datetime(2024, 1, 1, 5), 10.0), ("A", dt.datetime(2024, 1, 1, 17), None),
            ("A", dt.datetime(2024, 1, 3, 1), 30.0), ("B", dt.datetime(2024, 1, 2, 0), 5.0)]
    h = spark.createDataFrame(rows, "oblast_id string, ts timestamp_ntz, cloud_cover double")
    got = sorted((r.oblast_id, r.acq_date, r.cloud_cover) for r in hourly_to_daily(h).collect())
    assert got == [("A", dt.date(2024, 1, 1), 10.0), ("A", dt.date(2024, 1, 2), None),
                   ("A", dt.date(2024, 1, 3), 30.0), ("B", dt.date(2024, 1, 2), 5.0)]


def test_request_windows_short_and_long(spark):
    from hotspots.plans.ingest import request_windows
    short = [(r.window_start, r.n_days) for r in request_windows(spark, "2024-01-25", "2024-01-30").collect()]
    assert short == [(dt.date(2024, 1, 25), 6)]
    long = [(r.window_start, r.n_days) for r in request_windows(spark, "2024-01-01", "2024-01-21").collect()]
    assert long == [(dt.date(2024, 1, 1), 10), (dt.date(2024, 1, 11), 10), (dt.date(2024, 1, 21), 10)]


KEYS = ["acq_date", "oblast_id"]


def table(spark, root):
    return sorted(((r.oblast_id, r.acq_date, r.t_mean) for r in L.read_kind(spark, root, "weather").collect()), key=str)


def test_rows_without_a_date_survive_an_upsert(spark):
    root = scratch_dir(spark, "t-null")
    d = dt.date
    upsert_yearly(_w(spark, [("A", None, 1.0, 1.0), ("B", None, 2.0, 2.0), ("A", d(2024, 1, 1), 3.0, 3.0)]), root, "weather", KEYS)
    upsert_yearly(_w(spark, [("C", None, 4.0, 4.0), ("A", None, 5.0, 5.0)]), root, "weather", KEYS)
    assert table(spark, root) == sorted(
        [("A", None, 5.0), ("B", None, 2.0), ("C", None, 4.0), ("A", d(2024, 1, 1), 3.0)], key=str)
    upsert_yearly(_w(spark, [("A", d(2025, 1, 1), 6.0, 6.0)]), root, "weather", KEYS)
    assert len(table(spark, root)) == 5


def test_first_load_keeps_one_row_per_key(spark):
    root = scratch_dir(spark, "t-first")
    day = dt.date(2024, 1, 1)
    first = _w(spark, [("A", day, 1.0, 1.0), ("A", day, 2.0, 2.0)]).coalesce(1)
    upsert_yearly(first, root, "weather", KEYS, order=["cloud_cover"])
    assert table(spark, root) == [("A", day, 2.0)]


def test_a_job_that_dies_before_the_switch_leaves_the_old_years(spark, monkeypatch):
    from hotspots.sinks import writers

    root = scratch_dir(spark, "t-dies")
    d = dt.date
    L.land_yearly(_w(spark, [("A", d(2023, 5, 1), 1.0, 1.0), ("A", d(2024, 1, 1), 2.0, 2.0)]), root, "weather")
    upsert_yearly(_w(spark, [("A", d(2024, 1, 1), 3.0, 3.0)]), root, "weather", KEYS)
    before = table(spark, root)
    assert before == [("A", d(2023, 5, 1), 1.0), ("A", d(2024, 1, 1), 3.0)]
    new = _w(spark, [("A", d(2023, 5, 1), 9.0, 9.0), ("A", d(2024, 1, 1), 9.0, 9.0), ("B", d(2025, 1, 1), 9.0, 9.0)])

    def dies(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(writers, "_switch", dies)
        try:
            upsert_yearly(new, root, "weather", KEYS)
        except RuntimeError:
            pass
    assert table(spark, root) == before
    upsert_yearly(new, root, "weather", KEYS)
    assert table(spark, root) == [("A", d(2023, 5, 1), 9.0), ("A", d(2024, 1, 1), 9.0), ("B", d(2025, 1, 1), 9.0)]


def test_two_writers_from_one_manifest(spark, monkeypatch):
    from hotspots.sinks import writers

    root = scratch_dir(spark, "t-two")
    rows = _w(spark, [("A", dt.date(2024, 1, 1), 1.0, 1.0)])
    upsert_yearly(rows, root, "weather", KEYS)
    with monkeypatch.context() as m:
        m.setattr(writers, "committed", lambda *_: (0, {}))
        try:
            upsert_yearly(_w(spark, [("B", dt.date(2024, 1, 1), 1.0, 1.0)]), root, "weather", KEYS)
            raise AssertionError("both committed")
        except FileExistsError:
            pass
    assert table(spark, root) == [("A", dt.date(2024, 1, 1), 1.0)]
