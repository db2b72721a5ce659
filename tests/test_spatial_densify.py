import datetime as dt
import random

from pyspark.sql import functions as F

from hotspots.operators import densify as D
from hotspots.operators.spatial import points_in_polygons, ring_edges
from hotspots.sources.landing import rings_from_wkt


def py_inside(x, y, ring):
    inside = False
    n = len(ring)
    for i in range(n):
        (y1, x1), (y2, x2) = ring[i], ring[(i + 1) % n]
        if (y1 > y) != (y2 > y) and x < x1 + (y - y1) * (x2 - x1) / (y2 - y1):
            inside = not inside
    return inside


def test_pip_against_ray_casting(spark):
    rng = random.Random(1)
    polys = {0: [(0.0, 0.0), (0.0, 4.0), (3.0, 5.0), (5.0, 1.0)],
             1: [(2.0, 2.0), (2.5, 7.0), (6.0, 6.5), (6.5, 2.5), (4.0, 3.9)]}
    rings = spark.createDataFrame(
        [(k, [{"lat": a, "lon": b} for a, b in v]) for k, v in polys.items()],
        "poly_id int, ring array<struct<lat:double,lon:double>>")
    pts = [(i, rng.uniform(-1, 7), rng.uniform(-1, 8)) for i in range(400)]
    df = spark.createDataFrame(pts, "pid int, latitude double, longitude double")
    got = {(r.pid, r.poly_id) for r in points_in_polygons(df, ring_edges(rings), keep_poly=True).collect()}
    exp = {(i, k) for i, la, lo in pts for k, ring in polys.items() if py_inside(lo, la, ring)}
    assert got == exp


def test_polygon_with_hole_from_wkt(spark):
    wkt = "POLYGON ((0 0, 10 0, 10 10, 0 10, 0 0), (4 4, 6 4, 6 6, 4 6, 4 4))"
    rings = rings_from_wkt(spark.createDataFrame([(1, wkt)], "poly_id int, wkt string"))
    pts = spark.createDataFrame([(1, 5.0, 5.0), (2, 2.0, 2.0), (3, 11.0, 5.0)],
                                "pid int, latitude double, longitude double")
    got = {r.pid for r in points_in_polygons(pts, ring_edges(rings)).collect()}
    assert got == {2}


def test_densify_properties(spark):
    rng = random.Random(5)
    rows = [(i, 46 + rng.random() * 3, 24 + rng.random() * 3,
             dt.date(2024, 1, 1) + dt.timedelta(days=rng.randrange(10))) for i in range(500)]
    f = spark.createDataFrame(rows, "event_id int, latitude double, longitude double, acq_date date")
    s = D.snap_points(f)
    dens = D.densify(s, "2024-01-01", "2024-01-10")
    cells = s.select("grid_cell").distinct().count()
    assert dens.count() == cells * 10
    assert dens.agg(F.sum("fire_count")).first()[0] == 500
    assert dens.groupBy("grid_cell", "acq_date").count().filter("count > 1").count() == 0


def test_first_interval_match_overlaps_and_gaps(spark):
    from hotspots.operators.joins import first_interval_match, within_windows
    d = dt.date
    iv = spark.createDataFrame([(0, "a", d(2024, 1, 1), d(2024, 1, 3)), (1, "b", d(2024, 1, 2), d(2024, 1, 5)),
                                (2, "c", d(2024, 1, 9), d(2024, 1, 8))],   # empty interval
                               "pos int, url string, start_date date, end_date date")
    days = spark.createDataFrame([(d(2024, 1, i),) for i in (1, 2, 4, 7)], "acq_date date")
    got = sorted((r.acq_date, r.url) for r in first_interval_match(days, iv, ["acq_date"], "acq_date").collect())
    assert got == [(d(2024, 1, 1), "a"), (d(2024, 1, 2), "a"), (d(2024, 1, 4), "b"), (d(2024, 1, 7), None)]
    both = sorted((r.acq_date, r.url) for r in within_windows(days, iv).collect())
    assert both == [(d(2024, 1, 1), "a"), (d(2024, 1, 2), "a"), (d(2024, 1, 2), "b"), (d(2024, 1, 4), "b")]
