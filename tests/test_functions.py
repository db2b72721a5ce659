import math

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hotspots.functions import geo, scoring


def test_snap_docstring_example(spark):
    # grid snap example: (12.34567, 98.76543) at 10 km -> (12.3, 98.8)
    r = spark.createDataFrame([(12.34567, 98.76543)], "lat double, lon double").select(
        geo.snap("lat", "10km").alias("a"), geo.snap("lon", "10km").alias("b")).first()
    assert (r.a, r.b) == (12.3, 98.8)


def test_snap_unknown_resolution():
    try:
        geo.snap("x", "5km")
    except ValueError:
        return
    raise AssertionError("expected ValueError")


@settings(max_examples=25, deadline=None)
@given(st.lists(st.integers(min_value=-900000, max_value=900000), min_size=1, max_size=40))
def test_snap_50km_equals_python_half_even(spark, ints):
    vals = [i / 10000 for i in ints]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = [r[0] for r in df.select(geo.snap("x", "50km")).collect()]
    assert got == [round(v * 2) / 2 + 0.0 for v in vals]


def test_cell_key_format(spark):
    r = spark.createDataFrame([(49.5, 27.0)], "a double, b double").select(
        geo.cell_key("a", "b")).first()[0]
    assert r == "49.5_27.0"


def test_sigmoid_and_cutoff(spark):
    df = spark.createDataFrame([(d,) for d in (0.0, 5.0, 10.0, 11.0, 1000.0)], "d double")
    got = [r[0] for r in df.select(scoring.sigmoid_decay("d", 1.0, 5.0, 10.0)).collect()]
    exp = [1 / (1 + math.exp(-5)), 0.5, 1 / (1 + math.exp(5)), 0.0, 0.0]
    assert all(abs(a - b) < 1e-12 for a, b in zip(got, exp))


@settings(max_examples=20, deadline=None)
@given(st.floats(min_value=0, max_value=100), st.floats(min_value=0.01, max_value=50))
def test_significance_range(spark, e, t):
    v = spark.range(1).select(scoring.significance(F.lit(e), F.lit(t))).first()[0]
    assert -1.0 <= v < 1.0


def test_mercator_origin(spark):
    r = spark.range(1).select(geo.mercator_to_lon(F.lit(0.0)), geo.mercator_to_lat(F.lit(0.0))).first()
    assert abs(r[0]) < 1e-12 and abs(r[1]) < 1e-12


@settings(max_examples=30, deadline=None)
@given(st.lists(st.floats(min_value=-180, max_value=180, allow_nan=False), min_size=1, max_size=50))
def test_decimal_grids_equal_python_round(spark, vals):
    extra = [46.135, 2.675, 46.125, 0.285, 1.005, 30.0449999, -12.345]
    vals = vals + extra
    df = spark.createDataFrame([(float(v),) for v in vals], "x double")
    got = df.select(geo.snap("x", "1km"), geo.snap("x", "10km")).collect()
    for v, r in zip(vals, got):
        assert r[0] == round(v, 2) + 0.0, (v, r[0], round(v, 2))
        assert r[1] == round(v, 1) + 0.0, (v, r[1], round(v, 1))


def test_nan_becomes_null(spark):
    from hotspots.functions.scoring import nan_to_null
    df = spark.createDataFrame([(float("nan"), 1.0, "a")], "x double, y double, s string")
    r = nan_to_null(df).first()
    assert r.x is None and r.y == 1.0 and r.s == "a"


def test_literal_scores_and_classes(spark):
    from hotspots.functions import display
    df = spark.createDataFrame([(2.0, 4.0), (6.0, 4.0), (4.0, 4.0), (0.0, 0.0)], "e double, t double")
    got = [r[0] for r in df.select(scoring.significance("e", "t")).collect()]
    assert got == [(2.0 - 4.0) / 4.0, (6.0 - 4.0) / 6.0, 0.0, 0.0]
    lu = spark.createDataFrame([(0.2, 0.3, 0.3, 0.1, 0.1)], "c0 double, c1 double, c2 double, c3 double, c4 double")
    assert lu.select(geo.dominant_class("c0", "c1", "c2", "c3", "c4")).first()[0] == 1  # first max wins
    pop = spark.createDataFrame([(300.0,), (None,), (10.0,)], "p double")
    assert [r[0] for r in pop.select(display.cap("p", 250.0)).collect()] == [250.0, None, 10.0]
    ms = spark.range(1).select(display.marker_size(F.lit(3))).first()[0]
    assert abs(ms - (5 + 2 * math.log1p(3))) < 1e-12


def test_a_date_that_no_format_matches_is_an_error(spark):
    import pytest

    from hotspots.functions.calendar import to_date_any

    good = spark.createDataFrame([("2024-01-05",), ("05.01.2024",), ("2024/01/05",), (None,)], "d string")
    assert [str(r[0]) for r in good.select(to_date_any("d")).collect()] == ["2024-01-05"] * 3 + ["None"]
    bad = spark.createDataFrame([("2024-01-05",), ("soon",)], "d string")
    with pytest.raises(Exception, match="Invalid date format: soon"):
        bad.select(to_date_any("d")).collect()
    assert bad.select(to_date_any("d", strict=False)).collect()[1][0] is None
