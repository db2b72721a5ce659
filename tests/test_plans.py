"""Plan shape: the join-heavy queries never fall back to pairwise joins, and
the flagship scans its fact table once with the date filter pushed down."""
import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
JOIN_HEAVY = ["m15_cell_day_features", "j1_point_in_polygon", "j8_overlay_per_day",
              "j9_fires_in_event_windows", "a8_colour_range_per_event", "j7_region_day_layers",
              "ts1_densify", "j6_scored_fires"]


def _plan(df):
    df.write.format("noop").mode("overwrite").save()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", JOIN_HEAVY)
def test_no_pairwise_join(spark, name):
    plan = _plan(E.queries()[name](spark, SF))
    assert "CartesianProduct" not in plan
    assert "NestedLoopJoin" not in plan


def test_flagship_scans_events_once_with_pushdown(spark):
    df = E.queries()["m15_cell_day_features"](spark, SF)
    plan = _plan(df)
    # one scan of the detections (the other events scan reads only `ts` for the
    # weather adapter's calendar)
    assert plan.count("FileScan parquet [event_id") == 1
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in plan


def test_sorted_for_plot(spark):
    from hotspots.plans.views import sorted_for_plot
    df = spark.createDataFrame([(3.0,), (None,), (-1.0,), (2.0,)], "significance_score_decay double")
    got = [r[0] for r in sorted_for_plot(df).collect()]
    assert got == [None, -1.0, 2.0, 3.0]


def test_histogram_equals_numpy(spark):
    import numpy as np

    from hotspots.plans.views import score_histogram
    rng = np.random.default_rng(11)
    normal = -rng.uniform(0, 1, 300)
    abnormal = rng.uniform(0, 0.7, 120)
    rows = [(0, float(x)) for x in normal] + [(1, float(x)) for x in abnormal]
    df = spark.createDataFrame(rows, "abnormal_label_decay int, significance_score_decay double")
    h = {(r["class"], r.bin): r.n for r in score_histogram(df).collect()}
    n = int((normal.max() - normal.min()) / 0.05)
    for cls, xs in (("normal", normal), ("abnormal", abnormal)):
        counts, _ = np.histogram(xs, bins=n, range=(xs.min(), xs.max()))
        assert [h[(cls, b)] for b in range(n)] == counts.tolist()
