from pyspark.sql import functions as F

from hotspots.config import FEATURES, FIXTURE_PERIODS
from hotspots.functions.calendar import date_lit
from hotspots.plans.scoring_model import KEY, FirePredictionPipeline
from hotspots.plans.queries_core import features_no_border
from hotspots.session import scratch_dir
from hotspots.sinks.model_store import load_pipeline, save_pipeline
from hotspots.sinks.writers import write_table


def _period(df, p):
    return df.filter(F.col("acq_date").between(date_lit(p[0]), date_lit(p[1])))


def test_fit_predict_save_load(spark):
    f = features_no_border(spark, "/root/testdata/sf0.001").select(*KEY, "fire_count", *FEATURES).cache()
    pipe = FirePredictionPipeline(num_trees=10, max_depth=5).fit(
        _period(f, FIXTURE_PERIODS.train), _period(f, FIXTURE_PERIODS.calibration))
    test = _period(f, FIXTURE_PERIODS.test)
    p1 = pipe.predict(test)
    rows1 = sorted((r.grid_cell, r.acq_date, r.y_hat, r.significance_score_decay) for r in p1.collect())
    assert len(rows1) == test.count()
    assert all(-1 <= r[3] < 1 for r in rows1 if r[3] is not None)
    path = scratch_dir(spark, "t-model")
    save_pipeline(pipe, path)
    again = load_pipeline(spark, path)
    rows2 = sorted((r.grid_cell, r.acq_date, r.y_hat, r.significance_score_decay)
                   for r in again.predict(test).collect())
    assert rows1 == rows2
    # neighbours and explanations are plain tables (SK2, SK3)
    out = scratch_dir(spark, "t-tables")
    write_table(p1.select(*KEY, "y_hat"), f"{out}/nn")
    assert spark.read.parquet(f"{out}/nn").count() == len(rows1)


def test_nearest_training_days_and_sk2(spark):
    from hotspots.plans.queries_model import nearest_training_days
    from hotspots.sinks.writers import write_nn_results
    nn = nearest_training_days(spark, "/root/testdata/sf0.001").cache()
    rows = nn.collect()
    assert rows
    # every fire-day match burned, every no-fire-day match did not (as in the study's outputs)
    assert all((r.fire_count > 0) == (r["class"] == 1) for r in rows)
    per = nn.groupBy("grid_cell", "acq_date", "class").count().filter("count > 1").count()
    assert per == 0
    out = scratch_dir(spark, "t-nn")
    write_nn_results(nn.filter("class = 1"), nn.filter("class = 0"),
                     nn.select("grid_cell", "acq_date").distinct(), out)
    assert spark.read.parquet(f"{out}/nn_firedays").count() == nn.filter("class = 1").count()


def test_end_to_end_run(spark):
    from hotspots.__main__ import run
    out = scratch_dir(spark, "t-run")
    info = run(spark, "/root/testdata/sf0.001", out, trees=5)
    assert info["test_cell_days"] > 0
    for sub in ("scored_fires", "nearest_days/nn_firedays", "explanations", "model/leaves"):
        assert spark.read.format("csv" if sub == "scored_fires" else "parquet").option(
            "header", True).load(f"{out}/{sub}").count() >= 0
