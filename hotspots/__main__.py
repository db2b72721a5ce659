"""End-to-end run: features -> model -> scored fires and side outputs.

    python -m hotspots run --sf /root/testdata/sf0.01 --out <folder> [--trees 100]

Builds the cell-day features, fits the model on the training period and the
threshold on the calibration period, scores the test period and writes:
scored fires (SK1), nearest training days (SK2), explanations of the flagged
cell-days (SK3) and the fitted model (SK5). ``--out`` defaults to a folder
under the session's shared checkpoint location.
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import functions as F

from hotspots.config import FEATURES, FIXTURE_PERIODS
from hotspots.functions.calendar import date_lit


def _period(df, p):
    return df.filter(F.col("acq_date").between(date_lit(p[0]), date_lit(p[1])))


def run(spark, sf_dir: str, out: str, trees: int = 100) -> dict:
    from hotspots.operators import densify as D
    from hotspots.operators.explain import wide
    from hotspots.plans.queries_core import features_no_border
    from hotspots.plans.scoring import scored_fires
    from hotspots.plans.scoring_model import KEY, FirePredictionPipeline
    from hotspots.sinks.model_store import save_pipeline
    from hotspots.sinks.writers import write_nn_results, write_scored_fires, write_table
    from hotspots.sources import fixtures as X
    from hotspots.sources.tables import Tables

    P = FIXTURE_PERIODS
    f = features_no_border(spark, sf_dir).select(*KEY, "fire_count", *FEATURES).cache()
    pipe = FirePredictionPipeline(num_trees=trees).fit(_period(f, P.train), _period(f, P.calibration))
    scored = pipe.predict(_period(f, P.test)).cache()
    snapped = D.snap_points(X.fires(Tables(spark, sf_dir)))
    test_fires = _period(snapped, P.test)
    write_scored_fires(scored_fires(test_fires, scored), f"{out}/scored_fires")
    nn = pipe.nearest(_period(f, P.test)).cache()
    write_nn_results(nn.filter("class = 1"), nn.filter("class = 0"), _period(f, P.test), f"{out}/nearest_days")
    flagged = scored.filter(F.col("abnormal_label") == 1).select(*KEY)
    rows = (_period(f, P.test).join(flagged, KEY)
            .withColumn("row_id", F.concat_ws("|", "grid_cell", F.col("acq_date").cast("string"))))
    explained = pipe.explain(rows, "row_id")
    write_table(wide(explained, "row_id", len(FEATURES)), f"{out}/explanations")
    save_pipeline(pipe, f"{out}/model")
    return {"out": out, "threshold": pipe.threshold.threshold, "pca_components": pipe.pca.k,
            "test_cell_days": scored.count(), "flagged": flagged.count()}


def main(argv=None) -> None:
    ap = argparse.ArgumentParser(prog="hotspots")
    sub = ap.add_subparsers(dest="cmd", required=True)
    r = sub.add_parser("run")
    r.add_argument("--sf", default="/root/testdata/sf0.01")
    r.add_argument("--out", default=None)
    r.add_argument("--trees", type=int, default=100)
    args = ap.parse_args(argv)
    from hotspots.session import apply_sizing, get_spark, scratch_dir
    from hotspots.sources.paths import size
    spark = get_spark()
    apply_sizing(spark, size(spark, args.sf), spark.sparkContext.defaultParallelism)
    out = args.out or scratch_dir(spark, "run")
    print(json.dumps(run(spark, args.sf, out, args.trees)))


if __name__ == "__main__":
    main()
