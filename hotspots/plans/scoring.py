"""Score chain without a forest: expected count = per-cell mean of the series.

    series - expected count - clipped error - threshold (fit) - significance
           - decay per cell - join back to the fires
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hotspots.operators.decay import decay_scores
from hotspots.operators.threshold import ThresholdModel, fit_threshold


def with_cell_mean(series: DataFrame, y: str = "fire_count", out: str = "y_hat") -> DataFrame:
    """Per-cell mean of the count; every cell holds the same number of days, so
    the per-cell window partitions are equal in size."""
    return series.withColumn(out, F.avg(F.col(y).cast("double")).over(Window.partitionBy("grid_cell")))


def score_series(series: DataFrame, model: ThresholdModel | None = None,
                 y: str = "fire_count", y_hat: str = "y_hat") -> tuple[DataFrame, ThresholdModel]:
    """Raw and decayed labels and scores for every (cell, day)."""
    if model is None:
        model = fit_threshold(series, y, y_hat)
    scored = model.transform(series, y, y_hat)
    return decay_scores(scored), model


def scored_fires(snapped_fires: DataFrame, scores: DataFrame, keep_cell: bool = False) -> DataFrame:
    """Fires left-joined to their cell-day scores; original coordinates (J6 / SK1).

    Both sides are keyed by (grid_cell, acq_date) and the score side is unique
    on it, so a hot cell-day only splits (AQE skew join) the fire side.
    """
    s = scores.select("grid_cell", "acq_date", "abnormal_label", "significance_score",
                      "abnormal_label_decay", "significance_score_decay")
    return (snapped_fires.join(s, ["grid_cell", "acq_date"], "left")
            .select(*(["grid_cell"] if keep_cell else []),
                    "acq_date", F.col("longitude_original").alias("longitude"),
                    F.col("latitude_original").alias("latitude"), "abnormal_label",
                    "significance_score", "abnormal_label_decay", "significance_score_decay"))
