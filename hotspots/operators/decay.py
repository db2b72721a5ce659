"""Per-cell score decay.

In date order per cell, a positive score is kept and remembered. A score <= 0
is replaced by sigmoid(days since the last positive score) * that score when
this is larger than the current score and positive. Labels follow the new
scores. The last positive (date, score) up to the current row is a
``last(..., ignorenulls)`` window; after densification every cell has exactly
one row per day, so the per-cell window partitions are all the same size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hotspots.config import DECAY_CUTOFF, DECAY_MIDPOINT, DECAY_RATE
from hotspots.functions.scoring import label, sigmoid_decay


def decay_scores(df: DataFrame, score: str = "significance_score", cell: str = "grid_cell",
                 date: str = "acq_date", rate: float = DECAY_RATE,
                 midpoint: float = DECAY_MIDPOINT, cutoff: float = DECAY_CUTOFF,
                 out_score: str = "significance_score_decay",
                 out_label: str = "abnormal_label_decay") -> DataFrame:
    s = F.col(score)
    w = (Window.partitionBy(cell).orderBy(date)
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    last = F.last(F.when(s > 0, F.struct(F.col(date).alias("d"), s.alias("s"))), ignorenulls=True).over(w)
    withlast = df.withColumn("_last", last)
    days = F.datediff(F.col(date), F.col("_last.d"))
    decayed = sigmoid_decay(days, rate, midpoint, cutoff) * F.col("_last.s")
    new = (F.when(s > 0, s)
           .when(F.col("_last").isNotNull() & (decayed > s) & (decayed > 0), decayed)
           .otherwise(s))
    return (withlast.withColumn(out_score, new)
            .withColumn(out_label, label(F.col(out_score)))
            .drop("_last"))
