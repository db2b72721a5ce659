"""Error threshold: fit (M6) and apply (M7).

Fit, stage a: t0 = the smallest clipped error e with  sum(y | err <= e) >= f * sum(y);
labels = err > t0. Stage b: of ``n`` evenly spaced thresholds between the
smallest and largest error pick the first one with the highest balanced
accuracy (mean recall over the label classes present).

Both stages read one table of errors grouped by value, (err, sum y, rows,
positives), built with a single aggregation (partial aggregation before the
shuffle) and kept in memory while the fit runs. Stage b never pairs rows with
thresholds: each error group is mapped to j = the number of thresholds below
it (err > t_i exactly when i < j), so true positives and true negatives of
every threshold are running totals over at most n + 1 per-j counts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hotspots.config import CALIBRATION_CONFIDENCE, THRESHOLD_CANDIDATES
from hotspots.functions.scoring import clipped_error, significance
from hotspots.operators.prefix import running_total


def group_errors(errors: DataFrame, err: str = "err", y: str = "y",
                 label: str | None = None) -> DataFrame:
    """(err, ys, n[, pos]) per distinct error value."""
    aggs = [F.sum(F.col(y).cast("double")).alias("ys"), F.count(F.lit(1)).alias("n")]
    if label:
        aggs.append(F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).cast("bigint").alias("pos"))
    return errors.groupBy(F.col(err).alias("err")).agg(*aggs)


def first_stage(grouped: DataFrame, fraction: float) -> float:
    """t0 from grouped errors (err, ys)."""
    total = grouped.agg(F.sum("ys")).first()[0] or 0.0
    cum = running_total(grouped.select("err", "ys"), "err", "ys", "_cum")
    return cum.filter(F.col("_cum") >= F.lit(fraction * total)).agg(F.min("err")).first()[0]


def label_groups(grouped: DataFrame, t0: float) -> DataFrame:
    return grouped.withColumn("pos", F.when(F.col("err") > F.lit(t0), F.col("n")).otherwise(F.lit(0)))


def _t(i: Column, lo: float, hi: float, n: int) -> Column:
    step = (hi - lo) / (n - 1)
    return F.when(i == n - 1, F.lit(hi)).otherwise(i.cast("double") * F.lit(step) + F.lit(lo))


def _thresholds_below(df: DataFrame, e: str, lo: float, hi: float, n: int, out: str = "j") -> DataFrame:
    """Exact j = #{i : t_i < e}.

    The estimate k0 = ceil((e - lo) / step) is off by at most a rounding step,
    so j = (k0 - 2) + #{m in -2..1 : t_(k0+m) < e}, with t_i = -inf below 0
    and +inf from n on; every term is a flat comparison against t_i itself.
    """
    step = (hi - lo) / (n - 1)
    if step <= 0:
        return df.withColumn(out, F.lit(0))
    ec = F.col(e)
    d = df.withColumn("_k0", F.ceil((ec - F.lit(lo)) / F.lit(step)).cast("int"))
    k0 = F.col("_k0")
    j = k0 - 2
    for m in (-2, -1, 0, 1):
        i = k0 + m
        below = F.when(i < 0, F.lit(True)).when(i >= n, F.lit(False)).otherwise(_t(i, lo, hi, n) < ec)
        j = j + below.cast("int")
    return d.withColumn(out, F.least(F.greatest(j, F.lit(0)), F.lit(n))).drop("_k0")


def sweep(labelled: DataFrame, n: int = THRESHOLD_CANDIDATES) -> DataFrame:
    """Per-threshold table (i, threshold, balanced_accuracy), i in 0..n-1, from
    grouped errors (err, n, pos)."""
    spark = labelled.sparkSession
    g = labelled.select("err", F.col("pos").cast("bigint").alias("_pos"),
                        (F.col("n") - F.col("pos")).cast("bigint").alias("_neg"))
    s = g.agg(F.min("err").alias("lo"), F.max("err").alias("hi"),
              F.sum("_pos").alias("P"), F.sum("_neg").alias("N")).first()
    lo, hi, P, N = float(s["lo"]), float(s["hi"]), int(s["P"]), int(s["N"])
    per_j = (_thresholds_below(g, "err", lo, hi, n)
             .groupBy("j").agg(F.sum("_pos").alias("pos_j"), F.sum("_neg").alias("neg_j")))
    # n + 1 rows at most: a bounded table, a single ordered window is fine here
    idx = spark.range(n + 1).select(F.col("id").cast("int").alias("j"))
    w = Window.orderBy("j").rowsBetween(Window.unboundedPreceding, 0)
    cum = (idx.join(per_j, "j", "left").fillna(0, ["pos_j", "neg_j"])
           .select("j", F.sum("pos_j").over(w).alias("cpos"), F.sum("neg_j").over(w).alias("cneg")))
    tp = F.lit(P) - F.col("cpos")
    tn = F.col("cneg")
    if P > 0 and N > 0:
        ba = (tn / F.lit(float(N)) + tp / F.lit(float(P))) / F.lit(2.0)
    elif N > 0:
        ba = tn / F.lit(float(N))
    else:
        ba = tp / F.lit(float(P))
    return (cum.filter(F.col("j") < n)
            .select(F.col("j").alias("i"), _t(F.col("j"), lo, hi, n).alias("threshold"),
                    ba.alias("balanced_accuracy")))


def best_threshold(table: DataFrame) -> DataFrame:
    """The first threshold with the highest balanced accuracy (> 0); one row."""
    return (table.filter(F.col("balanced_accuracy") > 0)
            .orderBy(F.col("balanced_accuracy").desc(), F.col("i").asc()).limit(1))


@dataclass
class ThresholdModel:
    t0: float | None
    threshold: float
    index: int
    balanced_accuracy: float

    def transform(self, df: DataFrame, y_true: str = "y", y_pred: str = "y_hat") -> DataFrame:
        """abnormal_label = err > T; significance_score in [-1, 1) (M7)."""
        e = clipped_error(y_true, y_pred)
        T = F.lit(float(self.threshold))
        return (df.withColumn("err", e)
                .withColumn("abnormal_label", F.when(F.col("err") > T, 1).otherwise(0))
                .withColumn("significance_score", significance(F.col("err"), T)))


def fit_threshold(df: DataFrame, y_true: str = "y", y_pred: str = "y_hat",
                  fraction: float | None = CALIBRATION_CONFIDENCE,
                  labels: str | None = None, n: int = THRESHOLD_CANDIDATES) -> ThresholdModel:
    """Stage a (when no ``labels`` column is given) then stage b."""
    e = df.select(clipped_error(y_true, y_pred).alias("err"), F.col(y_true).alias("y"),
                  *([F.col(labels).alias("label")] if labels else []))
    grouped = group_errors(e, label="label" if labels else None).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        t0 = None
        if labels is None:
            t0 = first_stage(grouped, fraction)
            grouped_l = label_groups(grouped, t0)
        else:
            grouped_l = grouped
        row = best_threshold(sweep(grouped_l, n)).first()
    finally:
        grouped.unpersist()
    if row is None:
        raise ValueError("no threshold reaches a positive balanced accuracy")
    return ThresholdModel(t0, float(row["threshold"]), int(row["i"]), float(row["balanced_accuracy"]))
