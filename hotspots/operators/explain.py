"""Local surrogate explanations with quartile bins.

Fit (M10): per feature the exact quartiles of the training rows (distributed
ranks), the bin of
every training value (bin = number of quartiles strictly below the value) and
per (feature, bin) the frequency, mean, std, min and max.

Explain (M11/M12), for the rows to explain (e.g. every flagged cell-day):
every row gets ``num_samples`` perturbed copies,
generated in Spark with ``explode(sequence(..))``; each copy draws a bin per
feature from the training bin frequencies and a value inside that bin, all
seeded by ``xxhash64(seed, row, sample, feature)`` so a re-run gives the same
samples. Copy 0 is the row itself. All copies are scored by one call of the
prediction function (a DataFrame -> DataFrame model, e.g. the quantile
forest). A copy's binary form is "same bin as the row" per feature; its
weight is the exponential kernel of its distance to the row. Per row, the sums
of the normal equations of a weighted ridge regression on the binary form
(alpha = 1, intercept) are partially aggregated, one row of sums is solved, and
the features are reported with their rule text, ordered by absolute weight.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hotspots.config import RANDOM_STATE
from hotspots.operators.quantiles import exact_percentiles


SAMPLES_TOGETHER = 250  # copies of a row that one task makes


def bin_of(x, q1, q2, q3):
    return (F.when(x > F.lit(q3), 3).when(x > F.lit(q2), 2).when(x > F.lit(q1), 1).otherwise(0))


def rule_texts(name: str, q: list[float]) -> list[str]:
    """Fixed rule formats of the four quartile bins (two decimals)."""
    q1, q2, q3 = q
    return [f"{name} <= {q1:.2f}", f"{q1:.2f} < {name} <= {q2:.2f}",
            f"{q2:.2f} < {name} <= {q3:.2f}", f"{name} > {q3:.2f}"]


def stack_features(df: DataFrame, cols: list[str]) -> DataFrame:
    """(feature, x) rows for every non-NULL feature value, in one scan."""
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x"))
                      for c in cols])
    return df.select(F.explode(pairs).alias("_p")).select("_p.feature", "_p.x").filter(
        F.col("x").isNotNull())


def quartile_table(train: DataFrame, cols: list[str]) -> DataFrame:
    """(feature, q1, q2, q3) with exact linear percentiles: one row per feature."""
    found = exact_percentiles(stack_features(train, cols), [0.25, 0.5, 0.75])
    return train.sparkSession.createDataFrame(
        [(c, *found[c]) for c in cols if c in found], "feature string, q1 double, q2 double, q3 double")


def bin_stats(train: DataFrame, cols: list[str], quart: dict) -> DataFrame:
    """(feature, bin, n, freq, mean, std, min, max) of the training values."""
    st = stack_features(train, cols)
    b = F.lit(None).cast("int")
    for c in cols:
        q1, q2, q3 = quart[c]
        b = F.when(F.col("feature") == c, bin_of(F.col("x"), q1, q2, q3)).otherwise(b)
    g = st.withColumn("bin", b).groupBy("feature", "bin").agg(
        F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"),
        F.min("x").alias("min"), F.max("x").alias("max"))
    return g.withColumn("freq", F.col("n") / F.sum("n").over(Window.partitionBy("feature")))


def _normal_share(z: float) -> float:
    """Distribution function of the standard normal."""
    return 0.5 * (1 + math.erf(z / math.sqrt(2)))


# Coefficients of Acklam's published rational approximation of
# the standard normal quantile (relative error below 1.2e-9).
_A = (-3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02,
      1.383577518672690e+02, -3.066479806614716e+01, 2.506628277459239e+00)
_B = (-5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02,
      6.680131188771972e+01, -1.328068155288572e+01, 1.0)
_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e+00,
      -2.549732539343734e+00, 4.374664141464968e+00, 2.938163982698783e+00)
_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e+00, 3.754408661907416e+00, 1.0)
_TAIL = 0.02425


def normal_quantile(p: np.ndarray) -> np.ndarray:
    """Standard normal quantiles of shares between 0 and 1."""
    p = np.clip(p, 1e-12, 1 - 1e-12)
    q = p - 0.5
    low, high = np.sqrt(-2 * np.log(p)), np.sqrt(-2 * np.log(1 - p))
    middle = np.polyval(_A, q * q) * q / np.polyval(_B, q * q)
    return np.where(p < _TAIL, np.polyval(_C, low) / np.polyval(_D, low),
                    np.where(p > 1 - _TAIL, -np.polyval(_C, high) / np.polyval(_D, high), middle))


@dataclass
class Explainer:
    cols: list[str]
    quart: dict          # feature -> [q1, q2, q3]
    bins: dict           # feature -> list of 4 dicts (freq, mean, std, min, max, low, high)
    means: dict = field(default_factory=dict)  # feature -> training mean

    def rules(self, c: str) -> list[str]:
        return rule_texts(c, self.quart[c])

    def perturb(self, rows: DataFrame, key: str, num_samples: int, seed: int) -> DataFrame:
        """Copies (key, sample, features..., z_<f> same-bin flags). Spark makes the
        copies and their seeded uniforms; a vectorised function turns those into
        a bin and a normal value truncated to it."""
        cols, quart, bins = self.cols, self.quart, self.bins
        # the rows are few, their copies are not: runs of copies are dealt over the tasks first
        start = F.explode(F.sequence(F.lit(0), F.lit(num_samples - 1), F.lit(SAMPLES_TOGETHER)))
        parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        dealt = rows.select(key, *cols, start.alias("_start")).repartition(parts, key, "_start")
        last = F.least(F.col("_start") + (SAMPLES_TOGETHER - 1), F.lit(num_samples - 1))
        copies = dealt.select(key, *cols, F.explode(F.sequence("_start", last)).alias("sample"))

        def uniform(c, stream):
            return (F.pmod(F.xxhash64(F.lit(seed), F.col(key), F.col("sample"), F.lit(c), F.lit(stream)),
                           F.lit(1_000_000)) + 0.5) / 1e6

        given = copies.select(key, "sample", *[F.col(c).cast("double").alias(c) for c in cols],
                              *[uniform(c, 1).alias(f"_u_{c}") for c in cols], *[uniform(c, 2).alias(f"_v_{c}") for c in cols])

        def draw(it):
            for pdf in it:
                itself = (pdf["sample"] == 0).to_numpy()
                out = {key: pdf[key], "sample": pdf["sample"]}
                for c in cols:
                    own = pdf[c].to_numpy(float)
                    drawn = np.searchsorted(np.cumsum([b["freq"] for b in bins[c]])[:3], pdf[f"_u_{c}"].to_numpy(), "right")
                    mean, std, least, most, low, high = (np.array([b[k] for b in bins[c]])[drawn] for k in
                                                         ("mean", "std", "min", "max", "low", "high"))
                    value = mean + std * normal_quantile(low + pdf[f"_v_{c}"].to_numpy() * (high - low))
                    out[c] = np.where(itself, own, np.clip(value, least, most))
                    out[f"z_{c}"] = np.where(itself, 1.0, drawn == np.searchsorted(quart[c], own, "left"))
                yield pd.DataFrame(out)

        key_type = rows.schema[key].dataType.simpleString()
        schema = ", ".join([f"{key} {key_type}", "sample int", *[f"`{c}` double" for c in cols], *[f"`z_{c}` double" for c in cols]])
        return given.mapInPandas(draw, schema).select(key, "sample", *cols, *[f"z_{c}" for c in cols])

    def scored_copies(self, rows: DataFrame, key: str, predict: Callable[[DataFrame, list[str]], DataFrame],
                      num_samples: int, seed: int) -> DataFrame:
        """(key, sample, _z, y_hat): the prediction of every copy, beside its
        same-bin flags as bits. The prediction carries them as part of its key."""
        bits = sum((F.col(f"z_{c}").cast("long") * F.lit(1 << i) for i, c in enumerate(self.cols)), F.lit(0).cast("long"))
        copies = self.perturb(rows, key, num_samples, seed).select(key, "sample", bits.alias("_z"), *self.cols)
        return predict(copies, [key, "sample", "_z"]).select(key, "sample", "_z", "y_hat")

    def flag(self, i: int):
        """Same-bin flag of feature ``i`` as 0 or 1."""
        return F.shiftright("_z", i).bitwiseAND(F.lit(1).cast("long")).cast("double")

    def weight(self):
        """Kernel weight of a copy. Binned features are categorical: the distance is
        taken on the flags themselves to the row, whose flags are all one."""
        d = len(self.cols)
        width = math.sqrt(d) * 0.75
        return F.sqrt(F.exp(-(F.lit(float(d)) - F.bit_count("_z")) / F.lit(width ** 2)))

    def coefficients(self, rows: DataFrame, key: str, predict: Callable[[DataFrame, list[str]], DataFrame],
                     num_samples: int = 5000, seed: int = RANDOM_STATE, scored: DataFrame | None = None) -> DataFrame:
        """(key, features, coef, intercept): weighted ridge (alpha 1) of the
        predictions on the flags, per row. The sums of its normal equations are
        partially aggregated; one row of sums per explained row is solved. ``scored``:
        the rows' ``scored_copies``, where they are made already."""
        cols, d = self.cols, len(self.cols)
        given = rows.select(key, *[F.coalesce(F.col(c), F.lit(self.means.get(c, 0.0))).cast("double").alias(c) for c in cols])
        if scored is None:
            scored = self.scored_copies(given, key, predict, num_samples, seed)
        scored = scored.withColumn("_w", self.weight())
        w, y = F.col("_w"), F.col("y_hat")
        z = [self.flag(i) for i in range(d)]
        sums = [F.sum(w), F.sum(w * y), *[F.sum(w * x) for x in z], *[F.sum(w * x * y) for x in z],
                *[F.sum(w * z[i] * z[j]) for i in range(d) for j in range(i)]]
        stats = scored.groupBy(key).agg(F.array(*sums).alias("_sums"))

        def solve(batches):
            for pdf in batches:
                if not len(pdf):
                    continue
                s = np.stack(pdf["_sums"].to_numpy())
                total, wy, wz, wzy = s[:, 0], s[:, 1], s[:, 2:2 + d], s[:, 2 + d:2 + 2 * d]
                zz = np.zeros((len(s), d, d))
                low = np.tril_indices(d, -1)
                zz[:, low[0], low[1]] = s[:, 2 + 2 * d:]
                zz += zz.transpose(0, 2, 1)
                zz[:, np.arange(d), np.arange(d)] = wz  # flags are 0 or 1
                mean_z, mean_y = wz / total[:, None], wy / total
                A = zz - wz[:, :, None] * mean_z[:, None, :] + np.eye(d)
                coef = np.linalg.solve(A, (wzy - wz * mean_y[:, None])[:, :, None])[:, :, 0]
                yield pdf[[key, "features"]].assign(coef=list(coef), intercept=mean_y - (coef * mean_z).sum(1))

        kind = given.schema[key].dataType.simpleString()
        return (given.select(key, F.array(*cols).alias("features")).join(stats, key)
                .mapInPandas(solve, f"{key} {kind}, features array<double>, coef array<double>, intercept double"))

    def explain(self, rows: DataFrame, key: str, predict: Callable[[DataFrame, list[str]], DataFrame],
                num_features: int | None = None, num_samples: int = 5000,
                seed: int = RANDOM_STATE, scored: DataFrame | None = None) -> DataFrame:
        """One row per explained row: (key, explanation array<struct<rule,weight>>),
        by absolute weight. ``key`` identifies a row. A missing value is explained
        as the training mean of its feature, in the same-bin flags as in the rule texts."""
        found = self.coefficients(rows, key, predict, num_samples, seed, scored)
        k = num_features or len(self.cols)

        def text(i: int, c: str):
            x, (q1, q2, q3), rules = F.col("features")[i], self.quart[c], [F.lit(r) for r in self.rules(c)]
            return F.when(x <= q1, rules[0]).when(x <= q2, rules[1]).when(x <= q3, rules[2]).otherwise(rules[3])

        entries = F.array(*[F.struct(-F.abs(F.col("coef")[i]).alias("less"), F.lit(i).alias("place"), text(i, c).alias("rule"),
                                     F.col("coef")[i].alias("weight")) for i, c in enumerate(self.cols)])
        ordered = F.slice(F.array_sort(entries), 1, k)
        return found.select(key, F.transform(ordered, lambda e: F.struct(e["rule"], e["weight"])).alias("explanation"))


def fit_explainer(train: DataFrame, cols: list[str]) -> Explainer:
    qt = {r["feature"]: [float(r["q1"]), float(r["q2"]), float(r["q3"])]
          for r in quartile_table(train, cols).collect()}
    bs = bin_stats(train, cols, qt).collect()
    bins = {c: [dict(freq=0.0, mean=0.0, std=0.0, min=0.0, max=0.0, low=0.0, high=1.0) for _ in range(4)]
            for c in cols}
    means = {}
    for r in bs:
        mean, std = float(r["mean"]), float(r["std"] or 0.0)
        ends = [_normal_share((float(r[e]) - mean) / std) if std else s for e, s in (("min", 0.0), ("max", 1.0))]
        bins[r["feature"]][r["bin"]] = dict(freq=float(r["freq"]), mean=mean, std=std, min=float(r["min"]),
                                            max=float(r["max"]), low=ends[0], high=ends[1])
        means[r["feature"]] = means.get(r["feature"], 0.0) + float(r["freq"]) * mean
    return Explainer(list(cols), qt, bins, means)


def wide(explained: DataFrame, key: str, n: int) -> DataFrame:
    """(key, explanation_0 .. explanation_<n-1>): one (rule, weight) column per place (SK3)."""
    return explained.select(key, *[F.get("explanation", F.lit(i)).alias(f"explanation_{i}") for i in range(n)])
