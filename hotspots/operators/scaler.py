"""Standardisation with the population standard deviation.

NULL passes through; a feature with zero variance is divided by 1. The fitted
parameters (two numbers per feature) are the only values brought to the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class ScalerModel:
    cols: list[str]
    mean: dict[str, float]
    scale: dict[str, float]

    def transform(self, df: DataFrame, suffix: str = "") -> DataFrame:
        out = df
        for c in self.cols:
            m = self.mean[c]
            s = self.scale[c]
            out = out.withColumn(c + suffix, (F.col(c) - F.lit(m)) / F.lit(s))
        return out

    def inverse(self, df: DataFrame, suffix: str = "") -> DataFrame:
        out = df
        for c in self.cols:
            out = out.withColumn(c + suffix, F.col(c) * F.lit(self.scale[c]) + F.lit(self.mean[c]))
        return out


def feature_stats(df: DataFrame, cols: list[str]) -> DataFrame:
    """Mean and population std per feature, NULL ignored (A11); one row."""
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"{c}__mean"), F.stddev_pop(c).alias(f"{c}__std")]
    return df.agg(*aggs)


def fit_scaler(df: DataFrame, cols: list[str]) -> ScalerModel:
    row = feature_stats(df, cols).first()
    mean, scale = {}, {}
    for c in cols:
        m, s = row[f"{c}__mean"], row[f"{c}__std"]
        mean[c] = float(m) if m is not None else 0.0
        scale[c] = float(s) if s not in (None, 0.0) else 1.0
    return ScalerModel(list(cols), mean, scale)
