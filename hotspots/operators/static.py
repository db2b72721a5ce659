"""Static layers: full outer merge on position (J2) and winsorised population (A1)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hotspots.config import QUANTILE
from hotspots.operators.quantiles import exact_percentiles


def merge_layers(*layers: DataFrame, keys=("longitude", "latitude")) -> DataFrame:
    """Full outer join of every layer on the position keys, in the given order."""
    return reduce(lambda a, b: a.join(b, list(keys), "full_outer"), layers)


def winsorise(df: DataFrame, col: str = "pop_density", q: float = QUANTILE) -> DataFrame:
    """Cap ``col`` at its exact linearly interpolated ``q`` percentile computed
    over the same frame; NULL stays NULL. The percentile is a fitted number,
    found by distributed ranks."""
    found = exact_percentiles(df.select(F.lit(col).alias("feature"), F.col(col).alias("x")), [q])
    if col not in found:
        return df
    p = F.lit(found[col][0])
    return df.withColumn(col, F.when(F.col(col) > p, p).otherwise(F.col(col)))


def static_layers(*layers: DataFrame, cap_col: str | None = "pop_density") -> DataFrame:
    merged = merge_layers(*layers)
    if cap_col and cap_col in merged.columns:
        # the merged layers feed both the percentile and the capped values
        merged = winsorise(merged.checkpoint(eager=True), cap_col)
    return merged
