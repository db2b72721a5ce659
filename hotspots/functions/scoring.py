"""Scoring column functions: clipped error (F6), significance (F7),
sigmoid decay (F8) and labels (F9)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hotspots.config import DECAY_CUTOFF, DECAY_MIDPOINT, DECAY_RATE


def _c(x):
    return F.col(x) if isinstance(x, str) else x


def clipped_error(y_true, y_pred) -> Column:
    """``max(y - yhat, 0)`` that keeps NULL as NULL."""
    e = _c(y_true).cast("double") - _c(y_pred).cast("double")
    return F.when(e < 0, F.lit(0.0)).otherwise(e)


def significance(err, threshold) -> Column:
    """(e - T)/T below the threshold, (e - T)/e at or above it; range [-1, 1).

    e == T scores 0, the limit of both branches (also when T == 0).
    """
    e, t = _c(err), _c(threshold)
    return (F.when(e == t, F.lit(0.0))
            .when(e < t, (e - t) / t)
            .otherwise((e - t) / e))


def sigmoid_decay(days, rate: float = DECAY_RATE, midpoint: float = DECAY_MIDPOINT,
                  cutoff: float = DECAY_CUTOFF) -> Column:
    """1 / (1 + exp(rate * (t - midpoint))), 0 beyond ``cutoff`` days."""
    t = _c(days).cast("double")
    return (F.when(t > F.lit(cutoff), F.lit(0.0))
            .otherwise(F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(rate) * (t - F.lit(midpoint))))))


def label(score) -> Column:
    return F.when(_c(score) > 0, F.lit(1)).otherwise(F.lit(0))


def nan_to_null(df):
    """NaN in floating columns becomes NULL: Spark orders NaN above every number
    (so NaN > 0 would be true) while the study treats NaN as missing."""
    from pyspark.sql import types as T
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(F.nanvl(F.col(f.name), F.lit(None).cast(f.dataType)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)
