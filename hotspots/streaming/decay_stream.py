"""Per-cell score decay as a stateful stream (incremental M8).

Daily scores of every cell arrive as micro-batches. The state of a cell is
its last significant (date, score); within a batch a cell's rows are taken in
date order, positive scores are kept and remembered, the others are replaced
by sigmoid(days since the remembered date) * remembered score when that is
larger and positive. Batches are expected in date order (a daily update);
the state survives restarts in the stream's checkpoint.

The per-cell work inside a batch is a short loop over that batch's days for
one cell, the only Python in the stream.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout

from hotspots.config import DECAY_CUTOFF, DECAY_MIDPOINT, DECAY_RATE
from hotspots.session import ensure_checkpoint_dir

SCORES_SCHEMA = "grid_cell string, acq_date date, abnormal_label int, significance_score double"
OUT_SCHEMA = ("grid_cell string, acq_date date, abnormal_label int, significance_score double, "
              "abnormal_label_decay int, significance_score_decay double")
STATE_SCHEMA = "last_date date, last_score double"


def _decay_group(rate: float, midpoint: float, cutoff: float):
    def fn(key, pdfs: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last_d, last_s = state.get if state.exists else (None, None)
        pdf = pd.concat(list(pdfs), ignore_index=True).sort_values("acq_date")
        out = []
        for d, lab, s in zip(pdf["acq_date"], pdf["abnormal_label"], pdf["significance_score"]):
            new = s
            if s is not None and not (isinstance(s, float) and math.isnan(s)) and s > 0:
                last_d, last_s = d, s
            elif last_d is not None and s is not None and not math.isnan(s):
                t = (d - last_d).days
                w = 0.0 if t > cutoff else 1.0 / (1.0 + math.exp(rate * (t - midpoint)))
                v = w * last_s
                if v > s and v > 0:
                    new = v
            out.append((key[0], d, lab, s, 1 if (new is not None and new > 0) else 0, new))
        state.update((last_d, last_s))
        yield pd.DataFrame(out, columns=["grid_cell", "acq_date", "abnormal_label", "significance_score",
                                         "abnormal_label_decay", "significance_score_decay"])
    return fn


def decay_stream(scores: DataFrame, rate: float = DECAY_RATE, midpoint: float = DECAY_MIDPOINT,
                 cutoff: float = DECAY_CUTOFF) -> DataFrame:
    """Streaming scores -> decayed scores, state per grid cell."""
    return scores.groupBy("grid_cell").applyInPandasWithState(
        _decay_group(rate, midpoint, cutoff), OUT_SCHEMA, STATE_SCHEMA, "append",
        GroupStateTimeout.NoTimeout)


def start_decay_stream(spark: SparkSession, landing_dir: str, out_dir: str, name: str) -> StreamingQuery:
    """Scores landed as Parquet files -> decayed scores appended as Parquet."""
    base = ensure_checkpoint_dir(spark)
    src = spark.readStream.schema(SCORES_SCHEMA).parquet(landing_dir)
    return (decay_stream(src).writeStream.format("parquet").outputMode("append")
            .option("checkpointLocation", f"{base.rstrip('/')}/streams/{name}")
            .trigger(availableNow=True).start(out_dir))
