"""What the two trained classifiers share: the labelled sample and the optimiser.

The sample is bounded: at most ``per_class`` rows of each label whose text has
at most ``max_bytes`` bytes, taken in the order of a hash of the id, so it is
the same on every run and any partitioning. Everything else a classifier does
reads all rows and whole texts. The documents are scanned once for both labels.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fold(doc_id: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts`` (null for a null id)."""
    return F.crc32(F.col(f"`{doc_id}`").cast("string").cast("binary")) % parts


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, allowed: Column,
                    per_class: int, max_bytes: int, doc_id: str = "doc_id",
                    text: str = "text") -> tuple[list[bytes], np.ndarray]:
    """Texts and labels (0 or 1) of the bounded sample; ``allowed`` is a
    condition on the id of a label row. Null labels and texts are left out."""
    usable = labels.filter(allowed & F.col(f"`{label}`").isin(0, 1)).select(
        F.col(f"`{doc_id}`").alias("k"), F.col(f"`{label}`").cast("int").alias("y")).distinct()
    short = (docs.select(F.col(f"`{doc_id}`").alias("k"), F.col(f"`{text}`").cast("string").alias("t"))
             .filter(F.octet_length("t").between(1, max_bytes)))
    # twice as many ids of each label as wanted: some texts are missing or too long
    ids = None
    for y in (0, 1):
        own = usable.filter(F.col("y") == y).orderBy(F.xxhash64("k"), "k").limit(2 * per_class)
        ids = own if ids is None else ids.union(own)
    order = Window.partitionBy("y").orderBy(F.xxhash64("k"), "k", F.xxhash64("t"))
    rows = (short.join(F.broadcast(ids), "k").withColumn("place", F.row_number().over(order))
            .filter(F.col("place") <= per_class).orderBy("y", "place").select("y", "t").collect())
    return [r.t.encode() for r in rows], np.array([r.y for r in rows], np.float32)


class Adam:
    """Adam steps over a dictionary of arrays, in place."""

    def __init__(self, params: dict[str, np.ndarray], rate: float):
        self.params, self.rate, self.t = params, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def step(self, grads: dict[str, np.ndarray]) -> None:
        self.t += 1
        for k, g in grads.items():
            m, v = self.m[k], self.v[k]
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            self.params[k] -= self.rate * (m / (1 - 0.9 ** self.t)) / (np.sqrt(v / (1 - 0.999 ** self.t)) + 1e-8)


def best_shift(logits: np.ndarray, y: np.ndarray) -> float:
    """What to add to the logits so that 0 separates the classes best, both
    classes weighing the same."""
    order = np.argsort(logits)
    z, t = logits[order], y[order]
    below0 = np.concatenate([[0], np.cumsum(t == 0)]) / max(1, (t == 0).sum())
    above1 = 1 - np.concatenate([[0], np.cumsum(t == 1)]) / max(1, (t == 1).sum())
    edges = np.concatenate([[z[0] - 1], (z[1:] + z[:-1]) / 2, [z[-1] + 1]])
    gain = below0 + above1
    good = np.flatnonzero(gain >= gain.max() - 1e-9)
    return float(-edges[good[len(good) // 2]])
