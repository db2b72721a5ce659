"""Nearest training cell-days with and without fires (J11, M9) as a fitted object."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hotspots.operators.neighbors import nearest
from hotspots.operators.prefix import dense_index


@dataclass
class NearestDays:
    """``candidates``: cid, key columns, class (1 burned, 0 not), z (scaled and
    imputed features), the original features and the label."""

    cols: list[str]
    key: list[str]
    label: str
    candidates: DataFrame

    @classmethod
    def fit(cls, train: DataFrame, prepared: DataFrame, cols: list[str], key: list[str],
            label: str) -> "NearestDays":
        """``prepared`` holds the scaled, imputed features of ``train`` by key."""
        z = prepared.select(*key, F.array(*cols).alias("z"))
        rows = dense_index(train.select(*key, label, *cols).join(z, key), key, "cid")
        rows = rows.withColumn("class", (F.col(label) > 0).cast("bigint"))
        return cls(list(cols), list(key), label, rows.checkpoint(eager=True))

    def search(self, prepared: DataFrame) -> DataFrame:
        """Per row of ``prepared`` (key and scaled, imputed features) and class
        its nearest training cell-day: match_<key>, label, original features,
        distance."""
        q = dense_index(prepared.select(*self.key, *self.cols), self.key, "qid").select(
            "qid", *self.key, F.array(*self.cols).alias("z"))
        nn = nearest(q.select("qid", "z"), self.candidates.select("cid", "class", "z"), "qid", "cid", "z",
                     group="class", k=1)
        match = self.candidates.select("cid", *[F.col(c).alias(f"match_{c}") for c in self.key], self.label, *self.cols)
        return (nn.join(q.select("qid", *self.key), "qid").join(match, "cid")
                .select(*self.key, "class", *[f"match_{c}" for c in self.key], self.label, *self.cols, "distance"))
