"""k-nearest-neighbour imputation (M2).

A missing feature f of a row is the mean of f over the k training rows that
have f and are nearest under the NaN-aware Euclidean distance
sqrt(d / c * sum of squared differences over the c coordinates present in
both rows); a row with no usable donor gets the training mean of f.

Work split: rows with equal features (missing ones included) are imputed once.
Donors lie in blocks of one pattern of present features (``neighbors.BlockIndex``,
built once by the fit); a receiver visits, for every feature it lacks, the block
nearest to it that has the feature, and then only those whose bound under the
NaN-aware distance is within its k-th best so far. No (row, donor) pair becomes
a Spark row.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hotspots.config import N_NEIGHBORS
from hotspots.operators.neighbors import BlockIndex, matrix, nan_distances


def _key(cols: list[str]):
    return F.concat_ws("|", *[F.col(c).cast("string") for c in cols])


def _vector(cols: list[str]):
    return F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in cols])


@dataclass
class KNNImputerModel:
    cols: list[str]
    index: BlockIndex  # training rows by key
    means: dict[str, float]
    k: int = N_NEIGHBORS
    round_to: int = 9

    def imputed_values(self, receivers: DataFrame) -> DataFrame:
        """(_rid, feature, value) for every missing feature of every receiver
        (_rid and the feature columns, one row per distinct combination);
        ``feature`` is the number of the feature."""
        k, rnd = self.k, self.round_to
        names = ["_qid", "feature", "distance", "_cid", "value"]

        def best(r: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
            parts = []
            if len(r) and len(d):
                ids, R = r["_qid"].to_numpy(np.int64), matrix(r["_qvec"])
                # donors in key order: a stable sort by distance breaks ties by key
                d = d.sort_values("_cid", kind="stable")
                D, keys = matrix(d["_vec"]), d["_cid"].to_numpy()
                step = max(1, int(4_000_000 // max(1, len(D))))
                for s in range(0, len(R), step):
                    dist = np.round(nan_distances(R[s:s + step], D), rnd)
                    for f in range(R.shape[1]):
                        rows = np.flatnonzero(np.isnan(R[s:s + step, f]))
                        has = np.flatnonzero(~np.isnan(D[:, f]))
                        if not len(rows) or not len(has):
                            continue
                        own = dist[np.ix_(rows, has)]
                        own = np.where(np.isnan(own), np.inf, own)
                        order = np.argsort(own, axis=1, kind="stable")[:, :k]
                        top = np.take_along_axis(own, order, 1)
                        i, j = np.nonzero(np.isfinite(top))
                        at = has[order[i, j]]
                        parts.append(pd.DataFrame({"_qid": ids[s + rows[i]], "feature": f, "distance": top[i, j],
                                                   "_cid": keys[at], "value": D[at, f]}))
            return pd.concat(parts) if parts else pd.DataFrame({n: [] for n in names})

        queries = receivers.select(F.col("_rid").alias("_qid"), _vector(self.cols).alias("_qvec"))
        top = self.index.search(queries, k, best, "_qid long, feature long, distance double, _cid string, value double",
                                lambda b: (np.arange(b.has.shape[1]), b.has), lambda q, t: np.isnan(q), "feature")
        return top.groupBy(F.col("_qid").alias("_rid"), "feature").agg(F.avg("value").alias("value"))

    def transform(self, df: DataFrame, key: list[str]) -> DataFrame:
        missing = F.lit(False)
        for c in self.cols:
            missing = missing | F.col(c).isNull()
        if df.filter(missing).isEmpty():
            return df  # nothing to impute: no neighbour search at all
        # structs compare NULL fields as equal, so they can be joined and grouped
        combination = F.struct(*self.cols).alias("_features")
        distinct = df.filter(missing).select(combination).distinct()
        receivers = (distinct.withColumn("_rid", F.monotonically_increasing_id())
                     .select("_rid", "_features", "_features.*").checkpoint(eager=True))
        vals = self.imputed_values(receivers.drop("_features"))
        wide = vals.groupBy("_rid").agg(*[F.max(F.when(F.col("feature") == i, F.col("value"))).alias(c)
                                          for i, c in enumerate(self.cols)])
        wide = (receivers.select("_rid", "_features").join(wide, "_rid")
                .select("_features", *[F.col(c).alias(f"_imp_{c}") for c in self.cols]))
        j = df.withColumn("_features", combination).join(wide, "_features", "left")
        for c in self.cols:
            j = j.withColumn(c, F.coalesce(F.col(c), F.col(f"_imp_{c}"), F.lit(self.means[c])))
        return j.drop("_features", *[f"_imp_{c}" for c in self.cols])


def fit_knn_imputer(train: DataFrame, cols: list[str], key: list[str],
                    k: int = N_NEIGHBORS) -> KNNImputerModel:
    means_row = train.agg(*[F.avg(c).alias(c) for c in cols]).first()
    means = {c: float(means_row[c]) if means_row[c] is not None else 0.0 for c in cols}
    # every transform searches the same blocks of donors: built once
    index = BlockIndex(train.select(_key(key).alias("_cid"), F.lit(0).alias("_grp"), _vector(cols).alias("_vec")))
    return KNNImputerModel(list(cols), index, means, k)
