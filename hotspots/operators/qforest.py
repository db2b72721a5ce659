"""Quantile regression forest (M4, M5) after Meinshausen (2006).

Fit: ``pyspark.ml`` random forest with a leaf-index column, grown to Spark's
own depth bound (30). The rows are dealt by a hash of their values to a number
of partitions that follows the number of rows (``ROWS_PER_PARTITION``) and
sorted there, so the per-partition bootstrap seeds, and the forest, depend on
the training rows alone and not on how they were partitioned or on the cluster.
Every training row is mapped to its leaf in every tree, and the training labels
are kept as one sparse array (label, weight) per (tree, leaf), labels
ascending: a partitioned table of at most trees x rows entries.

Predict: a row's weight on training label y is the mean over trees of
count(tree, leaf, y) / size(tree, leaf). Rows meet the arrays of their leaves by
a join on (tree, leaf) - broadcast after a size check, else a shuffle - and the
weights of a row's labels are added by partial aggregation. The q-quantile is
the smallest label whose cumulative weight reaches q, found in one walk over the
row's own sorted labels: no array of all labels, nothing through the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hotspots.config import N_ESTIMATORS, QUANTILE, RANDOM_STATE
from hotspots.operators.joins import broadcast_if_small

EPS = 1e-9  # cumulative weights of one row end within a few ulps of 1
LEAST_PARTITIONS, ROWS_PER_PARTITION = 8, 10_000  # part of the model, like the seed
MAX_DEPTH = 30  # Spark's own bound; the original grows without one
PASS_MB = 48  # split statistics of one pass, per task


def weighted_quantile(df: DataFrame, key: list[str], y: str, w: str, q: float,
                      out: str = "y_hat") -> DataFrame:
    """Smallest ``y`` per key whose cumulative normalised weight reaches ``q``.

    ``df`` holds one row per (key, y); the running sum per key runs over that
    key's distinct y values only."""
    total = Window.partitionBy(*key)
    cw = Window.partitionBy(*key).orderBy(y).rowsBetween(Window.unboundedPreceding, 0)
    cum = df.withColumn("_c", F.sum(w).over(cw) / F.sum(w).over(total))
    return cum.filter(F.col("_c") >= F.lit(q - EPS)).groupBy(*key).agg(F.min(y).alias(out))


@dataclass
class QuantileForestModel:
    forest: RandomForestRegressionModel
    leaves: DataFrame  # tree, leaf, hist: array<struct<y, w>> by y
    num_trees: int
    features_col: str = "features"

    def weights(self, df: DataFrame, key: list[str]) -> DataFrame:
        """(key, labels: array<struct<y, w>> by y): the weight of every training
        label that a row's leaves hold. ``key`` identifies a row."""
        found = self.forest.transform(df.select(*key, self.features_col)).select(
            *key, F.posexplode(vector_to_array("leaf")).alias("tree", "leaf")).withColumn("leaf", F.col("leaf").cast("int"))
        each = (found.join(broadcast_if_small(self.leaves), ["tree", "leaf"])
                .select(*key, F.explode("hist").alias("h")).select(*key, "h.y", "h.w"))
        # integer counts per leaf, divided per leaf: the order of adding moves only the last bits
        summed = each.groupBy(*key, "y").agg(F.sum("w").alias("w"))
        return summed.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("y", "w"))).alias("labels"))

    def predict(self, df: DataFrame, key: list[str], q: float = QUANTILE,
                out: str = "y_hat") -> DataFrame:
        return self._quantiles(df, key, {out: q})

    def predict_many(self, df: DataFrame, key: list[str], qs: list[float]) -> DataFrame:
        return self._quantiles(df, key, {f"q{int(round(q * 100)):02d}": q for q in qs})

    def _quantiles(self, df: DataFrame, key: list[str], wanted: dict[str, float]) -> DataFrame:
        total = F.aggregate("labels", F.lit(0.0), lambda n, x: n + x["w"])
        weighted = self.weights(df, key).withColumn("_total", total)
        return weighted.select(*key, *[sorted_quantile("labels", "_total", q).alias(name) for name, q in wanted.items()])


def sorted_quantile(labels: str, total: str, q: float) -> Column:
    """Smallest y of an array (y, w) sorted by y whose cumulative weight reaches
    the share ``q`` of the total, in one walk."""
    limit = F.lit(q - EPS) * F.col(total)
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(None).cast("double").alias("y"))

    def step(acc: Column, x: Column) -> Column:
        now = acc["sum"] + x["w"]
        return F.struct(now.alias("sum"), F.coalesce(acc["y"], F.when(now >= limit, x["y"])).alias("y"))

    return F.aggregate(labels, start, step, lambda acc: acc["y"])


def fit_quantile_forest(df: DataFrame, label: str, features_col: str = "features",
                        num_trees: int = N_ESTIMATORS, seed: int = RANDOM_STATE,
                        max_depth: int = MAX_DEPTH, max_bins: int = 32, partitions: int | None = None,
                        checkpoint: bool = True) -> QuantileForestModel:
    # deep trees have many nodes: a task's statistics of one pass are bounded by
    # PASS_MB; checkpoints of the node-id cache go to the shared folder
    rf = RandomForestRegressor(featuresCol=features_col, labelCol=label, numTrees=num_trees,
                               seed=seed, maxDepth=max_depth, maxBins=max_bins,
                               featureSubsetStrategy="all", leafCol="leaf",
                               maxMemoryInMB=PASS_MB, cacheNodeIds=True, checkpointInterval=10)
    train = df.select(features_col, F.col(label).cast("double").alias(label))
    # rounded: the last bits of projected features follow the order of summation
    place = F.xxhash64(F.transform(vector_to_array(features_col), lambda x: F.round(x, 6)), label)
    if partitions is None:
        partitions = max(LEAST_PARTITIONS, -(-train.count() // ROWS_PER_PARTITION))
    train = (train.withColumn("_h", place).repartition(partitions, "_h").sortWithinPartitions("_h", label)
             .drop("_h").persist(StorageLevel.MEMORY_AND_DISK))
    forest = rf.fit(train)
    leaf = forest.transform(train).select(
        F.col(label).alias("y"), F.posexplode(vector_to_array("leaf")).alias("tree", "leaf"))
    hist = (leaf.withColumn("leaf", F.col("leaf").cast("int"))
            .groupBy("tree", "leaf", "y").agg(F.count(F.lit(1)).alias("cnt")))
    one = F.sort_array(F.collect_list(F.struct("y", "cnt")))
    size = F.aggregate("one", F.lit(0).cast("long"), lambda n, x: n + x["cnt"])
    share = lambda x: F.struct(x["y"].alias("y"), (x["cnt"] / F.col("size") / F.lit(float(num_trees))).alias("w"))
    leaves = (hist.groupBy("tree", "leaf").agg(one.alias("one")).withColumn("size", size)
              .select("tree", "leaf", F.transform("one", share).alias("hist")))
    leaves = leaves.checkpoint(eager=True) if checkpoint else leaves.cache()
    train.unpersist()
    return QuantileForestModel(forest, leaves, num_trees, features_col)
