"""Persist and reload a fitted model pipeline (SK5).

Spark ML writes the forest; the leaf table, the imputer donors and the training
days of the nearest-day search are Parquet tables; the small fitted parameters
(scaler, PCA loadings, threshold, explainer bins) are one JSON document. Everything lands under one folder, on shared storage.
"""

from __future__ import annotations

import json

from pyspark.ml.regression import RandomForestRegressionModel
from pyspark.sql import SparkSession

from hotspots.operators.explain import Explainer
from hotspots.operators.imputer import KNNImputerModel
from hotspots.operators.nearest_days import NearestDays
from hotspots.operators.neighbors import BlockIndex
from hotspots.operators.pca import PCAModelLite
from hotspots.operators.qforest import QuantileForestModel
from hotspots.operators.scaler import ScalerModel
from hotspots.operators.threshold import ThresholdModel


def save_pipeline(pipe, path: str) -> None:
    spark = pipe.forest.leaves.sparkSession
    p = path.rstrip("/")
    pipe.forest.forest.write().overwrite().save(f"{p}/forest")
    pipe.forest.leaves.write.mode("overwrite").parquet(f"{p}/leaves")
    pipe.imputer.index.rows.select("_cid", "_grp", "_vec").write.mode("overwrite").parquet(f"{p}/donors")
    if pipe.nearest_days is not None:
        pipe.nearest_days.candidates.write.mode("overwrite").parquet(f"{p}/nearest_days")
    params = {
        "features": pipe.features, "label": pipe.label, "quantile": pipe.quantile,
        "num_trees": pipe.forest.num_trees,
        "scaler": {"cols": pipe.scaler.cols, "mean": pipe.scaler.mean, "scale": pipe.scaler.scale},
        "imputer": {"cols": pipe.imputer.cols, "means": pipe.imputer.means, "k": pipe.imputer.k},
        "pca": {"cols": pipe.pca.cols, "mean": pipe.pca.mean, "loadings": pipe.pca.loadings,
                "explained_ratio": pipe.pca.explained_ratio},
        "threshold": None if pipe.threshold is None else pipe.threshold.__dict__,
        "explainer": None if pipe.explainer is None else pipe.explainer.__dict__,
        "nearest_days": None if pipe.nearest_days is None else pipe.nearest_days.key,
    }
    spark.createDataFrame([(json.dumps(params),)], "params string").coalesce(1).write.mode(
        "overwrite").text(f"{p}/params")


def load_pipeline(spark: SparkSession, path: str):
    from hotspots.plans.scoring_model import FirePredictionPipeline
    p = path.rstrip("/")
    params = json.loads(spark.read.text(f"{p}/params").first()[0])
    forest = RandomForestRegressionModel.load(f"{p}/forest")
    leaves = spark.read.parquet(f"{p}/leaves")
    donors = BlockIndex(spark.read.parquet(f"{p}/donors"))
    pipe = FirePredictionPipeline(features=params["features"], label=params["label"],
                                  quantile=params["quantile"], num_trees=params["num_trees"])
    pipe.scaler = ScalerModel(**params["scaler"])
    pipe.imputer = KNNImputerModel(params["imputer"]["cols"], donors, params["imputer"]["means"],
                                   params["imputer"]["k"])
    pipe.pca = PCAModelLite(**params["pca"])
    pipe.forest = QuantileForestModel(forest, leaves, params["num_trees"])
    if params["threshold"]:
        pipe.threshold = ThresholdModel(**params["threshold"])
    if params["explainer"]:
        pipe.explainer = Explainer(**params["explainer"])
    if params["nearest_days"]:
        pipe.nearest_days = NearestDays(pipe.features, params["nearest_days"], pipe.label,
                                        spark.read.parquet(f"{p}/nearest_days"))
    return pipe
