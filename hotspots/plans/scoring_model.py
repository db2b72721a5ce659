"""Model pipeline (E2 / M14): scale -> impute -> PCA -> quantile forest ->
threshold (calibration) -> significance -> decay.

Every step is a Spark DataFrame operation; the fitted parameters (means,
scales, loadings, thresholds) are small driver values, the forest and its
leaf table stay in Spark. Keys (grid_cell, acq_date) travel with every row.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame

from hotspots.config import FEATURES, QUANTILE
from hotspots.operators.decay import decay_scores
from hotspots.operators.explain import Explainer, fit_explainer
from hotspots.operators.imputer import KNNImputerModel, fit_knn_imputer
from hotspots.operators.nearest_days import NearestDays
from hotspots.operators.pca import PCAModelLite, fit_pca
from hotspots.operators.qforest import MAX_DEPTH, QuantileForestModel, fit_quantile_forest
from hotspots.operators.scaler import ScalerModel, fit_scaler
from hotspots.operators.threshold import ThresholdModel, fit_threshold

KEY = ["grid_cell", "acq_date"]


@dataclass
class FirePredictionPipeline:
    features: list[str] = field(default_factory=lambda: list(FEATURES))
    label: str = "fire_count"
    quantile: float = QUANTILE
    num_trees: int = 100
    max_depth: int = MAX_DEPTH
    scaler: ScalerModel | None = None
    imputer: KNNImputerModel | None = None
    pca: PCAModelLite | None = None
    forest: QuantileForestModel | None = None
    threshold: ThresholdModel | None = None
    nearest_days: NearestDays | None = None
    explainer: Explainer | None = None

    # ---------------------------------------------------------------- stages
    def prepare(self, df: DataFrame, key: list[str] = KEY) -> DataFrame:
        """Scaled, imputed and projected features with an assembled vector."""
        s = self.scaler.transform(df.select(*key, *self.features))
        s = self.imputer.transform(s, key)
        p = self.pca.transform(s)
        return VectorAssembler(inputCols=self.pca.out_cols(), outputCol="features").transform(p)

    def imputed(self, df: DataFrame, key: list[str] = KEY) -> DataFrame:
        """Scaled and imputed features by key."""
        return self.imputer.transform(self.scaler.transform(df.select(*key, *self.features)), key)

    def fit_rf(self, train: DataFrame) -> "FirePredictionPipeline":
        base = train.select(*KEY, self.label, *self.features)
        self.scaler = fit_scaler(base, self.features)
        scaled = self.scaler.transform(base).persist(StorageLevel.MEMORY_AND_DISK)
        self.imputer = fit_knn_imputer(scaled, self.features, KEY)
        imputed = self.imputer.transform(scaled, KEY).persist(StorageLevel.MEMORY_AND_DISK)
        self.pca = fit_pca(imputed, self.features)
        vec = VectorAssembler(inputCols=self.pca.out_cols(), outputCol="features").transform(
            self.pca.transform(imputed))
        self.forest = fit_quantile_forest(vec, self.label, num_trees=self.num_trees,
                                          max_depth=self.max_depth)
        imputed.unpersist()
        scaled.unpersist()
        return self

    def expected(self, df: DataFrame, q: float | None = None, key: list[str] = KEY) -> DataFrame:
        """Rows of ``df`` with ``y_hat`` = the q-quantile of the expected count."""
        prepared = self.prepare(df, key)
        pred = self.forest.predict(prepared, key, q or self.quantile)
        return df.join(pred, key, "left")

    def predict_fn(self):
        """DataFrame -> DataFrame scoring function for the explainer: (key columns, y_hat)."""
        def fn(df: DataFrame, key: list[str]) -> DataFrame:
            return self.forest.predict(self.prepare(df, key), key, self.quantile)
        return fn

    def fit_threshold(self, calibration: DataFrame) -> "FirePredictionPipeline":
        cal = self.expected(calibration).persist(StorageLevel.MEMORY_AND_DISK)
        self.threshold = fit_threshold(cal, self.label, "y_hat")
        cal.unpersist()
        return self

    def fit_views(self, train: DataFrame) -> "FirePredictionPipeline":
        """The nearest training days and the explainer."""
        self.nearest_days = NearestDays.fit(train, self.imputed(train), self.features, KEY, self.label)
        self.explainer = fit_explainer(train, self.features)
        return self

    def fit(self, train: DataFrame, calibration: DataFrame) -> "FirePredictionPipeline":
        """All fitted parts: scaler, imputer, PCA, forest, threshold, nearest
        days and explainer. Empty input is an error."""
        for name, df in (("training", train), ("calibration", calibration)):
            if df.isEmpty():
                raise ValueError(f"no {name} rows")
        return self.fit_rf(train).fit_threshold(calibration).fit_views(train)

    def nearest(self, df: DataFrame) -> DataFrame:
        """Nearest training cell-day with and without fires of every row."""
        return self.nearest_days.search(self.imputed(df))

    def explain(self, df: DataFrame, key: str, num_samples: int = 5000) -> DataFrame:
        """Local explanations of the rows of ``df``."""
        return self.explainer.explain(df.select(key, *self.features), key, self.predict_fn(), num_samples=num_samples)

    def predict(self, df: DataFrame) -> DataFrame:
        """Raw and decayed labels and scores per cell-day."""
        scored = self.threshold.transform(self.expected(df), self.label, "y_hat")
        return decay_scores(scored)
