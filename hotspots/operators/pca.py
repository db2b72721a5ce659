"""PCA keeping the fewest components whose explained variance ratio sum
exceeds a target (M3). Centred projection; component signs are arbitrary.

The covariance and its eigenvectors come from ``pyspark.ml.feature.PCA``
(distributed Gram matrix); the d x k loading matrix is a fitted parameter and
the projection is a plain column expression.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hotspots.config import PCA_VARIANCE


@dataclass
class PCAModelLite:
    cols: list[str]
    mean: list[float]
    loadings: list[list[float]]  # d x k
    explained_ratio: list[float]

    @property
    def k(self) -> int:
        return len(self.loadings[0]) if self.loadings else 0

    def transform(self, df: DataFrame, prefix: str = "pc") -> DataFrame:
        cols = []
        for j in range(self.k):
            expr = F.lit(0.0)
            for i, c in enumerate(self.cols):
                expr = expr + (F.col(c) - F.lit(self.mean[i])) * F.lit(self.loadings[i][j])
            cols.append(expr.alias(f"{prefix}{j}"))
        return df.select("*", *cols)

    def out_cols(self, prefix: str = "pc") -> list[str]:
        return [f"{prefix}{j}" for j in range(self.k)]


def fit_pca(df: DataFrame, cols: list[str], variance: float = PCA_VARIANCE) -> PCAModelLite:
    vec = VectorAssembler(inputCols=cols, outputCol="_x", handleInvalid="error").transform(df)
    model = PCA(k=len(cols), inputCol="_x", outputCol="_p").fit(vec.select("_x"))
    ratio = np.asarray(model.explainedVariance.toArray(), dtype=float)
    cum = np.cumsum(ratio)
    k = int(np.searchsorted(cum, variance, side="right") + 1)
    k = min(max(k, 1), len(cols))
    pc = model.pc.toArray()[:, :k]
    means = df.agg(*[F.avg(c) for c in cols]).first()
    return PCAModelLite(list(cols), [float(m or 0.0) for m in means], pc.tolist(), ratio.tolist())
