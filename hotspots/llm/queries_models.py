"""Queries of the trained operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hotspots.llm import quality_cnn, toxicity
from hotspots.llm.catalog import register
from hotspots.llm.training import fold
from hotspots.sources.tables import Tables


def _judged(scored: DataFrame, parts: int, held: int) -> DataFrame:
    return (scored.select(F.col("row.doc_id").alias("doc_id"), "score")
            .select("doc_id", F.coalesce(fold("doc_id", parts) == held, F.lit(False)).alias("held_out"), "score",
                    (F.col("score") >= 0.5).cast("int").alias("predicted")))


@register("op7_quality_cnn")
def op7_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document."""
    t = Tables(spark, sf_dir)
    model = quality_cnn.fit(t.documents, t.labels)
    return _judged(quality_cnn.score(spark, t.documents, model, keep=["doc_id"]), 3, 1)


@register("op9_toxicity")
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    t = Tables(spark, sf_dir)
    model = toxicity.fit(t.documents, t.labels)
    return _judged(toxicity.score(spark, t.documents, model, keep=["doc_id"]), 5, 0)
