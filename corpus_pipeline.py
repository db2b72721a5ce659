"""Corpus pipeline: toxicity, quality rules, near-duplicates, benchmark
decontamination, tokenisation.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
each stage's result as Parquet under the shared folder and rereads it as the
next stage's documents. The first four stages return the columns of their
input: what a stage rejects is gone for all later ones. A stage learns and
counts from its own input (and the labels and benchmark of ``sf_dir``).

Nulls, empty and very long texts, ties, repeated rows, empty tables and extra
columns: as each stage's operator defines them. In short: a document with a
null or blank text scores 0 for toxicity and falls to the quality rules (fewer
than ten words); repeated rows are near-duplicates of each other, one stays;
columns beside the id and the text are passed on untouched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hotspots.llm import decontaminate, quality_rules, sentencepiece_codec, simhash, toxicity
from hotspots.llm.queries_text import tokenizer_path
from hotspots.session import scratch_dir
from hotspots.sources.tables import Tables


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity stays below one half."""
    model = toxicity.fit(docs, Tables(spark, sf_dir).labels)
    return toxicity.score(spark, docs, model).filter(F.col("score") < 0.5).select("row.*")


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.judge(docs).filter("kept").select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component: that with the smallest id."""
    return simhash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages, or with less than a twentieth of
    their words in them."""
    judged = decontaminate.judge(spark, docs, Tables(spark, sf_dir).benchmark)
    return judged.filter(~F.col("contaminated")).select("row.*")


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces and their digests of every document that is left."""
    done = sentencepiece_codec.digests(spark, docs, tokenizer_path(), keep=["doc_id"])
    return done.select(F.col("row.doc_id").alias("doc_id"), "n_tokens", "ids_sha256", "decoded_sha256",
                       "n_source_bytes")


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_rules", drop_low_quality),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("sentencepiece", tokenise),
]

#: A trained network and a tokenizer have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = Tables(spark, sf_dir).documents
    folder = scratch_dir(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
