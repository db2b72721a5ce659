"""Queries of the text operators that run numpy inside their tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hotspots.llm import ctw, decontaminate, sentencepiece_codec, simhash
from hotspots.llm.catalog import register
from hotspots.sources.tables import Tables


@register("op3_decontaminate")
def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark hits of every document."""
    t = Tables(spark, sf_dir)
    judged = decontaminate.judge(spark, t.documents, t.benchmark, keep=["doc_id"])
    return judged.select(
        F.col("row.doc_id").alias("doc_id"), "n_words", "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"),
        "contaminated")


def tokenizer_path() -> str:
    """The public BPE model the query encodes with."""
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


@register("op5_sentencepiece")
def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the pieces and of the decoded text of every document."""
    done = sentencepiece_codec.digests(spark, Tables(spark, sf_dir).documents, tokenizer_path(),
                                       keep=["doc_id"])
    return done.select(F.col("row.doc_id").alias("doc_id"), "n_tokens", "ids_sha256",
                       "decoded_sha256", "n_source_bytes")


@register("op1_simhash")
def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    found = simhash.near_duplicates(Tables(spark, sf_dir).documents)
    return found.select(F.col("id").alias("doc_id"),
                        simhash.hex_text(F.col("fingerprint")).alias("fingerprint"), "component_id")


@register("op2_ctw_score")
def op2_ctw_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Context-tree and unigram scores of every document."""
    scored = ctw.score(spark, Tables(spark, sf_dir).documents, keep=["doc_id"])
    return scored.select(F.col("row.doc_id").alias("doc_id"), "held_out", "n_tokens", "n_known",
                         "train_tokens", "base_score", "score", "n_bytes", "code_length_per_byte")
