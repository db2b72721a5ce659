"""Queries of the WARC and chat operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hotspots.llm import chat, warc
from hotspots.llm.catalog import register
from hotspots.session import scratch_dir
from hotspots.sources.tables import Tables

_OP4_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes,
    sha1(encode(coalesce(html, ''))) AS payload_digest
  FROM pages),
m AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id < first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id < first THEN first END AS refers_to
FROM m
"""


@register("op4_warc", _OP4_SQL)
def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written to WARC archives in the shared folder and read back."""
    path = f"{scratch_dir(spark, 'warc')}/archives"
    warc.write_archives(Tables(spark, sf_dir).pages, path)
    records = warc.summarise(warc.read_archives(spark, path))
    return records.select(F.col("id").cast("long").alias("page_id"), "payload_bytes", "payload_digest",
                          "record_type", F.col("refers_to").cast("long").alias("refers_to"))


_OP10_SQL = """
WITH c AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(text) + length(role) + 23
    + CASE WHEN conv_id = -7 THEN 3 ELSE 0 END) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""


@register("op10_chat_format", _OP10_SQL)
def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -7, formatted and read back."""
    given = Tables(spark, sf_dir).conversations.select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(1).select(F.explode(F.array(*[
        F.struct(F.lit(-7).cast("long").alias("conv_id"), F.lit(i).cast("long").alias("turn"),
                 F.lit(r).alias("role"), F.lit(said).alias("text"))
        for i, r in enumerate(("user", "assistant"))])).alias("t")).select("t.*")
    turns = given.unionByName(extra)
    return chat.read_back(chat.format_turns(turns, chat.text_part(F.col("text"))))
