"""Queries of language ID, token alignment and spelling variants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hotspots.llm import language_id, spelling_variants, token_alignment
from hotspots.llm.catalog import register
from hotspots.llm.queries_text import tokenizer_path
from hotspots.llm.training import fold
from hotspots.sources.tables import Tables


@register("op11_language_id")
def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document."""
    docs = Tables(spark, sf_dir).documents
    held = fold("doc_id", 4) == 2
    found = language_id.predict(spark, docs, language_id.fit(docs, ~held), keep=["doc_id"])
    return (found.select(F.col("row.doc_id").alias("doc_id"), "lang_pred", "score")
            .select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "lang_pred", "score"))


@register("op12_token_alignment")
def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups, links and corpus link counts of every document under two tokenizers."""
    import public_tokenizers

    done = token_alignment.score_links(spark, Tables(spark, sf_dir).documents,
                                       public_tokenizers.path("byte_bpe_50k.json"), tokenizer_path(), keep=["doc_id"])
    return done.select(F.col("row.doc_id").cast("long").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best",
                       "count_sum", "groups_sha256", "n_overlaps", "n_shared")


#: crc32 as arithmetic: the byte table from its polynomial, folded over the bytes of a text.
OP13_SQL = r"""
WITH RECURSIVE byte_table AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
runs AS (
  SELECT id, run, count(*) AS n FROM (
    SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id,
      unnest(list_transform(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+'),
        lambda r: translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))) AS run
    FROM documents) x GROUP BY id, run),
hashed AS (
  SELECT run, n, xor(list_reduce(list_prepend(4294967295, list_transform(range(strlen(id || ':' || run)),
      lambda i: CAST('0x' || substr(hex(encode(id || ':' || run)), 2 * i + 1, 2) AS BIGINT))),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h
  FROM runs, byte_table),
words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
    SELECT n, CASE WHEN h % 97 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2)
      ELSE run END AS word FROM hashed) x
  WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
cut AS (
  SELECT word, i, left(word, i - 1) || substr(word, i + 1) AS rest
  FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words) x),
near AS (
  SELECT a.word, b.word AS other FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word FROM cut a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word FROM cut a JOIN words b ON a.rest = b.word),
ranked AS (
  SELECT near.word, near.other, w.n AS other_n, count(*) OVER (PARTITION BY near.word) AS n_near,
    row_number() OVER (PARTITION BY near.word ORDER BY w.n DESC, near.other) AS place
  FROM near JOIN words w ON w.word = near.other),
forms AS (
  SELECT words.word, words.n, coalesce(r.n_near, 0) AS n_near,
    CASE WHEN r.other_n >= 2 * words.n THEN r.other END AS form,
    CASE WHEN r.other_n >= 2 * words.n THEN r.other_n END AS form_n
  FROM words LEFT JOIN ranked r ON r.word = words.word AND r.place = 1),
walk AS (
  SELECT word, word AS at, form AS next FROM forms
  UNION ALL SELECT walk.word, f.word, f.form FROM walk JOIN forms f ON f.word = walk.next)
SELECT forms.word, form, walk.at AS root, n, CAST(n_near AS BIGINT) AS n_near, form_n
FROM forms JOIN walk ON walk.word = forms.word AND walk.next IS NULL
"""


@register("op13_spelling_variants", OP13_SQL)
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants among the words of all documents."""
    return spelling_variants.group_variants(spark, Tables(spark, sf_dir).documents)
