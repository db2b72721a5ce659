"""Queries of the two operators that are DataFrame expressions throughout."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hotspots.llm import quality_rules, url_filters
from hotspots.llm.catalog import register
from hotspots.sources.tables import Tables


def _sql_list(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


_OP6_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT rid, doc_id, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM d),
g AS (
  SELECT rid, i, list_slice(words, i, i + 4) AS gram
  FROM (SELECT rid, words, unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) >= 5) x),
r AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS n FROM g) x WHERE n > 1),
c AS (
  SELECT rid, sum(least(5, coalesce(nxt - i, 5))) AS covered
  FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM r) x GROUP BY rid),
m AS (
  SELECT w.doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]+', '', 'g')) AS n_symbols,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, len(lines) AS n_lines,
    CAST(coalesce(c.covered, 0) AS BIGINT) AS n_repeat_words,
    length(text) - length(regexp_replace(text, '!+', '', 'g')) AS n_excl,
    length(regexp_replace(text, '\\P{{L}}+', '', 'g')) AS n_letters,
    len(list_filter(words, lambda x: x IN ({_sql_list(quality_rules.STOP_WORDS)}))) AS n_stop
  FROM w LEFT JOIN c USING (rid)),
v AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
    CAST(greatest(n_words, 1) AS DOUBLE) AS nw FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
  CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  n_repeat_words, base_failed,
  NOT base_failed AND word_chars / nw BETWEEN 2.0 AND 20.0 AND n_symbols / nw <= 0.20
    AND n_excl / nw <= 0.30 AND (n_words < 60 OR n_stop / nw >= 0.02)
    AND n_dup_lines / greatest(n_lines, 1.0) <= 0.50
    AND n_letters / greatest(word_chars, 1.0) >= 0.45 AS kept
FROM v
"""


@register("op6_quality_rules", _OP6_SQL)
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of every document."""
    return quality_rules.judge(Tables(spark, sf_dir).documents, keep=["doc_id"]).select(
        F.col("row.doc_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines",
        "n_repeat_words", "base_failed", "kept")


_OP8_SQL = """
WITH u AS (
  SELECT page_id, coalesce(url, '') AS url FROM pages),
p AS (
  SELECT page_id,
    translate(CASE WHEN strpos(url, '://') > 0 THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*') ELSE '' END,
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    CASE WHEN strpos(url, '://') > 0 THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM u),
r AS (
  SELECT *, CASE
      WHEN ('.' || host) LIKE '%.www.example.com' AND starts_with(path, '/en/') THEN 'www.example.com/en/'
      WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/en/') THEN 'example.com/en/'
      WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/es/') THEN 'net/es/'
      WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/fr/') THEN 'net/fr/'
      WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/') THEN 'com/' END AS rule,
    host || path AS place
  FROM p)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow'
       WHEN rule IS NOT NULL THEN 'block'
       WHEN contains(place, 'adult-x.') OR contains(place, '/login/') OR contains(place, '/cart/')
         OR contains(place, '/casino/') OR contains(place, '/wp-admin/') OR contains(place, '/xxx/')
       THEN 'block' ELSE 'allow' END AS verdict
FROM r
"""


@register("op8_url_filters", _OP8_SQL)
def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, fitting host rule and verdict of every page."""
    pages = Tables(spark, sf_dir).pages.select("page_id", "url")
    judged = url_filters.judge_urls(pages, url_filters.rule_table(spark))
    return judged.select(F.col("row.page_id").alias("page_id"), "host", "path", "rule", "verdict")
