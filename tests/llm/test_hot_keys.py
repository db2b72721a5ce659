"""Joins with a key of most rows: adaptive execution must be able to split it."""
import pytest
from pyspark.sql import functions as F

from hotspots.llm import components, simhash, url_filters


@pytest.fixture
def skewed(spark):
    """Thresholds at which a few thousand rows count as skew, and no broadcasts."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10k",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
            "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def final_plan(df):
    # the frame's own execution, run to its end, holds the plan that adaptive execution settled on
    df._jdf.queryExecution().executedPlan().executeCollectPublic()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("large", [True, False])
def test_star_step_splits_a_hot_vertex(spark, skewed, large):
    # 95 % of the edges end in one vertex
    edges = spark.range(0, 40_000, 1, 12).select(
        (F.col("id") * 3 + 10).alias("u" if large else "v"),
        F.when(F.col("id") % 20 > 0, F.lit(1 if large else 200_000)).otherwise(F.col("id") + 3 if large else F.col("id") + 200_001)
        .cast("long").alias("v" if large else "u")).filter("u > v").select("u", "v").checkpoint()
    assert "skew=true" in final_plan(components._star(edges, large))


def test_members_of_one_component_are_split(spark, skewed):
    # fingerprints of one large class: the join of their root
    rows = spark.range(0, 30_000, 1, 12)
    rooted = rows.select(F.col("id").alias("fp"), F.when(F.col("id") % 20 > 0, F.lit(0)).otherwise(F.col("id")).alias("root")).checkpoint()
    component = rooted.groupBy("root").agg(F.min("fp").alias("component_id")).checkpoint()
    assert "skew=true" in final_plan(rooted.join(component, "root").select("fp", "component_id"))


def test_near_duplicates_of_one_hot_text(spark, skewed):
    docs = spark.range(0, 6_000, 1, 8).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") % 20 > 0, F.lit("one text that most of the documents hold"))
        .otherwise(F.concat(F.lit("text "), F.md5(F.col("id").cast("string")))).alias("text"))
    found = simhash.near_duplicates(docs).collect()
    hot = {r.component_id for r in found if r.id % 20}
    assert len(found) == 6_000 and hot == {1}


@pytest.mark.parametrize("hot", [None, "no scheme", "http://www.example.com/en/a"])
def test_hot_url_is_split(spark, skewed, hot):
    pages = spark.range(0, 30_000, 1, 12).select(
        F.col("id").alias("page_id"),
        F.when(F.col("id") % 20 > 0, F.lit(hot).cast("string")).otherwise(F.concat(F.lit("http://h"), "id", F.lit(".net/fr/"))).alias("url"),
        F.sha2(F.col("id").cast("string"), 256).alias("html"))
    rules = url_filters.rule_table(spark)
    judged = url_filters.judge_urls(pages, rules)
    assert "skew=true" in final_plan(judged)
    rows = judged.select("row.url", "verdict", "rule").collect()
    assert len(rows) == 30_000
    assert {r.rule for r in rows if r.url == hot} == ({"www.example.com/en/"} if hot and "://" in hot else {None})
