import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from hotspots.operators.prefix import dense_index, running_total


@settings(max_examples=6, deadline=None)
@given(st.integers(min_value=0, max_value=10_000))
def test_running_total_equals_cumsum(spark, seed):
    rng = np.random.default_rng(seed)
    keys = rng.choice(100_000, size=500, replace=False).astype(float)
    vals = rng.integers(0, 50, size=500).astype(float)
    df = spark.createDataFrame([(float(k), float(v)) for k, v in zip(keys, vals)], "k double, v double")
    got = {r.k: r.cum for r in running_total(df, "k", "v", "cum", buckets=8).collect()}
    order = np.argsort(keys)
    exp = dict(zip(keys[order], np.cumsum(vals[order])))
    assert got == exp


def test_dense_index_is_sorted_enumeration(spark):
    rng = np.random.default_rng(9)
    rows = [(int(a), float(b)) for a, b in zip(rng.integers(0, 20, 700), rng.normal(size=700))]
    df = spark.createDataFrame(rows, "a long, b double")
    got = sorted((r.row_id, r.a, r.b) for r in dense_index(df, ["a", "b"], "row_id", buckets=5).collect())
    exp = sorted(rows)
    assert [g[0] for g in got] == list(range(len(rows)))
    assert [(g[1], g[2]) for g in got] == exp


def test_the_plan_of_a_running_total_does_not_grow_with_its_partitions(spark):
    df = spark.range(2000).selectExpr("cast(id as double) AS k", "cast(id % 7 as double) AS v")

    def size(buckets):
        return len(running_total(df, "k", "v", buckets=buckets)._jdf.queryExecution().optimizedPlan().toString())
    assert abs(size(200) - size(4)) < 200
    assert running_total(df, "k", "v", buckets=200).agg({"cum": "max"}).first()[0] == sum(i % 7 for i in range(2000))
    assert running_total(df.limit(0), "k", "v").count() == 0
