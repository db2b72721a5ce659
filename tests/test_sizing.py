from hotspots.operators.joins import broadcast_if_small, measured_bytes
from hotspots.session import sizing


def test_sizing_targets_partition_bytes():
    c = sizing(100 * 1024 ** 4, executor_cores=4000)      # 100 TB on 4000 cores
    assert int(c["spark.sql.shuffle.partitions"]) == 100 * 1024 ** 4 // (128 << 20)
    small = sizing(10 << 20, executor_cores=8)             # tiny input: two waves of cores
    assert small["spark.sql.shuffle.partitions"] == "16"
    assert small["spark.sql.files.maxPartitionBytes"] == str(128 << 20)


def test_broadcast_guard_bounds_rows_and_bytes(spark):
    df = spark.range(1000).selectExpr("id", "cast(id as string) AS s")
    hinted = broadcast_if_small(df, max_rows=5000)
    assert "broadcast" in hinted._jdf.queryExecution().logical().toString().lower()
    too_many_rows = broadcast_if_small(df, max_rows=10)
    assert "broadcast" not in too_many_rows._jdf.queryExecution().logical().toString().lower()
    too_many_bytes = broadcast_if_small(df, max_rows=5000, max_bytes=4000)
    assert "broadcast" not in too_many_bytes._jdf.queryExecution().logical().toString().lower()


def test_nested_values_are_measured(spark):
    df = spark.range(1).selectExpr(
        "sequence(1, 500) AS a", "array(named_struct('x', 1D, 'y', 2D)) AS s", "map('k', 'v') AS m",
        "named_struct('t', repeat('z', 300)) AS t", "CAST(NULL AS ARRAY<STRING>) AS none")
    n = df.select(measured_bytes(df)).first()[0]
    assert 500 * 8 + 300 < n < 500 * 8 + 300 + 400
    assert "broadcast" not in broadcast_if_small(df, max_bytes=4000)._jdf.queryExecution().logical().toString().lower()
