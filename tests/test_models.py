import math

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from hotspots.operators.imputer import fit_knn_imputer
from hotspots.operators.kmeans import kmeans_groups
from hotspots.operators.neighbors import nearest
from hotspots.operators.qforest import fit_quantile_forest


def test_one_nn_literal_fixture(spark):
    # feature1 = 1..10, feature2 = 10..1, target 0 0 0 1 1 0 0 1 1 0
    f1 = list(range(1, 11))
    f2 = list(range(10, 0, -1))
    y = [0, 0, 0, 1, 1, 0, 0, 1, 1, 0]
    rows = [(i, [float(a), float(b)], int(t > 0)) for i, (a, b, t) in enumerate(zip(f1, f2, y))]
    c = spark.createDataFrame(rows, "cid long, v array<double>, cls long")
    q = spark.createDataFrame([(100, [2.2, 8.8]), (101, [7.6, 3.4])], "qid long, v array<double>")
    got = {(r.qid, r.cls): r.cid for r in nearest(q, c, "qid", "cid", "v", group="cls").collect()}
    X = np.array([[a, b] for a, b in zip(f1, f2)], float)
    for qid, qv in ((100, [2.2, 8.8]), (101, [7.6, 3.4])):
        for cls in (0, 1):
            idx = [i for i in range(10) if int(y[i] > 0) == cls]
            d = np.sqrt(((X[idx] - np.array(qv)) ** 2).sum(1))
            assert got[(qid, cls)] == idx[int(np.argmin(d))]


def test_knn_imputer_brute_force(spark):
    rng = np.random.default_rng(0)
    X = rng.normal(size=(120, 4))
    X[rng.random((120, 4)) < 0.15] = np.nan
    rows = [(f"r{i:03d}", *[None if np.isnan(v) else float(v) for v in X[i]]) for i in range(120)]
    df = spark.createDataFrame(rows, "key string, a double, b double, c double, d double")
    cols = ["a", "b", "c", "d"]
    m = fit_knn_imputer(df, cols, ["key"], k=5)
    got = {r.key: [r[c] for c in cols] for r in m.transform(df, ["key"]).collect()}
    means = np.nanmean(X, axis=0)
    for i in range(120):
        for f in range(4):
            if not np.isnan(X[i, f]):
                assert got[f"r{i:03d}"][f] == X[i, f]
                continue
            cands = []
            for j in range(120):
                if np.isnan(X[j, f]):
                    continue
                both = ~np.isnan(X[i]) & ~np.isnan(X[j])
                if not both.any():
                    continue
                dd = round(float(np.sqrt(((X[i, both] - X[j, both]) ** 2).sum() * 4 / both.sum())), 9)
                cands.append((dd, f"r{j:03d}", X[j, f]))
            exp = np.mean([v for _, _, v in sorted(cands)[:5]]) if cands else means[f]
            assert abs(got[f"r{i:03d}"][f] - exp) < 1e-9


def test_quantile_forest_monotone_and_coverage(spark):
    rng = np.random.default_rng(1)
    n = 600
    x = rng.uniform(0, 10, n)
    y = rng.poisson(x / 2 + 0.5)
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))],
                               "id long, x double, y double")
    vec = VectorAssembler(inputCols=["x"], outputCol="features").transform(df)
    m = fit_quantile_forest(vec, "y", num_trees=20, max_depth=6, checkpoint=False)
    p = m.predict_many(vec, ["id"], [0.5, 0.95]).join(df, "id").collect()
    assert len(p) == n
    assert all(r.q50 <= r.q95 for r in p)
    coverage = np.mean([r.y <= r.q95 for r in p])
    assert coverage >= 0.9


def test_kmeans_groups_invariants(spark):
    rng = np.random.default_rng(2)
    rows = []
    for g in range(3):
        n = [3, 40, 200][g]
        for i in range(n):
            rows.append((g * 1000 + i, g, float(rng.normal()), float(rng.normal())))
    pts = spark.createDataFrame(rows, "_pid long, day int, lat double, lon double")
    out = kmeans_groups(pts, ["day"], k=5, max_iter=5)
    assert out.count() == len(rows)
    per = {r.day: r.n for r in out.groupBy("day").agg(F.countDistinct("cluster").alias("n")).collect()}
    assert per[0] == 3 and per[1] <= 5 and per[2] <= 5


def test_nearest_many_blocks_equals_one_block(spark):
    rng = np.random.default_rng(4)
    C = rng.normal(size=(300, 3))
    Q = rng.normal(size=(50, 3))
    c = spark.createDataFrame([(i, [float(x) for x in v], i % 2) for i, v in enumerate(C)],
                              "cid long, v array<double>, g long")
    q = spark.createDataFrame([(1000 + i, [float(x) for x in v]) for i, v in enumerate(Q)],
                              "qid long, v array<double>")
    a = {(r.qid, r.g, r.rank): r.cid for r in nearest(q, c, "qid", "cid", "v", group="g", k=3).collect()}
    b = {(r.qid, r.g, r.rank): r.cid for r in nearest(q, c, "qid", "cid", "v", group="g", k=3,
                                                      block_rows=7).collect()}
    assert a == b and len(a) == 50 * 2 * 3


def test_explainer_recovers_linear_model(spark):
    """On a model that only depends on feature a, a gets the largest weight and
    the explanation lists every feature once, ordered by absolute weight."""
    from hotspots.operators.explain import fit_explainer
    rng = np.random.default_rng(5)
    rows = [(float(a), float(b), float(c)) for a, b, c in rng.uniform(0, 10, (400, 3))]
    train = spark.createDataFrame(rows, "a double, b double, c double")
    ex = fit_explainer(train, ["a", "b", "c"])
    target = spark.createDataFrame([("r1", 9.0, 5.0, 5.0)], "row_id string, a double, b double, c double")

    def predict(df, key):
        return df.select(*key, (F.col("a") * 3.0).alias("y_hat"))
    out = ex.explain(target, "row_id", predict, num_samples=2000).first()
    rules = [e.rule for e in out.explanation]
    weights = [abs(e.weight) for e in out.explanation]
    assert len(rules) == 3 and rules[0].startswith("a > ")
    assert weights == sorted(weights, reverse=True)


def test_explainer_weights_solve_the_weighted_least_squares(spark):
    """The partially aggregated sums give the solution found from the copies themselves."""
    from hotspots.operators.explain import fit_explainer
    rng = np.random.default_rng(6)
    rows = [(i, *map(float, r)) for i, r in enumerate(rng.normal(0, 1, (300, 3)))]
    train = spark.createDataFrame(rows, "row_id long, a double, b double, c double")
    cols = ["a", "b", "c"]
    ex = fit_explainer(train, cols)
    target = train.filter("row_id < 5").repartition(3)

    def predict(df, key):
        return df.select(*key, (F.col("a") * 2 + F.sin(F.col("b") * 3) - F.col("a") * F.col("c")).alias("y_hat"))
    got = {r.row_id: (r.coef, r.intercept) for r in ex.coefficients(target, "row_id", predict, 700).collect()}
    copies = ex.scored_copies(target.select("row_id", *cols), "row_id", predict, 700, 42).collect()
    assert len(got) == 5
    for i, (coef, intercept) in got.items():
        own = [r for r in copies if r.row_id == i]
        Z = np.array([[r._z >> k & 1 for k in range(3)] for r in own], float)
        y = np.array([r.y_hat for r in own])
        w = np.sqrt(np.exp(-(3 - Z.sum(1)) / (math.sqrt(3) * 0.75) ** 2))
        X = np.concatenate([np.ones((len(Z), 1)), Z], 1)
        ridge = np.diag([0.0, 1.0, 1.0, 1.0])
        want = np.linalg.solve(X.T @ (X * w[:, None]) + ridge, X.T @ (w * y))
        assert len(own) == 700 and np.allclose([intercept, *coef], want, atol=1e-8)


def test_kmeans_iteration_does_not_expand_the_assignment(spark, monkeypatch):
    """The expression that picks a cluster stands once in an iteration's plan, not
    in a filter below the aggregation, where it is too long to be compiled."""
    plans = []

    def spy(df, *a, **k):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return real(df, *a, **k)

    pts = spark.range(60).selectExpr("id AS _pid", "id % 2 AS day", "CAST(id * 7 % 31 AS double) AS lat", "CAST(id * 5 % 29 AS double) AS lon")
    real = type(pts).checkpoint
    monkeypatch.setattr(type(pts), "checkpoint", spy)
    out = kmeans_groups(pts, ["day"], k=3, max_iter=4).collect()
    assert len(out) == 60 and {r.cluster for r in out} == {0, 1, 2}
    filters = [line for p in plans for line in p.splitlines() if "Filter" in line]
    assert filters and not any("clat" in f or "aggregate(" in f for f in filters)


def test_copies_of_one_row_are_dealt_over_tasks_and_scored_once(spark):
    from hotspots.operators.explain import fit_explainer
    rng = np.random.default_rng(6)
    train = spark.createDataFrame([(float(a), float(b)) for a, b in rng.normal(0, 1, (200, 2))], "a double, b double")
    ex = fit_explainer(train, ["a", "b"])
    row = spark.createDataFrame([("r", 0.5, -0.5)], "row_id string, a double, b double").coalesce(1)
    copies = ex.perturb(row, "row_id", 1001, 3)
    assert sorted(r["sample"] for r in copies.select("sample").collect()) == list(range(1001))
    used = copies.select(F.spark_partition_id().alias("p")).distinct().count()
    assert used > 1
    calls = []

    def predict(df, key):
        calls.append(1)
        return df.select(*key, (F.col("a") * 2 + F.col("b")).alias("y_hat"))

    plain = ex.explain(row, "row_id", predict, num_samples=1001, seed=3).collect()[0]["explanation"]
    scored = ex.scored_copies(row, "row_id", predict, 1001, 3).checkpoint()
    made = len(calls)
    again = ex.explain(row, "row_id", predict, num_samples=1001, seed=3, scored=scored).collect()[0]["explanation"]
    assert len(calls) == made == 2
    assert [r["rule"] for r in plain] == [r["rule"] for r in again]
    assert np.allclose([r["weight"] for r in plain], [r["weight"] for r in again])
