"""Cases that must not lose rows, and plans that must not depend on partitioning."""
import datetime as dt
import math

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from hotspots.operators import densify as D
from hotspots.operators import kmeans
from hotspots.operators.explain import normal_quantile, wide
from hotspots.operators.kmeans import kmeans_groups
from hotspots.operators.neighbors import in_block_pairs, nearest
from hotspots.operators.qforest import fit_quantile_forest
from hotspots.operators.quantiles import exact_percentiles
from hotspots.operators.spatial import points_in_polygons, ring_edges
from hotspots.session import ensure_checkpoint_dir, scratch_dir
from hotspots.sinks import writers
from hotspots.sources import landing as L

d = dt.date
SF = "/root/testdata/sf0.001"


def _weather(spark, rows):
    return spark.createDataFrame(rows, "oblast_id string, acq_date date, t_mean double, cloud_cover double")


def test_upsert_raises_read_errors_and_leaves_the_year(spark, monkeypatch):
    root = scratch_dir(spark, "t-fault")
    rows = [("A", d(2024, 1, 1 + i), float(i), 0.0) for i in range(20)]
    writers.upsert_yearly(_weather(spark, rows), root, "weather", ["acq_date", "oblast_id"])

    def broken(*_):
        raise OSError("storage is away")
    with monkeypatch.context() as m:
        m.setattr(writers, "read_kind", broken)
        with pytest.raises(OSError):
            writers.upsert_yearly(_weather(spark, rows[:1]), root, "weather", ["acq_date", "oblast_id"])
    assert L.read_kind(spark, root, "weather").count() == 20


def test_last_row_of_a_batch_wins(spark):
    old = _weather(spark, [("A", d(2024, 1, 1), 0.0, 0.0)])
    new = _weather(spark, [("A", d(2024, 1, 1), float(i), 0.0) for i in range(9)]).coalesce(1)
    keys = ["acq_date", "oblast_id"]
    assert [r.t_mean for r in writers.keep_last(old, new, keys).collect()] == [8.0]
    assert [r.t_mean for r in writers.keep_last(old, new, keys, order=["cloud_cover", "t_mean"]).collect()] == [8.0]


def test_upsert_keeps_shared_columns(spark):
    old = _weather(spark, [("A", d(2024, 1, 1), 1.0, 5.0)])
    new = spark.createDataFrame([("A", d(2024, 1, 2), 2.0, "x")], "oblast_id string, acq_date date, t_mean double, extra string")
    out = writers.keep_last(old, new, ["acq_date", "oblast_id"])
    assert out.columns == ["oblast_id", "acq_date", "t_mean"] and out.count() == 2


def test_static_scan_raises_storage_errors(spark, tmp_path, monkeypatch):
    (tmp_path / "a_50km.csv").write_text("LATITUDE,LONGITUDE,OBLAST_ID,C0\n46.0,24.0,1,NaN\n")
    [layer] = L.scan_static(spark, [f"file://{tmp_path}", f"file://{tmp_path}/none"])
    assert layer.dtypes == [("latitude", "double"), ("longitude", "double"), ("oblast_id", "string"), ("c0", "double")]
    assert layer.first().c0 is None

    def broken(*_):
        raise PermissionError("no")
    monkeypatch.setattr(L, "glob", broken)
    with pytest.raises(PermissionError):
        L.scan_static(spark, [f"file://{tmp_path}"])


def test_empty_windows_are_errors(spark):
    root = scratch_dir(spark, "t-empty")
    L.land_yearly(spark.createDataFrame([(46.0, 24.0, d(2024, 5, 1))], "latitude double, longitude double, acq_date date"), root, "fire")
    L.land_yearly(_weather(spark, [("A", d(2024, 5, 1), 1.0, 1.0)]), root, "weather")
    L.scan_dynamic(spark, root, "2024-05-01", "2024-05-01")
    with pytest.raises(ValueError):
        L.scan_dynamic(spark, root, "2024-06-01", "2024-06-30")


def test_kmeans_keeps_null_classes_and_converges(spark):
    rng = np.random.default_rng(0)
    rows = [(i, None if i % 2 else 1, float(10 * (i % 3) + rng.normal() / 10), 0.0) for i in range(120)]
    rows += [(1000, 7, 0.0, 0.0)]
    pts = spark.createDataFrame(rows, "_pid long, cls int, lat double, lon double")
    out = kmeans_groups(pts, ["cls"], k=3)
    got = out.collect()
    assert len(got) == 121 and all(r.converged for r in got)
    for cls in (None, 1):
        own = [r for r in got if r.cls == cls]
        # each point is nearest to the mean of its own cluster: a fixed point of Lloyd's steps
        centres = {c: np.mean([r.lat for r in own if r.cluster == c]) for c in {r.cluster for r in own}}
        assert all(abs(r.lat - centres[r.cluster]) <= min(abs(r.lat - m) for m in centres.values()) + 0.2 for r in own)
    assert {r.cluster for r in kmeans_groups(pts, ["cls"], k=1).collect()} == {r[0] for r in rows}


def test_kmeans_reports_an_early_stop(spark, monkeypatch):
    rows = [(i, 0, float(i * i % 97), float(i % 13)) for i in range(90)]
    pts = spark.createDataFrame(rows, "_pid long, cls int, lat double, lon double")
    assert kmeans.MAX_ITER == 300
    assert not any(r.converged for r in kmeans_groups(pts, ["cls"], k=5, max_iter=1).collect())


def test_densify_takes_only_fires_of_the_window(spark):
    pts = spark.createDataFrame([(46.0, 24.0, d(2024, 1, 2)), (47.0, 25.0, d(2024, 3, 1)), (48.0, 26.0, None)],
                                "latitude double, longitude double, acq_date date")
    s = D.densify(D.snap_points(pts), "2024-01-01", "2024-01-03").collect()
    assert {r.grid_cell for r in s} == {"46.0_24.0"} and sum(r.fire_count for r in s) == 1


def test_flagship_counts_a_place_and_day_once(spark):
    from hotspots.plans.feature_plan import DataPipeline
    grid = spark.createDataFrame([(46.0, 24.0, "UA1", 1.0)], "latitude double, longitude double, oblast_id string, pop_density double")
    fires = spark.createDataFrame([(1, 46.01, 24.0, d(2024, 1, 1)), (2, 46.01, 24.0, d(2024, 1, 1)), (3, 46.02, 24.0, d(2024, 1, 1))],
                                  "event_id long, latitude double, longitude double, acq_date date")
    out = DataPipeline().fit(grid).transform(fires, None, "2024-01-01", "2024-01-01").collect()
    assert [r.fire_count for r in out] == [2]


def test_pca_covers_every_training_row(spark):
    import __spark_entry__ as E
    from hotspots.plans import queries_model as M
    f = M._period(M._features(spark, SF), M.TR)
    assert E.queries()["m3_pca_projection"](spark, SF).count() == f.count()


def test_cell_day_count_is_a_splittable_join(spark):
    pts = spark.createDataFrame([("a", d(2024, 1, 1))] * 5 + [("b", None)] * 2, "grid_cell string, acq_date date")
    out = D.with_cell_day_count(pts)
    assert sorted((r.grid_cell, r.fire_count_cell) for r in out.collect()) == [("a", 5)] * 5 + [("b", 2)] * 2
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString()


def _crossings(lat, lon, rings):
    n = 0
    for ring in rings:
        for (y1, x1), (y2, x2) in zip(ring, ring[1:] + ring[:1]):
            if (y1 > lat) != (y2 > lat) and lon < x1 + (lat - y1) * (x2 - x1) / (y2 - y1):
                n += 1
    return n % 2 == 1


def test_polygons_with_holes_and_parts(spark):
    square = lambda y, x, s: [(float(a), float(b)) for a, b in ((y, x), (y, x + s), (y + s, x + s), (y + s, x))]
    polygons = {1: [square(0, 0, 10), square(3, 3, 4)], 2: [square(20, 0, 2), square(20, 30, 3)], 3: [square(-5, -5, 30)]}
    rings = spark.createDataFrame([(k, r) for k, rs in polygons.items() for r in rs],
                                  "poly_id long, ring array<struct<lat:double,lon:double>>")
    rng = np.random.default_rng(3)
    pts = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.uniform(-8, 36, (3000, 2)))]
    pts += [(9000, None, 1.0), (9001, 5.0, None)]
    df = spark.createDataFrame(pts, "pid long, latitude double, longitude double")
    want = {(p, k) for p, a, b in pts if a is not None and b is not None for k, rs in polygons.items() if _crossings(a, b, rs)}
    got = points_in_polygons(df, ring_edges(rings), keep_poly=True)
    assert {(r.pid, r.poly_id) for r in got.collect()} == want


def test_points_are_not_shuffled_for_the_spatial_join(spark):
    import __spark_entry__ as E
    df = E.queries()["j1_point_in_polygon"](spark, SF)
    df.write.format("noop").mode("overwrite").save()
    plan = df._jdf.queryExecution().executedPlan().toString()
    exchanges = [x for x in plan.splitlines() if "Exchange" in x and "event_id" in x]
    assert not exchanges


def _forest_input(spark, n=400):
    rng = np.random.default_rng(1)
    rows = [(i, float(a), float(b), float(c)) for i, (a, b, c) in enumerate(zip(rng.uniform(0, 9, n), rng.normal(size=n), rng.poisson(2, n)))]
    df = spark.createDataFrame(rows, "id long, x0 double, x1 double, y double")
    return VectorAssembler(inputCols=["x0", "x1"], outputCol="features").transform(df)


def test_forest_predictions_equal_the_definition(spark):
    vec = _forest_input(spark)
    m = fit_quantile_forest(vec, "y", num_trees=7)
    leaves = {}
    for r in m.leaves.collect():
        leaves[r.tree, r.leaf] = [(h.y, h.w) for h in r.hist]
    where = {r.id: r.leaf for r in m.forest.transform(vec).select("id", vector_to_array("leaf").alias("leaf")).collect()}
    got = {r.id: (r.q50, r.q95) for r in m.predict_many(vec, ["id"], [0.5, 0.95]).collect()}
    assert len(got) == 400
    for i, leaf in where.items():
        w = {}
        for tree, k in enumerate(leaf):
            for y, x in leaves[tree, int(k)]:
                w[y] = w.get(y, 0.0) + x
        assert math.isclose(sum(w.values()), 1.0)
        for q, value in zip((0.5, 0.95), got[i]):
            total, want = 0.0, None
            for y in sorted(w):
                total += w[y]
                if total >= q - 1e-9:
                    want = y
                    break
            assert value == want


def test_forest_does_not_depend_on_partitioning(spark):
    vec = _forest_input(spark)
    a, b = (fit_quantile_forest(vec.repartition(n), "y", num_trees=5).predict(vec, ["id"]).collect() for n in (1, 7))
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_forest_predictions_without_a_broadcast(spark, monkeypatch):
    from hotspots.operators import joins
    vec = _forest_input(spark)
    m = fit_quantile_forest(vec, "y", num_trees=5)
    whole = sorted(map(tuple, m.predict(vec, ["id"]).collect()))
    monkeypatch.setattr(joins.LIMITS, "broadcast_bytes", 1)
    assert sorted(map(tuple, m.predict(vec, ["id"]).collect())) == whole


def test_neighbour_search_makes_no_job_per_block(spark):
    rng = np.random.default_rng(2)
    c = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(300, 3)))], "cid long, v array<double>")
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(200, 3)))], "qid long, v array<double>")
    tracker = spark.sparkContext.statusTracker()

    def jobs(block_rows):
        group = f"nn-{block_rows}"
        spark.sparkContext.setJobGroup(group, group)
        n = len(nearest(q, c, "qid", "cid", "v", k=2, block_rows=block_rows).collect())
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        assert n == 400
        return len(tracker.getJobIdsForGroup(group))
    assert abs(jobs(200) - jobs(10)) <= 2


def test_block_pairs_meet_once(spark):
    q, c = spark.range(50).withColumnRenamed("id", "a"), spark.range(70).withColumnRenamed("id", "b")

    def pairs(x, y):
        return x[["a"]].merge(y[["b"]], how="cross")
    out = in_block_pairs(q, c, "a", "b", pairs, "a long, b long", block_rows=4)
    assert out.count() == 3500 and out.distinct().count() == 3500


def test_percentiles_equal_numpy(spark, monkeypatch):
    from hotspots.operators import quantiles
    monkeypatch.setattr(quantiles, "FEW", 60)
    rng = np.random.default_rng(4)
    data = {"n": rng.normal(size=5000), "ties": rng.integers(0, 5, 3000).astype(float), "one": np.array([3.0]),
            "two": np.array([1.0, 2.0]), "heavy": np.concatenate([np.zeros(4000), rng.exponential(size=1000)])}
    df = spark.createDataFrame([(k, float(x)) for k, v in data.items() for x in v] + [("n", None), ("none", None)], "feature string, x double")
    got = exact_percentiles(df, [0.25, 0.5, 0.75, 0.95])
    assert set(got) == set(data)
    for k, v in data.items():
        assert np.allclose(got[k], np.quantile(v, [0.25, 0.5, 0.75, 0.95]), atol=1e-12)


def test_population_percentile_gathers_no_column(spark):
    from hotspots.plans import queries_core as q
    from hotspots.sources import fixtures as X
    from hotspots.sources.tables import Tables
    t = Tables(spark, SF)
    values = [r.pop_density for r in q.merge_layers(X.grid(t), X.land_use(t)).collect() if r.pop_density is not None]
    out = q.q_a1p(spark, SF)
    assert "percentile" not in out._jdf.queryExecution().toString()
    assert out.columns == ["p95"] and math.isclose(out.first().p95, np.quantile(values, 0.95), abs_tol=1e-6)


def test_normal_quantile():
    ps = np.array([1e-9, 0.001, 0.02, 0.3, 0.5, 0.77, 0.98, 0.9999])
    for p, z in zip(ps, normal_quantile(ps)):
        assert math.isclose(0.5 * math.erfc(-z / math.sqrt(2)), p, rel_tol=1e-6)


def test_explanations_of_missing_values_and_wide_form(spark):
    from hotspots.operators.explain import fit_explainer
    rng = np.random.default_rng(5)
    train = spark.createDataFrame([(float(a), float(b)) for a, b in rng.uniform(0, 10, (300, 2))], "a double, b double")
    ex = fit_explainer(train, ["a", "b"])
    rows = spark.createDataFrame([("r", None, 9.0)], "row_id string, a double, b double")
    samples = ex.perturb(rows.fillna(ex.means), "row_id", 500, 1).collect()
    for f in ("a", "b"):
        inside = [(s[f], s[f"z_{f}"]) for s in samples if s["sample"]]
        # a drawn value lies in the bin that was drawn for it
        own = np.searchsorted(ex.quart[f], ex.means[f] if f == "a" else 9.0, "left")
        assert all((np.searchsorted(ex.quart[f], x, "left") == own) == (z == 1.0) for x, z in inside)
    out = ex.explain(rows, "row_id", lambda df, key: df.select(*key, F.col("b").alias("y_hat")), num_samples=500)
    w = wide(out, "row_id", 2)
    assert w.columns == ["row_id", "explanation_0", "explanation_1"]
    assert w.first().explanation_0.rule.startswith("b > ")


def test_cluster_without_a_shared_folder_is_an_error(spark):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()
        conf = {}
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(Session())


def test_entry_works_without_the_optional_operators(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path
    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "hotspots", tmp_path / "hotspots", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 70 and set(e.oracle_sql()) <= set(q); assert not any(x.startswith('op') for x in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)
