"""Pruned block search against comparing everything."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from hotspots.config import LIMITS
from hotspots.operators import neighbors
from hotspots.operators.imputer import KNNImputerModel, fit_knn_imputer


def clustered(rng, n, d, clusters=12, missing=0.0):
    centres = rng.normal(0, 10, (clusters, d))
    x = centres[rng.integers(0, clusters, n)] + rng.normal(0, 0.5, (n, d))
    x[rng.random((n, d)) < missing] = np.nan
    return x


def frame(spark, x, name, **more):
    rows = [(i, [float(v) for v in r], *[int(c[i]) for c in more.values()]) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, f"{name} long, v array<double>" + "".join(f", {k} long" for k in more)).repartition(5)


def brute(q, c, group, k, exclude=False):
    d = np.round(neighbors.nan_distances(q, c), 9)
    out = set()
    for i in range(len(q)):
        for g in np.unique(group):
            own = [(d[i, j], j) for j in np.flatnonzero(group == g) if not np.isnan(d[i, j]) and not (exclude and i == j)]
            out |= {(i, int(g), j, r + 1) for r, (_, j) in enumerate(sorted(own)[:k])}
    return out


def found(df, group="g"):
    return {(r.qid, r[group], r.cid, r["rank"]) for r in df.collect()}


@pytest.mark.parametrize("k,missing", [(1, 0.0), (3, 0.0), (2, 0.15)])
def test_pruned_search_equals_brute_force(spark, monkeypatch, k, missing):
    monkeypatch.setattr(neighbors, "CHUNK_ROWS", 37)
    rng = np.random.default_rng(k)
    c, q = clustered(rng, 900, 5, missing=missing), clustered(rng, 150, 5, missing=missing)
    c[100:300] = c[0]  # many equal rows: ties
    group = rng.integers(0, 3, len(c))
    index = neighbors.block_index(frame(spark, c, "cid", g=group), "cid", "v", "g", block_rows=20)
    got = found(neighbors.nearest(frame(spark, q, "qid"), None, "qid", "cid", "v", group="g", k=k, index=index))
    assert got == brute(q, c, group, k)
    assert found(neighbors.nearest(frame(spark, q, "qid"), frame(spark, c, "cid", g=group), "qid", "cid", "v", group="g", k=k)) == got


def test_pruning_compares_less_than_a_third(spark):
    rng = np.random.default_rng(5)
    x = clustered(rng, 4000, 8)
    group = rng.integers(0, 2, len(x))
    index = neighbors.block_index(frame(spark, x, "cid", g=group), "cid", "v", "g", block_rows=50)
    got = found(neighbors.nearest(frame(spark, x, "qid"), None, "qid", "cid", "v", group="g", exclude_self=True, index=index))
    assert got == brute(x, x, group, 1, exclude=True)
    assert 0 < index.comparisons() < len(x) ** 2 / 3


def test_bounds_never_exceed_a_distance():
    rng = np.random.default_rng(8)
    for missing in (0.0, 0.3):
        x, q = clustered(rng, 60, 4, missing=missing), clustered(rng, 40, 4, missing=missing)
        pivots = clustered(rng, 3, 4)
        order = np.argsort(neighbors._patterns(x), kind="stable")
        x = x[order]
        edge = np.flatnonzero(np.concatenate([[True], np.diff(neighbors._patterns(x)) != 0, [True]]))
        spans = [(a, b) for a, b in zip(edge, edge[1:])]
        to = neighbors.nan_distances(x, pivots)
        of = lambda f, m: np.array([f(m[a:b], axis=0) for a, b in spans])
        blocks = neighbors.Blocks(np.arange(len(spans)), np.array([~np.isnan(x[a]) for a, _ in spans]), np.zeros(len(spans)),
                                  np.array([b - a for a, b in spans]), of(np.min, x), of(np.max, x), of(np.min, to), of(np.max, to), pivots)
        bound = blocks.bounds(q)
        real = neighbors.nan_distances(q, x)
        for j, (a, b) in enumerate(spans):
            least = np.where(np.isnan(real[:, a:b]), np.inf, real[:, a:b]).min(1)
            assert (bound[:, j] <= least + 1e-9).all()


def test_without_a_block_table_everything_is_compared(spark, monkeypatch):
    monkeypatch.setattr(LIMITS, "broadcast_bytes", 100)
    rng = np.random.default_rng(2)
    c, q = clustered(rng, 80, 3), clustered(rng, 20, 3)
    group = np.arange(80) % 2
    got = found(neighbors.nearest(frame(spark, q, "qid"), frame(spark, c, "cid", g=group), "qid", "cid", "v", group="g", k=2))
    assert got == brute(q, c, group, 2)


def test_no_candidates_and_wide_vectors(spark):
    q = frame(spark, np.ones((3, 70)), "qid")
    c = frame(spark, np.arange(210.0).reshape(3, 70), "cid")
    assert {r.cid for r in neighbors.nearest(q, c, "qid", "cid", "v").collect()} == {0}
    assert neighbors.nearest(q, c.limit(0), "qid", "cid", "v").collect() == []
    with pytest.raises(ValueError):
        neighbors.block_index(c.withColumn("v", F.transform("v", lambda x: F.lit(float("nan")))), "cid", "v")


def test_imputer_prunes_and_equals_brute_force(spark):
    rng = np.random.default_rng(11)
    x = clustered(rng, 1500, 4, missing=0.1)
    cols = list("abcd")
    rows = [(f"k{i:05d}", *[None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "key string, a double, b double, c double, d double").repartition(4)
    model = fit_knn_imputer(df, cols, ["key"], k=3)
    from hotspots.operators.neighbors import BlockIndex
    small = BlockIndex(model.index.rows.select("_cid", "_grp", "_vec"), block_rows=25)
    model = KNNImputerModel(cols, small, model.means, 3)
    got = {r.key: [r[c] for c in cols] for r in model.transform(df, ["key"]).collect()}
    d = np.round(neighbors.nan_distances(x, x), 9)
    lacking = 0
    for i in range(len(x)):
        for f in np.flatnonzero(np.isnan(x[i])):
            own = sorted((d[i, j], j) for j in np.flatnonzero(~np.isnan(x[:, f])) if not np.isnan(d[i, j]))[:3]
            want = np.mean([x[j, f] for _, j in own]) if own else model.means[cols[f]]
            assert got[f"k{i:05d}"][f] == pytest.approx(want)
            lacking += 1
    receivers = len({tuple(r) for r in np.nan_to_num(x[np.isnan(x).any(1)], nan=1e9)})
    assert lacking and 0 < small.comparisons() < receivers * len(x) / 3


def test_k_nearest_equals_measuring_every_pair():
    rng = np.random.default_rng(4)
    for missing, scale in ((0.0, 1.0), (0.0, 1e6), (0.1, 1.0)):
        c, q = clustered(rng, 300, 6, missing=missing) * scale, clustered(rng, 40, 6, missing=missing) * scale
        c[50:120] = c[0]
        q[3], q[4] = c[0], c[0] + 1e-10
        ids = rng.permutation(300)
        skip = np.arange(40)
        far = np.where(skip[:, None] == ids[None, :], np.inf, np.round(neighbors.nan_distances(q, c), 9))
        for k in (1, 4, 1000):
            want = [(i, j, far[i, j]) for i in range(40)
                    for j in sorted((j for j in range(300) if np.isfinite(far[i, j])), key=lambda j: (far[i, j], ids[j]))[:k]]
            assert list(zip(*neighbors.k_nearest(q, c, k, 9, ids, skip))) == want


def test_visits_are_handed_on_in_bounded_pieces(spark, monkeypatch):
    """Every block is visited by every query: the pieces stay small, and beyond
    the bound all is compared in large blocks instead."""
    import pandas as pd
    from types import SimpleNamespace
    rng = np.random.default_rng(9)
    x = rng.normal(0, 1, (600, 40))  # no clusters: the bounds prune next to nothing
    group = rng.integers(0, 2, len(x))
    index = neighbors.block_index(frame(spark, x, "cid", g=group), "cid", "v", "g", block_rows=10)
    monkeypatch.setattr(neighbors, "PIECE_BYTES", 100 * (32 + 8 * 40))
    run = neighbors._visits(SimpleNamespace(value=index.blocks), 1, lambda b: (np.arange(2), b.group[:, None] == np.arange(2)),
                            lambda q, t: np.ones((len(q), len(t)), bool), True)
    batch = pd.DataFrame({"_qid": np.arange(600), "_qvec": list(x), "_kth": [None] * 600})
    pieces = [len(p) for p in run(iter([batch]))]
    assert max(pieces) <= 100 and sum(pieces) > 600 * 50
    want = brute(x, x, group, 1, exclude=True)
    for least, whole in ((1 << 30, False), (0, True)):
        monkeypatch.setattr(neighbors, "LEAST_VISIT_BYTES", least)
        got = neighbors.nearest(frame(spark, x, "qid"), None, "qid", "cid", "v", group="g", exclude_self=True, index=index)
        assert found(got) == want
        assert bool(index.whole) == whole
