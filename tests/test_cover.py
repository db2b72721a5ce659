"""Quadtree cover of polygons against ray casting over all edges."""

import math

import numpy as np
import pytest

from hotspots.operators import spatial


def ring(lat, lon, radius, n, rng, wild=0.0):
    r = radius * (1 + wild * rng.uniform(-1, 1, n))
    a = np.linspace(0, 2 * math.pi, n, endpoint=False)
    return [(float(lat + k * math.sin(t)), float(lon + k * math.cos(t))) for k, t in zip(r, a)]


def edges_of(points):
    return np.array([(*p, *q) for p, q in zip(points, points[1:] + points[:1])])


def inside(edges, lat, lon):
    n = 0
    for y1, x1, y2, x2 in edges.tolist():
        if (y1 > lat) != (y2 > lat) and lon < x1 + (lat - y1) * (x2 - x1) / (y2 - y1):
            n += 1
    return n % 2 == 1


def by_cells(cells, edges, lat, lon):
    found = []
    for level, row, col, parity, own in cells:
        side = 2.0 ** level
        if math.floor(lat / side) == row and math.floor(lon / side) == col:
            found.append((parity + inside(edges[own], lat, lon)) % 2 == 1)
    assert len(found) <= 1
    return bool(found and found[0])


@pytest.mark.parametrize("seed", range(6))
def test_cells_decide_like_all_edges(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(3, 200))
    points = ring(rng.uniform(-60, 60), rng.uniform(-170, 170), rng.choice([0.01, 0.6, 9.0]), n, rng, rng.uniform(0, 0.8))
    edges = edges_of(points)
    cells = spatial.polygon_cells(edges, 4)
    low, high = edges.reshape(-1, 2).min(0), edges.reshape(-1, 2).max(0)
    tries = [tuple(rng.uniform(low - 0.1, high + 0.1)) for _ in range(400)] + points[:50]
    tries += [(p[0], float(x)) for p, x in zip(points, rng.uniform(low[1], high[1], n))]  # on the latitude of a vertex
    for lat, lon in tries:
        assert by_cells(cells, edges, lat, lon) == inside(edges, lat, lon), (lat, lon)


def test_level_edges_and_corners_on_cell_sides():
    rng = np.random.default_rng(0)
    for points in ([(0.0, 0.0), (0.0, 4.0), (3.0, 5.0), (5.0, 1.0)], [(0.0, 0.0), (0.0, 8.0), (4.0, 8.0), (4.0, 0.0)],
                   [(-2.0, -2.0), (-2.0, 2.0), (0.0, 2.0), (0.0, 1.0), (1.0, 1.0), (1.0, 2.0), (2.0, 2.0), (2.0, -2.0)]):
        edges = edges_of(points)
        for leaf in (1, 2, 6):
            cells = spatial.polygon_cells(edges, leaf)
            tries = [(float(a), float(b)) for a in np.arange(-3, 9, 0.5) for b in np.arange(-3, 9, 0.5)]
            tries += [tuple(t) for t in rng.uniform(-3, 9, (200, 2))]
            for lat, lon in tries:
                assert by_cells(cells, edges, lat, lon) == inside(edges, lat, lon), (points, leaf, lat, lon)


def test_a_country_beside_villages_keeps_a_small_cover():
    rng = np.random.default_rng(1)
    country = edges_of(ring(48, 30, 5.0, 400, rng, 0.05))
    village = edges_of(ring(48, 30, 0.01, 8, rng))
    for edges in (country, village):
        cells = spatial.polygon_cells(edges)
        boundary = [c for c in cells if len(c[4])]
        length = np.hypot(edges[:, 0] - edges[:, 2], edges[:, 1] - edges[:, 3])
        # a cell on the boundary holds several of its edges, or the end of one
        assert len(boundary) <= 4 * len(edges) and len(cells) <= 16 * len(edges)
        assert len(boundary) <= 8 * length.sum() / min(2.0 ** c[0] for c in boundary)
        assert max(len(c[4]) for c in cells) <= 8 * spatial.LEAF_EDGES
    assert len(spatial.polygon_cells(village)) < 200


def test_points_in_polygons_of_very_different_sizes(spark):
    rng = np.random.default_rng(3)
    shapes = {"country": ring(48, 30, 4.0, 150, rng, 0.1), "lake": ring(48, 30, 1.0, 40, rng, 0.2),
              **{f"v{i}": ring(46 + i * 0.2, 28 + i * 0.1, 0.02, 7, rng) for i in range(10)}}
    rows = [(name, [{"lat": a, "lon": b} for a, b in pts]) for name, pts in shapes.items()]
    rings = spark.createDataFrame(rows, "poly_id string, ring array<struct<lat:double,lon:double>>")
    where = [(i, float(a), float(b)) for i, (a, b) in enumerate(np.concatenate([
        rng.uniform((43, 25), (53, 35), (1500, 2)), [(46 + i % 10 * 0.2 + 0.005, 28 + i % 10 * 0.1) for i in range(40)]]))]
    points = spark.createDataFrame([*where, (9999, None, 3.0)], "id long, latitude double, longitude double").repartition(4)
    got = {(r.id, r.poly_id) for r in spatial.points_in_polygons(points, spatial.ring_edges(rings), keep_poly=True).collect()}
    assert got == {(i, name) for i, a, b in where for name, pts in shapes.items() if inside(edges_of(pts), a, b)}
    assert spatial.points_in_polygons(points, spatial.ring_edges(rings.limit(0))).collect() == []
