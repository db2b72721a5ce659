"""Point in polygon (J1): equi-join on quadtree cells, parity decided in the row.

The even-odd rule: a ray to the east crosses an edge when the edge straddles the
point's latitude and the crossing lies east of the point; an odd number of
crossings means inside. Each polygon is covered by cells whose sides are powers
of two (so that a point's cell is exact). In a cell, an edge that spans all its
latitudes and lies east of it crosses every ray, and counts as one fixed parity;
edges west of it or beyond its latitudes never do; the others are kept. A cell
near more than ``LEAF_EDGES`` edges is split into quarters of its side; one near
no edge is inside as a whole, a single row without edges, or outside and
dropped. So the cells follow the boundary of their own polygon, whatever the
size of the others, and the interior is a few large ones.

Points join the cells of every side in use (a few) by an equi-join; the cover is
broadcast after a size check, so the points are not shuffled, and no (point,
edge) row exists.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hotspots.operators.joins import broadcast_if_small

#: Edges a cell may keep, how often a cell's side is halved in a split, and the smallest side.
LEAF_EDGES, SPLIT_LEVELS, LEAST_LEVEL = 6, 2, -20
#: Crossings are computed in doubles: an edge this near to a cell counts as one of its own.
_MARGIN = 1e-9


def ring_edges(rings: DataFrame, id_col: str = "poly_id", ring_col: str = "ring") -> DataFrame:
    """(poly_id, ring array<struct<lat,lon>>) -> (poly_id, y1, x1, y2, x2).

    The ring may be open or closed; zero-length edges (a closing duplicate
    vertex) are dropped.
    """
    n = F.size(ring_col)
    exploded = rings.select(id_col, ring_col, F.posexplode(ring_col).alias("_i", "_v"))
    nxt = F.element_at(F.col(ring_col), ((F.col("_i") + 1) % n + 1).cast("int"))
    edges = exploded.select(id_col, F.col("_v.lat").alias("y1"), F.col("_v.lon").alias("x1"),
                            nxt["lat"].alias("y2"), nxt["lon"].alias("x2"))
    return edges.filter((F.col("y1") != F.col("y2")) | (F.col("x1") != F.col("x2")))


def cover(edges: DataFrame, leaf_edges: int = LEAF_EDGES) -> DataFrame:
    """(poly_id, _level, _row, _col, _parity, _edges): the cells (of side
    2 ** _level) that are not wholly outside their polygon, one task per polygon."""
    kind = edges.schema["poly_id"].dataType.simpleString()

    def of_polygon(pdf: pd.DataFrame) -> pd.DataFrame:
        corners = pdf[["y1", "x1", "y2", "x2"]].to_numpy(np.float64)
        cells = polygon_cells(corners, leaf_edges)
        return pd.DataFrame({
            "poly_id": [pdf["poly_id"].iloc[0]] * len(cells), "_level": [c[0] for c in cells], "_row": [c[1] for c in cells],
            "_col": [c[2] for c in cells], "_parity": [c[3] for c in cells],
            "_edges": [[dict(zip(("y1", "x1", "y2", "x2"), e)) for e in corners[c[4]].tolist()] for c in cells]})

    return edges.select("poly_id", "y1", "x1", "y2", "x2").groupBy("poly_id").applyInPandas(
        of_polygon, f"poly_id {kind}, _level int, _row long, _col long, _parity int, "
                    "_edges array<struct<y1:double,x1:double,y2:double,x2:double>>")


def polygon_cells(corners: np.ndarray, leaf_edges: int = LEAF_EDGES) -> list[tuple[int, int, int, int, np.ndarray]]:
    """(level, row, col, parity, numbers of the kept edges) of one polygon, whose
    edges are the rows (y1, x1, y2, x2)."""
    # a level edge straddles no latitude
    whole = np.flatnonzero(np.isfinite(corners).all(1) & (corners[:, 0] != corners[:, 2]))
    if not len(whole):
        return []
    y, x = corners[:, [0, 2]], corners[:, [1, 3]]
    south, north, west, east = y.min(1), y.max(1), x.min(1), x.max(1)
    bottom, start, end, finish = south[whole].min(), west[whole].min(), north[whole].max(), east[whole].max()
    top = int(np.ceil(np.log2(max(end - bottom, finish - start, 2.0 ** LEAST_LEVEL))))
    side = 2.0 ** top
    open_cells = [(top, row, col, 0, whole)
                  for row in range(int(np.floor(bottom / side)), int(np.floor(end / side)) + 1)
                  for col in range(int(np.floor(start / side)), int(np.floor(finish / side)) + 1)]
    done = []
    n = 1 << SPLIT_LEVELS
    while open_cells:
        level, row, col, parity, own = open_cells.pop()
        side = 2.0 ** level
        low, left = row * side, col * side
        own = own[(south[own] < low + side) & (north[own] > low) & (east[own] >= left - _MARGIN)]
        near, beyond = _sides(corners[own], low, left, side)
        own, beyond = own[near | beyond], beyond[near | beyond]
        fixed = beyond & (south[own] <= low) & (north[own] >= low + side)
        parity ^= int(fixed.sum()) & 1
        local = int((~beyond).sum())
        own = own[~fixed]
        if not local:
            # no edge comes near: all of the cell is on one side, found at its lowest latitude
            parity ^= int(((south[own] <= low) & (north[own] > low)).sum()) & 1
            if parity:
                done.append((level, row, col, parity, whole[:0]))
        elif (local <= leaf_edges and (len(own) <= 8 * leaf_edges or top - level >= 6 * SPLIT_LEVELS)
              or level - SPLIT_LEVELS < LEAST_LEVEL):
            done.append((level, row, col, parity, own))
        else:
            open_cells += [(level - SPLIT_LEVELS, row * n + i, col * n + j, parity, own) for i in range(n) for j in range(n)]
    return done


def _sides(edges: np.ndarray, low: float, left: float, side: float) -> tuple[np.ndarray, np.ndarray]:
    """Which edges come near a cell, and which pass east of it; the others pass
    west of it. All of them reach its latitudes."""
    y1, x1, y2, x2 = edges.T
    dy, dx = y2 - y1, x2 - x1
    slack = _MARGIN * (np.abs(dy) + np.abs(dx))
    turn = np.stack([dx * (low + i * side - y1) - dy * (left + j * side - x1) for i in (0, 1) for j in (0, 1)])
    near = ~((turn > slack).all(0) | (turn < -slack).all(0))
    near &= (np.minimum(x1, x2) <= left + side + _MARGIN) & (np.maximum(x1, x2) >= left - _MARGIN)
    middle = (np.maximum(np.minimum(y1, y2), low) + np.minimum(np.maximum(y1, y2), low + side)) / 2
    return near, ~near & (x1 + (middle - y1) * dx / dy > left + side / 2)


def points_in_polygons(points: DataFrame, edges: DataFrame, lat_col: str = "latitude",
                       lon_col: str = "longitude", id_col: str = "poly_id", keep_poly: bool = False) -> DataFrame:
    """Inner spatial join: one output row per (point, containing polygon); a
    point inside two polygons appears twice. Points without a position are in no
    polygon."""
    edges = edges.withColumnRenamed(id_col, "poly_id")
    cells = cover(edges).withColumnRenamed("poly_id", "_poly").checkpoint()
    levels = sorted(r[0] for r in cells.select("_level").distinct().collect())  # at most one per power of two
    lat, lon = F.col(lat_col), F.col(lon_col)

    def place(level: int):
        scale = F.lit(2.0 ** -level)  # exact, as is the product
        return F.struct(F.lit(level).alias("_level"), F.floor(lat * scale).alias("_row"), F.floor(lon * scale).alias("_col"))

    pts = points.withColumn("_at", F.explode(F.array(*map(place, levels or [0])))).select(*points.columns, "_at.*")

    def crossed(n, e):
        straddles = (e["y1"] > lat) != (e["y2"] > lat)
        at = e["x1"] + F.try_divide((lat - e["y1"]) * (e["x2"] - e["x1"]), e["y2"] - e["y1"])
        return n + F.when(straddles & (lon < at), 1).otherwise(0)

    inside = F.aggregate("_edges", F.col("_parity"), crossed) % 2 == 1
    hit = pts.join(broadcast_if_small(cells), ["_level", "_row", "_col"]).filter(inside)
    return hit.select(*points.columns, *([F.col("_poly").alias(id_col)] if keep_poly else []))
