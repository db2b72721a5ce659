"""Connected components of an edge table, by alternating stars.

Each round joins every edge with the smallest neighbour of its ends and
reconnects to it, until the edges form stars around the smallest vertex of
each component. Smallest neighbours are partially aggregated before their
shuffle. They are written to the checkpoint folder before they are joined back:
with an exchange right under both sides of the join, adaptive execution splits
the edges of a hot vertex over tasks. Every half round is written there too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _distinct(pairs: DataFrame) -> DataFrame:
    return pairs.filter(F.col("u") != F.col("v")).distinct()


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step; edges hold u > v."""
    if large:
        near = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = edges
    least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")).checkpoint()
    joined = near.join(least, "u")
    if large:
        moved = joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            least.select("u", F.col("m").alias("v")))
    return _distinct(moved.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))


def _state(edges: DataFrame):
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def stars(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(u, v): every vertex that is not the smallest of its component, and that
    smallest vertex. Vertices without an edge do not appear."""
    now = _distinct(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))).checkpoint()
    state = _state(now)
    while state[0]:
        now = _star(_star(now, True).checkpoint(), False).checkpoint()
        before, state = state, _state(now)
        if state == before:
            break
    return now
