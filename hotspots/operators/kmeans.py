"""Per-group k-means on (lat, lon) for all groups at once.

A group (one day and one class of fires; a NULL class is a group like any
other) is clustered only when it has more than ``k`` points and k > 1;
otherwise every point is its own cluster.

Lloyd iterations run as Spark jobs over all groups together:
  assign  - points join their group's centre array (at most k entries, one row
            per group; broadcast after a size check, so points stay in place)
            and pick the nearest centre in one compiled expression (above
            ``FLAT_CENTRES`` centres with a higher-order function);
  update  - new centres are per-(group, cluster) means, a partially aggregated
            groupBy, folded back into one centre array per group.
A group stops when its centres move by no more than ``tol`` times the mean
variance of its coordinates (summed squared shift), as single-machine k-means
does; only the groups that still move are assigned again. ``max_iter`` bounds
the loop, and ``converged`` tells whether a group stopped before it. What an
iteration reads is only the group's number and the position of every point.

A group with a third of all points is spread over many tasks (AQE splits the
skewed join side; the centre row is replicated). Initial centres are the k
points with the smallest hash per group, chosen by a salted two-step top-k
whose salt count grows with the group, so no task sorts more than about 100k
points of one group. Lineage is cut with a reliable checkpoint of the (small)
centre table after every iteration.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hotspots.config import LIMITS

ROWS_PER_SALT = 100_000
MAX_ITER = 300
TOLERANCE = 1e-4
FLAT_CENTRES = 64
# the number of a group (its columns are compared as a struct, whose NULL fields are equal)
G = "_group"


def _topk_by_hash(points: DataFrame, k: int, seed: int) -> DataFrame:
    """k points with the smallest seeded hash per group. Stage one ranks inside
    (group, salt) buckets of about ROWS_PER_SALT rows (the salt count grows with
    the group, from the group sizes), stage two ranks the k x salts survivors."""
    h = F.xxhash64(F.lit(seed), "_pid")
    salts = F.greatest(F.lit(1), F.ceil(F.col("_n") / F.lit(ROWS_PER_SALT))).cast("bigint")
    p = points.withColumn("_h", h).withColumn("_salt", F.pmod(F.col("_h"), salts))
    w1 = Window.partitionBy(G, "_salt").orderBy("_h", "_pid")
    stage1 = p.withColumn("_r", F.row_number().over(w1)).filter(F.col("_r") <= k)
    w2 = Window.partitionBy(G).orderBy("_h", "_pid")
    return stage1.withColumn("_r", F.row_number().over(w2)).filter(F.col("_r") <= k)


def _centre_arrays(c: DataFrame) -> DataFrame:
    return c.groupBy(G).agg(F.sort_array(F.collect_list(
        F.struct(F.col("cluster").alias("cluster"), F.col("clat").alias("clat"),
                 F.col("clon").alias("clon")))).alias("_centres"))


def _assign(points: DataFrame, centres: DataFrame, small: bool, k: int) -> DataFrame:
    # one row per group with at most k centres: broadcast where the groups were
    # counted to be few, so the points never move between iterations; above the
    # bound a shuffle join
    lat, lon = F.col("lat"), F.col("lon")
    if k <= FLAT_CENTRES:
        # centres as plain columns by cluster: little generated code per point, which the
        # JVM compiles. least leaves out NULL and takes NaN last; the first centre at the
        # least distance is the nearest
        flat = [F.get("_centres", F.lit(i)) for i in range(k)]
        c = centres.select(G, *[flat[i][x].alias(f"_{x}{i}") for i in range(k) for x in ("clat", "clon")])
        j = points.join(F.broadcast(c) if small else c, G)
        d = [(lat - F.col(f"_clat{i}")) * (lat - F.col(f"_clat{i}")) + (lon - F.col(f"_clon{i}")) * (lon - F.col(f"_clon{i}"))
             for i in range(k)]
        j = j.select(*points.columns, *[d[i].alias(f"_d{i}") for i in range(k)])
        least = F.least(F.lit(float("inf")), *[f"_d{i}" for i in range(k)])
        j = j.select(*points.columns, *[f"_d{i}" for i in range(k)], least.alias("_d"))
        best = F.when(F.col("_d") == F.lit(float("inf")), -1)
        for i in range(k):
            best = best.when(F.col(f"_d{i}") == F.col("_d"), i)
        return j.select(*points.columns, best.cast("bigint").alias("cluster"))
    c = centres.select(G, "_centres")
    j = points.join(F.broadcast(c) if small else c, G)

    def distance(c):
        return (lat - c["clat"]) * (lat - c["clat"]) + (lon - c["clon"]) * (lon - c["clon"])

    init = F.struct(F.lit(float("inf")).alias("d"), F.lit(-1).cast("bigint").alias("cluster"))

    def step(acc, c):
        d = distance(c)
        better = d < acc["d"]
        return F.struct(F.when(better, d).otherwise(acc["d"]).alias("d"),
                        F.when(better, c["cluster"]).otherwise(acc["cluster"]).alias("cluster"))
    return j.withColumn("cluster", F.aggregate("_centres", init, step)["cluster"]).drop("_centres")


def kmeans_groups(points: DataFrame, group: list[str], k: int, max_iter: int = MAX_ITER,
                  seed: int = 0, tol: float = TOLERANCE) -> DataFrame:
    """points: group columns + _pid (unique) + lat + lon. Returns points with
    ``cluster`` (0..k-1 for clustered groups; 0.. per point in groups of at most
    k points, and the point's own id for k <= 1) and ``converged``."""
    columns = [*points.columns, "cluster", "converged"]
    if k <= 1:
        return (points.withColumn("cluster", F.col("_pid").cast("bigint"))
                .withColumn("converged", F.lit(True)).select(*columns))
    keyed = points.withColumn("_key", F.struct(*group))
    spread = (F.var_pop("lat") + F.var_pop("lon")) / 2
    # one row per group; its number stands for the struct in all that follows
    sizes = (keyed.groupBy("_key").agg(F.count(F.lit(1)).alias("_n"), (spread * tol).alias("_tol"))
             .withColumn(G, F.monotonically_increasing_id()).checkpoint(eager=True))
    clustered = sizes.filter(F.col("_n") > k)
    few = clustered.count() * (64 + 32 * k) <= LIMITS.broadcast_bytes
    p = keyed.join(sizes.drop("_tol"), "_key").drop("_key").persist(StorageLevel.MEMORY_AND_DISK)
    small, big = p.filter(F.col("_n") <= k), p.filter(F.col("_n") > k)
    ws = Window.partitionBy(G).orderBy("_pid")  # at most k rows
    small = (small.withColumn("cluster", (F.row_number().over(ws) - 1).cast("bigint"))
             .withColumn("converged", F.lit(True)))

    first = _topk_by_hash(big, k, seed).select(
        G, (F.col("_r") - 1).cast("bigint").alias("cluster"),
        F.col("lat").alias("clat"), F.col("lon").alias("clon"))
    centres = (_centre_arrays(first).join(clustered.select(G, "_tol"), G)
               .withColumn("converged", F.lit(False)).checkpoint(eager=True))
    spots = big.select(G, "lat", "lon")
    for _ in range(max_iter):
        moving = centres.filter(~F.col("converged"))
        if moving.isEmpty():
            break
        new = _assign(spots, moving, few, k).groupBy(G, "cluster").agg(
            F.avg("lat").alias("nlat"), F.avg("lon").alias("nlon"))
        # the means are folded into a row per group before they meet the old centres: a
        # join on the cluster would put its whole expression, expanded, into a filter
        # below the aggregation
        folded = new.groupBy(G).agg(F.map_from_entries(F.collect_list(
            F.struct("cluster", F.struct("nlat", "nlon").alias("to")))).alias("_new"))
        # clusters that lost every point keep their previous centre
        to = lambda c, x: F.coalesce(F.try_element_at("_new", c["cluster"])[f"n{x}"], c[f"c{x}"]).alias(f"c{x}")
        moved = moving.join(folded, G, "left").withColumn("_next", F.transform(
            "_centres", lambda c: F.struct(c["cluster"].alias("cluster"), to(c, "lat"), to(c, "lon"))))
        step = F.zip_with("_centres", "_next", lambda a, b: F.coalesce(
            (b["clat"] - a["clat"]) ** 2 + (b["clon"] - a["clon"]) ** 2, F.lit(0.0)))
        shift = F.aggregate(step, F.lit(0.0), lambda n, x: n + x)
        moved = moved.select(G, F.col("_next").alias("_centres"), "_tol", (shift <= F.col("_tol")).alias("converged"))
        centres = centres.filter("converged").unionByName(moved)
        # a union keeps the partitions of both sides: few rows stay in one
        centres = (centres.coalesce(1) if few else centres).checkpoint(eager=True)
    done = centres.select(G, "converged")
    assigned = _assign(big, centres, few, k).join(F.broadcast(done) if few else done, G)
    out = assigned.select(*columns).unionByName(small.select(*columns)).checkpoint(eager=True)
    p.unpersist()
    return out
