"""Exact nearest neighbours with pruned blocks (M9, J11, M2 helper).

Candidates are cut into blocks of near points: sorted by their pattern of
missing coordinates, their group, the pivot (one of a few reference points)
nearest to them and their distance to it, ``BLOCK_ROWS`` rows a block. A block
is summed up by the box around it and by its interval of distances to every
pivot. Both bound the distance of any query to the block from below:

* the box, per missing pattern: only coordinates that the query and the block's
  pattern share count, scaled as the distance itself is;
* the triangle inequality over the pivots, where nothing is missing.

A query first visits, for each group, the block that may hold its nearest
candidates; the k-th distance found there then drops every block whose bound is
above it. Only what is left is visited in a second round, so the result is that
of comparing everything. Visits are rows (query, block); the queries of a block
are split into chunks of ``CHUNK_ROWS``, so that neither a hot block nor a hot
query region is one task's work. No (query, candidate) pair is ever a row; a
task returns the best k per query and group, and a final ranking picks the
overall best.

The second round's visits are counted before any is made. Where the bounds prune
little (many coordinates without clusters) they would be copies of the queries,
one for almost every block; if that is more than the copies that comparing all
large query blocks with all large candidate blocks needs, and above
``LEAST_VISIT_BYTES``, the latter is done. A batch of visits is handed on in
pieces of ``PIECE_BYTES``, so a task's memory follows neither the number of
blocks nor the width of a vector.

What reaches the driver and is broadcast is the block table, at most
``MOST_BLOCKS`` rows besides one for every (pattern, group, partition); blocks
grow with the candidates beyond that. If there are too many groups for it (see
``LIMITS``), every block is visited instead.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hotspots.config import LIMITS

PIVOTS = 8
BLOCK_ROWS = 512
CHUNK_ROWS = 4096
MOST_BLOCKS = 1 << 16
#: Query rows of a block where everything is compared, four times as many candidates.
TILE_ROWS = 8192
#: Visits up to this size are made in any case; and what one piece of them holds.
LEAST_VISIT_BYTES, PIECE_BYTES = 256 << 20, 8 << 20
#: Entries of one (query, block) or (query, candidate) matrix.
MATRIX_ENTRIES = 1 << 20
#: Bounds may be off by rounding; distances are compared after rounding, too.
_SLACK = 1e-8


def nan_distances(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """sqrt(d / n * sum of squared differences over the n coordinates that both
    rows have) between the rows of ``q`` and ``c``; NaN where they share none."""
    d = q.shape[1]
    total = np.zeros((len(q), len(c)))
    if not (np.isnan(q).any() or np.isnan(c).any()):
        for i in range(d):
            diff = q[:, i, None] - c[None, :, i]
            total += diff * diff
        return np.sqrt(total)
    have_q, have_c = ~np.isnan(q), ~np.isnan(c)
    shared = have_q.astype(np.float64) @ have_c.T.astype(np.float64)
    q, c = np.where(have_q, q, 0.0), np.where(have_c, c, 0.0)
    for i in range(d):
        diff = np.where(have_q[:, i, None] & have_c[None, :, i], q[:, i, None] - c[None, :, i], 0.0)
        total += diff * diff
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(shared > 0, np.sqrt(total * d / shared), np.nan)


def k_nearest(q: np.ndarray, c: np.ndarray, k: int, round_to: int, ids: np.ndarray,
              skip: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of ``q``, row of ``c``, distance) of the k nearest per query, by rounded
    distance, then by ``ids``; ``skip`` holds the id that a query leaves out.

    The matrix product gives every squared distance up to a rounding error that
    is bounded by the norms; only pairs within that error (and the rounding of
    distances) of the k-th are measured, coordinate by coordinate."""
    rows, cols, dists = [], [], []
    with np.errstate(over="ignore", invalid="ignore"):
        q2, c2 = (q * q).sum(1), (c * c).sum(1)
    quick = bool(np.isfinite(q2).all() and np.isfinite(c2).all())
    step = max(1, MATRIX_ENTRIES // max(1, len(c)))
    for s in range(0, len(q) if len(c) else 0, step):
        part = q[s:s + step]
        same = None if skip is None else skip[s:s + step, None] == ids[None, :]
        if quick:
            error = 4 * (q.shape[1] + 2) * np.finfo(np.float64).eps * (q2[s:s + step] + c2.max())
            near = (q2[s:s + step, None] + c2[None, :]) - 2 * (part @ c.T)
            if same is not None:
                near[same] = np.inf
            kth = near.min(1) if k == 1 else np.partition(near, min(k, len(c)) - 1, axis=1)[:, min(k, len(c)) - 1]
            reach = np.sqrt(np.maximum(kth + error, 0.0)) * (1 + 1e-12) + 2 * 10.0 ** -round_to
            i, j = np.nonzero((near <= (reach * reach + error)[:, None]) & np.isfinite(near))
            total = np.zeros(len(i))
            for d in range(q.shape[1]):
                diff = part[i, d] - c[j, d]
                total += diff * diff
            dist = np.round(np.sqrt(total), round_to)
        else:
            far = np.round(nan_distances(part, c), round_to)
            if same is not None:
                far = np.where(same, np.inf, far)
            i, j = np.nonzero(np.isfinite(far))
            dist = far[i, j]
        order = np.lexsort((ids[j], dist, i))
        i, j, dist = i[order], j[order], dist[order]
        place = np.arange(len(i)) - np.searchsorted(i, i, "left")
        rows.append(s + i[place < k])
        cols.append(j[place < k])
        dists.append(dist[place < k])
    join = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
    return join(rows, np.int64), join(cols, np.int64), join(dists, np.float64)


def matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def _patterns(x: np.ndarray) -> np.ndarray:
    """Which coordinates a row has, one bit each."""
    return (~np.isnan(x)).astype(np.int64) @ (1 << np.arange(x.shape[1], dtype=np.int64))


@dataclass
class Blocks:
    """The block table as arrays, and the pivots."""

    block: np.ndarray
    has: np.ndarray  # (block, coordinate): present in the block's rows
    group: np.ndarray
    rows: np.ndarray
    low: np.ndarray
    high: np.ndarray
    near: np.ndarray
    far: np.ndarray
    pivots: np.ndarray

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """Least possible distance of each query to each block; infinite where
        they share no coordinate."""
        d = q.shape[1]
        total, shared = np.zeros((len(q), len(self.block))), np.zeros((len(q), len(self.block)))
        for i in range(d):
            both = ~np.isnan(q[:, i, None]) & self.has[None, :, i]
            x = np.where(np.isnan(q[:, i]), 0.0, q[:, i])[:, None]
            gap = np.maximum(np.maximum(self.low[:, i] - x, x - self.high[:, i]), 0.0)
            total += np.where(both, gap * gap, 0.0)
            shared += both
        with np.errstate(invalid="ignore", divide="ignore"):
            out = np.where(shared > 0, np.sqrt(total * d / shared), np.inf)
        whole_q, whole_b = ~np.isnan(q).any(1), self.has.all(1)
        if whole_q.any() and whole_b.any():
            to = nan_distances(q[whole_q], self.pivots)
            for p in range(len(self.pivots)):
                gap = np.maximum(self.near[whole_b, p] - to[:, p, None], to[:, p, None] - self.far[whole_b, p])
                at = np.ix_(whole_q, whole_b)
                out[at] = np.maximum(out[at], gap)
        return out


class BlockIndex:
    """Candidates (_cid, _grp, _vec) in blocks. ``_vec`` has NaN where a
    coordinate is missing; vectors of more than 62 coordinates must be whole."""

    def __init__(self, candidates: DataFrame, block_rows: int = BLOCK_ROWS, pivots: int = PIVOTS):
        self.spark = candidates.sparkSession
        n = candidates.count()
        size = max(block_rows, -(-n // MOST_BLOCKS))
        rows = candidates.select("_cid", F.col("_grp").cast("long").alias("_grp"), "_vec")
        h = F.xxhash64(F.col("_cid").cast("string"))
        picked = rows.select("_vec", h.alias("_h"), "_cid").orderBy("_h", "_cid").limit(pivots).collect()
        self.width = len(picked[0]["_vec"]) if picked else 0
        if self.width > 62 and not rows.filter(F.exists("_vec", lambda x: F.isnan(x))).isEmpty():
            raise ValueError("more than 62 coordinates with missing values")
        points = np.nan_to_num(np.array([r["_vec"] for r in picked], np.float64)).reshape(len(picked), self.width)
        cid = rows.schema["_cid"].dataType.simpleString()

        def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if len(pdf):
                    x = matrix(pdf["_vec"])
                    to = nan_distances(x, points)
                    whole = ~np.isnan(x).any(1)
                    order = np.nan_to_num(to, nan=np.inf)
                    home = order.argmin(1)
                    yield pdf.assign(_pattern=_patterns(x) if x.shape[1] <= 62 else 0, _home=home,
                                     _far=order[np.arange(len(x)), home],
                                     _to=list(np.where(whole[:, None], to, np.nan)))

        shape = f"_cid {cid}, _grp long, _vec array<double>, _pattern long, _home long, _far double, _to array<double>"
        key = ["_pattern", "_grp", "_home", "_far", "_h"]
        parts = max(1, min(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-n // size)))
        dealt = (rows.mapInPandas(place, shape).withColumn("_h", h)
                 .repartitionByRange(parts, *key).sortWithinPartitions(*key, "_cid"))

        def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            """Consecutive rows of a pattern and group, ``size`` to a block."""
            from pyspark import TaskContext

            part = TaskContext.get().partitionId()
            key, held, block = None, 0, -1
            for pdf in batches:
                own = np.empty(len(pdf), np.int64)
                for i, k in enumerate(zip(pdf["_pattern"].tolist(), pdf["_grp"].tolist(), pdf["_home"].tolist())):
                    if k != key or held == size:
                        key, held, block = k, 0, block + 1
                    own[i] = block
                    held += 1
                yield pdf[["_cid", "_grp", "_vec", "_pattern", "_to"]].assign(_block=own + (part << 32))

        self.rows = dealt.mapInPandas(
            number, f"_cid {cid}, _grp long, _vec array<double>, _pattern long, _to array<double>, _block long").checkpoint()
        self.blocks = self._summary(points)

    def _summary(self, points: np.ndarray) -> Blocks | None:
        """The block table, if it is within the broadcast bound."""
        bare = lambda c: F.when(~F.isnan(c), c)  # noqa: E731  minima and maxima leave nulls out, but not NaN
        of = lambda f, name, n: F.array(*[f(bare(F.col(name)[i])) for i in range(n)])
        table = self.rows.groupBy("_block", "_pattern", "_grp").agg(
            F.count(F.lit(1)).alias("n"), of(F.min, "_vec", self.width).alias("low"), of(F.max, "_vec", self.width).alias("high"),
            of(F.min, "_to", len(points)).alias("near"), of(F.max, "_to", len(points)).alias("far"))
        most = LIMITS.broadcast_bytes // (64 + 16 * (self.width + len(points)))
        got = table.limit(most + 1).toPandas()
        if len(got) > most:
            return None
        got = got.sort_values("_block", ignore_index=True)
        wide = lambda c, n: (np.array([[np.nan if v is None else v for v in x] for x in got[c]], np.float64)
                             .reshape(len(got), n))
        pattern = got["_pattern"].to_numpy(np.int64)
        has = (pattern[:, None] >> np.arange(self.width) & 1).astype(bool) if self.width <= 62 else np.ones((len(got), self.width), bool)
        return Blocks(got["_block"].to_numpy(np.int64), has, got["_grp"].to_numpy(np.int64), got["n"].to_numpy(np.int64),
                      wide("low", self.width), wide("high", self.width), wide("near", len(points)), wide("far", len(points)), points)

    # -- searching ---------------------------------------------------------

    def search(self, queries: DataFrame, k: int, best: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str,
               serves: Callable[[Blocks], tuple[np.ndarray, np.ndarray]],
               wants: Callable[[np.ndarray, np.ndarray], np.ndarray], target: str) -> DataFrame:
        """The overall k best (by distance, then candidate id; ``rank`` from 1) per
        query (_qid, _qvec) and target.

        ``best(queries, candidates)`` returns rows of ``schema`` (with _qid,
        ``target``, distance and _cid): the k best of some candidates per query
        and target. ``serves(blocks)`` gives the target values and a matrix
        (block, target) of what a block's rows can be the answer to,
        ``wants(vectors, targets)`` a matrix (query, target) of what is asked."""
        place = Window.partitionBy("_qid", target).orderBy("distance", "_cid")
        self.visited, self.whole = [], 0
        queries = queries.select("_qid", "_qvec").checkpoint()
        if self.blocks is None:
            found = self._everything(queries, best, schema)
        else:
            sent = self.spark.sparkContext.broadcast(self.blocks)
            first = self._visit(queries.mapInPandas(_visits(sent, k, serves, wants, False), _visit_schema(queries)),
                                best, schema).checkpoint()
            kth = (first.withColumn("_r", F.row_number().over(place)).filter(F.col("_r") == k)
                   .groupBy("_qid").agg(F.map_from_entries(F.collect_list(F.struct(
                       F.col(target).cast("long"), "distance"))).alias("_kth")))
            asked = queries.join(kth, "_qid", "left")
            counts = asked.mapInPandas(_visits(sent, k, serves, wants, True, True), "n long, visits long")
            n, visits = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("visits"), F.lit(0))).first()
            m = int(self.blocks.rows.sum())
            qb, cb = _tiles(n, m, TILE_ROWS, self.spark)
            row = 32 + 8 * self.width
            if visits * row <= max(LEAST_VISIT_BYTES, (n * cb + m * qb) * row):
                found = first.union(self._visit(asked.mapInPandas(_visits(sent, k, serves, wants, True), _visit_schema(queries)),
                                                best, schema))
            else:
                found = self._everything(queries, best, schema, n, m)
        return found.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k)

    def _everything(self, queries: DataFrame, best: Callable, schema: str, n: int | None = None, m: int | None = None) -> DataFrame:
        n, m = queries.count() if n is None else n, self.rows.count() if m is None else m
        self.visited, self.whole = [], n * m
        return in_block_pairs(queries, self.rows.select("_cid", "_grp", "_vec"), "_qid", "_cid", best, schema, TILE_ROWS, (n, m))

    def _visit(self, visits: DataFrame, best: Callable, schema: str) -> DataFrame:
        """``best`` of every block and chunk of the queries that visit it."""
        visits = visits.checkpoint()
        counts = visits.groupBy("_block").agg(F.count(F.lit(1)).alias("_n"))
        self.visited.append(counts)
        chunks = F.broadcast(counts.select("_block", F.ceil(F.col("_n") / CHUNK_ROWS).cast("int").alias("_chunks")))
        q = visits.join(chunks, "_block").withColumn("_chunk", F.pmod(F.xxhash64("_qid"), F.col("_chunks")).cast("int"))
        c = self.rows.join(chunks, "_block").withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)))
        return (q.select("_block", "_chunk", "_qid", "_qvec").groupBy("_block", "_chunk")
                .cogroup(c.select("_block", "_chunk", "_cid", "_grp", "_vec").groupBy("_block", "_chunk"))
                .applyInPandas(lambda a, b: best(a, b), schema))

    def comparisons(self) -> int:
        """Distances that the last search computed."""
        rows = self.rows.groupBy("_block").agg(F.count(F.lit(1)).alias("_rows"))
        return self.whole + sum(v.join(rows, "_block").agg(F.sum(F.col("_n") * F.col("_rows"))).first()[0] or 0
                                for v in self.visited)


def _visit_schema(queries: DataFrame) -> str:
    return f"_block long, _qid {queries.schema['_qid'].dataType.simpleString()}, _qvec array<double>"


def _visits(sent, k: int, serves: Callable, wants: Callable, further: bool, counted: bool = False):
    """Blocks that queries visit: in the first round one for each target they
    want, in the second all others whose bound is within the k-th distance.
    ``counted``: only how many queries there are, and how many visits."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        blocks = sent.value
        targets, serving = serves(blocks)
        step = max(1, MATRIX_ENTRIES // max(1, len(blocks.block)))
        for pdf in batches:
            for at in range(0, len(pdf) if len(blocks.block) else 0, step):
                part = pdf.iloc[at:at + step]
                q = matrix(part["_qvec"])
                asked = wants(q, targets)
                bound = blocks.bounds(q)
                go = np.zeros(bound.shape, bool)
                for t in range(len(targets)):
                    own = np.flatnonzero(serving[:, t])
                    full = own[blocks.rows[own] >= k]
                    near = full if len(full) else own
                    if len(near):
                        rows = np.flatnonzero(asked[:, t])
                        go[rows, near[bound[np.ix_(rows, near)].argmin(1)]] = True
                go &= np.isfinite(bound)
                if further:
                    before = go
                    go = np.zeros(bound.shape, bool)
                    known = [dict(m) if m is not None else {} for m in part["_kth"]]
                    for t, value in enumerate(targets.tolist()):
                        limit = np.array([m.get(value, np.inf) for m in known])
                        reach = (limit * (1 + _SLACK) + _SLACK)[:, None]
                        go |= asked[:, t, None] & serving[None, :, t] & (bound <= reach) & np.isfinite(bound)
                    go &= ~before
                if counted:
                    yield pd.DataFrame({"n": [len(part)], "visits": [int(go.sum())]})
                    continue
                i, b = np.nonzero(go)
                piece = max(1, PIECE_BYTES // (32 + 8 * q.shape[1]))
                for s in range(0, len(i), piece):
                    own = i[s:s + piece]
                    yield pd.DataFrame({"_block": blocks.block[b[s:s + piece]], "_qid": part["_qid"].to_numpy()[own],
                                        "_qvec": part["_qvec"].to_numpy()[own]})
    return run


def _block_count(rows: int, most: int, least: int, cores: int) -> int:
    """Blocks of at most ``most`` rows; more while they keep ``least`` rows and
    cores would be idle. The result does not depend on the number."""
    return max(1, -(-rows // most), min(cores, rows // least))


def _tiles(n: int, m: int, most: int, spark) -> tuple[int, int]:
    """Into how many blocks n queries and m candidates are cut to compare them all."""
    cores = spark.sparkContext.defaultParallelism
    return _block_count(n, most, min(most, 256), cores), _block_count(m, 4 * most, 4 * most, 1)


def in_block_pairs(queries: DataFrame, candidates: DataFrame, qkey: str, ckey: str,
                   fn: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str,
                   block_rows: int | None = None, sizes: tuple[int, int] | None = None) -> DataFrame:
    """``fn`` of every (query block, candidate block), as one cogrouped stage:
    everything is compared. ``sizes``: rows of both sides, where they are known."""
    n, m = sizes or (queries.count(), candidates.count())
    qb, cb = _tiles(n, m, block_rows or LIMITS.query_block_rows, queries.sparkSession)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    block = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    q = queries.withColumn("_qb", block(qkey, qb)).select("*", every(cb).alias("_cb"))
    c = candidates.withColumn("_cb", block(ckey, cb)).select("*", every(qb).alias("_qb"))
    return (q.groupBy("_qb", "_cb").cogroup(c.groupBy("_qb", "_cb"))
            .applyInPandas(lambda a, b: fn(a, b), schema))


def nearest(queries: DataFrame, candidates: DataFrame, qid: str, cid: str, vec: str,
            group: str | None = None, k: int = 1, round_to: int = 9,
            block_rows: int | None = None, exclude_self: bool = False, index: BlockIndex | None = None) -> DataFrame:
    """k nearest candidates per query (and per candidate ``group``) under
    Euclidean distance on array column ``vec``.

    Output: (qid, [group,] cid, distance, rank). Distances are rounded to
    ``round_to`` decimals and ties broken by candidate id. With
    ``exclude_self`` a candidate never matches the query with the same id
    (leave-one-out over one table). ``index``: of the same candidates
    (``block_index``), to search them more than once.
    """
    index = index or block_index(candidates, cid, vec, group, block_rows)
    query = queries.select(F.col(qid).alias("_qid"), F.col(vec).cast("array<double>").alias("_qvec"))

    def best(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        parts = []
        if len(q) and len(c):
            qi, ci = q["_qid"].to_numpy(np.int64), c["_cid"].to_numpy(np.int64)
            groups = c["_grp"].to_numpy(np.int64)
            qm, cm = matrix(q["_qvec"]), matrix(c["_vec"])
            for g in np.unique(groups):
                own = np.flatnonzero(groups == g)
                row, col, dist = k_nearest(qm, cm[own], k, round_to, ci[own], qi if exclude_self else None)
                parts.append(pd.DataFrame({"_qid": qi[row], "_grp": g, "_cid": ci[own[col]], "distance": dist}))
        return pd.concat(parts) if parts else pd.DataFrame({"_qid": [], "_grp": [], "_cid": [], "distance": []})

    def serves(b: Blocks) -> tuple[np.ndarray, np.ndarray]:
        groups = np.unique(b.group)
        return groups, b.group[:, None] == groups

    top = index.search(query, k, best, "_qid long, _grp long, _cid long, distance double", serves,
                       lambda q, t: np.ones((len(q), len(t)), bool), "_grp")
    top = top.withColumnRenamed("_qid", qid).withColumnRenamed("_cid", cid)
    if group:
        return top.withColumnRenamed("_grp", group)
    return top.drop("_grp")


def block_index(candidates: DataFrame, cid: str, vec: str, group: str | None = None,
                block_rows: int | None = None) -> BlockIndex:
    """Index of candidates for ``nearest``."""
    return BlockIndex(candidates.select(F.col(cid).alias("_cid"), (F.col(group) if group else F.lit(0)).alias("_grp"),
                                        F.col(vec).cast("array<double>").alias("_vec")), block_rows or BLOCK_ROWS)
