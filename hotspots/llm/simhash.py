"""SimHash near-duplicates with a Gray-order hierarchical index.

A fingerprint has a bit set where over half the hashes of the text's word
shingles have it set. Two different fingerprints link when at most
``distance`` bits differ; exact copies share a fingerprint and are one vertex.

Finding all links: the 64 bits are cut into ``distance`` + 1 blocks, and linked
fingerprints agree in at least one of them, so each is dealt once per block to
the bucket of that block's bits. A bucket with more than ``bucket`` members is
dealt again by the blocks of its remaining bits (and so on), which keeps the
rule exact: what agrees up to ``distance`` bits in the rest agrees in one block
of the rest. Inside a bucket the fingerprints are sorted by Gray rank, so
neighbours share most bits; runs of ``FAN`` form nodes that hold the bits all
members share, and nodes form upper nodes. Pairs of nodes are walked from the
top, adding the differences of newly shared bits; a pair over the limit is
dropped with everything below it, and so is a pair whose members are connected
already. A bucket returns a spanning forest of its links (fewer edges than
members), never its pairs.

Defined results: a null or blank text has fingerprint zero and links like any
other; a text of fewer words than a shingle is one shingle; repeated rows are
each returned; a component's id is the smallest id of its rows, ids that are
null are passed over (null where all are); an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hotspots.llm.batches import packed, slices
from hotspots.llm.components import stars

SEED = 42
FAN = 16
#: Members above which a bucket is dealt again, and how often at most.
BUCKET = 8192
LEVELS = 3
#: Shingles hashed at a time.
_RUN = 1 << 16
#: Node pairs compared at a time.
_PAIRS = 1 << 18


# -- fingerprints --------------------------------------------------------------

def fingerprint(text: bytes, shingle: int = 4) -> int:
    """Unsigned fingerprint of a text (A-Z lower-cased, ASCII white space)."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))  # one past the space after each word
    starts = [0, *ends[:-1]]
    last = ends[shingle - 1:] or ends[-1:]
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_digest
    for i in range(0, len(last), _RUN):
        raw = b"".join([digest(joined[a:b - 1], SEED)
                        for a, b in zip(starts[i:i + _RUN], last[i:i + _RUN])])
        bits = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(last)).tobytes(), "big")


def fingerprints(docs: DataFrame, text: str = "text", keep: list[str] | None = None,
                 shingle: int = 4) -> DataFrame:
    """``row`` (the columns ``keep``, default all) and ``fingerprint`` (64 bits as a long)."""
    rows = packed(docs, text, keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, "body"):
            found = np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(found)],
                                             names=["row", "fingerprint"])

    return rows.mapInArrow(run, rows.select("row").schema.add("fingerprint", "long"))


def hex_text(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


# -- hierarchical index of one bucket --------------------------------------------

def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Position of each code in the reflected Gray order."""
    rank = codes.copy()
    for k in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(k)
    return rank


class Index:
    """Nodes over Gray-sorted codes. ``shared[l]`` are the masks of the bits
    that the members of each node of level l agree in, ``bits[l]`` their values."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes[np.argsort(gray_rank(codes), kind="stable")]
        full = np.full(len(codes), np.uint64(0xFFFFFFFFFFFFFFFF))
        self.shared, self.bits = [full], [self.codes]
        low = high = self.codes  # AND and OR of all members
        while len(low) > FAN:
            at = np.arange(0, len(low), FAN)
            low, high = np.bitwise_and.reduceat(low, at), np.bitwise_or.reduceat(high, at)
            mask = ~(low ^ high)
            self.shared.append(mask)
            self.bits.append(low & mask)

    def links(self, distance: int) -> list[tuple[int, int]]:
        """Spanning forest, as positions in ``codes``, of the pairs at most
        ``distance`` bits apart."""
        forest = Forest(len(self.codes))
        top = len(self.shared) - 1
        x, y = np.triu_indices(len(self.shared[top]))
        both = self.shared[top][x] & self.shared[top][y]
        apart = np.bitwise_count((self.bits[top][x] ^ self.bits[top][y]) & both).astype(np.int64)
        todo = [(top, x, y, apart)]
        while todo:
            level, x, y, apart = todo.pop()
            if len(x) > _PAIRS:
                todo += [(level, x[i:i + _PAIRS], y[i:i + _PAIRS], apart[i:i + _PAIRS])
                         for i in range(0, len(x), _PAIRS)]
                continue
            near = apart <= distance
            if level == 0:
                near &= x != y
                forest.join(x[near], y[near])
                continue
            near &= ~forest.one(level, x, y)
            x, y, apart = x[near], y[near], apart[near]
            step = max(1, _PAIRS // (FAN * FAN))
            for i in range(0, len(x), step):
                todo.append((level - 1, *self._below(level, x[i:i + step], y[i:i + step], apart[i:i + step])))
        return forest.edges

    def _below(self, level, x, y, apart):
        """Pairs of children of node pairs; differences are added for the bits
        that become shared one level down."""
        size = len(self.shared[level - 1])
        fan = np.arange(FAN)
        a = np.repeat(x * FAN, FAN * FAN) + np.tile(np.repeat(fan, FAN), len(x))
        b = np.repeat(y * FAN, FAN * FAN) + np.tile(fan, FAN * len(x))
        above = np.repeat(self.shared[level][x] & self.shared[level][y], FAN * FAN)
        so_far = np.repeat(apart, FAN * FAN)
        keep = (a < size) & (b < size) & (a <= b)
        a, b, above, so_far = a[keep], b[keep], above[keep], so_far[keep]
        new = self.shared[level - 1][a] & self.shared[level - 1][b] & ~above
        return a, b, so_far + np.bitwise_count((self.bits[level - 1][a] ^ self.bits[level - 1][b]) & new)


class Forest:
    """Union-find over positions; keeps the edges that joined two trees."""

    def __init__(self, n: int):
        self.parent = list(range(n))
        self.edges: list[tuple[int, int]] = []
        self._spans: list[tuple[np.ndarray, np.ndarray]] | None = None

    def root(self, i: int) -> int:
        p = self.parent
        while p[i] != i:
            p[i] = p[p[i]]
            i = p[i]
        return i

    def join(self, x: np.ndarray, y: np.ndarray) -> None:
        for i, j in zip(x.tolist(), y.tolist()):
            a, b = self.root(i), self.root(j)
            if a != b:
                self.parent[max(a, b)] = min(a, b)
                self.edges.append((i, j))
                self._spans = None

    def one(self, level: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """True where all members of both nodes are in one tree already."""
        if self._spans is None:
            roots = np.array([self.root(i) for i in range(len(self.parent))])
            self._spans = [(roots, roots)]
        while len(self._spans) <= level:
            low, high = self._spans[-1]
            at = np.arange(0, len(low), FAN)
            self._spans.append((np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)))
        low, high = self._spans[level]
        return (low[x] == high[x]) & (low[y] == high[y]) & (low[x] == low[y])


# -- all links --------------------------------------------------------------------

def _cut(positions: list[int], parts: int) -> list[list[int]]:
    size, more = divmod(len(positions), parts)
    out, at = [], 0
    for k in range(parts):
        n = size + (k < more)
        out.append(positions[at:at + n])
        at += n
    return [p for p in out if p]


def _blocks(distance: int, levels: int) -> list[dict[int, list[tuple[int, int]]]]:
    """Per level: node -> [(child node, mask of all bits fixed there)]."""
    paths = {0: (list(range(64)), 0)}  # free bits, mask
    out = []
    count = 1
    for _ in range(levels):
        below: dict[int, list[tuple[int, int]]] = {}
        following = {}
        for node, (free, mask) in paths.items():
            for part in _cut(free, distance + 1):
                m = mask | sum(1 << p for p in part)
                below.setdefault(node, []).append((count, m))
                following[count] = ([p for p in free if p not in part], m)
                count += 1
        out.append(below)
        paths = {k: v for k, v in following.items() if v[0]}
    return out


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _deal(rows: DataFrame, below: dict[int, list[tuple[int, int]]]) -> DataFrame:
    """One row per child block: (node, value, fp)."""
    child = F.lit(None).cast("array<struct<node:int,value:bigint>>")
    for node, children in below.items():
        dealt = F.array(*[F.struct(F.lit(c).alias("node"),
                                   F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("value"))
                          for c, m in children])
        child = F.when(F.col("node") == node, dealt).otherwise(child)
    return rows.select("fp", F.explode(child).alias("c")).select("c.node", "c.value", "fp")


def link_edges(codes: DataFrame, distance: int = 4, bucket: int = BUCKET) -> DataFrame:
    """(a, b): edges that connect exactly the classes of linked fingerprints.
    ``codes`` holds distinct fingerprints in column ``fp``."""
    levels = _blocks(distance, LEVELS)
    rows = _deal(codes.select("fp", F.lit(0).alias("node")), levels[0])
    found = []
    for below in levels[1:]:
        rows = rows.checkpoint()
        counts = rows.groupBy("node", "value").agg(F.count(F.lit(1)).alias("n"))
        hot = counts.filter((F.col("n") > bucket) & F.col("node").isin(list(below))).drop("n").checkpoint()
        if hot.isEmpty():
            break
        found.append(_bucket_links(rows.join(hot, ["node", "value"], "left_anti"), distance))
        rows = _deal(rows.join(hot, ["node", "value"], "left_semi"), below)
    else:
        # what is still hot meets in pairs of sub-blocks
        rows = rows.checkpoint()
        hot = (rows.groupBy("node", "value").agg(F.count(F.lit(1)).alias("n"))
               .filter(F.col("n") > bucket).checkpoint())
        if not hot.isEmpty():
            found.append(_bucket_links(_sub_blocks(rows.join(hot, ["node", "value"]), bucket), distance))
            rows = rows.join(hot, ["node", "value"], "left_anti")
    out = _bucket_links(rows, distance)
    for f in found:
        out = out.union(f)
    return out


def _sub_blocks(rows: DataFrame, bucket: int) -> DataFrame:
    """Rows of hot buckets of ``n`` members, once for each pair of sub-blocks
    that theirs is in: every two members meet, about ``bucket`` at a time."""
    own = F.pmod(F.xxhash64("fp"), F.col("k")).cast("int")
    pair = F.struct(F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))
    return (rows.withColumn("k", F.greatest(F.lit(2), F.ceil(2 * F.col("n") / bucket)).cast("int"))
            .withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
            .filter("own != other").withColumn("pair", pair)
            .select("node", "value", "fp", (F.col("pair.low").cast("long") * F.col("k") + F.col("pair.high")).alias("pair")))


def _bucket_links(rows: DataFrame, distance: int) -> DataFrame:
    """Forest edges of every bucket, or of every pair of sub-blocks of one. A partition streams its sorted buckets;
    one bucket is in memory at a time."""
    rows = rows.select("node", "value", "fp", "pair" if "pair" in rows.columns else F.lit(0).cast("long").alias("pair"))
    sorted_rows = rows.repartition("node", "value", "pair").sortWithinPartitions("node", "value", "pair")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        key = None
        out: list[np.ndarray] = []

        def close():
            codes = np.concatenate(held)
            if len(codes) > 1:
                index = Index(codes)
                pairs = index.links(distance)
                if pairs:
                    out.append(index.codes[np.array(pairs)].view(np.int64))

        for batch in batches:
            node, value, pair = (batch.column(c).to_numpy() for c in ("node", "value", "pair"))
            fp = batch.column("fp").to_numpy().view(np.uint64)
            if not len(fp):
                continue
            cuts = np.flatnonzero((node[1:] != node[:-1]) | (value[1:] != value[:-1]) | (pair[1:] != pair[:-1])) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(fp)]):
                k = (node[a], value[a], pair[a])
                if key is not None and k != key:
                    close()
                    held = []
                key = k
                held.append(fp[a:b])
            if out:
                edges = np.concatenate(out)
                out = []
                yield pa.RecordBatch.from_arrays([pa.array(edges[:, 0]), pa.array(edges[:, 1])], names=["a", "b"])
        if held:
            close()
        if out:
            edges = np.concatenate(out)
            yield pa.RecordBatch.from_arrays([pa.array(edges[:, 0]), pa.array(edges[:, 1])], names=["a", "b"])

    return sorted_rows.mapInArrow(run, "a long, b long")


def classes(marked: DataFrame, distance: int = 4, bucket: int = BUCKET) -> DataFrame:
    """(fp, root) for every distinct fingerprint of ``marked``: root is one
    fingerprint of its component. ``marked`` should be materialised."""
    codes = marked.select(F.col("fingerprint").alias("fp")).distinct()
    roots = stars(link_edges(codes, distance, bucket))
    return (codes.join(roots, codes.fp == roots.u, "left")
            .select("fp", F.coalesce("v", "fp").alias("root")))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                    shingle: int = 4, distance: int = 4) -> DataFrame:
    """``id``, ``fingerprint`` and ``component_id`` of every row."""
    marked = fingerprints(docs, text, [doc_id], shingle).select(
        F.col(f"row.`{doc_id}`").alias("id"), "fingerprint").checkpoint()
    rooted = classes(marked, distance)
    smallest = (marked.groupBy("fingerprint").agg(F.min("id").alias("least"))
                .join(rooted, F.col("fingerprint") == F.col("fp")))
    # written first: then the members of a hot root can be split over tasks
    component = smallest.groupBy("root").agg(F.min("least").alias("component_id")).checkpoint()
    of_code = rooted.join(component, "root").select("fp", "component_id")
    return (marked.join(of_code, marked.fingerprint == of_code.fp)
            .select("id", "fingerprint", "component_id"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
             shingle: int = 4, distance: int = 4) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each component the row
    with the smallest id (null last), then the smallest text hash; of rows equal
    in both, one."""
    def key(c):
        return F.struct(F.col(c).isNull().alias("no_id"), F.col(c).alias("id"), F.col("_h").alias("h"))

    columns = docs.columns
    hashed = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"),
                         F.col(f"`{doc_id}`").alias("_id"),
                         F.xxhash64(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))).alias("_h"),
                         F.col(f"`{text}`").alias("_text"))
    marked = fingerprints(hashed, "_text", ["_id", "_h"], shingle).select(
        F.col("row._id").alias("_id"), F.col("row._h").alias("_h"), "fingerprint").checkpoint()
    rooted = classes(marked, distance)
    by_code = marked.groupBy("fingerprint", "_id", "_h").agg(F.count(F.lit(1)).alias("n"))
    # one row per fingerprint meets the classes, however many copies it has
    best = (by_code.groupBy("fingerprint")
            .agg(F.min(F.struct(*[key("_id")[f].alias(f) for f in ("no_id", "id", "h")], "n")).alias("k"))
            .join(rooted, F.col("fingerprint") == F.col("fp"))
            .groupBy("root").agg(F.min("k").alias("k"))
            .select(F.col("k.id").alias("k_id"), F.col("k.h").alias("k_h"), F.col("k.n").alias("k_n"))).checkpoint()
    kept = hashed.join(best.hint("shuffle_hash"),
                       F.col("_id").eqNullSafe(F.col("k_id")) & (F.col("_h") == F.col("k_h")))
    once = kept.select("row.*")
    if best.filter("k_n > 1").isEmpty():
        return once
    single = kept.filter("k_n = 1").select("row.*")
    several = kept.filter("k_n > 1").groupBy("_id", "_h").agg(F.min("row").alias("row")).select("row.*")
    return single.union(several)
