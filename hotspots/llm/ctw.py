"""Language-model scoring by context-tree weighting.

The model reads bytes (A-Z lower-cased, a zero byte ends a text). Each byte is
eight binary decisions in the binary tree of its bits; each decision has, per
context of 0 to ``DEPTH`` preceding bytes, the counts of zeros and ones seen in
the training rows. A node's block probability mixes its own Krichevsky-Trofimov
estimate with the product of its children's (one byte more of context), half
and half, and the prediction for a decision mixes the estimates of all depths
by the weights that follow; where the training rows never saw a context, the
deeper ones are left out. Counts come from all training rows, so the tables
grow with the corpus; nothing but the upper tree (contexts of up to two bytes,
at most 65,536 x 255 nodes) passes the driver.

How it runs, with G groups of rows and B buckets of keys:

1. tasks turn their rows into groups of bounded text size: the texts, and per
   group the distinct grams (context and byte) and words with training counts,
   as sorted key blocks per bucket - one pass over the documents;
2. per bucket the blocks of all groups are added up: total counts of its keys;
3. grams are dealt by their nearest three context bytes, so that every node
   from depth three down is whole in one place (at most 2^24 grams each), and
   each gram gets the log probability of its byte, once the sums of the upper
   tree are known;
4. per bucket every group's keys are answered, and each group scores its texts.

The unigram base uses the word counts in the same way. Words are told apart by
a 64-bit hash.

Defined results: a null text is the empty text (one end token); a null id is
never held out; repeated rows count and are scored each; without training rows
every decision has probability one half; an empty table gives an empty result;
columns other than id and text are ignored. A text of n bytes has n + 1 bytes to
code, its end byte too; the code length per byte is in bits.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hotspots.llm.batches import packed, slices
from hotspots.llm.training import fold
from hotspots.session import scratch_dir

DEPTH = 5
#: Text bytes of a group, and of a run of texts inside it.
GROUP_BYTES = 32 << 20
#: Bytes of text that one bucket of keys stands for: the number of buckets grows with the corpus.
BUCKET_BYTES = 64 << 20
RUN_BYTES = 2 << 20
_U = np.uint64
_MIX = _U(0x9E3779B97F4A7C15)
#: Marks the end token among word hashes.
END_WORD = xxhash.xxh64_intdigest(b"\n", 1)


# -- blocks of numbers ---------------------------------------------------------------

def pack(a: np.ndarray) -> bytes:
    """A number block as bytes: equal-place bytes side by side, compressed."""
    raw = a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() if len(a) else b""
    return struct.pack("<q", len(a)) + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(block: bytes, kind) -> np.ndarray:
    n = struct.unpack_from("<q", block)[0]
    size = np.dtype(kind).itemsize
    if not n:
        return np.empty(0, kind)
    raw = pa.decompress(block[8:], decompressed_size=n * size, codec="zstd", asbytes=True)
    return np.frombuffer(raw, np.uint8).reshape(size, n).T.copy().view(kind).ravel()


def pack_keys(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=_U(0)))


def unpack_keys(block: bytes) -> np.ndarray:
    return np.cumsum(unpack(block, np.uint64), dtype=np.uint64)


def add_up(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[at], np.add.reduceat(counts, at)


# -- grams and words of texts ----------------------------------------------------------

def gram_keys(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all positions of lower-cased texts (each with its end), and
    where each text's keys begin. A key holds the context, nearest byte first,
    and the byte itself last, so a shorter context is a prefix."""
    pad = b"\0" * DEPTH
    buffer = pad.join([b"", *[t + b"\0" for t in texts]]) + b"\0" * 8
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    first = np.concatenate([[0], np.cumsum(sizes + DEPTH)])[:-1]
    n = int((sizes + DEPTH).sum())
    view = np.ndarray((n,), "<u8", buffer, strides=(1,))
    keep = np.ones(n, bool)
    ends = first + sizes
    for k in range(DEPTH):
        keep[ends + k] = False
    wide = view[keep]
    width = _U(8 * DEPTH)
    keys = ((wide & _U((1 << 8 * DEPTH) - 1)) << _U(8)) | ((wide >> width) & _U(255))
    return keys, np.concatenate([[0], np.cumsum(sizes)])[:-1]


def word_keys(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words and the end of each lower-cased text, and where
    each text's hashes begin."""
    parts, sizes = [], []
    digest, end = xxhash.xxh64_digest, struct.pack(">Q", END_WORD)
    for t in texts:
        words = t.split()
        parts += map(digest, words)
        parts.append(end)
        sizes.append(len(words) + 1)
    keys = np.frombuffer(b"".join(parts), ">u8").astype(np.uint64)
    return keys, np.concatenate([[0], np.cumsum(np.array(sizes, np.int64))])[:-1]


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    h = keys * _MIX
    return ((h ^ (h >> _U(32))) % _U(buckets)).astype(np.int64)


def _runs(texts: list[bytes]) -> Iterator[slice]:
    """Runs of texts of at most RUN_BYTES, or one text."""
    a = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > RUN_BYTES:
            yield slice(a, i)
            a, size = i, 0
        size += len(t)
    if a < len(texts):
        yield slice(a, len(texts))


_PARTS = ("kind string, grp long, bucket int, rows array<%s>, held array<boolean>, lengths array<int>, "
          "texts binary, keys binary, counts binary")


def group_rows(rows: DataFrame, buckets: int) -> DataFrame:
    """Step 1. Rows of kind ``text`` (a run of texts) and ``gram`` / ``word``
    (sorted keys of a group in one bucket, with training counts)."""
    schema = _PARTS % rows.schema["row"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        number = size = 0
        seen = {"gram": [], "word": []}
        row_type = None

        def out(**columns):
            n = len(next(iter(columns.values())))
            full = {"kind": pa.string(), "grp": pa.int64(), "bucket": pa.int32(), "rows": pa.list_(row_type),
                    "held": pa.list_(pa.bool_()), "lengths": pa.list_(pa.int32()), "texts": pa.binary(),
                    "keys": pa.binary(), "counts": pa.binary()}
            return pa.RecordBatch.from_arrays(
                [columns[k] if isinstance(columns.get(k), pa.Array) else pa.array(columns.get(k, [None] * n), t)
                 for k, t in full.items()], names=list(full))

        def close():
            group = part * (1 << 32) + number
            for kind, found in seen.items():
                keys, counts = add_up(np.concatenate([k for k, _ in found]), np.concatenate([c for _, c in found]))
                bucket = _bucket(keys, buckets)
                order = np.argsort(bucket, kind="stable")
                keys, counts, bucket = keys[order], counts[order], bucket[order]
                ids, at = np.unique(bucket, return_index=True)
                ends = [*at[1:], len(keys)]
                yield out(kind=[kind] * len(ids), grp=[group] * len(ids), bucket=ids.tolist(),
                          keys=[pack_keys(keys[a:b]) for a, b in zip(at, ends)],
                          counts=[pack(counts[a:b].astype(np.int64)) for a, b in zip(at, ends)])
                found.clear()

        for batch, raw in slices(batches, "body", RUN_BYTES):
            row_type = batch.schema.field(0).type
            texts = [t.lower() for t in raw]
            held = batch.column("held").to_pylist()
            for kind, keyed in (("gram", gram_keys), ("word", word_keys)):
                for flag in (True, False):
                    own = [t for t, h in zip(texts, held) if h == flag]
                    if own:
                        keys, counts = np.unique(keyed(own)[0], return_counts=True)
                        seen[kind].append((keys, np.zeros_like(counts) if flag else counts))
            n = batch.num_rows
            whole = b"".join(texts)
            yield out(kind=["text"], grp=[part * (1 << 32) + number],
                      rows=pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), batch.column("row")),
                      held=[held], lengths=[list(map(len, texts))],
                      texts=[struct.pack("<q", len(whole)) + pa.compress(whole, codec="zstd", asbytes=True)])
            size += len(whole)
            if size >= GROUP_BYTES:
                yield from close()
                number, size = number + 1, 0
        if seen["gram"]:
            yield from close()

    return rows.mapInArrow(run, schema)


def _texts(row_lengths: list[int], block: bytes) -> list[bytes]:
    n = struct.unpack_from("<q", block)[0]
    whole = pa.decompress(block[8:], decompressed_size=n, codec="zstd", asbytes=True) if n else b""
    ends = np.cumsum([0, *row_lengths]).tolist()
    return [whole[a:b] for a, b in zip(ends, ends[1:])]


# -- the tree ----------------------------------------------------------------------------

_LG_HALF = np.concatenate([[0.5 * np.log(np.pi)], 0.5 * np.log(np.pi) + np.cumsum(np.log(np.arange(4096) + 0.5))])
_LG_INT = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, 4097)))])
LN2 = float(np.log(2))


def _gamma(x: np.ndarray) -> np.ndarray:
    """log Gamma for large arguments."""
    return (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + 1 / (12 * x) - 1 / (360 * x ** 3)


def _table(n: np.ndarray, table: np.ndarray, shift: float) -> np.ndarray:
    small = n < 4096
    out = table[np.where(small, n, 0)]
    if not small.all():
        out = np.where(small, out, _gamma(np.where(small, 4096, n) + shift))
    return out


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Natural log of the Krichevsky-Trofimov probability of so many zeros and ones."""
    return (_table(zeros, _LG_HALF, 0.5) + _table(ones, _LG_HALF, 0.5)
            - _table(zeros + ones, _LG_INT, 1.0) - np.log(np.pi))


class Level:
    """Decisions of one bit place at one depth for the grams of a place sorted
    by ``key``: the nodes, and each gram's node."""

    def __init__(self, prefix: np.ndarray, byte: np.ndarray, counts: np.ndarray, place: int):
        """``prefix`` (context) and ``byte`` per distinct (context, byte), sorted."""
        self.node = (prefix << _U(8)) | (_U(1 << place) | (byte >> _U(8 - place)))
        self.first = np.flatnonzero(np.concatenate([[True], self.node[1:] != self.node[:-1]]))
        self.of = np.cumsum(np.concatenate([[False], self.node[1:] != self.node[:-1]]))
        self.bit = ((byte >> _U(7 - place)) & _U(1)).astype(bool)
        self.ones = np.add.reduceat(np.where(self.bit, counts, 0), self.first)
        self.zeros = np.add.reduceat(counts, self.first) - self.ones
        self.seen = (self.ones + self.zeros) > 0

    def estimate(self) -> np.ndarray:
        """Krichevsky-Trofimov probability of each entry's own bit."""
        mine = np.where(self.bit, self.ones[self.of], self.zeros[self.of])
        return (mine + 0.5) / (self.ones + self.zeros + 1)[self.of]


class Tree:
    """The tree from depth ``top`` to DEPTH over grams that hold all members of
    their depth-``top`` contexts."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, top: int = 3):
        self.keys, self.top = keys, top
        byte, context = keys & _U(255), keys >> _U(8)
        self.entry, self.levels, self.weight, self.block = {}, {}, {}, {}
        for d in range(DEPTH, top - 1, -1):
            short = ((context >> _U(8 * (DEPTH - d))) << _U(8)) | byte
            if d == DEPTH:
                distinct, entry, sums = short, np.arange(len(keys)), counts
            else:
                distinct, entry = np.unique(short, return_inverse=True)
                sums = np.bincount(entry, counts, len(distinct)).astype(np.int64)
            self.entry[d] = entry
            self.levels[d] = [Level(distinct >> _U(8), distinct & _U(255), sums, k) for k in range(8)]
            self.block[d], self.weight[d] = [], []
            representative = np.full(len(distinct), -1)
            representative[entry] = np.arange(len(keys))
            self.entry[d, "gram"] = representative
            for k in range(8):
                level = self.levels[d][k]
                own = log_kt(level.zeros, level.ones)
                if d == DEPTH:
                    block, weight = own, np.ones(len(own))
                else:
                    below = self.levels[d + 1][k]
                    # a gram below each child node tells the node it hangs on
                    gram = self.entry[d + 1, "gram"][below.first]
                    parent = level.of[entry[gram]]
                    children = np.bincount(parent, self.block[d + 1][k], len(own))
                    block = np.logaddexp(own, children) - LN2
                    weight = np.exp(own - LN2 - block)
                self.block[d].append(block)
                self.weight[d].append(weight)

    def upper_sums(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Per decision node of the contexts one byte shorter than ``top``: its
        number (context, then decision), zeros, ones and summed block logs."""
        parts = []
        for k in range(8):
            level = self.levels[self.top][k]
            node = level.node[level.first]
            parts.append((((node >> _U(16)) << _U(8)) | (node & _U(255)), level.zeros, level.ones, self.block[self.top][k]))
        node = np.concatenate([p[0] for p in parts])
        distinct, at = np.unique(node, return_inverse=True)
        add = lambda i: np.bincount(at, np.concatenate([p[i] for p in parts]), len(distinct))
        return distinct, add(1).astype(np.int64), add(2).astype(np.int64), add(3)

    def log10(self, upper: "Upper") -> np.ndarray:
        """log10 probability of each gram's byte in its context."""
        total = np.zeros(len(self.keys))
        for k in range(8):
            p = None
            for d in range(DEPTH, self.top - 1, -1):
                level, entry = self.levels[d][k], self.entry[d]
                of = level.of[entry]
                own = level.estimate()[entry]
                seen = level.seen[of]
                if p is None:
                    p, known = own, seen
                else:
                    w = self.weight[d][k][of]
                    p, known = np.where(known, w * own + (1 - w) * p, own), seen
            level = self.levels[self.top][k]
            of = level.of[self.entry[self.top]]
            node = level.node[level.first]
            number = ((node >> _U(16)) << _U(8)) | (node & _U(255))
            bit = level.bit[self.entry[self.top]]
            total += np.log10(upper.mix(number[of], bit, p, known))
        return total


class Upper:
    """Contexts of 0 to 2 bytes: what their decisions contribute. For each node
    of depth two, the probability of a zero is ``part`` + ``rest`` x (deeper
    prediction), or ``alone`` where the tree ends there."""

    def __init__(self, node: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray):
        self.node = node
        n2, a2, b2 = node, zeros, ones
        block2 = np.logaddexp(log_kt(a2, b2), below) - LN2
        w2 = np.exp(log_kt(a2, b2) - LN2 - block2)
        n1, at1 = np.unique(((node >> _U(16)) << _U(8)) | (node & _U(255)), return_inverse=True)
        a1, b1 = (np.bincount(at1, x, len(n1)).astype(np.int64) for x in (a2, b2))
        block1 = np.logaddexp(log_kt(a1, b1), np.bincount(at1, block2, len(n1))) - LN2
        w1 = np.exp(log_kt(a1, b1) - LN2 - block1)
        n0, at0 = np.unique(n1 & _U(255), return_inverse=True)
        a0, b0 = (np.bincount(at0, x, len(n0)).astype(np.int64) for x in (a1, b1))
        block0 = np.logaddexp(log_kt(a0, b0), np.bincount(at0, block1, len(n0))) - LN2
        w0 = np.exp(log_kt(a0, b0) - LN2 - block0)
        zero = lambda a, b: (a + 0.5) / (a + b + 1)
        up1, up0 = at1, at0[at1]
        seen2, seen1 = (a2 + b2) > 0, ((a1 + b1) > 0)[up1]
        k0, k1, k2 = zero(a0, b0)[up0], zero(a1, b1)[up1], zero(a2, b2)
        v0, v1 = w0[up0], w1[up1]
        to1 = np.where(seen2, v1 * k1 + (1 - v1) * k2, k1)
        self.alone = np.where(seen1, v0 * k0 + (1 - v0) * to1, k0)
        self.rest = (1 - v0) * (1 - v1) * (1 - w2)
        self.part = v0 * k0 + (1 - v0) * (v1 * k1 + (1 - v1) * w2 * k2)

    def mix(self, node: np.ndarray, bit: np.ndarray, deeper: np.ndarray, known: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.node, node)
        alone = np.where(bit, 1 - self.alone[at], self.alone[at])
        rest = self.rest[at]
        part = np.where(bit, 1 - rest - self.part[at], self.part[at])
        return np.where(known, part + rest * deeper, alone)


# -- answers ---------------------------------------------------------------------------------

class Lookup:
    """Open-addressed table from known keys to values."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(2 * len(keys) - 1).bit_length())
        self.shift, self.mask = _U(64 - bits), (1 << bits) - 1
        slot = np.full(1 << bits, -1, np.int64)
        place = self._place(keys)
        todo = np.arange(len(keys))
        while len(todo):
            free = todo[slot[place[todo]] < 0]
            slot[place[free]] = free
            todo = todo[slot[place[todo]] != todo]
            place[todo] = (place[todo] + 1) & self.mask
        self.keys = np.where(slot >= 0, keys[slot], ~_U(0))
        self.values = values[slot]

    def _place(self, keys):
        return ((keys * _MIX) >> self.shift).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        place = self._place(keys)
        todo = np.flatnonzero(self.keys[place] != keys)
        while len(todo):
            place[todo] = (place[todo] + 1) & self.mask
            todo = todo[self.keys[place[todo]] != keys[todo]]
        return self.values[place]


def _sum_blocks(table: pa.Table, counts: str = "counts") -> tuple[np.ndarray, np.ndarray]:
    keys = [unpack_keys(x) for x in table.column("keys").to_pylist()]
    sums = [unpack(x, np.int64) for x in table.column(counts).to_pylist()]
    return add_up(np.concatenate(keys), np.concatenate(sums))


def _places(gram: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of a gram's nearest three context bytes."""
    return _bucket(gram >> _U(8 * (DEPTH - 2)), buckets)


def _deal(keys: np.ndarray, values: np.ndarray, bucket: np.ndarray) -> dict:
    order = np.lexsort((keys, bucket))
    keys, values, bucket = keys[order], values[order], bucket[order]
    ids, at = np.unique(bucket, return_index=True)
    ends = [*at[1:], len(keys)]
    return {"bucket": pa.array(ids.astype(np.int32)),
            "keys": pa.array([pack_keys(keys[a:b]) for a, b in zip(at, ends)], pa.binary()),
            "counts": pa.array([pack(values[a:b]) for a, b in zip(at, ends)], pa.binary())}


def score(spark: SparkSession, docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
          keep: list[str] | None = None) -> DataFrame:
    """``row`` (the columns ``keep``, default all), held_out, n_tokens, n_known,
    train_tokens, base_score, n_bytes (with the end byte), score (log10) and
    code_length_per_byte (bits)."""
    size = docs.agg(F.sum(F.octet_length(F.col(f"`{text}`").cast("string")))).first()[0] or 0
    buckets = max(16, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))
    packs = packed(docs, text, keep)
    flag = F.coalesce(fold(doc_id, 10) == 0, F.lit(False))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in (docs.columns if keep is None else keep)]).alias("row"),
                       F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("body"), flag.alias("held"))
    folder = scratch_dir(spark, "ctw")
    group_rows(rows, buckets).write.partitionBy("kind").option("compression", "zstd").parquet(f"{folder}/parts")
    schema = _PARTS % packs.schema["row"].dataType.simpleString()
    parts = spark.read.schema(schema).parquet(f"{folder}/parts")
    gram = parts.filter("kind = 'gram'").select("grp", "bucket", "keys", "counts")
    word = parts.filter("kind = 'word'").select("grp", "bucket", "keys", "counts")
    text_rows = parts.filter("kind = 'text'").select("grp", "rows", "held", "lengths", "texts")

    # totals of grams, dealt by context
    def totals(table: pa.Table) -> pa.Table:
        keys, counts = _sum_blocks(table)
        return pa.table(_deal(keys, counts, _places(keys, buckets)))

    tree_rows = (gram.groupBy("bucket").applyInArrow(totals, "bucket int, keys binary, counts binary")
                 .checkpoint())

    def sums(table: pa.Table) -> pa.Table:
        node, zeros, ones, block = Tree(*_sum_blocks(table)).upper_sums()
        return pa.table({"node": node.astype(np.int64), "zeros": zeros, "ones": ones, "block": block})

    upper_rows = (tree_rows.groupBy("bucket").applyInArrow(sums, "node long, zeros long, ones long, block double")
                  .groupBy("node").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"),
                                       F.sum("block").alias("block")).toArrow().sort_by("node"))
    upper = spark.sparkContext.broadcast(Upper(
        upper_rows["node"].to_numpy().astype(np.uint64), upper_rows["zeros"].to_numpy(),
        upper_rows["ones"].to_numpy(), upper_rows["block"].to_numpy()))

    def predict(table: pa.Table) -> pa.Table:
        keys, counts = _sum_blocks(table)
        logs = Tree(keys, counts).log10(upper.value).astype(np.float32)
        return pa.table(_deal(keys, logs, _bucket(keys, buckets)))

    model = tree_rows.groupBy("bucket").applyInArrow(predict, "bucket int, keys binary, counts binary")

    def answer_grams(asked: pa.Table, known: pa.Table) -> pa.Table:
        keys = np.concatenate([unpack_keys(x) for x in known.column("keys").to_pylist()])
        logs = np.concatenate([unpack(x, np.float32) for x in known.column("counts").to_pylist()])
        order = np.argsort(keys)
        keys, logs = keys[order], logs[order]
        found = [pack(logs[np.searchsorted(keys, unpack_keys(x))]) for x in asked.column("keys").to_pylist()]
        return pa.table({"grp": asked.column("grp"), "keys": asked.column("keys"), "found": pa.array(found, pa.binary())})

    grams = (gram.drop("counts").groupBy("bucket").cogroup(model.groupBy("bucket"))
             .applyInArrow(answer_grams, "grp long, keys binary, found binary"))

    # totals of words, answered at once
    def answer_words(table: pa.Table) -> pa.Table:
        keys, counts = _sum_blocks(table)
        distinct, total = int((counts > 0).sum()), int(counts.sum())
        n = table.num_rows
        found = [pack(counts[np.searchsorted(keys, unpack_keys(x))]) for x in table.column("keys").to_pylist()]
        first = np.arange(n) == 0
        return pa.table({"grp": table.column("grp"), "keys": table.column("keys"), "found": pa.array(found, pa.binary()),
                         "distinct": np.where(first, distinct, 0), "total": np.where(first, total, 0)})

    (word.groupBy("bucket").applyInArrow(answer_words, "grp long, keys binary, found binary, distinct long, total long")
     .write.option("compression", "zstd").parquet(f"{folder}/words"))
    words = spark.read.parquet(f"{folder}/words")
    size = words.agg(F.coalesce(F.sum("distinct"), F.lit(0)).alias("v"), F.coalesce(F.sum("total"), F.lit(0)).alias("n")).first()

    answers = (grams.select("grp", F.lit("gram").alias("kind"), "keys", "found")
               .union(words.select("grp", F.lit("word").alias("kind"), "keys", "found")))
    row_type = packs.schema["row"].dataType.simpleString()

    def finish(texts: pa.Table, known: pa.Table) -> pa.Table:
        kinds = np.array(known.column("kind").to_pylist())
        lookups = {}
        for kind, number in (("gram", np.float32), ("word", np.int64)):
            own = known.filter(pa.array(kinds == kind))
            lookups[kind] = Lookup(
                np.concatenate([unpack_keys(x) for x in own.column("keys").to_pylist()]),
                np.concatenate([unpack(x, number) for x in own.column("found").to_pylist()]))
        out = {"row": [], "held_out": [], "n_tokens": [], "n_known": [], "logs": [], "n_bytes": [], "score": []}
        for batch in texts.to_batches():
            for i in range(batch.num_rows):
                own = _texts(batch.column("lengths")[i].as_py(), batch.column("texts")[i].as_py())
                out["row"].append(batch.column("rows").slice(i, 1).flatten())
                out["held_out"].append(batch.column("held").slice(i, 1).flatten())
                out["n_bytes"].append(np.array([len(t) + 1 for t in own], np.int64))
                for run in _runs(own):
                    keys, first = gram_keys(own[run])
                    out["score"].append(np.add.reduceat(lookups["gram"](keys).astype(np.float64), first))
                    keys, first = word_keys(own[run])
                    c = lookups["word"](keys)
                    out["n_tokens"].append(np.diff(np.append(first, len(keys))))
                    out["n_known"].append(np.add.reduceat((c > 0).astype(np.int64), first))
                    out["logs"].append(np.add.reduceat(np.log10(c + 0.1), first))
        return pa.table({k: pa.concat_arrays(v) if k in ("row", "held_out") else np.concatenate(v) for k, v in out.items()})

    done = text_rows.groupBy("grp").cogroup(answers.groupBy("grp")).applyInArrow(
        finish, f"row {row_type}, held_out boolean, n_tokens long, n_known long, logs double, n_bytes long, score double")
    scale = float(np.log10(size.n + 0.1 * (size.v + 1)))
    return done.select("row", "held_out", "n_tokens", "n_known", F.lit(int(size.n)).cast("long").alias("train_tokens"),
                       (F.col("logs") - F.col("n_tokens") * F.lit(scale)).alias("base_score"), "n_bytes", "score",
                       (-F.col("score") * F.lit(float(np.log2(10))) / F.col("n_bytes")).alias("code_length_per_byte"))
