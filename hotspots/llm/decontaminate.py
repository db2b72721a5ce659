"""Benchmark decontamination by Wu-Manber multi-pattern search.

A benchmark item gives one window per run of 13 consecutive words (an item of
fewer words is one window). Texts and windows are normalised to lower-case
words joined by single spaces with a space at either end, so a window occurs
where its bytes occur. Windows of similar length form one matcher:

* a shift table over hashed blocks of ``block`` bytes says how far the search
  position may jump when the block before it ends no window;
* a zero shift leads to the suffix-hash bucket of the windows that end in that
  block, whose first bytes are compared;
* what is left is confirmed by direct comparison.

All positions of a text buffer advance together (numpy lanes), each lane by
its own shift. The tables are built once, on the driver, from blocks of the
benchmark of bounded size (``PATTERN_BYTES`` of item text), and sent to the
tasks as arrays: one pass over the documents searches for up to ``PASS_BLOCKS``
blocks, and only a larger benchmark needs a further pass. Nothing is shuffled.

Defined results: null texts and texts without words have no hits; an item
without words has no window; a null item id counts as an item with an empty
id; repeated items and repeated documents are each reported as they are; an
empty benchmark leaves every document clean; columns other than the ids and
texts are ignored. Words and windows may be of any length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hotspots.llm.batches import packed, slices

WINDOW = 13
#: Bytes of benchmark text in one block (or a single longer item), and blocks
#: that one pass over the documents searches for.
PATTERN_BYTES = 4 << 20
PASS_BLOCKS = 6
_TABLE_BITS = (16, 22)
_FAR = (1 << 16) - 1
_LANE = 1 << 11

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
              for c in range(256))
_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def words(text: bytes) -> list[bytes]:
    """Runs of ASCII digits, letters (lower-cased) and all non-ASCII characters."""
    return text.translate(_FOLD).split()


@dataclass
class Matcher:
    """Shift table and suffix buckets of the patterns ``first`` to ``last`` - 1,
    whose length is at least ``shortest``."""

    shortest: int
    block: int
    shift: np.ndarray
    suffixes: np.ndarray
    order: np.ndarray

    @classmethod
    def build(cls, view: np.ndarray, which: np.ndarray, start: np.ndarray, end: np.ndarray) -> "Matcher":
        """Matcher of the patterns ``which``; pattern i is the bytes from
        ``start[i]`` to ``end[i]`` of the buffer behind ``view``."""
        shortest = int((end[which] - start[which]).min())
        block = max(2, min(16, shortest // 2))
        bits = min(_TABLE_BITS[1], max(_TABLE_BITS[0], (4 * len(which)).bit_length()))
        # a jump shorter than possible is never wrong, so large ones may be cut to the type
        table = np.full(1 << bits, min(shortest - block + 1, _FAR), np.uint16)
        # the table speaks of the last ``shortest`` bytes of each pattern; the
        # larger shifts are entered first, so that the smallest one stays
        for back in range(shortest - block, -1, -1):
            for i in range(0, len(which), 1 << 18):
                codes = _codes(view, end[which[i:i + (1 << 18)]] - back, block)
                table[codes >> np.uint64(64 - bits)] = min(back, _FAR)
        suffixes = _codes(view, end[which], block)
        order = np.argsort(suffixes, kind="stable")
        return cls(shortest, block, table, suffixes[order], which[order])

    def candidates(self, view: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(end position, place of the first pattern of its bucket) wherever the
        block before a position of a text of ``n`` bytes ends a pattern."""
        m = self.shortest
        pos = np.arange(m, n + 1, _LANE)
        stop = np.minimum(pos + _LANE, n + 1)
        ends, places = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        shift_bits = np.uint64(64 - (len(self.shift).bit_length() - 1))
        while len(pos):
            codes = _codes(view, pos, self.block)
            step = self.shift[codes >> shift_bits]
            at = np.flatnonzero(step == 0)
            if len(at):
                low = np.searchsorted(self.suffixes, codes[at])
                known = low < len(self.suffixes)
                known[known] = self.suffixes[low[known]] == codes[at][known]
                ends.append(pos[at[known]])
                places.append(low[known])
            pos = pos + np.maximum(step, 1)
            live = pos < stop
            if not live.all():
                pos, stop = pos[live], stop[live]
        return np.concatenate(ends), np.concatenate(places)


def _codes(view: np.ndarray, ends: np.ndarray, block: int) -> np.ndarray:
    """Hash of the ``block`` bytes before each end position."""
    start = ends - block
    low, high = (np.uint64((1 << (8 * k)) - 1) for k in (min(8, block), max(0, block - 8)))
    h = (view[start] & low) * _K1
    if block > 8:
        h ^= (view[start + 8] & high) * _K2
    h ^= h >> np.uint64(29)
    return h * _K1


def _view(text: bytes) -> np.ndarray:
    """The eight bytes from every position, as little-endian integers."""
    padded = text + b"\0" * 16
    return np.ndarray(shape=(len(text) + 8,), dtype="<u8", buffer=padded, strides=(1,))


class Search:
    """All different windows of a block of items, as spans of one buffer of the
    items' normalised texts, and the items of each (CSR). Built once, on the
    driver; tasks receive its arrays."""

    def __init__(self, items: list[tuple[str | None, bytes]]):
        self.names = sorted({"" if i is None else i for i, _ in items})
        number = {name: k for k, name in enumerate(self.names)}
        known: dict[bytes, int] = {}
        parts, start, end, owner = [], [], [], []
        at = 0
        for item_id, text in items:
            found = words(text)
            if not found:
                continue
            line = b" " + b" ".join(found) + b" "
            edge = [0, *accumulate(len(w) + 1 for w in found)]  # the space before each word
            size = min(WINDOW, len(found))
            own = number["" if item_id is None else item_id]
            for a, b in zip(edge, edge[size:]):
                k = known.setdefault(line[a:b + 1], len(start))
                if k == len(start):
                    start.append(at + a)
                    end.append(at + b + 1)
                owner.append((k, own))
            parts.append(line)
            at += len(line)
        del known
        self.buffer = b"".join(parts)
        self.start, self.end = np.array(start, np.int64), np.array(end, np.int64)
        pairs = np.unique(np.array(owner, np.int64).reshape(-1, 2), axis=0)
        self.owner_at = np.searchsorted(pairs[:, 0], np.arange(len(start) + 1))
        self.owner = pairs[:, 1]
        # similar lengths meet in one matcher: under 32 bytes by powers of two, and all others
        size = np.minimum(6, np.frexp((self.end - self.start).astype(np.float64))[1])
        view = _view(self.buffer)
        self.matchers = [Matcher.build(view, np.flatnonzero(size == k), self.start, self.end) for k in np.unique(size)]

    def hits(self, texts: list[list[bytes]]) -> Iterator[tuple[int, list[tuple[int, int]], set[str]]]:
        """(text index, byte spans hit, item ids) for texts with an occurrence.
        The texts are searched as one buffer; a zero byte keeps them apart."""
        parts = [b" " + b" ".join(w) + b" " for w in texts]
        starts = np.cumsum([0] + [len(p) + 1 for p in parts])
        text = b"\0".join(parts)
        view = _view(text)
        spans: dict[int, list[tuple[int, int]]] = {}
        items: dict[int, set[str]] = {}
        for matcher in self.matchers:
            for stop, k in self._occurrences(matcher, text, view):
                begin = stop - int(self.end[k] - self.start[k])
                doc = int(np.searchsorted(starts, begin, "right")) - 1
                spans.setdefault(doc, []).append((begin - int(starts[doc]), stop - int(starts[doc])))
                items.setdefault(doc, set()).update(
                    self.names[i] for i in self.owner[self.owner_at[k]:self.owner_at[k + 1]].tolist())
        for doc in sorted(spans):
            yield doc, spans[doc], items[doc]

    def _occurrences(self, matcher: Matcher, text: bytes, view: np.ndarray) -> Iterator[tuple[int, int]]:
        """(end position, pattern) of every occurrence: the patterns of a suffix
        bucket are compared, their first bytes first."""
        for stop, place in zip(*(x.tolist() for x in matcher.candidates(view, len(text)))):
            code = matcher.suffixes[place]
            while place < len(matcher.suffixes) and matcher.suffixes[place] == code:
                k = int(matcher.order[place])
                a, b = int(self.start[k]), int(self.end[k])
                begin = stop - (b - a)
                if begin >= 0 and text.startswith(self.buffer[a:min(b, a + 8)], begin) and text.startswith(self.buffer[a:b], begin):
                    yield stop, k
                place += 1


def merge(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted ranges [first, last) without overlap."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def hit_words(word_list: list[bytes], spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Merged ranges of word numbers covered by byte spans of the joined text."""
    starts = np.cumsum([1] + [len(w) + 1 for w in word_list])
    return merge([(int(np.searchsorted(starts, a + 1)), int(np.searchsorted(starts, b))) for a, b in spans])


def item_blocks(benchmark: DataFrame, item_id: str = "item_id", text: str = "text",
                block_bytes: int = PATTERN_BYTES) -> Iterator[list[tuple[str | None, bytes]]]:
    """The benchmark in blocks of bounded text size, one block in memory at a time."""
    rows = benchmark.select(F.col(f"`{item_id}`").cast("string"),
                            F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")))
    block: list[tuple[str | None, bytes]] = []
    size = 0
    for i, t in rows.toLocalIterator():
        raw = t.encode()
        if block and size + len(raw) > block_bytes:
            yield block
            block, size = [], 0
        block.append((i, raw))
        size += len(raw)
    if block:
        yield block


def find_hits(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, text: str = "text",
              keep: list[str] | None = None, block_bytes: int = PATTERN_BYTES,
              pass_blocks: int = PASS_BLOCKS) -> DataFrame:
    """The columns ``keep`` of ``docs`` (default: all) in the struct ``row``,
    plus n_words, hit_ranges (merged ranges [first, last) of word numbers) and
    item_ids (sorted). Each further pass reads what the one before it found
    from the checkpoint folder."""
    rows = packed(docs, text, keep).select(
        "row", "body", F.lit(0).cast("long").alias("n_words"),
        F.array().cast("array<struct<first:int,last:int>>").alias("hit_ranges"),
        F.array().cast("array<string>").alias("item_ids"))
    blocks = item_blocks(benchmark, block_bytes=block_bytes)
    some = list(islice(blocks, pass_blocks)) or [[]]
    while some:
        following = list(islice(blocks, pass_blocks))
        sent = [spark.sparkContext.broadcast(Search(block)) for block in some]
        rows = rows.mapInArrow(_task(sent, bool(following)), rows.schema if following else rows.drop("body").schema)
        if following:
            rows = rows.checkpoint()
        some = following
    return rows


def _task(sent: list, keep_body: bool):
    range_type = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searches = [s.value for s in sent]
        for batch, texts in slices(batches, "body"):
            lists = [words(t) for t in texts]
            ranges = [[(r["first"], r["last"]) for r in x] for x in batch.column("hit_ranges").to_pylist()]
            items = [set(x) for x in batch.column("item_ids").to_pylist()]
            for search in searches:
                for doc, spans, ids in search.hits(lists):
                    ranges[doc] = merge(ranges[doc] + hit_words(lists[doc], spans))
                    items[doc] |= ids
            out = {"row": batch.column("row"), "body": batch.column("body"),
                   "n_words": pa.array(list(map(len, lists)), pa.int64()),
                   "hit_ranges": pa.array([[{"first": a, "last": b} for a, b in x] for x in ranges], range_type),
                   "item_ids": pa.array([sorted(x) for x in items], pa.list_(pa.string()))}
            if not keep_body:
                del out["body"]
            yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    return run


def judge(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, text: str = "text",
          keep: list[str] | None = None) -> DataFrame:
    """``find_hits`` plus n_hit and contaminated (a twentieth or more of the words hit)."""
    found = find_hits(spark, docs, benchmark, text, keep)
    n_hit = F.aggregate("hit_ranges", F.lit(0).cast("long"),
                        lambda acc, r: acc + (r["last"] - r["first"]))
    return (found.withColumn("n_hit", n_hit)
            .withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))))

