"""Spelling variants by reduced-alphabet neighbourhoods.

``vocabulary`` counts the words of all documents. ``near_pairs`` finds every two
of them that differ by one inserted, deleted or replaced letter:

* every letter is hashed to one of ``SYMBOLS`` symbols; a word becomes a reduced
  word, known by a 64-bit polynomial hash of its symbols;
* the one-edit neighbourhood of each reduced word - itself, all its deletions,
  all its replacements, all its insertions - is joined with the reduced
  vocabulary. A replacement by a higher symbol and an insertion are seen from
  the other word as a replacement by a lower one and a deletion, so every word
  generates only the lower half and no pair is missed;
* candidates are verified on the original words (edit distance one).

The hash of a neighbour follows from the word's prefix hashes, so a word of n
letters costs n times the symbols, never n strings of n letters. Neighbours that
are no reduced word are mostly dropped before the join, by a bitmap of the
reduced vocabulary of bounded size. Long words (over ``CARRIED`` letters) are
joined among themselves by their hashes and fetched for the verification.

A reduced word that more than ``BUCKET`` words share is hot: its words are left
out of that join and meet their neighbours in a second one in which every letter
is a symbol of its own, which proposes true neighbours only. The finer symbols
refine the coarser ones and keep their order, so both joins agree on which word
of a pair generates it. No bucket is capped.

``variants`` picks each word's form (the near word of largest count, if that is
at least twice the word's own) and follows forms to the root by pointer
doubling. Counts at least double along a chain, so it has no circle and few
rounds; each is checkpointed.

Defined results: a null text has no words; a null id counts as an empty id; very
long texts and words are read whole; repeated rows count as often as they occur;
ties between near words go to the smaller word in code-point order; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hotspots.operators.joins import broadcast_if_small
from hotspots.session import scratch_dir

RUNS = "[A-Za-zÀ-ÿ]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LETTERS = [*map(ord, _LOWER), *range(0xC0, 0x100)]
SYMBOLS = 8
#: Words that may share a reduced word in the first join; letters up to which a row carries its word.
BUCKET = 1000
CARRIED = 64
#: Bits (as a power of two) of the largest bitmap of present keys: 128 MB.
MAP_BITS = 30
#: Letters whose neighbours are generated at a time (or one longer word).
SLICE = 1 << 16
_BASE = 0x9E3779B97F4A7C15
_INVERSE = np.uint64(pow(_BASE, -1, 1 << 64))


def lower_ascii(c: Column) -> Column:
    """A-Z in lower case, other letters as they are."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, _UPPER, _LOWER))


def words(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", modulus: int = 97) -> DataFrame:
    """``word``: one row per letter run of every text, lower-cased; a run whose
    crc32 with the document's id is a multiple of ``modulus`` lacks one letter."""
    runs = docs.select(F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("")).alias("id"),
                       F.explode(F.regexp_extract_all(F.col(f"`{text}`").cast("string"), F.lit(RUNS), F.lit(0))).alias("run"))
    low = runs.select("id", lower_ascii(F.col("run")).alias("run"))
    hashed = low.select("run", F.crc32(F.concat_ws(":", "id", "run").cast("binary")).alias("h"))
    return hashed.select(F.expr(f"""CASE WHEN h % {modulus} = 0
        THEN concat(left(run, CAST(h % length(run) AS INT)), substring(run, CAST(h % length(run) AS INT) + 2))
        ELSE run END""").alias("word"))


def vocabulary(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", letters: int = 5,
               least: int = 3) -> DataFrame:
    """(word, n) of the words of at least ``letters`` letters that occur at least
    ``least`` times; counts are partially aggregated."""
    return (words(docs, doc_id, text).filter(F.length("word") >= letters).groupBy("word")
            .agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least))


def _symbol_table(symbols: int) -> np.ndarray:
    """Symbol (from 1) of every letter's byte in Latin-1: letters in the order of
    a hash, cut into ``symbols`` runs. More symbols refine fewer and keep their order."""
    table = np.zeros(256, np.uint8)
    order = sorted(LETTERS, key=lambda c: (zlib.crc32(b"letter %d" % c), c))
    for place, c in enumerate(order):
        table[c] = 1 + place * symbols // len(order)
    return table


class Reduced:
    """Reduced words of a block of words, and the hashes of their neighbours."""

    def __init__(self, block: list[str], symbols: int):
        self.symbols = symbols
        raw = [w.encode("latin-1") for w in block]
        self.length = np.array([len(w) for w in raw], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.length)])
        self.owner = np.repeat(np.arange(len(raw)), self.length)
        self.symbol = _symbol_table(symbols)[np.frombuffer(b"".join(raw), np.uint8)].astype(np.uint64)
        place = np.arange(len(self.owner)) - self.start[self.owner]
        powers = np.full(self.length.max(initial=0) + 1, _BASE, np.uint64)
        powers[0] = 1
        powers = np.cumprod(powers)
        self.power = powers[place]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.symbol * self.power)])
        self.whole = sums[self.start[1:]] - sums[self.start[:-1]]
        self.before = sums[:-1] - sums[self.start[:-1]][self.owner]

    @staticmethod
    def _key(h: np.ndarray, length: np.ndarray) -> np.ndarray:
        h = h ^ (length.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return (h ^ (h >> np.uint64(32))).view(np.int64)

    def own(self) -> np.ndarray:
        """Key of every reduced word."""
        return self._key(self.whole, self.length)

    def lower(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(word number, key) of all deletions and of all replacements by a lower
        symbol, each once: a symbol that repeats the one before it is not
        deleted again."""
        own, s = self.owner, self.symbol
        behind = self.whole[own] - self.before - s * self.power
        again = np.zeros(len(s), bool)
        again[1:] = (s[1:] == s[:-1]) & (own[1:] == own[:-1])
        new = np.flatnonzero(~again)
        yield own[new], self._key((self.before + behind * _INVERSE)[new], self.length[own[new]] - 1)
        for t in range(1, self.symbols):
            at = np.flatnonzero(s > t)
            if len(at):
                changed = self.whole[own[at]] - (s[at] - np.uint64(t)) * self.power[at]
                yield own[at], self._key(changed, self.length[own[at]])


def _keyed(vocab: DataFrame, symbols: int, carry: bool, present=None) -> DataFrame:
    """Rows (key, own, id, word, n): each word under the key of its reduced word
    (``own``) and, given a bitmap of the present keys, under those of its lower
    neighbours that are among them. Without ``carry`` the id stands for the word."""
    rows = vocab.select("word", "n", F.xxhash64("word").alias("id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if present is None else np.frombuffer(present.value, np.uint8)
        for batch in batches:
            names = batch.column("word").to_pylist()
            sizes = np.cumsum([0, *map(len, names)])
            first = 0
            while first < len(names):
                last = max(first + 1, int(np.searchsorted(sizes, sizes[first] + SLICE, "right")) - 1)
                block = Reduced(names[first:last], symbols)
                part = batch.slice(first, last - first)

                def out(index, key, own):
                    index = pa.array(index)
                    word = part.column("word").take(index) if carry else pa.nulls(len(index), pa.string())
                    return pa.RecordBatch.from_arrays(
                        [pa.array(key), pa.array(np.full(len(key), own)), part.column("id").take(index), word,
                         part.column("n").take(index)], names=["key", "own", "id", "word", "n"])

                yield out(np.arange(last - first), block.own(), True)
                if bits is not None:
                    for index, key in block.lower():
                        slot = key & (8 * len(bits) - 1)
                        known = np.flatnonzero(bits[slot >> 3] >> (slot & 7) & 1)
                        yield out(index[known], key[known], False)
                first = last

    return rows.mapInArrow(run, "key long, own boolean, id long, word string, n long")


def _present(spark: SparkSession, keyed: DataFrame, words: int):
    """Broadcast bitmap of the keys of ``keyed``, by their low bits: about eight
    bits a word, at most ``2 ** MAP_BITS``. What it lets through by chance only
    finds no partner."""
    bits = min(MAP_BITS, max(15, (8 * words).bit_length()))
    slot = F.col("key").bitwiseAND(F.lit((1 << bits) - 1)) + 1
    parts = (keyed.groupBy(F.bitmap_bucket_number(slot).alias("at"))
             .agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("map")).toLocalIterator())
    out = bytearray(1 << (bits - 3))
    size = 1 << 12  # bytes of one bitmap
    for r in parts:
        out[(r["at"] - 1) * size:r["at"] * size] = bytes(r["map"])
    return spark.sparkContext.broadcast(bytes(out))


def _verified(vocab: DataFrame, left: DataFrame, right: DataFrame, carry: bool) -> DataFrame:
    """(a, n_a, b, n_b): words of equal keys at edit distance one."""
    found = (left.select("key", "own", F.col("id").alias("id_a"), F.col("word").alias("a"), F.col("n").alias("n_a"))
             .join(right.select("key", F.col("id").alias("id_b"), F.col("word").alias("b"), F.col("n").alias("n_b")), "key"))
    if carry:
        # two words of one reduced word meet twice; the greater one generates the pair
        found = found.filter(~F.col("own") | (F.col("a") > F.col("b")))
    else:
        names = vocab.select(F.xxhash64("word").alias("id"), "word", "n")
        found = (found.filter("id_a != id_b").select("id_a", "id_b").distinct()
                 .join(names.toDF("id_a", "a", "n_a"), "id_a").join(names.toDF("id_b", "b", "n_b"), "id_b"))
    return found.filter(F.levenshtein("a", "b", 1) == 1).select("a", "n_a", "b", "n_b")


def _near(vocab: DataFrame, symbols: int, bucket: int, carry: bool) -> DataFrame:
    spark = vocab.sparkSession
    every = len(LETTERS)
    count = vocab.count()
    right = _keyed(vocab, symbols, carry)
    left = _keyed(vocab, symbols, carry, _present(spark, right, count))
    hot = (right.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > bucket)
           .select("key").checkpoint())
    if hot.isEmpty():
        return _verified(vocab, left, right, carry)
    hot = broadcast_if_small(hot)
    ids = lambda rows: rows.join(hot, "key", "left_semi").select("id").distinct()
    of = lambda chosen: vocab.join(chosen, F.xxhash64("word") == F.col("id"), "left_semi")
    fine = _keyed(of(ids(right)), every, carry)
    return _verified(vocab, left, right.join(hot, "key", "left_anti"), carry).union(
        _verified(vocab, _keyed(of(ids(left)), every, carry, _present(spark, fine, count)), fine, carry))


def near_pairs(vocab: DataFrame, symbols: int = SYMBOLS, bucket: int = BUCKET) -> DataFrame:
    """(a, n_a, b, n_b): every two words of ``vocab`` at edit distance one, once.
    ``vocab`` (word, n) should be materialised."""
    found = _near(vocab.filter(F.length("word") <= CARRIED), symbols, bucket, True)
    # a near word of a long one has CARRIED letters or more itself
    long = vocab.filter(F.length("word") >= CARRIED)
    if not long.filter(F.length("word") > CARRIED).isEmpty():
        found = found.union(_near(long, symbols, bucket, False))
    a_first = F.col("a") < F.col("b")
    pick = lambda x, y, name: F.when(a_first, F.col(x)).otherwise(F.col(y)).alias(name)
    return found.select(pick("a", "b", "a"), pick("n_a", "n_b", "n_a"), pick("b", "a", "b"),
                        pick("n_b", "n_a", "n_b")).distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of every word of ``forms`` (word, form): the last word that
    following forms leads to. The paths double in length each round."""
    now = forms.select("word", F.col("form").alias("root")).checkpoint()
    while True:
        ahead = now.select(F.col("word").alias("_at"), F.col("root").alias("_next"))
        moved = now.join(ahead, F.col("root") == F.col("_at"), "left").select(
            "word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")).checkpoint()
        now = moved.drop("_moved")
        if moved.filter("_moved").isEmpty():
            return now


def variants(vocab: DataFrame, pairs: DataFrame) -> DataFrame:
    """``word``, ``form``, ``root``, ``n``, ``n_near`` and ``form_n`` of every word."""
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("near_n")).union(
        pairs.select("b", "a", "n_a"))
    best = (both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"),
                                     F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")))
    enough = -F.col("best.less") >= 2 * F.col("n")
    rows = (vocab.join(best, "word", "left")
            .select("word", F.when(enough, F.col("best.near")).alias("form"), "n",
                    F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                    F.when(enough, -F.col("best.less")).alias("form_n"))).checkpoint()
    last = roots(rows.filter(F.col("form").isNotNull()))
    return rows.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n",
                                                  "n_near", "form_n")


def group_variants(spark: SparkSession, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``variants`` of all words of ``docs``. Vocabulary and pairs are written once
    to the shared scratch folder."""
    folder = scratch_dir(spark, "variants")
    vocabulary(docs, doc_id, text).write.parquet(f"{folder}/words")
    vocab = spark.read.parquet(f"{folder}/words")
    near_pairs(vocab).write.parquet(f"{folder}/pairs")
    return variants(vocab, spark.read.parquet(f"{folder}/pairs"))
