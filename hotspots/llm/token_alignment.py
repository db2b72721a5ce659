"""Cross-tokenizer alignment through sparse incidence products.

A text is encoded by two tokenizers: A, a byte-level BPE (``tokenizers`` file),
sees a space and the text; B, a ``sentencepiece`` model, sees the text and adds
that space. Each tokenizer gives an incidence matrix, one row per token and one
column per byte, held as hand-built CSR (``Csr``). Gustavson's row product
A·Bᵀ yields the overlap links: token pairs and the number of bytes they share.
The overlap links whose tokens end at the same byte are the text's links; their
ends cut the tokens into groups. Token-by-group incidence matrices give the
shared-group links as the product G_A·G_Bᵀ: ``shared_links`` emits them in
blocks of rows, ``align`` needs only their number, G_A·(G_Bᵀ·1), so no group is
ever squared.

Neither tokenizer joins bytes across a space between two characters that are
not white space: there a text is cut into segments, and what is known about
recent segments is remembered (at most ``CACHE`` of them), so a common word is
encoded and multiplied once per task and not once per occurrence.

Corpus counts: two ids whose tokens end together are suffixes of one another, so
there are at most as many different pairs as the two vocabularies have bytes.
The table of pair counts is bounded by that, whatever the corpus, and may be
broadcast; counting is a partially aggregated sum over each text's distinct
pairs.

Defined results: a null or empty text, and one whose joined tokens of either
side are not the space and the text byte by byte (U+2581 in the text, which B
reads as a space), has no tokens: zeros, an empty group list and digest. Very
long texts are read whole, a run of characters without a cut at a time; repeated
rows count as often as they occur; a null id is passed on; an empty table gives
an empty result; columns other than the text and those kept are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hotspots.llm.batches import packed, slices
from hotspots.session import scratch_dir

#: Segments a worker remembers, and the longest (characters) that it does.
CACHE = 400_000
CACHED_LENGTH = 64
#: Text bytes aligned at a time, and rows of a product held at a time.
SLICE = 1 << 20
ROWS = 1 << 16
#: Largest tokenizer file that is sent to the executors.
MODEL_BYTES = 64 << 20
_SPACE = "▁"

#: The pre-tokenizer of byte-level BPE files, and white space beside blank and line feed.
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_RARE = [c for c in map(chr, range(0x3001)) if (c.isspace() and c not in " \n") or c == "\u180e"]
_CUT = re.compile(r"(?<=[^\s\u180e]) (?=[^\s\u180e])")
#: Characters below this one mean the same to every Unicode version's tables.
_SETTLED = "\u0250"


def segments(text: str) -> list[str]:
    """The text cut at each space between two characters that are not white
    space; the cutting spaces are left out, joined by them the parts are the text."""
    plain = not (text[0] in " \n" or text[-1] in " \n" or "  " in text or " \n" in text or "\n " in text
                 or any(c in text for c in _RARE))
    return text.split(" ") if plain else _CUT.split(text)


@dataclass
class Csr:
    """Sparse matrix of counts: the columns of row i are
    ``columns[start[i]:start[i + 1]]``, ``values`` beside them."""

    start: np.ndarray
    columns: np.ndarray
    values: np.ndarray
    width: int

    @classmethod
    def of_spans(cls, begin: np.ndarray, end: np.ndarray, width: int) -> "Csr":
        """One row per span [begin, end), a one in each of its columns."""
        start = np.concatenate([[0], np.cumsum(end - begin)])
        columns = np.arange(start[-1]) - np.repeat(start[:-1] - begin, end - begin)
        return cls(start, columns, np.ones(len(columns), np.int64), width)

    @classmethod
    def of_labels(cls, labels: np.ndarray, width: int) -> "Csr":
        """One row per label, a single one in its column."""
        return cls(np.arange(len(labels) + 1), labels, np.ones(len(labels), np.int64), width)

    def transposed(self) -> "Csr":
        """Rows and columns exchanged, by a counting sort of the columns."""
        rows = np.repeat(np.arange(len(self.start) - 1), np.diff(self.start))
        order = np.argsort(self.columns, kind="stable")
        start = np.concatenate([[0], np.cumsum(np.bincount(self.columns, minlength=self.width))])
        return Csr(start, rows[order], self.values[order], len(self.start) - 1)

    def row_sums(self, weight: np.ndarray | None = None) -> np.ndarray:
        """The product with a column vector (of ones)."""
        terms = self.values if weight is None else self.values * weight[self.columns]
        sums = np.concatenate([[0], np.cumsum(terms)])
        return sums[self.start[1:]] - sums[self.start[:-1]]

    def product(self, other: "Csr", rows: int = ROWS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Gustavson's product, ``rows`` rows at a time: (row, column, value) of
        the entries. Every entry (i, k) of this matrix fetches row k of the other
        one; equal (i, j) are added up."""
        for first in range(0, len(self.start) - 1, rows):
            last = min(first + rows, len(self.start) - 1)
            a, b = self.start[first], self.start[last]
            inner = self.columns[a:b]
            n = other.start[inner + 1] - other.start[inner]
            place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - other.start[inner], n)
            i = np.repeat(np.repeat(np.arange(first, last), np.diff(self.start[first:last + 1])), n)
            key = i * other.width + other.columns[place]
            value = np.repeat(self.values[a:b], n) * other.values[place]
            if len(key) > 1 and (key[1:] < key[:-1]).any():
                order = np.argsort(key, kind="stable")
                key, value = key[order], value[order]
            if len(key):
                head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
                key, value = key[head], np.add.reduceat(value, head)
            yield key // other.width, key % other.width, value


@dataclass
class Aligned:
    """What the products say about one buffer of bytes. ``ends_*``: byte ends of
    the tokens; ``cuts``: byte ends where both tokenizations end; ``link_a`` and
    ``link_b``: the tokens that end there; ``group_*``: the group of each token."""

    ends_a: np.ndarray
    ends_b: np.ndarray
    overlap_a: np.ndarray
    overlap_b: np.ndarray
    shared: np.ndarray
    cuts: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray
    group_a: np.ndarray
    group_b: np.ndarray

    def shared_links(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All (A token, B token) of the same group, a block of rows at a time."""
        g_a = Csr.of_labels(self.group_a, len(self.cuts))
        for i, j, _ in g_a.product(Csr.of_labels(self.group_b, len(self.cuts)).transposed()):
            yield i, j

    def shared_counts(self) -> np.ndarray:
        """Per A token, how many B tokens share its group."""
        g_b = Csr.of_labels(self.group_b, len(self.cuts))
        return Csr.of_labels(self.group_a, len(self.cuts)).row_sums(g_b.transposed().row_sums())


def aligned(lengths_a: np.ndarray, lengths_b: np.ndarray) -> Aligned:
    """Align two tokenizations of the same bytes, given the tokens' byte lengths."""
    ends_a, ends_b = np.cumsum(lengths_a), np.cumsum(lengths_b)
    width = int(ends_a[-1]) if len(ends_a) else 0
    a = Csr.of_spans(ends_a - lengths_a, ends_a, width)
    b = Csr.of_spans(ends_b - lengths_b, ends_b, width)
    parts = list(a.product(b.transposed())) or [(np.zeros(0, np.int64),) * 3]
    over_a, over_b, shared = (np.concatenate([p[k] for p in parts]) for k in range(3))
    together = ends_a[over_a] == ends_b[over_b]
    link_a, link_b = over_a[together], over_b[together]
    cuts = ends_a[link_a]
    return Aligned(ends_a, ends_b, over_a, over_b, shared, cuts, link_a, link_b,
                   np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b))


def _byte_level() -> dict[str, int]:
    """Character of a byte-level vocabulary -> byte: printable bytes stand for
    themselves, the others follow from U+0100 in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def merges_are_ranks(model_a: bytes) -> bool:
    """Whether A may be run as a table of ranks (``tiktoken``, several times as
    fast): merges make ascending ids, and every entry, encoded alone, is itself.
    Then two neighbours whose bytes form an entry are always that entry's merge:
    they come about inside its bytes alone as well, and there only this merge is
    left to complete it."""
    from tokenizers import Tokenizer

    about = json.loads(model_a)["model"]
    if about.get("dropout") or about.get("unk_token") or about.get("end_of_word_suffix"):
        return False
    vocab = about["vocab"]
    made = [vocab.get("".join(m if isinstance(m, list) else m.split(" ")), -1) for m in about["merges"]]
    bytewise = sorted(vocab[c] for c in _byte_level() if c in vocab)
    if made != sorted(set(made)) or len(bytewise) != 256 or made and made[0] <= bytewise[-1]:
        return False
    model = Tokenizer.from_str(model_a.decode()).model
    known = {*made, *bytewise}
    return all([t.id for t in model.tokenize(text)] == [i] for text, i in vocab.items() if i in known)


class Pair:
    """Both tokenizers in one worker, and what it remembers of recent segments."""

    def __init__(self, model_a: bytes, model_b: bytes, ranked: bool = False):
        # the libraries' own threads would take cores that Spark counts on
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        about = json.loads(model_a)
        before = about["pre_tokenizer"] or {}
        if (before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True)
                or about["normalizer"] or about["post_processor"]):
            raise ValueError("A must be a byte-level BPE that neither normalises nor adds tokens")
        self.a = Tokenizer.from_str(model_a.decode())
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model_b)
        decoded = _byte_level()
        entries = self.a.get_vocab(with_added_tokens=True)
        added = {t.content for t in self.a.get_added_tokens_decoder().values()}
        self.bytes_a = [b""] * (max(entries.values()) + 1)
        for text, i in entries.items():
            self.bytes_a[i] = text.encode() if text in added else bytes(decoded[c] for c in text)
        self.bytes_b = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            self.bytes_b.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i)
                                else piece.replace(_SPACE, " ").encode())
        self.ranks = None
        if ranked:
            import tiktoken

            ranks = {x: i for i, x in enumerate(self.bytes_a) if x and i not in self.a.get_added_tokens_decoder()}
            self.ranks = tiktoken.Encoding("A", pat_str=_WORDS, mergeable_ranks=ranks, special_tokens={})
        self.length_a = np.array([len(x) for x in self.bytes_a], np.int64)
        self.length_b = np.array([len(x) for x in self.bytes_b], np.int64)
        self.names_a, self.names_b = _names(len(self.bytes_a)), _names(len(self.bytes_b))
        self.start()

    def start(self) -> None:
        """No segment: numbers, group texts, counts, and CSR of link keys."""
        self.known: dict[str, int] = {}
        self.groups: list[bytes] = []
        self.stats = np.zeros((0, 6), np.int64)
        self.links, self.at = np.zeros(0, np.int64), np.zeros(1, np.int64)
        self.hits = np.zeros(0, np.int64)
        self.fresh: list[tuple[np.ndarray, np.ndarray]] = []

    def forget(self) -> None:
        """Keep only segments seen several times, at most half of the memory."""
        if len(self.groups) <= CACHE and len(self.links) <= 8 * CACHE:
            return
        often = max(2, int(np.sort(self.hits)[-CACHE // 2]) + 1) if len(self.hits) >= CACHE else 2
        names = [s for s, i in self.known.items() if self.hits[i] >= often and len(s) <= CACHED_LENGTH]
        rows = np.array([self.known[s] for s in names], np.int64)
        self.groups = [self.groups[i] for i in rows.tolist()]
        self.known = dict(zip(names, range(len(names))))
        self.links = _gather(self.links, self.at, rows)
        self.stats, self.hits = self.stats[rows], np.zeros(len(rows), np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.stats[:, 2])])

    def learn(self, fresh: list[str]) -> None:
        """Encode and align new segments. Those without white space at their ends
        are encoded as one text."""
        joint, single = [], []
        for s in fresh:
            (single if not s or s[0].isspace() or s[-1].isspace() or _SPACE in s or "\u180e" in s
             else joint).append(s)
        for s in single:
            self._add([s])
        batch, size = [], 0
        for s in joint:
            batch.append(s)
            size += len(s)
            if size > 1 << 16:
                self._add(batch)
                batch, size = [], 0
        if batch:
            self._add(batch)
        if self.fresh:
            self.stats = np.concatenate([self.stats, *[x for x, _ in self.fresh]])
            self.links = np.concatenate([self.links, *[x for _, x in self.fresh]])
            self.at = np.concatenate([[0], np.cumsum(self.stats[:, 2])])
            self.hits = np.concatenate([self.hits, np.zeros(len(self.groups) - len(self.hits), np.int64)])
            self.fresh = []

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of both sides; None where either side's joined bytes are not the
        space and the text."""
        if not text or _SPACE in text:
            return None
        ids_a = self._encode_a(" " + text)
        ids_b = self.b.encode(text)
        raw = (" " + text).encode()
        if (b"".join(map(self.bytes_a.__getitem__, ids_a.tolist())) != raw
                or b"".join(map(self.bytes_b.__getitem__, ids_b)) != raw):
            return None
        return ids_a, np.array(ids_b, np.int64)

    def _encode_a(self, text: str) -> np.ndarray:
        """A's ids."""
        if self.ranks is None or not text.isascii() and max(text) >= _SETTLED:
            return np.array(self.a.encode(text, add_special_tokens=False).ids, np.int64)
        return self.ranks.encode_to_numpy(text, disallowed_special=()).astype(np.int64)

    def _add(self, parts: list[str]) -> None:
        """Remember segments that are encoded as one text."""
        ids = self.encode(" ".join(parts))
        if ids is None:
            if len(parts) > 1:
                for s in parts:
                    self._add([s])
                return
            self.known[parts[0]] = len(self.groups)
            self.groups.append(b"")
            self.fresh.append((np.array([[0, 0, 0, 0, 0, 1]]), np.zeros(0, np.int64)))
            return
        a, b = ids
        x = aligned(self.length_a[a], self.length_b[b])
        # a part's bytes: a space and itself
        ends = np.cumsum([len(s.encode()) + 1 for s in parts])
        of_a, of_b, of_cut = (np.searchsorted(e, ends, "right") for e in (x.ends_a, x.ends_b, x.cuts))
        per = lambda at: np.diff(at, prepend=0)
        over = np.bincount(np.searchsorted(ends, x.ends_a[x.overlap_a]), minlength=len(parts))
        shared = np.bincount(np.searchsorted(ends, x.ends_a), x.shared_counts(), len(parts)).astype(np.int64)
        self.fresh.append((np.stack([per(of_a), per(of_b), per(of_cut), over, shared, np.zeros(len(parts), np.int64)], 1),
                           a[x.link_a] * len(self.bytes_b) + b[x.link_b]))
        text, group_at = self._group_text(a, b, x)
        first = 0
        for s, last in zip(parts, group_at[of_cut].tolist()):
            self.known[s] = len(self.groups)
            self.groups.append(text[first:last - 1])
            first = last

    def _group_text(self, a: np.ndarray, b: np.ndarray, x: Aligned) -> tuple[bytes, np.ndarray]:
        """All groups, each as ``a1,a2|b1;``, and where the text of each begins (and the last ends)."""
        last_a, last_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
        last_a[x.link_a], last_b[x.link_b] = True, True
        mark = np.concatenate([np.where(last_a, ord("|"), ord(",")), np.where(last_b, ord(";"), ord(","))])
        letters = np.concatenate([self.names_a[a], self.names_b[b]])
        letters[:, -1] = mark
        group = np.concatenate([x.group_a, x.group_b])
        order = np.argsort(group * 2 + np.repeat([0, 1], [len(a), len(b)]), kind="stable")
        letters = letters[order]
        used = letters > 0
        sizes = np.bincount(group[order], used.sum(1), len(x.cuts)).astype(np.int64)
        return letters[used].tobytes(), np.concatenate([[0], np.cumsum(sizes)])

    def texts(self, texts: list[str]) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray, np.ndarray]:
        """For a slice of texts: counts per text (a, b, groups = links, overlaps,
        shared, bad), group lists, and the distinct link keys (a id times B's
        size plus b id) of all texts with their offsets and counts."""
        self.forget()
        parts = [segments(t) if t else [] for t in texts]
        every = [s for p in parts for s in p]
        fresh = [s for s in dict.fromkeys(every) if s not in self.known]
        self.learn(fresh)
        at = list(map(self.known.__getitem__, every))
        index = np.array(at, np.int64)
        self.hits += np.bincount(index, minlength=len(self.hits))
        offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
        sums = np.concatenate([np.zeros((1, 6), np.int64), np.cumsum(self.stats[index], 0)])
        stats = sums[offsets[1:]] - sums[offsets[:-1]]
        good = stats[:, 5] == 0
        stats[~good] = 0
        groups = []
        for d, ok in enumerate(good.tolist()):
            groups.append(b";".join(map(self.groups.__getitem__, at[offsets[d]:offsets[d + 1]] if ok else [])))
        doc = np.repeat(np.arange(len(texts)), np.diff(offsets))
        index, doc = index[good[doc]], doc[good[doc]]
        n = self.at[index + 1] - self.at[index]
        span = len(self.bytes_a) * len(self.bytes_b)
        keys, counts = np.unique(np.repeat(doc, n) * span + _gather(self.links, self.at, index), return_counts=True)
        sizes = np.bincount(keys // span, minlength=len(texts))
        for s in fresh:
            if len(s) > CACHED_LENGTH:
                self.groups[self.known.pop(s)] = b""
        return stats, groups, np.concatenate([[0], np.cumsum(sizes)]), keys % span, counts


def _gather(values: np.ndarray, start: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The values of the given CSR rows, one after the other."""
    n = start[rows + 1] - start[rows]
    return values[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - start[rows], n)]


def _names(n: int) -> np.ndarray:
    """Decimal digits of 0 .. n - 1, a row each, zero bytes before them and one behind."""
    width = len(str(max(1, n - 1)))
    number = np.arange(n)
    power = 10 ** np.arange(width - 1, -1, -1)
    digits = (number[:, None] // power % 10 + ord("0")).astype(np.uint8)
    digits[(number[:, None] < power) & (power > 1)] = 0
    return np.concatenate([digits, np.zeros((n, 1), np.uint8)], 1)


_PAIRS: dict[tuple, Pair] = {}


def _model(path: str) -> bytes:
    if os.path.getsize(path) > MODEL_BYTES:
        raise ValueError(f"tokenizer file over {MODEL_BYTES} bytes")
    with open(path, "rb") as f:
        return f.read()


def align(spark: SparkSession, docs: DataFrame, path_a: str, path_b: str, text: str = "text",
          keep: list[str] | None = None, group_texts: bool = False) -> DataFrame:
    """``row`` (the columns ``keep``, default all), n_a, n_b, n_groups, n_links,
    n_overlaps (overlap links), n_shared (shared-group links), groups_sha256,
    ``links``: the distinct pairs (a, b) of ids whose tokens end together, with
    n, how often; with ``group_texts`` also ``groups``, the list that
    groups_sha256 digests. The tokenizer files are read on the driver."""
    model_a = _model(path_a)
    sent = spark.sparkContext.broadcast((model_a, _model(path_b), merges_are_ranks(model_a)))
    rows = packed(docs, text, keep)
    link = T.ArrayType(T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.IntegerType()),
                                     T.StructField("n", T.LongType())]))
    schema = rows.select("row").schema
    for name in ("n_a", "n_b", "n_groups", "n_links", "n_overlaps", "n_shared"):
        schema = schema.add(name, "long")
    schema = schema.add("groups_sha256", "string").add("links", link)
    if group_texts:
        schema = schema.add("groups", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = tuple(hashlib.sha256(m).digest() for m in sent.value[:2])
        pair = _PAIRS.get(name)
        if pair is None:
            _PAIRS.clear()
            pair = _PAIRS[name] = Pair(*sent.value)
        for batch, raw in slices(batches, "body", SLICE):
            stats, groups, offsets, keys, counts = pair.texts([t.decode() for t in raw])
            links = pa.ListArray.from_arrays(
                pa.array(offsets, pa.int32()),
                pa.StructArray.from_arrays([pa.array(keys // len(pair.bytes_b), pa.int32()),
                                            pa.array(keys % len(pair.bytes_b), pa.int32()),
                                            pa.array(counts, pa.int64())], ["a", "b", "n"]))
            digests = [hashlib.sha256(g).hexdigest() if g else "" for g in groups]
            out = [batch.column("row"), *[pa.array(stats[:, k]) for k in (0, 1, 2, 2, 3, 4)], pa.array(digests), links]
            if group_texts:
                out.append(pa.array([g.decode() for g in groups]))
            yield pa.RecordBatch.from_arrays(out, names=schema.names)

    return rows.mapInArrow(run, schema)


def pair_counts(alignments: DataFrame) -> DataFrame:
    """(a, b, count, best) of every linked id pair: how many links hold it, and
    whether no pair of the same ``b`` has more. Bounded by the vocabularies' bytes."""
    counts = (alignments.select(F.explode("links").alias("l")).groupBy("l.a", "l.b")
              .agg(F.sum("l.n").alias("count")))
    top = counts.groupBy("b").agg(F.max("count").alias("top"))
    return counts.join(top, "b").select("a", "b", "count", (F.col("count") == F.col("top")).alias("best"))


def score_links(spark: SparkSession, docs: DataFrame, path_a: str, path_b: str, text: str = "text",
                keep: list[str] | None = None) -> DataFrame:
    """``align`` without the links, plus n_best (links whose pair's count is the
    highest of its B id) and count_sum (the sum of the pairs' counts over the
    links). The alignments are written once to the shared scratch folder and
    read by the counting and by the scoring."""
    folder = scratch_dir(spark, "alignment")
    (align(spark, docs, path_a, path_b, text, keep).withColumn("_key", F.monotonically_increasing_id())
     .write.option("compression", "zstd").parquet(f"{folder}/texts"))
    texts = spark.read.parquet(f"{folder}/texts")
    pair_counts(texts).write.parquet(f"{folder}/pairs")
    pairs = spark.read.parquet(f"{folder}/pairs")
    each = texts.select("_key", F.explode("links").alias("l")).select("_key", "l.a", "l.b", "l.n")
    sums = (each.join(F.broadcast(pairs), ["a", "b"]).groupBy("_key")
            .agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"),
                 F.sum(F.col("n") * F.col("count")).alias("count_sum")))
    return (texts.drop("links").join(sums, "_key", "left").drop("_key")
            .fillna(0, ["n_best", "count_sum"]))
