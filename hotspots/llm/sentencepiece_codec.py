"""Offset-preserving SentencePiece (BPE) encoding and decoding.

The model file is parsed here: vocabulary, scores, and the compiled character
map (a double-array trie over UTF-8 prefixes followed by its replacement
texts). Normalisation walks a text by the longest prefix that the trie knows
and records, for every normalised character, the original byte where its
source begins; a prefix without a rule stands for itself. Encoding merges the
adjacent pair with the best score (leftmost on ties) until none is in the
vocabulary; characters outside it become byte pieces. Every piece is projected
through the alignment to a span of original bytes. A byte piece covers its
byte; where a character map is in force, the last byte piece of a character
carries the span of its source and the others are empty.

No vocabulary entry of a usual model holds a space mark after another
character, so merges never cross the start of a word: the normalised text is
cut there, and the pieces of recent words are remembered (at most twice
``CACHE`` words). A model that does hold such an entry is encoded without cuts.

Defined results: a null text is encoded as the empty one, which has no pieces
and decodes to the empty text; very long texts are encoded ``BLOCK`` words at
a time; repeated rows are encoded each; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from hotspots.llm.batches import packed, slices

#: Words whose pieces a worker remembers, and words encoded at a time.
CACHE = 300_000
BLOCK = 1 << 16
#: Largest model file that is sent to the executors.
MODEL_BYTES = 64 << 20

SPACE = "▁"
_NORMAL, _UNKNOWN, _USER, _BYTE = 1, 2, 4, 6


def _varint(b: bytes, i: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        out |= (b[i] & 127) << shift
        i, shift = i + 1, shift + 7
        if b[i - 1] < 128:
            return out, i


def _fields(b: bytes) -> Iterator[tuple[int, object]]:
    """(field number, value) of one protocol-buffer message."""
    i = 0
    while i < len(b):
        key, i = _varint(b, i)
        kind = key & 7
        if kind == 0:
            value, i = _varint(b, i)
        else:
            if kind == 2:
                n, i = _varint(b, i)
            else:
                n = 8 if kind == 1 else 4
            value, i = b[i:i + n], i + n
        yield key >> 3, value


class CharMap:
    """Compiled character map: longest known prefix and its replacement."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if blob else []
        self.texts = blob[4 + size:] if blob else b""

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """(length of the longest prefix of ``text[at:]`` with a rule, replacement)."""
        units = self.units
        if not units:
            return None
        node = _offset(units[0])
        best = None
        for i in range(at, len(text)):
            c = text[i]
            node ^= c
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != c:
                break
            node ^= _offset(unit)
            if unit >> 8 & 1:
                best = (i + 1 - at, units[node] & 0x7FFFFFFF)
        if best is None:
            return None
        return best[0], self.texts[best[1]:self.texts.index(b"\0", best[1])]


def _offset(unit: int) -> int:
    return (unit >> 10) << ((unit & 0x200) >> 6)


@dataclass
class Pieces:
    """Ids and original byte spans of consecutive pieces."""

    ids: np.ndarray
    begin: np.ndarray
    end: np.ndarray


class Codec:
    """Encoder and decoder of one model file."""

    def __init__(self, model: bytes):
        pieces, trainer, normalizer = [], {}, {}
        for number, value in _fields(model):
            if number == 1:
                pieces.append(dict(_fields(value)))
            elif number == 2:
                trainer |= dict(_fields(value))
            elif number == 3:
                normalizer |= dict(_fields(value))
        if trainer.get(3, 1) != 2:
            raise ValueError("only BPE models are supported")
        self.charmap = CharMap(normalizer.get(2, b""))
        self.dummy_prefix = bool(normalizer.get(3, 1))
        self.trim = bool(normalizer.get(4, 1))
        self.escape = bool(normalizer.get(5, 1))
        self.suffix_space = bool(trainer.get(24, 0))
        self.byte_fallback = bool(trainer.get(35, 0))
        if not self.escape or self.suffix_space:
            raise ValueError("models must escape white space and mark it before words")
        self.surface: list[bytes] = []
        self.ids: dict[str, int] = {}
        scores: dict[str, float] = {}
        self.byte_ids = [0] * 256
        self.unknown = 0
        for i, p in enumerate(pieces):
            text, kind = p.get(1, b"").decode(), p.get(3, _NORMAL)
            surface = text.replace(SPACE, " ").encode() if kind == _NORMAL else b""
            if kind == _NORMAL:
                self.ids[text] = i
                scores[text] = struct.unpack("<f", p[2])[0] if 2 in p else 0.0
            elif kind == _BYTE:
                self.byte_ids[int(text[3:5], 16)] = i
                surface = bytes([int(text[3:5], 16)])
            elif kind == _UNKNOWN:
                self.unknown = i
                surface = trainer.get(44, b" \xe2\x81\x87 ")
            elif kind == _USER or kind == 5:
                raise ValueError("models with user-defined or unused pieces are not supported")
            self.surface.append(surface)
        order = {s: r for r, s in enumerate(sorted(set(scores.values()), reverse=True))}
        self.rank = {t: order[s] for t, s in scores.items()}
        self.last = len(order)  # above every rank: no such piece
        self.byte_set = set(self.byte_ids) if self.byte_fallback else set()
        self.id_text = [b"%d" % i for i in range(len(pieces))]
        self.cuts = not any(re.search(f"[^{SPACE}]{SPACE}", t) for t in self.ids)
        #: nothing to normalise but white space: words can be cut from the raw bytes
        self.plain = (not self.charmap.units and not self.trim and self.dummy_prefix and self.cuts
                      and self.byte_fallback)
        self.inside = {t[i:i + 2] for t in self.ids for i in range(len(t) - 1)}
        self.lengths = np.array([len(x) for x in self.surface], np.int64)
        #: ids of remembered words; ``older`` holds the words of the last full memory
        self.cache: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    # -- normalisation -----------------------------------------------------

    def normalise(self, raw: bytes) -> tuple[str, list[int]]:
        """Normalised text, and for each of its characters (and its end) the
        original byte position where the character's source begins."""
        out: list[str] = []
        at: list[int] = []
        i, n = 0, len(raw)

        def prefix(i):
            rule = self.charmap.longest(raw, i)
            if rule is not None:
                return rule[0], rule[1].decode("utf-8", "replace")
            b = raw[i]
            k = 1 if b < 0x80 else 2 if b < 0xE0 else 3 if b < 0xF0 else 4
            return k, raw[i:i + k].decode("utf-8", "replace")

        if self.trim:
            while i < n:
                k, s = prefix(i)
                if s != " ":
                    break
                i += k
        if i >= n:
            return "", [0]
        if self.dummy_prefix:
            out.append(SPACE)
            at.append(i)
        after_space = self.trim
        while i < n:
            k, s = prefix(i)
            if after_space:
                s = s.lstrip(" ")
            if s:
                s = s.replace(" ", SPACE)
                out.append(s)
                at.extend([i] * len(s))
                after_space = self.trim and s.endswith(SPACE)
            i += k
        text = "".join(out)
        end = n
        if self.trim:
            while text.endswith(SPACE):
                text = text[:-1]
                end = at.pop()
        return text, at + [end]

    # -- merging -----------------------------------------------------------

    def merge(self, text: str) -> list[str]:
        """Symbols of ``text`` after all merges."""
        parts = list(text)
        if len(parts) > 256:
            return self._merge_long(parts)
        get, last = self.rank.get, self.last
        ranks = [get(a + b, last) for a, b in zip(parts, parts[1:])]
        while ranks:
            best = min(ranks)
            if best == last:
                break
            i = ranks.index(best)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = get(parts[i - 1] + parts[i], last)
            if i < len(ranks):
                ranks[i] = get(parts[i] + parts[i + 1], last)
        return parts

    def _merge_long(self, parts: list[str]) -> list[str]:
        n = len(parts)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap: list[tuple[int, int, int, str]] = []

        def offer(i, j):
            if i >= 0 and j >= 0 and (r := self.rank.get(parts[i] + parts[j])) is not None:
                heapq.heappush(heap, (r, i, j, parts[i] + parts[j]))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, i, j, s = heapq.heappop(heap)
            if not parts[i] or not parts[j] or right[i] != j or parts[i] + parts[j] != s:
                continue
            parts[i], parts[j] = s, ""
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
            offer(left[i], i)
            offer(i, right[i])
        return [p for p in parts if p]

    def _pieces(self, text: str) -> tuple[list[int], list[int]]:
        """Ids of a cut of normalised text, and how many characters each covers."""
        ids: list[int] = []
        chars: list[int] = []
        for s in self.merge(text):
            i = self.ids.get(s)
            if i is not None:
                ids.append(i)
                chars.append(len(s))
            elif self.byte_fallback:
                raw = s.encode()
                ids.extend(self.byte_ids[b] for b in raw)
                chars.extend([0] * (len(raw) - 1) + [len(s)])
            elif ids and ids[-1] == self.unknown:
                chars[-1] += len(s)
            else:
                ids.append(self.unknown)
                chars.append(len(s))
        return ids, chars

    # -- encoding ----------------------------------------------------------

    def _word(self, word: bytes) -> bytes:
        """Ids (as int32 bytes) of a space-led cut of plain text."""
        found = self.older.get(word)
        if found is None:
            text = word.decode("utf-8", "replace").replace(" ", SPACE)
            core = word[:-1]
            if text[-1] in ",.;:!?" and len(text) > 2 and text[-2:] not in self.inside:
                # no piece holds these two characters side by side: nothing merges across
                found = (self.cache.get(core) or self._word(core)) + self._ids(text[-1])
            else:
                found = self._ids(text)
        if len(word) <= 64:
            if len(self.cache) >= CACHE:
                self.older, self.cache = self.cache, {}
            self.cache[word] = found
        return found

    def _ids(self, text: str) -> bytes:
        parts = self.merge(text)
        ids = list(map(self.ids.get, parts))
        if None in ids:
            ids = self._pieces(text)[0]
        return struct.pack(f"<{len(ids)}i", *ids)

    def encode(self, raw: bytes) -> Iterator[Pieces]:
        """Pieces of a whole text, some ``BLOCK`` words at a time."""
        if not raw:
            return
        if not self.plain or SPACE.encode() in raw:
            yield from self._encode_aligned(raw)
            return
        at = -1  # the space of the dummy prefix lies before byte 0
        words = re.finditer(rb" +[^ ]*", b" " + raw) if b"  " in raw or raw[:1] == b" " else None
        cuts = (m.group() for m in words) if words else iter((b" " + raw.replace(b" ", b"\0 ")).split(b"\0")) \
            if b"\0" not in raw else (b" " + w for w in raw.split(b" "))
        while block := list(islice(cuts, BLOCK)):
            get = self.cache.get
            ids = np.frombuffer(b"".join([get(w) or self._word(w) for w in block]), np.int32)
            end = np.cumsum(self.lengths[ids]) + at
            begin = np.empty_like(end)
            begin[0], begin[1:] = at, end[:-1]
            if at < 0:
                np.maximum(begin, 0, out=begin)
            at = int(end[-1])
            yield Pieces(ids, begin, end)

    def _encode_aligned(self, raw: bytes) -> Iterator[Pieces]:
        text, origin = self.normalise(raw)
        cuts = (m.group() for m in re.finditer(f"{SPACE}+[^{SPACE}]*|^[^{SPACE}]+", text)) if self.cuts else iter([text])
        at = 0
        while block := list(islice(cuts, BLOCK)):
            ids: list[int] = []
            chars: list[int] = []
            for cut in block:
                i, c = self._pieces(cut)
                if i and ids and i[0] == ids[-1] == self.unknown and not self.byte_fallback:
                    chars[-1] += c[0]
                    i, c = i[1:], c[1:]
                ids += i
                chars += c
            edges = np.cumsum([at, *chars])
            where = np.array(origin, np.int64)[edges]
            at = int(edges[-1])
            if ids:
                yield Pieces(np.array(ids, np.int32), where[:-1], where[1:])

    # -- decoding ----------------------------------------------------------

    def decode(self, blocks: Iterator[np.ndarray]) -> Iterator[bytes]:
        """Text of consecutive runs of ids; a run must not end inside the byte
        pieces of one character (``encode`` never does). Bytes that are not
        UTF-8 decode to the replacement character each."""
        surface, first = self.surface, True
        for ids in blocks:
            out = b"".join(map(surface.__getitem__, ids.tolist()))
            if first and (self.dummy_prefix or self.trim) and len(ids):
                if surface[ids[0]][:1] == b" " and int(ids[0]) not in self.byte_set:
                    out = out.lstrip(b" ") if self.trim else out[1:]
                first = False
            try:
                out.decode()
            except UnicodeDecodeError:
                out = _replace_bad(out)
            yield out


def _replace_bad(raw: bytes) -> bytes:
    """Every byte that is not part of a UTF-8 character becomes U+FFFD."""
    out, i = [], 0
    while i < len(raw):
        for k in (1, 2, 3, 4):
            try:
                out.append(raw[i:i + k].decode())
                i += k
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            i += 1
    return "".join(out).encode()


_codecs: dict[bytes, Codec] = {}


def codec_of(model: bytes) -> Codec:
    """This worker's codec of a model; it keeps its words from task to task."""
    if model not in _codecs:
        _codecs.clear()
        _codecs[model] = Codec(model)
    return _codecs[model]


def load_model(spark: SparkSession, path: str):
    """Broadcast of the model file's bytes, read on the driver."""
    with open(path, "rb") as f:
        model = f.read(MODEL_BYTES + 1)
    if len(model) > MODEL_BYTES:
        raise ValueError(f"model file is larger than {MODEL_BYTES} bytes")
    return spark.sparkContext.broadcast(model)


def encode(spark: SparkSession, docs: DataFrame, model_path: str, text: str = "text",
           keep: list[str] | None = None) -> DataFrame:
    """``row`` (the columns ``keep``, default all), ids, begin, end: one array
    element per piece, spans in bytes of the original text."""
    rows = packed(docs, text, keep)
    model = load_model(spark, model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(model.value)
        for batch, texts in slices(batches, "body"):
            found = [list(codec.encode(t)) for t in texts]
            column = lambda f, kind: pa.array(
                [np.concatenate([f(p) for p in ps]) if ps else [] for ps in found], pa.list_(kind))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), column(lambda p: p.ids, pa.int32()),
                 column(lambda p: p.begin, pa.int64()), column(lambda p: p.end, pa.int64())],
                names=["row", "ids", "begin", "end"])

    schema = (rows.select("row").schema.add("ids", T.ArrayType(T.IntegerType()))
              .add("begin", T.ArrayType(T.LongType())).add("end", T.ArrayType(T.LongType())))
    return rows.mapInArrow(run, schema)


def digests(spark: SparkSession, docs: DataFrame, model_path: str, text: str = "text",
            keep: list[str] | None = None) -> DataFrame:
    """``row``, n_tokens, n_source_bytes (covered by the pieces' spans) and the
    SHA-256 of the comma-joined ids and of the decoded text. The pieces of a
    text are digested block by block where they are made."""
    rows = packed(docs, text, keep)
    model = load_model(spark, model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(model.value)
        for batch, texts in slices(batches, "body"):
            found = [digest(codec, t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array([f[0] for f in found], pa.int64()),
                 pa.array([f[1] for f in found], pa.int64()),
                 pa.array([f[2] for f in found]), pa.array([f[3] for f in found])],
                names=["row", "n_tokens", "n_source_bytes", "ids_sha256", "decoded_sha256"])

    schema = (rows.select("row").schema.add("n_tokens", "long").add("n_source_bytes", "long")
              .add("ids_sha256", "string").add("decoded_sha256", "string"))
    return rows.mapInArrow(run, schema)


def digest(codec: Codec, raw: bytes) -> tuple[int, int, str, str]:
    """Number of pieces, source bytes covered, digests of ids and decoded text."""
    ids_hash, text_hash = hashlib.sha256(), hashlib.sha256()
    n = covered = 0

    def blocks():
        nonlocal n, covered
        for p in codec.encode(raw):
            ids_hash.update((b"," if n else b"") + b",".join(map(codec.id_text.__getitem__, p.ids.tolist())))
            n += len(p.ids)
            covered += int((p.end - p.begin).sum())
            yield p.ids

    for part in codec.decode(blocks()):
        text_hash.update(part)
    return n, covered, ids_hash.hexdigest(), text_hash.hexdigest()
