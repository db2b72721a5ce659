"""Language ID by cross-parsing entropy.

For every language a suffix automaton is built over a bounded sample of its
labelled texts. A text is parsed into phrases, each the longest match of what
follows in the language's sample (or one unknown byte); with ``c`` phrases
against a sample of ``n`` bytes its code length is ``c * log2(n)``, the
normalised phrase count of cross-parsing. The language of the shortest code wins
(ties: the smaller name); ``score`` is 1 over the sum of 2^-(bits more than the
winner's) over all languages.

Texts are read as bytes: A-Z lower-cased, runs of other ASCII non-letters one
space, all other bytes as they are. The automaton is kept as a table from
(state, byte) to the next state; a transition that begins a new phrase carries
the sign bit, so parsing is one table look-up a byte. Long texts are cut into
blocks that advance together, each from a guess: the state reached from
``WARM`` bytes before it. Where that differs from the state in which the block
before it ended, the block is parsed again from there, so the phrases are those
of one parse of the whole text.

Learning: about ``SampleSize.per_language`` bytes a language (and ``total`` over
all of them), different texts in the order of their hash until that is reached,
of a longer one its first ``per_text`` characters; at most ``languages``
languages, the most frequent. Texts of the sample that look mislabelled
(``agreed``) are left out. Only rows that the caller allows are learned. Everything
else reads all rows and whole texts.

Defined results: ``und`` and score 0 for a text that is null or holds no letter,
and for every text if nothing was learned; a null language label teaches
nothing; repeated rows are judged each; an empty table gives an empty result;
columns other than the text (and the label in learning) are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hotspots.llm.batches import packed, slices

BLOCK, WARM = 1024, 64
UNKNOWN_LANGUAGE = "und"
#: Text bytes parsed at a time (or one longer text).
SLICE = 2 << 20
#: Bytes of one text parsed at a time, and languages parsed at a time.
PIECE = 8 << 20
LANES = 8

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_SPACES = re.compile(rb" {2,}")
_START = np.int32(-(1 << 31))  # sign bit of a transition: a phrase begins
_STATE = np.int32((1 << 31) - 1)


@dataclass(frozen=True)
class SampleSize:
    """Bounds of what is learned."""

    per_language: int = 1 << 16
    total: int = 1 << 18
    per_text: int = 2000
    languages: int = 200


def normalised(text: bytes) -> bytes:
    """Words of letters and non-ASCII bytes, a space before, between and after; empty without any."""
    words = _SPACES.sub(b" ", text.translate(_FOLD)).strip(b" ")
    return b" " + words + b" " if words else b""


def has_letter(text: bytes, clean: bytes) -> bool:
    """Whether a text holds a letter of any script."""
    return clean.isascii() and bool(clean) or any(c.isalpha() for c in text.decode("utf-8", "replace"))


class Automaton:
    """Suffix automaton of a sample: the smallest one that reads exactly the
    substrings of its texts."""

    def __init__(self, texts: list[bytes]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.size = [-1], [0]
        for t in texts:
            last = 0  # no substring crosses from one text to the next
            for c in t:
                last = self._extend(last, c)

    def _extend(self, last: int, c: int) -> int:
        known = self.next[last].get(c)
        if known is not None:
            return known if self.size[known] == self.size[last] + 1 else self._split(last, known, c)
        state = self._state({}, self.size[last] + 1)
        p = last
        while p != -1 and c not in self.next[p]:
            self.next[p][c] = state
            p = self.link[p]
        if p == -1:
            self.link[state] = 0
        else:
            q = self.next[p][c]
            self.link[state] = q if self.size[q] == self.size[p] + 1 else self._split(p, q, c)
        return state

    def _state(self, after: dict[int, int], size: int) -> int:
        self.next.append(after)
        self.link.append(0)
        self.size.append(size)
        return len(self.size) - 1

    def _split(self, p: int, q: int, c: int) -> int:
        copy = self._state(dict(self.next[q]), self.size[p] + 1)
        self.link[copy], self.link[q] = self.link[q], copy
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def edges(self) -> np.ndarray:
        """Columns: state, byte, next state."""
        return np.array([(s, c, t) for s, after in enumerate(self.next) for c, t in after.items()], np.int32).reshape(-1, 3)


@dataclass
class Model:
    """Languages in order, bytes learned of each, and the edges of their automata."""

    names: list[str]
    learned: list[int]
    edges: list[np.ndarray]


def agreed(samples: dict[str, list[bytes]]) -> dict[str, list[bytes]]:
    """The sample without texts that look mislabelled: each half of the texts is
    judged by automata of the other half, and those judged another language go. A
    language that would lose half of its texts, or has less than four, keeps all."""
    halves = [{name: texts[k::2] for name, texts in samples.items() if texts[k::2]} for k in (0, 1)]
    out = {}
    judged = []
    for k in (0, 1):
        other = _model(halves[1 - k])
        if other is None:
            return samples
        parser = Parser(other)
        judged.append({name: [parser.names[b] == name for b in (parser.phrases(texts) * parser.bits).argmin(1)]
                       for name, texts in halves[k].items()})
    for name, texts in samples.items():
        good = [judged[i % 2].get(name, [])[i // 2] for i in range(len(texts))]
        enough = len(texts) >= 4 and 2 * sum(good) > len(texts)
        out[name] = [t for t, ok in zip(texts, good) if ok] if enough else texts
    return out


def train(samples: dict[str, list[bytes]]) -> Model | None:
    """Model of the (normalised) texts of each language; None without any."""
    return _model(agreed({name: [t for t in texts if t] for name, texts in samples.items() if any(texts)}))


def _model(samples: dict[str, list[bytes]]) -> Model | None:
    kept = dict(sorted(samples.items()))
    if not kept:
        return None
    return Model(list(kept), [sum(map(len, x)) for x in kept.values()],
                 [Automaton(texts).edges() for texts in kept.values()])


def sample(docs: DataFrame, allowed: Column, size: SampleSize = SampleSize(), text: str = "text",
           lang: str = "lang") -> dict[str, list[bytes]]:
    """Normalised texts of the bounded sample, copies once. The languages are
    counted first, so that only about as many rows as are needed are ranked."""
    rows = docs.filter(allowed & (F.col(f"`{lang}`") != UNKNOWN_LANGUAGE) & F.col(f"`{text}`").isNotNull()).select(
        F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{text}`").cast("string").alias("text"))
    counts = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(size.languages).collect()
    if not counts:
        return {}
    most = min(size.per_language, size.total // len(counts))
    scale = 1 << 20
    # most bytes are at most so many texts of 128 bytes or more; shorter ones may not fill the sample
    share = F.create_map(*[F.lit(x) for r in counts for x in
                           (r["lang"], min(scale, 1 + 4 * max(16, most // 128) * scale // r["count"]))])
    some = (rows.withColumn("h", F.xxhash64("text")).filter(F.pmod("h", F.lit(scale)) < share[F.col("lang")])
            .groupBy("lang", "h", F.substring("text", 1, size.per_text).alias("text")).agg(F.count(F.lit(1))))
    before = Window.partitionBy("lang").orderBy("h", "text").rowsBetween(Window.unboundedPreceding, -1)
    used = F.coalesce(F.sum(F.octet_length("text")).over(before), F.lit(0))
    picked = some.withColumn("used", used).filter(F.col("used") < most).orderBy("lang", "h", "text").collect()
    out: dict[str, list[bytes]] = {}
    for r in picked:
        clean = normalised(r["text"].encode())
        if clean:
            out.setdefault(r["lang"], []).append(clean)
    return out


def fit(docs: DataFrame, allowed: Column, size: SampleSize = SampleSize(), text: str = "text",
        lang: str = "lang") -> Model | None:
    """Learn the languages of the rows that ``allowed`` holds for."""
    return train(sample(docs, allowed, size, text, lang))


class Parser:
    """Transition tables of all languages, laid out one after the other."""

    def __init__(self, model: Model):
        self.names = model.names
        self.bits = np.log2(np.maximum(2, model.learned))
        tables, self.root, self.codes = [], [], []
        at = 0
        for edges in model.edges:
            state, byte, to = edges.T
            symbols = np.unique(byte)
            width = len(symbols) + 1  # symbol 0: a byte that the language's sample lacks
            code = np.zeros(256, np.uint8)
            code[symbols] = np.arange(1, width)
            states = int(max(state.max(), to.max())) + 1
            first = np.full(width, at, np.int64)  # where a phrase that begins with a symbol leads
            own = state == 0
            first[code[byte[own]]] = at + to[own].astype(np.int64) * width
            table = np.tile(first, (states, 1)).astype(np.int32) | _START
            table[state, code[byte]] = at + to.astype(np.int64) * width
            table[0] |= _START
            tables.append(table.ravel())
            self.root.append(at)
            self.codes.append(code.tobytes())
            at += states * width
        if at >= 1 << 31:
            raise ValueError("the languages' automata are too large")
        self.table = np.concatenate(tables)

    def phrases(self, texts: list[bytes]) -> np.ndarray:
        """Phrases of each (normalised) text in each language: (text, language)."""
        count = np.zeros((len(texts), len(self.names)), np.int64)
        short = [i for i, t in enumerate(texts) if 0 < len(t) <= PIECE]
        long = [i for i, t in enumerate(texts) if len(t) > PIECE]
        for first in range(0, len(self.names), LANES):
            k = slice(first, first + LANES)
            root = np.array(self.root[k], np.int32)
            if short:
                count[short, k], _ = self._parse([texts[i] for i in short], k, np.tile(root, (len(short), 1)))
            for i in long:
                state = root[None]
                for a in range(0, len(texts[i]), PIECE):
                    found, state = self._parse([texts[i][a:a + PIECE]], k, state)
                    count[i, k] += found[0]
        return count

    def _parse(self, texts: list[bytes], which: slice, begun: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Phrases and end states of not empty texts in some languages, each from
        its state in ``begun``."""
        codes = self.codes[which]
        k = len(codes)
        sizes = np.array([len(t) for t in texts], np.int64)
        joined = b"".join(texts)
        blocks = -(-sizes // BLOCK)
        doc = np.repeat(np.arange(len(texts)), blocks)
        number = np.arange(len(doc)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        length = np.minimum(BLOCK, sizes[doc] - number * BLOCK)
        order = np.argsort(-length, kind="stable")  # full blocks first: those still running are a prefix
        rank = np.empty(len(doc), np.int64)
        rank[order] = np.arange(len(doc))
        laid = np.frombuffer(b"".join(joined.translate(c) for c in codes), np.uint8)
        # the block of rank i has lane i * k + l in the l-th language
        start = (((np.cumsum(sizes) - sizes)[doc] + number * BLOCK)[order][:, None] + np.arange(k) * len(joined)).ravel()
        length = np.repeat(length[order], k)
        inner = np.repeat(number[order] > 0, k)
        chain = (doc[order][:, None] * k + np.arange(k)).ravel()
        before = np.where(number > 0, rank[np.arange(len(doc)) - 1], 0)[order]
        before = (before[:, None] * k + np.arange(k)).ravel()
        state = begun.ravel()[chain]
        warm = np.flatnonzero(inner)
        state[warm], _ = self._run(laid, start[warm] - WARM, np.full(len(warm), WARM),
                                   np.array(self.root[which], np.int32)[warm % k])
        end, found = self._run(laid, start, length, state)
        rounds = 0
        while True:
            wrong = warm[state[warm] != end[before[warm]]]
            if not len(wrong):
                break
            if rounds > 3:  # periodic texts: their blocks one after the other
                wrong = wrong[np.unique(chain[wrong], return_index=True)[1]]
                wrong.sort()
            state[wrong] = end[before[wrong]]
            end[wrong], found[wrong] = self._run(laid, start[wrong], length[wrong], state[wrong])
            rounds += 1
        last = rank[np.cumsum(blocks) - 1]
        return (np.bincount(chain, found, len(texts) * k).reshape(len(texts), k).astype(np.int64),
                end[last[:, None] * k + np.arange(k)])

    def _run(self, codes: np.ndarray, start: np.ndarray, length: np.ndarray,
             state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """End states and phrases begun, all lanes advancing byte by byte;
        ``length`` descends."""
        state, found = state.copy(), np.zeros(len(state), np.int32)
        at = start.copy()
        if not len(state):
            return state, found
        running = np.searchsorted(-length, -np.arange(int(length.max())), "left")
        for n in running.tolist():
            step = self.table.take(state[:n] + codes.take(at[:n]))
            found[:n] -= step >> 31
            state[:n] = step & _STATE
            at[:n] += 1
        return state, found

    def judge(self, texts: list[bytes]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text (UTF-8)."""
        clean = [normalised(t) for t in texts]
        bits = self.phrases(clean) * self.bits
        best = bits.argmin(1)
        more = np.minimum(bits - bits.min(1, keepdims=True), 1000)
        score = 1 / np.exp2(-more).sum(1)
        lettered = np.array([has_letter(t, c) for t, c in zip(texts, clean)], bool)
        return ([self.names[b] if ok else UNKNOWN_LANGUAGE for b, ok in zip(best.tolist(), lettered.tolist())],
                np.where(lettered, score, 0.0))


_PARSERS: dict[str, Parser] = {}


def predict(spark: SparkSession, docs: DataFrame, model: Model | None, text: str = "text",
            keep: list[str] | None = None) -> DataFrame:
    """``row`` (the columns ``keep``, default all), ``lang_pred`` and ``score``."""
    rows = packed(docs, text, keep)
    if model is None:
        return rows.select("row", F.lit(UNKNOWN_LANGUAGE).alias("lang_pred"), F.lit(0.0).alias("score"))
    sent = spark.sparkContext.broadcast(model)
    name = f"{spark.sparkContext.applicationId}-{sent._jbroadcast.id()}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = _PARSERS.get(name)
        if parser is None:
            _PARSERS.clear()
            parser = _PARSERS[name] = Parser(sent.value)
        for batch, texts in slices(batches, "body", SLICE):
            names, score = parser.judge(texts)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(names), pa.array(score)],
                                             names=["row", "lang_pred", "score"])

    return rows.mapInArrow(run, rows.select("row").schema.add("lang_pred", "string").add("score", "double"))
