"""Quality classifier: a byte-level convolutional network.

Learned filters read every run of ``WIDTH`` bytes of a text (and whether a
word or line start repeats what came right before it). The text is cut into
overlapping chunks of ``CHUNK`` bytes, every ``STRIDE`` bytes, that cover all
of it; each filter is max-pooled over a chunk, the pooled responses give the
chunk's logit, and the mean of the chunk logits gives the text's probability.

Training is numpy on the driver over a bounded, documented sample
(``SampleSize``); scoring runs in the tasks over whole texts. A text is laid out
once, however long, and convolved ``BYTES`` bytes at a time, each run seeing the
bytes that follow it; a score does not depend on where a run ends.

Defined results: a null or empty text scores 0; with no labelled text of
either class every score is 0; equal texts score equally up to rounding;
repeated rows are scored each; an empty table gives an empty result; columns
other than id and text never enter a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hotspots.llm.batches import packed, slices
from hotspots.llm.training import Adam, best_shift, fold, labelled_sample

WIDTH, FILTERS = 4, 16
BLOCK = 32
CHUNK, STRIDE = 16 * BLOCK, 15 * BLOCK
_TAIL = 3
#: Bytes convolved at a time.
BYTES = 1 << 18


@dataclass(frozen=True)
class SampleSize:
    """Bounds of the labelled sample."""

    per_class: int = 900
    max_bytes: int = 16_000
    epochs: int = 8


def _repeats(buffer: np.ndarray, piece: np.ndarray) -> np.ndarray:
    """Per byte: 1 where a word starts that goes on a run of repeated words,
    2 where a line starts that begins like one of the eight before it, else 0.
    ``piece`` holds the first position of every text in the buffer."""
    flags = np.zeros(len(buffer), np.uint8)
    space = (buffer == 0) | (buffer == 32) | ((buffer >= 9) & (buffer <= 13))
    before = np.concatenate([[True], space[:-1]])
    starts = np.flatnonzero(~space & before)
    if not len(starts):
        return flags
    ends = np.flatnonzero(space & ~before)
    if len(ends) < len(starts):
        ends = np.append(ends, len(buffer))
    text = np.searchsorted(piece, starts, "right")
    wide = np.ndarray((len(buffer) + 8,), "<u8", buffer.tobytes() + b"\0" * 16, strides=(1,))
    length = (ends - starts).astype(np.uint64)
    low = np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(8) * (np.uint64(8) - np.minimum(length, np.uint64(8))))
    code = (wide[starts] & low) * np.uint64(0x9E3779B97F4A7C15) + length
    same = np.zeros(len(starts), bool)
    same[1:] = (code[1:] == code[:-1]) & (text[1:] == text[:-1])
    again = same.copy()
    again[0] = False
    again[1:] &= same[:-1] | np.concatenate([[False], same[:-2]])[:len(same) - 1]
    flags[starts[again]] = 1
    # a line head ends with its text
    beyond = np.append(piece[1:], len(buffer))[text - 1]
    lines = np.flatnonzero((buffer[starts - 1] == 10) & (starts > 0))
    if len(lines) > 1:
        at = starts[lines]
        head = wide[at] * np.uint64(0x9E3779B97F4A7C15) + wide[np.minimum(at + 8, len(buffer))]
        head[at + 16 > beyond[lines]] = at[at + 16 > beyond[lines]]
        seen = np.zeros(len(at), bool)
        for lag in range(1, min(9, len(at))):
            seen[lag:] |= (head[lag:] == head[:-lag]) & (text[lines][lag:] == text[lines][:-lag])
        flags[at[seen]] = 2
    return flags


def _lay(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Texts laid into one buffer of whole blocks with a zero tail each: bytes,
    first block of each text, chunk starts (in blocks) and chunk ends."""
    parts, first, starts, ends = [], [], [], []
    at = 0
    for t in texts:
        blocks = (len(t) + WIDTH) // BLOCK + 1
        parts.append(t + b"\0" * (blocks * BLOCK - len(t)))
        first.append(at)
        step = STRIDE // BLOCK
        for a in range(0, max(1, blocks - 1), step):
            starts.append(at + a)
            ends.append(at + min(blocks, a + CHUNK // BLOCK))
        at += blocks
    return (np.frombuffer(b"".join(parts), np.uint8), np.array(first), np.array(starts), np.array(ends))


class Model:
    """Filter tables per byte position, repeat weights, output weights."""

    def __init__(self, params: dict[str, np.ndarray]):
        self.p = params
        self.pairs = None

    @classmethod
    def start(cls, seed: int = 11) -> "Model":
        rng = np.random.default_rng(seed)
        small = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
        p = {"T": small(WIDTH, 256, FILTERS), "S": small(3, FILTERS), "b": np.zeros(FILTERS, np.float32),
             "w": small(FILTERS) * 3, "c": np.zeros(1, np.float32)}
        p["T"][:, 0] = 0
        p["S"][0] = 0
        return cls(p)

    def ready(self) -> "Model":
        """Tables over byte pairs, for scoring."""
        T = self.p["T"]
        self.pairs = [(T[k][:, None, :] + T[k + 1][None, :, :]).reshape(65536, FILTERS) for k in (0, 2)]
        self.pairs[0] += self.p["b"]
        return self

    def responses(self, buffer: np.ndarray, flags: np.ndarray) -> np.ndarray:
        """Filter responses, max-pooled over blocks."""
        padded = np.concatenate([buffer, np.zeros(WIDTH, np.uint8)]).astype(np.int32)
        pair = (padded[:-1] << 8) | padded[1:]
        n = len(buffer)
        out = np.take(self.pairs[0], pair[:n], axis=0)
        out += np.take(self.pairs[1], pair[2:n + 2], axis=0)
        marked = np.flatnonzero((flags > 0) & (flags < _TAIL))
        out[marked] += self.p["S"][flags[marked]]
        out[flags == _TAIL] = self.p["b"]
        return out.reshape(-1, BLOCK, FILTERS).max(1)

    def chunk_logits(self, texts: list[bytes]) -> list[np.ndarray]:
        """Logits of the chunks of each (not empty) text."""
        buffer, first, starts, ends = _lay(texts)
        flags = _repeats(buffer, first * BLOCK)
        # the last positions of a text must not see the text laid behind it
        for k in range(1, WIDTH):
            flags[np.append(first[1:] * BLOCK, len(buffer)) - k] = _TAIL
        pooled = np.concatenate([self.responses(buffer[i:i + BYTES], flags[i:i + BYTES])
                                 if i + BYTES >= len(buffer) else
                                 self._across(buffer, flags, i) for i in range(0, len(buffer), BYTES)])
        pooled = np.concatenate([pooled, np.zeros((1, FILTERS), np.float32)])
        tops = np.maximum.reduceat(pooled, np.stack([starts, ends], 1).ravel(), axis=0)[::2]
        logits = np.maximum(tops, 0) @ self.p["w"] + self.p["c"][0]
        return np.split(logits, np.searchsorted(starts, first[1:]))

    def _across(self, buffer, flags, i):
        """Responses of BYTES bytes from i on, seeing the bytes that follow."""
        more = self.responses(buffer[i:i + BYTES + BLOCK], flags[i:i + BYTES + BLOCK])
        return more[:BYTES // BLOCK]

    def logits(self, texts: list[bytes]) -> np.ndarray:
        """Mean chunk logit of each text; -inf for an empty one."""
        total, count = np.zeros(len(texts)), np.zeros(len(texts))
        batch, owner, size = [], [], 0

        def flush():
            for i, z in zip(owner, self.chunk_logits(batch)):
                total[i] += z.sum()
                count[i] += len(z)

        for i, t in enumerate(texts):
            if t:
                batch.append(t)
                owner.append(i)
                size += len(t)
            if size >= BYTES:
                flush()
                batch, owner, size = [], [], 0
        if batch:
            flush()
        return np.where(count > 0, total / np.maximum(count, 1), -np.inf)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        z = self.logits(texts)
        return np.where(np.isneginf(z), 0.0, 1 / (1 + np.exp(-np.clip(z, -60, 60))))

    # -- training ----------------------------------------------------------

    def gradients(self, chunks: np.ndarray, flags: np.ndarray, owner: np.ndarray, y: np.ndarray,
                  weight: np.ndarray) -> tuple[dict[str, np.ndarray], float]:
        """Gradients of the weighted log loss of texts whose chunks are the
        rows of ``chunks`` (zero-padded by WIDTH - 1) and ``flags``."""
        p = self.p
        n = chunks.shape[1] - WIDTH + 1
        out = p["b"] + p["S"][flags]
        for k in range(WIDTH):
            out += p["T"][k][chunks[:, k:n + k]]
        top = out.argmax(1)
        rows = np.arange(len(chunks))[:, None]
        h = np.take_along_axis(out, top[:, None, :], 1)[:, 0]
        active = np.maximum(h, 0)
        sizes = np.bincount(owner, minlength=len(y)).astype(np.float32)
        z = np.bincount(owner, active @ p["w"], len(y)) / sizes + p["c"][0]
        prob = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        loss = float(-(weight * (y * np.log(prob + 1e-9) + (1 - y) * np.log(1 - prob + 1e-9))).mean())
        dz = (weight * (prob - y) / len(y)).astype(np.float32)
        dchunk = (dz / sizes)[owner]
        dh = (dchunk[:, None] * p["w"] * (h > 0)).astype(np.float32)
        g = {"w": active.T @ dchunk, "c": np.array([dz.sum()], np.float32), "b": dh.sum(0),
             "T": np.zeros_like(p["T"]), "S": np.zeros_like(p["S"])}
        filters = np.broadcast_to(np.arange(FILTERS), top.shape)
        for k in range(WIDTH):
            np.add.at(g["T"][k], (chunks[rows, top + k], filters), dh)
        np.add.at(g["S"], (flags[rows, top], filters), dh)
        g["T"][:, 0] = 0
        g["S"][0] = 0
        return g, loss


def train(texts: list[bytes], y: np.ndarray, epochs: int = 8, seed: int = 11) -> Model | None:
    """Model of a labelled sample; None when a class is missing."""
    if not len(y) or y.min() == y.max():
        return None
    rng = np.random.default_rng(seed)
    model = Model.start(seed)
    opt = Adam(model.p, 0.02)
    laid = []
    for t in texts:
        buffer, first, starts, ends = _lay([t])
        flags = _repeats(buffer, first * BLOCK)
        c = np.zeros((len(starts), CHUNK + WIDTH - 1), np.uint8)
        f = np.zeros((len(starts), CHUNK), np.uint8)
        for j, (a, b) in enumerate(zip(starts * BLOCK, ends * BLOCK)):
            piece = buffer[a:b + WIDTH - 1]
            c[j, :len(piece)] = piece
            f[j, :b - a] = flags[a:b]
        laid.append((c, f))
    share = y.mean()
    weight = np.where(y == 1, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for i in range(0, len(order), 32):
            b = order[i:i + 32]
            chunks = np.concatenate([laid[j][0] for j in b])
            flags = np.concatenate([laid[j][1] for j in b])
            owner = np.repeat(np.arange(len(b)), [len(laid[j][0]) for j in b])
            g, _ = model.gradients(chunks, flags, owner, y[b], weight[b])
            opt.step(g)
    model.ready()
    model.p["c"] += best_shift(model.logits(texts), y)
    return model


def fit(docs: DataFrame, labels: DataFrame, size: SampleSize = SampleSize(), doc_id: str = "doc_id",
        text: str = "text") -> Model | None:
    """Learn ``labels.quality`` from rows outside the held-out fold."""
    texts, y = labelled_sample(docs, labels, "quality", fold(doc_id, 3) != 1, size.per_class, size.max_bytes,
                               doc_id, text)
    return train(texts, y, size.epochs)


def score(spark: SparkSession, docs: DataFrame, model: Model | None, text: str = "text",
          keep: list[str] | None = None) -> DataFrame:
    """``row`` (the columns ``keep``, default all) and ``score``."""
    rows = packed(docs, text, keep)
    if model is None:
        return rows.select("row", F.lit(0.0).alias("score"))
    sent = spark.sparkContext.broadcast(model.p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(sent.value).ready()
        for batch, texts in slices(batches, "body", 1 << 20):
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(model.scores(texts).astype(np.float64))],
                                             names=["row", "score"])

    return rows.mapInArrow(run, rows.select("row").schema.add("score", "double"))
