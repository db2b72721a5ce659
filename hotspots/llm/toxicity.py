"""Toxicity: a bidirectional gated recurrent network with attention pooling.

Each word enters as the sum of what is known of it: a learned vector for words
of the training sample, and learned vectors for its character n-grams, which
also reach unseen words. A word of more than ``WORD`` characters (a glued run, a
sentence of a script without spaces) enters as overlapping parts that cover all
of it, each like a word of its own. Two recurrent passes read a window of
``WINDOW`` words in both directions, attention pools their states, and one logit comes
out. A text is cut into overlapping windows that cover all of it (every
``STRIDE`` words), and its score is that of its worst window.

Training is numpy on the driver over a bounded, documented sample (see
``SampleSize``); of each sampled text the most suspicious windows and a random
one are learned from. Scoring runs in the tasks over whole texts; a task holds
``BATCH`` windows at a time.

Defined results: a null or wordless text scores 0; with no labelled text of
either class every score is 0; scores of equal texts are equal; repeated rows
are scored each; an empty table gives an empty result; columns other than id
and text (language, source, labels) never enter a score.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hotspots.llm.batches import packed, slices
from hotspots.llm.training import Adam, best_shift, fold, labelled_sample

WINDOW, STRIDE = 32, 24
HIDDEN, DIM = 8, 6
BATCH = 2048
#: Words whose input a worker remembers.
CACHE = 200_000
#: Longest part of a word that is one input, in characters, and what two parts share:
#: an insult of up to OVERLAP characters is whole in one of them.
WORD, OVERLAP = 40, 20
#: Put where a part does not start or end its word; no word holds this byte.
_MORE = b" "


@dataclass(frozen=True)
class SampleSize:
    """Bounds of the labelled sample."""

    per_class: int = 900
    max_bytes: int = 24_000
    epochs: int = 6


_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
              for c in range(256))


def words(text: bytes) -> list[bytes]:
    """Words, long ones in parts."""
    found = text.translate(_FOLD).split()
    if max(map(len, found), default=0) <= WORD:
        return found
    return [p for w in found for p in ((w,) if len(w) <= WORD else parts(w))]


def parts(word: bytes) -> list[bytes]:
    """Overlapping parts of at most WORD characters that cover the word."""
    w = word.decode("utf-8", "replace")
    if len(w) <= WORD:
        return [word]
    step = WORD - OVERLAP
    return [(_MORE if a else b"") + w[a:a + WORD].encode() + (_MORE if a + WORD < len(w) else b"")
            for a in range(0, len(w) - OVERLAP, step)]


def grams(word: bytes) -> set[str]:
    """Character n-grams (3 to 5) with a mark at the start and the end of a
    word; a part of a word has none where the word goes on."""
    w = word.strip(_MORE).decode("utf-8", "replace")
    w = f"{'' if word.startswith(_MORE) else '^'}{w}{'' if word.endswith(_MORE) else '$'}"
    return {w[i:i + n] for n in (3, 4, 5) for i in range(len(w) - n + 1)}


def window_starts(n: int) -> list[int]:
    """Overlapping windows that cover n words."""
    return list(range(0, max(1, n - WINDOW + STRIDE), STRIDE)) if n else []


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Model:
    """Parameters and the passes over batches of windows."""

    def __init__(self, word_ids: dict[bytes, int], gram_ids: dict[str, int], params: dict[str, np.ndarray]):
        self.word_ids, self.gram_ids, self.p = word_ids, gram_ids, params

    @classmethod
    def start(cls, texts: list[list[bytes]], y: np.ndarray, seed: int = 7) -> "Model":
        """Vectors start at the log-odds of words and n-grams in the sample."""
        rng = np.random.default_rng(seed)
        seen = [set(t) for t in texts]
        word_odds = _odds(seen, y, 3, 0.5)
        gram_odds = _odds([set().union(*map(grams, s)) if s else set() for s in seen], y, 6, 0.7)
        small = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
        p = {"word": small(len(word_odds) + 1, DIM) * 0.3, "gram": small(len(gram_odds) + 1, DIM) * 0.3}
        p["word"][0] = p["gram"][0] = 0
        for name, odds in (("word", word_odds), ("gram", gram_odds)):
            p[name][1:, 0] = np.array([*odds.values()], np.float32) / 3 if odds else 0
        for d in "fb":
            p |= {f"W{d}": small(2 * DIM, 3 * HIDDEN) * 3, f"U{d}": small(HIDDEN, 3 * HIDDEN) * 2,
                  f"b{d}": np.zeros(3 * HIDDEN, np.float32)}
        p |= {"A": small(2 * HIDDEN, HIDDEN) * 2, "a": np.zeros(HIDDEN, np.float32), "v": small(HIDDEN),
              "o": small(2 * HIDDEN), "c": np.zeros(1, np.float32)}
        return cls({w: i + 1 for i, w in enumerate(word_odds)}, {g: i + 1 for i, g in enumerate(gram_odds)}, p)

    # -- inputs ------------------------------------------------------------

    def features(self, vocabulary: list[bytes]) -> tuple[np.ndarray, list[list[int]]]:
        """Word numbers and n-gram numbers of words."""
        get = self.gram_ids.get
        return (np.array([self.word_ids.get(w, 0) for w in vocabulary], np.int64),
                [sorted(i for g in grams(w) if (i := get(g))) for w in vocabulary])

    def vectors(self, word_no: np.ndarray, gram_no: list[list[int]]) -> np.ndarray:
        x = np.zeros((len(word_no), 2 * DIM), np.float32)
        x[:, :DIM] = self.p["word"][word_no]
        counts = np.array(list(map(len, gram_no)))
        if counts.sum():
            owner = np.repeat(np.arange(len(counts)), counts)
            flat = np.concatenate([g for g in gram_no if g]).astype(np.int64)
            sums = np.stack([np.bincount(owner, self.p["gram"][flat, k], len(counts)) for k in range(DIM)], 1)
            x[:, DIM:] = sums / np.sqrt(np.maximum(counts, 1))[:, None]
        return x

    # -- forward -----------------------------------------------------------

    def _pass(self, proj: np.ndarray, mask: np.ndarray, d: str, keep: list | None):
        """States (T, B, H) of one direction; proj is (T, B, 3H)."""
        T, B, _ = proj.shape
        U, h = self.p[f"U{d}"], np.zeros((B, HIDDEN), np.float32)
        out = np.empty((T, B, HIDDEN), np.float32)
        for t in range(T) if d == "f" else range(T - 1, -1, -1):
            u = h @ U
            g = _sigmoid(proj[t, :, :2 * HIDDEN] + u[:, :2 * HIDDEN])
            r, z = g[:, :HIDDEN], g[:, HIDDEN:]
            n = np.tanh(proj[t, :, 2 * HIDDEN:] + r * u[:, 2 * HIDDEN:])
            new = n + z * (h - n)
            if keep is not None:
                keep.append((t, h, r, z, n, u[:, 2 * HIDDEN:]))
            h = np.where(mask[t][:, None], new, h)
            out[t] = h
        return out

    def forward(self, pf: np.ndarray, pb: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Logits of a batch from its projected inputs (T, B, 3H) and mask (T, B)."""
        p = self.p
        steps_f, steps_b = ([], []) if keep is not None else (None, None)
        h = np.concatenate([self._pass(pf, mask, "f", steps_f), self._pass(pb, mask, "b", steps_b)], 2)
        s = np.tanh(h @ p["A"] + p["a"])
        e = np.where(mask, s @ p["v"], -1e9)
        w = np.exp(e - e.max(0))
        w /= w.sum(0)
        context = (w[:, :, None] * h).sum(0)
        if keep is not None:
            keep |= {"f": steps_f, "b": steps_b, "h": h, "s": s, "w": w, "context": context}
        return context @ p["o"] + p["c"][0]

    # -- backward ----------------------------------------------------------

    def gradients(self, x: np.ndarray, at: np.ndarray, mask: np.ndarray, y: np.ndarray,
                  weight: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, float]:
        """Gradients of the weighted log loss: of the parameters above the
        inputs and of the input vectors ``x`` (rows picked by ``at`` (T, B))."""
        p, keep = self.p, {}
        xs = x[at]
        logit = self.forward(xs @ p["Wf"] + p["bf"], xs @ p["Wb"] + p["bb"], mask, keep)
        prob = _sigmoid(logit)
        loss = float(-(weight * (y * np.log(prob + 1e-9) + (1 - y) * np.log(1 - prob + 1e-9))).mean())
        dl = (weight * (prob - y) / len(y)).astype(np.float32)
        g = {"o": keep["context"].T @ dl, "c": np.array([dl.sum()], np.float32)}
        dc = dl[:, None] * p["o"]
        h, s, w = keep["h"], keep["s"], keep["w"]
        dh = w[:, :, None] * dc
        dw = (h * dc).sum(2)
        de = w * (dw - (w * dw).sum(0))
        g["v"] = np.einsum("tb,tbk->k", de, s)
        ds = de[:, :, None] * p["v"] * (1 - s * s)
        g["A"] = np.einsum("tbh,tbk->hk", h, ds)
        g["a"] = ds.sum((0, 1))
        dh = dh + ds @ p["A"].T
        dxs = np.zeros_like(xs)
        for d, part in (("f", dh[:, :, :HIDDEN]), ("b", dh[:, :, HIDDEN:])):
            U, W = p[f"U{d}"], p[f"W{d}"]
            dproj = np.zeros((*mask.shape, 3 * HIDDEN), np.float32)
            dU = np.zeros_like(U)
            carry = np.zeros((mask.shape[1], HIDDEN), np.float32)
            for t, before, r, z, n, un in reversed(keep[d]):
                total = carry + part[t]
                m = mask[t][:, None]
                dnew = np.where(m, total, 0)
                dn = dnew * (1 - z) * (1 - n * n)
                dz = dnew * (before - n) * z * (1 - z)
                dr = dn * un * r * (1 - r)
                dproj[t] = np.concatenate([dr, dz, dn], 1)
                du = np.concatenate([dr, dz, dn * r], 1)
                dU += before.T @ du
                carry = np.where(m, dnew * z, total) + du @ U.T
            g[f"U{d}"] = dU
            g[f"b{d}"] = dproj.sum((0, 1))
            g[f"W{d}"] = np.einsum("tbi,tbj->ij", xs, dproj)
            dxs += dproj @ W.T
        dx = np.zeros_like(x)
        np.add.at(dx, at.ravel(), dxs.reshape(-1, dxs.shape[2]))
        return g, dx, loss


def _odds(seen: list[set], y: np.ndarray, support: int, least: float) -> dict:
    """Log-odds of the positive class for what occurs in ``support`` texts or
    more, moved towards zero by one standard error."""
    pos, neg = Counter(), Counter()
    for s, label in zip(seen, y):
        (pos if label else neg).update(s)
    n1, n0 = y.sum() + 1, len(y) - y.sum() + 1
    out = {}
    for k in sorted({k for c in (pos, neg) for k in c if pos[k] + neg[k] >= support}):
        odds = math.log((pos[k] + 0.5) / n1) - math.log((neg[k] + 0.5) / n0)
        error = math.sqrt(1 / (pos[k] + 0.5) + 1 / (neg[k] + 0.5))
        odds = math.copysign(max(0.0, abs(odds) - error), odds)
        if abs(odds) >= least:
            out[k] = max(-4.0, min(4.0, odds))
    return out


def train(texts: list[bytes], y: np.ndarray, epochs: int = 6, seed: int = 7) -> Model | None:
    """Model of a labelled sample; None when a class is missing."""
    if not len(y) or y.min() == y.max():
        return None
    rng = np.random.default_rng(seed)
    lists = [words(t) for t in texts]
    keep = [i for i, w in enumerate(lists) if w]
    lists, y = [lists[i] for i in keep], y[keep]
    if not len(y) or y.min() == y.max():
        return None
    model = Model.start(lists, y, seed)
    vocabulary = sorted(set().union(*lists))
    number = {w: i + 1 for i, w in enumerate(vocabulary)}
    word_no, gram_no = model.features([b"", *vocabulary])
    gram_no[0] = []
    x = model.vectors(word_no, gram_no)
    suspicion = x[:, 0] + x[:, DIM]
    picked, owner = [], []
    for i, w in enumerate(lists):
        ids = np.array([number[v] for v in w])
        starts = window_starts(len(ids))
        worst = [np.sort(suspicion[ids[a:a + WINDOW]])[-3:].sum() for a in starts]
        best = np.argsort(worst)[::-1]
        chosen = {int(best[0])} if y[i] else {int(best[0]), int(best[len(best) // 8]), int(rng.integers(len(starts)))}
        for k in sorted(chosen):
            picked.append(ids[starts[k]:starts[k] + WINDOW])
            owner.append(i)
    at, mask = _stack(picked)
    t = y[owner]
    weight = np.where(t == 1, 0.5 / max(t.mean(), 1e-3), 0.5 / max(1 - t.mean(), 1e-3)).astype(np.float32)
    opt = Adam(model.p, 0.01)
    flat_no = np.concatenate([np.array(g, np.int64) for g in gram_no])
    flat_owner = np.repeat(np.arange(len(gram_no)), list(map(len, gram_no)))
    scale = 1 / np.sqrt(np.maximum(1, np.array(list(map(len, gram_no)))))
    for _ in range(epochs):
        order = rng.permutation(len(t))
        for i in range(0, len(order), 128):
            b = order[i:i + 128]
            used, inverse = np.unique(at[:, b], return_inverse=True)
            lo, hi = np.searchsorted(flat_owner, used, "left"), np.searchsorted(flat_owner, used, "right")
            own = [flat_no[p:q] for p, q in zip(lo, hi)]
            x = model.vectors(word_no[used], [o.tolist() for o in own])
            g, dx, _ = model.gradients(x, inverse.reshape(at[:, b].shape), mask[:, b], t[b], weight[b])
            g["word"], g["gram"] = np.zeros_like(model.p["word"]), np.zeros_like(model.p["gram"])
            np.add.at(g["word"], word_no[used], dx[:, :DIM])
            counts = hi - lo
            if counts.sum():
                np.add.at(g["gram"], np.concatenate(own),
                          np.repeat(dx[:, DIM:] * scale[used][:, None], counts, axis=0))
            g["word"][0] = 0
            g["gram"][0] = 0
            opt.step(g)
    logits = Scorer(model).logits(lists)
    model.p["c"] += best_shift(logits, y)
    return model


def _stack(windows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Windows as (T, B) word numbers, 0 where a window is shorter, and mask."""
    at = np.zeros((WINDOW, len(windows)), np.int64)
    mask = np.zeros((WINDOW, len(windows)), bool)
    for i, w in enumerate(windows):
        at[:len(w), i] = w
        mask[:len(w), i] = True
    return at, mask


class Scorer:
    """Scores texts with a trained model; remembers the inputs of recent words."""

    def __init__(self, model: Model):
        self.model = model
        self._forget()

    def _forget(self):
        self.rows: dict[bytes, int] = {b"": 0}
        self.table = np.zeros((1 << 14, 6 * HIDDEN), np.float32)

    def _add(self, new: list[bytes]) -> None:
        p = self.model.p
        x = self.model.vectors(*self.model.features(new))
        first = len(self.rows)
        while first + len(new) > len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[first:first + len(new)] = np.concatenate(
            [x @ p["Wf"] + p["bf"], x @ p["Wb"] + p["bb"]], 1)
        self.rows.update(zip(new, range(first, first + len(new))))

    def logits(self, texts: list[list[bytes]]) -> np.ndarray:
        """Logit of the worst window of each text; -inf for texts without words."""
        out = np.full(len(texts), -np.inf)
        pending: list[tuple[int, np.ndarray]] = []
        for i, w in enumerate(texts):
            for a in range(0, len(w), BATCH * STRIDE):
                # a very long text is read in runs that overlap as windows do
                run = w[a:a + BATCH * STRIDE + WINDOW - STRIDE]
                if a and len(run) <= WINDOW - STRIDE:
                    continue
                if len(self.rows) > CACHE:
                    self._flush(pending, out)
                    pending = []
                    self._forget()
                new = [v for v in dict.fromkeys(run) if v not in self.rows]
                if new:
                    self._add(new)
                ids = np.fromiter(map(self.rows.__getitem__, run), np.int64, len(run))
                pending += [(i, ids[s:s + WINDOW]) for s in window_starts(len(ids))]
                if len(pending) >= BATCH:
                    self._flush(pending, out)
                    pending = []
        self._flush(pending, out)
        return out

    def _flush(self, pending, out):
        for k in range(0, len(pending), BATCH):
            part = pending[k:k + BATCH]
            at, mask = _stack([w for _, w in part])
            proj = self.table[at]
            z = self.model.forward(proj[:, :, :3 * HIDDEN], proj[:, :, 3 * HIDDEN:], mask)
            np.maximum.at(out, [i for i, _ in part], z)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        logits = self.logits([words(t) for t in texts])
        return np.where(np.isneginf(logits), 0.0, _sigmoid(logits))


def fit(docs: DataFrame, labels: DataFrame, size: SampleSize = SampleSize(), doc_id: str = "doc_id",
        text: str = "text") -> Model | None:
    """Learn ``labels.toxic`` from rows outside the held-out fold."""
    texts, y = labelled_sample(docs, labels, "toxic", fold(doc_id, 5) != 0, size.per_class, size.max_bytes,
                               doc_id, text)
    return train(texts, y, size.epochs)


def score(spark: SparkSession, docs: DataFrame, model: Model | None, text: str = "text",
          keep: list[str] | None = None) -> DataFrame:
    """``row`` (the columns ``keep``, default all) and ``score``."""
    rows = packed(docs, text, keep)
    if model is None:
        return rows.select("row", F.lit(0.0).alias("score"))
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for batch, texts in slices(batches, "body", 1 << 20):
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(scorer.scores(texts).astype(np.float64))],
                                             names=["row", "score"])

    return rows.mapInArrow(run, rows.select("row").schema.add("score", "double"))
