"""Plain forward passes, one text and one step at a time, against the registered queries."""
import math

import numpy as np
import pytest

from hotspots.llm import quality_cnn as qc
from hotspots.llm import queries, toxicity
from hotspots.llm.training import fold

SF = "/root/testdata/sf0.001"


def marks(text, size):
    """1 at word starts that go on a run of repeated words, 2 at line starts that
    begin like one of the eight lines before."""
    padded = text + bytes(size - len(text))
    blank = lambda c: c == 0 or c == 32 or 9 <= c <= 13
    starts = [i for i in range(len(text)) if not blank(text[i]) and (i == 0 or blank(text[i - 1]))]
    names = []
    for i in starts:
        j = i
        while j < size and not blank(padded[j]):
            j += 1
        names.append((padded[i:min(j, i + 8)], j - i))
    same = [k > 0 and names[k] == names[k - 1] for k in range(len(names))]
    out = {}
    for k, i in enumerate(starts):
        if k and same[k] and (same[k - 1] or k > 1 and same[k - 2]):
            out[i] = 1
    heads = []
    for i in starts:
        if i and text[i - 1] == 10:
            head = padded[i:i + 16] if i + 16 <= size else i
            if head in heads[-8:]:
                out[i] = 2
            heads.append(head)
    return out


def quality_logit(model, text):
    p = {k: v.astype(np.float64) for k, v in model.p.items()}
    blocks = (len(text) + qc.WIDTH) // qc.BLOCK + 1
    size = blocks * qc.BLOCK
    padded = text + bytes(size - len(text) + qc.WIDTH)
    mark = marks(text, size)
    rows = []
    for i in range(size):
        r = p["b"].copy()
        if i < size - qc.WIDTH + 1:
            for k in range(qc.WIDTH):
                r += p["T"][k][padded[i + k]]
            r += p["S"][mark.get(i, 0)]
        rows.append(r)
    chunks = []
    for a in range(0, max(1, blocks - 1), qc.STRIDE // qc.BLOCK):
        top = np.max(rows[a * qc.BLOCK:min(blocks, a + qc.CHUNK // qc.BLOCK) * qc.BLOCK], axis=0)
        chunks.append(np.maximum(top, 0) @ p["w"] + p["c"][0])
    return float(np.mean(chunks))


def test_quality_query_equals_the_plain_pass(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = qc.fit(docs, labels)
    got = {r.doc_id: r.score for r in queries.QUERIES["op7_quality_cnn"](spark, SF).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for r in rows[::3]:
        z = quality_logit(model, r.text.encode())
        assert got[r.doc_id] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-4)


def test_marks_look_back_over_any_distance():
    text = (b"same head of lines " + b"x" * 300 + b"\n") * 12 + b"go go go go stop\n" + b"word " * 5
    buffer, first, _, _ = qc._lay([text])
    got = {int(i): int(f) for i, f in enumerate(qc._repeats(buffer, first * qc.BLOCK)) if f}
    assert got == marks(text, len(buffer)) and 1 in got.values() and 2 in got.values()


def toxic_logit(model, text):
    p = {k: v.astype(np.float64) for k, v in model.p.items()}
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    H, words = toxicity.HIDDEN, toxicity.words(text)
    inputs = []
    for w in words:
        own = sorted(model.gram_ids[g] for g in toxicity.grams(w) if g in model.gram_ids)
        gram = sum((p["gram"][g] for g in own), np.zeros(toxicity.DIM)) / math.sqrt(max(1, len(own)))
        inputs.append(np.concatenate([p["word"][model.word_ids.get(w, 0)], gram]))

    def states(xs, d):
        h, out = np.zeros(H), []
        for x in xs:
            a, u = x @ p[f"W{d}"] + p[f"b{d}"], h @ p[f"U{d}"]
            r, z = sigmoid(a[:H] + u[:H]), sigmoid(a[H:2 * H] + u[H:2 * H])
            h = (1 - z) * np.tanh(a[2 * H:] + r * u[2 * H:]) + z * h
            out.append(h)
        return out

    worst = -math.inf
    for s in toxicity.window_starts(len(words)):
        xs = inputs[s:s + toxicity.WINDOW]
        h = [np.concatenate(x) for x in zip(states(xs, "f"), states(xs[::-1], "b")[::-1])]
        e = np.array([np.tanh(x @ p["A"] + p["a"]) @ p["v"] for x in h])
        w = np.exp(e - e.max())
        worst = max(worst, float((w / w.sum()) @ np.array(h) @ p["o"] + p["c"][0]))
    return worst


def test_toxicity_query_equals_the_plain_pass(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r.score for r in queries.QUERIES["op9_toxicity"](spark, SF).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for r in rows[::3]:
        z = toxic_logit(model, r.text.encode())
        assert got[r.doc_id] == pytest.approx(1 / (1 + math.exp(-z)) if z > -math.inf else 0.0, abs=1e-4)


def test_sample_is_one_scan_and_bounded(spark):
    from hotspots.llm.training import labelled_sample

    docs = spark.createDataFrame([(i % 40, f"text {i} " * (i % 7)) for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    texts, y = labelled_sample(docs, labels, "quality", fold("doc_id", 3) != 1, 25, 30)
    assert len(texts) == len(y) and (y == 0).sum() <= 25 and (y == 1).sum() <= 25 and len(texts) > 20
    assert all(0 < len(t) <= 30 for t in texts)
    again, _ = labelled_sample(docs.repartition(7), labels, "quality", fold("doc_id", 3) != 1, 25, 30)
    assert texts == again
