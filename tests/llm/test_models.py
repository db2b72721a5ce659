"""The two trained classifiers: gradients, held-out accuracy, whole texts."""
import zlib

import numpy as np
import pytest

from hotspots.llm import quality_cnn, queries, toxicity

SF = "/root/testdata/sf0.01"


def labelled(spark, label):
    return [(r.doc_id, (r.text or "").encode(), r[label]) for r in
            spark.read.parquet(f"{SF}/documents.parquet").join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()]


@pytest.fixture(scope="module")
def toxic_model():
    rng = np.random.default_rng(0)
    plain = [f"w{i}" for i in range(60)]
    texts, y = [], []
    for i in range(160):
        w = [plain[k] for k in rng.integers(0, 60, 50)]
        if i % 2:
            w[int(rng.integers(50))] = f"insult{i % 4}"
            w[int(rng.integers(50))] = "insult1"
        texts.append(" ".join(w).encode())
        y.append(i % 2)
    return toxicity.train(texts, np.array(y, np.float32), 6)


@pytest.fixture(scope="module")
def quality_model():
    rng = np.random.default_rng(0)
    texts, y = [], []
    for i in range(120):
        w = ["".join(chr(97 + k) for k in rng.integers(0, 26, 5)) for _ in range(80)]
        texts.append(" ".join(w if i % 2 else [x + "$$$" for x in w]).encode())
        y.append(i % 2)
    return quality_cnn.train(texts, np.array(y, np.float32), 6)


def numeric(f, a, at, eps=1e-2):
    keep = a[at]
    a[at] = keep + eps
    up = f()
    a[at] = keep - eps
    down = f()
    a[at] = keep
    return (up - down) / (2 * eps)


def test_recurrent_gradients():
    rng = np.random.default_rng(0)
    model = toxicity.Model.start([[b"a"], [b"b"]], np.array([0, 1], np.float32))
    model.p = {k: (v + rng.normal(0, 0.3, v.shape)).astype(np.float64) for k, v in model.p.items()}
    x = rng.normal(0, 1, (6, 2 * toxicity.DIM))
    at = rng.integers(0, 6, (5, 4))
    mask = np.array([[1, 1, 1, 1], [1, 1, 1, 1], [1, 1, 0, 1], [1, 0, 0, 1], [1, 0, 0, 1]], bool)
    y, weight = np.array([0., 1, 1, 0]), np.array([1., 2, 1, 1])
    g, dx, _ = model.gradients(x, at, mask, y, weight)
    loss = lambda: model.gradients(x, at, mask, y, weight)[2]
    for name in ("Wf", "Wb", "Uf", "Ub", "bf", "bb", "A", "a", "v", "o", "c"):
        for _ in range(4):
            where = tuple(int(rng.integers(n)) for n in model.p[name].shape)
            assert abs(numeric(loss, model.p[name], where, 1e-4) - g[name][where]) < 1e-4, name
    for _ in range(6):
        where = (int(rng.integers(6)), int(rng.integers(2 * toxicity.DIM)))
        assert abs(numeric(loss, x, where, 1e-4) - dx[where]) < 1e-4


def test_convolution_gradients():
    rng = np.random.default_rng(0)
    model = quality_cnn.Model.start()
    model.p = {k: (v + rng.normal(0, 0.3, v.shape)).astype(np.float64) for k, v in model.p.items()}
    chunks = rng.integers(97, 100, (3, 12), dtype=np.uint8)
    flags = rng.integers(0, 3, (3, 9), dtype=np.uint8)
    owner, y, weight = np.array([0, 0, 1]), np.array([1., 0]), np.array([1., 1])
    g, _ = model.gradients(chunks, flags, owner, y, weight)
    loss = lambda: model.gradients(chunks, flags, owner, y, weight)[1]
    for name, where in [("T", (k, 97 + k % 3, k * 3)) for k in range(4)] + [("w", (2,)), ("b", (5,)), ("c", (0,)), ("S", (1, 3))]:
        assert abs(numeric(loss, model.p[name], where, 1e-5) - g[name][where]) < 1e-3, name


def test_toxic_held_out(spark):
    rows = labelled(spark, "toxic")
    got = {r.doc_id: r for r in queries.QUERIES["op9_toxicity"](spark, SF).collect()}
    held = [(got[d], y) for d, _, y in rows if zlib.crc32(str(d).encode()) % 5 == 0]
    assert all(g.held_out for g, _ in held) and all(0 <= g.score <= 1 for g in got.values())
    assert np.mean([g.predicted == y for g, y in held]) > 0.9
    assert all(g.predicted == (g.score >= 0.5) for g in got.values())


def test_quality_held_out(spark):
    rows = labelled(spark, "quality")
    got = {r.doc_id: r for r in queries.QUERIES["op7_quality_cnn"](spark, SF).collect()}
    held = [(got[d], y) for d, _, y in rows if zlib.crc32(str(d).encode()) % 3 == 1]
    assert all(g.held_out for g, _ in held) and all(0 <= g.score <= 1 for g in got.values())
    assert np.mean([g.predicted == y for g, y in held]) > 0.9


def test_insult_anywhere_in_a_long_text(toxic_model):
    scorer = toxicity.Scorer(toxic_model)
    plain = ["w1"] * 120_000
    assert scorer.scores([" ".join(plain).encode()])[0] < 0.5
    for at in (0, 31, 49_151, 49_152, 49_160, 98_303, 98_304, 119_999):
        w = list(plain)
        w[at] = "insult1"
        assert scorer.scores([" ".join(w).encode()])[0] >= 0.5, at


@pytest.mark.parametrize("fill", ["x", "é", "日", "、"])
def test_insult_anywhere_in_a_long_run(toxic_model, fill):
    scorer = toxicity.Scorer(toxic_model)
    plain = scorer.scores([(fill * 200).encode(), b"w1 w2 " + (fill * 5000).encode()])
    assert (plain < 0.5).all()
    runs = [(fill * a + "insult1" + fill * (200 - a)).encode() for a in range(201)]
    runs.append((fill * 100_000 + "insult1" + fill * 9).encode())
    assert [i for i, s in enumerate(scorer.scores(runs)) if s < 0.5] == []
    assert scorer.scores(["　".join(["日本"] * 300 + ["insult1"]).encode()])[0] >= 0.5


def test_parts_cover_every_word():
    for n in (*range(1, 200), 100_003):
        word = "".join(chr(0x4E00 + i % 997) for i in range(n))
        own = toxicity.parts(word.encode())
        want = f"^{word}$"
        assert set().union(*map(toxicity.grams, own)) == {
            want[i:i + k] for k in (3, 4, 5) for i in range(len(want) - k + 1)}
        assert all(len(p.strip(b" ").decode()) <= toxicity.WORD for p in own)
    assert toxicity.words(b"Ab " + b"c" * 40) == [b"ab", b"c" * 40]


def test_windows_cover_every_word():
    for n in range(1, 200):
        starts = toxicity.window_starts(n)
        assert set().union(*(range(a, min(n, a + toxicity.WINDOW)) for a in starts)) == set(range(n))


def test_forgetting_words_changes_nothing(toxic_model, monkeypatch):
    texts = [b"w1 w2 insult1 w3", b"w4 w5", b"", b"w9 insult3 unseen"]
    want = toxicity.Scorer(toxic_model).scores(texts)
    monkeypatch.setattr(toxicity, "CACHE", 2)
    assert np.allclose(toxicity.Scorer(toxic_model).scores(texts), want, atol=1e-6)


def test_convolution_scores_whole_texts_alike(quality_model, monkeypatch):
    rng = np.random.default_rng(1)
    texts = [bytes(rng.integers(97, 123, n, dtype=np.uint8)) for n in (1, 5, 31, 32, 33, 479, 480, 512, 513, 5000)]
    texts.append(b"one two\n" * 900 + b"x$$$ y$$$ " * 300)
    alone = [quality_model.scores([t])[0] for t in texts]
    assert np.allclose(quality_model.scores(texts), alone, atol=1e-5)
    whole = quality_model.logits(texts)
    monkeypatch.setattr(quality_cnn, "BYTES", 1024)
    assert np.allclose(quality_model.logits(texts), whole, atol=1e-5)


def test_last_byte_of_a_text_in_several_runs(monkeypatch):
    model = quality_cnn.Model.start()
    model.p = {k: np.zeros_like(v) for k, v in model.p.items()}
    model.p["T"][3, ord("z"), 0] = model.p["w"][0] = 1
    model.ready()
    monkeypatch.setattr(quality_cnn, "BYTES", 1024)
    for n in range(4 * quality_cnn.STRIDE, 4 * quality_cnn.STRIDE + 70):
        assert model.logits([b"a" * (n - 1) + b"z"])[0] > 0, n


def test_junk_part_of_a_long_text_counts(quality_model):
    good = b"abcde fghij klmno " * 3000
    junk = b"abcde$$$ fghij$$$ " * 9000
    a, b = quality_model.logits([good, good + junk])
    assert b < a


@pytest.mark.parametrize("module", [toxicity, quality_cnn])
def test_odd_rows(spark, odd, none, module, toxic_model, quality_model):
    model = toxic_model if module is toxicity else quality_model
    rows = module.score(spark, odd, model).collect()
    assert len(rows) == odd.count()
    for r in rows:
        assert 0 <= r.score <= 1
        if not r.row.text:
            assert r.score == 0
    assert [set(r.row.asDict()) for r in rows[:1]] == [set(odd.columns)]
    assert module.score(spark, none, model).collect() == []


@pytest.mark.parametrize("module", [toxicity, quality_cnn])
def test_without_labels_all_score_zero(spark, odd, module):
    labels = spark.createDataFrame([(1, None, None), (2, 1, 1), (None, 0, 0)], "doc_id long, quality int, toxic int")
    model = module.fit(odd, labels)
    assert model is None
    assert {r.score for r in module.score(spark, odd, model).collect()} == {0.0}
