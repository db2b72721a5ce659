"""Cross-parsing against a plain restatement, and accuracy on held-out rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from hotspots.llm import language_id as li
from hotspots.llm.training import fold


def phrases(text, texts):
    """Longest matches, one after the other, by substring search."""
    big = b"\0".join(texts)
    at = n = 0
    while at < len(text):
        end = at + 1
        while end <= len(text) and text[at:end] in big:
            end += 1
        at = max(at + 1, end - 1)
        n += 1
    return n


def prose(rng, syllables, n):
    return " ".join("".join(rng.choice(syllables, rng.integers(1, 4))) for _ in range(n)).encode()


def small_model(seed=1, n=300):
    rng = np.random.default_rng(seed)
    kinds = {"aa": ["tha", "ing", "er", "o"], "bb": ["sch", "ung", "er", "ü"], "cc": ["ción", "os", "ara", "o"]}
    samples = {name: [li.normalised(prose(rng, s, n)) for _ in range(4)] for name, s in kinds.items()}
    return rng, kinds, samples, li.train(samples)


def test_phrases_equal_the_restatement(monkeypatch):
    monkeypatch.setattr(li, "BLOCK", 96)
    monkeypatch.setattr(li, "WARM", 16)
    monkeypatch.setattr(li, "PIECE", 1000)
    monkeypatch.setattr(li, "LANES", 2)
    rng, kinds, samples, model = small_model()
    parser = li.Parser(model)
    texts = [li.normalised(prose(rng, list(kinds[k]), int(n))) for k in kinds for n in (1, 3, 40, 200, 900)]
    texts += [b"", li.normalised(b"x"), li.normalised("日本語 ".encode() * 50), li.normalised(b"a" * 3000),
              li.normalised(b"tha" * 700), li.normalised(b"ererer o " * 300), li.normalised(b"q" * 95 + b"o" * 400)]
    got = parser.phrases(texts)
    want = [[phrases(t, samples[name]) for name in parser.names] for t in texts]
    assert got.tolist() == want


def test_automaton_reads_exactly_the_substrings():
    texts = [b"abcbc", b"bcab", b"", b"aab"]
    a = li.Automaton(texts)
    table = {(s, c): t for s, c, t in a.edges().tolist()}
    substrings = {t[i:j] for t in texts for i in range(len(t)) for j in range(i, len(t) + 1)}

    def reads(w):
        s = 0
        for c in w:
            s = table.get((s, c))
            if s is None:
                return False
        return True
    from itertools import product
    words = {bytes(p) for n in range(6) for p in product(b"abc", repeat=n)}
    assert {w for w in words if reads(w)} == {w for w in words if w in substrings}
    assert len(a.size) <= 2 * sum(map(len, texts))


def test_fewest_normalised_phrases_win_and_score():
    _, _, samples, model = small_model(2)
    parser = li.Parser(model)
    text = "Thaing eroing, THA 12 inger!".encode()
    names, score = parser.judge([text, b"", b"12 !?", "日本".encode(), "÷".encode(), b"Schung"])
    bits = np.array([phrases(li.normalised(text), samples[n]) * np.log2(sum(map(len, samples[n]))) for n in parser.names])
    assert names[0] == parser.names[bits.argmin()] == "aa" and names[5] == "bb"
    assert score[0] == pytest.approx(1 / np.exp2(bits.min() - bits).sum())
    assert names[1] == names[2] == names[4] == "und" and names[3] != "und"
    assert score[1] == score[2] == 0 and ((score >= 0) & (score <= 1)).all()


def test_mislabelled_sample_texts_go():
    rng, kinds, samples, _ = small_model(3, 60)
    odd = li.normalised(prose(rng, kinds["bb"], 60))
    mixed = {**samples, "aa": samples["aa"] + [odd]}
    assert li.agreed(mixed) == {**samples, "aa": samples["aa"]}
    assert li.agreed({"aa": samples["aa"][:1]}) == {"aa": samples["aa"][:1]}


def test_sample_is_bounded_and_holds_copies_once(spark):
    rows = [(i, "same text of many copies", "en") for i in range(500)]
    rows += [(1000 + i, f"text {chr(97 + i % 26)}{chr(97 + i // 26)} " * 30, "en" if i % 2 else "de") for i in range(400)]
    rows += [(5000, None, "en"), (5001, "kein label", None), (5002, "nothing known", "und")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    size = li.SampleSize(per_language=3000, total=5000, per_text=200)
    got = li.sample(docs, F.lit(True), size)
    assert set(got) == {"en", "de"}
    for texts in got.values():
        assert len(set(texts)) == len(texts) and sum(map(len, texts)) <= 2500 + 210
    assert got == li.sample(docs.repartition(2), F.lit(True), size)
    assert set(li.sample(docs, F.lit(True), li.SampleSize(languages=1))) == {"en"}


def test_held_out_accuracy_of_the_registered_query(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    got = E.queries()["op11_language_id"](spark, sf)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"]
    rows = got.join(docs, "doc_id").collect()
    assert len(rows) == docs.count()
    held = [r.lang == r.lang_pred for r in rows if r.held_out]
    assert len(held) > 200 and np.mean(held) > 0.98
    assert {r.doc_id for r in rows if r.held_out} == {r.doc_id for r in docs.filter(fold("doc_id", 4) == 2).collect()}


def test_registered_query_equals_the_restatement(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    samples = li.agreed(li.sample(docs, fold("doc_id", 4) != 2))
    names = sorted(samples)
    bits = np.log2([sum(map(len, samples[n])) for n in names])
    got = {r.doc_id: r for r in E.queries()["op11_language_id"](spark, sf).collect()}
    for r in docs.filter(F.length("text") < 400).collect():
        t = li.normalised(r.text.encode())
        code = np.array([phrases(t, samples[n]) for n in names]) * bits
        assert got[r.doc_id].lang_pred == names[code.argmin()]
        assert got[r.doc_id].score == pytest.approx(1 / np.exp2(code.min() - code).sum())


def test_odd_rows_and_clashing_columns(spark, odd, none):
    docs = odd.withColumn("lang", F.when(F.col("doc_id") > 3, "en")).withColumn("lang_pred", F.lit(1))
    model = li.fit(docs, F.lit(True))
    done = li.predict(spark, docs, model)
    assert done.select("row.*").columns == docs.columns
    rows = done.collect()
    assert len(rows) == odd.count()
    for r in rows:
        blank = not (r["row"]["text"] or "").strip()
        assert (r["lang_pred"], r["score"]) == (("und", 0.0) if blank else ("en", 1.0))
    assert li.fit(none.withColumn("lang", F.lit("en")), F.lit(True)) is None
    assert {r["lang_pred"] for r in li.predict(spark, docs, None).collect()} == {"und"}
    assert li.predict(spark, none, model).count() == 0
