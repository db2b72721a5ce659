"""Spelling variants against plain restatements."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest

from hotspots.llm import spelling_variants as sv


def changed(run, doc_id):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{low}".encode())
    return low if h % 97 else low[:h % len(low)] + low[h % len(low) + 1:]


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) < len(b):
        a, b = b, a
    return any(a[:i] + a[i + 1:] == b for i in range(len(a)))


def restated(docs):
    counts = Counter(changed(r, i) for i, t in docs for r in re.findall("[A-Za-zÀ-ÿ]+", t or ""))
    n = {w: c for w, c in counts.items() if len(w) >= 5 and c >= 3}
    close = {w: [x for x in n if near(w, x)] for w in n}
    form = {w: min(xs, key=lambda x: (-n[x], x)) if xs else None for w, xs in close.items()}
    form = {w: f if f is not None and n[f] >= 2 * n[w] else None for w, f in form.items()}
    out = {}
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n[w], len(close[w]), n[form[w]] if form[w] else None)
    return out


def answer(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def random_docs(seed, letters="abcé", size=400):
    rng = np.random.default_rng(seed)
    base = ["".join(rng.choice(list(letters), rng.integers(4, 9))) for _ in range(60)]
    docs = []
    for i in range(40):
        some = []
        for w in rng.choice(base, size // 10, p=(1 / np.arange(1, 61)) / (1 / np.arange(1, 61)).sum()):
            w = list(w)
            if rng.random() < 0.4:
                at = rng.integers(0, len(w))
                w[at:at + rng.integers(0, 2)] = [] if rng.random() < 0.3 else [rng.choice(list(letters))]
            some.append("".join(w).upper() if rng.random() < 0.1 else "".join(w))
        docs.append((i, " ".join(some) + "; É÷× 12"))
    return docs


@pytest.mark.parametrize("seed", [1, 2])
def test_results_equal_the_restatement(spark, seed):
    docs = random_docs(seed)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    want = restated(docs)
    assert sum(x[0] is not None for x in want.values()) > 5
    assert answer(sv.group_variants(spark, df)) == want


@pytest.mark.parametrize("bucket", [1, 3, 1000])
def test_hot_reduced_words_lose_no_pair(spark, bucket):
    rng = np.random.default_rng(9)
    names = sorted({"".join(rng.choice(list("abcdeéz"), rng.integers(5, 8))) for _ in range(600)})
    vocab = spark.createDataFrame([(w, 3 + i % 5) for i, w in enumerate(names)], "word string, n long").checkpoint()
    got = {(r.a, r.b) for r in sv.near_pairs(vocab, symbols=2 if bucket < 1000 else 8, bucket=bucket).collect()}
    assert got == {(a, b) for a in names for b in names if a < b and near(a, b)}


def test_neighbourhoods_hold_every_near_word():
    rng = np.random.default_rng(4)
    for symbols in (2, 8, len(sv.LETTERS)):
        for _ in range(200):
            a = "".join(rng.choice(list("abcxyzéü"), rng.integers(5, 12)))
            at = int(rng.integers(0, len(a) + 1))
            kind = rng.integers(0, 3)
            b = a[:at] + ("" if kind == 0 else str(rng.choice(list("abcxyzéü")))) + a[at + (kind != 1):]
            if a == b or len(b) < 5:
                continue
            found = False
            for x, y in ((a, b), (b, a)):
                own = int(sv.Reduced([y], symbols).own()[0])
                block = sv.Reduced([x], symbols)
                keys = [int(block.own()[0])] + [int(k) for _, ks in block.lower() for k in ks]
                assert len(keys) == len(set(keys))
                found |= own in keys
            assert found


def test_finer_symbols_refine_coarser_ones():
    order = np.array(sv.LETTERS)
    fine = sv._symbol_table(len(sv.LETTERS))[order]
    assert sorted(fine.tolist()) == list(range(1, len(order) + 1))
    for symbols in (2, 4, 8):
        coarse = sv._symbol_table(symbols)[order][np.argsort(fine)]
        assert (np.diff(coarse.astype(int)) >= 0).all() and coarse.max() == symbols


def test_long_words_meet(spark):
    rng = np.random.default_rng(5)
    long = "".join(rng.choice(list("acgt"), 5000))
    edge = "".join(rng.choice(list("acgt"), sv.CARRIED))
    names = [long, long[:777] + long[778:], long[:777] + "x" + long[778:], long + "a", edge, edge + "t", edge[:-1],
             edge[:-1] + "q" + "w"]
    vocab = spark.createDataFrame([(w, 3) for w in names], "word string, n long").checkpoint()
    for bucket in (1, 1000):
        got = {(r.a, r.b) for r in sv.near_pairs(vocab, bucket=bucket).collect()}
        assert got == {(a, b) for a in names for b in names if a < b and near(a, b)}


def test_chain_of_forms_ends_at_its_root(spark):
    names = ["aaaaaa", "aaaaab", "aaaabb", "aaabbb", "aabbbb", "abbbbb", "bbbbbb"]
    docs = [(i, " ".join([w] * (3 * 2 ** k))) for k, w in enumerate(names) for i in [k * 1000]]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = answer(sv.group_variants(spark, df))
    assert got == restated(docs)


def test_odd_rows_and_clashing_columns(spark, odd, none):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    clash = odd.withColumn("word", odd.doc_id).withColumn("n", odd.doc_id).withColumn("id", odd.doc_id)
    assert answer(sv.group_variants(spark, clash)) == restated(rows)
    empty = sv.group_variants(spark, none)
    assert empty.count() == 0 and empty.columns == ["word", "form", "root", "n", "n_near", "form_n"]
