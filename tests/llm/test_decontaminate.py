"""Wu-Manber search against brute force over words."""
import re
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from hotspots.llm import decontaminate, queries

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(t):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items):
    windows = {}
    for i, t in items:
        w = low(t)
        for j in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[j:j + 13]), set()).add("" if i is None else str(i))
    sizes = {len(w) for w in windows}
    out = []
    for d, t in docs:
        w, hit, ids = low(t), set(), set()
        for n in sizes:
            for j in range(len(w) - n + 1):
                found = windows.get(tuple(w[j:j + n]))
                if found:
                    hit.update(range(j, j + n))
                    ids |= found
        out.append((d, len(w), len(hit), sorted(ids)))
    return out


def judged(spark, docs, items, **more):
    found = decontaminate.find_hits(spark, docs, items, **more)
    return [(r.row.doc_id, r.n_words, sum(x.last - x.first for x in r.hit_ranges), r.item_ids) for r in found.collect()]


def test_query_equals_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.contaminated)
           for r in queries.QUERIES["op3_decontaminate"](spark, SF).collect()}
    assert got == {d: (n, h, len(i), h > 0 and 20 * h >= n) for d, n, h, i in brute(docs, items)}
    assert any(v[3] for v in got.values())


def items_of(spark):
    return spark.createDataFrame(
        [(1, "the thing of her and re with that inged on the er ble an of to in is"), (2, "Re"), (3, "日本 end"),
         (4, None), (5, "..."), (6, "re"), (None, "sh thin of"), (7, "wh re the sh"), (7, "it was for")],
        "item_id long, text string")


def test_odd_rows_short_items_and_blocks(spark, odd):
    items = items_of(spark)
    want = sorted(brute([(r.doc_id, r.text) for r in odd.collect()], [(r.item_id, r.text) for r in items.collect()]), key=str)
    assert sorted(judged(spark, odd, items), key=str) == want
    assert sorted(judged(spark, odd, items, block_bytes=20), key=str) == want
    assert sorted(judged(spark, odd, items, block_bytes=20, pass_blocks=2), key=str) == want


def test_empty_tables(spark, odd, none):
    items = items_of(spark)
    assert judged(spark, none, items) == []
    assert all(h == 0 and i == [] for _, _, h, i in judged(spark, odd, items.limit(0)))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab é.", max_size=40), max_size=5), st.lists(st.text("ab é.", max_size=12), max_size=6))
def test_matches_brute_force(texts, items):
    items = [(i, t) for i, t in enumerate(items)]
    search = decontaminate.Search([(str(i), t.encode()) for i, t in items])
    lists = [decontaminate.words(t.encode()) for t in texts]
    got = [(k, len(w), 0, []) for k, w in enumerate(lists)]
    for k, spans, ids in search.hits(lists):
        got[k] = (k, len(lists[k]), sum(b - a for a, b in decontaminate.hit_words(lists[k], spans)), sorted(ids))
    assert got == brute(list(enumerate(texts)), items)


def test_long_passage_at_lane_edges():
    passage = " ".join(f"w{i}" for i in range(60))
    for gap in range(2030, 2060):
        text = ("x" * gap + " " + passage + " y").encode()
        search = decontaminate.Search([("p", passage.encode())])
        [(_, spans, ids)] = list(search.hits([decontaminate.words(text)]))
        assert ids == {"p"} and decontaminate.hit_words(decontaminate.words(text), spans) == [(1, 61)]


@pytest.mark.parametrize("n", [65_535 - 40, 65_535, 65_535 + 40, 70_000])
def test_windows_of_very_long_words(n):
    word = ("é" * n)[:n]
    items = [("long", word), ("two", word + " b"), ("none", "")]
    search = decontaminate.Search([(i, t.encode()) for i, t in items])
    docs = [word, "a " + word + " b c", word + "x", "b " + word[:-1], "x" + word]
    got = {k: ids for k, _, ids in search.hits([decontaminate.words(t.encode()) for t in docs])}
    assert got == {0: {"long"}, 1: {"long", "two"}}


def test_tables_are_built_quickly_and_once():
    rng = np.random.default_rng(1)
    vocabulary = np.array([f"w{i}" for i in range(20_000)])
    items = [(str(i), " ".join(rng.choice(vocabulary, 1000)).encode()) for i in range(600)]
    begun = time.process_time()
    search = decontaminate.Search(items)
    assert sum(len(t) for _, t in items) > 3_500_000 and time.process_time() - begun < 8
    [(_, spans, ids)] = list(search.hits([decontaminate.words(b"x " + items[77][1][:400] + b" y")]))
    assert ids == {"77"} and spans


def test_a_pass_over_the_documents_takes_several_blocks(spark):
    docs = spark.createDataFrame([(1, "one two three four"), (2, "five")], "doc_id long, text string")
    items = spark.createDataFrame([(i, f"{w}") for i, w in enumerate("one two three four five six".split())],
                                  "item_id long, text string")
    found = decontaminate.find_hits(spark, docs, items, block_bytes=4, pass_blocks=6)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
    assert {r.row.doc_id: r.item_ids for r in found.collect()} == {1: ["0", "1", "2", "3"], 2: ["4"]}
