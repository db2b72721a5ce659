"""SimHash near-duplicates against brute force."""
import re
from collections import defaultdict

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from hotspots.llm import queries, simhash
from hotspots.llm.components import stars

SF = "/root/testdata/sf0.001"


def fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i:i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(nodes, pairs):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n
    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def close_pairs(codes, distance=4):
    c = np.array(codes, np.uint64)
    i, j = np.where(np.triu(np.bitwise_count(c[:, None] ^ c[None, :]) <= distance, 1))
    return list(zip(i.tolist(), j.tolist()))


def test_query_equals_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.QUERIES["op1_simhash"](spark, SF).collect()}
    codes = [fingerprint(t) for _, t in docs]
    root = components([d for d, _ in docs], [(docs[i][0], docs[j][0]) for i, j in close_pairs(codes)])
    assert got == {d: (f"{c:016x}", root[d]) for (d, _), c in zip(docs, codes)}


def test_odd_rows(odd):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    by_code = defaultdict(set)
    for r in rows:
        by_code[r.component_id].add((r.id, r.fingerprint))
    zero = {i for g in by_code.values() for i, f in g if f == 0}
    assert zero == {2, 3, 4, None}
    assert all(r.component_id == 2 for r in rows if r.fingerprint == 0)
    assert {i for i, _ in by_code[1]} == {1, 5}


def test_only_null_ids_have_no_component(spark):
    df = spark.createDataFrame([(None, "a b c"), (None, "a b c")], "doc_id long, text string")
    assert [r.component_id for r in simhash.near_duplicates(df).collect()] == [None, None]


def test_empty_table(none):
    assert simhash.near_duplicates(none).collect() == []
    assert simhash.keep_one(none).columns == none.columns
    assert simhash.keep_one(none).collect() == []


def test_keep_one_keeps_columns_and_one_row_each(odd):
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    ids = sorted(str(r.doc_id) for r in kept.collect())
    wanted = {r.component_id for r in simhash.near_duplicates(odd).collect()}
    assert len(ids) == len(wanted) and {i for i in ids if i != "None"} == {str(w) for w in wanted if w is not None}


def test_keep_one_of_identical_rows(spark):
    df = spark.createDataFrame([(3, "x y z")] * 5 + [(4, "other words here now")], "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.keep_one(df).collect()) == [3, 4]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=6),
       st.lists(st.tuples(st.integers(0, 5), st.lists(st.integers(0, 63), max_size=6)), max_size=80))
def test_index_finds_the_same_classes(bases, changes):
    codes = set(bases)
    for k, bits in changes:
        c = bases[k % len(bases)]
        for b in bits:
            c ^= 1 << b
        codes.add(c)
    codes = np.array(sorted(codes), np.uint64)
    index = simhash.Index(codes)
    edges = [(int(index.codes[a]), int(index.codes[b])) for a, b in index.links(4)]
    want = components(codes.tolist(), [(int(codes[i]), int(codes[j])) for i, j in close_pairs(codes)])
    assert components(codes.tolist(), edges) == want
    assert len(edges) == len(codes) - len(set(want.values()))


def test_dense_group_returns_a_forest():
    rng = np.random.default_rng(0)
    codes = np.unique(np.uint64(12345) ^ (np.uint64(1) << rng.integers(0, 64, 4000).astype(np.uint64))
                      ^ (np.uint64(1) << rng.integers(0, 64, 4000).astype(np.uint64)))
    assert len(simhash.Index(codes).links(4)) == len(codes) - 1


def test_small_buckets_are_dealt_again(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 20, dtype=np.uint64)
    codes = base[rng.integers(0, 20, 300)]
    for _ in range(6):
        codes = codes ^ np.where(rng.random(300) < 0.7, np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64), np.uint64(0))
    codes = np.unique(codes)
    marked = spark.createDataFrame([(int(x),) for x in codes.view(np.int64)], "fingerprint long")
    got = defaultdict(set)
    for r in simhash.classes(marked, 4, bucket=3).collect():
        got[r.root].add(r.fp)
    want = defaultdict(set)
    signed = codes.view(np.int64).tolist()
    for n, r in components(list(range(len(codes))), close_pairs(codes)).items():
        want[r].add(signed[n])
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_no_task_takes_a_bucket_that_stays_hot(spark, monkeypatch):
    rng = np.random.default_rng(5)
    codes = sorted({int(x) for x in rng.integers(0, 1 << 16, 400)})
    links, most = simhash._bucket_links, []

    def watched(rows, distance):
        keys = [c for c in rows.columns if c != "fp"]
        most.append(rows.groupBy(*keys).count().agg({"count": "max"}).first()[0] or 0)
        return links(rows, distance)

    monkeypatch.setattr(simhash, "_bucket_links", watched)
    df = spark.createDataFrame([(c,) for c in codes], "fp long")
    edges = [(r.a, r.b) for r in simhash.link_edges(df, 2, bucket=40).collect()]
    assert max(most) <= 80
    assert all((a ^ b).bit_count() <= 2 for a, b in edges)
    want = components(codes, [(codes[i], codes[j]) for i, j in close_pairs(codes, 2)])
    assert components(codes, edges) == want


def test_stars_on_chains_and_loops(spark):
    chain = [(i, i + 1) for i in range(40)]
    edges = spark.createDataFrame(chain + [(100, 102), (102, 101), (100, 100), (101, 100)], "a long, b long")
    got = {r.u: r.v for r in stars(edges).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 101: 100, 102: 100}
    assert stars(edges.limit(0)).collect() == []
