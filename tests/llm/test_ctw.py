"""Context-tree weighting against a recursive restatement."""
import collections
import math
import zlib

import numpy as np

from hotspots.llm import ctw, queries
from hotspots.session import scratch_dir

D = ctw.DEPTH


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 10 == 0


def restated(rows):
    """log10 probability of every text, by the definition."""
    counts, kids = collections.defaultdict(lambda: [0, 0]), collections.defaultdict(set)
    low = [(i, (t or "").encode().lower()) for i, t in rows]

    def decisions(t):
        s = b"\0" * D + t + b"\0"
        for i in range(D, len(s)):
            node = 1
            for k in range(8):
                bit = s[i] >> (7 - k) & 1
                yield s[i - D:i], node, bit
                node = 2 * node + bit
    for i, t in low:
        if not held(i):
            for ctx, node, bit in decisions(t):
                for d in range(D + 1):
                    counts[ctx[D - d:], node][bit] += 1
                    if d:
                        kids[ctx[D - d + 1:], node].add((ctx[D - d:], node))

    def kt(a, b):
        return math.lgamma(a + .5) + math.lgamma(b + .5) - math.lgamma(a + b + 1) - math.log(math.pi)
    memo = {}

    def block(key):
        if key not in memo:
            own = kt(*counts[key])
            memo[key] = own if len(key[0]) == D else np.logaddexp(own, sum(map(block, kids[key]))) - math.log(2)
        return memo[key]

    def score(t):
        total = 0.0
        for ctx, node, bit in decisions(t):
            p = None
            for d in range(D, -1, -1):
                key = (ctx[D - d:], node)
                a, b = counts.get(key, (0, 0))
                if a + b == 0 and d:
                    continue
                own = ((b if bit else a) + .5) / (a + b + 1)
                if p is None:
                    p = own
                else:
                    w = math.exp(kt(a, b) - math.log(2) - block(key))
                    p = w * own + (1 - w) * p
            total += math.log10(p)
        return total
    return [score(t) for _, t in low]


def base(rows):
    count = collections.Counter()
    for i, t in rows:
        if not held(i):
            count.update([*(t or "").encode().lower().split(), None])
    n, v = sum(count.values()), len(count)
    out = []
    for _, t in rows:
        tokens = [*(t or "").encode().lower().split(), None]
        out.append((len(tokens), sum(count[w] > 0 for w in tokens), n,
                    sum(math.log10((count[w] + .1) / (n + .1 * (v + 1))) for w in tokens)))
    return out


ROWS = [(i, t) for i, t in enumerate(
    ["The cat sat on the mat.", "the dog sat", None, "", "A dog and a cat", "the the the", "zebra quagga",
     "on the mat the cat sat", "mat", "THE CAT", "naïve café", "and so on and on", "dog", "cat sat on a dog"])]


def check(df, rows):
    got = sorted(df.collect(), key=lambda r: (str(r.i), str(r.row.text)))
    order = sorted(range(len(rows)), key=lambda k: (str(rows[k][0]), str(rows[k][1])))
    for r, k, in zip(got, order):
        n_tokens, n_known, n, b = base(rows)[k]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(rows[k][0]), n_tokens, n_known, n)
        assert math.isclose(r.base_score, b, rel_tol=1e-9, abs_tol=1e-9)
        assert math.isclose(r.score, restated(rows)[k], rel_tol=1e-6)
    assert len(got) == len(rows)


def test_equals_restatement(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3)
    check(ctw.score(spark, df).selectExpr("row.doc_id AS i", "*"), ROWS)


def test_repeated_rows_null_ids_and_other_columns(spark):
    rows = [*ROWS, *ROWS[:3], (None, "a cat sat")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS row", "'x' AS body", "0 AS held")
    check(ctw.score(spark, df).selectExpr("row.doc_id AS i", "*"), rows)


def test_registered_query_gives_the_code_length(spark):
    folder = f"{scratch_dir(spark, 'ctw-test')}"
    spark.createDataFrame(ROWS, "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    got = {r.doc_id: r for r in queries.QUERIES["op2_ctw_score"](spark, folder).collect()}
    assert len(got) == len(ROWS)
    for (i, t), want, (n_tokens, n_known, n, b) in zip(ROWS, restated(ROWS), base(ROWS)):
        r, size = got[i], len((t or "").encode()) + 1
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.n_bytes) == (held(i), n_tokens, n_known, n, size)
        assert math.isclose(r.base_score, b, rel_tol=1e-9) and math.isclose(r.score, want, rel_tol=1e-6)
        assert math.isclose(r.code_length_per_byte, -want * math.log2(10) / size, rel_tol=1e-6)


def test_groups_of_one_run(spark, monkeypatch):
    monkeypatch.setattr(ctw, "GROUP_BYTES", 16)
    monkeypatch.setattr(ctw, "RUN_BYTES", 16)
    df = spark.createDataFrame(ROWS, "doc_id long, text string").coalesce(1)
    check(ctw.score(spark, df).selectExpr("row.doc_id AS i", "*"), ROWS)


def test_only_held_out_rows_know_nothing(spark):
    ids = [i for i in range(200) if held(i)][:2]
    df = spark.createDataFrame([(i, "ab") for i in ids], "doc_id long, text string")
    for r in ctw.score(spark, df).collect():
        assert (r.held_out, r.n_known, r.train_tokens) == (True, 0, 0)
        assert math.isclose(r.score, -24 * math.log10(2), rel_tol=1e-6)


def test_empty_table(spark, none):
    assert ctw.score(spark, none).collect() == []


def test_very_long_text(spark, odd):
    rows = ctw.score(spark, odd.filter("doc_id = 6"), keep=["doc_id"]).collect()
    assert len(rows) == 1 and rows[0].n_tokens == 30_000 * 7 + 1 and rows[0].score < 0


def test_blocks_round_trip():
    keys = np.unique(np.random.default_rng(0).integers(0, 2**63, 1000, dtype=np.uint64))
    assert (ctw.unpack_keys(ctw.pack_keys(keys)) == keys).all()
    assert len(ctw.unpack(ctw.pack(np.empty(0, np.int64)), np.int64)) == 0
    values = np.arange(len(keys)).astype(np.float64)
    assert (ctw.Lookup(keys, values)(keys[::-1]) == values[::-1]).all()
