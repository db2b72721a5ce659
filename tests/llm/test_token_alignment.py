"""Token alignment against a plain restatement with the tokenizers' own libraries."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest

import __spark_entry__ as E
from hotspots.llm import token_alignment as ta

PATH_A, PATH_B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
TEXTS = [
    "The quick brown fox's tokenization isn't aligned.", "", None, " ", "\n", "  two  spaces ", "tab\tand\nline \n x",
    "a▁b", "▁", "ünïcödé wörds çéñ", "日本語のテキスト 123 456", "emoji 👩‍👩‍👧 end", "<|endoftext|> and </s> <s> <unk> <0x41>",
    "x\x1cy z\x85w ᠎v u", "\x00 nul", "word " * 3000, "z" * 5000, "Ǆ ɐɑ ʰ ꙮ mixed text", "'s 's don't we'll 'sx",
    "The quick brown fox's tokenization isn't aligned.", " leading", "trailing ", "a  b c", "tokens, groups; links|bars",
]


def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(PATH_A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=PATH_B)


def byte_tables(a, b):
    chars = ta._byte_level()
    bytes_a = {i: ("<|endoftext|>".encode() if t == "<|endoftext|>" else bytes(chars[c] for c in t))
               for t, i in a.get_vocab().items()}
    bytes_b = {i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
               for i in range(b.get_piece_size())}
    return bytes_a, bytes_b


def restated(texts):
    """Per text (n_a, n_b, n_groups, links, n_overlaps, n_shared, group list), whole texts at once."""
    a, b = libraries()
    bytes_a, bytes_b = byte_tables(a, b)
    out = []
    for t in texts:
        ids_a = a.encode(" " + t, add_special_tokens=False).ids if t else []
        ids_b = b.encode(t) if t else []
        raw = (" " + t).encode() if t else b""
        if (not t or b"".join(bytes_a[i] for i in ids_a) != raw or b"".join(bytes_b[i] for i in ids_b) != raw):
            out.append((0, 0, 0, [], 0, 0, ""))
            continue
        spans = []
        for ids, table in ((ids_a, bytes_a), (ids_b, bytes_b)):
            at, s = 0, []
            for i in ids:
                s.append((at, at + len(table[i]), i))
                at += len(table[i])
            spans.append(s)
        cuts = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        groups, links, shared = [], [], 0
        ia = ib = 0
        for c in cuts:
            ga, gb = [], []
            while ia < len(spans[0]) and spans[0][ia][1] <= c:
                ga.append(spans[0][ia][2])
                ia += 1
            while ib < len(spans[1]) and spans[1][ib][1] <= c:
                gb.append(spans[1][ib][2])
                ib += 1
            groups.append(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)))
            links.append((ga[-1], gb[-1]))
            shared += len(ga) * len(gb)
        over = len(spans[0]) + len(spans[1]) - len(cuts)  # intervals that cover a line twice
        out.append((len(ids_a), len(ids_b), len(cuts), links, over, shared, ";".join(groups)))
    return out


def expected(texts):
    parts = restated(texts)
    counts = Counter(p for x in parts for p in x[3])
    best = Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    return [(n_a, n_b, n_g, len(links), sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links),
             hashlib.sha256(g.encode()).hexdigest() if g else "", over, shared)
            for n_a, n_b, n_g, links, over, shared, g in parts]


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_overlaps", "n_shared"]


def test_results_equal_the_restatement(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id int, text string").repartition(3)
    got = {r["row"]["doc_id"]: tuple(r[c] for c in COLUMNS)
           for r in ta.score_links(spark, docs, PATH_A, PATH_B, keep=["doc_id"]).collect()}
    want = expected([t or "" for t in TEXTS])
    assert [got[i] for i in range(len(TEXTS))] == want


def test_registered_query_equals_the_restatement(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = dict(zip([r.doc_id for r in rows], expected([r.text or "" for r in rows])))
    got = E.queries()["op12_token_alignment"](spark, sf)
    assert dict(got.dtypes)["doc_id"] == "bigint"
    assert {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in got.collect()} == want


def test_group_texts_and_bounded_pair_table(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id int, text string")
    got = ta.align(spark, docs, PATH_A, PATH_B, keep=["doc_id"], group_texts=True).orderBy("row.doc_id").collect()
    assert [r["groups"] for r in got] == [x[6] for x in restated([t or "" for t in TEXTS])]
    a, b = libraries()
    bytes_a, bytes_b = byte_tables(a, b)
    for r in got:
        for a_id, b_id, _ in r["links"]:  # one is a suffix of the other: the bound of the pair table
            assert bytes_a[a_id].endswith(bytes_b[b_id]) or bytes_b[b_id].endswith(bytes_a[a_id])


def test_odd_rows_and_clashing_columns(spark, odd, none):
    clash = odd.withColumn("links", odd.doc_id).withColumn("_key", odd.doc_id).withColumn("n", odd.doc_id)
    done = ta.score_links(spark, clash, PATH_A, PATH_B)
    assert done.select("row.*").columns == clash.columns
    rows = done.collect()
    assert len(rows) == odd.count()
    assert all(r["n_a"] == 0 and r["groups_sha256"] == "" for r in rows if not r["row"]["text"])
    assert ta.score_links(spark, none, PATH_A, PATH_B).count() == 0


def test_csr_product_equals_dense():
    rng = np.random.default_rng(3)
    for _ in range(20):
        x, y = (rng.integers(0, 3, (rng.integers(1, 9), 7)) * rng.integers(0, 2, 7) for _ in range(2))

        def csr(m):
            r, c = np.nonzero(m)
            return ta.Csr(np.concatenate([[0], np.cumsum(np.bincount(r, minlength=len(m)))]), c, m[r, c], m.shape[1])
        dense = np.zeros((len(x), len(y)), int)
        for i, j, v in csr(x).product(csr(y).transposed(), rows=2):
            dense[i, j] = v
        assert (dense == x @ y.T).all()
        assert (csr(x).row_sums(np.arange(7)) == x @ np.arange(7)).all()


def test_shared_links_equal_their_counts():
    x = ta.aligned(np.array([1, 2, 3, 1, 1]), np.array([2, 1, 1, 2, 2]))
    links = [p for i, j in x.shared_links() for p in zip(i.tolist(), j.tolist())]
    assert links == [(0, 0), (0, 1), (1, 0), (1, 1), (2, 2), (2, 3), (3, 4), (4, 4)]
    assert x.shared_counts().tolist() == [2, 2, 2, 1, 1]


def test_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(ta, "CACHE", 50)
    model_a, model_b = ta._model(PATH_A), ta._model(PATH_B)
    small, plain = ta.Pair(model_a, model_b, True), ta.Pair(model_a, model_b)
    for k in range(8):
        texts = [f"common words {k} w{k * 37 + i} and more{i}" for i in range(40)] + ["y" * 100, "common words again"]
        one, two = small.texts(texts), plain.texts(texts)
        assert all((np.array(u) == np.array(v)).all() for u, v in zip(one, two))
        assert len(small.known) < 400


@pytest.mark.parametrize("text", [t for t in TEXTS if t])
def test_segments_join_to_the_text(text):
    assert " ".join(ta.segments(text)) == text


def test_ranks_are_used_only_when_proved():
    import json
    model = json.loads(ta._model(PATH_A))
    assert ta.merges_are_ranks(json.dumps(model).encode())
    model["model"]["merges"][0], model["model"]["merges"][1] = model["model"]["merges"][1], model["model"]["merges"][0]
    assert not ta.merges_are_ranks(json.dumps(model).encode())
