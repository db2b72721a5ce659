"""The codec against the public library."""
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from hotspots.llm import queries
from hotspots.llm import sentencepiece_codec as sc
from hotspots.llm.queries_text import tokenizer_path

SF = "/root/testdata/sf0.001"


def message(number, value):
    """One length-delimited protocol-buffer field."""
    def varint(n):
        out = b""
        while n > 127:
            out += bytes([n & 127 | 128])
            n >>= 7
        return out + bytes([n])
    return varint(number << 3 | 2) + varint(len(value)) + value


@pytest.fixture(scope="module")
def model():
    with open(tokenizer_path(), "rb") as f:
        return f.read()


@pytest.fixture(scope="module")
def pair(model):
    return sc.Codec(model), sentencepiece.SentencePieceProcessor(model_proto=model)


def with_rules(model, rule, **flags):
    """The model with the character map of a named public rule."""
    normalizer = sentencepiece.SentencePieceNormalizer(rule_name=rule, **flags).serialized_model_proto()
    spec = next(v for n, v in sc._fields(normalizer) if n == 3)
    return model + message(3, spec)


def encoded(codec, text):
    return [i for p in codec.encode(text.encode()) for i in p.ids.tolist()]


def decoded(codec, ids):
    import numpy as np
    return b"".join(codec.decode(iter([np.array(ids, np.int32)]))).decode() if ids else ""


ALPHABET = "ab  \n\tä▁�éß日本x\x00🎉<0>s! 　​́ the ing.,ﬁ①Ａ"


@settings(max_examples=300, deadline=None)
@given(st.text(ALPHABET, max_size=60) | st.text(max_size=30))
def test_plain_model_equals_library(pair, text):
    codec, library = pair
    ids = encoded(codec, text)
    assert ids == library.encode(text)
    assert decoded(codec, ids) == library.decode(ids)


@pytest.mark.parametrize("rule", ["nfkc", "nmt_nfkc", "nmt_nfkc_cf"])
@pytest.mark.parametrize("flags", [{}, {"add_dummy_prefix": True, "escape_whitespaces": True, "remove_extra_whitespaces": True}])
def test_character_maps_equal_library(model, rule, flags):
    changed = with_rules(model, rule, **flags)
    codec, library = sc.Codec(changed), sentencepiece.SentencePieceProcessor(model_proto=changed)
    if not codec.escape:
        pytest.skip("rule without white space marks")
    for text in ["ﬁne ①② Ａｂｃ", "  two  spaces ", "Straße İstanbul", "㌔ ｶﾞ é é", "", " ", "a\tb\nc", "▁x ▁", "日本🎉"]:
        assert encoded(codec, text) == library.encode(text), (rule, text)


@settings(max_examples=150, deadline=None)
@given(st.text(ALPHABET, max_size=60))
def test_spans_cover_the_text_in_order(pair, text):
    raw = text.encode()
    parts = list(pair[0].encode(raw))
    spans = [(a, b) for p in parts for a, b in zip(p.begin.tolist(), p.end.tolist())]
    at = 0
    for a, b in spans:
        assert a == at and b >= a
        at = b
    assert at == len(raw)
    if "▁" not in text:
        ids = [i for p in parts for i in p.ids.tolist()]
        surface = pair[0].surface
        # all but the dummy prefix of the first piece is the text of the span
        assert [raw[a:b] for a, b in spans][1:] == [surface[i] for i in ids][1:]


def test_spans_point_at_mapped_characters(model):
    codec = sc.Codec(with_rules(model, "nfkc"))
    raw = "x ﬁ y".encode()
    [p] = list(codec.encode(raw))
    covered = {raw[a:b] for a, b in zip(p.begin.tolist(), p.end.tolist())}
    assert any("ﬁ".encode() in c for c in covered)


def test_long_words_and_texts(pair):
    codec, library = pair
    for text in ["x" * 3000, "ab" * 700 + " " * 400, "the " * 70_000, "é" * 600]:
        ids = encoded(codec, text)
        assert ids == library.encode(text) and decoded(codec, ids) == library.decode(ids)


def test_bytes_that_are_no_character(pair):
    codec, library = pair
    ids = [codec.byte_ids[b] for b in (0xE2, 0x28, 0xA1, 0xF0, 0x9F, 0x41)]
    assert decoded(codec, ids) == library.decode(ids)


def test_query_equals_library(spark, pair):
    import hashlib
    want = {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        ids = pair[1].encode(r.text or "")
        want[r.doc_id] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                          hashlib.sha256(pair[1].decode(ids).encode()).hexdigest())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.QUERIES["op5_sentencepiece"](spark, SF).collect()}
    assert got == want


def test_odd_rows_and_empty_table(spark, odd, none, pair):
    rows = sc.encode(spark, odd, tokenizer_path()).collect()
    assert len(rows) == odd.count()
    for r in rows:
        assert r.ids == pair[1].encode(r.row.text or "") and len(r.ids) == len(r.begin) == len(r.end)
    assert sc.encode(spark, none, tokenizer_path()).collect() == []
    assert sc.digests(spark, none, tokenizer_path()).collect() == []


def test_forgetting_words_changes_nothing(model, monkeypatch):
    monkeypatch.setattr(sc, "CACHE", 3)
    codec, text = sc.Codec(model), "one two three, four five six seven one two. three"
    assert encoded(codec, text) == encoded(sc.Codec(model), text)
    assert len(codec.cache) <= 3
