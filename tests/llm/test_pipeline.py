"""The corpus pipeline against stage-by-stage brute force."""
import hashlib
import re
import unicodedata

import sentencepiece

import corpus_pipeline as cp
from hotspots.llm import toxicity
from hotspots.llm.quality_rules import RULES, STOP_WORDS
from hotspots.llm.queries_text import tokenizer_path
from hotspots.sources.tables import Tables
from tests.llm.test_decontaminate import brute
from tests.llm.test_native import WORD, restated
from tests.llm.test_simhash import close_pairs, components, fingerprint

SF = "/root/testdata/sf0.001"


def test_stages_in_order():
    assert [n for n, _ in cp.STAGES] == ["toxicity", "quality_rules", "simhash_near_dedup", "benchmark_decontamination", "sentencepiece"]


def test_run_equals_brute_force(spark):
    t = Tables(spark, SF)
    rows = [(r.doc_id, r.text) for r in t.documents.collect()]
    scores = toxicity.Scorer(toxicity.fit(t.documents, t.labels)).scores([(x or "").encode() for _, x in rows])
    rows = [r for r, s in zip(rows, scores) if s < 0.5]
    from hotspots.llm import quality_rules
    kept = {r.row.doc_id for r in quality_rules.judge(t.documents).collect() if r.kept}
    for d, x in rows:
        n, _, _, _, repeated = restated(x)
        assert d not in kept or not (n < 10 or 100 * repeated > 20 * n)
    rows = [r for r in rows if r[0] in kept]
    codes = [fingerprint(x) for _, x in rows]
    root = components([d for d, _ in rows], [(rows[i][0], rows[j][0]) for i, j in close_pairs(codes)])
    rows = [r for r in rows if root[r[0]] == r[0]]
    hits = brute(rows, [(r.item_id, r.text) for r in t.benchmark.collect()])
    clean = {d for d, n, h, _ in hits if not (h and 20 * h >= n)}
    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path())
    want = {}
    for d, x in rows:
        if d in clean:
            ids = library.encode(x)
            want[d] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                       hashlib.sha256(library.decode(ids).encode()).hexdigest())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in cp.run(spark, SF).collect()}
    assert got == want and 0 < len(got) < 200


def test_quality_stage_keeps_what_the_rules_keep(spark):
    docs = Tables(spark, SF).documents
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    want = set()
    for d, t in rows:
        n, chars, symbols, dup, repeated = restated(t)
        lines = sum(1 for x in t.split("\n") if re.search(WORD, x))
        measure = {"mean_word_chars": chars / max(1, n), "symbols_per_word": symbols / max(1, n),
                   "exclamations_per_word": t.count("!") / max(1, n), "dup_line_ratio": dup / max(1, lines),
                   "stop_word_ratio": sum(w in STOP_WORDS for w in re.findall(WORD, t)) / max(1, n),
                   "letter_ratio": sum(unicodedata.category(c)[0] == "L" for c in t) / max(1, chars)}
        failed = [r for r in RULES if n >= r.from_words and (
            r.low is not None and measure[r.measure] < r.low or r.high is not None and measure[r.measure] > r.high)]
        if not (n < 10 or 100 * repeated > 20 * n or failed):
            want.add(d)
    assert {r.doc_id for r in cp.drop_low_quality(spark, docs, SF).collect()} == want and 0 < len(want) < len(rows)


def test_stages_on_odd_rows_and_empty_tables(spark, odd, none):
    for docs in (odd, none):
        for _, stage in cp.STAGES[:-1]:
            out = stage(spark, docs, SF)
            assert out.columns == odd.columns
            assert [f.dataType for f in out.schema] == [f.dataType for f in odd.schema]
            ids = {(r.doc_id, r.text) for r in docs.collect()}
            assert {(r.doc_id, r.text) for r in out.collect()} <= ids
        assert cp.STAGES[-1][1](spark, docs, SF).count() == docs.count()
