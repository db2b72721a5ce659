"""Quality rules and URL filters against restatements; no Python in their plans."""
import collections
import re

import pytest

from hotspots.llm import quality_rules, queries, url_filters

WORD = r"[^\x20\x09-\x0D]+"


def restated(text):
    t = text or ""
    w = re.findall(WORD, t)
    grams = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    count, covered = collections.Counter(grams), set()
    for i, g in enumerate(grams):
        if count[g] > 1:
            covered.update(range(i, i + 5))
    lines = [x for x in t.split("\n") if re.search(WORD, x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))


TEXTS = [None, "", " ", "a b c d e a b c d e", "x " * 50, "a b c d e f a b c d e b c d e f", "a\na\n\n \nb\na",
         "#*$%&|<> <b>", "é 日本 é", "a b c d e\x0bf a\tb c d e", "one two three four five six seven eight nine ten"]


def test_measures(spark, odd):
    df = odd.unionByName(spark.createDataFrame([(i + 100, t) for i, t in enumerate(TEXTS)], "doc_id long, text string"),
                         allowMissingColumns=True)
    rows = quality_rules.judge(df).collect()
    assert len(rows) == df.count()
    for r in rows:
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert got == restated(r.row.text)
        assert r.base_failed == (got[0] < 10 or 100 * got[4] > 20 * got[0])
        assert r.kept == (not r.base_failed and not r.failed_rules)


def test_each_rule_fires(spark):
    clean = ("the day was for it and with that in one man to see his own house on a hill by river as they had been at it "
             "from early light of morning till late when all went home for food rest then slept well until sun rose over "
             "fields again so work could go on once more while birds sang near old mill")
    cases = {"symbol_ratio": clean + " # # # # # # # # # # # # # # # $ $ $ $ $", "exclamation_ratio": clean + " go!" * 1 + "!" * 40,
             "stop_words": " ".join(f"qw{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(80)),
             "mean_word_length": " ".join("w" * 25 + chr(97 + i) for i in range(12)),
             "duplicate_lines": "\n".join(["one two"] * 8),
             "letters": " ".join(str(10 ** 4 + i) for i in range(20))}
    df = spark.createDataFrame([(k, v) for k, v in cases.items()] + [("clean", clean)], "name string, text string")
    for r in quality_rules.judge(df).collect():
        if r.row.name == "clean":
            assert r.kept
        else:
            assert r.row.name in r.failed_rules and not r.kept


def test_rule_table_is_a_parameter(spark):
    df = spark.createDataFrame([("a b c d e f g h i j k l",)], "text string")
    rule = quality_rules.Rule("long", "n_words", high=11)
    assert quality_rules.judge(df, rules=(rule,)).first().failed_rules == ["long"]


URLS = {
    "http://a.com/x": ("a.com", "/x", "com/", "allow"),
    "HTTPS://WWW.Example.COM/en/1?q=1": ("www.example.com", "/en/1", "www.example.com/en/", "allow"),
    "http://m.www.example.com/en/": ("m.www.example.com", "/en/", "www.example.com/en/", "allow"),
    "http://example.com/en/9#t": ("example.com", "/en/9", "example.com/en/", "block"),
    "http://badexample.com/en/9": ("badexample.com", "/en/9", "com/", "allow"),
    "http://x.net/es/1": ("x.net", "/es/1", "net/es/", "block"),
    "http://x.net/ES/1": ("x.net", "/ES/1", None, "allow"),
    "http://x.net/fr": ("x.net", "/fr", None, "allow"),
    "http://com": ("com", "", None, "allow"),
    "http://com/": ("com", "/", "com/", "allow"),
    "http://x.org/casino/1": ("x.org", "/casino/1", None, "block"),
    "http://adult-x.example.org/": ("adult-x.example.org", "/", None, "block"),
    "http://x.com/casino/1": ("x.com", "/casino/1", "com/", "allow"),
    "nothing": ("", "", None, "allow"), "": ("", "", None, "allow"), None: ("", "", None, "allow"),
    "a://b?c://d.com/": ("b", "", None, "allow"),
    "http://é.net/fr/": ("é.net", "/fr/", "net/fr/", "block"),
    "http://" + "s." * 5000 + "net/fr/" + "p" * 5000: ("s." * 5000 + "net", "/fr/" + "p" * 5000, "net/fr/", "block"),
    "http://a.net:80/fr/": ("a.net:80", "/fr/", None, "allow"),
}


def test_urls(spark):
    pages = spark.createDataFrame([(i, u, 0) for i, u in enumerate([*URLS, *URLS])], "page_id long, url string, host int")
    rows = url_filters.judge_urls(pages, url_filters.rule_table(spark)).collect()
    assert len(rows) == 2 * len(URLS)
    for r in rows:
        assert (r.host, r.path, r.rule, r.verdict) == URLS[r.row.url], r.row.url


def test_ties_and_rules_without_tokens(spark):
    H, P = url_filters.HostRule, url_filters.PatternRule
    rules = url_filters.rule_table(spark, [H("a.b", "/c", "allow"), H("b", "/c/d", "block")], [P("*zz*", "block")])
    pages = spark.createDataFrame([("http://a.b/c/d",), ("http://q/zzz",), ("http://q/z",)], "url string")
    got = {r.row.url: (r.rule, r.pattern, r.verdict) for r in url_filters.judge_urls(pages, rules).collect()}
    assert got == {"http://a.b/c/d": ("a.b/c", None, "allow"), "http://q/zzz": (None, "*zz*", "block"),
                   "http://q/z": (None, None, "allow")}


def test_no_rules_and_empty_table(spark):
    pages = spark.createDataFrame([("http://a.com/x",)], "url string")
    assert url_filters.judge_urls(pages, url_filters.rule_table(spark, [], [])).first().verdict == "allow"
    assert url_filters.judge_urls(pages.limit(0), url_filters.rule_table(spark)).collect() == []


def test_rarest_token_indexes_a_rule(spark):
    tokens = spark.createDataFrame([("u1", "example"), ("u1", "com"), ("u2", "com"), ("u1", "en"), ("u2", "en"), ("u3", "en")],
                                   "place string, token string")
    index = {r.rule: r.token for r in url_filters.index_rules(url_filters.rule_table(spark), tokens).collect()}
    assert index["example.com/en/"] == "example" and index["com/"] == "com" and index["*/casino/*"] == "casino"
    assert index["net/es/"] == "es"


@pytest.mark.parametrize("name", ["op6_quality_rules", "op8_url_filters"])
def test_plans_hold_no_python(spark, name):
    plan = queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", plan)
