"""Quality rules: a threshold table compiled into one Spark projection.

All measures of a text are column expressions over its row (words, lines and
five-word windows are arrays of that row), so the scan is the only stage: no
shuffle and no user function. ``RULES`` is the threshold table; ``compile_rules``
turns it into one boolean expression, and the name of every failed rule is
reported.

Defined results: a null text has no words, fails the base rule (fewer than ten
words) and is not kept; an empty text likewise; repeated rows are judged each
on their own; an empty table gives an empty result; other columns are ignored.
Two equal five-word windows are recognised by a 64-bit hash of the window.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hotspots.llm.batches import packed

_SPACE = r"[\x20\x09-\x0D]+"
_WORD_CHAR = r"[^\x20\x09-\x0D]"
WINDOW = 5

#: Frequent function words of the languages at hand (English, German, French, Spanish).
STOP_WORDS = (
    "the", "of", "and", "to", "in", "is", "that", "it", "was", "for", "on", "with", "as", "at",
    "by", "this", "be", "are", "from", "a", "an",
    "der", "die", "das", "und", "ist", "von", "den", "mit", "zu", "ein", "eine", "nicht", "auf",
    "im", "für", "sich", "dem", "des", "auch",
    "le", "la", "les", "et", "est", "un", "une", "du", "que", "qui", "dans", "pour", "pas", "sur",
    "par", "au", "ou", "il", "elle", "de", "avec", "se",
    "el", "los", "las", "y", "en", "una", "por", "con", "su", "para", "del", "al", "no", "es", "lo",
)


@dataclass(frozen=True)
class Rule:
    """``measure`` must lie within [low, high]; applied from ``from_words`` words on."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None
    from_words: int = 0


#: The threshold table. Measures are columns of ``measures()``.
RULES = (
    Rule("mean_word_length", "mean_word_chars", low=2.0, high=20.0),
    Rule("symbol_ratio", "symbols_per_word", high=0.20),
    Rule("exclamation_ratio", "exclamations_per_word", high=0.30),
    Rule("stop_words", "stop_word_ratio", low=0.02, from_words=60),
    Rule("duplicate_lines", "dup_line_ratio", high=0.50),
    Rule("letters", "letter_ratio", low=0.45),
)


def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and use it inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeat_words(grams: Column) -> Column:
    """Words covered by windows whose hash occurs twice or more; ``grams`` are
    the window hashes in order. Equal hashes meet by sorting (hash, position)."""
    pairs = F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def same(s, x, j):
        return F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False)) | (
            (j > 0) & F.coalesce(F.get(s, F.greatest(j - 1, F.lit(0)))["h"] == x["h"], F.lit(False)))

    positions = _let(pairs, lambda s: F.sort_array(F.transform(
        F.filter(s, lambda x, j: same(s, x, j)), lambda x: x["i"])))
    covered = _let(positions, lambda p: F.aggregate(
        F.transform(p, lambda x, j: F.least(F.lit(WINDOW),
                                            F.coalesce(F.get(p, j + 1) - x, F.lit(WINDOW)))),
        F.lit(0), lambda acc, x: acc + x))
    return F.when(F.size(F.array_distinct(grams)) < F.size(grams), covered).otherwise(0)


def measures(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` (default: all) in the struct ``row``,
    plus the measures."""
    base = packed(docs, text, keep).select(
        "row", "body", F.array_remove(F.split("body", _SPACE), "").alias("words"))
    n = F.size("words")
    windows = F.when(n >= WINDOW, _let(F.col("words"), lambda w: F.transform(
        F.sequence(F.lit(1), F.size(w) - (WINDOW - 1)),
        lambda i: F.xxhash64(F.slice(w, i, WINDOW))))).otherwise(F.array().cast("array<bigint>"))
    counted = base.select(
        "row", n.cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.length("body") - F.length(F.regexp_replace("body", r"[#*$%&|<>]+", ""))
         ).cast("long").alias("n_symbols"),
        (F.length("body") - F.length(F.regexp_replace("body", r"!+", ""))
         ).cast("long").alias("n_exclamations"),
        F.length(F.regexp_replace("body", r"\P{L}+", "")).cast("long").alias("n_letters"),
        F.size(F.filter("words", lambda w: w.isin(*STOP_WORDS))).cast("long").alias("n_stop_words"),
        F.filter(F.split("body", "\n"), lambda s: s.rlike(_WORD_CHAR)).alias("lines"),
        windows.alias("grams"))
    ratio = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return counted.select(
        "row", "n_words", "word_chars", "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("grams")).cast("long").alias("n_repeat_words"),
        ratio("word_chars", "n_words").alias("mean_word_chars"),
        ratio("n_symbols", "n_words").alias("symbols_per_word"),
        ratio("n_exclamations", "n_words").alias("exclamations_per_word"),
        ratio("n_stop_words", "n_words").alias("stop_word_ratio"),
        ratio("n_letters", "word_chars").alias("letter_ratio"),
        F.size("lines").cast("long").alias("n_lines"),
        # never negative: see judge()
        F.monotonically_increasing_id().alias("_at"))


def compile_rules(rules=RULES) -> Column:
    """Names of the failed rules, as one array expression."""
    def failed(r: Rule) -> Column:
        m = F.col(r.measure)
        bad = F.lit(False)
        if r.low is not None:
            bad = bad | (m < r.low)
        if r.high is not None:
            bad = bad | (m > r.high)
        return F.when(bad & (F.col("n_words") >= r.from_words), F.lit(r.name))

    return F.array_compact(F.array(*[failed(r) for r in rules]))


def judge(docs: DataFrame, text: str = "text", rules=RULES, keep: list[str] | None = None) -> DataFrame:
    """``row``, the measures, base_failed, failed_rules and kept.

    A filter on ``kept`` would be pushed down to the scan with all its measures
    written out once per use; it refers to the row number made beside them, so
    it stays above and the measures are computed once."""
    m = measures(docs, text, keep).withColumn(
        "dup_line_ratio", F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)))
    base_failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return (m.withColumn("base_failed", base_failed)
            .withColumn("failed_rules", compile_rules(rules))
            .withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0) & (F.col("_at") >= 0))
            .drop("_at"))
