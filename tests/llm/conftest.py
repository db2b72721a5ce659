import pytest

LONG = "the sh thin of and wh re, " * 30_000


def odd_rows():
    """Null and blank texts, a null id, repeated rows, a very long text."""
    plain = "it was for the thing of her and re with that inged on the er ble an of to in is a for the day"
    return [
        (1, plain, "row text", 0.5), (2, None, None, None), (3, "", "", 0.0), (4, " \t\n\x0b\f\r", "x", 1.0),
        (None, plain + " more", "y", 2.0), (None, None, None, None), (5, plain, "row text", 0.5),
        (5, plain, "row text", 0.5), (6, LONG, "long", 3.0), (7, "Ünïcode ▁ wörd 日本 \x00 end", "u", 4.0),
        (8, "a", "b", 5.0), (9, "\n".join([plain] * 4), "lines", 6.0),
    ]


@pytest.fixture
def odd(spark):
    """Documents whose further columns clash with names the operators use."""
    return spark.createDataFrame(odd_rows(), "doc_id long, text string, row string, score double").selectExpr(
        "doc_id", "text", "row", "score", "1 AS body", "'k' AS kept", "0L AS fingerprint", "array(1) AS words",
        "false AS held", "'t' AS kind", "0L AS n_words")


@pytest.fixture
def none(odd):
    return odd.limit(0)
