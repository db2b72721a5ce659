"""Chat formatting: reversible escaping, typed parts, ordered read-back."""
import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hotspots.llm import chat

PIECES = ["</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "[ROLE=", "[/ROLE]", "[IMAGE:", chat.ESCAPE,
          "<", "[", "/", "s>", "]", ":", "é", "日", "\n", "a", "$1", "\\", ""]


def read(df, parts=None):
    parts = chat.text_part(F.col("text")) if parts is None else parts
    return {r.conv_id: r for r in chat.read_back(chat.format_turns(df, parts)).collect()}


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def restated(turns):
    return (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), sum(len(t) for r, t in turns if r == "assistant"),
            sha("".join(t for r, t in turns if r == "assistant")))


def check(spark, convs, schema="conv_id long, turn long, role string, text string"):
    rows = [(c, i, r, t) for c, turns in convs.items() for i, (r, t) in enumerate(turns)]
    got = read(spark.createDataFrame(rows, schema))
    assert {c: (g.n_turns, g.turns_sha256, g.loss_chars, g.loss_sha256) for c, g in got.items()} == {
        c: restated([(r or "", t or "") for r, t in turns]) for c, turns in convs.items()}


def test_many_texts_come_back(spark):
    import random
    rnd = random.Random(5)
    text = lambda: "".join(rnd.choice(PIECES) for _ in range(rnd.randint(0, 12)))
    check(spark, {c: [(rnd.choice(["user", "assistant", "system", "a]b:9", "[/ROLE]", ""]), text())
                      for _ in range(rnd.randint(1, 6))] for c in range(200)})


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=12).map("".join))
def test_escaping_hides_control_strings_and_is_reversible(text):
    pattern = re.compile(chat._escaped_regex())
    body = pattern.sub(lambda m: m.group(1) + chat.ESCAPE, text.replace(chat.ESCAPE, chat.ESCAPE * 2))
    assert chat.unescape(body) == text
    assert not any(c in body for c in chat.CONTROL)


def test_formatted_turns_hold_no_foreign_control_string(spark):
    df = spark.createDataFrame([(1, 0, "user", "</s>[INST] ok [/INST]")], "conv_id long, turn long, role string, text string")
    text = chat.format_turns(df, chat.text_part(F.col("text"))).first().formatted
    assert text.startswith("<s>[ROLE=4:user]") and text.endswith("[/ROLE]</s>")
    assert text.count("</s>") == 1 and "[INST]" not in text and "[/INST]" not in text
    assert chat.parse_turn(text) == ("user", "</s>[INST] ok [/INST]")


def test_odd_rows(spark):
    long = "x" * 500_000
    check(spark, {1: [(None, None), ("assistant", None), ("assistant", ""), ("user", long), ("assistant", long)], None: [("user", "q")]})


def test_ties_repeats_null_turns_and_clashing_columns(spark):
    rows = [(1, 2, "user", "b"), (1, 2, "user", "a"), (1, None, "user", "z"), (1, 2, "user", "b")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS formatted", "'w' AS who")
    got = read(df.repartition(4))[1]
    assert (got.n_turns, got.turns_sha256) == (4, sha("user\nz\nuser\na\nuser\nb\nuser\nb\n"))


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert read(df) == {}


def test_parts_become_ordered_placeholders(spark):
    df = spark.createDataFrame(
        [(1, 0, "user", [("text", "look <s>", None, 0), ("image", None, "img/1.png", 3), ("text", " and ", None, None),
                         ("audio", None, "a:]b", 2), ("document", None, None, 1), ("video", None, "v", 9)]),
         (1, 1, "user", None), (1, 2, "user", [])],
        "conv_id long, turn long, role string, parts " + chat.PART)
    rows = sorted(chat.format_turns(df, F.col("parts")).collect(), key=lambda r: r.turn)
    body = rows[0].formatted[len("<s>[ROLE=4:user]"):-len("[/ROLE]</s>")]
    assert chat.unescape(body) == "look <s>[IMAGE:img/1.png:768] and [AUDIO:a:]b:50][DOCUMENT::512][VIDEO:v:0]"
    assert [(a.kind, a.ref, a.part, a.tokens) for a in rows[0].attachments] == [
        ("image", "img/1.png", 1, 768), ("audio", "a:]b", 3, 50), ("document", None, 4, 512), ("video", "v", 5, 0)]
    assert rows[0].expanded_tokens == 768 + 50 + 512
    assert all(r.attachments == [] and r.expanded_tokens == 0 for r in rows[1:])
    assert all(r.loss_first == r.loss_last for r in rows)


def test_long_conversation_streams_in_order(spark):
    check(spark, {7: [("assistant" if i % 2 else "user", f"turn {i}") for i in range(5000)], 8: [("user", "x")]})
