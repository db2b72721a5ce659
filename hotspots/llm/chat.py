"""Chat formatting with typed content parts.

A message's content is a list of typed parts: text, image, audio or document.
A visitor flattens them into one body: text parts as they are (control strings
escaped), every other part as a placeholder that stands in its place, with the
attachment's reference and the number of tokens the placeholder expands to.
The template marks each turn:

    <s>[ROLE=4:user]body[/ROLE]</s>

The number is the length of the (escaped) role.
Control strings are the ones this template and common chat templates act on
(``CONTROL``); inside texts an escape character is put behind the first
character of each, and doubled where a text holds it itself, so a formatted
turn never contains a control string that a text brought along, and
``unescape`` gives every text back exactly. The loss mask is the list of
character spans of assistant bodies.

Formatting is done turn by turn in DataFrame expressions and scales with the
rows; only the digest of a conversation reads its turns in order, streamed
from a sorted partition, one turn in memory at a time. SHA-256 is sequential,
so a conversation of very many turns is one task's stream, not its memory.

Defined results: a null text is empty, a null role is the empty role; turns
with equal numbers are ordered by role and text, null turn numbers first;
repeated rows are turns of their own; null conversation ids form one
conversation; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The escape character: private use, as good as absent from texts.
ESCAPE = "\ue000"
#: Control strings of chat templates: fixed values.
CONTROL = (
    "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>",
    "<|im_start|>", "<|im_end|>", "<|endoftext|>",
    "[ROLE=", "[/ROLE]", "[IMAGE:", "[AUDIO:", "[DOCUMENT:",
)
TURN_OPEN, ROLE_END, TURN_CLOSE = "<s>[ROLE=", "]", "[/ROLE]</s>"
#: Tokens one unit of an attachment expands to: an image tile, a second of
#: audio, a document page.
TOKENS_PER_UNIT = {"image": 256, "audio": 25, "document": 512}

PART = "array<struct<kind:string,text:string,ref:string,units:int>>"


def _escaped_regex() -> str:
    first = sorted({c[0] for c in CONTROL})
    rest = "|".join(_quote(c[1:]) for c in sorted(CONTROL, key=lambda c: (-len(c), c)))
    return f"([{''.join(_quote(c) for c in first)}])(?={rest})"


def _quote(text: str) -> str:
    return "".join(c if c.isalnum() or c in "=:/_" else "\\" + c for c in text)


def escape(text: Column) -> Column:
    """``text`` without any control string; reversed by ``unescape``."""
    doubled = F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE * 2))
    return F.regexp_replace(doubled, _escaped_regex(), "$1" + ESCAPE)


def unescape(body: str) -> str:
    """The text that ``escape`` was given."""
    out, i = [], 0
    while True:
        j = body.find(ESCAPE, i)
        if j < 0:
            return "".join([*out, body[i:]])
        out.append(body[i:j])
        if body[j + 1:j + 2] == ESCAPE:
            out.append(ESCAPE)
            j += 1
        i = j + 1


# -- visitor over typed parts -------------------------------------------------------

def text_part(text: Column) -> Column:
    """A content of one text part."""
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"),
                            F.lit(None).cast("string").alias("ref"), F.lit(0).alias("units"))).cast(PART)


def _placeholder(part: Column, tokens: dict[str, int]) -> Column:
    """``[IMAGE:reference:tokens]`` and the like."""
    return F.concat(F.lit("["), F.upper(part["kind"]), F.lit(":"), escape(F.coalesce(part["ref"], F.lit(""))),
                    F.lit(":"), _tokens(part, tokens).cast("string"), F.lit("]"))


def _tokens(part: Column, tokens: dict[str, int]) -> Column:
    per = F.lit(0)
    for kind, n in tokens.items():
        per = F.when(part["kind"] == kind, n).otherwise(per)
    return per.cast("long") * F.coalesce(part["units"], F.lit(0))


def visit(parts: Column, tokens: dict[str, int] | None = None) -> Column:
    """Struct of body, attachments (kind, ref, order, tokens) and
    expanded_tokens of one content. Unknown kinds are treated as documents
    without tokens; a null content has no parts."""
    tokens = TOKENS_PER_UNIT if tokens is None else tokens
    parts = F.coalesce(parts, F.array().cast(PART))
    is_text = lambda p: p["kind"] == "text"
    body = F.array_join(F.transform(parts, lambda p: F.when(
        is_text(p), escape(F.coalesce(p["text"], F.lit("")))).otherwise(_placeholder(p, tokens))), "")
    attachments = F.filter(F.transform(parts, lambda p, i: F.struct(
        p["kind"].alias("kind"), p["ref"].alias("ref"), i.alias("part"), _tokens(p, tokens).alias("tokens"))),
        lambda a: a["kind"] != "text")
    return F.struct(body.alias("body"), attachments.alias("attachments"),
                    F.aggregate(attachments, F.lit(0).cast("long"),
                                lambda n, a: n + a["tokens"]).alias("expanded_tokens"))


# -- template --------------------------------------------------------------------------

def format_turns(turns: DataFrame, parts: Column, conv_id: str = "conv_id", turn: str = "turn",
                 role: str = "role") -> DataFrame:
    """Per turn: conv_id, turn, formatted text, loss span inside it (first and
    one past the last character; equal when the turn is not learned), attachments
    and expanded_tokens."""
    who = F.coalesce(F.col(f"`{role}`").cast("string"), F.lit(""))
    seen = turns.select(F.col(f"`{conv_id}`").cast("long").alias("conv_id"), F.col(f"`{turn}`").alias("turn"),
                        who.alias("who"), visit(parts).alias("v"))
    name = escape(F.col("who"))
    head = F.concat(F.lit(TURN_OPEN), F.length(name).cast("string"), F.lit(":"), name, F.lit(ROLE_END))
    first = F.length(head)
    return seen.select(
        "conv_id", "turn",
        F.concat(head, F.col("v.body"), F.lit(TURN_CLOSE)).alias("formatted"),
        first.alias("loss_first"),
        (first + F.when(F.col("who") == "assistant", F.length("v.body")).otherwise(0)).alias("loss_last"),
        F.col("v.attachments").alias("attachments"), F.col("v.expanded_tokens").alias("expanded_tokens"))


def parse_turn(formatted: str) -> tuple[str, str]:
    """(role, text) of a formatted turn whose parts are texts."""
    if not formatted.startswith(TURN_OPEN) or not formatted.endswith(TURN_CLOSE):
        raise ValueError("not a formatted turn")
    size, _, rest = formatted[len(TURN_OPEN):len(formatted) - len(TURN_CLOSE)].partition(":")
    role, body = rest[:int(size)], rest[int(size) + len(ROLE_END):]
    return unescape(role), unescape(body)


_READ = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
         "formatted_chars long")


def read_back(formatted: DataFrame) -> DataFrame:
    """What the formatted turns hold, per conversation: number of turns, digest
    of all roles and texts, characters and digest of the unescaped text under
    the loss mask, characters formatted."""
    ordered = (formatted.select("conv_id", "turn", "formatted", "loss_first", "loss_last")
               .repartition("conv_id").sortWithinPartitions("conv_id", "turn", "formatted"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _READ.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        done: list[tuple] = []
        now = None

        def close():
            done.append((now["id"], now["n"], now["turns"].hexdigest(), now["loss_chars"],
                         now["loss"].hexdigest(), now["chars"]))

        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(5)]
            for conv, _, text, first, last in zip(*columns):
                if now is None or now["id"] != conv:
                    if now is not None:
                        close()
                    now = {"id": conv, "n": 0, "turns": hashlib.sha256(), "loss_chars": 0,
                           "loss": hashlib.sha256(), "chars": 0}
                role, body = parse_turn(text)
                now["n"] += 1
                now["turns"].update(f"{role}\n{body}\n".encode())
                learned = unescape(text[first:last])
                now["loss_chars"] += len(learned)
                now["loss"].update(learned.encode())
                now["chars"] += len(text)
            if done:
                yield _batch(done, names, kinds)
                done = []
        if now is not None:
            close()
            yield _batch(done, names, kinds)

    return ordered.mapInArrow(run, _READ)


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
