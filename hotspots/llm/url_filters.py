"""URL filters: pattern rules indexed by their rarest literal token.

Every rule (a host rule such as ``example.com/en/`` or a wildcard pattern such
as ``*/casino/*``) becomes one regular expression plus the literal tokens that
any URL it matches must contain. The index keeps, per rule, the token that is
rarest among the URLs at hand; the tokens of a URL fetch the candidate rules
by an equi-join, and only those candidates run their expression.

All steps are DataFrame operations. A URL is judged once however many rows
carry it: tokens and candidates are made from the distinct (host, path) texts.

Defined results: a null URL, an empty one or one without ``://`` has an empty
host and path, fits no rule and gets the default verdict; repeated rows are
all returned; an empty table gives an empty result; columns other than the id
and the URL are ignored. When several host rules fit, the longest text wins,
on equal length the one with the longer host, then ``block``, then the smaller
text; patterns only decide where no host rule fits, in the same way.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hotspots.operators.joins import broadcast_if_small

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_TOKEN_BREAK = "[^A-Za-z0-9]+"


@dataclass(frozen=True)
class HostRule:
    """Fits ``host`` and all its subdomains where the path starts with ``path``."""

    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path

    def regex(self) -> str:
        return rf"^(?:[^/]*\.)?{_quote(self.text)}"

    def tokens(self) -> list[str]:
        # the path is a prefix: its last run of letters may go on in the URL
        whole = re.sub(r"[A-Za-z0-9]+$", "", self.path) if self.path else ""
        return [t for t in re.split(_TOKEN_BREAK, self.host + whole) if t]


@dataclass(frozen=True)
class PatternRule:
    """A text over host and path; ``*`` stands for any characters, and the
    pattern must cover the whole of host plus path."""

    text: str
    verdict: str

    def regex(self) -> str:
        return "(?s)^" + ".*".join(_quote(p) if p else "" for p in self.text.split("*")) + "$"

    def tokens(self) -> list[str]:
        out = []
        for m in re.finditer(r"[A-Za-z0-9]+", self.text):
            before, after = self.text[:m.start()], self.text[m.end():]
            if not before.endswith("*") and not after.startswith("*"):
                out.append(m.group())
        return out


#: Host rules of the contract.
HOST_RULES = (
    HostRule("com", "/", "allow"),
    HostRule("example.com", "/en/", "block"),
    HostRule("www.example.com", "/en/", "allow"),
    HostRule("net", "/es/", "block"),
    HostRule("net", "/fr/", "block"),
)

#: What decides where no host rule fits: adult hosts, path parts of pages without prose.
PATTERN_RULES = (
    PatternRule("*adult-x.*", "block"),
    PatternRule("*/login/*", "block"),
    PatternRule("*/cart/*", "block"),
    PatternRule("*/casino/*", "block"),
    PatternRule("*/wp-admin/*", "block"),
    PatternRule("*/xxx/*", "block"),
)


def _quote(text: str) -> str:
    return re.sub(r"([^A-Za-z0-9/_-])", r"\\\1", text)


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or no ``://``."""
    whole = F.coalesce(url, F.lit(""))
    return (F.translate(F.regexp_extract(whole, _URL, 1), _UPPER, _LOWER),
            F.regexp_extract(whole, _URL, 2))


def rule_table(spark: SparkSession, host_rules=HOST_RULES, pattern_rules=PATTERN_RULES) -> DataFrame:
    """Rules as rows: rule, regex, tokens, verdict, and the rank by which the
    best of several fitting rules is taken (largest first)."""
    rows = [(r, 1, len(r.host)) for r in host_rules] + [(r, 0, 0) for r in pattern_rules]
    if not rows:
        return rule_table(spark, HOST_RULES, ()).filter(F.lit(False))
    lit = F.lit

    def row(r, is_host, host_len):
        return F.struct(
            lit(r.text).alias("rule"), lit(r.regex()).alias("regex"),
            F.array(*[lit(t) for t in r.tokens()]).cast("array<string>").alias("tokens"),
            lit(r.verdict).alias("verdict"),
            F.struct(lit(is_host).alias("is_host"), lit(len(r.text)).alias("length"),
                     lit(host_len).alias("host_length"),
                     lit(int(r.verdict == "block")).alias("block"),
                     # the smaller text wins: code points inverted, longest first above
                     lit("".join(chr(0x10FFFF - ord(c)) if ord(c) < 0xD000 else c
                                 for c in r.text)).alias("text")).alias("rank"))

    return (spark.range(1).select(F.explode(F.array(*[row(*x) for x in rows])).alias("r"))
            .select("r.*"))


def index_rules(rules: DataFrame, tokens: DataFrame) -> DataFrame:
    """Per rule its token that occurs in the fewest URLs (ties: the smaller
    token). ``tokens`` holds one row per distinct URL and token. A rule without
    any whole literal token is kept under the empty token, which every URL has."""
    own = rules.select("rule", F.explode_outer("tokens").alias("token"))
    wanted = own.filter(F.col("token").isNotNull()).select("token").distinct()
    seen = (tokens.join(broadcast_if_small(wanted), "token", "left_semi")
            .groupBy("token").agg(F.count(F.lit(1)).alias("urls")))
    best = (own.join(seen, "token", "left")
            .groupBy("rule")
            .agg(F.min(F.struct(F.coalesce("urls", F.lit(0)).alias("urls"), "token")).alias("m"))
            .select("rule", F.coalesce("m.token", F.lit("")).alias("token")))
    return rules.drop("tokens").join(best, "rule")


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url",
               default: str = "allow") -> DataFrame:
    """One row per row of ``pages``: its columns are not kept but for those
    under ``row`` (a struct of all of them), plus host, path, rule, pattern,
    verdict. ``rule`` is the host rule's text, ``pattern`` the pattern's."""
    host, path = url_parts(F.col(f"`{url}`"))
    parts = (pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("row"),
                          host.alias("host"), path.alias("path"))
             .withColumn("place", F.concat("host", "path")))
    places = parts.select("place").distinct()
    tokens = places.select(
        "place", F.explode(F.array_union(F.split("place", _TOKEN_BREAK),
                                         F.array(F.lit("")))).alias("token"))
    index = broadcast_if_small(index_rules(rules, tokens))
    best = (tokens.join(index, "token")
            .filter(F.rlike(F.col("place"), F.col("regex")))
            .groupBy("place")
            .agg(F.max(F.struct("rank", "rule", "verdict")).alias("best"))
            .checkpoint())  # written first: then the rows of a hot place can be split over tasks
    is_host = F.col("best.rank.is_host") == 1
    return (parts.join(best, "place", "left")
            .select("row", "host", "path",
                    F.when(is_host, F.col("best.rule")).alias("rule"),
                    F.when(~is_host, F.col("best.rule")).alias("pattern"),
                    F.coalesce("best.verdict", F.lit(default)).alias("verdict")))
