"""Exact interpolated percentiles without gathering the values.

Per column name and probability the two order statistics around the wanted
rank are needed. Approximate quantiles bracket them; one partially aggregated
pass counts the values below each bracket, and the distinct values inside it
(with counts) are narrowed again until few are left. No task ever holds the
values of a column, and only the final, bounded brackets are read out.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Distinct values of one bracket that may be read out.
FEW = 20_000
_ACCURACY = 1000


def exact_percentiles(values: DataFrame, probs: list[float], name: str = "feature",
                      x: str = "x") -> dict[str, list[float | None]]:
    """Linear percentiles of ``x`` per ``name`` (a few names); NULLs are left
    out, a name without values is missing from the result."""
    v = values.select(F.col(name).alias("f"), F.col(x).cast("double").alias("x")).filter("x IS NOT NULL")
    sizes = {r["f"]: r["n"] for r in v.groupBy("f").agg(F.count(F.lit(1)).alias("n")).collect()}
    # (name, rank) -> bracket [lo, hi]
    open_ranks = {(f, r): (-math.inf, math.inf) for f, n in sizes.items() for p in probs
                  for r in {math.floor(p * (n - 1)), math.ceil(p * (n - 1))}}
    found: dict[tuple[str, int], float] = {}
    while open_ranks:
        rows = values.sparkSession.createDataFrame(
            [(f, r, float(lo), float(hi)) for (f, r), (lo, hi) in open_ranks.items()], "f string, r long, lo double, hi double")
        held = v.join(F.broadcast(rows), "f")  # a handful of rows by construction
        inside = F.when(F.col("x").between(F.col("lo"), F.col("hi")), F.col("x"))
        facts = held.groupBy("f", "r").agg(
            F.sum((F.col("x") < F.col("lo")).cast("long")).alias("below"),
            F.approx_count_distinct(inside).alias("distinct"),
            F.percentile_approx(inside, [i / 16 for i in range(17)], _ACCURACY).alias("cuts"),
            F.count(inside).alias("n")).collect()
        small = [(q["f"], q["r"]) for q in facts if q["distinct"] <= FEW // 2]
        for q in facts:
            key = (q["f"], q["r"])
            if key in small:
                continue
            # narrow to the cuts around the wanted rank, with a margin on either side
            at = (q["r"] - q["below"]) / max(1, q["n"]) * 16
            lo, hi = q["cuts"][max(0, math.floor(at) - 1)], q["cuts"][min(16, math.ceil(at) + 1)]
            if (lo, hi) == open_ranks[key]:
                small.append(key)  # cannot be narrowed: few distinct values after all
            open_ranks[key] = (lo, hi)
        if small:
            wanted = values.sparkSession.createDataFrame(
                [(f, r, float(open_ranks[f, r][0]), float(open_ranks[f, r][1])) for f, r in small],
                "f string, r long, lo double, hi double")
            counted = (v.join(F.broadcast(wanted), "f").groupBy("f", "r", F.when(F.col("x") < F.col("lo"), F.lit(None)).when(
                F.col("x") <= F.col("hi"), F.col("x")).alias("x"), (F.col("x") < F.col("lo")).alias("below"))
                .agg(F.count(F.lit(1)).alias("n")).filter("below OR x IS NOT NULL").collect())
            for f, r in small:
                own = [c for c in counted if (c["f"], c["r"]) == (f, r)]
                at = sum(c["n"] for c in own if c["below"])
                for value, n in sorted((c["x"], c["n"]) for c in own if not c["below"]):
                    at += n
                    if at > r:
                        found[f, r] = value
                        break
                open_ranks.pop((f, r))
    out: dict[str, list[float | None]] = {}
    for f, n in sizes.items():
        out[f] = []
        for p in probs:
            rank = p * (n - 1)
            a, b = found[f, math.floor(rank)], found[f, math.ceil(rank)]
            out[f].append(a + (b - a) * (rank - math.floor(rank)))
    return out
