"""Presentation helpers used by the analysis views (F10-F13, PF10)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hotspots.functions.geo import round_scaled_exact


def _c(x):
    return F.col(x) if isinstance(x, str) else x


def marker_size(n) -> Column:
    """5 + 2 ln(1 + n)."""
    return F.lit(5.0) + F.log1p(_c(n).cast("double")) * F.lit(2.0)


def percent(score) -> Column:
    """Score as a percentage rounded to 2 places."""
    return F.round(_c(score) * F.lit(100.0), 2)


def percent_text(score) -> Column:
    """The percentage as shown beside a marker."""
    return F.concat(F.lit("Significance: "), _rounded(_c(score) * F.lit(100.0), 100.0).cast("string"), F.lit("%"))


def position_text(name: str, value) -> Column:
    """A coordinate with 4 places as shown beside a marker (``Lat`` or ``Lon``)."""
    return F.concat(F.lit(f"{name}: "), _rounded(_c(value), 10_000.0).cast("string"))


def _rounded(x: Column, scale: float) -> Column:
    """Decimal rounding of the exact binary value."""
    return round_scaled_exact(x, scale) / F.lit(scale)


def signed_for_label(score, label) -> Column:
    """Normal fires show the negated score."""
    return F.when(_c(label) == F.lit("normal"), -_c(score)).otherwise(_c(score))


def min_max_normalise(x, lo, hi) -> Column:
    return F.try_divide(_c(x) - _c(lo), _c(hi) - _c(lo))


def cap(x, limit: float) -> Column:
    """Values above ``limit`` become ``limit``; NULL stays NULL."""
    return F.when(_c(x) > F.lit(limit), F.lit(limit)).otherwise(_c(x))
