"""Spatial column functions: grid snap (PF4), cell key (PF5), projections."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from hotspots.config import MERCATOR_RADIUS

# Grid resolution -> multiplier k, a coordinate snaps to rint(x*k)/k.
#   "1km" -> 100 (two decimals), "10km" -> 10 (one decimal), "50km" -> 2 (nearest 0.5)
_GRID_SCALE = {"1km": 100.0, "10km": 10.0, "50km": 2.0}


def grid_scale(resolution: str) -> float:
    try:
        return _GRID_SCALE[resolution]
    except KeyError:
        raise ValueError(
            f"Invalid resolution {resolution!r}; expected one of {sorted(_GRID_SCALE)}") from None


_SPLIT = 134217729.0  # 2**27 + 1, Veltkamp split of a double into two 26-bit halves


def round_scaled_exact(c: Column, k: float) -> Column:
    """Integer nearest to the exact product x*k, ties to even.

    The double product p = x*k is rounded; its exact error e (x*k = p + e) is
    recovered error-free with a Dekker split (k is a small integer, so k has
    no low half). Only when p itself is exactly halfway does the rounding
    direction depend on e; otherwise rint(p) is already right.
    """
    kk = F.lit(k)
    p = c * kk
    big = c * F.lit(_SPLIT)
    hi = big - (big - c)
    lo = c - hi
    err = (hi * kk - p) + lo * kk
    fl = F.floor(p).cast("double")
    tie = (p - fl) == F.lit(0.5)
    return (F.when(tie & (err > 0), fl + F.lit(1.0))
            .when(tie & (err < 0), fl)
            .otherwise(F.rint(p)))


def snap(col: Column | str, resolution: str = "50km") -> Column:
    """Round onto the grid of ``resolution`` like decimal half-to-even rounding
    of the exact binary value: two decimals (1 km), one decimal (10 km), or
    ``round(2x)/2`` (50 km, where the doubled value is exact)."""
    k = grid_scale(resolution)
    c = F.col(col) if isinstance(col, str) else col
    scaled = F.rint(c * F.lit(k)) if k == 2.0 else round_scaled_exact(c, k)
    # + 0.0 turns a negative zero into zero so the cell key never reads "-0.0"
    return scaled / F.lit(k) + F.lit(0.0)


def cell_key(lat: Column | str, lon: Column | str) -> Column:
    """``"<lat>_<lon>"`` from already snapped coordinates."""
    la = F.col(lat) if isinstance(lat, str) else lat
    lo = F.col(lon) if isinstance(lon, str) else lon
    return F.concat_ws("_", la.cast("string"), lo.cast("string"))


def mercator_to_lon(x: Column | str) -> Column:
    c = F.col(x) if isinstance(x, str) else x
    return F.degrees(c / F.lit(MERCATOR_RADIUS))


def mercator_to_lat(y: Column | str) -> Column:
    c = F.col(y) if isinstance(y, str) else y
    return F.degrees(F.lit(2.0) * F.atan(F.exp(c / F.lit(MERCATOR_RADIUS))) - F.lit(math.pi / 2))


def dominant_class(*cols: str) -> Column:
    """0-based position of the largest value; the first maximum wins (PF12)."""
    arr = F.array(*[F.col(c) for c in cols])
    return (F.array_position(arr, F.greatest(*[F.col(c) for c in cols])) - 1).cast("int")
