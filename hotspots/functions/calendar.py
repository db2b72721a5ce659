"""Date helpers."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted input date formats, tried in this order.
DATE_FORMATS = ["yyyy-MM-dd", "yyyy/MM/dd", "dd-MM-yyyy", "dd.MM.yyyy", "yyyy-MM-dd HH:mm:ss"]


def _c(x):
    return F.col(x) if isinstance(x, str) else x


def to_date_any(col, strict: bool = True) -> Column:
    """Parse a date-like value (F1). NULL stays NULL; a text that no format
    matches is an error, or NULL unless ``strict``."""
    c = _c(col).cast("string")
    parsed = F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in DATE_FORMATS]).cast("date")
    if not strict:
        return parsed
    return (F.when(c.isNull() | parsed.isNotNull(), parsed)
            .otherwise(F.raise_error(F.concat(F.lit("Invalid date format: "), c)).cast("date")))


def as_date(value) -> dt.date:
    if isinstance(value, dt.datetime):
        return value.date()
    if isinstance(value, dt.date):
        return value
    if isinstance(value, str):
        for fmt in ("%Y-%m-%d", "%Y/%m/%d", "%d-%m-%Y", "%d.%m.%Y"):
            try:
                return dt.datetime.strptime(value, fmt).date()
            except ValueError:
                continue
    raise ValueError(f"not a date: {value!r}")


def date_lit(d) -> Column:
    """A date literal; a Column (e.g. a scalar subquery) passes through."""
    if isinstance(d, Column):
        return d.cast("date")
    return F.lit(as_date(d)).cast("date")


def days_between(later, earlier) -> Column:
    return F.datediff(_c(later), _c(earlier)).cast("double")
