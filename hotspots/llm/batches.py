"""Helpers shared by the operators that work on Arrow batches.

``rows_of`` walks the rows of a batch stream in slices of bounded text size,
so that an operator's own buffers stay small whatever the batch size is.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Text bytes that one slice of rows may hold (a single longer text is a slice of its own).
SLICE_BYTES = 4 << 20


def packed(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``row``: a struct of the columns ``keep`` (default: all, under whatever
    names they have); ``body``: the text, empty where it is null."""
    kept = docs.columns if keep is None else keep
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"),
                       F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("body"))


def text_bytes(column) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    raw = column.cast(pa.binary())
    return [b"" if x is None else x for x in raw.to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], text: str,
           limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """(batch slice, its texts as bytes), each of at most ``limit`` text bytes
    or one row."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        lengths = pa.compute.fill_null(pa.compute.binary_length(column), 0).to_numpy(zero_copy_only=False)
        start = size = 0
        for i, n in enumerate(lengths):
            if size and size + n > limit:
                part = batch.slice(start, i - start)
                yield part, text_bytes(column.slice(start, i - start))
                start, size = i, 0
            size += int(n)
        if start < batch.num_rows:
            part = batch.slice(start)
            yield part, text_bytes(column.slice(start))
