"""Bounded Arrow batches for the operators whose kernels run in Python."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that a kernel works on at once, unless a single text is longer.
BLOCK_BYTES = 4 << 20


def blocks(batches: Iterator[pa.RecordBatch], text: str, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches into runs of rows whose texts come to about `limit` bytes; every row is in one run."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
        start = total = 0
        for i, n in enumerate(sizes):
            if i > start and total + n > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if start < len(sizes):
            yield batch.slice(start)


def texts(batch: pa.RecordBatch, column: str) -> list[str]:
    """A text column as strings; null becomes the empty text."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(column)).to_pylist()]


def raw(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """A text column as UTF-8 bytes; null becomes the empty text."""
    return [x or b"" for x in batch.column(batch.schema.get_field_index(column)).cast(pa.binary()).to_pylist()]


def text_blocks(found: pd.Series, limit: int = BLOCK_BYTES) -> Iterator[list[str]]:
    """The texts of a series, null as empty, in runs of about `limit` characters."""
    part, total = [], 0
    for x in found:
        text = x if isinstance(x, str) else ""
        if part and total + len(text) > limit:
            yield part
            part, total = [], 0
        part.append(text)
        total += len(text)
    if part:
        yield part
