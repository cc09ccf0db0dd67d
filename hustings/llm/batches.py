"""Small helpers for functions over Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

#: Rows and text bytes that are worked on at once; a single longer text is worked on alone, whole.
ROWS, BYTES = 512, 4_000_000


def pieces(batches: Iterator[pa.RecordBatch], column: int = 1) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with few rows and, by the bytes of one string column, little text."""
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            n = min(ROWS, batch.num_rows - at)
            while n > 1 and batch.column(column).slice(at, n).nbytes > BYTES:
                n = max(1, n // 2)
            yield batch.slice(at, n)
            at += n


def quoted(name: str) -> str:
    """A column's name as an expression, whatever is in it."""
    return "`" + name.replace("`", "``") + "`"
