"""Small helpers for Arrow batches inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def byte_values(column: pa.Array) -> Iterator[bytes]:
    """The UTF-8 bytes of every value of a string or binary column; null is empty. One value is copied at a time."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8) if len(column) else []
    data = memoryview(column.buffers()[2] or b"")
    missing = np.asarray(column.is_null()) if column.null_count else None
    for i in range(len(column)):
        yield b"" if missing is not None and missing[i] else bytes(data[offsets[i] : offsets[i + 1]])


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All values of a string or binary column as one byte array and its ``len + 1`` offsets; null is empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def sub_batches(batch: pa.RecordBatch, column: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """``batch`` in slices of about ``most`` bytes of ``column``, so that work arrays stay small; one long value may exceed it."""
    _, offsets = flat_bytes(batch.column(batch.schema.get_field_index(column)))
    i, n = 0, batch.num_rows
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield batch.slice(i, min(j, n) - i)
        i = j
