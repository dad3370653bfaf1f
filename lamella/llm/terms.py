"""Numbering the byte strings of a slice of text: length-bucketed packing, radix sort, run counting.

Terms of up to 7 bytes are one uint64 and terms of up to 15 bytes two, with the length in the last byte; both are sorted
by 16-bit digits, for which numpy's stable sort is a radix sort. Longer terms are sorted as bytes, a bucket for each length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

ONE, TWO = 7, 15
_KEEP = np.array([0] + [(1 << 64) - (1 << 64 - 8 * k) for k in range(1, 9)], np.uint64)  # the first k bytes of a word


def radix_order(words: list[np.ndarray], order: np.ndarray | None = None) -> np.ndarray:
    """Stable order of rows by uint64 words, the most significant first; ``order`` is where to start from."""
    order = np.arange(len(words[0])) if order is None else order
    for word in reversed(words):
        for shift in range(0, 64, 16):
            digit = (word >> np.uint64(shift)).astype(np.uint16)
            if len(digit) and (digit != digit[0]).any():
                order = order[np.argsort(digit[order], kind="stable")]
    return order


def _runs(order: np.ndarray, words: list[np.ndarray]) -> np.ndarray:
    """For sorted rows, whether each differs from the one before."""
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.logical_or.reduce([w[order[1:]] != w[order[:-1]] for w in words])
    return new


def packed(data: np.ndarray, begin: np.ndarray, end: np.ndarray):
    """``(rows, words)`` of the two buckets of short terms, and ``(rows, bytes)`` of each length of the long ones."""
    size = end - begin
    tail = np.concatenate((data, np.zeros(16, np.uint8)))
    at = np.ndarray(len(data) + 8, ">u8", tail, strides=(1,))
    rows = np.flatnonzero(size <= ONE)
    yield rows, [at[begin[rows]].astype(np.uint64) & _KEEP[size[rows]] | size[rows].astype(np.uint64)]
    rows = np.flatnonzero((size > ONE) & (size <= TWO))
    yield rows, [at[begin[rows]].astype(np.uint64), at[begin[rows] + 8].astype(np.uint64) & _KEEP[size[rows] - 8] | size[rows].astype(np.uint64)]
    long = np.flatnonzero(size > TWO)
    for n in np.unique(size[long]):
        rows = long[size[long] == n]
        yield rows, [data[begin[rows, None] + np.arange(n)].view(f"S{n}").ravel()]


def numbered(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(ids, order, first)``: equal terms have equal ids from 0; ``order`` sorts by id, stably; ``first`` is a row of each id."""
    ids, orders, firsts, base = np.empty(len(begin), np.int64), [], [], 0
    for rows, words in packed(data, begin, end):
        order = radix_order(words) if words[0].dtype.kind == "u" else np.argsort(words[0], kind="stable")
        new = _runs(order, words)
        ids[rows[order]] = base + np.cumsum(new) - 1
        orders.append(rows[order])
        firsts.append(rows[order[new]])
        base += int(new.sum())
    return ids, np.concatenate(orders), np.concatenate(firsts)


def strings(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.Array:
    """The spans of ``data``, which are UTF-8, as an Arrow column."""
    size = (end - begin).astype(np.int32)
    stop = np.cumsum(size, dtype=np.int32)
    place = np.repeat((begin - (stop - size)).astype(np.int32), size) + np.arange(int(stop[-1]) if len(stop) else 0, dtype=np.int32)
    offsets = np.concatenate((np.zeros(1, np.int32), stop))
    return pa.StringArray.from_buffers(len(begin), pa.py_buffer(offsets), pa.py_buffer(data[place]))


def lowered(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z in lower case."""
    return data + (((data >= 65) & (data <= 90)).astype(np.uint8) << 5)
