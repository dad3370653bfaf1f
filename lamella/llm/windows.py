"""Finding windows of a fixed length that recur, without sorting or shipping every window.

Of the ``w`` k-grams in a window of ``k + w - 1`` units (bytes or words) the smallest hash is the window's anchor.
It depends on the window's content alone, so equal windows have equal anchors wherever they are; consecutive windows
mostly share theirs, so a text becomes a few runs of windows per anchor. Only runs whose anchor occurs elsewhere can
hold windows that recur. Those runs, with their text, meet in one task per anchor, where they are compared byte for byte.
Only of anchors with very many runs windows are compared by 128 bits of hash, see :mod:`lamella.llm.recurrence`.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(n, BASE, np.uint64)
    down = np.full(n, INVERSE, np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2^64, at least ``n`` of each."""
    return _powers(1 << max(16, int(n).bit_length()))


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """Sums of value times power up to each place, one more than values."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(len(values))[0][: len(values)], out=out[1:])
    return out


def span_hashes(sums: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the units from ``begin`` to ``end``, the same wherever the units stand."""
    return mixed((sums[end] - sums[begin]) * powers(len(sums))[1][begin])


def gram_hashes(values: np.ndarray, k: int) -> np.ndarray:
    """Hash of the ``k`` units that start at each place."""
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    sums = prefix_sums(values)
    return mixed((sums[k:] - sums[:n]) * powers(len(sums))[1][:n])


def sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each ``w`` consecutive values, by running minima of blocks of ``w`` from both ends."""
    n = len(h) - w + 1
    if n <= 0:
        return np.zeros(0, h.dtype)
    padded = np.full(-(-len(h) // w) * w, np.iinfo(h.dtype).max, h.dtype)
    padded[: len(h)] = h
    blocks = padded.reshape(-1, w)
    right = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    left = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(left[:n], right[w - 1 : w - 1 + n])


def runs(values: np.ndarray, offsets: np.ndarray, k: int, w: int) -> tuple[np.ndarray, ...]:
    """``(text, first, last, anchor, twice)`` of each run of windows with one anchor; places count from the text's begin.

    ``twice`` is set when the anchor's k-gram occurs at several places of the run, which may then repeat itself.
    Texts shorter than a window have no runs.
    """
    h = gram_hashes(values, k)
    least = sliding_min(h, w)
    length = np.diff(offsets)
    windows = np.maximum(length - (k + w - 2), 0)
    start = np.repeat(offsets[:-1], windows) + np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
    if not len(start):
        return tuple(np.zeros(0, np.int64) for _ in range(3)) + (np.zeros(0, np.int64), np.zeros(0, bool))
    anchor = least[start]
    new = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)))
    begin = np.flatnonzero(new)
    first, last, anchor = start[begin], start[np.append(begin[1:], len(start)) - 1], anchor[begin]
    twice, view = np.zeros(len(first), bool), np.lib.stride_tricks.sliding_window_view(h, w)
    for i in range(0, len(first), 4096):
        part = slice(i, i + 4096)
        twice[part] = first[part] + view[first[part]].argmin(axis=1) != last[part] + w - 1 - view[last[part]][:, ::-1].argmin(axis=1)
    text = np.searchsorted(offsets, first, "right") - 1
    return text, first - offsets[text], last - offsets[text], anchor.view(np.int64), twice
