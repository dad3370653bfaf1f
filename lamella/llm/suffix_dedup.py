"""Suffix-array dedup (operator 3): bytes covered by 400-byte strings that start anywhere else are removed.

Runs that may recur (see :mod:`lamella.llm.recurrence`) are concatenated into shards of bounded size. A shard's suffix
array comes from Larsson-Sadakane refinement in numpy: suffixes are sorted by eight bytes, then groups that are still
tied by the rank of the suffix further on, doubling the depth up to the window. Kasai's method, over all runs of the
shard in step, gives common prefixes of neighbours; 400 or more mark a repeat. Where runs of one anchor fill several
shards, each shard's sorted windows are merged into those before by binary search.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.llm.arrow import flat_bytes
from lamella.llm.recurrence import DONE, FOUND, HOT, RUN, Spec, documents_with_ranges, hot_found, hot_windows, intervals, recurring, removed
from lamella.plans.session import settled

WINDOW = 400
SHARD = 1 << 20
#: Suffixes that advance one after another in Kasai's method; longer runs are taken in pieces.
PIECE = 32


def _units(texts: pa.Array):
    data, offsets = flat_bytes(texts)
    at = np.arange(len(data))
    return data, data.astype(np.uint64) + np.uint64(1), offsets, at, at + 1


SPEC = Spec(k=100, w=WINDOW - 99, hot=4000, units=_units, finish=lambda text: (len(text), hashlib.sha256(text).hexdigest()), held=1 << 18)


def _once(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Runs and hot windows that a slice has several times are repeats throughout: found at once, and sent once for the other slices."""
    seen: dict[tuple[int, bytes], list[tuple]] = {}
    for row in rows:
        if row[0] == RUN or row[0] == HOT:
            seen.setdefault((row[5], row[8] if row[0] == RUN else row[7]), []).append(row)
        else:
            yield row
    places: dict[int, list[int]] = {}
    for same in seen.values():
        yield same[0] if same[0][0] == RUN else (*same[0][:3], len(same), *same[0][4:])
        for r in same if len(same) > 1 else ():
            if r[0] == HOT:
                places.setdefault(r[1], []).append(r[6])
            else:
                yield FOUND, r[1], None, None, None, None, r[6], r[7], None
    yield from hot_found(places)


def words8(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place as one big-endian number; zeros follow the end."""
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    out = np.zeros(len(data), np.uint64)
    for i in range(8):
        out = out << np.uint64(8) | padded[i : i + len(data)]
    return out


def suffix_array(word: np.ndarray, depth: int, ahead_of: np.ndarray | None = None) -> np.ndarray:
    """Rank of each suffix by its first ``depth`` bytes (at least 8), equal ones ranking alike: Larsson-Sadakane.

    A rank is the place of the first suffix of its group in sorted order. Only groups that are still tied are sorted
    again, by the ranks of the suffixes ``h`` further on; near the end the step is shorter, so no more than ``depth``
    bytes count. Suffixes nearer to the end than ``depth`` get ranks of what follows them there, padded with zeros.
    ``ahead_of`` says how many bytes each suffix lies beyond the last one wanted (0: it is wanted); suffixes beyond are
    refined only as deep as those before them look.
    """
    n = len(word)
    order = np.argsort(word)
    rank = np.empty(n, np.int64)

    def regroup(slots: np.ndarray, suffixes: np.ndarray, new: np.ndarray) -> np.ndarray:
        """Ranks of sorted ``suffixes`` in their slots, where ``new`` starts a group; which of them are still tied."""
        begin = np.flatnonzero(new)
        size = np.diff(np.append(begin, len(suffixes)))
        rank[suffixes] = np.repeat(slots[begin], size)
        return np.repeat(size > 1, size)

    key = word[order]
    tied = regroup(np.arange(n), order, np.concatenate(([True], key[1:] != key[:-1])))
    slots, suffixes, h = np.flatnonzero(tied), order[tied], 8
    while h < depth and len(suffixes):
        step = min(h, depth - h)
        if ahead_of is not None:
            needed = ahead_of[suffixes] <= depth - h - step
            slots, suffixes = slots[needed], suffixes[needed]
        ahead = suffixes + step
        key = rank[suffixes] << 32 | np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        order = np.argsort(key)
        suffixes, key = suffixes[order], key[order]
        tied = regroup(slots, suffixes, np.concatenate(([True], key[1:] != key[:-1])))
        slots, suffixes, h = slots[tied], suffixes[tied], h + step
    return rank


def _extend(word: np.ndarray, a: np.ndarray, b: np.ndarray, h: np.ndarray, depth: int) -> np.ndarray:
    """Common prefix of the suffixes ``a`` and ``b``, known to be ``h`` at least, up to ``depth`` or a little more."""
    h, open_ = h.copy(), np.arange(len(a))
    while len(open_):
        x = word[np.minimum(a[open_] + h[open_], len(word) - 1)] ^ word[np.minimum(b[open_] + h[open_], len(word) - 1)]
        same = np.full(len(x), 8)
        bits = np.flatnonzero(x)
        same[bits] = (53 - np.frexp((x[bits] >> np.uint64(11)).astype(np.float64))[1]) // 8
        low = bits[(x[bits] >> np.uint64(11)) == 0]
        same[low] = np.where(x[low] > 255, 6, 7)
        h[open_] += same
        open_ = open_[(same == 8) & (h[open_] < depth)]
    return h


def common_prefixes(word: np.ndarray, begin: np.ndarray, count: np.ndarray, sa: np.ndarray, depth: int, rank: np.ndarray) -> np.ndarray:
    """Kasai's common prefix of each entry of ``sa`` with the one before it, for the ``count`` suffixes from each ``begin``.

    All runs advance together, one suffix a step; a prefix carries over less one while the neighbour advances with it.
    Neighbours that the refinement to ``depth`` left tied (equal in ``rank``) share it whole.
    """
    previous = np.full(len(word) + 1, -1, np.int64)
    previous[sa[1:]] = sa[:-1]
    last = np.zeros(len(word) + 1, bool)
    last[begin + count - 1] = True
    pieces = -(-count // PIECE)
    part = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin, count = np.repeat(begin, pieces) + part * PIECE, np.minimum(np.repeat(count, pieces) - part * PIECE, PIECE)
    lcp = np.zeros(len(word) + 1, np.int64)
    h, before = np.zeros(len(begin), np.int64), np.full(len(begin), -1, np.int64)
    for t in range(int(count.max(initial=0))):
        run = np.flatnonzero(count > t)
        i = begin[run] + t
        j, was = previous[i], before[run]
        valid = (was >= 0) & ~last[np.maximum(was, 0)] & ((h[run] < depth) | (j == was + 1))
        start = np.where(valid, np.maximum(h[run] - 1, 0), 0)
        some = j >= 0
        start[~some] = 0
        tied = some & (rank[i] == rank[j])
        start[tied] = depth
        some &= ~tied
        start[some] = _extend(word, i[some], j[some], start[some], depth)
        lcp[i], h[run], before[run] = start, start, j
    return lcp[sa]


def _less(word: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether windows ``a`` sort before windows ``b``, and whether they are equal."""
    less, equal, open_ = np.zeros(len(a), bool), np.ones(len(a), bool), np.arange(len(a))
    for t in range(0, WINDOW, 8):
        x, y = word[a[open_] + t], word[b[open_] + t]
        if rest := max(0, t + 8 - WINDOW):
            x, y = x >> np.uint64(8 * rest), y >> np.uint64(8 * rest)
        differ = x != y
        less[open_[differ]] = x[differ] < y[differ]
        equal[open_[differ]] = False
        open_ = open_[~differ]
        if not len(open_):
            break
    return less, equal


def merge(word: np.ndarray, old: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Binary search of sorted distinct windows ``new`` in ``old``: the place of each and whether it is there."""
    lo, hi = np.zeros(len(new), np.int64), np.full(len(new), len(old), np.int64)
    while (open_ := np.flatnonzero(lo < hi)).size:
        mid = (lo[open_] + hi[open_]) // 2
        less, _ = _less(word, old[mid], new[open_])
        lo[open_[less]] = mid[less] + 1
        hi[open_[~less]] = mid[~less]
    there = np.zeros(len(new), bool)
    inside = np.flatnonzero(lo < len(old))
    there[inside] = _less(word, old[lo[inside]], new[inside])[1]
    return lo, there


class Shard:
    """Runs put together: their windows in sorted order and which of them repeat within the shard."""

    def __init__(self, runs: list[tuple[int, bytes, int, int]]):
        self.runs = runs
        self.data = np.frombuffer(b"".join(r[1] for r in runs), np.uint8)
        length = np.array([len(r[1]) for r in runs])
        self.begin = np.cumsum(length) - length
        self.count = length - WINDOW + 1
        self.word = words8(self.data)
        ahead = np.concatenate([np.zeros(0, np.int64), np.arange(len(self.data)) - np.repeat(self.begin + self.count - 1, length)])
        rank = suffix_array(self.word, WINDOW, ahead)
        at = np.repeat(self.begin - np.cumsum(self.count) + self.count, self.count) + np.arange(self.count.sum())
        self.sa = at[np.argsort(rank[at], kind="stable")]
        lcp = common_prefixes(self.word, self.begin, self.count, self.sa, WINDOW, rank)
        same = lcp >= WINDOW
        same[:1] = False
        self.group = np.cumsum(~same) - 1
        repeats = np.bincount(self.group)[self.group] > 1
        self.marked = np.zeros(len(self.data), bool)
        self.marked[self.sa[repeats]] = True

    def windows_of(self, key: int) -> tuple[np.ndarray, np.ndarray]:
        """Sorted windows of the runs of ``key`` and their group numbers (groups never cross keys)."""
        own = np.zeros(len(self.data), bool)
        for (k, body, *_), b in zip(self.runs, self.begin.tolist(), strict=True):
            if k == key:
                own[b : b + len(body)] = True
        pick = own[self.sa]
        return self.sa[pick], self.group[pick]

    def slim(self) -> None:
        """Drops what only sorting and merging need."""
        self.word = self.sa = self.group = self.data = None

    def results(self) -> Iterator[tuple[int, int, int]]:
        """``(rid, first, last)`` of marked windows."""
        for (_, _, rid, first), b, n in zip(self.runs, self.begin.tolist(), self.count.tolist(), strict=True):
            flags = np.concatenate(([False], self.marked[b : b + n], [False]))
            edges = np.flatnonzero(flags[1:] != flags[:-1])
            for a, z in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
                yield rid, first + a, first + z - 1


class Merged:
    """Windows of one anchor over the shards that it fills, sorted and distinct."""

    def __init__(self, key: int):
        self.key, self.shards, self.text, self.size = key, [], [], 0
        self.old, self.owner = np.zeros(0, np.int64), np.zeros((0, 2), np.int64)

    def add(self, shard: Shard) -> None:
        at, group = shard.windows_of(self.key)
        if not len(at):
            return
        head = np.concatenate(([True], group[1:] != group[:-1]))
        new = at[head] + self.size
        self.text.append(shard.data)
        self.size += len(shard.data)
        word = words8(np.concatenate(self.text))
        place, there = merge(word, self.old, new)
        for s, p in {(int(s), int(p)) for s, p in self.owner[place[there]]}:
            self.shards[s].marked[p] = True
        again = np.isin(group, group[head][there])
        shard.marked[at[again]] = True
        self.shards.append(shard)
        fresh = ~there
        self.old = np.insert(self.old, place[fresh], new[fresh])
        self.owner = np.insert(self.owner, place[fresh], np.column_stack((np.full(fresh.sum(), len(self.shards) - 1), at[head][fresh])), axis=0)


def resolve(batches: Iterator[pa.RecordBatch], shard_bytes: int = SHARD) -> Iterator[pa.RecordBatch]:
    """Ranges of repeated windows of runs ``(key, body, rid, first)`` that come sorted by key."""

    again: list[tuple[int, int, int]] = []

    def out(shards: list[Shard]) -> Iterator[pa.RecordBatch]:
        rows = [*again, *(r for s in shards for r in s.results())]
        again.clear()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["rid", "first", "last"])

    def shards() -> Iterator[Shard]:
        """Distinct runs; of a run that comes again every place is a repeat."""
        runs, size, now, seen = [], 0, None, {}
        for batch in batches:
            for key, body, rid, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != now:
                    now, seen = key, {}
                last = first + len(body) - WINDOW
                if body in seen:
                    if seen[body]:
                        again.append(seen[body])
                        seen[body] = None
                    again.append((rid, first, last))
                    continue
                seen[body] = (rid, first, last)
                if runs and (size + len(body) > 4 * shard_bytes or size >= shard_bytes):
                    yield Shard(runs)
                    runs, size = [], 0
                runs.append((key, body, rid, first))
                size += len(body)
        if runs:
            yield Shard(runs)

    waiting: list[Shard] = []
    merged = None
    for shard in shards():
        if waiting and waiting[-1].runs[-1][0] == shard.runs[0][0]:
            if merged is None or merged.key != shard.runs[0][0]:
                merged = Merged(shard.runs[0][0])
                merged.add(waiting[-1])
            merged.add(shard)
            if shard.runs[-1][0] != merged.key:
                yield from out(waiting)
                waiting, merged = [], None
        else:
            yield from out(waiting)
            waiting, merged = [], None
        if waiting:
            waiting[-1].slim()
        waiting.append(shard)
    yield from out(waiting)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc_id, n, body, firsts, lasts in documents_with_ranges(batch):
            begin, end = intervals(firsts, lasts, WINDOW)
            digest, at = hashlib.sha256(), 0
            for a, z in zip(begin.tolist(), end.tolist(), strict=True):
                digest.update(body[at:a])
                at = z
            digest.update(body[at:])
            rows.append((doc_id, n, int((end - begin).sum()), len(begin), digest.hexdigest()))
        types = [batch.schema.field(0).type, pa.int64(), pa.int64(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def remove_repeats(docs: DataFrame, spec: Spec = SPEC) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Every byte covered by a 400-byte string that also starts at another place, in whatever document, is removed.
    Null texts are empty; texts under 400 bytes stay whole; rows equal in all columns count as several documents, so
    their texts repeat each other. Other columns are not read.
    """
    rows = recurring(docs, spec, _once)
    sent = rows.where(F.col("kind") == RUN).select("key", "body", "rid", "first").repartition("key").sortWithinPartitions("key")
    found = sent.mapInArrow(resolve, "rid long, first long, last long").unionByName(hot_windows(rows, F.lit(True)))
    kind = docs.schema["doc_id"].dataType.simpleString()
    done = rows.where(F.col("kind") == DONE).select("doc_id", F.col("n").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.col("digest").alias("kept_sha256"))
    return settled(done.unionByName(removed(rows, found, _cut, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")), "kept", rows)
