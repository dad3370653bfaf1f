"""Substring dedup (operator 4): relative Lempel-Ziv parsing against the documents with smaller ids.

Runs of 13-word windows that may recur (see :mod:`lamella.llm.recurrence`) meet with the other runs of their anchor.
In the order of document ids each run is parsed greedily against the indexed blocks of smaller ids: the window at the
parse position is looked up and extended word by word to the longest factor in its block. Factors of 13 words or more
are duplicate spans. Parsing goes on 12 words before a factor's end, so that windows across the boundary of two factors
are looked up too.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.llm.arrow import byte_values
from lamella.llm.recurrence import DONE, FOUND, HOT, RUN, Spec, documents_with_ranges, hot_found, hot_windows, intervals, recurring, removed
from lamella.llm.windows import prefix_sums, span_hashes
from lamella.plans.session import settled

WINDOW = 13
SPACE = 0x20


def word_units(texts: pa.Array):
    """Words of each text, joined by one space; a word is a run of bytes other than the six ASCII spaces."""
    joined = [b" ".join(t.split()) for t in byte_values(texts)]
    data = np.frombuffer(b" ".join(joined) + b" ", np.uint8)
    stop = np.flatnonzero(data == SPACE)
    begin = np.concatenate(([0], stop[:-1] + 1))
    real = stop > begin  # an empty text leaves an empty word between two spaces
    begin, stop = begin[real], stop[real]
    sums = prefix_sums(data.astype(np.uint64) + np.uint64(1))
    size = np.array([len(j) + 1 for j in joined])
    offsets = np.searchsorted(begin, np.concatenate(([0], np.cumsum(size))))
    return data, span_hashes(sums, begin, stop), offsets, begin, stop


def _finish(text: bytes) -> tuple[int, str]:
    words = text.split()
    return len(words), hashlib.sha256(b" ".join(words)).hexdigest()


SPEC = Spec(k=6, w=WINDOW - 5, hot=4000, units=word_units, finish=_finish)


def _order(doc_id) -> tuple:
    """Null ids come last."""
    return doc_id is None, doc_id


def _once(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Of equal runs and equal hot windows in a slice those of the smallest id are sent; the others are found to repeat it."""
    seen: dict[tuple[int, bytes], list[tuple]] = {}
    for row in rows:
        if row[0] == RUN or row[0] == HOT:
            seen.setdefault((row[5], row[8] if row[0] == RUN else row[7]), []).append(row)
        else:
            yield row
    places: dict[int, list[int]] = {}
    for same in seen.values():
        least = min(_order(r[2]) for r in same)
        for r in same:
            if _order(r[2]) == least:
                yield r
            elif r[0] == HOT:
                places.setdefault(r[1], []).append(r[6])
            else:
                yield FOUND, r[1], None, None, None, None, r[6], r[7], None
    yield from hot_found(places)


class Reference:
    """Index of the windows of all blocks added: window -> (block, place of its first word)."""

    def __init__(self):
        self.blocks: list[list[bytes]] = []
        self.index: dict[bytes, tuple[int, int]] = {}

    def add(self, words: list[bytes]) -> None:
        block = len(self.blocks)
        self.blocks.append(words)
        for i in range(len(words) - WINDOW + 1):
            self.index.setdefault(b" ".join(words[i : i + WINDOW]), (block, i))

    def spans(self, words: list[bytes]) -> list[tuple[int, int]]:
        """Ranges ``(first, last)`` of windows of ``words`` that some block holds."""
        out, i, n = [], 0, len(words)
        while i <= n - WINDOW:
            if (hit := self.index.get(b" ".join(words[i : i + WINDOW]))) is None:
                i += 1
                continue
            block, at = self.blocks[hit[0]], hit[1]
            size = WINDOW
            while i + size < n and at + size < len(block) and words[i + size] == block[at + size]:
                size += 1
            out.append((i, i + size - WINDOW))
            i += size - WINDOW + 1  # the next window crosses the factor's end
        return out


def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges of repeated windows of runs ``(key, doc_id, body, rid, first)`` sorted by key, then id with null last.

    Equal runs of one anchor are parsed and indexed once.
    """
    key, reference = None, Reference()
    doc, pending, parsed, indexed = None, [], {}, set()
    for batch in batches:
        rows = []
        for k, doc_id, body, rid, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if k != key:
                key, reference, doc, pending, parsed, indexed = k, Reference(), (doc_id,), [], {}, set()
            elif (doc_id,) != doc:
                for old in pending:
                    if old not in indexed:
                        indexed.add(old)
                        reference.add(old.split())
                doc, pending = (doc_id,), []
                parsed.clear()
            if body in indexed:
                rows.append((rid, first, first + body.count(b" ") - WINDOW + 1))
                continue
            if body not in parsed:
                parsed[body] = reference.spans(body.split()) if reference.blocks else []
                pending.append(body)
            rows += [(rid, first + a, first + z) for a, z in parsed[body]]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["rid", "first", "last"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc_id, n, body, firsts, lasts in documents_with_ranges(batch):
            begin, end = intervals(firsts, lasts, WINDOW)
            words, kept, at = body.split(), [], 0
            for a, z in zip(begin.tolist(), end.tolist(), strict=True):
                kept += words[at:a]
                at = z
            kept += words[at:]
            rows.append((doc_id, n, int((end - begin).sum()), hashlib.sha256(b" ".join(kept)).hexdigest()))
        types = [batch.schema.field(0).type, pa.int64(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["doc_id", "n_words", "n_removed", "kept_sha256"])


def remove_duplicates(docs: DataFrame, spec: Spec = SPEC) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept_sha256.

    Every word covered by a window of 13 words that also starts in a document with a smaller id is removed. Rows with
    the same id are never smaller than each other; null ids are larger than all others. Null texts have no words;
    texts under 13 words stay whole. Other columns are not read.
    """
    rows = recurring(docs, spec, _once)
    sent = rows.where(F.col("kind") == RUN).select("key", "doc_id", "body", "rid", "first").repartition("key").sortWithinPartitions("key", F.col("doc_id").asc_nulls_last())
    found = sent.mapInArrow(resolve, "rid long, first long, last long").unionByName(hot_windows(rows, F.col("own") > F.col("least")))
    kind = docs.schema["doc_id"].dataType.simpleString()
    done = rows.where(F.col("kind") == DONE).select("doc_id", F.col("n").alias("n_words"), F.lit(0).cast("long").alias("n_removed"), F.col("digest").alias("kept_sha256"))
    return settled(done.unionByName(removed(rows, found, _cut, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string")), "kept", rows)
