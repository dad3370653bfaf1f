"""Jobs around :mod:`lamella.llm.windows`: from documents to the runs of windows that may recur, and back.

1. Every input partition is a block. Its tasks hash all texts and send each anchor once, with the block's number and a
   count, so that an anchor of a third of all rows is still one row per block.
2. Anchors seen twice or more go back to the blocks that have them; texts and anchors meet there in one exchange.
3. Documents without such an anchor are finished on the spot. Of the others, the runs of recurring anchors leave with
   their text. A run that occurs several times in a block is sent once. Runs of an anchor with very many of them are
   split into their windows, of which only 128 bits of hash leave, one row for equal windows of a slice; so no task
   gets more than ``hot`` texts of one anchor, however many documents share a passage in different surroundings.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamella.llm.arrow import byte_values, sub_batches
from lamella.llm.windows import mixed, prefix_sums, runs, span_hashes
from lamella.plans.session import checkpointed, saved, small_batches

SLICE = 1 << 20
#: Runs whose anchors a task combines before it sends them.
FLUSH = 2 << 20
DONE, DOCUMENT, RUN, FOUND, HOT = range(5)


@dataclass(frozen=True)
class Spec:
    """Windows of ``k + w - 1`` units; runs of anchors that have more than ``hot`` are split into windows."""

    k: int
    w: int
    hot: int
    #: texts -> (bytes, unit values, units' offsets by text, first byte of each unit, byte after each unit)
    units: Callable[[pa.Array], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    #: text -> (number of units, digest when nothing is removed)
    finish: Callable[[bytes], tuple[int, str]]
    #: bytes of text whose rows a task holds at a time; a window may be a row
    held: int = SLICE

    @property
    def length(self) -> int:
        return self.k + self.w - 1


def as_table(docs: DataFrame) -> DataFrame:
    """``docs`` if it is read straight from files, so that its partitions are the same each time; else saved first."""
    todo, straight = [docs._jdf.queryExecution().optimizedPlan()], True
    while todo:
        node = todo.pop()
        straight &= node.nodeName().endswith(("Project", "Relation"))
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return docs if straight else saved(docs, "documents", compression="zstd")


def _anchors(spec: Spec) -> Callable:
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, n = TaskContext.get().partitionId(), [], 0

        def flush() -> pa.RecordBatch:
            keys, counts = np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held])
            keys, at = np.unique(keys, return_inverse=True)
            counts = np.bincount(at, counts).astype(np.int64)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.full(len(keys), block, np.int32)), pa.array(counts)], names=["key", "block", "n"])

        for batch in (s for b in batches for s in sub_batches(b, "text", SLICE)):
            _, values, offsets, _, _ = spec.units(batch.column(0))
            _, _, _, key, twice = runs(values, offsets, spec.k, spec.w)
            held.append((key, 1 + twice.astype(np.int64)))
            n += len(key)
            if n >= FLUSH:
                yield flush()
                n = 0
        if n:
            yield flush()

    return send


def _recurring(hot: int) -> Callable:
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [[np.asarray(c) for c in b.columns] for b in batches if b.num_rows]
        if not got:
            return
        key, block, n = (np.concatenate(c) for c in zip(*got, strict=True))
        _, at = np.unique(key, return_inverse=True)
        total = np.bincount(at, n)[at]
        some = total > 1
        yield pa.RecordBatch.from_arrays([pa.array(key[some]), pa.array(block[some]), pa.array(total[some] > hot)], names=["key", "block", "hot"])

    return keep


class _Block:
    """What a task knows of the block whose texts it reads: its recurring anchors and the runs sent so far."""

    def __init__(self, spec: Spec, base: int):
        self.spec, self.base, self.rows = spec, base, 0
        self.number, self.parts = None, []

    def begin(self, number: int) -> None:
        self.number, self.parts, self.keys, self.sent = number, [], None, {}

    def learn(self, keys: np.ndarray, hot: np.ndarray) -> None:
        self.parts.append((keys, hot))

    def chosen(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each anchor recurs, and whether it is a hot one."""
        if self.keys is None:
            keys = np.concatenate([k for k, _ in self.parts] or [np.zeros(0, np.int64)])
            hot = np.concatenate([h for _, h in self.parts] or [np.zeros(0, bool)])
            self.keys, first = np.unique(keys, return_index=True)
            self.hot, self.parts = hot[first], []
        if not len(self.keys):
            return np.zeros(len(key), bool), np.zeros(len(key), bool)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        found = self.keys[at] == key
        return found, found & self.hot[at]

    def read(self, ids: list, texts: pa.Array) -> Iterator[tuple]:
        """Rows ``(kind, rid, doc_id, n, digest, key, first, last, body)``; of a HOT row key and last are a window's hashes."""
        spec = self.spec
        data, values, offsets, begin, end = spec.units(texts)
        text, first, last, key, _ = runs(values, offsets, spec.k, spec.w)
        found, hot = self.chosen(key)
        per_text: dict[int, list[tuple[int, int, int]]] = {}
        plain = np.flatnonzero(found & ~hot)
        for t, a, b, h in zip(text[plain].tolist(), first[plain].tolist(), last[plain].tolist(), key[plain].tolist(), strict=True):
            per_text.setdefault(t, []).append((a, b, h))
        split: dict[int, list[tuple[int, int, int]]] = {}
        if hot.any():
            sums = prefix_sums(values), prefix_sums(mixed(values))
            for r in np.flatnonzero(hot):
                at = np.arange(first[r], last[r] + 1)
                o = int(offsets[text[r]])
                h = (span_hashes(x, o + at, o + at + spec.length).view(np.int64).tolist() for x in sums)
                split.setdefault(int(text[r]), []).extend(zip(at.tolist(), *h, strict=True))
        raw = data.tobytes()
        for t, doc_id in enumerate(ids):
            rid, self.rows = self.base + self.rows, self.rows + 1
            whole, o = texts[t], int(offsets[t])
            body = whole.as_py() or b""
            n, digest = spec.finish(body)
            if t not in per_text and t not in split:
                yield DONE, rid, doc_id, n, digest, None, None, None, None
                continue
            yield DOCUMENT, rid, doc_id, n, None, None, None, None, body
            for at, h, g in split.get(t, ()):
                yield HOT, rid, doc_id, 1, None, h, at, g, None
            for a, b, h in per_text.get(t, ()):
                yield RUN, rid, doc_id, None, None, h, a, b, raw[begin[o + a] : end[o + b + spec.length - 1]]


def recurring(docs: DataFrame, spec: Spec, local: Callable[[Iterator[tuple]], Iterator[tuple]]) -> DataFrame:
    """Saved rows ``(kind, rid, doc_id, n, digest, key, first, last, body)`` of all documents, see :class:`_Block`.

    ``local`` sees the rows of a slice and may answer some runs by itself, as rows of kind FOUND.
    """
    small_batches(docs.sparkSession)
    docs = as_table(docs.select("doc_id", F.col("text").cast("binary").alias("text")))
    blocks = docs.select(F.spark_partition_id().alias("p")).agg(F.max("p")).first()[0]
    blocks = 1 if blocks is None else blocks + 1
    sent = docs.select("text").mapInArrow(_anchors(spec), "key long, block int, n long")
    answers = sent.repartition("key").mapInArrow(_recurring(spec.hot), "key long, block int, hot boolean")
    kind = docs.schema["doc_id"].dataType.simpleString()
    none = lambda t: F.lit(None).cast(t)
    texts = docs.select(F.spark_partition_id().alias("block"), F.lit(1).alias("order"), none("long").alias("key"), none("boolean").alias("hot"), "doc_id", "text")
    both = answers.select("block", F.lit(0).alias("order"), "key", "hot", none(kind).alias("doc_id"), none("binary").alias("text")).unionByName(texts)
    names = ["kind", "rid", "doc_id", "n", "digest", "key", "first", "last", "body"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = _Block(spec, TaskContext.get().partitionId() << 33)
        for batch in batches:
            block, order = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            cuts = np.flatnonzero(np.concatenate(([True], (block[1:] != block[:-1]) | (order[1:] != order[:-1]), [True])))
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if state.number != block[a]:
                    state.begin(int(block[a]))
                part = batch.slice(a, b - a)
                if not order[a]:
                    state.learn(np.asarray(part.column(2)), np.asarray(part.column(3).to_numpy(zero_copy_only=False), bool))
                    continue
                for some in sub_batches(part, "text", spec.held):
                    rows = list(local(state.read(some.column(4).to_pylist(), some.column(5).fill_null(b""))))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types(some.schema.field(4).type), strict=True)], names=names)

    def types(key: pa.DataType) -> list[pa.DataType]:
        return [pa.int32(), pa.int64(), key, pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]

    met = both.repartitionById(blocks, F.col("block")).sortWithinPartitions("block", "order")
    return saved(met.mapInArrow(read, f"kind int, rid long, doc_id {kind}, n long, digest string, key long, first long, last long, body binary"), "windows", compression="zstd")


def hot_windows(rows: DataFrame, kept: Column) -> DataFrame:
    """Ranges ``(rid, first, last)`` of the HOT windows of which ``kept`` says so, given ``n`` and ``least`` of all equal ones.

    ``n`` counts equal windows; ``least`` is the smallest ``own``, the order of a document's id with null last.
    """
    hot = rows.where(F.col("kind") == HOT)
    hot = hot.select("rid", "first", F.col("n").alias("one"), F.struct(F.col("doc_id").isNull().alias("missing"), F.col("doc_id").alias("id")).alias("own"), "key", F.col("last").alias("other"))
    equal = checkpointed(hot.groupBy("key", "other").agg(F.sum("one").alias("n"), F.min("own").alias("least")).where("n > 1"))
    found = hot.join(equal, ["key", "other"]).where(kept).select("rid", "first")
    island = F.col("first") - F.row_number().over(Window.partitionBy("rid").orderBy("first"))  # adjacent windows are one range
    return found.withColumn("island", island).groupBy("rid", "island").agg(F.min("first").alias("first"), F.max("first").alias("last")).drop("island")


def hot_found(places: dict[int, list[int]]) -> Iterator[tuple]:
    """FOUND rows of windows by rid, adjacent ones in one."""
    for rid, at in places.items():
        a = np.unique(np.array(at, np.int64))
        cut = np.flatnonzero(np.diff(a) > 1)
        for first, last in zip(a[np.append(0, cut + 1)].tolist(), a[np.append(cut, len(a) - 1)].tolist(), strict=True):
            yield FOUND, rid, None, None, None, None, first, last, None


def documents_with_ranges(batch: pa.RecordBatch) -> Iterator[tuple]:
    """``(doc_id, n, body, firsts, lasts)`` of the rows of :func:`removed`; ranges stay arrays."""
    bodies = byte_values(batch.column(2))
    for i, (doc_id, n, body) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), bodies, strict=True)):
        firsts, lasts = (batch.column(k)[i].values for k in (3, 4))
        yield doc_id, n, body, *(None if x is None else x.to_numpy(zero_copy_only=False) for x in (firsts, lasts))


def removed(rows: DataFrame, found: DataFrame, cut: Callable, schema: str) -> DataFrame:
    """Results of all documents: those done at once, and those that ``cut`` makes of (doc_id, n, body, ranges).

    ``found`` has ranges ``(rid, first, last)`` of windows to remove; one document's ranges are gathered with it.
    """
    own = rows.where(F.col("kind") == FOUND).select("rid", "first", "last")
    ranges = found.unionByName(own).groupBy("rid").agg(F.collect_list(F.struct("first", "last")).alias("ranges"))
    ranges = ranges.withColumnRenamed("rid", "of")
    open_ = rows.where(F.col("kind") == DOCUMENT).select("rid", "doc_id", "n", "body")
    joined = open_.join(ranges, F.col("rid") == F.col("of"), "left").select("doc_id", "n", "body", F.col("ranges.first").alias("firsts"), F.col("ranges.last").alias("lasts"))
    return joined.mapInArrow(cut, schema)


def intervals(firsts: np.ndarray | None, lasts: np.ndarray | None, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal covered stretches ``[begin, end)`` of windows that start in the ranges."""
    if firsts is None or not len(firsts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, z = np.array(firsts, np.int64), np.array(lasts, np.int64) + length
    order = np.argsort(a, kind="stable")
    a, z = a[order], np.maximum.accumulate(z[order])
    new = np.concatenate(([True], a[1:] > z[:-1]))
    return a[new], z[np.append(np.flatnonzero(new)[1:], len(a)) - 1]
