"""SimHash near-dedup (operator 7): segment-popcount embedding, grid range-join, exact check.

The 64 bits of a fingerprint are 16 segments of 4; the bit counts of the segments, packed in one long, are a point on
a grid. The Manhattan distance of two points is at most the number of differing bits, so fingerprints within 2 bits
lie within distance 2 and share a cell that is at most one step from either. Each distinct fingerprint goes to its
own cell and the 32 next to it, whatever the size of the corpus; fingerprints that meet in a cell are checked bit by
bit. A task links what it has verified into stars before it emits, so a crowded cell yields a row per fingerprint
and not a row per pair; components are then joined up over all tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from lamella.llm.arrow import byte_values
from lamella.llm.lz_dedup import word_units
from lamella.llm.windows import gram_hashes, mixed, prefix_sums, span_hashes
from lamella.operators.graph import connected_components
from lamella.plans.session import bounded, checkpointed, collected, forget, saved, small_batches

SEED = 42
SHINGLE_WORDS = 3
MAX_BITS = 2
#: A cell with more fingerprints is searched by blocks of bits, of which at least one is equal in any pair to be found.
CROWDED = 64
#: Near copies of the pipeline's stage: words of a shingle and similarity; orders and smallest hashes of its candidates.
STAGE_WORDS, SIMILARITY, ORDERS, SMALLEST = 5, 0.8, 12, 3
#: Ranges of hashes of a sketch, what its estimate may be too low by (four deviations), rows compared between looks at the components.
BINS, SLACK, COMPARED = 256, 0.1, 64
#: Texts of a slice of a number, of which two meet in a task at once, and shingles of those texts (of 8 bytes each).
TOGETHER, SHINGLES = 8192, 1 << 22
_SEEDS, _FACTORS = np.random.default_rng(7).integers(1, 1 << 63, (2, 16), np.uint64)


def fingerprint(text: bytes, shingle: int = SHINGLE_WORDS) -> int:
    """Bit i is set when it is in over half of the XXH64 values of the word shingles, repeats included; no words: 0."""
    words = text.lower().split()  # bytes: lower-cases A-Z and splits at the six ASCII spaces only
    if not words:
        return 0
    joined, n = b" ".join(words), max(1, len(words) - shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.concatenate(([0], ends[:-1] + 1))
    ends = ends[-1:] if len(words) < shingle else ends[shingle - 1 :]
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(begins[:n].tolist(), ends.tolist(), strict=True)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 65536):
        ones += np.unpackbits(h[i : i + 65536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def _fingerprint_udf(shingle: int = SHINGLE_WORDS):
    @F.arrow_udf(LongType())
    def fingerprints(texts: pa.Array) -> pa.Array:
        return pa.array(np.fromiter((fingerprint(t, shingle) for t in byte_values(texts)), np.uint64, len(texts)).view(np.int64))

    return fingerprints


def cells(fp: str) -> Column:
    """The packed segment counts of a fingerprint and those one step away, as an array of 33 longs (null: off the grid)."""
    ones = F.lit(0x1111111111111111)
    x = sum((F.shiftrightunsigned(F.col(fp), k).bitwiseAND(ones) for k in range(1, 4)), F.col(fp).bitwiseAND(ones))
    step = [1 << 4 * i for i in range(16)]
    near = []
    for i in range(16):
        count = F.shiftrightunsigned(x, 4 * i).bitwiseAND(F.lit(15))
        near += [F.when(count > 0, x - F.lit(step[i])), F.when(count < 4, x + F.lit(step[i]))]
    return F.filter(F.array(x, *near), lambda c: c.isNotNull())


def _linked(keys: np.ndarray, fps: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of positions with the same key (rows are sorted by it) whose fingerprints differ in at most ``most`` bits."""
    at, lag = np.arange(len(keys) - 1), 1
    while len(at):
        at = at[at + lag < len(keys)]
        at = at[keys[at] == keys[at + lag]]
        near = at[np.bitwise_count(fps[at] ^ fps[at + lag]) <= most]
        if len(near):
            yield near, near + lag
        lag += 1


class _Stars:
    """Union-find over the fingerprints of a task, fed with arrays of pairs."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            ra, rb = self.root[a], self.root[b]
            if not (differ := ra != rb).any():
                return
            a, b, lo, hi = a[differ], b[differ], np.minimum(ra, rb)[differ], np.maximum(ra, rb)[differ]
            np.minimum.at(self.root, hi, lo)
            while not np.array_equal(jump := self.root[self.root], self.root):
                self.root = jump


def _verify(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    got = [(np.asarray(b.column(0)), np.asarray(b.column(1)).view(np.uint64)) for b in batches if b.num_rows]
    if not got:
        return
    cell, fp = (np.concatenate(x) for x in zip(*got, strict=True))
    order = np.lexsort((fp, cell))
    cell, fp = cell[order], fp[order]
    nodes, node = np.unique(fp, return_inverse=True)
    stars = _Stars(len(nodes))
    begin = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
    size = np.repeat(np.diff(np.append(begin, len(cell))), np.diff(np.append(begin, len(cell))))
    few = (size > 1) & (size <= CROWDED)
    for a, b in _linked(cell[few], fp[few], most):
        stars.add(node[few][a], node[few][b])
    if (crowd := size > CROWDED).any():
        cell, fp, node = cell[crowd], fp[crowd], node[crowd]
        bounds = [64 * i // (most + 1) for i in range(most + 2)]
        for lo, hi in zip(bounds, bounds[1:], strict=False):
            part = fp >> np.uint64(lo) & np.uint64((1 << hi - lo) - 1)
            order = np.lexsort((fp, part, cell))
            c, p = cell[order], part[order]
            group = np.cumsum(np.concatenate(([True], (c[1:] != c[:-1]) | (p[1:] != p[:-1]))))
            for a, b in _linked(group, fp[order], most):
                stars.add(node[order][a], node[order][b])
    inner = np.flatnonzero(stars.root != np.arange(len(nodes)))
    yield pa.RecordBatch.from_arrays([pa.array(nodes[inner].view(np.int64)), pa.array(nodes[stars.root[inner]].view(np.int64))], names=["a", "b"])


def simhash_links(fps: DataFrame, most: int = MAX_BITS) -> DataFrame:
    """``(a, b)``: links between distinct fingerprints (column ``fp``) that join up all within ``most`` (0 to 2) bits."""
    if not 0 <= most <= 2:
        raise ValueError("cells of one step find links of at most 2 bits")
    met = fps.select(F.explode(cells("fp")).alias("cell"), "fp").repartition("cell")
    return met.mapInArrow(lambda batches: _verify(batches, most), "a long, b long").distinct()


def near_copies(docs: DataFrame, most: int = MAX_BITS) -> DataFrame:
    """One row per row of ``docs``: doc_id, text_hash, fingerprint (16 hex digits), component_id, kept.

    Null and empty texts and texts without words have fingerprint zero and link like any other. component_id is the
    smallest doc_id that links reach; null ids come last, so it is null only where all are. Exactly one row of a
    component is kept (equal rows apart): the smallest by id, then by text_hash. Other columns are not read.
    """
    small_batches(docs.sparkSession)
    rows = checkpointed(docs.select("doc_id", F.xxhash64("text").alias("text_hash"), _fingerprint_udf()(F.coalesce("text", F.lit(""))).alias("fp")))
    order = F.struct(F.col("doc_id").isNull().alias("missing"), F.col("doc_id").alias("doc_id"), F.col("text_hash").alias("text_hash"))
    fps = checkpointed(rows.groupBy("fp").agg(F.min(order).alias("best")))
    roots = connected_components(simhash_links(fps.select("fp"), most))
    rooted = fps.join(roots, fps["fp"] == roots["node"], "left").select("fp", "best", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("best").alias("best"))
    classes = rooted.select("fp", "root").join(least, "root").select("fp", "best")
    return rows.join(classes, "fp").select(
        "doc_id", "text_hash", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("best.doc_id").alias("component_id"), (order == F.col("best")).alias("kept")
    )


def _shingles(texts: pa.Array, size: int) -> list[np.ndarray]:
    """Distinct hashes of each text's shingles of ``size`` lower-cased words; of fewer words the whole sequence is one, also of none."""
    lowered = pa.array([t.lower() for t in byte_values(texts)], pa.large_binary())
    _, values, offsets, _, _ = word_units(lowered)
    grams, sums = gram_hashes(values, size), prefix_sums(values)
    whole = span_hashes(sums, offsets[:-1], offsets[1:])
    return [np.unique(grams[a : b - size + 1]) if b - a >= size else whole[i : i + 1] for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True))]


def _sketch(size: int):
    @F.arrow_udf(StructType([StructField("keys", ArrayType(LongType())), StructField("size", LongType()), StructField("bins", BinaryType())]))
    def sketch(texts: pa.Array) -> pa.Array:
        """For each order of the hashes one number made of the smallest ones; the size of the set; of each of ``BINS`` ranges of hashes a byte of the smallest, 0 if none."""
        keys, bins, sizes = np.zeros((len(texts), ORDERS), np.uint64), np.zeros((len(texts), BINS), np.uint8), []
        edges = np.arange(BINS, dtype=np.uint64) * np.uint64((1 << 64) // BINS)
        for i, own in enumerate(_shingles(texts, size)):
            for k in range(ORDERS):
                h = mixed(own ^ _SEEDS[k])
                h = np.sort(np.partition(h, SMALLEST - 1)[:SMALLEST] if len(h) > SMALLEST else h)
                keys[i, k] = mixed(np.array([(h * _FACTORS[: len(h)]).sum()], np.uint64))[0]
            first = np.searchsorted(own, edges)
            some = np.flatnonzero(first < np.append(first[1:], len(own)))
            bins[i, some] = own[first[some]] % np.uint64(255) + np.uint64(1)
            sizes.append(len(own))
        keys = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * ORDERS), pa.array(keys.ravel().view(np.int64)))
        return pa.StructArray.from_arrays([keys, pa.array(sizes, pa.int64()), pa.array([b.tobytes() for b in bins], pa.binary())], names=["keys", "size", "bins"])

    return sketch


def _sets(size: int):
    @F.arrow_udf(ArrayType(LongType()))
    def sets(texts: pa.Array) -> pa.Array:
        own = _shingles(texts, size)
        ends = np.concatenate(([0], np.cumsum([len(x) for x in own]))).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.uint64), *own]).view(np.int64)))

    return sets


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Of ``(a, b)`` those whose whole sets have that Jaccard similarity; sets too unlike in size to have it aren't fetched twice."""
    one = sets.select(F.col("node").alias("b"), F.col("set").alias("y")).hint("merge")
    two = sets.select(F.col("node").alias("a"), F.col("set").alias("x")).hint("merge")
    shared = F.size(F.array_intersect("x", "y"))
    return checkpointed(pairs.join(one, "b").join(two, "a").where(shared >= similarity * (F.size("x") + F.size("y") - shared)).select("a", "b"))


def _estimated(bins: np.ndarray, similarity: float) -> Callable[[int, np.ndarray], np.ndarray]:
    """The similarity of a text to others by their sketches; 0 where by the estimate, less ``SLACK``, it can't be similar."""

    def share(i: int, near: np.ndarray) -> np.ndarray:
        some, filled = bins[near], bins[i] > 0
        share = np.count_nonzero((some == bins[i]) & filled, axis=1) / np.count_nonzero((some > 0) | filled, axis=1)
        return np.where(share >= similarity - SLACK, share, 0)

    return share


def _exact(sets: list[np.ndarray], similarity: float) -> Callable[[int, np.ndarray], np.ndarray]:
    """The similarity of a text to others by their whole sets, none of them empty; 0 where they aren't similar."""
    size = np.array([len(x) for x in sets])
    begin, known = np.cumsum(size) - size, np.concatenate(sets)
    known.sort()  # in place: two full slices have 8 million shingles, of which an inverse makes several copies
    same = known[1:] == known[:-1]
    known = known[1:][same & ~np.append(False, same)[:-1]]  # what two texts or more have, numbered text by text; all else is the number after these
    number = np.full(size.sum(), len(known), np.int32)
    for first, x in zip(begin.tolist(), sets, strict=True) if len(known) else ():
        at = np.minimum(np.searchsorted(known, x), len(known) - 1)
        number[first : first + len(x)] = np.where(known[at] == x, at, len(known))
    own = np.zeros(len(known) + 1, bool)

    def share(i: int, near: np.ndarray) -> np.ndarray:
        if not len(near):
            return np.zeros(0)
        own[number[begin[i] : begin[i] + size[i]]] = True
        own[-1] = False
        shared = np.empty(len(near), np.int64)
        for x in range(0, len(near), COMPARED):
            some = near[x : x + COMPARED]
            first = np.cumsum(size[some]) - size[some]
            at = np.arange(size[some].sum()) + np.repeat(begin[some] - first, size[some])
            shared[x : x + COMPARED] = np.add.reduceat(own[number[at]], first, dtype=np.int64)
        own[number[begin[i] : begin[i] + size[i]]] = False
        either = size[near] + size[i] - shared
        return np.where(shared >= similarity * either, shared / either, 0)

    return share


def joining_pairs(node: np.ndarray, size: np.ndarray, keys: np.ndarray, root: np.ndarray, share: Callable[[int, np.ndarray], np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """A forest of pairs of texts of a number, in different components, of which ``share`` says that they may be similar.

    Each text outside the largest component is compared with all; texts that a chosen pair joins up aren't paired again.
    ``keys`` are the texts' numbers in earlier orders: two texts that share one of those have met there and don't meet here.
    """
    label = np.unique(root, return_inverse=True)[1]
    stars = _Stars(len(node))
    stars.add(np.unique(label, return_index=True)[1][label], np.arange(len(node)))
    found, done = [], np.zeros(len(node), bool)
    while True:
        main = np.bincount(stars.root).argmax()
        todo = np.flatnonzero((stars.root != main) & ~done)
        if not len(todo):
            return [(int(min(node[i], node[j])), int(max(node[i], node[j]))) for i, js in found for j in js.tolist()]
        for i in todo[:COMPARED].tolist():
            if stars.root[i] == main:
                continue
            done[i] = True
            near = np.flatnonzero(~done & (stars.root != stars.root[i]) & (size >= similarity * size[i] - 1e-9) & (size[i] >= similarity * size - 1e-9))
            near = near[~(keys[near] == keys[i]).any(axis=1)]
            like = share(i, near)
            other, like = near[like > 0], like[like > 0]
            other = other[np.lexsort((-like, stars.root[other]))]
            other = other[np.unique(stars.root[other], return_index=True)[1]]
            if len(other):
                stars.add(np.full(len(other), i), other)
                found.append((i, other))


_GROUP = ["bucket", "i", "j"]


def _candidates(rows: DataFrame, similarity: float, whole: bool) -> DataFrame:
    """``(bucket, i, j, a, b)`` of rows ``(bucket, i, j, node, size, keys, root, content)``: pairs that join up the texts of a group.

    The content is a text's sketch, by which pairs may be similar, or with ``whole`` its set of shingles, by which they are.
    """

    def one(rows: list) -> pa.RecordBatch:
        order = np.argsort(rows[3], kind="stable")
        bucket, i, j, node, size, keys, root, content = (x[order] for x in rows)
        keys = np.array(list(keys), np.int64).reshape(len(node), len(keys[0]))
        share = _exact(list(content), similarity) if whole else _estimated(np.frombuffer(b"".join(content), np.uint8).reshape(-1, BINS), similarity)
        pairs = joining_pairs(node, size, keys, root, share, similarity)
        a, b = (pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1))
        return pa.RecordBatch.from_arrays([*[pa.array(np.full(len(pairs), x[0])) for x in (bucket, i, j)], a, b], names=[*_GROUP, "a", "b"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = []
        for batch in batches:
            rows = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if not len(rows[0]):
                continue
            if held and any(rows[k][0] != held[-1][k][-1] for k in range(3)):
                yield one([np.concatenate(x) for x in zip(*held, strict=True)])
                held = []
            cut = np.flatnonzero(np.logical_or.reduce([rows[k][1:] != rows[k][:-1] for k in range(3)])) + 1
            for x, y in zip([0, *cut], cut, strict=False):
                yield one([np.concatenate(z) for z in zip(*held, [r[x:y] for r in rows], strict=True)])
                held = []
            held.append([r[cut[-1] if len(cut) else 0 :] for r in rows])
        if held:
            yield one([np.concatenate(x) for x in zip(*held, strict=True)])

    dealt = rows.select(*_GROUP, "node", "size", "keys", "root", "content").repartition(*_GROUP).sortWithinPartitions(*_GROUP)
    return dealt.mapInArrow(each, "bucket long, i long, j long, a long, b long")


def similar_links(docs: DataFrame, shingle: int = STAGE_WORDS, similarity: float = SIMILARITY, most: int = TOGETHER) -> DataFrame:
    """``(a, b)``: links that join up texts (their xxhash64) whose sets of word shingles have that Jaccard similarity or more.

    At 0.8 two fingerprints of 64 bits are about 10 bits apart, where popcounts no longer tell texts from others. So
    candidates come from two sources: fingerprints within ``MAX_BITS``, and numbers made of the ``SMALLEST`` smallest
    shingle hashes in each of ``ORDERS`` orders, of which texts of similarity 0.8 share one with probability 0.9998. Every
    candidate is verified by its whole sets.

    The texts of a number meet in a task; those of a number with more than ``most``, or with more than ``SHINGLES``, are
    dealt into slices, of which each two meet. There an estimate from a sketch of ``BINS`` bytes finds pairs that may be
    similar, and only a forest of pairs that would join up components leaves the task. Where a pair turns out unlike, the
    forest may lack others that join up the same components: its slices meet once more with the whole sets of their texts,
    every two texts of different components are compared there, and a forest of similar pairs leaves the task. So no more
    pairs than texts leave a task, however many pairs of a crowd are nearly similar.
    """
    texts = docs.select(F.xxhash64("text").alias("node"), F.coalesce("text", F.lit("")).alias("text"))
    nodes = checkpointed(texts.select("node", _sketch(shingle)("text").alias("s"), _fingerprint_udf(shingle)("text").alias("fp")).select("node", "s.*", "fp"))
    keyed = nodes.select("node", "size", "bins", "keys", F.posexplode("keys").alias("k", "key"))
    keyed = keyed.select(F.xxhash64("k", "key").alias("bucket"), "node", "size", "bins", F.slice("keys", F.lit(1), F.col("k")).alias("keys")).dropDuplicates(["bucket", "node"])
    crowds = nodes.select("node", "size", F.posexplode("keys").alias("k", "key")).select(F.xxhash64("k", "key").alias("bucket"), "node", "size").distinct()
    crowds = checkpointed(crowds.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("size").alias("shingles")).where("n > 1"))
    slices = F.greatest(F.ceil(F.col("n") / most), F.ceil(F.col("shingles") / SHINGLES)).cast("long")
    met = keyed.join(crowds, "bucket").withColumn("own", F.pmod(F.xxhash64("node", "bucket"), slices))
    met = met.withColumn("t", F.explode(F.sequence(F.lit(0).cast("long"), slices - 1))).withColumns({"i": F.least("own", "t"), "j": F.greatest("own", "t")})
    met = saved(met.select(*_GROUP, "node", "size", "bins", "keys"), "met")
    collected(docs.sparkSession)
    fps = checkpointed(nodes.groupBy("fp").agg(F.min("node").alias("rep")))
    same = nodes.join(fps, "fp").select("node", F.col("rep").alias("end"))
    close = simhash_links(fps.select("fp"))
    across = close.join(fps.select(F.col("fp").alias("a"), F.col("rep").alias("node")), "a").join(fps.select(F.col("fp").alias("b"), F.col("rep").alias("end")), "b").select("node", "end")
    first = same.unionByName(across).where("node <> end").select(F.least("node", "end").alias("a"), F.greatest("node", "end").alias("b"))
    tried = saved(_candidates(met.withColumns({"root": F.col("node"), "content": F.col("bins")}), similarity, False), "tried")
    pairs = saved(tried.select("a", "b").unionByName(first).distinct(), "pairs")

    def sets(wanted: DataFrame) -> DataFrame:
        return saved(texts.join(bounded(wanted.distinct()), "node", "left_semi").select("node", _sets(shingle)("text").alias("set")).dropDuplicates(["node"]), "shingles")

    ends = sets(pairs.select(F.explode(F.array("a", "b")).alias("node")))
    good = _verified(pairs, ends, similarity)
    forget(ends)
    again = bounded(tried.join(good, ["a", "b"], "left_anti").select(*_GROUP).distinct())
    more = saved(met.join(again, _GROUP, "left_semi").select(*_GROUP, "node", "size", "keys"), "again")
    forget(met, tried, pairs)
    collected(docs.sparkSession)
    wholes = sets(more.select("node"))
    roots = connected_components(good).withColumnRenamed("node", "of")
    rooted = more.join(roots, F.col("node") == F.col("of"), "left").select(*more.columns, F.coalesce("root", "node").alias("root"))
    rows = rooted.join(wholes.withColumnRenamed("set", "content").hint("merge"), "node")
    out = checkpointed(good.unionByName(_candidates(rows, similarity, True).select("a", "b")).distinct())
    forget(more, wholes)
    return out


def similar_copies(docs: DataFrame, shingle: int = STAGE_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """One row per row of ``docs``: doc_id, text_hash, component_id, kept; components are what :func:`similar_links` join up.

    Null texts are empty; texts without words are alike. Equal texts are one component. component_id is the smallest
    doc_id of the component, null last; one document of each is kept: the smallest by id, then by text_hash, equal rows apart.
    """
    small_batches(docs.sparkSession)
    order = F.struct(F.col("doc_id").isNull().alias("missing"), F.col("doc_id").alias("doc_id"), F.col("node").alias("text_hash"))
    rows = checkpointed(docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("node")))
    texts = checkpointed(rows.groupBy("node").agg(F.min(order).alias("best")))
    roots = connected_components(similar_links(docs.select(F.coalesce("text", F.lit("")).alias("text")), shingle, similarity))
    rooted = texts.join(roots.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left").select("node", "best", F.coalesce("root", "node").alias("root"))
    least = rooted.groupBy("root").agg(F.min("best").alias("best"))
    classes = checkpointed(rooted.select("node", "root").join(least, "root").select("node", "best"))
    return rows.join(classes, "node").select("doc_id", F.col("node").alias("text_hash"), F.col("best.doc_id").alias("component_id"), (order == F.col("best")).alias("kept"))


def drop_similar(docs: DataFrame, shingle: int = STAGE_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one document of each component of :func:`similar_copies`, the one with the smallest id; other columns may have any name."""
    return _kept(docs, similar_copies(docs, shingle, similarity), F.xxhash64(F.coalesce("text", F.lit(""))))


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each component of :func:`near_copies`, the one with the smallest id."""
    return _kept(docs, near_copies(docs), F.xxhash64("text"))


def _kept(docs: DataFrame, copies: DataFrame, text_hash: Column) -> DataFrame:
    kept = copies.where("kept").select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), text_hash.alias("own_hash"), F.col("doc_id").alias("own"))
    same = rows.join(kept, F.col("own").eqNullSafe(F.col("id")) & (F.col("own_hash") == F.col("hash")), "left_semi")
    return same.dropDuplicates(["own", "own_hash"]).select("row.*")
