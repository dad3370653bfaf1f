"""Phrase collocation mining (operator 13): multikey three-way quicksort of suffix pointers.

A slice's words are numbered (:mod:`lamella.llm.terms`), and pointers to its suffixes are sorted by multikey three-way
quicksort to a maximum depth; the sizes of the equal partitions are the slice's counts. First all suffixes are sorted to two
words and the partitions are routed by their leading words and added up; pairs that are infrequent everywhere are
abandoned. What is left goes to the tasks as a bitmap of fixed size that may let an infrequent pair pass but holds back no
frequent one; suffixes are cut where it abandons them and sorted on to five words. No key is a group in one task: slices
send sums, which Spark adds up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamella.llm.arrow import flat_bytes, sub_batches
from lamella.llm.terms import lowered, numbered, radix_order, strings
from lamella.llm.windows import mixed, prefix_sums, span_hashes
from lamella.plans.session import forget, saved, small_batches

SLICE, ROWS = 3 << 20, 1 << 16
LEAST, WORDS, TOP, PERCENT = 100, 5, 2000, 100
#: Bits of the bitmap of frequent pairs; a fixed size, so more pairs than bits only let more pass.
BITS = 1 << 26
NO_LANG = "und"
_ENDS = np.zeros(256, bool)
_ENDS[[*b".,;:!?", *range(10, 14)]] = True
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9]] = True


def equal_partitions(keys: list[np.ndarray], pointers: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per depth, a pointer of each equal partition and the partition's size, by multikey three-way quicksort of ``pointers``.

    ``keys[d]`` is the d-th key of each suffix, 0 past its end, where the suffix takes no further part. First keys are
    numbers, so their partitions come from a radix sort. Then all partitions are split at once: each by its middle
    pointer's key into less, equal and greater, by ranks within it; equal ones go on to the next key. A partition of one
    pointer is done.
    """
    out = [([], []) for _ in keys]
    table = np.stack(keys)
    pointers = pointers[keys[0][pointers] > 0].astype(np.int32)
    pointers = pointers[radix_order([keys[0][pointers].astype(np.uint64)])]
    first = keys[0][pointers]
    start = np.flatnonzero(np.concatenate((np.ones(min(1, len(first)), bool), first[1:] != first[:-1]))).astype(np.int32)
    size = np.diff(np.append(start, np.int32(len(pointers))))
    out[0][0].append(pointers[start])
    out[0][1].append(size)
    depth = np.ones(len(start), np.int8)
    while len(pointers) and len(keys) > 1:
        single = size == 1
        alone, at = pointers[start[single]], depth[single]
        for d in range(1, len(keys)):
            alone, at = (x[go] for go in [(table[d, alone] > 0) | (at > d)] for x in (alone, at))
            found = alone[at <= d]
            out[d][0].append(found)
            out[d][1].append(np.ones(len(found), np.int32))
        stay = ~single
        start, size, depth = start[stay], size[stay], depth[stay]
        if not len(start):
            break
        begin = (np.cumsum(size) - size).astype(np.int32)
        pointers = pointers[np.repeat(start - begin, size) + np.arange(size.sum(), dtype=np.int32)]
        start = begin
        seg = np.repeat(np.arange(len(start), dtype=np.int32), size)
        key = table[np.repeat(depth, size), pointers]
        pivot = key[start + size // 2]
        middle = np.repeat(pivot, size)
        less, more = key < middle, key > middle
        n_less, n_more = (np.add.reduceat(x, start, dtype=np.int32) for x in (less, more))
        n_same = size - n_less - n_more
        moved = np.empty_like(pointers)
        for mine, to, n in ((less, start, n_less), (~(less | more), start + n_less, n_same), (more, start + size - n_more, n_more)):
            own = np.flatnonzero(mine)
            before = (np.cumsum(n) - n).astype(np.int32)
            moved[np.arange(len(own), dtype=np.int32) + (to - before)[seg[own]]] = pointers[own]
        real = pivot > 0  # suffixes that end here are the least: their partition is not a phrase
        same = start + n_less
        for d in range(1, len(keys)):
            found = (depth == d) & real
            out[d][0].append(moved[same[found]])
            out[d][1].append(n_same[found])
        on = np.stack([n_less > 0, real & (depth + 1 < len(keys)), n_more > 0]).T.ravel()
        start = np.stack([start, same, start + size - n_more]).T.ravel()[on]
        size = np.stack([n_less, n_same, n_more]).T.ravel()[on]
        depth = np.stack([depth, depth + np.int8(1), depth]).T.ravel()[on]
        pointers = moved
    none = np.zeros(0, np.int32)
    return [(np.concatenate([none, *p]), np.concatenate([none, *n])) for p, n in out]


class Slice:
    """Words of a slice of rows: spans, numbers from 1, the language's number, and whether the next word is in the same piece."""

    def __init__(self, part: pa.RecordBatch):
        coded = part.column(0).dictionary_encode()
        self.langs = coded.dictionary
        data, offsets = flat_bytes(part.column(1))
        self.data = lowered(data)
        ends, space = _ENDS[self.data], _SPACE[self.data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        inside = ~(ends | space)
        before = np.concatenate(([False], inside[:-1])) if len(data) else inside
        after = np.concatenate((inside[1:], [False])) if len(data) else inside
        self.begin = np.flatnonzero(inside & (~before | edge[:-1])).astype(np.int32)
        self.end = np.flatnonzero(inside & (~after | edge[1:])).astype(np.int32) + np.int32(1)
        row = np.searchsorted(offsets, self.begin, "right") - 1
        self.lang = coded.indices.to_numpy(zero_copy_only=False).astype(np.int32)[row]
        breaks = np.concatenate(([0], np.cumsum(ends))).astype(np.int32)
        self.joined = np.append((row[1:] == row[:-1]) & (breaks[self.begin[1:]] == breaks[self.begin[:-1]]), False) if len(row) else np.zeros(0, bool)
        ids, _, first = numbered(self.data, self.begin, self.end)
        self.ids, self.first = (ids + 1).astype(np.int32), first

    def text(self, pointers: np.ndarray, words: int) -> pa.Array:
        """The phrases at pointers, their words joined by one space."""
        each = (pointers[:, None] + np.arange(words, dtype=np.int32)).ravel()
        length = self.end[each] - self.begin[each] + np.int32(1)
        stop = np.cumsum(length, dtype=np.int32)
        source = np.repeat(self.begin[each] - (stop - length), length) + np.arange(int(stop[-1]) if len(stop) else 0, dtype=np.int32)
        joined = np.append(self.data, np.uint8(32))[np.minimum(source, len(self.data))]
        joined[stop - 1] = 32
        ends = stop[words - 1 :: words]
        return strings(joined, np.concatenate(([0], ends[:-1]))[: len(ends)], ends - 1)


def pair_bits(words: np.ndarray, a: np.ndarray, b: np.ndarray, lang: np.ndarray, bits: int) -> np.ndarray:
    """The bit of each pair of words of a language, from hashes of the words and languages."""
    return (mixed(words[a] + mixed(words[b] + mixed(lang))) % np.uint64(bits)).astype(np.int64)


def _hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    return span_hashes(prefix_sums(data.astype(np.uint64) + np.uint64(1)), begin, end)


def _text_hashes(texts: pa.Array) -> np.ndarray:
    data, offsets = flat_bytes(texts)
    return _hashes(data, offsets[:-1], offsets[1:])


def _rows(cut: Slice, found: list[tuple[np.ndarray, np.ndarray]], least_words: int) -> Iterator[pa.RecordBatch]:
    for words, (pointers, n) in enumerate(found, 1):
        for i in range(0, len(pointers) if words >= least_words else 0, ROWS):
            some, count = pointers[i : i + ROWS], n[i : i + ROWS].astype(np.int64)
            yield pa.RecordBatch.from_arrays([cut.langs.take(pa.array(cut.lang[some])), cut.text(some, words), pa.array(np.full(len(some), words, np.int32)), pa.array(count)], names=["lang", "phrase", "words", "n"])


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[Slice]:
    return (Slice(part) for b in batches for part in sub_batches(b, "text", SLICE))


def _keys(cut: Slice, go_on: np.ndarray, depth: int) -> list[np.ndarray]:
    """Keys of the suffix at each word: the language with the first word, then the numbers of the next, 0 where it stops."""
    n, still = len(cut.ids), np.ones(len(cut.ids), bool)
    keys = [cut.ids if len(cut.langs) == 1 else (np.unique(cut.ids.astype(np.int64) * len(cut.langs) + cut.lang, return_inverse=True)[1] + 1).astype(np.int32)]
    for d in range(1, depth):
        still[n - d :] = False
        still[: max(0, n - d)] &= go_on[d - 1 : n - 1][: max(0, n - d)]
        key = np.zeros(n, np.int32)
        key[: max(0, n - d)] = np.where(still[: max(0, n - d)], cut.ids[d:], 0)
        keys.append(key)
    return keys


def leading_counts(texts: DataFrame) -> DataFrame:
    """``(lang, phrase, words, n)`` of all words and pairs of words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cut in _slices(batches):
            yield from _rows(cut, equal_partitions(_keys(cut, cut.joined, 2), np.arange(len(cut.ids))), 1)

    return _summed(texts.mapInArrow(count, "lang string, phrase string, words int, n long"))


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy("lang", "phrase", "words").agg(F.sum("n").alias("n"))


def bitmap(pairs: DataFrame, bits: int = BITS) -> np.ndarray:
    """Bits set by pairs (lang, phrase), combined in tasks; at most ``bits`` / 64 rows of one long leave them."""

    def where(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = pc.split_pattern(b.column(1), " ")
            hashes = _text_hashes(words.flatten())
            at = np.arange(0, 2 * b.num_rows, 2)
            yield pa.RecordBatch.from_arrays([pa.array(pair_bits(hashes, at, at + 1, _text_hashes(b.column(0)), bits))], names=["bit"])

    found = pairs.select("lang", "phrase").mapInArrow(where, "bit long")
    rows = found.groupBy(F.shiftright("bit", 6).alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit").bitwiseAND(F.lit(63)).cast("int"))).alias("word"))
    got = rows.toArrow()
    out = np.zeros(-(-bits // 64), np.uint64)
    out[got.column(0).to_numpy()] = got.column(1).to_numpy().view(np.uint64)
    return out


def deeper_counts(texts: DataFrame, pairs: DataFrame, words: int = WORDS, bits: int = BITS) -> DataFrame:
    """``(lang, phrase, words, n)`` of phrases of 3 to ``words`` words of which no pair is abandoned; ``pairs`` are the frequent ones."""
    shared = texts.sparkSession.sparkContext.broadcast(bitmap(pairs, bits))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for cut in _slices(batches):
            at = np.flatnonzero(cut.joined)
            own = _hashes(cut.data, cut.begin[cut.first], cut.end[cut.first])
            bit = pair_bits(own, cut.ids[at] - 1, cut.ids[at + 1] - 1, _text_hashes(cut.langs)[cut.lang[at]], bits)
            go_on = np.zeros(len(cut.ids), bool)
            go_on[at] = (known[bit >> 6] >> (bit & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
            three = np.flatnonzero(go_on[:-1] & go_on[1:]) if len(go_on) > 1 else at[:0]  # others have no third word
            yield from _rows(cut, equal_partitions(_keys(cut, go_on, words), three), 3)

    return _summed(texts.mapInArrow(count, "lang string, phrase string, words int, n long"))


def _span(first: Column | int, n: Column | int) -> Column:
    return F.array_join(F.slice("w", first, n), " ")


def collocations(docs: DataFrame, least: int = LEAST, words: int = WORDS, top: int = TOP, percent: int = PERCENT, bits: int = BITS) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: each language's ``top`` phrases of 2 to ``words`` words by their lowest-scoring cut.

    A phrase counts from ``least`` occurrences; one that lies in a longer candidate with at least ``percent`` of its count
    is dropped. Null text is empty and null lang ``und``; repeated rows count each; rows without words and an empty table give
    no rows. Texts of any length are read whole, a slice of rows at a time. Other columns, whatever their names, aren't read.
    """
    small_batches(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANG)).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    leading = saved(leading_counts(texts), "leading")
    total = leading.where("words = 1").groupBy("lang").agg(F.sum("n").alias("total"))
    frequent = leading.where(F.col("n") >= least)
    deep = deeper_counts(texts, frequent.where("words = 2"), words, bits).where(F.col("n") >= least)
    counts = saved(frequent.unionByName(deep).join(total, "lang"), "phrases")
    forget(leading)
    wanted = counts.where(F.col("words") > 1).withColumn("w", F.split("phrase", " "))
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("words") - m + 1), lambda i: _span(i, m))))
    covered = wanted.where("words > 2").select("lang", F.explode(F.array_distinct(inner)).alias("phrase"), "n").groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
    left = wanted.join(covered, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("longer") < percent * F.col("n"), F.lit(True)))
    cuts = left.select("lang", "phrase", F.col("n").alias("a"), "total", F.explode(F.transform(F.sequence(F.lit(1), F.col("words") - 1), lambda k: F.struct(k.alias("k"), _span(1, k).alias("one"), _span(k + 1, F.col("words") - k).alias("rest")))).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "total", "cut.*")
    one = counts.select("lang", F.col("phrase").alias("one"), F.col("n").alias("l"))
    rest = counts.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r"))
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    score = F.call_function("div", (F.lit(1000).cast("decimal(4,0)") * F.col("a").cast("decimal(15,0)")) * wide("total"), wide("l") * wide("r"))
    met = cuts.join(one, ["lang", "one"]).join(rest, ["lang", "rest"]).withColumn("score", score)
    lowest = met.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "a", F.col("total").alias("n"))).alias("low")).select("lang", "phrase", "low.*")
    ranked = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    out = lowest.withColumn("rank", F.row_number().over(ranked).cast("long")).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    out = saved(out, "collocations")
    forget(counts)
    return out
