"""Interpolated modified Kneser-Ney model of word pairs for the quality classifier.

Words are what ASCII spaces separate, byte for byte; a text begins with a start token and ends with an end token. Words
and pairs are known by 64-bit hashes, none is left out, and their counts are partitioned tables that grow with the text.
A unigram's probability comes from the number of different words before it; below it all words of the model and one
unknown word are equally likely.

The logarithm of a text's probability is a sum over its words and pairs with a term for each one that the model has seen
and none for others (see :func:`fit`). So texts are scored by an equi-join of their words and pairs with the terms, in groups
of hashes: a text's words and pairs of a group travel as one array to the terms of the group.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamella.llm.arrow import flat_bytes, sub_batches
from lamella.plans.session import bucketed, checkpointed, collected, forget, saved

SLICE = 2 << 20
#: Terms that tasks look up themselves: the words and pairs counted most often, which would crowd single tasks of the join.
FREQUENT = 1 << 19
#: Words whose statistics are broadcast when the pairs' terms are made, for the same reason.
FREQUENT_WORDS = 1 << 16
#: Parts in which texts are scored, so that the arrays of one part are on disk at a time.
ROUNDS = 4
#: Parts in which the terms are made, for the same reason.
PARTS = 4
#: Rows that a bucket of a table has at most, about.
BUCKET_ROWS = 2_000_000
#: Groups of terms in a bucket, about; a task has the terms of one group in memory.
GROUPS = 2
#: Bytes of text whose pairs a task sums before it sends them.
HELD = 16 << 20
#: Groups of terms for each part in which their sums are added up, so that arrays between them stay long.
ADDED = 8
START, END = 0x1B873593CC9E2D51, 0x2545F4914F6CDD1D
_BASE, _BYTES = 0x5851F42D4C957F2D, np.random.default_rng(10).integers(1, 1 << 63, 256, np.uint64)
_INVERSE = pow(_BASE, -1, 1 << 64)


def pair_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a << np.uint64(21) | a >> np.uint64(43)) ^ b ^ np.uint64(0x632BE59BD9B4E019)


def _pair(a: str, b: str) -> Column:
    return F.shiftleft(a, 21).bitwiseOR(F.shiftrightunsigned(a, 43)).bitwiseXOR(F.col(b)).bitwiseXOR(F.lit(0x632BE59BD9B4E019))


class Words:
    """Hashes of the words of a column's texts, each text's end token included, with the hash ``before`` and the ``text`` (row)."""

    def __init__(self, column: pa.Array):
        data, self.offsets = flat_bytes(column)
        n, rows = len(data), len(self.offsets) - 1
        blank = (data == 32) | (data >= 9) & (data <= 13)
        first = np.zeros(n + 1, bool)
        first[self.offsets] = True
        before = np.concatenate(([True], blank[:-1])) if n else blank
        after = np.concatenate((blank[1:], [True])) if n else blank
        begin = np.flatnonzero(~blank & (before | first[:-1]))
        end = np.flatnonzero(~blank & (after | first[1:])) + 1
        text = np.searchsorted(self.offsets, begin, "right") - 1
        power, undo = (np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n, x, np.uint64)))) for x in (_BASE, _INVERSE))
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTES[data] * power[:n], dtype=np.uint64)))
        h = (total[end] - total[begin]) * undo[begin]
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            h = (h ^ h >> np.uint64(shift)) * np.uint64(factor)
        h ^= h >> np.uint64(31)
        last = np.searchsorted(text, np.arange(rows), "right")
        self.text, self.hash = np.insert(text, last, np.arange(rows)), np.insert(h, last, np.uint64(END))
        start = np.concatenate(([True], self.text[1:] != self.text[:-1])) if rows else np.zeros(0, bool)
        self.before = np.where(start, np.uint64(START), np.concatenate((np.full(1, START, np.uint64), self.hash[:-1]))[: len(start)])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (s for b in batches for s in sub_batches(b, "text", SLICE))


def count_pairs(texts: DataFrame) -> DataFrame:
    """``(b, c, n)``: pairs of word hashes of all ``text`` values and how often c follows b; those of ``HELD`` bytes of text are summed before they leave."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def summed() -> pa.RecordBatch:
            b, c = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            _, at, n = np.unique(pair_key(b, c), return_index=True, return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(b[at].view(np.int64)), pa.array(c[at].view(np.int64)), pa.array(n.astype(np.int64))], names=["b", "c", "n"])

        for part in _pieces(batches):
            w = Words(part.column(part.schema.get_field_index("text")))
            held.append((w.before, w.hash))
            size += int(w.offsets[-1])
            if size >= HELD:
                yield summed()
                size = 0
        if held:
            yield summed()

    return texts.select("text").mapInArrow(count, "b long, c long, n long").groupBy("b", "c").agg(F.sum("n").alias("n"))


def _discounts(counts: DataFrame, n: str) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts for counts 1, 2 and 3 or more, from the numbers of entries seen 1 to 4 times."""
    seen = counts.agg(*[F.count(F.when(F.col(n) == k, 1)).alias(f"n{k}") for k in range(1, 5)]).first()
    n1, n2, n3, n4 = (float(x) for x in seen)
    if not (n1 and n2):
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 0.9]
    return tuple(min(max(x, 0.1), k - 0.05) for k, x in enumerate(d, 1))


def _taken(n: str, d: tuple[float, float, float]) -> Column:
    return F.when(F.col(n) == 1, d[0]).when(F.col(n) == 2, d[1]).otherwise(d[2])


def _most_counted(rows: DataFrame, most: int) -> DataFrame:
    """Rows counted often enough that at most ``most`` are; the least count is read from how many rows have each count, without a sort."""
    upto, least = 0, None
    for r in rows.groupBy("n").agg(F.count("*").alias("rows")).orderBy(F.desc("n")).limit(most).toLocalIterator():
        upto += r["rows"]
        if upto > most:
            break
        least = r["n"]
    return rows.where(F.lit(False) if least is None else F.col("n") >= least)


def fit(trusted: DataFrame) -> tuple[DataFrame, float]:
    """Terms ``(key, n, term, group)`` of the log-probability, in a table bucketed by group, and the logarithm of an unknown word's probability.

    With w the back-off weight of a context and p the interpolated probability, a seen pair has the term
    log p(c|b) - log w(b) - log p(c) under its key. A seen word has, under its hash, log p(c) less the unknown word's
    logarithm and, if words follow it, log w as a context: every word of a text is followed by one, so each occurrence
    is both. With the unknown word's logarithm for each token the sum is log p of the pair, backed off where unseen.
    """
    c2 = saved(count_pairs(trusted).sortWithinPartitions("b"), "pairs")
    d2 = _discounts(c2, "n")
    words = c2.groupBy(F.col("c").alias("word")).agg(F.count("*").alias("k"))
    context = c2.groupBy(F.col("b").alias("word")).agg(F.sum("n").alias("total"), (F.sum(_taken("n", d2)) / F.sum("n")).alias("w"))
    buckets = -(-c2.count() // BUCKET_ROWS)
    words = bucketed([words.join(context, "word", "full")], "word", "words", buckets)
    d1 = _discounts(words, "k")
    whole = words.where("k is not null").agg(F.sum("k").alias("k"), F.sum(_taken("k", d1)).alias("freed"), F.count("*").alias("v")).first()
    groups = GROUPS * max(buckets, int(trusted.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def grouped(parts: list[DataFrame]) -> DataFrame:
        group = F.pmod(F.shiftrightunsigned("key", 40), F.lit(groups)).cast("int")  # as _group
        out = bucketed([p.withColumn("group", group) for p in parts], "group", "terms", buckets)
        out.groups = groups
        return out

    if not whole["k"]:
        return grouped([words.select(F.col("word").alias("key"), F.col("k").alias("n"), F.lit(0.0).cast("float").alias("term"))]), 0.0
    unknown = whole["freed"] / whole["k"] / (whole["v"] + 1)
    known = words.select("word", "total", "w", F.when(F.col("k").isNotNull(), (F.col("k") - _taken("k", d1)) / whole["k"] + unknown).alias("p"), F.coalesce("total", "k").alias("n"))
    often = checkpointed(_most_counted(known, FREQUENT_WORDS))
    some_b = F.broadcast(often.select(F.col("word").alias("b"), "total", "w"))
    some_c = F.broadcast(often.select(F.col("word").alias("c"), "p"))
    every_b = known.select(F.col("word").alias("b"), "total", "w").hint("merge")
    every_c = known.select(F.col("word").alias("c"), "p").hint("merge")

    def term(rows: DataFrame) -> DataFrame:
        p = (F.col("n") - _taken("n", d2)) / F.col("total") + F.col("w") * F.col("p")
        return rows.select("key", "n", (F.log(p) - F.log("w") - F.log("p")).cast("float").alias("term"))

    one = F.coalesce(F.log("p") - F.lit(math.log(unknown)), F.lit(0.0)) + F.coalesce(F.log("w"), F.lit(0.0))
    single = known.select(F.col("word").alias("key"), "n", one.cast("float").alias("term"))
    parts = []
    for k in range(PARTS):
        mine = F.pmod(F.shiftright("key", 5), F.lit(PARTS)) == k
        near = c2.withColumn("key", _pair("b", "c")).where(mine).join(some_b, "b", "left").join(some_c, "c", "left")  # frequent words don't move
        far = near.where("w is null or p is null").select("key", "b", "c", "n").join(every_b, "b").join(every_c, "c")
        parts.append(term(near.where("w is not null and p is not null").unionByName(far, allowMissingColumns=True)).unionByName(single.where(mine)))
    terms = grouped(parts)
    forget(c2, words)
    return terms, math.log(unknown)


def _group(key: np.ndarray, groups: int) -> np.ndarray:
    """The group of each key, by bits that pairs and words alike have mixed."""
    return (key.view(np.uint64) >> np.uint64(40)) % np.uint64(groups)


def _sorted_runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where equal values of a sorted array begin, and how many there are."""
    at = np.flatnonzero(np.concatenate((np.ones(min(1, len(x)), bool), x[1:] != x[:-1])))
    return at, np.diff(np.append(at, len(x)))


def _added(ids: np.ndarray, totals: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct ids and the sums of what each has."""
    node, at = np.unique(ids, return_inverse=True)
    return node, np.bincount(at, totals, len(node)).astype(np.float64), np.bincount(at, tokens, len(node)).astype(np.int64)


def _arrays(rows: pa.Table, **columns: type) -> Iterator[tuple[np.ndarray, ...]]:
    """The arrays that each row's binary columns hold; null is empty."""
    for row in zip(*(rows.column(c).to_pylist() for c in columns), strict=True):
        yield tuple(np.frombuffer(x or b"", t) for x, t in zip(row, columns.values(), strict=True))


def _met(parts: int):
    def met(asked: pa.Table, terms: pa.Table) -> pa.Table:
        """Arrays ``(part, ids, totals, tokens)`` of the texts that ask for keys of a group of terms; what a text brings along is added."""
        keys, values = terms.column("key").to_numpy(), terms.column("term").to_numpy().astype(np.float64)
        order = np.argsort(keys)
        keys, values = keys[order], values[order]
        found = [(np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))]
        for own, sizes, key, base, n in _arrays(asked, ids=np.int64, sizes=np.int32, keys=np.int64, base=np.float64, tokens=np.int64):
            total = base.copy() if len(base) else np.zeros(len(own))
            if len(key) and len(keys):
                at = np.searchsorted(keys, key).clip(max=len(keys) - 1)
                total += np.bincount(np.repeat(np.arange(len(own)), sizes), np.where(keys[at] == key, values[at], 0.0), len(own))
            found.append((own, total, n if len(n) else np.zeros(len(own), np.int64)))
        columns = _added(*(np.concatenate(x) for x in zip(*found, strict=True)))
        part = _group(columns[0], parts)
        order = np.argsort(part, kind="stable")
        first, count = _sorted_runs(part[order])
        sent = [[x[order[a : a + m]].tobytes() for a, m in zip(first.tolist(), count.tolist(), strict=True)] for x in columns]
        return pa.table([pa.array(part[order][first].astype(np.int32)), *(pa.array(x, pa.binary()) for x in sent)], names=["part", "ids", "totals", "tokens"])

    return met


def _means(rows: pa.Table) -> pa.Table:
    """``(text_id, nll)`` of the texts of a part."""
    ids, totals, tokens = _added(*(np.concatenate(x) for x in zip(*_arrays(rows, ids=np.int64, totals=np.float64, tokens=np.int64), strict=True)))
    return pa.table([pa.array(ids), pa.array(-totals / tokens)], names=["text_id", "nll"])


def scores(texts: DataFrame, terms: DataFrame, unknown: float, frequent: int | None = None) -> DataFrame:
    """``(text_id, nll)``, saved: mean negative log-probability per token of each distinct ``text`` that isn't empty; text_id is its xxhash64.

    A task sends, for each slice of text and group of terms, an array of the words and pairs to be looked up there and one of
    the texts that they are from; sums of a group come back as arrays too, dealt by the texts. The frequent ones, at most ``FREQUENT``, are looked up where they are read; all others
    meet the terms of their group. Copies of a text add up above and below the line.
    """
    table = _most_counted(terms, FREQUENT if frequent is None else frequent).select("key", "term").toArrow()
    keys, values = table.column(0).to_numpy().view(np.uint64), table.column(1).to_numpy()
    order = np.argsort(keys)
    shared, groups = texts.sparkSession.sparkContext.broadcast((keys[order], values[order])), terms.groups
    del table, keys, values, order

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, worth = shared.value
        for part in _pieces(batches):
            w = Words(part.column(part.schema.get_field_index("text")))
            ids = part.column(part.schema.get_field_index("text_id")).to_numpy(zero_copy_only=False)
            tokens = np.bincount(w.text, minlength=len(ids))
            total = tokens * unknown
            rest = []
            for key, text in ((w.hash, w.text), (pair_key(w.before, w.hash), w.text), (np.full(len(ids), START, np.uint64), np.arange(len(ids)))):
                if len(known):
                    place = np.searchsorted(known, key).clip(max=len(known) - 1)
                    here = known[place] == key
                    total += np.bincount(text[here], worth[place[here]], minlength=len(ids)) if here.any() else 0
                    key, text = key[~here], text[~here]
                rest.append((key, text))
            key, text = (np.concatenate(x) for x in zip(*rest, strict=True))
            place = _group(key, groups).astype(np.int64) * len(ids) + text
            order = np.argsort(place)
            place, key = place[order], key[order]
            at, n = _sorted_runs(place)
            group, own = place[at] // len(ids), ids[place[at] % len(ids)]
            n32, ends = n.astype(np.int32), np.append(at, len(key))
            first, count = _sorted_runs(group)
            rows = [(int(group[a]), own[a : a + m].tobytes(), n32[a : a + m].tobytes(), key[ends[a] : ends[a + m]].tobytes(), None, None) for a, m in zip(first.tolist(), count.tolist(), strict=True)]
            rows.append((int(_group(ids[:1], groups)[0]), ids.tobytes(), bytes(4 * len(ids)), b"", total.astype(np.float64).tobytes(), tokens.astype(np.int64).tobytes()))
            types = [pa.int32(), *[pa.binary()] * 5]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["group", "ids", "sizes", "keys", "base", "tokens"])

    rows = texts.where("length(text) > 0").select(F.xxhash64("text").alias("text_id"), "text")
    known = terms.select("group", "key", "term").groupBy("group")
    out = None
    for k in range(ROUNDS):
        some = rows.where(F.pmod(F.shiftright("text_id", 3), F.lit(ROUNDS)) == k).mapInArrow(grams, "group int, ids binary, sizes binary, keys binary, base binary, tokens binary")
        met = some.groupBy("group").cogroup(known).applyInArrow(_met(max(1, groups // ADDED)), "part int, ids binary, totals binary, tokens binary")  # the terms stay in their buckets
        part = saved(met.groupBy("part").applyInArrow(_means, "text_id long, nll double"), "scores")
        collected(texts.sparkSession)
        out = part if out is None else out.unionByName(part)
    return out
