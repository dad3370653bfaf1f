"""Toxicity (operator 5): a convolutional text classifier over hashed word embeddings, trained in numpy.

Words are runs of letters, ASCII lower-cased, hashed into a fixed number of buckets. Filters of widths 1, 2 and 3
slide over the embeddings, the maximum of each over the whole text is kept, and a logistic unit gives the score. The
classifier learns from all labelled rows that aren't held out: embeddings start from the smoothed log-odds of their
buckets, counted over all of them, and in each pass tasks train copies of the network, each on a shard of the rows, whose
changes are averaged. A fifth of the rows isn't trained on: the score is moved so that 0.5 is the best cut there, and
cut-offs for flags are calibrated there per language. The score itself sees nothing but the text.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType

from lamella.llm.arrow import flat_bytes, sub_batches
from lamella.plans.session import bounded, forget, saved, small_batches

BUCKETS = 1 << 20
DIM = 8
FILTERS = 8
WIDTHS = (1, 2, 3)
#: Rows that a copy of the network is trained on before it is averaged with the others, about.
SHARD = 500
#: One labelled row in so many is kept from training, to calibrate the score and the cut-offs.
CHECKED = 5
EPOCHS = 5
#: Rows that are trained on at least, in so many more passes over few rows (30 at most).
LEAST = 5000
BATCH = 50
RATE = 0.05
SLICE = 2 << 20
#: Steps per unit of a score's logarithmic odds in which the rows kept from training are counted.
BINS = 1000
#: Changes of copies are summed in whole numbers of this part, so their order doesn't matter.
UNIT = 1 << 32

_LETTER = np.zeros(256, np.uint64)  # 0: no letter, else a lower-cased letter's value
_LETTER[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_LETTER[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
_LETTER[0x80:] = np.arange(0x80, 0x100)
with np.errstate(over="ignore"):
    _POWERS = np.multiply.accumulate(np.full(64, 0x9E3779B97F4A7C15, np.uint64))


def hashed_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every word of every text, and each text's begin in them (one more than texts)."""
    data, offsets = flat_bytes(column)
    value = _LETTER[data]
    inside = value > 0
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    first[edges] = inside[edges]
    begins = np.flatnonzero(first)
    if not len(begins):
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    at = np.flatnonzero(inside)
    word = np.cumsum(first)[at] - 1
    h = np.add.reduceat(value[at] * _POWERS[(at - begins[word]) & 63], np.searchsorted(at, begins))
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return (h >> np.uint64(44)).astype(np.int64), np.searchsorted(begins, offsets)


class Network:
    """Embeddings, filters, max pooling and a logistic unit; float32 throughout."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.embedding = np.zeros((BUCKETS, DIM), np.float32)
        self.filters = [(rng.normal(0, 0.3, (w, DIM, FILTERS)) * np.array([1, *[0.3] * (w - 1)])[:, None, None]).astype(np.float32) for w in WIDTHS]
        for f in self.filters:
            f[0, 0] = np.abs(f[0, 0]) + 0.5
        self.bias = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.out = np.full(FILTERS * len(WIDTHS), 0.1, np.float32)
        self.constant = np.float32(-1.0)

    def start(self, seen: np.ndarray, ones: np.ndarray, all_: np.ndarray, rate: float, rng) -> None:
        """Embeddings of the buckets ``seen`` from smoothed log-odds: of ``all_`` texts with a bucket ``ones`` are labelled 1, of all texts the share ``rate``."""
        odds = np.log((ones + 2 * rate) / (all_ - ones + 2 * (1 - rate))) - np.log(rate / (1 - rate))
        self.embedding[seen] = rng.normal(0, 0.02, (len(seen), DIM))
        self.embedding[seen, 0] += odds * all_ / (all_ + 10.0)

    def pooled(self, words: np.ndarray, begins: np.ndarray, where: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Max of each filter over each text, at least 0; with ``where`` the word it came from (-1: none)."""
        n = len(begins) - 1
        out = np.zeros((n, FILTERS * len(WIDTHS)), np.float32)
        at = np.full(out.shape, -1, np.int64)
        x, length = self.embedding[words], np.diff(begins)
        for k, w in enumerate(WIDTHS):
            full = np.flatnonzero(length >= w)
            if not len(full):
                continue
            m = len(words) - w + 1
            conv = sum(x[i : m + i] @ self.filters[k][i] for i in range(w)) + self.bias[k]
            for back in range(1, w):  # windows that would leave their text
                edge = begins[1:] - back
                edge = edge[(edge >= 0) & (edge < m)]
                conv[edge] = -1e9
            columns = slice(k * FILTERS, (k + 1) * FILTERS)
            top = np.maximum.reduceat(conv, begins[:-1][full], axis=0) if len(full) == n else np.stack([conv[begins[i] : begins[i + 1] - w + 1].max(axis=0) for i in full])
            out[full, columns] = np.maximum(top, 0)
            if where:
                for row, i in enumerate(full):
                    arg = conv[begins[i] : min(m, begins[i + 1])].argmax(axis=0) + begins[i]
                    at[i, columns] = np.where(top[row] > 0, arg, -1)
        return out, at if where else None

    def odds(self, words: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Logarithmic odds of label 1."""
        return (self.pooled(words, begins)[0] @ self.out + self.constant).astype(np.float64)

    def score(self, words: np.ndarray, begins: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.odds(words, begins)))

    def gradients(self, words: np.ndarray, begins: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean logistic loss over the texts; only words that a filter's maximum came from have one, as rows ``embedding`` of buckets ``touched``."""
        features, at = self.pooled(words, begins, where=True)
        p = 1 / (1 + np.exp(-(features @ self.out + self.constant)))
        g = ((p - y) / len(y)).astype(np.float32)
        back = g[:, None] * self.out[None, :] * (at >= 0)
        out = {"out": features.T @ g, "constant": g.sum(keepdims=True)}
        rows, grads = [np.zeros(0, np.int64)], [np.zeros((0, DIM), np.float32)]
        for k, w in enumerate(WIDTHS):
            columns = slice(k * FILTERS, (k + 1) * FILTERS)
            text, f = np.nonzero(at[:, columns] >= 0)
            source, d = at[:, columns][text, f], back[:, columns][text, f]
            grad = np.zeros_like(self.filters[k])
            for i in range(w):
                np.add.at(grad[i].T, f, d[:, None] * self.embedding[words[source + i]])
                rows.append(words[source + i])
                grads.append(d[:, None] * self.filters[k][i][:, f].T)
            out |= {f"filter{k}": grad, f"bias{k}": np.bincount(f, d, FILTERS).astype(np.float32)}
        touched, inverse = np.unique(np.concatenate(rows), return_inverse=True)
        total = np.zeros((len(touched), DIM), np.float32)
        np.add.at(total, inverse, np.concatenate(grads))
        return out | {"touched": touched, "embedding": total}

    def __getstate__(self):
        """Buckets that the labelled rows never had stay zero and aren't sent."""
        rows = np.flatnonzero(self.embedding.any(axis=1))
        return self.__dict__ | {"embedding": (rows, self.embedding[rows])}

    def __setstate__(self, state):
        rows, values = state.pop("embedding")
        self.__dict__ |= state
        self.embedding = np.zeros((BUCKETS, DIM), np.float32)
        self.embedding[rows] = values


class Trainer:
    """A network and the sums of squared gradients of Adagrad on the logistic loss."""

    def __init__(self, network: Network):
        self.network = network
        self.seen = {"embedding": np.full(BUCKETS, 1e-3, np.float32), "dense": np.full(len(self.dense()), 1e-3, np.float32)}

    def dense(self) -> np.ndarray:
        """All parameters but the embeddings."""
        n = self.network
        return np.concatenate([*(f.ravel() for f in n.filters), *n.bias, n.out, [n.constant]]).astype(np.float32)

    def put(self, dense: np.ndarray) -> None:
        n, at = self.network, 0
        for value in (*n.filters, *n.bias, n.out):
            value.flat = dense[at : at + value.size]
            at += value.size
        n.constant = np.float32(dense[at])

    def step(self, words: np.ndarray, begins: np.ndarray, y: np.ndarray) -> np.ndarray:
        """One step on the mean loss over the texts; the buckets whose embeddings it moved."""
        n, grad = self.network, self.network.gradients(words, begins, y)
        own = np.concatenate([*(grad[f"filter{k}"].ravel() for k in range(len(WIDTHS))), *(grad[f"bias{k}"] for k in range(len(WIDTHS))), grad["out"], grad["constant"]])
        self.seen["dense"] += own**2
        self.put(self.dense() - RATE * own / np.sqrt(self.seen["dense"]))
        touched, own = grad["touched"], grad["embedding"]
        self.seen["embedding"][touched] += (own**2).mean(axis=1)
        n.embedding[touched] -= RATE * own / np.sqrt(self.seen["embedding"][touched])[:, None]
        return touched

    def moved(self, before: Trainer, touched: np.ndarray) -> pa.RecordBatch:
        """Changes since ``before``: a row for each bucket ``touched``, then one for each other parameter under -1, -2, ...; ``s`` is the sums' change."""
        n, dense = len(touched), self.dense() - before.dense()
        values = np.zeros((n + len(dense), DIM + 1))
        values[:n, :DIM] = self.network.embedding[touched] - before.network.embedding[touched]
        values[:n, DIM] = self.seen["embedding"][touched] - before.seen["embedding"][touched]
        values[n:, 0], values[n:, DIM] = dense, self.seen["dense"] - before.seen["dense"]
        columns = [pa.array(c) for c in np.rint(values * UNIT).astype(np.int64).T]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate((touched, -1 - np.arange(len(dense))))), *columns], names=["key", *(f"d{i}" for i in range(DIM)), "s"])

    def move(self, rows: pa.Table) -> None:
        """Adds averaged changes, rows as :meth:`moved` gives."""
        key, *columns = (np.asarray(c) for c in rows.columns)
        change, own = np.column_stack(columns).astype(np.float32), key >= 0
        self.network.embedding[key[own]] += change[own, :DIM]
        self.seen["embedding"][key[own]] += change[own, DIM]
        dense = self.dense()
        dense[-1 - key[~own]] += change[~own, 0]
        self.seen["dense"][-1 - key[~own]] += change[~own, DIM]
        self.put(dense)


@F.arrow_udf(ArrayType(IntegerType()))
def _words(texts: pa.Array) -> pa.Array:
    words, begins = hashed_words(texts)
    return pa.ListArray.from_arrays(pa.array(begins, pa.int32()), pa.array(words, pa.int32()))


def held_out(key: str = "doc_id"):
    """Rows that labels are never learned from: CRC32 of the id as text is a multiple of 5 (a null id counts as empty text)."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, lang, toxic, words, checked)`` of every document with a label that may be learned from, stored.

    Rows with null id or label and held-out rows are left out; an id labelled both ways counts as toxic; of documents
    that share an id the one with the fewest words is used. Ids are broadcast while they are few enough (see :func:`bounded`).
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = docs.select("doc_id", "text", "lang").join(bounded(known), "doc_id").select("doc_id", "toxic", "lang", _words(F.coalesce("text", F.lit(""))).alias("words"))
    once = rows.groupBy("doc_id").agg(F.min(F.struct(F.size("words").alias("n"), "words", "lang", "toxic")).alias("row"))
    return saved(once.select("doc_id", "row.lang", "row.toxic", "row.words", (F.pmod(F.xxhash64("doc_id"), F.lit(CHECKED)) == 0).alias("checked")), "labelled")


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Words and begins of a column of word lists."""
    begins = np.asarray(column.offsets, np.int64)
    return np.asarray(column.values, np.int64)[begins[0] : begins[-1]], begins - begins[0]


def _bucket_counts(rows: DataFrame) -> tuple[np.ndarray, ...]:
    """Buckets of the ``words`` of ``rows``, and of how many texts labelled 1 and of how many texts at all each is."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ones, all_ = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            (words, begins), y = _texts(batch.column(0)), np.asarray(batch.column(1))
            pair = np.unique(words * len(y) + np.repeat(np.arange(len(y)), np.diff(begins)))
            bucket, label = pair // len(y), y[pair % len(y)]
            np.add.at(all_, bucket, 1)
            np.add.at(ones, bucket[label == 1], 1)
        seen = np.flatnonzero(all_)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (seen, ones[seen], all_[seen])], names=["bucket", "ones", "n"])

    sums = rows.select("words", "toxic").mapInArrow(count, "bucket long, ones long, n long").groupBy("bucket").agg(F.sum("ones").alias("ones"), F.sum("n").alias("n")).toArrow()
    bucket, ones, n = (np.asarray(c) for c in sums.columns)
    order = np.argsort(bucket)
    return bucket[order], ones[order], n[order]


def _trained(rows: DataFrame, shards: int, passes: range, shared) -> pa.Table:
    """Average changes of copies of the shared trainer, each trained on all rows of a shard in ``passes``.

    Rows come in an order of their ids' hashes, another in each pass, a batch in memory at a time. A bucket's change is
    averaged over the shards that have moved it.
    """

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held, size, touched = copy.deepcopy(shared.value), [], 0, np.zeros(BUCKETS, bool)

        def step() -> None:
            words, begins, y = (np.concatenate(x) for x in zip(*held, strict=True))
            touched[own.step(words, np.append(0, np.cumsum(begins)), y)] = True
            held.clear()

        for batch in batches:
            (words, begins), y, at = _texts(batch.column(0)), np.asarray(batch.column(1), np.float64), 0
            while at < len(y):
                end = min(len(y), at + BATCH - size)
                held.append((words[begins[at] : begins[end]], np.diff(begins[at : end + 1]), y[at:end]))
                size, at = size + end - at, end
                if size == BATCH:
                    step()
                    size = 0
        if held:
            step()
        if touched.any():
            yield own.moved(shared.value, np.flatnonzero(touched))

    shard = F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(shards)).cast("int")
    order = F.explode(F.sequence(F.lit(passes.start), F.lit(passes.stop - 1)))
    dealt = rows.select("doc_id", "words", "toxic", shard.alias("shard"), order.alias("pass")).repartitionById(shards, F.col("shard"))
    dealt = dealt.sortWithinPartitions("pass", F.xxhash64("pass", "doc_id"), "doc_id").select("words", "toxic")
    names = [*(f"d{i}" for i in range(DIM)), "s"]
    moved = dealt.mapInArrow(train, "key long, " + ", ".join(f"{c} long" for c in names))
    return moved.groupBy("key").agg(*[(F.sum(c) / F.count("*") / UNIT).cast("float").alias(c) for c in names]).toArrow()


def best_cut(bins: np.ndarray, ones: np.ndarray, n: np.ndarray) -> float | None:
    """The odds above which flags agree best with the labels (F1), from ``n`` rows a bin, ``ones`` of them labelled 1: between two bins that have rows. Null without labels of both kinds."""
    order = np.argsort(-bins)
    b, t, n = bins[order], np.cumsum(ones[order]), np.cumsum(n[order])
    if not len(b) or not 0 < t[-1] < n[-1]:
        return None
    k = int((2 * t / (n + t[-1])).argmax())
    return float(b[k] + b[k + 1]) / 2 / BINS if k + 1 < len(b) else b[k] / BINS - 1


def fit(docs: DataFrame, labels: DataFrame) -> tuple[Network, DataFrame | None]:
    """The network trained on all labelled rows, and the odds that are cut-offs, ``(cut_lang, cut)``; without labels of both kinds it stays as it was made.

    One labelled row in ``CHECKED``, by a hash of its id, isn't trained on. The network's constant is moved so that a score
    of 0.5 is the best cut on those rows, and the languages' cut-offs are read from them, all counted in steps of odds.
    """
    network, rows = Network(), labelled(docs, labels)
    rest = rows.where("not checked")
    n, toxic = rest.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not 0 < toxic < n:
        forget(rows)
        return network, None
    context, shards, epochs = docs.sparkSession.sparkContext, -(-n // SHARD), min(30, max(EPOCHS, LEAST // n))
    network.start(*_bucket_counts(rest), toxic / n, np.random.default_rng(11))
    trainer, together = Trainer(network), epochs if shards == 1 else 1
    for k in range(0, epochs, together):
        shared = context.broadcast(trainer)
        trainer.move(_trained(rest, shards, range(k, k + together), shared))
        shared.destroy()
    shared = context.broadcast(network)

    @F.arrow_udf(IntegerType())
    def step(words: pa.Array) -> pa.Array:
        return pa.array(np.rint(np.clip(shared.value.odds(*_texts(words)), -30, 30) * BINS).astype(np.int32))

    counts = saved(rows.where("checked").select("lang", "toxic", step("words").alias("bin")).groupBy("lang", "bin").agg(F.sum("toxic").cast("long").alias("ones"), F.count("*").alias("n")), "counts")
    forget(rows)
    every = counts.groupBy("bin").agg(F.sum("ones").alias("ones"), F.sum("n").alias("n")).toArrow()
    shift = best_cut(*(np.asarray(c) for c in every.columns)) or 0.0
    network.constant -= np.float32(shift)

    def cut(own: pa.Table) -> pa.Table:
        at = best_cut(*(np.asarray(own.column(c)) for c in ("bin", "ones", "n")))
        return pa.table({"cut_lang": own.column("lang")[:1], "cut": pa.array([None if at is None else at - shift], pa.float64())})

    return network, bounded(counts.groupBy("lang").applyInArrow(cut, f"cut_lang {docs.schema['lang'].dataType.simpleString()}, cut double").where("cut is not null"))


def _sigmoid(odds: str) -> Column:
    return 1 / (1 + F.exp(-F.col(odds)))


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score, predicted (score of 0.5 or more), flagged (by the language's cut-off).

    Null and empty texts, and texts without letters, get the score of a text without words. A language without a
    cut-off of its own, null included, uses 0.5. Other columns are not read.
    """
    small_batches(docs.sparkSession)
    network, cuts = fit(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(network)

    @F.arrow_udf(DoubleType())
    def score(texts: pa.Array) -> pa.Array:
        out: list[np.ndarray] = [np.zeros(0)]
        for part in sub_batches(pa.RecordBatch.from_arrays([texts], names=["text"]), "text", SLICE):
            out.append(shared.value.score(*hashed_words(part.column(0))))
        return pa.array(np.concatenate(out))

    scored = docs.select("doc_id", "lang", held_out().alias("held_out"), score(F.coalesce("text", F.lit(""))).alias("score"))
    cut = F.lit(0.5)
    if cuts is not None:
        scored, cut = scored.join(cuts, F.col("lang").eqNullSafe(F.col("cut_lang")), "left"), F.coalesce(_sigmoid("cut"), F.lit(0.5))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), (F.col("score") >= cut).alias("flagged"))
