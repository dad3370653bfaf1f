"""Best-fit packing (operator 9): bounded-space online best fit over token sequences.

Documents are tokenized once where they are read; only ``(doc_id, piece, start, length, crc)`` rows travel. They are
dealt by hash to packers of about 32,768 pieces. A packer keeps a fixed number of bins open, in a bitset keyed by free
space: the lowest set bit at or above a length is the tightest fit, the lowest set bit of all is the fullest bin, which
closes first when a new one is needed.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lamella.llm.arrow import byte_values, sub_batches
from lamella.plans.session import checkpointed, small_batches

TOKENIZER = "word_bpe_49k.json"
CAPACITY = 2048
OPEN_BINS = 1024
PIECES_PER_PACKER = 32768
END = 0
#: Entries of a worker's cache; it is emptied when full, so its memory is bounded.
CACHE = 800_000
#: Bytes of text that are cut at once.
SLICE = 2 << 20
#: Texts and words of these characters are cut as the tokenizer cuts them after lower-casing (fixed by its file).
SIMPLE = re.compile("[\\t-\\r -~À-ÿ]*")
PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\\sa-zß-öø-ÿ0-9]+")


class Parts:
    """Part of a word -> its ids as little-endian bytes.

    The tokenizer cuts a text into parts and encodes each by itself, so parts are encoded once and cached. All that are
    missing are encoded in one call, as a text of their own: the last token of each is marked as a word's end.
    """

    def __init__(self, name: str):
        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
        self.ends = np.array([self.tokenizer.id_to_token(i).endswith("</w>") for i in range(self.tokenizer.get_vocab_size())])
        self.known: dict[str, bytes] = {}

    def learn(self, seen: set[str]) -> None:
        """Makes every part of ``seen``, none of them known yet, known."""
        if len(self.known) + len(seen) > CACHE:
            self.known.clear()
        missing = list(seen)
        for i in range(0, len(missing), 4096):
            some = missing[i : i + 4096]
            ids = np.array(self.tokenizer.encode(" ".join(some), add_special_tokens=False).ids, "<u4")
            stops = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(stops) != len(some):
                raise ValueError("the tokenizer cut a part")
            data = ids.tobytes()
            self.known.update(zip(some, map(data.__getitem__, map(slice, [0, *stops[:-1]], stops)), strict=True))

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@lru_cache(maxsize=2)
def cached_parts(name: str) -> Parts:
    return Parts(name)


def _simple(text: str) -> bool:
    return SIMPLE.fullmatch(text) is not None and "<|" not in text


def encoded(texts: list[bytes], cache: Parts) -> Iterator[bytes]:
    """Every text's ids and the closing id 0, as little-endian unsigned 32-bit.

    A text with other characters is cut at ASCII white space, which the tokenizer never joins across; its words with
    such characters are encoded whole.
    """
    cut: list[list[str | bytes]] = []
    for text in map(bytes.decode, texts):
        if _simple(text):
            cut.append(PARTS.findall(text.lower()))
        else:
            words = map(bytes.decode, text.encode().split())
            cut.append([p for w in words for p in (PARTS.findall(w.lower()) if _simple(w) else [cache.whole(w)])])
    end, ids = END.to_bytes(4, "little"), [list(map(cache.known.get, parts)) for parts in cut]
    new = {p for parts, got in zip(cut, ids, strict=True) if None in got for p, g in zip(parts, got, strict=True) if g is None and isinstance(p, str)}
    cache.learn(new)
    for parts, got in zip(cut, ids, strict=True):
        if None in got:
            got = [g if g is not None else p if isinstance(p, bytes) else cache.known[p] for p, g in zip(parts, got, strict=True)]
        yield b"".join(got) + end


def pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32)``; only documents over ``capacity`` ids are cut. Null texts are empty: one id."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = cached_parts(tokenizer)
        for batch in (s for b in batches for s in sub_batches(b, "text", SLICE)):
            where, piece, start, length, crc = [], [], [], [], []
            for i, ids in enumerate(encoded(list(byte_values(batch.column(1))), cache)):
                for k in range(0, len(ids), 4 * capacity):
                    part = ids[k : k + 4 * capacity]
                    where.append(i)
                    piece.append(k // (4 * capacity))
                    start.append(k // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            keys = batch.column(0).take(pa.array(where, pa.int64()))
            yield pa.RecordBatch.from_arrays([keys, pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


class Packer:
    """Bounded-space online best fit: ``place(length)`` gives (bin, offset)."""

    def __init__(self, capacity: int = CAPACITY, open_bins: int = OPEN_BINS):
        self.capacity, self.open_bins = capacity, open_bins
        self.free, self.bins, self.open, self.made = 0, [[] for _ in range(capacity + 1)], 0, 0

    def _take(self, space: int) -> int:
        b = self.bins[space].pop()
        if not self.bins[space]:
            self.free &= ~(1 << space)
        return b

    def place(self, length: int) -> tuple[int, int]:
        if fits := self.free >> length:
            space = length + (fits & -fits).bit_length() - 1
            b = self._take(space)
            self.open -= 1
        else:
            b, space = self.made, self.capacity
            self.made += 1
            if self.open == self.open_bins and length < self.capacity:
                self._take((self.free & -self.free).bit_length() - 1)
                self.open -= 1
        if rest := space - length:
            self.bins[rest].append(b)
            self.free |= 1 << rest
            self.open += 1
        return b, self.capacity - space


def pack(cut: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, per_packer: int = PIECES_PER_PACKER) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to rows of :func:`pieces`, whose lengths are 1 to ``capacity``.

    Packers see their pieces in hash order, which mixes lengths. Ties and repeated rows are packed like any others;
    an empty table gives an empty result.
    """
    cut = checkpointed(cut)
    packers, names = max(1, -(-cut.count() // per_packer)), [*cut.columns, "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, base = Packer(capacity, open_bins), TaskContext.get().partitionId() << 33
        for batch in batches:
            at = [packer.place(n) for n in batch.column("length").to_pylist()]
            columns = [*batch.drop_columns(["dealt"]).columns, pa.array([base + b for b, _ in at], pa.int64()), pa.array([o for _, o in at], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema) + ", sequence_id long, offset long"
    dealt = cut.withColumn("dealt", F.xxhash64("doc_id", "piece", "ids_crc32")).repartition(packers, "dealt").sortWithinPartitions("dealt", "length")
    return dealt.mapInArrow(run, schema)


def packed(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER) -> DataFrame:
    """One row per piece of every row of ``docs``: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are the closing id alone. Only documents longer than a sequence are cut. Repeated rows and ids are
    packed each; an empty table gives no rows; other columns, whatever their names, aren't read.
    """
    return pack(pieces(docs, capacity, tokenizer), capacity)
