"""Media columns (operator 2): ISO base media containers in a binary column.

``store`` writes a payload as the 64-byte samples of a raw 8-bit sound track, with complete sample tables. ``probe``
walks the nested boxes of any such container, decodes the sample tables and gives codec, duration and the byte ranges
of key frames; payload bytes are located, never decoded.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lamella.llm.arrow import byte_values, sub_batches
from lamella.plans.session import saved, settled, small_batches

UNIT = 64
TIMESCALE = 8000
CHUNK_SAMPLES = 256
KEY_EVERY = 16
NESTED = (b"moov", b"trak", b"mdia", b"minf", b"stbl")
MATRIX = struct.pack(">9i", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
SLICE = 8 << 20


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def _full(kind: bytes, *parts: bytes) -> bytes:
    return _box(kind, bytes(4), *parts)


def padded(data: bytes) -> bytes:
    """``data`` with zero bytes up to a positive multiple of the unit."""
    return data + bytes(-len(data) % UNIT if data else UNIT)


def container(payload: bytes) -> bytes:
    """A container whose only track holds ``payload``, a positive multiple of 64 bytes; equal payloads give equal bytes."""
    n = len(payload) // UNIT
    if n < 1 or len(payload) % UNIT:
        raise ValueError("the payload is not a positive multiple of the unit")
    chunks = -(-n // CHUNK_SAMPLES)
    runs = [(1, CHUNK_SAMPLES, 1)] if n >= CHUNK_SAMPLES else []
    if rest := n % CHUNK_SAMPLES:
        runs.append((chunks, rest, 1))
    keys = np.arange(1, n + 1, KEY_EVERY, dtype=">u4")
    entry = _box(b"raw ", bytes(6), struct.pack(">H8xHHHHI", 1, 1, 8, 0, 0, TIMESCALE << 16))
    head = _box(b"ftyp", b"isom", struct.pack(">I", 0x200), b"isom", b"mp41")

    def moov(first: int) -> bytes:
        at = first + np.arange(chunks, dtype=np.int64) * CHUNK_SAMPLES * UNIT
        wide = bool(first + len(payload) > 0xFFFFFFFF)
        table = _box(
            b"stbl",
            _full(b"stsd", struct.pack(">I", 1), entry),
            _full(b"stts", struct.pack(">III", 1, n, UNIT)),
            _full(b"stss", struct.pack(">I", len(keys)), keys.tobytes()),
            _full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
            _full(b"stsz", struct.pack(">II", UNIT, n)),
            _full(b"co64" if wide else b"stco", struct.pack(">I", chunks), at.astype(">u8" if wide else ">u4").tobytes()),
        )
        minf = _box(b"minf", _full(b"smhd", bytes(4)), _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _box(b"url ", b"\0\0\0\1"))), table)
        mdia = _box(b"mdia", _full(b"mdhd", struct.pack(">IIIIHH", 0, 0, TIMESCALE, n * UNIT, 0x55C4, 0)), _full(b"hdlr", bytes(4), b"soun", bytes(13)), minf)
        tkhd = _box(b"tkhd", b"\0\0\0\7", struct.pack(">IIIII8xHHHH", 0, 0, 1, 0, n * UNIT, 0, 0, 0x100, 0), MATRIX, bytes(8))
        mvhd = _full(b"mvhd", struct.pack(">IIIIIH10x", 0, 0, TIMESCALE, n * UNIT, 0x10000, 0x100), MATRIX, bytes(24), struct.pack(">I", 2))
        return _box(b"moov", mvhd, _box(b"trak", tkhd, mdia))

    long = len(payload) + 8 > 0xFFFFFFFF
    mdat = struct.pack(">I4sQ", 1, b"mdat", len(payload) + 16) if long else struct.pack(">I4s", len(payload) + 8, b"mdat")
    first = len(head) + len(moov(0)) + len(mdat)
    return b"".join((head, moov(first), mdat, payload))


def boxes(data: memoryview, begin: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """``(kind, begin, end)`` of the contents of each box; a box that leaves its parent is an error."""
    while begin < end:
        if end - begin < 8:
            raise ValueError("a box is cut off")
        size, kind = struct.unpack_from(">I4s", data, begin)
        head = 8
        if size == 1:
            size, head = struct.unpack_from(">Q", data, begin + 8)[0], 16
        elif size == 0:
            size = end - begin
        if size < head or begin + size > end:
            raise ValueError(f"box {kind!r} leaves its parent")
        yield kind, begin + head, begin + size
        begin += size


def _tracks(data: memoryview, begin: int, end: int, track: dict | None = None) -> Iterator[dict]:
    for kind, b, e in boxes(data, begin, end):
        if kind == b"trak":
            track = {}
            yield from _tracks(data, b, e, track)
            yield track
        elif kind in NESTED:
            yield from _tracks(data, b, e, track)
        elif track is not None:
            track[kind] = (b, e)


def _table(data: memoryview, box: tuple[int, int], kind: str, columns: int = 1, skip: int = 8) -> np.ndarray:
    """The entries of a full box whose count ends ``skip`` bytes after its start."""
    n = struct.unpack_from(">I", data, box[0] + skip - 4)[0]
    if box[0] + skip + n * columns * np.dtype(kind).itemsize > box[1]:
        raise ValueError("a table leaves its box")
    return np.frombuffer(data, kind, n * columns, box[0] + skip).astype(np.int64).reshape(n, columns)


class Track:
    """Sample tables of one track: codec, timescale, duration, and byte ranges of samples and key samples."""

    def __init__(self, data: memoryview, found: dict[bytes, tuple[int, int]]):
        b = found[b"mdhd"][0]
        self.timescale, self.duration = struct.unpack_from(">IQ", data, b + 20) if data[b] == 1 else struct.unpack_from(">II", data, b + 12)
        self.codec = bytes(data[found[b"stsd"][0] + 12 : found[b"stsd"][0] + 16]).decode("latin-1")
        b = found[b"stsz"][0]
        fixed, n = struct.unpack_from(">II", data, b + 4)
        self.sizes = np.full(n, fixed, np.int64) if fixed else _table(data, found[b"stsz"], ">u4", skip=12)[:, 0]
        chunks = (_table(data, found[b"co64"], ">u8") if b"co64" in found else _table(data, found[b"stco"], ">u4"))[:, 0]
        runs = _table(data, found[b"stsc"], ">u4", 3)
        per_chunk = np.repeat(runs[:, 1], np.diff(np.append(runs[:, 0], len(chunks) + 1)))
        if per_chunk.sum() != n:
            raise ValueError("chunks and samples don't agree")
        before = np.concatenate(([0], np.cumsum(self.sizes)))
        first = np.concatenate(([0], np.cumsum(per_chunk)))
        self.offsets = np.repeat(chunks - before[first[:-1]], per_chunk) + before[:-1]
        self.chunks = list(zip(chunks.tolist(), (before[first[1:]] - before[first[:-1]]).tolist(), strict=True))
        keys = _table(data, found[b"stss"], ">u4")[:, 0] - 1 if b"stss" in found else np.arange(n)
        self.key_offsets, self.key_sizes = self.offsets[keys], self.sizes[keys]

    def payload(self, data: memoryview) -> Iterator[memoryview]:
        for at, size in self.chunks:
            if at + size > len(data):
                raise ValueError("a sample lies outside the file")
            yield data[at : at + size]


def read(media: bytes) -> tuple[Track, memoryview]:
    """The only track of a container and its bytes."""
    data = memoryview(media)
    tracks = list(_tracks(data, 0, len(data)))
    if len(tracks) != 1:
        raise ValueError(f"{len(tracks)} tracks")
    return Track(data, tracks[0]), data


def store(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, n_bytes, media)`` per row: the UTF-8 text, padded, in a container. Null counts as empty: one zero unit."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (s for b in batches for s in sub_batches(b, "body", SLICE)):
            texts = list(byte_values(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, texts), pa.int64()), pa.array([container(padded(t)) for t in texts], pa.binary())], names=["key", "n_bytes", "media"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(docs[key].alias("key"), docs[text].alias("body")).mapInArrow(write, f"key {kind}, n_bytes long, media binary")
    return rows.withColumnRenamed("key", key)


PROBED = "codec string, timescale long, duration long, samples long, keyframes array<struct<offset: long, size: long>>, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string"


def probe(stored: DataFrame, keep: tuple[str, ...] = ("doc_id", "n_bytes")) -> DataFrame:
    """Per row ``keep`` and what the container in ``media`` says; a null container gives nulls, a broken one is an error."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (s for b in batches for s in sub_batches(b, "media", SLICE)):
            out = []
            for media, valid in zip(byte_values(batch.column(len(keep))), batch.column(len(keep)).is_valid().to_pylist(), strict=True):
                if not valid:
                    out.append(None)
                    continue
                track, data = read(media)
                digest, n, tail = hashlib.sha256(), 0, b""
                for part in track.payload(data):
                    digest.update(part)
                    n += len(part)
                    tail = (tail + bytes(part[-UNIT:]))[-UNIT:]
                keys = [{"offset": o, "size": s} for o, s in zip(track.key_offsets.tolist(), track.key_sizes.tolist(), strict=True)]
                out.append((track.codec, track.timescale, track.duration, len(track.sizes), keys, n, digest.hexdigest(), zlib.crc32(tail), len(media), hashlib.sha256(media).hexdigest()))
            columns = [pa.array([x and x[i] for x in out], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *columns], names=[*keep, *names])

    names = [c.split(" ", 1)[0] for c in PROBED.replace("struct<offset: long, size: long>", "").split(", ")]
    types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("offset", pa.int64()), ("size", pa.int64())])), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
    schema = ", ".join(f"{c} {stored.schema[c].dataType.simpleString()}" for c in keep)
    return stored.select(*keep, "media").mapInArrow(walk, f"{schema}, {PROBED}")


def stored_and_probed(docs: DataFrame) -> DataFrame:
    """Writes the media table in the shared folder, rereads it and probes every row; equal texts give equal values.

    Null texts are empty ones of one block of zeros; texts of any length are stored whole; repeated rows stay, each stored; an
    empty table gives no rows; other columns, whatever their names, aren't read.
    """
    small_batches(docs.sparkSession)
    stored = saved(store(docs), "media")
    return settled(probe(stored), "probed", stored)
