"""WARC archives (operator 8): writing, and reading by boundary-chain verification.

Archives are written by Spark's text writer: the record separator of the format is the writer's line separator. When
they are read, tasks look for the magic of a record anywhere and emit ``(file, offset, successor)`` for everything
that parses as a record head, payloads that quote records included. Pointer jumping from the start of each file keeps
only what the chain of successors reaches, in as many rounds as the logarithm of the records of a file.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.plans.session import bounded, checkpointed, forget_path, saved, scratch, small_batches

MAGIC = b"WARC/1."
END = b"\r\n\r\n"
LEAST_PAYLOAD = 100
#: Fixed value of the format: how a revisit is alike.
PROFILE = "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of records after which a file is closed; a longer record has a file of its own.
FILE_BYTES = 64 << 20
#: Digests of repeated payloads that may be broadcast.
REPEATED = 500_000
HEAD = re.compile(rb"WARC/1\.[01]\r\n((?:[^\s:]+:[^\r\n]*\r\n(?:[ \t][^\r\n]*\r\n)*)+)\r\n")
FOLD = re.compile(rb"\r\n[ \t]+")


def records(pages: DataFrame) -> DataFrame:
    """``(record, page_id, payload_bytes, payload_digest, record_type, refers_to)``: a record without its closing separator per row.

    Of pages with equal payloads of at least 100 bytes the one with the smallest page_id is the response and the others
    revisit it; smaller ones are responses. Null html is an empty payload. Rows that repeat the smallest id are all
    responses; a null id is never the smallest unless all are null (then all are responses). Line ends in a url become
    spaces. Other columns are not read.
    """
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", F.regexp_replace(F.coalesce("url", F.lit("")), "[\r\n]", " ").alias("url"), html.alias("html"), F.octet_length(html).cast("long").alias("n"), F.sha2(html, 256).alias("digest"))
    firsts = rows.where(F.col("n") >= LEAST_PAYLOAD).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("copies")).where("copies > 1 and first is not null")
    rows = rows.join(bounded(firsts.select("digest", "first"), REPEATED), "digest", "left")
    revisit = F.coalesce((F.col("n") >= LEAST_PAYLOAD) & ~F.col("page_id").eqNullSafe(F.col("first")) & F.col("first").isNotNull(), F.lit(False))
    kind, body = F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")), F.when(revisit, F.lit("")).otherwise(F.col("html"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">\r\n"))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), kind, F.lit("\r\nWARC-Record-ID: "), urn(F.col("page_id")), F.lit("WARC-Date: 1970-01-01T00:00:00Z\r\nWARC-Target-URI: "), F.col("url"),
        F.lit("\r\nWARC-Payload-Digest: sha256:"), F.col("digest"), F.lit("\r\nWARC-Payload-Length: "), F.col("n").cast("string"), F.lit("\r\n"),
        F.when(revisit, F.concat(F.lit(PROFILE), F.lit("\r\nWARC-Refers-To: "), urn(F.col("first")))).otherwise(F.lit("")),
        F.lit("Content-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
    )
    return rows.select(F.concat(head, body).alias("record"))


def _in_files(file_bytes: int):
    """Records with the number of their file in their task: the running sum of their bytes decides."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = 0
        for b in batches:
            size = pc.add(pc.binary_length(b.column(0)), len(END)).to_numpy(zero_copy_only=False).astype(np.int64)
            upto = before + np.cumsum(size)
            file = (upto - size) // file_bytes
            before += int(size.sum())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(file)], names=["record", "file"])

    return number


def write(pages: DataFrame, path: str, file_bytes: int = FILE_BYTES) -> None:
    """Gzip-compressed archives of about ``file_bytes`` each, or of one longer record, in folders below ``path``."""
    small_batches(pages.sparkSession)
    dealt = records(pages).mapInArrow(_in_files(file_bytes), "record string, file long")
    dealt.write.partitionBy("file").option("lineSep", END.decode()).option("compression", "gzip").text(path)


def _parsed(data: bytes, at: int) -> tuple | None:
    """What the record head at ``at`` says, or None if there is none."""
    if (m := HEAD.match(data, at)) is None:
        return None
    lines = (line.split(b":", 1) for line in FOLD.sub(b" ", m[1]).split(b"\r\n")[:-1])
    fields = {name.lower(): value.strip(b" \t") for name, value in lines}
    size = fields.get(b"content-length", b"")
    if not size.isdigit():
        return None
    end = m.end() + int(size)
    if data[end : end + len(END)] != END:
        return None
    page = lambda x: x.decode("utf-8", "replace")
    kind, body = fields.get(b"warc-type", b"").decode(), data[m.end() : end]
    refers = page(fields[b"warc-refers-to"]) if b"warc-refers-to" in fields else None
    digest, n = hashlib.sha256(body).hexdigest(), len(body)
    if kind == "revisit":  # the payload is in the record referred to
        digest, n = fields.get(b"warc-payload-digest", b"").decode().removeprefix("sha256:"), int(fields.get(b"warc-payload-length", b"0"))
    return end + len(END), page(fields.get(b"warc-record-id", b"")), n, digest, kind, refers


def inflated(data: bytes) -> bytes:
    """All gzip members of ``data``, one after another."""
    parts = []
    while data:
        member = zlib.decompressobj(31)
        parts.append(member.decompress(data))
        if not member.eof:
            raise ValueError("a gzip member is cut short")
        data = member.unused_data
    return b"".join(parts)


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """Everything in the archives below ``path`` that parses as a record, whether it is one or a payload quotes it.

    A row without ``next`` tells where each file ends.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data, rows, at = content.as_py(), [], 0
                if data[:2] == b"\x1f\x8b":
                    data = inflated(data)
                while (at := data.find(MAGIC, at)) >= 0:
                    if got := _parsed(data, at):
                        rows.append((file, at, *got))
                    at += len(MAGIC)
                rows.append((file, len(data), *[None] * 6))
                types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), *[pa.string()] * 3]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["file", "at", "next", "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInArrow(scan, "file string, at long, next long, page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string")


def reachable(links: DataFrame) -> DataFrame:
    """``(file, at)`` of the links ``(file, at, next)`` on the chain from offset 0 of each file, ends included, by pointer jumping.

    The links of a file meet in one task, as its bytes have; an offset has one successor, which lies behind it.
    """

    def chain(rows: pa.Table) -> pa.Table:
        at, onward = (rows.column(c).to_numpy() for c in ("at", "next"))
        offsets = np.unique(np.concatenate((at, onward)))
        jumps = np.arange(len(offsets))
        jumps[np.searchsorted(offsets, at)] = np.searchsorted(offsets, onward)
        reached = np.isin(offsets, at[at == 0])
        while True:
            # everything reached also reaches its successor 2^k records on; then jumps double
            reached[jumps[reached]] = True
            if np.array_equal(jumps, beyond := jumps[jumps]):
                break
            jumps = beyond
        there = offsets[reached]
        return pa.table({"file": pa.array([rows.column("file")[0].as_py()] * len(there), pa.string()), "at": pa.array(there, pa.int64())})

    return checkpointed(links.select("file", "at", "next").groupBy("file").applyInArrow(chain, "file string, at long"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of the archives below ``path``: file, at, next, page_id, payload_bytes, payload_digest, record_type, refers_to.

    Digests and lengths of responses are taken from the bytes read; revisits carry those of the payload they refer to.
    A file whose chain of records does not end where the file does is an error, and so is a record whose id isn't a page's.
    """
    found = checkpointed(candidates(spark, path))
    links = found.where("next is not null")
    reached = reachable(links)
    broken = found.where("next is null and at > 0").join(reached, ["file", "at"], "left_anti").select("file").first()
    if broken:
        raise ValueError(f"the records of {broken['file']} do not lead to its end")
    rows = links.join(reached, ["file", "at"], "left_semi")
    return rows.withColumns({c: _page(c) for c in ("page_id", "refers_to")})


def _page(urn: str) -> Column:
    """The page's number in a record's id: null for ``null`` and where there is no id; any other id is an error."""
    number = F.regexp_extract(urn, "^<urn:page:(null|-?[0-9]+)>$", 1)
    wrong = F.raise_error(F.concat(F.lit("a record has the id "), F.col(urn)))
    return F.when(F.col(urn).isNull() | (F.col(urn) == "") | (number == "null"), F.lit(None).cast("long")).when(number == "", wrong.cast("long")).otherwise(number.cast("long"))


def written_and_read(pages: DataFrame) -> DataFrame:
    """Every page as its record in an archive in the shared folder says."""
    path = scratch(pages.sparkSession, "warc")
    write(pages, path)
    out = saved(read(pages.sparkSession, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"), "records")
    forget_path(pages.sparkSession, path)
    return out
