"""Acquisition folders: trial XML, raw frames, file inventories and scans."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from lamella.functions.scalars import xml_time

#: Fixed values of the folder format: a log, one XML file for each trial, a raw frame beside it.
LOG, XML, FRAME = "log.txt", r"^[0-9]{3}\.xml$", r"^([0-9]{3})-ccd\.dat$"
XML_SCHEMA = (
    "info struct<_type: string, _trial: string, _date: string, _time: string>, "
    "ccd struct<camera: struct<_frames: string, _serpix: string, _parpix: string, _typebytes: string, _type: string, transform: struct<_ax: string, _ay: string>>>"
)


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """``(path, length, modificationTime)`` of all files below ``root``; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length", "modificationTime")


def read_xml(spark: SparkSession, root: str) -> DataFrame:
    """``(dataset, xml)`` of every trial's XML file below ``root``; the dataset is the file's folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "[0-9][0-9][0-9].xml").load(root)
    return files.select(F.element_at(F.split("path", "/"), -2).alias("dataset"), F.decode("content", "UTF-8").alias("xml"))


def trial_meta(files: DataFrame) -> DataFrame:
    """``(dataset, trial, time, w, h, bytes, dtype, flip_x, flip_y)`` of single-frame snapshots.

    Broken XML, other types and more than one frame give no row; an absent transform flips nothing.
    """
    # the document is parsed by name, so a default namespace or other elements do no harm
    x = F.from_xml("xml", XML_SCHEMA, {"mode": "PERMISSIVE"})
    rows = files.where("xml is not null").select("dataset", x.alias("x")).select("dataset", F.col("x.info").alias("i"), F.col("x.ccd.camera").alias("c"))
    rows = rows.where((F.col("i._type") == "snapshot") & F.col("c").isNotNull() & (F.coalesce(F.col("c._frames").try_cast("int"), F.lit(1)) == 1))
    whole = lambda c: F.col(c).try_cast("int")
    flip = lambda c: F.coalesce(whole(c) < 0, F.lit(False))
    return rows.select(
        "dataset", F.col("i._trial").try_cast("long").alias("trial"), xml_time(F.coalesce("i._date", F.lit("")), F.coalesce("i._time", F.lit(""))).alias("time"),
        whole("c._serpix").alias("w"), whole("c._parpix").alias("h"), whole("c._typebytes").alias("bytes"), F.col("c._type").alias("dtype"),
        flip("c.transform._ax").alias("flip_x"), flip("c.transform._ay").alias("flip_y"),
    ).where("trial is not null and w is not null and h is not null and bytes is not null")


def frame_files(files: DataFrame) -> DataFrame:
    """``(dataset, trial, length, path)`` of the raw frames in a listing."""
    name, folder = F.element_at(F.split("path", "/"), -1), F.element_at(F.split("path", "/"), -2)
    return files.select(folder.alias("dataset"), F.regexp_extract(name, FRAME, 1).try_cast("long").alias("trial"), "length", "path").where("trial is not null")


def inventory(meta: DataFrame, frames: DataFrame) -> DataFrame:
    """Trials whose frame file is there and as long as the XML says; nothing is left out by number or shape."""
    return meta.join(frames.select("dataset", "trial", "length"), ["dataset", "trial"]).where("length = w * h * bytes").drop("length")


def readable(entries: DataFrame, meta: DataFrame) -> DataFrame:
    """Per dataset the trials that the log calls snapshots, those that have a frame, and those in both sets."""
    a = entries.where("type = 'Snapshot'").select("dataset", "trial", F.lit(1).alias("logged")).distinct()
    both = a.join(meta.select("dataset", "trial", F.lit(1).alias("framed")).distinct(), ["dataset", "trial"], "full")
    return both.groupBy("dataset").agg(F.count("logged").alias("n_logged"), F.count("framed").alias("n_framed"), F.count(F.col("logged") + F.col("framed")).alias("n_both"))


def mixed_shapes(meta: DataFrame) -> DataFrame:
    """S3: datasets whose frames have more than one shape, which a stack refuses, with the number of shapes."""
    return meta.groupBy("dataset").agg(F.countDistinct("w", "h").alias("n_shapes")).where("n_shapes > 1")


def missing_frames(wanted: DataFrame, meta: DataFrame) -> DataFrame:
    """S3: wanted trials without a frame."""
    return wanted.select("dataset", "trial").distinct().join(meta, ["dataset", "trial"], "left_anti")


@F.arrow_udf(ArrayType(FloatType()))
def _decoded(px: pa.Array, w: pa.Array, h: pa.Array, flip_x: pa.Array, flip_y: pa.Array) -> pa.Array:
    out = []
    for data, wide, high, fx, fy in zip(px.to_pylist(), *(c.to_pylist() for c in (w, h, flip_x, flip_y)), strict=True):
        if data is None:
            out.append(None)
            continue
        frame = np.frombuffer(data, "<u2").reshape(high, wide)
        out.append(frame[:: -1 if fy else 1, :: -1 if fx else 1].astype(np.float32).ravel())
    return pa.array(out, pa.list_(pa.float32()))


def load_frames(meta: DataFrame, raw: DataFrame) -> DataFrame:
    """S3: ``(dataset, trial, w, h, px, refused)``: raw little-endian 16-bit frames (``px`` binary) as floats, flipped as the XML says.

    Another pixel type or a size that isn't w * h gives no pixels and a reason.
    """
    rows = meta.join(raw.select("dataset", "trial", F.col("px").alias("raw")), ["dataset", "trial"])
    kind = (F.col("dtype") != "uint16") | (F.col("bytes") != 2) | F.col("dtype").isNull()
    wrong = F.coalesce(F.octet_length("raw") != 2 * F.col("w") * F.col("h"), F.lit(True))
    rows = rows.withColumn("refused", F.when(kind, "pixel_type").when(wrong, "size"))
    rows = rows.withColumn("raw", F.when(F.col("refused").isNull(), F.col("raw")))
    return rows.select("dataset", "trial", "w", "h", _decoded("raw", "w", "h", "flip_x", "flip_y").alias("px"), "refused")


def frame_notes(meta: DataFrame) -> DataFrame:
    """Which way up a dataset's frames are, from the flips of all its trials."""
    per = meta.groupBy("dataset").agg(*[f(c).alias(f"{k}_{c}") for c in ("flip_x", "flip_y") for k, f in (("all", F.bool_and), ("any", F.bool_or))])
    note = (
        F.when(F.expr("all_flip_x and all_flip_y"), "rotated").when(F.expr("not any_flip_x and not any_flip_y"), "raw")
        .when(F.expr("all_flip_x and not any_flip_y"), "mirrored_x").when(F.expr("all_flip_y and not any_flip_x"), "mirrored_y").otherwise("mixed")
    )
    return per.select("dataset", note.alias("note"))


def _looked_at(files: DataFrame, root: str, depth: int) -> DataFrame:
    """``(folder, n_xml, reason)`` of the folders that look like datasets and don't lie inside another; reason says why one can't be read."""
    parts = F.split(F.substring(F.col("path"), F.lit(len(root.rstrip("/")) + 2), F.length("path")), "/")
    full = F.col("length") > 0 if "length" in files.columns else F.lit(True)
    rows = files.where(F.col("path").startswith(root.rstrip("/") + "/")).select(parts.alias("parts"), full.alias("full"))
    rows = rows.select(F.element_at("parts", -1).alias("name"), F.slice("parts", 1, F.size("parts") - 1).alias("dirs"), "full")
    rows = rows.where((F.size("dirs") < depth) & ~F.exists("dirs", lambda d: d.rlike(r"^[.$]")))
    log, xml = F.col("name") == LOG, F.col("name").rlike(XML)
    found = rows.groupBy("dirs").agg(F.count_if(log).alias("n_log"), F.count_if(xml).alias("n_xml"), F.count_if(log & F.col("full")).alias("full_log"), F.count_if(xml & F.col("full")).alias("full_xml")).where("n_log > 0 and n_xml > 0")
    join = lambda c: F.array_join(c, "/")
    above = F.transform(F.sequence(F.lit(0), F.size("dirs") - 1), lambda k: F.array_join(F.slice("dirs", F.lit(1), k), "/"))
    inner = found.where(F.size("dirs") > 0).select(join("dirs").alias("folder"), F.explode(above).alias("parent"))
    reason = F.when(F.col("full_log") == 0, "the log is empty").when(F.col("full_xml") == 0, "no trial can be read")
    tops = found.select(join("dirs").alias("folder"), "n_xml", reason.alias("reason"))
    nested = inner.join(tops.select(F.col("folder").alias("parent")), "parent", "left_semi").select("folder")
    return tops.join(nested, "folder", "left_anti")


def scan(files: DataFrame, root: str, depth: int = 3) -> DataFrame:
    """``(folder, n_xml)`` of the datasets in a listing (columns ``path`` and, if known, ``length``), folders relative to ``root``.

    A folder with a log and an XML file of a trial is a dataset; what lies inside a dataset, deeper than ``depth``
    levels or below a folder whose name begins with a dot or dollar sign isn't looked at.
    """
    return _looked_at(files, root, depth).where("reason is null").select("folder", "n_xml")


def skipped_folders(files: DataFrame, root: str, depth: int = 3) -> DataFrame:
    """``(folder, reason)`` of the folders that :func:`scan` takes for datasets but that can't be read."""
    return _looked_at(files, root, depth).where("reason is not null").select("folder", "reason")
