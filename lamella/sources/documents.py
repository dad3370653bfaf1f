"""Tile documents, ground truth, electrode maps, regions and keyframe tables as files and rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.functions.scalars import csv_field, electrode_id, xy_pair

TILE = "struct<status: string, state: string, x: double, y: double, r: double, machine: array<string>, ncc: double, margin: double>"
DOCUMENT = f"tiles map<string, {TILE}>, tolerance_px struct<region_default: double>"
KEY = "^(0|[1-9][0-9]*)$"
#: The header lines of the region and electrode tables.
REGION_HEADER = "region_id,name,video,status,placed_by,x,y,w,h,scale,still_kind,ncc,margin,confident,n_electrodes,electrode_ids"
ELECTRODE_HEADER = ("electrode", "col", "row", "x", "y", "x_um", "y_um", "kind", "coverage")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """``(dataset, json)`` of each document below ``path``, a file each; the dataset is the file's name without its ending."""
    files = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+?)\.[^/.]*$", 1).alias("dataset"), F.col("value").alias("json"))
    return files


def tile_rows(documents: DataFrame) -> DataFrame:
    """``(dataset, trial, status, state, x, y, r, mx, my, ncc, margin)`` of the tile maps of ``(dataset, json)``.

    Keys that aren't unpadded decimals give no row, nor do documents that can't be read; half-written machine pairs are null.
    """
    doc = documents.select("dataset", F.from_json("json", DOCUMENT).alias("d"))
    rows = doc.select("dataset", F.col("d.tolerance_px.region_default").alias("default"), F.explode("d.tiles").alias("key", "t")).where(F.col("key").rlike(KEY) & F.col("t").isNotNull())
    m = xy_pair(F.col("t.machine"))
    return rows.select("dataset", F.col("key").cast("long").alias("trial"), "t.status", "t.state", "t.x", "t.y", F.coalesce("t.r", "default").alias("r"), m["x"].alias("mx"), m["y"].alias("my"), "t.ncc", "t.margin")


def truth_rows(documents: DataFrame) -> DataFrame:
    """The anchors with a position, whose radius falls back on the document's default."""
    return tile_rows(documents).where("status = 'anchor' AND x IS NOT NULL AND y IS NOT NULL").select("dataset", "trial", "x", "y", "r")


def truth_documents(tiles: DataFrame, default: float | None) -> DataFrame:
    """``(dataset, n_anchors, json)``, documents that :func:`truth_rows` reads; no anchors are worth a warning, not an error.

    A missing default radius is refused, and so is an anchor without position.
    """
    if default is None:
        raise ValueError("a truth needs a default radius")
    bad = (F.col("status") == "anchor") & (F.col("x").isNull() | F.col("y").isNull())
    checked = F.when(bad, F.raise_error(F.lit("an anchor has no position")).cast("string")).otherwise(F.col("trial").cast("string"))
    one = F.struct(checked.alias("key"), F.struct("status", "x", "y", "r").alias("value"))
    return tiles.groupBy("dataset").agg(F.count_if(F.col("status") == "anchor").alias("n_anchors"), F.map_from_entries(F.collect_list(one)).alias("tiles")).select(
        "dataset", "n_anchors", F.to_json(F.struct("tiles", F.struct(F.lit(float(default)).alias("region_default")).alias("tolerance_px"))).alias("json")
    )


def electrode_rows(electrodes: DataFrame, coverage: str = "partial", offset: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """The electrode table; the offset moves pixels only; micrometres are blank without a device; coverage is on every row."""
    at = lambda c, o: F.round(F.col(c) + o, 2).alias(c)
    um = [F.col(c) if c in electrodes.columns else F.lit(None).cast("double").alias(c) for c in ("x_um", "y_um")]
    kind = F.when(F.col("kind") == 1, "detected").otherwise("inferred").alias("kind")
    return electrodes.select("mosaic", electrode_id(F.col("col"), F.col("row")).alias("electrode"), "col", "row", at("x", offset[0]), at("y", offset[1]), *um, kind, F.lit(coverage).alias("coverage"))


def electrode_payload(electrodes: DataFrame, **options) -> DataFrame:
    """``(mosaic, json)``, cells as parallel arrays ordered by row, then column; a mosaic has as many cells as its chip."""
    rows = electrode_rows(electrodes, **options).withColumn("code", F.when(F.col("kind") == "detected", 1).otherwise(2))
    cells = F.array_sort(F.collect_list(F.struct("row", "col", "x", "y", "code")))
    arrays = F.struct(*[F.col(f"cells.{k}").alias(n) for n, k in (("col", "col"), ("row", "row"), ("x", "x"), ("y", "y"), ("kind", "code"))])
    return rows.groupBy("mosaic").agg(cells.alias("cells"), F.first("coverage").alias("array_coverage")).select("mosaic", F.to_json(F.struct(arrays.alias("cells"), "array_coverage")).alias("json"))


def write_electrodes(electrodes: DataFrame, path: str, **options) -> None:
    """A folder for each mosaic with its table in row order."""
    rows = electrode_rows(electrodes, **options)
    rows.repartition("mosaic").sortWithinPartitions("mosaic", "row", "col").select("mosaic", *ELECTRODE_HEADER).write.partitionBy("mosaic").option("header", True).csv(path)


def current_maps(files: DataFrame, recorded: DataFrame) -> DataFrame:
    """Of each mosaic's map files ``(mosaic, path, modified)`` the recorded one ``(mosaic, path)``, else the newest (ties by path)."""
    named = files.join(recorded.select("mosaic", "path").distinct().withColumn("named", F.lit(1)), ["mosaic", "path"], "left")
    best = F.max(F.struct(F.col("named").isNotNull().alias("named"), "modified", "path")).alias("best")
    return named.groupBy("mosaic").agg(best).select("mosaic", F.col("best.path").alias("path"), F.col("best.named").alias("recorded"))


def region_lines(regions: DataFrame) -> DataFrame:
    """A CSV line for each region ``(region, name, video, status, placed_by, x, y, w, h, scale, still_kind, ncc, margin, confident, n, ids)``."""
    fixed = lambda c, n: F.format_string(f"%.{n}f", F.coalesce(F.col(c).cast("double"), F.lit(0.0)))
    blank = lambda c, n: F.coalesce(F.format_string(f"%.{n}f", F.col(c)), F.lit("")) if n else F.coalesce(F.col(c).cast("string"), F.lit(""))
    measured = lambda c: F.when(F.col(c).isNull(), "").otherwise(blank(c, 4))
    line = F.concat_ws(
        ",", blank("region", 0), csv_field(F.col("name")), csv_field(F.col("video")), blank("status", 0), blank("placed_by", 0), *(fixed(c, 2) for c in "xywh"), fixed("scale", 6), blank("still_kind", 0),
        measured("ncc"), measured("margin"), F.when(F.col("confident"), "true").otherwise("false"), blank("n", 0), csv_field(F.col("ids")),
    )
    return regions.select("region", line.alias("line"))


def keyframe_rows(keyframes: DataFrame, origins: DataFrame) -> DataFrame:
    """The keyframe table, positions from the canvas origin ``(video, ox, oy)`` to two decimals, null where unplaced."""
    at = lambda c, o: F.round(F.when(F.col("placed"), F.col(c) - F.col(o)), 2)
    rows = keyframes.join(origins, "video", "left")
    return rows.select("video", "keyframe", F.col("frame").alias("video_frame"), at("x", "ox").alias("x_px"), at("y", "oy").alias("y_px"), "segment", "reason", "placed")


def chosen_frames(frames: DataFrame, wanted: DataFrame) -> DataFrame:
    """The frames asked for ``(video, frame)``, each once; those that aren't there shorten the result."""
    return frames.join(wanted.select("video", "frame").distinct(), ["video", "frame"], "left_semi")


def merged_summaries(table: DataFrame, new: DataFrame, key: str = "mosaic") -> DataFrame:
    """Rows of ``new`` in place of those with their key, all others as they are."""
    return table.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def pair_text(x: Column, y: Column) -> Column:
    """A position as the pair of texts that documents hold."""
    return F.array(x.cast("string"), y.cast("string"))
