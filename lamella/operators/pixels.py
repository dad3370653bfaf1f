"""Work on small frames held as arrays: statistics over frames, exposure and gains, tone, colour, sub-pixel peaks, composites.

A frame is ``(frame, grp, px)`` with px an array of ``side * side`` doubles, row-major. Null frames give no pixels.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamella.operators.blocks import frame_statistics, median_blocks

SIDE = 8
#: Side of a canvas block, and the canvas pixels that a task holds before it sends its sums.
BLOCK, HELD = 32, 4 << 20


def pixel_statistics(frames: DataFrame, side: int = SIDE) -> DataFrame:
    """Median, largest and standard deviation of each pixel over the frames of a group; pieces of frames travel, not pixels."""
    cut = frame_statistics(frames, side * side)
    rows = cut.select("grp", "first", F.posexplode(F.arrays_zip("median", "largest", "deviation")).alias("k", "s"))
    return rows.select("grp", (F.col("first") + F.col("k")).alias("pixel"), *[F.round(f"s.{c}", 6).alias(n) for c, n in (("median", "median_px"), ("largest", "max_px"), ("deviation", "std_px"))])


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value computed once however often it is used."""
    return F.transform(F.array(value), use)[0]


def percentile_of(values: Column, share: float) -> Column:
    """The linear percentile of an array of numbers; null if it is empty."""

    def of(s: Column) -> Column:
        at = F.lit(share) * (F.size(s) - 1)
        low, high = F.try_element_at(s, (F.floor(at) + 1).cast("int")), F.try_element_at(s, (F.ceil(at) + 1).cast("int"))
        return F.when(F.size(s) > 0, low + (high - low) * (at - F.floor(at)))

    return _once(F.array_sort(values), of)


def flat_corrected(px: Column, flat: Column, level: float) -> Column:
    """Pixels over the flat field's, at least 0.001, scaled so that their median is the dataset's ``level``."""
    over = F.zip_with(px, flat, lambda v, f: v / F.greatest(f, F.lit(1e-3)))
    return _once(over, lambda c: _once(F.lit(level) / F.greatest(percentile_of(c, 0.5), F.lit(1e-3)), lambda g: F.transform(c, lambda v: v * g)))


def exposure(frames: DataFrame, floor: float = 0.05, share: float = 0.01) -> DataFrame:
    """60th percentile of a frame's pixels above ``floor``, or 0 where at most ``share`` of them are. No row leaves its task."""
    lit = F.filter("px", lambda v: v > floor)
    level = F.when(F.size(lit) > share * F.size("px"), percentile_of(lit, 0.6)).otherwise(0.0)
    return frames.where(F.size("px") > 0).select("frame", "grp", F.round(level, 6).alias("level"))


def gains(levels: DataFrame, low: float = 0.4, high: float = 2.5) -> DataFrame:
    """Per frame ``(frame, grp, level)`` the group's median level over its own, clipped; 1 for frames without a level."""
    real = F.when(F.col("level") > 1e-3, F.col("level"))
    ref = levels.groupBy("grp").agg(F.median(real).alias("ref"))
    gain = F.coalesce(F.greatest(F.lit(low), F.least(F.lit(high), F.col("ref") / real)), F.lit(1.0))
    return levels.join(ref, "grp").select("frame", "grp", F.round(gain, 6).alias("gain"))


def tone(frames: DataFrame, most: int = 96, shares: tuple[float, float] = (0.005, 0.996)) -> DataFrame:
    """One window per group: the level (median of the frames' medians) and two percentiles of the pixels over up to ``most`` evenly spaced frames.

    A window without width is ``degenerate``. Equal values are counted together before they are ranked.
    """
    i = F.row_number().over(Window.partitionBy("grp").orderBy("frame")) - 1
    rows = frames.where(F.size("px") > 0).select("grp", "frame", "px", i.alias("i"), F.count("*").over(Window.partitionBy("grp")).alias("n"))
    stride = F.greatest(F.lit(1), F.floor(F.col("n") / most))
    rows = rows.where((F.col("i") % stride == 0) & (F.col("i") / stride < most))
    level = rows.groupBy("grp").agg(F.median(percentile_of(F.col("px"), 0.5)).alias("level"), F.count("*").alias("n_sample"))
    values = rows.select("grp", F.explode("px").alias("v")).groupBy("grp", "v").agg(F.count("*").alias("k"))
    window = values.groupBy("grp").agg(*[F.percentile("v", s, F.col("k")).alias(name) for name, s in zip(("lo", "hi"), shares, strict=True)])
    return level.join(window, "grp").select("grp", F.round("level", 6).alias("level"), "n_sample", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"), (F.col("hi") <= F.col("lo")).alias("degenerate"))


def colour_evidence(frames: DataFrame, least: float = 12.0, share: float = 0.98, enough: int = 64) -> DataFrame:
    """``(video, n_frames, n_px, cb, cg, cr)``: the mean unit colour of lit pixels of frames ``(video, frame, bgr)``, bgr an array of three-number arrays.

    Lit are pixels whose largest channel is at least the frame's 98th percentile of it and ``least``; a frame with fewer
    than ``enough`` of them has no vote. Each frame is one row of partial sums.
    """
    top = lambda p: F.greatest(p[0], p[1], p[2])
    cut = F.greatest(percentile_of(F.transform("bgr", top), share), F.lit(least))
    rows = frames.where(F.size("bgr") > 0).withColumn("lit", _once(cut, lambda c: F.filter("bgr", lambda p: top(p) >= c)))
    norm = lambda p: F.greatest(F.sqrt(p[0] * p[0] + p[1] * p[1] + p[2] * p[2]), F.lit(1e-6))
    total = lambda lit, k: F.aggregate(lit, F.lit(0.0), lambda s, p: s + p[k] / norm(p))
    sums = lambda lit: F.struct(F.size(lit).alias("n"), *[total(lit, k).alias(c) for k, c in enumerate("bgr")])
    rows = rows.select("video", _once(F.col("lit"), sums).alias("s")).select("video", "s.*").where(F.col("n") >= enough)
    rows = rows.groupBy("video").agg(F.count("*").alias("n_frames"), F.sum("n").alias("n_px"), *[F.sum(c).alias(c) for c in "bgr"])
    return rows.select("video", "n_frames", "n_px", *[(F.col(c) / F.col("n_px")).alias(f"c{c}") for c in "bgr"])


def peaks(frames: DataFrame, side: int = SIDE) -> DataFrame:
    """H6: brightest pixel (the first of equal ones) and its sub-pixel offsets along x and y by parabolas, at most half a pixel; null at the border."""
    top = F.array_position("px", F.array_max("px")) - 1
    rows = frames.select("frame", "px", top.alias("pixel")).where("pixel >= 0")
    value = lambda k: F.get("px", (F.col("pixel") + k).cast("int"))

    def offset(step: int, place: Column) -> Column:
        before, mid, after = value(-step), value(0), value(step)
        bend = before - 2 * mid + after
        return F.round(F.when((place > 0) & (place < side - 1) & (bend < 0), F.greatest(F.lit(-0.5), F.least(F.lit(0.5), 0.5 * (before - after) / bend))), 6)

    return rows.select("frame", "pixel", offset(1, F.col("pixel") % side).alias("subpixel"), offset(side, F.floor(F.col("pixel") / side)).alias("subpixel_y"))


def _summed(block: int, rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """Sums of ``(grp, bx, by, x, y, w v, w, n)`` pieces, pictures at a place of a block, in as few rows as fit."""
    held: dict[tuple, np.ndarray] = {}

    def flush() -> pa.RecordBatch:
        keys = list(held)
        cols = [pa.array([k[i] for k in keys], pa.int64()) for i in range(3)]
        planes = [pa.array([held[k][p].ravel() for k in keys], pa.list_(pa.float64())) for p in range(3)]
        held.clear()
        return pa.RecordBatch.from_arrays([*cols, *planes], names=["grp", "bx", "by", "acc", "wsum", "n"])

    for key, x, y, planes in rows:
        if key not in held:
            if len(held) * block * block >= HELD:
                yield flush()
            held[key] = np.zeros((3, block, block))
        h, w = planes.shape[1:]
        held[key][:, y : y + h, x : x + w] += planes
    if held:
        yield flush()


def blocks(frames: DataFrame, side: int = SIDE, block: int = BLOCK) -> DataFrame:
    """Canvas blocks ``(grp, bx, by, acc, wsum, n)`` of frames at ``(x, y)``: weighted pixels, weights and covering frames, as arrays.

    The weight is a tent of at least 0.001. Tasks add up whole blocks before they send them, and again where they meet.
    """
    tent = np.minimum(np.arange(1, side + 1), np.arange(side, 0, -1)) / (side / 2)
    weight = np.maximum(0.001, np.outer(tent, tent))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pieces() -> Iterator[tuple]:
            for batch in batches:
                for grp, x, y, px in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    v = np.array(px).reshape(side, side)
                    planes = np.stack((weight * v, weight, np.ones_like(v)))
                    for by in range(y // block, (y + side - 1) // block + 1):
                        for bx in range(x // block, (x + side - 1) // block + 1):
                            x0, y0 = max(x, bx * block), max(y, by * block)
                            x1, y1 = min(x + side, (bx + 1) * block), min(y + side, (by + 1) * block)
                            yield (grp, bx, by), x0 - bx * block, y0 - by * block, planes[:, y0 - y : y1 - y, x0 - x : x1 - x]

        return _summed(block, pieces())

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks come in order, so one is held at a time."""
        key, total = None, None
        for batch in batches:
            for *k, acc, wsum, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                planes = np.array((acc, wsum, n))
                if k == key:
                    total += planes
                    continue
                if key is not None:
                    yield from _summed(block, iter([(tuple(key), 0, 0, total.reshape(3, block, block))]))
                key, total = k, planes
        if key is not None:
            yield from _summed(block, iter([(tuple(key), 0, 0, total.reshape(3, block, block))]))

    schema = "grp long, bx long, by long, acc array<double>, wsum array<double>, n array<double>"
    own = frames.where(F.size("px") == side * side).select("grp", F.col("x").cast("long"), F.col("y").cast("long"), "px")
    parts = own.mapInArrow(place, schema).repartition("grp", "bx", "by").sortWithinPartitions("grp", "bx", "by")
    return parts.mapInArrow(merge, schema)


def composite(frames: DataFrame, side: int = SIDE, block: int = BLOCK) -> DataFrame:
    """The blended picture ``(grp, cx, cy, px, n)``: sum(w v) / sum(w) of the frames over a canvas pixel and their number."""
    rows = blocks(frames, side, block).select("grp", "bx", "by", F.posexplode(F.arrays_zip("acc", "wsum", "n")).alias("i", "c")).where("c.n > 0")
    return rows.select(
        "grp", (F.col("bx") * block + F.col("i") % block).alias("cx"), (F.col("by") * block + F.floor(F.col("i") / block)).alias("cy"), F.round(F.col("c.acc") / F.col("c.wsum"), 6).alias("px"), F.col("c.n").cast("long").alias("n")
    )


def median_composite(frames: DataFrame, side: int = SIDE, block: int = BLOCK) -> DataFrame:
    """The median of the frames over each canvas pixel, without those that don't cover it; pieces of frames travel, not pixels."""
    rows = median_blocks(frames, side, block).select("grp", "bx", "by", F.posexplode("px").alias("i", "px")).where(~F.isnan("px"))
    return rows.select("grp", (F.col("bx") * block + F.col("i") % block).alias("cx"), (F.col("by") * block + F.floor(F.col("i") / block)).alias("cy"), F.round("px", 6).alias("px"))


def write_canvas(frames: DataFrame, path: str, side: int = SIDE, block: int = BLOCK) -> None:
    """The canvas as Parquet blocks ``(bx, by, px, covered)`` of each group; pixels that nothing covers are 0."""
    rows = blocks(frames, side, block)
    px = F.zip_with("acc", "wsum", lambda a, w: F.when(w > 0, a / w).otherwise(0.0))
    rows.select("grp", "bx", "by", px.alias("px"), F.transform("n", lambda n: n > 0).alias("covered")).write.partitionBy("grp").parquet(path)
