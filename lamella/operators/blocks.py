"""Pictures as tables of blocks: halo exchange, local maxima, blur, order statistics over frames, sums of windows.

A picture is rows ``(grp, bx, by, px)``: blocks of ``side * side`` numbers, row-major, at block places that may be missing.
Only whole blocks and their rims travel, never a pixel by itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamella.operators.pairing import kept_apart

#: Numbers that a task holds of one piece of a picture over all frames.
HELD = 4 << 20


def _rows_of(batch: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of a list column and where each row's begin."""
    column = batch.column(k)
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False), offsets


def _lists(values: np.ndarray) -> pa.Array:
    """Rows of a matrix as a list column."""
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(values.ravel()))


def groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """Rows of equal first ``keys`` columns, which come together, as one batch each."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        while batch.num_rows:
            change = np.logical_or.reduce([(c := batch.column(k).to_numpy(zero_copy_only=False))[1:] != c[:-1] for k in range(keys)]) if batch.num_rows > 1 else np.zeros(0, bool)
            end = int(np.flatnonzero(change)[0]) + 1 if change.any() else batch.num_rows
            if held and any(held[0].column(k)[0] != batch.column(k)[0] for k in range(keys)):
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
            held.append(batch.slice(0, end))
            batch = batch.slice(end)
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _whole(batch: pa.RecordBatch, k: int) -> np.ndarray:
    """The list column of a batch whose rows are equally long, as a matrix."""
    values, offsets = _rows_of(batch, k)
    return values[offsets[0] : offsets[-1]].reshape(batch.num_rows, -1)


def with_halo(picture: DataFrame, side: int, reach: int, work: Callable[[np.ndarray], np.ndarray], size: tuple[int, int] | None = None) -> DataFrame:
    """``(grp, bx, by, px)``: ``work`` of each block with the ``reach`` pixels around it, cut back to the block.

    A block sends each neighbour the rim that it needs. Pixels outside the picture are nan or, where the picture's
    ``size`` (width, height) is given, mirrored at the border without repeating it, as far as the picture goes.
    """
    far = -(-reach // side)
    shift = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-far, far + 1) for j in range(-far, far + 1)]))
    sent = picture.select("grp", "bx", "by", "px", shift.alias("to"))
    lo = lambda d: F.greatest(F.lit(0), -F.col(f"to.{d}") * -side - reach)  # noqa: E731  of the receiver's frame: it starts at to * side
    hi = lambda d: F.least(F.lit(side), F.col(f"to.{d}") * side + side + reach)
    x0, x1, y0, y1 = lo("i"), hi("i"), lo("j"), hi("j")
    rim = F.flatten(F.transform(F.sequence(y0, y1 - 1), lambda y: F.slice("px", y * side + x0 + 1, x1 - x0)))
    sent = sent.where((x1 > x0) & (y1 > y0)).select("grp", (F.col("bx") + F.col("to.i")).alias("bx"), (F.col("by") + F.col("to.j")).alias("by"), (x0 - F.col("to.i") * side).alias("x"), (y0 - F.col("to.j") * side).alias("y"), (x1 - x0).alias("w"), rim.alias("px"))
    full = side + 2 * reach

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in groups(batches, 3):
            values, offsets = _rows_of(b, 6)
            xs, ys, ws = (b.column(k).to_numpy() for k in (3, 4, 5))
            around = np.full((full, full), np.nan)
            own = False
            for k in range(b.num_rows):
                piece = values[offsets[k] : offsets[k + 1]].reshape(-1, ws[k])
                around[ys[k] + reach : ys[k] + reach + len(piece), xs[k] + reach : xs[k] + reach + ws[k]] = piece
                own |= piece.shape == (side, side) and xs[k] == 0 and ys[k] == 0
            if not own:
                continue
            bx, by = b.column(1)[0].as_py(), b.column(2)[0].as_py()
            if size is not None:
                at = []
                for block, most in ((by, size[1]), (bx, size[0])):
                    g = np.abs(np.arange(block * side - reach, block * side + side + reach))
                    g = np.where(g >= most, 2 * (most - 1) - g, g)
                    at.append(np.clip(g - block * side + reach, 0, full - 1))
                around = around[np.ix_(*at)]
            out = work(around)[reach : reach + side, reach : reach + side]
            yield pa.RecordBatch.from_arrays([*[pa.array([b.column(k)[0].as_py()], pa.int64()) for k in range(3)], _lists(out.reshape(1, -1).astype(float))], names=["grp", "bx", "by", "px"])

    keys = ["grp", "bx", "by"]
    dealt = sent.select(*[F.col(k).cast("long") for k in keys], "x", "y", "w", "px").repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(each, "grp long, bx long, by long, px array<double>")


def _largest(picture: np.ndarray, reach: int) -> np.ndarray:
    """Each pixel where it is the largest of those within ``reach`` along both axes, else nan; nan around it doesn't count."""
    filled = np.where(np.isnan(picture), -np.inf, picture)
    most = filled
    for axis in (0, 1):
        padded = np.pad(most, [(reach, reach) if a == axis else (0, 0) for a in (0, 1)], constant_values=-np.inf)
        most = np.lib.stride_tricks.sliding_window_view(padded, 2 * reach + 1, axis).max(axis=-1)
    return np.where(filled >= most, picture, np.nan)


def local_maxima(picture: DataFrame, side: int, reach: int, least: float) -> DataFrame:
    """``(grp, x, y, value)`` of pixels of at least ``least`` that none within ``reach`` along both axes exceeds; equal ones all count."""
    rows = with_halo(picture, side, reach, lambda p: _largest(p, reach))
    rows = rows.select("grp", "bx", "by", F.posexplode("px").alias("k", "value")).where(~F.isnan("value") & (F.col("value") >= least))
    return rows.select("grp", (F.col("bx") * side + F.col("k") % side).alias("x"), (F.col("by") * side + F.floor(F.col("k") / side)).alias("y"), "value")


def blurred(picture: DataFrame, side: int, sigma: float, size: tuple[int, int]) -> DataFrame:
    """A Gaussian blur of pictures of ``size``, to four deviations, mirrored at the borders; a picture is larger than that reach."""
    reach = int(np.ceil(4 * sigma))
    weight = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    weight /= weight.sum()

    def blur(p: np.ndarray) -> np.ndarray:
        for axis in (0, 1):
            padded = np.pad(p, [(reach, reach) if a == axis else (0, 0) for a in (0, 1)])
            p = np.lib.stride_tricks.sliding_window_view(padded, 2 * reach + 1, axis) @ weight
        return p

    return with_halo(picture, side, reach, blur, size)


def pieces(frames: DataFrame, width: int, held: int = HELD) -> DataFrame:
    """``(grp, first, n, px)``: frames ``(grp, px)`` of ``width`` pixels cut so that a piece of all frames of its group has at most ``held`` numbers."""
    counts = frames.groupBy("grp").agg(F.count("*").alias("n"))
    cut = frames.where(F.size("px") == width).select("grp", "px").join(counts, "grp")
    each = F.greatest(F.lit(1), F.least(F.lit(width), F.floor(F.lit(held) / F.col("n")))).cast("int")
    cut = cut.withColumn("each", each)
    starts = F.explode(F.sequence(F.lit(0), F.lit(width - 1), F.col("each")))
    return cut.select("grp", "px", "each", starts.alias("first")).select("grp", F.col("first").cast("long"), F.slice("px", F.col("first") + 1, F.col("each")).alias("px"))


def frame_statistics(frames: DataFrame, width: int, held: int = HELD) -> DataFrame:
    """``(grp, first, median, largest, deviation)``, arrays for the pixels from ``first`` on, over the frames ``(grp, px)`` of a group."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in groups(batches, 2):
            stack = _whole(b, 2)
            arrays = [_lists(x[None]) for x in (np.median(stack, axis=0), stack.max(axis=0), stack.std(axis=0))]
            yield pa.RecordBatch.from_arrays([b.column(0)[:1], b.column(1)[:1], *arrays], names=["grp", "first", "median", "largest", "deviation"])

    rows = pieces(frames, width, held).repartition("grp", "first").sortWithinPartitions("grp", "first")
    return rows.mapInArrow(each, "grp long, first long, median array<double>, largest array<double>, deviation array<double>")


def flat_field(frames: DataFrame, side: int, sigma: float) -> DataFrame:
    """``(grp, px)``: the median of a group's frames of ``side * side`` pixels, blurred and over its own mean."""
    cut = frame_statistics(frames, side * side)
    whole = cut.groupBy("grp").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("first", "median"))), lambda p: p["median"])).alias("px"))
    zero = F.lit(0).cast("long")
    soft = blurred(whole.select("grp", zero.alias("bx"), zero.alias("by"), "px"), side, sigma, (side, side))
    mean = F.aggregate("px", F.lit(0.0), lambda s, v: s + v) / F.size("px")
    return soft.withColumn("mean", mean).select("grp", F.transform("px", lambda v: v / F.col("mean")).alias("px"))


def median_blocks(frames: DataFrame, side: int, block: int) -> DataFrame:
    """Canvas blocks ``(grp, bx, by, px)`` of the median of the frames ``(grp, x, y, px)`` over each pixel, nan where none is."""
    own = frames.where(F.size("px") == side * side).select("grp", F.col("x").cast("long"), F.col("y").cast("long"), "px")
    over = lambda c: F.explode(F.sequence(F.floor(F.col(c) / block), F.floor((F.col(c) + side - 1) / block)))
    cut = own.withColumn("bx", over("x")).withColumn("by", over("y"))
    x0, y0 = F.greatest("x", F.col("bx") * block), F.greatest("y", F.col("by") * block)
    x1, y1 = F.least(F.col("x") + side, (F.col("bx") + 1) * block), F.least(F.col("y") + side, (F.col("by") + 1) * block)
    part = F.flatten(F.transform(F.sequence(y0 - F.col("y"), y1 - F.col("y") - 1), lambda r: F.slice("px", (r * side + x0 - F.col("x") + 1).cast("int"), (x1 - x0).cast("int"))))
    cut = cut.select("grp", "bx", "by", (x0 - F.col("bx") * block).alias("px0"), (y0 - F.col("by") * block).alias("py0"), (x1 - x0).alias("w"), part.alias("px"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in groups(batches, 3):
            values, offsets = _rows_of(b, 6)
            x, y, w = (b.column(k).to_numpy() for k in (3, 4, 5))
            out, rows = np.full((block, block), np.nan), max(1, min(block, HELD // (b.num_rows * block)))
            for top in range(0, block, rows):  # strips, so that a pixel that very many frames cover stays within what is held
                stack = np.full((b.num_rows, min(rows, block - top), block), np.nan)
                for k in range(b.num_rows):
                    piece = values[offsets[k] : offsets[k + 1]].reshape(-1, w[k])
                    a, z = max(y[k], top), min(y[k] + len(piece), top + stack.shape[1])
                    if z > a:
                        stack[k, a - top : z - top, x[k] : x[k] + w[k]] = piece[a - y[k] : z - y[k]]
                some = ~np.isnan(stack).all(axis=0)
                out[top : top + stack.shape[1]][some] = np.nanmedian(stack[:, some], axis=0)
            yield pa.RecordBatch.from_arrays([*[b.column(k)[:1] for k in range(3)], _lists(out.reshape(1, -1))], names=["grp", "bx", "by", "px"])

    keys = ["grp", "bx", "by"]
    return cut.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(each, "grp long, bx long, by long, px array<double>")


def corner_sums(picture: DataFrame) -> DataFrame:
    """``(grp, bx, by, total)``: the sum of all blocks to the left of and above a block corner, for every corner of the picture.

    Blocks are added up in their tasks; the sums are carried along the rows of blocks and then down the columns. Missing blocks are 0.
    """
    totals = picture.groupBy("grp", "bx", "by").agg(F.sum(F.aggregate("px", F.lit(0.0), lambda s, v: s + F.coalesce(v.cast("double"), F.lit(0.0)))).alias("sum"))
    edges = totals.groupBy("grp").agg(F.min("bx").alias("x0"), F.max("bx").alias("x1"), F.min("by").alias("y0"), F.max("by").alias("y1"))
    grid = edges.withColumn("by", F.explode(F.sequence(F.col("y0"), F.col("y1") + 1))).withColumn("bx", F.explode(F.sequence(F.col("x0"), F.col("x1") + 1))).select("grp", "bx", "by")
    before = lambda part, order: Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = grid.join(totals, ["grp", "bx", "by"], "left").withColumn("across", F.coalesce(F.sum("sum").over(before(("grp", "by"), "bx")), F.lit(0.0)))
    return rows.select("grp", "bx", "by", F.coalesce(F.sum("across").over(before(("grp", "bx"), "by")), F.lit(0.0)).alias("total"))


def window_sums(picture: DataFrame, blocks: int, step: int) -> DataFrame:
    """``(grp, bx, by, total)`` of the windows of ``blocks`` by ``blocks`` blocks, ``step`` apart from the picture's corner, that lie inside it; four corners each."""
    corners = corner_sums(picture)
    first = corners.groupBy("grp").agg(F.min("bx").alias("x0"), F.min("by").alias("y0"))
    at = lambda dx, dy, name: corners.select("grp", (F.col("bx") - dx).alias("bx"), (F.col("by") - dy).alias("by"), F.col("total").alias(name))
    keys = ["grp", "bx", "by"]
    rows = at(0, 0, "a").join(at(blocks, 0, "b"), keys).join(at(0, blocks, "c"), keys).join(at(blocks, blocks, "d"), keys).join(first, "grp")
    rows = rows.where(((F.col("bx") - F.col("x0")) % step == 0) & ((F.col("by") - F.col("y0")) % step == 0))
    return rows.select(*keys, (F.col("d") - F.col("b") - F.col("c") + F.col("a")).alias("total"))


def covered_windows(picture: DataFrame, side: int, blocks: int, least: float = 0.35, most: int = 5) -> DataFrame:
    """``(grp, place, bx, by, share)``: the ``most`` best-covered windows of a picture of 0 and 1, half a window apart along one axis at least.

    Windows are half a window apart to begin with; those covered by ``least`` or less don't count; ties go to the lower, then the right one.
    """
    windows = window_sums(picture, blocks, max(1, blocks // 2)).select("grp", "bx", "by", (F.col("total") / (blocks * side) ** 2).alias("share")).where(F.col("share") > least)
    apart = kept_apart(windows.select("grp", F.col("bx").alias("x"), F.col("by").alias("y"), F.col("share").alias("score")), max(1, blocks // 2), last_first=True)
    place = F.row_number().over(Window.partitionBy("grp").orderBy(F.desc("score"), F.desc("y"), F.desc("x")))
    return apart.withColumn("place", place.cast("long")).where(F.col("place") <= most).select("grp", "place", F.col("x").alias("bx"), F.col("y").alias("by"), F.col("score").alias("share"))
