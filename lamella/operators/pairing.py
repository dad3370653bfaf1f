"""Tiles that meet in pairs, and points kept apart."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamella.plans.session import checkpointed, forget, saved

#: Tiles of a group at least and at most, of which each two groups of a dataset meet in a task, and its pixels where that leaves a choice.
GROUP, LARGEST, PIXELS = 16, 256, 1 << 20


def overlap_scores(a: np.ndarray, b: np.ndarray, dx: int, dy: int, least: int) -> np.ndarray:
    """The correlation of every picture of ``a`` with every one of ``b`` over what they share when b lies at ``(dx, dy)`` from a; nan under ``least`` pixels or without contrast."""
    h, w = a.shape[1:]
    if (w - abs(dx)) * (h - abs(dy)) < least or abs(dx) >= w or abs(dy) >= h:
        return np.full((len(a), len(b)), np.nan)
    one = a[:, max(0, dy) : h + min(0, dy), max(0, dx) : w + min(0, dx)].reshape(len(a), -1)
    two = b[:, max(0, -dy) : h - max(0, dy), max(0, -dx) : w - max(0, dx)].reshape(len(b), -1)
    one, two = one - one.mean(axis=1, keepdims=True), two - two.mean(axis=1, keepdims=True)
    scale = np.sqrt((one * one).sum(axis=1))[:, None] * np.sqrt((two * two).sum(axis=1))
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(scale > 1e-12, (one @ two.T) / scale, np.nan)


def meetings(tiles: DataFrame, side: int, group: int | None = None) -> DataFrame:
    """``(dataset, ga, gb, g, trial, px)``: a row for each block of two groups in which a tile of group g meets others."""
    group = group or min(LARGEST, max(GROUP, PIXELS // side**2))
    listed = tiles.select("dataset", "trial", F.col("px").cast("array<double>").alias("px"))
    place = listed.select("dataset", "trial", F.floor((F.row_number().over(Window.partitionBy("dataset").orderBy("trial")) - 1) / group).alias("g"))
    place = place.withColumn("last", F.max("g").over(Window.partitionBy("dataset")))
    met = listed.join(place, ["dataset", "trial"]).withColumn("t", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))))
    return met.select("dataset", F.least("g", "t").alias("ga"), F.greatest("g", "t").alias("gb"), "g", "trial", "px")


def measured_pairs(tiles: DataFrame, side: int, aliases: tuple[int, ...], least: int, group: int | None = None) -> DataFrame:
    """Every unordered pair of a dataset's tiles ``(dataset, trial, px)`` once: ``(dataset, a, b, dx, dy, ncc, moved)``.

    Tiles are dealt into groups of at most ``group`` (if not given, of what has ``PIXELS``) and each two groups meet in one
    task, so a tile travels as often as there are groups and no pair before it is measured. Each pair is scored at every
    combination of the ``aliases`` along both axes, b at that distance from a, over at least ``least`` shared pixels; the
    best score wins, to nine digits, ties by (dy, dx). A pair that nothing can be measured of has nulls. Tiles that aren't ``side * side`` pixels are left out.
    """
    met = meetings(tiles.where(F.size("px") == side * side), side, group)
    shifts = [(dx, dy) for dy in aliases for dx in aliases]

    def measure(b: pa.RecordBatch) -> pa.RecordBatch:
        from lamella.operators.blocks import _whole

        ga, gb, g, trial = b.column(1)[0].as_py(), b.column(2)[0].as_py(), b.column(3).to_numpy(), b.column(4).to_numpy()
        order = np.argsort(trial, kind="stable")
        px = _whole(b, 5).reshape(-1, side, side)[order]
        g, trial = g[order], trial[order]
        one, two = np.flatnonzero(g == ga), np.flatnonzero(g == gb)
        best, at = np.full((len(one), len(two)), -np.inf), np.full((len(one), len(two)), -1, np.int16)
        for k, (dx, dy) in enumerate(shifts):
            score = overlap_scores(px[one], px[two], dx, dy, least)
            score *= 1e9
            np.rint(score, out=score)
            np.copyto(at, k, where=score > best)  # not for nan
            np.fmax(best, score, out=best)
        first = trial[one][:, None] < trial[two][None, :] if ga == gb else np.ones(best.shape, bool)
        i, j = np.nonzero(first)
        k, best = at[first], best[first] / 1e9
        none, shift = k < 0, np.array(shifts)[k]
        columns = [pa.array(np.full(len(i), b.column(0)[0].as_py())), pa.array(trial[one][i]), pa.array(trial[two][j]), pa.array(shift[:, 0], mask=none), pa.array(shift[:, 1], mask=none), pa.array(best, mask=none), pa.array((shift != 0).any(axis=1), mask=none)]
        return pa.RecordBatch.from_arrays(columns, names=["dataset", "a", "b", "dx", "dy", "ncc", "moved"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from lamella.operators.blocks import groups

        return (measure(b) for b in groups(batches, 3))

    keys = ["dataset", "ga", "gb"]
    return met.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(each, "dataset long, a long, b long, dx long, dy long, ncc double, moved boolean")


def kept_apart(points: DataFrame, reach: float, last_first: bool = False, round_reach: bool = False) -> DataFrame:
    """Of points ``(grp, x, y, score)`` those that a walk from the best to the worst keeps: a point goes that is closer to a kept one than ``reach``.

    Closer along both axes or, with ``round_reach``, at most ``reach`` away. Ties in score go to the smaller (y, x), or to the
    larger with ``last_first``; equal points are one. Points are paired in neighbouring cells once. Then a point that is
    the best of those still open around it is kept and its neighbours go, all over the picture at once, until none is open.
    """
    sign = -1 if last_first else 1
    rows = points.dropDuplicates(["grp", "x", "y", "score"]).withColumn("id", F.struct((-F.col("score")).alias("s"), (sign * F.col("y")).alias("y"), (sign * F.col("x")).alias("x")))
    rows = saved(rows.select("grp", "id", "x", "y", F.floor(F.col("x") / reach).alias("bx"), F.floor(F.col("y") / reach).alias("by")), "points")
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    first = rows.select("grp", F.col("id").alias("worse"), F.col("x").alias("px"), F.col("y").alias("py"), "bx", "by", around.alias("o")).select("grp", "worse", "px", "py", (F.col("bx") + F.col("o.i")).alias("bx"), (F.col("by") + F.col("o.j")).alias("by"))
    dx, dy = F.abs(F.col("px") - F.col("x")), F.abs(F.col("py") - F.col("y"))
    near = dx * dx + dy * dy <= reach * reach if round_reach else (dx < reach) & (dy < reach)
    close = first.join(rows, ["grp", "bx", "by"]).where(near & (F.col("id") < F.col("worse"))).select("grp", F.col("id").alias("better"), "worse")
    close, open_, kept, stored = saved(close, "close"), rows.select("grp", "id"), None, [rows]
    while True:
        blocked = close.select("grp", F.col("worse").alias("id")).distinct()
        now = saved(open_.join(blocked, ["grp", "id"], "left_anti"), "kept")
        kept = now if kept is None else kept.unionByName(now)
        gone = checkpointed(close.join(now.withColumnRenamed("id", "better"), ["grp", "better"], "left_semi").select("grp", F.col("worse").alias("id")).distinct())
        left = saved(open_.join(now, ["grp", "id"], "left_anti").join(gone, ["grp", "id"], "left_anti"), "open")
        rest = close.join(now.withColumnRenamed("id", "better"), ["grp", "better"], "left_anti")
        rest = saved(rest.join(gone.withColumnRenamed("id", "better"), ["grp", "better"], "left_anti").join(gone.withColumnRenamed("id", "worse"), ["grp", "worse"], "left_anti"), "close")
        stored += [close, now, left]
        close, open_ = rest, left
        if open_.isEmpty():
            break
    out = checkpointed(kept.select("grp", (sign * F.col("id.x")).alias("x"), (sign * F.col("id.y")).alias("y"), (-F.col("id.s")).alias("score")))
    forget(*stored, close)
    return out
