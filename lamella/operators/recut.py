"""Cutting runs again where the origins that their anchors imply jump."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.operators.blocks import groups

#: Fixed values of the rule: the jump in pixels, anchors looked at from a jump on, anchors that must agree on either side.
JUMP, LOOK, AGREEING = 12.0, 3, 2


def jumps(origin: np.ndarray, jump: float = JUMP, look: int = LOOK, agreeing: int = AGREEING) -> tuple[list[int], list[int]]:
    """Places at which the origins ``(n, 2)`` go over to another value, and those of single ones that nothing bears out.

    An origin belongs to the stretch before it while it is within ``jump`` of the stretch's median. Else it is a cut if it is
    borne out on both sides: by ``agreeing`` origins, or as many as there are, but at least two. A stretch of one is
    dropped rather than cut from.
    """
    cuts, dropped, stretch = [], [], [0] if len(origin) else []
    for i in range(1, len(origin)):
        if np.hypot(*(origin[i] - np.median(origin[stretch], axis=0))) <= jump:
            stretch.append(i)
            continue
        ahead = origin[i : i + look]
        need = max(2, min(agreeing, len(stretch), len(ahead)))
        if len(stretch) < need:
            dropped += stretch
            stretch = [i]
        elif np.count_nonzero(np.hypot(*(ahead - origin[i]).T) <= jump) >= need:
            cuts.append(i)
            stretch = [i]
        else:
            dropped.append(i)
    return cuts, dropped


def recut_runs(tiles: DataFrame, jump: float = JUMP, look: int = LOOK, agreeing: int = AGREEING) -> DataFrame:
    """``(dataset, run, trial, part, outlier)`` of tiles ``(dataset, run, trial, lx, ly, ax, ay)``.

    ``(lx, ly)`` is the tile's place in its run and ``(ax, ay)`` where its anchor puts it, null without one. A run is cut before
    a tile whose implied origin jumps; ``part`` counts the cuts before a tile, ``outlier`` marks anchors that nothing bears
    out. A task holds one run at a time. Rows without dataset, run, trial or place are left out.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in groups(batches, 2):
            trial, place = b.column(2).to_numpy(), np.stack([b.column(k).to_numpy() for k in (3, 4)], axis=1)
            anchor = np.stack([b.column(k).to_numpy(zero_copy_only=False).astype(float) for k in (5, 6)], axis=1)
            has = np.flatnonzero(~np.isnan(anchor).any(axis=1))
            cuts, dropped = jumps(anchor[has] - place[has], jump, look, agreeing)
            part, outlier = np.zeros(len(trial), np.int64), np.zeros(len(trial), bool)
            part[has[cuts]] = 1
            outlier[has[dropped]] = True
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(np.cumsum(part)), pa.array(outlier)], names=["dataset", "run", "trial", "part", "outlier"])

    keys = [F.col(c).cast("long").alias(c) for c in ("dataset", "run", "trial")]
    rows = tiles.select(*keys, *[F.col(c).cast("double").alias(c) for c in ("lx", "ly", "ax", "ay")]).na.drop(subset=["dataset", "run", "trial", "lx", "ly"])
    return rows.repartition("dataset", "run").sortWithinPartitions("dataset", "run", "trial").mapInArrow(each, "dataset long, run long, trial long, part long, outlier boolean")
