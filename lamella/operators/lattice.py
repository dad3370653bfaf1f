"""Indexing the pads of a grid by column and row."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamella.operators.graph import connected_components, contradictions
from lamella.plans.session import checkpointed, forget, saved

#: Steps that are looked for from each pad: to the neighbours, and past one missing pad.
STEPS = ((1, 0), (0, 1), (1, 1), (1, -1), (2, 0), (0, 2))
#: Fixed value of the rule: how far from where a step leads a pad may be, in pitches.
SNAP = 0.25


def pad_links(pads: DataFrame, along: tuple[float, float], down: tuple[float, float], snap: float = SNAP, steps: tuple = STEPS) -> DataFrame:
    """``(mosaic, a, b, col, row)``: the pad b nearest to where each step of (col, row) from pad a leads, within ``snap`` pitches.

    ``along`` and ``down`` are the grid's vectors. Pads ``(mosaic, pad, x, y)`` lie in cells of a pitch, and a step looks into the
    cells that its circle touches.
    """
    pitch = ((along[0] ** 2 + along[1] ** 2) ** 0.5 + (down[0] ** 2 + down[1] ** 2) ** 0.5) / 2
    reach = snap * pitch
    to = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.lit(r).alias("r"), F.lit(c * along[0] + r * down[0]).alias("x"), F.lit(c * along[1] + r * down[1]).alias("y")) for c, r in steps]))
    first = pads.select("mosaic", F.col("pad").alias("a"), "x", "y", to.alias("to")).select("mosaic", "a", F.col("to.c").alias("col"), F.col("to.r").alias("row"), (F.col("x") + F.col("to.x")).alias("px"), (F.col("y") + F.col("to.y")).alias("py"))
    touched = lambda c: F.explode(F.array_distinct(F.array(F.floor((F.col(c) - reach) / pitch), F.floor((F.col(c) + reach) / pitch))))
    first = first.withColumn("bx", touched("px")).withColumn("by", touched("py"))
    second = pads.select("mosaic", F.col("pad").alias("b"), "x", "y", F.floor(F.col("x") / pitch).alias("bx"), F.floor(F.col("y") / pitch).alias("by"))
    far = F.hypot(F.col("px") - F.col("x"), F.col("py") - F.col("y"))
    # files of pads are far smaller than their rows, of which each meets up to 24 cells: neither side is broadcast
    met = first.join(second.hint("merge"), ["mosaic", "bx", "by"]).withColumn("far", far).where((F.col("far") <= reach) & (F.col("a") != F.col("b")))
    best = met.groupBy("mosaic", "a", "col", "row").agg(F.min(F.struct("far", "b")).alias("best"))
    return best.select("mosaic", "a", F.col("best.b").alias("b"), F.col("col").cast("long"), F.col("row").cast("long"))


def indexed_pads(pads: DataFrame, along: tuple[float, float], down: tuple[float, float], snap: float = SNAP, steps: tuple = STEPS) -> DataFrame:
    """``(mosaic, pad, part, n, col, row, n_wrong)``: column and row of each pad in its part of the grid, both from 1.

    A part is what links join up, named by its smallest pad, and has ``n`` pads; ``n_wrong`` counts the pad's links that
    contradict its place (two pads may then share a cell). Pads that fit nowhere are parts by themselves; pads without
    position or id are left out; of rows with the same id one counts.
    """
    pads = saved(pads.select("mosaic", "pad", "x", "y").na.drop().dropDuplicates(["mosaic", "pad"]), "pads")
    at = lambda c: F.struct("mosaic", F.col(c).alias("pad")).alias(c)
    links = saved(pad_links(pads, along, down, snap, steps).select(at("a"), at("b"), (-F.col("col")).alias("col"), (-F.col("row")).alias("row")), "pad-links")
    found = checkpointed(connected_components(links, steps=["col", "row"]))
    wrong = contradictions(links, found, ["col", "row"]).select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_wrong"))
    rows = pads.select(F.struct("mosaic", "pad").alias("node")).join(found, "node", "left").join(wrong, "node", "left")
    rows = rows.select("node.*", F.coalesce("root.pad", "node.pad").alias("part"), F.coalesce("col", F.lit(0)).alias("col"), F.coalesce("row", F.lit(0)).alias("row"), F.coalesce("n_wrong", F.lit(0)).alias("n_wrong"))
    low = rows.groupBy("mosaic", "part").agg(F.count("*").alias("n"), F.min("col").alias("c0"), F.min("row").alias("r0"))
    out = rows.join(low, ["mosaic", "part"]).select("mosaic", "pad", "part", "n", (F.col("col") - F.col("c0") + 1).alias("col"), (F.col("row") - F.col("r0") + 1).alias("row"), "n_wrong")
    out = saved(out, "indexed")
    forget(pads, links)
    return out


def filled_cells(indexed: DataFrame) -> DataFrame:
    """``(mosaic, part, col, row, n_around)``: cells without a pad that at least two pads of their part touch along the axes."""
    cells = indexed.select("mosaic", "part", "col", "row").distinct()
    around = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.lit(r).alias("r")) for c, r in ((1, 0), (-1, 0), (0, 1), (0, -1))]))
    beside = cells.select("mosaic", "part", "col", "row", around.alias("o")).groupBy("mosaic", "part", (F.col("col") + F.col("o.c")).alias("col"), (F.col("row") + F.col("o.r")).alias("row")).agg(F.count("*").alias("n_around"))
    return beside.where("n_around > 1").join(cells.hint("merge"), ["mosaic", "part", "col", "row"], "left_anti")
