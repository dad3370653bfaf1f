"""Pairs, budgets and areas of placed frames and grids."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamella.functions.scalars import lattice_coordinates
from lamella.plans.session import checkpointed


def pair_blocks(tiles: DataFrame, group: int = 16) -> DataFrame:
    """The blocks in which a dataset's tile pairs are measured: two groups of at most ``group`` tiles and the number of their pairs.

    Pairs themselves aren't listed: a tile goes to as many blocks as there are groups, not to as many as there are tiles.
    """
    i = F.row_number().over(Window.partitionBy("dataset").orderBy("trial")) - 1
    groups = tiles.select("dataset", F.floor(i / group).alias("g")).groupBy("dataset", "g").agg(F.count("*").alias("n"))
    last = groups.groupBy("dataset").agg(F.max("g").alias("last"))
    a = groups.join(last, "dataset").select("dataset", F.col("g").alias("ga"), F.col("n").alias("na"), F.explode(F.sequence("g", "last")).alias("gb"))
    b = groups.select("dataset", F.col("g").alias("gb"), F.col("n").alias("nb"))
    pairs = F.when(F.col("ga") == F.col("gb"), F.col("na") * (F.col("na") - 1) / 2).otherwise(F.col("na") * F.col("nb"))
    return a.join(b, ["dataset", "gb"]).select("dataset", "ga", "gb", pairs.cast("long").alias("n_pairs"))


def cross_candidates(keyframes: DataFrame, width: int, height: int, share: float = 0.12, apart: int = 3) -> DataFrame:
    """Keyframes ``(video, segment, i, x, y)`` of a segment at least ``apart`` places apart whose frames would share ``share`` of their area.

    Frames overlap only in neighbouring cells of their own size; the earlier one of a pair looks.
    """
    own = keyframes.select("video", "segment", "i", "x", "y", F.floor(F.col("x") / width).alias("bx"), F.floor(F.col("y") / height).alias("by"))
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    first = own.select("video", "segment", F.col("i").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"), "bx", "by", F.explode(around).alias("o"))
    first = first.select("video", "segment", "a", "ax", "ay", (F.col("bx") + F.col("o.i")).alias("bx"), (F.col("by") + F.col("o.j")).alias("by"))
    second = own.select("video", "segment", F.col("i").alias("b"), F.col("x").alias("cx"), F.col("y").alias("cy"), "bx", "by")
    dx, dy = F.abs(F.col("cx") - F.col("ax")), F.abs(F.col("cy") - F.col("ay"))
    ok = (F.col("b") >= F.col("a") + apart) & (dx < width) & (dy < height) & ((width - dx) * (height - dy) >= share * width * height)
    return first.join(second, ["video", "segment", "bx", "by"]).where(ok).select("video", "a", "b", F.hypot(dx, dy).alias("distance"))


def budgeted(candidates: DataFrame, most: int = 6, rounds: int = 1000) -> DataFrame:
    """Candidates ``(video, a, b, distance)`` taken in the order of (distance, a, b) while both ends have taken fewer than ``most``.

    Taking one by one isn't needed: a candidate that is among the first ``left`` of those still open at both its ends
    is taken whatever happens to the others, so each round takes all of these and drops those of full ends.
    """
    open_, taken = checkpointed(candidates.select("video", "a", "b", "distance")), []
    used = open_.select("video", F.col("a").alias("end"), F.lit(0).cast("long").alias("n")).limit(0)
    order = [F.col("distance"), F.col("a"), F.col("b")]
    for _ in range(rounds):
        ends = open_.withColumn("end", F.explode(F.array("a", "b"))).join(used, ["video", "end"], "left")
        ends = ends.withColumn("place", F.row_number().over(Window.partitionBy("video", "end").orderBy(*order))).withColumn("left", most - F.coalesce("n", F.lit(0)))
        both = checkpointed(ends.groupBy("video", "a", "b", "distance").agg(F.min(F.col("place") <= F.col("left")).alias("now"), F.min("left").alias("left")).where("left > 0"))
        if both.isEmpty():
            break
        new = both.where("now").select("video", "a", "b", "distance")
        taken.append(new)
        counts = new.select("video", F.explode(F.array("a", "b")).alias("end")).groupBy("video", "end").agg(F.count("*").alias("n"))
        used = checkpointed(used.unionByName(counts).groupBy("video", "end").agg(F.sum("n").alias("n")))
        open_ = both.where("not now").select("video", "a", "b", "distance")
    out = candidates.select("video", "a", "b", "distance").limit(0)
    for t in taken:
        out = out.unionByName(t)
    return out


def axis_bands(steps: DataFrame, least: float = 0.62, pad: int = 4) -> DataFrame:
    """How far off an axis a dataset's confident steps ``(dataset, dx, dy, ncc)`` go, rounded up, plus ``pad``; null without a confident one."""
    cross = F.when(F.col("ncc") >= least, F.least(F.abs("dx"), F.abs("dy")))
    return steps.groupBy("dataset").agg(F.count(cross).alias("n_confident"), F.count_if(cross > 4).alias("n_off_axis"), (F.ceil(F.max(cross)) + pad).alias("band"))


#: Tiles of a dataset that may be looked up in an array; draws of larger datasets are joined with their tiles.
HELD = 4096


def null_draws(tiles: DataFrame, n: int = 3000, seed: int = 11) -> DataFrame:
    """``n`` random ordered pairs of a dataset's tiles, by hashes of the draw's number, whatever the partitions.

    Datasets are dealt to all tasks before each becomes ``n`` rows, and neither draws nor tiles are broadcast.
    """
    parts = int(tiles.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    i = F.row_number().over(Window.partitionBy("dataset").orderBy("trial")) - 1
    listed = tiles.where("dataset is not null").select("dataset", "trial", i.alias("i"))
    held = F.transform(F.array_sort(F.collect_list(F.when(F.col("i") < HELD, F.struct("i", "trial")))), lambda t: t["trial"])
    sizes = listed.groupBy("dataset").agg(F.count("*").alias("size"), held.alias("held")).repartition(parts, F.xxhash64("dataset"))  # a partitioning of its own, or Spark drops it
    draw = lambda k, end: F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), "dataset", k, F.lit(end))), 1, 8), 16, 10).cast("long") % F.col("size")
    numbers = F.sequence(F.lit(0), F.lit(n - 1))
    drawn = F.transform(numbers, lambda k: F.struct(k.alias("k"), *[F.get("held", draw(k, e).cast("int")).alias(e) for e in "ab"]))
    few = sizes.where(F.col("size") <= HELD).select("dataset", F.inline(drawn))
    draws = sizes.where(F.col("size") > HELD).select("dataset", "size", F.explode(numbers).alias("k")).select("dataset", "k", draw("k", "a").alias("ia"), draw("k", "b").alias("ib"))
    a, b = (listed.select("dataset", F.col("i").alias(f"i{e}"), F.col("trial").alias(e)).hint("merge") for e in "ab")
    return few.unionByName(draws.join(a, ["dataset", "ia"]).join(b, ["dataset", "ib"]).select("dataset", "k", "a", "b"))


def null_floor(scores: DataFrame, share: float = 0.995) -> DataFrame:
    """The ncc that ``share`` of random matches ``(dataset, k, ncc)`` stay below, each the best over its aliases."""
    best = scores.groupBy("dataset", "k").agg(F.max("ncc").alias("ncc"))
    return best.groupBy("dataset").agg(F.round(F.percentile("ncc", share), 6).alias("floor"), F.count("ncc").alias("n"))


def coverage(tiles: DataFrame, side: int = 512, block: int = 256) -> DataFrame:
    """Pixels under at least one placed tile ``(dataset, x, y)`` and their share of the canvas, exact and without pixels.

    Each block is cut into strips at its tiles' edges; in a strip the tiles are intervals whose union is added up.
    """
    t = tiles.select("dataset", F.rint("x").cast("long").alias("x"), F.rint("y").cast("long").alias("y")).where("x is not null and y is not null").distinct()
    spans = lambda c: F.explode(F.sequence(F.floor(F.col(c) / block), F.floor((F.col(c) + side - 1) / block)))
    b = t.withColumn("bx", spans("x")).withColumn("by", spans("y"))
    low = lambda c, k: F.greatest(F.lit(0), F.col(c) - F.col(k) * block)
    high = lambda c, k: F.least(F.lit(block), F.col(c) + side - F.col(k) * block)
    key = ["dataset", "bx", "by"]
    b = b.select(*key, low("x", "bx").alias("x0"), high("x", "bx").alias("x1"), low("y", "by").alias("y0"), high("y", "by").alias("y1")).distinct()
    cuts = b.select(*key, F.explode(F.array("y0", "y1")).alias("ya")).distinct().withColumn("yb", F.lead("ya").over(Window.partitionBy(*key).orderBy("ya"))).where("yb is not null")
    strips = cuts.join(b, key).where("y0 <= ya and y1 >= yb")
    before = F.max("x1").over(Window.partitionBy(*key, "ya").orderBy("x0", "x1").rowsBetween(Window.unboundedPreceding, -1))
    part = F.greatest(F.lit(0), F.col("x1") - F.greatest("x0", F.coalesce(before, F.lit(0)))) * (F.col("yb") - F.col("ya"))
    area = strips.withColumn("area", part).groupBy("dataset").agg(F.sum("area").alias("covered_px"))
    canvas = t.groupBy("dataset").agg(((F.max("x") - F.min("x") + side) * (F.max("y") - F.min("y") + side)).alias("canvas_px"))
    return area.join(canvas, "dataset").select("dataset", "covered_px", "canvas_px", F.round(F.col("covered_px") / F.col("canvas_px"), 6).alias("share"))


def micrometres(electrodes: DataFrame, grids: DataFrame, pitch_um: float = 17.5) -> DataFrame:
    """Cells in micrometres along the lattice's own axes, from its least-squares origin.

    ``grids`` has ``(mosaic, pitch, a1x, a1y, a2x, a2y)``. The origin is the mean of all cells stepped back to the
    first one; a cell's place is solved in the lattice's vectors, not projected on them. Parallel vectors give null.
    """
    rows = electrodes.join(grids, "mosaic")
    c, r = F.col("col") - 1, F.col("row") - 1
    back = lambda p, k: F.col(p) - c * F.col(f"a1{k}") - r * F.col(f"a2{k}")
    origin = rows.groupBy("mosaic").agg(F.avg(back("x", "x")).alias("ox"), F.avg(back("y", "y")).alias("oy"))
    rows = rows.join(origin, "mosaic")
    u, v = lattice_coordinates(F.col("x") - F.col("ox"), F.col("y") - F.col("oy"), (F.col("a1x"), F.col("a1y")), (F.col("a2x"), F.col("a2y")))
    return rows.select("mosaic", "col", "row", F.round(u * pitch_um, 4).alias("x_um"), F.round(v * pitch_um, 4).alias("y_um"), F.round(F.lit(pitch_um) / F.col("pitch"), 6).alias("um_per_px"))
