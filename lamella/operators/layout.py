"""Tiles, links, electrodes and located regions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamella.operators.graph import connected_components
from lamella.plans.session import checkpointed

OVERLAP_SIDE, OVERLAP_AREA, NEAR, TILE = 40, 3600, 480, 512


def state_counts(tiles: DataFrame) -> DataFrame:
    """A3: tiles by state, and the diverted ones (column ``diverted``) that are unverified with a position."""
    states = ("anchor", "unverified", "human", "excluded")
    diverted = F.count_if(F.col("diverted") & (F.col("state") == "unverified") & F.col("x").isNotNull())
    return tiles.groupBy("dataset").agg(*[F.count_if(F.col("state") == s).alias(f"n_{s}") for s in states], diverted.alias("n_diverted"))


def placed(tiles: DataFrame, unverified: bool = False) -> DataFrame:
    """P5: positions of tiles that aren't excluded; unverified ones on request."""
    states = ["anchor", "human"] + ["unverified"] * unverified
    return tiles.where(F.col("state").isin(states) & F.col("x").isNotNull()).select("dataset", "trial", "x", "y", "state")


def moved(tiles: DataFrame) -> DataFrame:
    """L2: distance of each kept tile from where the machine put it, worst first in its dataset."""
    d = F.round(F.hypot(F.col("x") - F.col("mx"), F.col("y") - F.col("my")), 4)
    rows = tiles.where("state <> 'excluded'").select("dataset", "trial", d.alias("moved_px"))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("dataset").orderBy(F.desc("moved_px"), "trial")).cast("long"))


def nearby_pairs(tiles: DataFrame, near: float = NEAR) -> DataFrame:
    """Pairs of a dataset whose corners are closer than ``near`` and whose tiles overlap enough.

    Tiles are bucketed by ``near``; only the first tile of a pair looks into the nine buckets around it.
    """
    own = tiles.where("x is not null").select("dataset", "trial", "x", "y", F.floor(F.col("x") / near).alias("bx"), F.floor(F.col("y") / near).alias("by"))
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    first = own.select("dataset", F.col("trial").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"), "bx", "by", F.explode(around).alias("o"))
    first = first.select("dataset", "a", "ax", "ay", (F.col("bx") + F.col("o.i")).alias("bx"), (F.col("by") + F.col("o.j")).alias("by"))
    second = own.select("dataset", F.col("trial").alias("b"), F.col("x").alias("cx"), F.col("y").alias("cy"), "bx", "by")
    dx, dy = F.abs(F.col("cx") - F.col("ax")), F.abs(F.col("cy") - F.col("ay"))
    ow, oh = TILE - dx, TILE - dy
    ok = (F.col("a") < F.col("b")) & (dx * dx + dy * dy < near * near) & (ow >= OVERLAP_SIDE) & (oh >= OVERLAP_SIDE) & (ow * oh >= OVERLAP_AREA)
    # what is guessed of their sizes knows nothing of the nine buckets and little of rows in files: neither side is broadcast
    return first.join(second.hint("merge"), ["dataset", "bx", "by"]).where(ok).select("dataset", "a", "b", (ow * oh).alias("overlap_px"))


#: By kind of link: the least overlap as a share of the frame, and the largest correction of the prior in pixels (None: the frame's diagonal).
LINK_LIMITS = {"seq": (0.06, 100.0), "cross": (0.12, 300.0), "bridge": (0.06, None)}


REJECTIONS = ("no_overlap_at_prior", "weak_phase_response", "correction_too_large", "no_overlap_at_measured", "low_ncc_at_measured")


def _overlap(x, y, width: int, height: int):
    """Pixels that two frames share at an offset, in whole blocks of 16; none if a side is under 32."""
    w, h = (F.floor((size - F.abs(F.bround(off))) / 16) * 16 for off, size in ((x, width), (y, height)))
    return F.when((w >= 32) & (h >= 32), w * h).otherwise(0)


def link_verdicts(links: DataFrame, response: float = 0.08, limits: dict = LINK_LIMITS, ncc: float = 0.3, frame: tuple[int, int] = (TILE, TILE)) -> DataFrame:
    """P10: why a link is rejected, in the order of the checks; ok otherwise.

    ``(dx, dy)`` is the measured offset and ``(px, py)`` the prior; without prior columns the prior is 0. ``limits`` are
    by kind as in :data:`LINK_LIMITS`; a kind that isn't there is an error.
    """
    px, py = (F.col(c) if c in links.columns else F.lit(0.0) for c in ("px", "py"))
    unknown = F.raise_error(F.concat(F.lit("no limits for links of kind "), F.coalesce("kind", F.lit("null")))).cast("double")

    def of_kind(value):
        out = unknown
        for kind, limit in limits.items():
            out = F.when(F.col("kind") == kind, F.lit(float(value(limit)))).otherwise(out)
        return out

    area = of_kind(lambda x: x[0] * frame[0] * frame[1])
    most = of_kind(lambda x: x[1] if x[1] is not None else (frame[0] ** 2 + frame[1] ** 2) ** 0.5)
    shared = lambda x, y: (least := _overlap(x, y, *frame)).eqNullSafe(F.lit(0)) | (least < area)
    verdict = (
        F.when(shared(px, py), "no_overlap_at_prior").when(F.col("response") < response, "weak_phase_response")
        .when(F.hypot(F.col("dx") - px, F.col("dy") - py) > most, "correction_too_large").when(shared(F.col("dx"), F.col("dy")), "no_overlap_at_measured")
        .when(F.col("ncc") < ncc, "low_ncc_at_measured").otherwise("ok")
    )
    return links.withColumn("verdict", verdict)


def link_statistics(links: DataFrame, **limits) -> DataFrame:
    """Accepted links by kind with their medians, and how many links each check rejects; ``limits`` as in :func:`link_verdicts`."""
    ok = F.col("verdict") == "ok"
    rejected = [F.count_if(F.col("verdict") == v).alias(f"n_{v}") for v in REJECTIONS]
    return link_verdicts(links, **limits).groupBy("dataset", "kind").agg(
        F.count("*").alias("n"), F.count_if(ok).alias("n_ok"), F.median(F.when(ok, F.col("response"))).alias("median_response"), F.median(F.when(ok, F.col("ncc"))).alias("median_ncc"), *rejected
    )


def top_links(links: DataFrame, most: int = 6) -> DataFrame:
    """Links among the ``most`` best at either end (ties by the ends)."""
    pairs = links.groupBy("dataset", "a", "b").agg(F.max("ncc").alias("ncc"))
    ends = pairs.withColumn("end", F.explode(F.array("a", "b")))
    rank = F.row_number().over(Window.partitionBy("dataset", "end").orderBy(F.desc("ncc"), "a", "b"))
    return ends.withColumn("rank", rank).where(F.col("rank") <= most).select("dataset", "a", "b", "ncc").distinct()


def margins(links: DataFrame) -> DataFrame:
    """Best minus second-best ncc of each tile's links; null with one link."""
    pairs = links.groupBy("dataset", "a", "b").agg(F.max("ncc").alias("ncc"))
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("dataset", "a").orderBy(F.desc("ncc"), "b"))).where("rank <= 2")
    best, second = F.max(F.when(F.col("rank") == 1, F.col("ncc"))), F.max(F.when(F.col("rank") == 2, F.col("ncc")))
    return ranked.groupBy("dataset", "a").agg(F.round(best - second, 6).alias("margin"))


def rigid_runs(tiles: DataFrame, floor: float = 0.55, adjacent: int = 1) -> DataFrame:
    """Runs cut where trials are over ``adjacent`` apart or ncc is low; positions restart at 0."""
    by = Window.partitionBy("dataset").orderBy("trial")
    cut = (F.lag("trial").over(by).isNull() | (F.col("trial") - F.lag("trial").over(by) > adjacent) | (F.col("ncc") < floor)).cast("int")
    rows = tiles.withColumn("cut", cut).withColumn("run", F.sum("cut").over(by)).withColumn("dx", F.when(F.col("cut") == 1, 0.0).otherwise(F.col("x") - F.lag("x").over(by)))
    return rows.select("dataset", "trial", "run", F.sum("dx").over(Window.partitionBy("dataset", "run").orderBy("trial")).alias("local_x"))


def link_components(links: DataFrame, **limits) -> DataFrame:
    """``(dataset, node, component, n)``: components of a dataset's accepted links, numbered from the largest on (ties by smallest node), with their sizes."""
    ok = link_verdicts(links, **limits).where("verdict = 'ok' AND a IS NOT NULL AND b IS NOT NULL")
    at = lambda c: F.struct("dataset", F.col(c).alias("node")).alias(c)
    nodes = checkpointed(connected_components(ok.select(at("a"), at("b"))))
    sizes = nodes.groupBy("root").agg(F.count("*").alias("n")).select("root.dataset", "root", "n")
    number = F.row_number().over(Window.partitionBy("dataset").orderBy(F.desc("n"), "root.node")) - 1
    sizes = checkpointed(sizes.select("root", "n", number.cast("long").alias("component")))
    return nodes.join(sizes, "root").select("node.dataset", "node.node", "component", "n")


def electrodes_in_regions(electrodes: DataFrame, regions: DataFrame, cell: float = 128.0) -> DataFrame:
    """Electrodes inside each rectangle, half-open, by buckets of ``cell`` pixels."""
    e = electrodes.withColumn("bx", F.floor(F.col("x") / cell)).withColumn("by", F.floor(F.col("y") / cell))
    r = regions.select("region", "mosaic", F.col("x").alias("rx"), F.col("y").alias("ry"), "w", "h")
    r = r.withColumn("bx", F.explode(F.sequence(F.floor(F.col("rx") / cell), F.floor((F.col("rx") + F.col("w")) / cell))))
    r = r.withColumn("by", F.explode(F.sequence(F.floor(F.col("ry") / cell), F.floor((F.col("ry") + F.col("h")) / cell))))
    inside = (F.col("x") >= F.col("rx")) & (F.col("x") < F.col("rx") + F.col("w")) & (F.col("y") >= F.col("ry")) & (F.col("y") < F.col("ry") + F.col("h"))
    return e.join(r, ["mosaic", "bx", "by"]).where(inside).groupBy("region").agg(F.count("*").alias("n"), F.count_if(F.col("kind") == 1).alias("n_detected"), F.concat_ws(" ", F.array_sort(F.collect_list(F.concat_ws("-", "col", "row")))).alias("ids"))


def nearest_electrode(electrodes: DataFrame, points: DataFrame, radius: float = 30.0) -> DataFrame:
    """Nearest electrode within ``radius`` of each point ``(region, mosaic, x, y)`` (ties by col, row); points may have a smaller ``radius`` of their own."""
    e = electrodes.select("mosaic", "col", "row", F.col("x").alias("ex"), F.col("y").alias("ey"), F.floor(F.col("x") / radius).alias("bx"), F.floor(F.col("y") / radius).alias("by"))
    near = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    own = F.least(F.col("radius"), F.lit(radius)) if "radius" in points.columns else F.lit(radius)
    p = points.select("region", "mosaic", "x", "y", own.alias("own"), F.explode(near).alias("o"))
    p = p.select("region", "mosaic", "x", "y", "own", (F.floor(F.col("x") / radius) + F.col("o.i")).alias("bx"), (F.floor(F.col("y") / radius) + F.col("o.j")).alias("by"))
    d2 = (F.col("x") - F.col("ex")) ** 2 + (F.col("y") - F.col("ey")) ** 2
    found = p.join(e, ["mosaic", "bx", "by"]).withColumn("d2", d2).where(F.col("d2") <= F.col("own") * F.col("own"))
    best = found.groupBy("region").agg(F.min(F.struct("d2", "col", "row")).alias("best"))
    return best.select("region", F.col("best.col").alias("col"), F.col("best.row").alias("row"), F.round(F.sqrt("best.d2"), 6).alias("distance"))


def neighbour_steps(electrodes: DataFrame) -> DataFrame:
    """``(mosaic, col, row, axis, dx, dy)`` from each detected cell to the detected ones in the next column and the next row."""
    e = electrodes.where("kind = 1").select("mosaic", "col", "row", "x", "y")
    ends = F.array(*[F.struct(F.lit(a).alias("axis"), c.alias("c"), r.alias("r")) for a, c, r in (("col", F.col("col") - 1, F.col("row")), ("row", F.col("col"), F.col("row") - 1))])
    after = e.select("mosaic", F.col("x").alias("nx"), F.col("y").alias("ny"), F.explode(ends).alias("o")).select("mosaic", "nx", "ny", "o.axis", F.col("o.c").alias("col"), F.col("o.r").alias("row"))
    return e.join(after, ["mosaic", "col", "row"]).select("mosaic", "col", "row", "axis", (F.col("nx") - F.col("x")).alias("dx"), (F.col("ny") - F.col("y")).alias("dy"))


def step_statistics(electrodes: DataFrame) -> DataFrame:
    """Detected and inferred cells, and how far steps between detected neighbours are from the mean step along their axis."""
    steps = neighbour_steps(electrodes)
    mean = steps.groupBy("mosaic", "axis").agg(F.avg("dx").alias("mx"), F.avg("dy").alias("my"))
    off = F.hypot(F.col("dx") - F.col("mx"), F.col("dy") - F.col("my"))
    per = steps.join(mean, ["mosaic", "axis"]).groupBy("mosaic").agg(F.count("*").alias("n_steps"), F.round(F.median(off), 6).alias("median_px"), F.round(F.percentile(off, 0.95), 6).alias("p95_px"))
    found, all_ = F.count_if(F.col("kind") == 1), F.count_if(F.col("kind").isin(1, 2))
    cells = electrodes.groupBy("mosaic").agg(found.alias("n_detected"), F.count_if(F.col("kind") == 2).alias("n_inferred"), F.round(found / F.greatest(all_, F.lit(1)), 4).alias("detected_share"))
    return cells.join(per, "mosaic", "left")


def score(build: DataFrame, truth: DataFrame, ladder=(5, 10, 25, 50, 96, 256)) -> DataFrame:
    """Errors of a build against the truth, after the dataset's median shift."""
    t = truth.select("dataset", "trial", F.col("x").alias("tx"), F.col("y").alias("ty"))
    both = build.join(t, ["dataset", "trial"])
    shift = both.groupBy("dataset").agg(F.median(F.col("x") - F.col("tx")).alias("sx"), F.median(F.col("y") - F.col("ty")).alias("sy"))
    err = F.hypot(F.col("x") - F.col("tx") - F.col("sx"), F.col("y") - F.col("ty") - F.col("sy"))
    rows = both.join(shift, "dataset").withColumn("err", err)
    within = [F.count_if(F.col("err") <= t).alias(f"within_{t}") for t in ladder]
    return rows.groupBy("dataset").agg(F.count("*").alias("n_shared"), *within, F.round(F.median("err"), 6).alias("median_err"), F.round(F.percentile("err", 0.9), 6).alias("p90_err"))
