"""Scoring layouts against a truth: consensus shift, report, rotation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.plans.session import checkpointed

#: The tolerance of the headline score and the ladder reported beside it, in pixels.
TOLERANCE, LADDER, ROUNDS = 10.0, (5, 10, 25, 50, 96, 256), 20


def matched(build: DataFrame, truth: DataFrame, tolerance: float | None = TOLERANCE) -> DataFrame:
    """Shared tiles ``(dataset, trial, x, y, tx, ty, ox, oy, r)``, o the shift that would make the tile exact; a null tolerance keeps each tile's own r."""
    r = F.col("r").cast("double") if tolerance is None else F.lit(float(tolerance))
    t = truth.select("dataset", "trial", F.col("x").alias("tx"), F.col("y").alias("ty"), r.alias("r"))
    return build.select("dataset", "trial", "x", "y").join(t, ["dataset", "trial"]).withColumn("ox", F.col("tx") - F.col("x")).withColumn("oy", F.col("ty") - F.col("y"))


def consensus(points: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Per dataset the shift ``(sx, sy)`` that brings most points within their radius, refitted on those, and how many.

    Each distinct shift of a point is a candidate; more points win, then the smaller median distance of those inside,
    then the first trial. Equal shifts are counted together and only shifts in neighbouring cells of the largest
    radius are compared. Then the mean over the points inside takes the shift's place for as long as it keeps as many.
    """
    points = checkpointed(points)
    reach = points.agg(F.max("r")).first()[0] or 1.0
    reach = max(float(reach), 1e-9)
    cell = lambda c: F.floor(F.col(c) / reach)
    some = points.groupBy("dataset", "ox", "oy", "r").agg(F.count("*").alias("k"))
    candidates = points.groupBy("dataset", F.col("ox").alias("cx"), F.col("oy").alias("cy")).agg(F.min("trial").alias("first"))
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    asked = candidates.withColumn("o", F.explode(around)).withColumn("bx", cell("cx") + F.col("o.i")).withColumn("by", cell("cy") + F.col("o.j")).drop("o")
    d = F.hypot(F.col("ox") - F.col("cx"), F.col("oy") - F.col("cy"))
    met = asked.join(some.withColumn("bx", cell("ox")).withColumn("by", cell("oy")), ["dataset", "bx", "by"]).withColumn("d", d).where("d <= r")
    scored = met.groupBy("dataset", "cx", "cy", "first").agg(F.sum("k").alias("n"), F.percentile("d", 0.5, F.col("k")).alias("m"))
    best = scored.groupBy("dataset").agg(F.min(F.struct((-F.col("n")).alias("n"), "m", "first", "cx", "cy")).alias("b"))
    inside = lambda x, y: F.hypot(F.col("ox") - x, F.col("oy") - y) <= F.col("r")
    member = F.pmod(F.xxhash64("trial"), F.lit(1 << 40))
    now = best.select("dataset", F.col("b.cx").alias("sx"), F.col("b.cy").alias("sy"), F.lit(False).alias("done"))
    for _ in range(rounds):
        rows = points.join(now, "dataset")
        fit = rows.where(inside(F.col("sx"), F.col("sy"))).groupBy("dataset").agg(F.avg("ox").alias("fx"), F.avg("oy").alias("fy"), F.count("*").alias("n"), F.sum(member).alias("set"))
        new = points.join(fit, "dataset").where(inside(F.col("fx"), F.col("fy"))).groupBy("dataset").agg(F.count("*").alias("fn"), F.sum(member).alias("fset"))
        both = now.join(fit, "dataset").join(new, "dataset", "left")
        better = ~F.col("done") & (F.coalesce("fn", F.lit(0)) >= F.col("n"))
        now = checkpointed(both.select("dataset", F.when(better, F.col("fx")).otherwise(F.col("sx")).alias("sx"), F.when(better, F.col("fy")).otherwise(F.col("sy")).alias("sy"), (F.col("done") | ~better | (F.col("set") == F.col("fset"))).alias("done")))
        if now.where("not done").isEmpty():
            break
    n = points.join(now, "dataset").where(inside(F.col("sx"), F.col("sy"))).groupBy("dataset").agg(F.count("*").alias("n_inliers"))
    return now.join(n, "dataset").select("dataset", "sx", "sy", "n_inliers")


def report(build: DataFrame, truth: DataFrame, excluded: DataFrame, tolerance: float | None = TOLERANCE) -> DataFrame:
    """A row for each dataset of the truth that shares tiles with the build: counts over shared tiles and over all of the truth, errors, rotation, broken rules.

    ``excluded`` has trials that no build may place (J23).
    """
    points = checkpointed(matched(build, truth, tolerance))
    shift = checkpointed(consensus(points))
    rows = points.join(shift, "dataset").withColumn("err", F.hypot(F.col("x") + F.col("sx") - F.col("tx"), F.col("y") + F.col("sy") - F.col("ty")))
    ok = F.col("err") <= F.col("r")
    six = lambda c: F.round(c, 6)
    per = rows.groupBy("dataset").agg(
        F.count("*").alias("n_tiles"), F.count_if(ok).alias("n_correct"), six(100 * F.avg(ok.cast("int"))).alias("pct_correct"), six(F.median("err")).alias("median_err"), six(F.avg("err")).alias("mean_err"),
        six(F.sqrt(F.avg(F.col("err") ** 2))).alias("rmse"), six(F.percentile("err", 0.9)).alias("p90_err"), six(F.max("err")).alias("max_err"),
        *[six(100 * F.avg((F.col("err") <= t).cast("int"))).alias(f"pct_within_{t}") for t in LADDER],
    )
    all_ = truth.groupBy("dataset").agg(F.count("*").alias("n_gt"))
    missing = truth.join(build, ["dataset", "trial"], "left_anti").groupBy("dataset").agg(F.count("*").alias("n_missing"))
    broken = build.join(excluded.select("dataset", "trial").distinct(), ["dataset", "trial"], "left_semi").groupBy("dataset").agg(F.count("*").alias("n_excluded_placed"))
    rows = per.join(all_, "dataset").join(missing, "dataset", "left").join(broken, "dataset", "left").join(shift, "dataset").join(rotation(points, shift), "dataset", "left")
    return rows.select(
        *per.columns, "n_gt", F.coalesce("n_missing", F.lit(0)).alias("n_missing"), six(100 * F.col("n_correct") / F.col("n_gt")).alias("pct_of_gt"),
        F.coalesce("n_excluded_placed", F.lit(0)).alias("n_excluded_placed"), six(F.col("sx")).alias("sx"), six(F.col("sy")).alias("sy"), "n_inliers", "rot_deg",
    )


def rotation(points: DataFrame, shift: DataFrame) -> DataFrame:
    """Degrees by which the points inside are turned, from the sums of cross and dot products about their means; 0 for fewer than three."""
    rows = points.join(shift.select("dataset", "sx", "sy"), "dataset").where(F.hypot(F.col("ox") - F.col("sx"), F.col("oy") - F.col("sy")) <= F.col("r"))
    means = rows.groupBy("dataset").agg(*[F.avg(c).alias(f"m{c}") for c in ("x", "y", "tx", "ty")])
    of = lambda c: F.col(c) - F.col(f"m{c}")
    dot, cross = of("x") * of("tx") + of("y") * of("ty"), of("x") * of("ty") - of("y") * of("tx")
    angle = F.degrees(F.atan2(F.sum(cross), F.sum(dot)))
    return rows.join(means, "dataset").groupBy("dataset").agg(F.round(F.when(F.count("*") >= 3, angle).otherwise(0.0), 6).alias("rot_deg"))
