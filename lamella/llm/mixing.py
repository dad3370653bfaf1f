"""Mixing sources to target weights (operator 1), in DataFrame functions only.

Every source has a weight that varies over the training run, given as straight lines between knots. Integrating it
gives the source's cumulative demand; a document whose words start at the fraction ``q`` of the source's target is
needed where the demand reaches ``q``, so inverting the demand gives the training position, and documents are
range-sorted by it. Running word counts inside a source are two-level: sums of 4,096 hash buckets first, then a
window inside a bucket, so that a source with a third of all rows is spread over as many tasks as any other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamella.plans.session import checkpointed

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
#: Per weight class (time, weight) knots over the run: the heavy class fades out, the light one fades in.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 0.75), (1.0, 1.75)))


def word_count(text: str | Column) -> Column:
    """Number of words (runs of bytes other than the six ASCII spaces); null texts have none."""
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(WORD)), F.lit(0)).cast("long")


def inverse_demand(q: Column, knots: Sequence[tuple[float, float]]) -> Column:
    """Time at which the integral of the piecewise-linear schedule reaches the fraction ``q`` of its total."""
    total = sum((t1 - t0) * (a + b) / 2 for (t0, a), (t1, b) in zip(knots, knots[1:], strict=False))
    out, begin, cases = None, 0.0, []
    for (t0, a), (t1, b) in zip(knots, knots[1:], strict=False):
        area, slope = q * F.lit(total) - F.lit(begin), (b - a) / (t1 - t0)
        at = F.lit(t0) + (area / F.lit(a) if slope == 0 else (F.sqrt(F.lit(a * a) + F.lit(2 * slope) * area) - F.lit(a)) / F.lit(slope))
        begin += (t1 - t0) * (a + b) / 2
        cases.append((F.lit(begin), at))
    for end, at in reversed(cases):
        out = at if out is None else F.when(q * F.lit(total) <= end, at).otherwise(out)
    return out


def source_targets(sized: DataFrame, weights: Sequence[int], budget: float, passes: int) -> DataFrame:
    """``(skey, source_size, class, target)`` per source from rows ``(skey, size)``.

    One row per source enters the ordered windows; that table is as small as the number of sources. Sources sorted by
    (largest target / weight) fill up one after another; the first that the level of the rest doesn't fill, and all
    after it, get the level times their weight.
    """
    by_key, by_level, everything = Window.orderBy("skey"), Window.orderBy("ratio", "skey"), Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = sized.groupBy("skey").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("class", F.pmod(F.row_number().over(by_key) - 1, F.lit(len(weights))))
    s = s.withColumn("weight", F.array(*[F.lit(w) for w in weights])[F.col("class")]).withColumn("most", F.lit(passes) * F.col("source_size"))
    s = s.withColumn("ratio", F.col("most") / F.col("weight")).withColumn("rest", F.lit(budget) * F.sum("source_size").over(everything))
    before, onward = by_level.rowsBetween(Window.unboundedPreceding, -1), by_level.rowsBetween(0, Window.unboundedFollowing)
    s = s.withColumn("level", (F.col("rest") - F.coalesce(F.sum("most").over(before), F.lit(0))) / F.sum("weight").over(onward))
    s = s.withColumn("full", F.col("weight") * F.col("level") > F.col("most"))
    s = s.withColumn("level", F.max(F.when(~F.col("full"), F.col("level"))).over(everything))
    return s.select("skey", "source_size", "class", F.when(F.col("full"), F.col("most").cast("double")).otherwise(F.col("weight") * F.col("level")).alias("target"))


def mix(docs: DataFrame, carry: Sequence[str] = ("doc_id",), weights: Sequence[int] = WEIGHTS, budget: float = 1.5, passes: int = 2, schedules=SCHEDULES) -> DataFrame:
    """The mix: per row of ``docs`` ``row`` (struct of ``carry``), size, source_size, target, taken, takes, positions.

    ``takes[k]`` are the words taken in pass k (all, or the first ones of the document at the target's edge, or 0) and
    ``positions[k]`` in [0, 1] says where in training they come (null: not taken). Sources are ranked by code point,
    null last, and get the weights in turn; together they get ``budget`` times all words and none more than ``passes``
    times its own. Inside a source documents come in the order of the MD5 of their id, so reruns agree; for a null id
    the text's hash stands in, and rows equal in id and size are interchangeable. Null or empty texts have size 0 and are never
    taken. Extra columns are read only if carried.
    """
    draw = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.xxhash64("text").cast("string")))
    skey = F.coalesce(F.concat(F.lit("a"), F.col("source")), F.lit("b"))  # keeps code point order, null last
    sized = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"), skey.alias("skey"), draw.alias("draw"), F.substring(draw, 1, 3).alias("bucket"), F.col("doc_id").alias("id"), word_count("text").alias("size"))
    if "text" not in carry:  # narrow rows are stored, so that words are counted once
        sized = checkpointed(sized)
    sums = sized.groupBy("skey", "bucket").agg(F.sum("size").alias("size"))
    targets = source_targets(sums, weights, budget, passes).withColumnRenamed("skey", "tkey")
    offsets = sums.withColumn("begin", F.coalesce(F.sum("size").over(Window.partitionBy("skey").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    offsets = offsets.join(targets, F.col("skey") == F.col("tkey")).select("skey", "bucket", "begin", "source_size", "class", "target")
    inside = Window.partitionBy("skey", "bucket").orderBy("draw", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.join(offsets, ["skey", "bucket"]).withColumn("begin", F.col("begin") + F.coalesce(F.sum("size").over(inside), F.lit(0)))

    words = F.floor("target").cast("long")
    starts = [F.col("begin") + k * F.col("source_size") for k in range(passes)]
    takes = [F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), words - s)) for s in starts]

    def position(start: Column) -> Column:
        q, out = start / F.col("target"), None
        for k, knots in enumerate(schedules):
            at = inverse_demand(q, knots)
            out = F.when(F.col("class") % len(schedules) == k, at) if out is None else out.when(F.col("class") % len(schedules) == k, at)
        return out

    placed = placed.withColumn("takes", F.array(*takes)).withColumn("starts", F.array(*starts))
    return placed.select(
        "row", "size", "source_size", "target",
        F.aggregate("takes", F.lit(0).cast("long"), lambda x, y: x + y).alias("taken"), "takes",
        F.array(*[F.when(F.col("takes")[k] > 0, position(F.col("starts")[k])) for k in range(passes)]).alias("positions"),
    )


def in_training_order(mixed: DataFrame) -> DataFrame:
    """One row ``(row, words, size, position)`` per document and pass that the mix takes, range-sorted by position."""
    taken = mixed.select("row", "size", F.posexplode(F.arrays_zip("takes", "positions")).alias("pass", "take"))
    return taken.where("take.takes > 0").select("row", "size", F.col("take.takes").alias("words"), F.col("take.positions").alias("position")).orderBy("position")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """``docs`` as the mix has them: a row for each pass over a document, in training order.

    A document at the edge of its source's target is cut to the words taken (joined by single spaces); n_chars follows.
    """
    rows = in_training_order(mix(docs, carry=docs.columns, **options))
    cut = F.array_join(F.slice(F.regexp_extract_all(F.col("row.text"), F.lit(WORD), F.lit(0)), 1, F.col("words").cast("int")), " ")
    text = F.when(F.col("words") < F.col("size"), cut).otherwise(F.col("row.text"))
    named = {"text": text, "n_chars": F.when(F.col("words") < F.col("size"), F.length(text).cast("long")).otherwise(F.col("row.n_chars")) if "n_chars" in docs.columns else None}
    return rows.select(*[named.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
