"""Runs, gaps and timing splits of acquisition logs; frame inventories."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SIDE = 0.2


def snapshots(entries: DataFrame) -> DataFrame:
    return entries.where("type = 'Snapshot'")


def _in_file(entries: DataFrame) -> str:
    """What the entries of a log are ordered by: their line, or the trial where they have none."""
    return "line_no" if "line_no" in entries.columns else "trial"


def snapshot_gaps(entries: DataFrame) -> DataFrame:
    """Seconds since the previous snapshot in the dataset's log, to one decimal; null for the first."""
    before = F.lag("us").over(Window.partitionBy("dataset").orderBy(_in_file(entries)))
    return snapshots(entries).select("dataset", "trial", (F.floor((F.col("us") - before + 50_000) / 100_000) / 10.0).alias("gap_s"))


def blocks(entries: DataFrame) -> DataFrame:
    """Maximal stretches of adjacent snapshot trials."""
    island = F.col("trial") - F.row_number().over(Window.partitionBy("dataset").orderBy("trial"))
    return snapshots(entries).withColumn("island", island).groupBy("dataset", "island").agg(F.min("trial").alias("lo"), F.max("trial").alias("hi"), F.count("*").alias("n")).drop("island")


def longest_block(entries: DataFrame) -> DataFrame:
    """The run of each dataset is its longest block, the earliest of equal ones."""
    best = F.max(F.struct(F.col("n"), (-F.col("lo")).alias("first"), F.col("hi"))).alias("best")
    return blocks(entries).groupBy("dataset").agg(best).select("dataset", (-F.col("best.first")).alias("lo"), F.col("best.hi").alias("hi"), F.col("best.n").alias("n"))


def chosen_run(entries: DataFrame, ranges: DataFrame) -> DataFrame:
    """The run of each dataset: the range ``(dataset, lo, hi)`` that a user gave, refused if lo > hi, else the longest block; with the reason."""
    asked = ranges.select("dataset", F.col("lo").alias("ulo"), F.col("hi").alias("uhi"))
    n = entries.select("dataset", "trial", "type").join(asked, "dataset").where("type = 'Snapshot' AND trial BETWEEN ulo AND uhi").groupBy("dataset").agg(F.count("*").alias("un"))
    rows = longest_block(entries).join(asked, "dataset", "full").join(n, "dataset", "left")
    own = F.col("ulo").isNotNull() & F.col("uhi").isNotNull()
    why = F.when(own & (F.col("ulo") > F.col("uhi")), "refused").when(own, "asked").otherwise("longest")
    pick = lambda a, b: F.when(why == "asked", F.col(a)).when(why == "longest", F.col(b))
    return rows.select("dataset", pick("ulo", "lo").alias("lo"), pick("uhi", "hi").alias("hi"), F.when(why == "asked", F.coalesce("un", F.lit(0))).when(why == "longest", F.col("n")).alias("n"), why.alias("why"))


def square(meta: DataFrame, side: int = 512) -> DataFrame:
    """Trials whose frames are squares of ``side``, the ones a run of square frames is chosen from."""
    return meta.where((F.col("w") == side) & (F.col("h") == side)).select("dataset", "trial")


def gaps(entries: DataFrame) -> DataFrame:
    """Consecutive snapshots that aren't adjacent."""
    after = F.lead("trial").over(Window.partitionBy("dataset").orderBy("trial"))
    return snapshots(entries).select("dataset", F.col("trial").alias("before"), after.alias("after")).where("after > before + 1")


def timing_split(entries: DataFrame) -> DataFrame:
    """The last trial before the longest interior pause, its median, and whether it is decisive.

    A fifth of all steps (half-even, at least one) is left out on either side; equal pauses go to the earliest; a
    dataset without candidates is undetected and counts all its snapshots before the split.
    """
    by, all_ = Window.partitionBy("dataset").orderBy("trial"), Window.partitionBy("dataset")
    steps = snapshot_gaps(entries).select("dataset", "trial", F.lead("gap_s").over(by).alias("gap"), (F.row_number().over(by) - 1).alias("i"), F.count("gap_s").over(all_).alias("n"))
    m = F.greatest(F.lit(1), F.bround(F.lit(SIDE) * F.col("n")).cast("int"))
    inside = F.col("gap").isNotNull() & (F.col("i") >= m) & (F.col("i") < F.col("n") - m)
    # the two longest pauses inside, the earlier of equal ones first; an acquisition has some hundreds
    pause = F.when(inside, F.struct("gap", (-F.col("trial")).alias("t"), "i"))
    top = F.slice(F.sort_array(F.collect_list(pause), asc=False), 1, 2)
    per = steps.groupBy("dataset").agg(F.median("gap").alias("median_gap_s"), F.count("*").alias("trials"), top.alias("top"))
    first, second = F.try_element_at("top", F.lit(1)), F.try_element_at("top", F.lit(2))
    per = per.select("dataset", (-first["t"]).alias("split"), first["gap"].alias("gap_s"), "median_gap_s", second["gap"].alias("runner_up_s"), "trials", (first["i"] + 1).cast("long").alias("before"))
    decisive = F.coalesce((F.col("gap_s") > 2 * F.col("median_gap_s")) & (F.col("runner_up_s").isNull() | (F.col("gap_s") >= 2 * F.col("runner_up_s"))), F.lit(False))
    n_before = F.coalesce("before", "trials")
    return per.select("dataset", "split", "gap_s", "median_gap_s", "runner_up_s", decisive.alias("decisive"), n_before.alias("n_before"), (F.col("trials") - n_before).alias("n_after"))


def run_summary(entries: DataFrame) -> DataFrame:
    """Which trials are the run of each dataset, where does it split, how many blocks and gaps has it?"""
    n_gaps = gaps(entries).groupBy("dataset").agg(F.count("*").alias("n_gaps"))
    n_blocks = blocks(entries).groupBy("dataset").agg(F.count("*").alias("n_blocks"))
    joined = longest_block(entries).join(timing_split(entries), "dataset").join(n_blocks, "dataset").join(n_gaps, "dataset", "left")
    return joined.select("dataset", "lo", "hi", "n", "split", "gap_s", "decisive", "n_blocks", F.coalesce("n_gaps", F.lit(0)).alias("n_gaps"))


def log_counts(entries: DataFrame) -> DataFrame:
    """A1: snapshots and others, types of the log's first and last entry."""
    place = _in_file(entries)
    return entries.groupBy("dataset").agg(F.count_if(F.col("type") == "Snapshot").alias("n_snapshots"), F.count_if(F.col("type") != "Snapshot").alias("n_others"), F.min_by("type", place).alias("first_type"), F.max_by("type", place).alias("last_type"))


def median_gap(entries: DataFrame) -> DataFrame:
    """A5: median pause between snapshots."""
    return snapshot_gaps(entries).groupBy("dataset").agg(F.median("gap_s").alias("median_gap_s"))


def shape_groups(meta: DataFrame) -> DataFrame:
    """A2: frames by shape with their trials in order, the most frequent shape first; an acquisition has some hundreds of trials."""
    listed = F.concat_ws(" ", F.array_sort(F.collect_list("trial")))
    counts = meta.groupBy("dataset", "w", "h").agg(F.count("*").alias("n"), F.min("trial").alias("first"), F.max("trial").alias("last"), listed.alias("trials"))
    return counts.withColumn("place", F.row_number().over(Window.partitionBy("dataset").orderBy(F.desc("n"), "w", "h")).cast("long"))


def shape_gate(entries: DataFrame, meta: DataFrame, side: int = 512) -> DataFrame:
    """Of every trial in a dataset's logged range, why it is dropped (null: kept)."""
    span = entries.groupBy("dataset").agg(F.min("trial").alias("lo"), F.max("trial").alias("hi"))
    every = span.select("dataset", F.explode(F.sequence("lo", "hi")).alias("trial"))
    seen = every.join(meta.select("dataset", "trial", "w", "h"), ["dataset", "trial"], "left")
    return seen.select("dataset", "trial", F.when(F.col("w").isNull(), "not_snapshot").when((F.col("w") != side) | (F.col("h") != side), "off_shape").alias("reason"))


def log_and_frames(entries: DataFrame, meta: DataFrame) -> DataFrame:
    """Log joined with the inventory; which side a trial is missing on."""
    a = snapshots(entries).select("dataset", "trial", F.lit(1).alias("logged"))
    b = meta.select("dataset", "trial", F.lit(1).alias("framed"))
    side = F.when(F.col("framed").isNull(), "no_frame").when(F.col("logged").isNull(), "no_log").otherwise("both")
    return a.join(b, ["dataset", "trial"], "full").select("dataset", "trial", side.alias("side"))
