"""Reviewing placed layouts: edits, refusals, staleness, evidence, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamella.functions.scalars import dataset_key

PLACED = ("anchor", "human", "unverified")
MOVED, THIN = 0.5, 0.10


def apply_edits(tiles: DataFrame, edits: DataFrame) -> DataFrame:
    """Tiles after an edit log ``(dataset, trial, seq, state, x, y)``; of a tile's edits the last counts.

    Excluding or unplacing a tile takes its position; an edit without position keeps it. ``moved_px`` follows the
    machine's position, and the edit's number stays with anchored and unverified tiles.
    """
    last = edits.groupBy("dataset", "trial").agg(F.max(F.struct("seq", "state", "x", "y")).alias("e"))
    rows = tiles.join(last, ["dataset", "trial"], "left")
    state = F.coalesce("e.state", "state")
    at = lambda c: F.when(~state.isin("excluded", "unplaced") | F.col("e").isNull(), F.coalesce(F.col(f"e.{c}"), F.col(c)))
    seq = F.when(state.isin("anchor", "unverified"), F.col("e.seq"))
    return rows.select("dataset", "trial", state.alias("state"), at("x").alias("x"), at("y").alias("y"), F.round(F.hypot(at("x") - F.col("mx"), at("y") - F.col("my")), 4).alias("moved_px"), seq.alias("seq"))


def edit_regions(regions: DataFrame, edits: DataFrame) -> DataFrame:
    """Regions ``(region, name, status)`` after one edit each ``(region, action, name)``: confirm, rename or delete; a blank name is refused."""
    rows = regions.join(edits.select("region", "action", F.trim("name").alias("to")), "region", "left")
    named = (F.col("action") == "rename") & (F.coalesce(F.length("to"), F.lit(0)) > 0)
    rows = rows.where("action IS NULL OR action <> 'delete'")
    return rows.select("region", F.when(named, F.col("to")).otherwise(F.col("name")).alias("name"), F.when(F.col("action") == "confirm", "confirmed").otherwise(F.col("status")).alias("status"))


def tracked_steps(steps: DataFrame, width: int, response: float = 0.30, share: float = 0.0625) -> DataFrame:
    """Which measurement of a step counts: over one frame, else over two, else none; a longer jump than ``share`` of the width a frame is none.

    ``steps`` has ``(video, frame, response1, step1, response2, step2)``.
    """
    gap = F.when(F.col("response1") >= response, 1).when(F.col("response2") >= response, 2)
    step = F.when(gap == 1, F.col("step1")).when(gap == 2, F.col("step2"))
    rows = steps.select("video", "frame", gap.alias("gap"), step.alias("step"))
    far = F.coalesce(F.col("step") > share * width * F.col("gap"), F.lit(True))
    return rows.select("video", "frame", F.when(~far, F.col("gap")).alias("gap"), F.when(~far, F.col("step")).alias("step"), far.alias("is_break"))


def belongs(documents: DataFrame, scopes: DataFrame, key: str = "document") -> DataFrame:
    """P20: whether a document ``(document, dataset_key, name, identity)`` belongs to the scope of the same ``document``; blanks abstain."""
    other = scopes.select(key, *[F.col(c).alias(f"o_{c}") for c in ("dataset_key", "name", "identity")])
    given = lambda c: F.nullif(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(""))
    same = F.lit(True)
    for c in ("dataset_key", "name", "identity"):
        same = same & F.coalesce(given(c) == given(f"o_{c}"), F.lit(True))
    return documents.join(other, key).select(key, same.alias("belongs"))


def match_refusals(targets: DataFrame, references: DataFrame, blank: DataFrame) -> DataFrame:
    """Why a target can't be matched: it is blank itself, or its dataset has no reference tile that isn't blank; with the number dropped."""
    b = blank.select("dataset", "trial").distinct().withColumn("blank", F.lit(True))
    left = references.select("dataset", "trial").distinct().join(b, ["dataset", "trial"], "left").groupBy("dataset").agg(F.count_if(F.col("blank")).alias("n_dropped"), F.count_if(F.col("blank").isNull()).alias("n_left"))
    rows = targets.select("dataset", "trial").join(b, ["dataset", "trial"], "left").join(left, "dataset", "left")
    reason = F.when(F.col("blank"), "blank").when(F.coalesce("n_left", F.lit(0)) == 0, "no_anchors")
    return rows.select("dataset", "trial", reason.alias("reason"), F.coalesce("n_dropped", F.lit(0)).alias("n_dropped"))


def unmeasured(candidates: DataFrame, links: DataFrame) -> DataFrame:
    """Candidate pairs without an accepted link ``(video, a, b, ok)``."""
    return candidates.join(links.where("ok").select("video", "a", "b"), ["video", "a", "b"], "left_anti")


def kept_links(old: DataFrame, new: DataFrame) -> DataFrame:
    """The old measurement of a pair unless it was rejected and the new one is accepted."""
    n = new.select("video", "a", "b", F.col("ok").alias("new_ok"), F.col("ncc").alias("new_ncc"))
    rows = old.join(n, ["video", "a", "b"], "full")
    better = F.col("ok").isNull() | (F.coalesce("new_ok", F.lit(False)) & ~F.coalesce("ok", F.lit(False)))
    return rows.select("video", "a", "b", F.when(better, F.col("new_ok")).otherwise(F.col("ok")).alias("ok"), F.when(better, F.col("new_ncc")).otherwise(F.col("ncc")).alias("ncc"))


def build_staleness(tiles: DataFrame, recorded: DataFrame, builds: DataFrame) -> DataFrame:
    """Builds ``(dataset)`` that were solved on other trials ``(dataset, trial)`` than the present ones; a build without recorded trials is stale.

    The gaps follow from the trials, so equal trials have equal gaps.
    """
    now = tiles.where("state <> 'excluded'").select("dataset", "trial", F.lit(1).alias("now"))
    was = recorded.select("dataset", "trial", F.lit(1).alias("was")).distinct()
    known = was.select("dataset").distinct().withColumn("known", F.lit(True))
    diff = now.join(was, ["dataset", "trial"], "full").groupBy("dataset").agg(F.count_if(F.col("now").isNull()).alias("n_dropped"), F.count_if(F.col("was").isNull()).alias("n_added"))
    rows = builds.select("dataset").distinct().join(diff, "dataset", "left").join(known, "dataset", "left")
    reason = F.when(F.col("known").isNull(), "unrecorded").when(F.col("n_dropped") + F.col("n_added") > 0, "trials_changed")
    n = lambda c: F.when(F.col("known"), F.coalesce(c, F.lit(0)))
    return rows.select("dataset", n("n_dropped").alias("n_dropped"), n("n_added").alias("n_added"), reason.alias("reason"))


def rechecked(tiles: DataFrame, measured: DataFrame, tolerance: float = 5.0) -> DataFrame:
    """Flagged tiles (``stale``) against where they measure best ``(dataset, trial, bx, by)``; unmeasured ones stay flagged, anchors are never asked."""
    rows = tiles.where("stale AND state <> 'anchor'").join(measured.select("dataset", "trial", "bx", "by"), ["dataset", "trial"], "left")
    d = F.hypot(F.col("bx") - F.coalesce("x", F.lit(0.0)), F.col("by") - F.coalesce("y", F.lit(0.0)))
    return rows.select("dataset", "trial", F.round(d, 2).alias("disagree_px"), F.coalesce(d > tolerance, F.lit(True)).alias("stale"))


def recompute_targets(tiles: DataFrame, frames: DataFrame) -> DataFrame:
    """Tiles with a frame that nobody has anchored, placed by hand or excluded."""
    return tiles.where("state NOT IN ('anchor', 'human', 'excluded')").select("dataset", "trial").join(frames.select("dataset", "trial").distinct(), ["dataset", "trial"], "left_semi")


def build_evidence(positions: DataFrame, anchors: DataFrame, runs: DataFrame, splits: DataFrame) -> DataFrame:
    """Per tile its anchor's ncc and distance, its run and the run's margin, its pass.

    ``anchors`` has ``(dataset, trial, ncc, ax, ay)`` from the corner of pass 1, ``runs`` ``(dataset, run, trials, margin)``.
    """
    corner = positions.join(splits.select("dataset", "split"), "dataset").where("trial <= split").groupBy("dataset").agg(F.min("x").alias("cx"), F.min("y").alias("cy"))
    of = runs.select("dataset", "run", F.col("margin").alias("run_margin"), F.explode("trials").alias("trial"))
    rows = positions.join(splits.select("dataset", "split"), "dataset", "left").join(corner, "dataset", "left")
    rows = rows.join(anchors.select("dataset", "trial", F.col("ncc").alias("anchor_ncc"), "ax", "ay"), ["dataset", "trial"], "left").join(of, ["dataset", "trial"], "left")
    residual = F.when(F.col("anchor_ncc").isNotNull(), F.hypot(F.col("ax") + F.col("cx") - F.col("x"), F.col("ay") + F.col("cy") - F.col("y")))
    return rows.select("dataset", "trial", "anchor_ncc", F.round(residual, 6).alias("anchor_residual_px"), "run", "run_margin", F.when(F.col("trial") <= F.col("split"), 1).otherwise(2).alias("pass"))


def region_ids(videos: DataFrame) -> DataFrame:
    """Ids of recordings ``(path)``: ten hex digits of the SHA-1 of the lower-cased path; paths that share them are numbered from 2 on."""
    base = videos.select("path", F.substring(F.sha1(F.lower("path")), 1, 10).alias("base"))
    k = F.row_number().over(Window.partitionBy("base").orderBy("path"))
    rows = base.withColumn("k", k)
    return rows.select("path", F.when(F.col("k") == 1, F.col("base")).otherwise(F.concat_ws("-", "base", F.col("k").cast("string"))).alias("region_id"), dataset_key(F.col("path")).alias("key"))


def guarded_steps(steps: DataFrame, challengers: DataFrame, gain: float = 0.05) -> DataFrame:
    """A pair's measured shift gives way only to one whose ncc is higher by ``gain``."""
    c = challengers.select("dataset", "a", "b", F.col("dx").alias("cx"), F.col("dy").alias("cy"), F.col("ncc").alias("cn"))
    rows = steps.join(c, ["dataset", "a", "b"], "left")
    better = F.coalesce(F.col("cn") - F.col("ncc") >= gain, F.lit(False))
    pick = lambda new, old: F.when(better, F.col(new)).otherwise(F.col(old)).alias(old)
    return rows.select("dataset", "a", "b", pick("cx", "dx"), pick("cy", "dy"), pick("cn", "ncc"), better.alias("moved"))


def rule_breaks(build: DataFrame, tiles: DataFrame) -> DataFrame:
    """Excluded trials that a build has placed all the same."""
    return build.select("dataset", "trial").join(tiles.where("state = 'excluded'").select("dataset", "trial"), ["dataset", "trial"], "left_semi")


def quality_report(tiles: DataFrame, staleness: DataFrame) -> DataFrame:
    """A document's numbers: tiles, those not excluded (the denominator of every share), moved ones and the worst, thin margins, rescued ones, gaps, staleness."""
    d = F.round(F.hypot(F.col("x") - F.col("mx"), F.col("y") - F.col("my")), 4)
    placed = F.col("state").isin(*PLACED) & F.col("x").isNotNull()
    after = F.lead(F.when(F.col("state") != "excluded", F.col("trial")), 1).over(Window.partitionBy("dataset", F.col("state") == "excluded").orderBy("trial"))
    rows = tiles.select("dataset", "trial", "state", F.when(placed, d).alias("d"), placed.alias("placed"), "mx", "margin", (after - F.col("trial") > 1).alias("gap"))
    moved = F.col("d") >= MOVED
    per = rows.groupBy("dataset").agg(
        F.count("*").alias("n_tiles"), F.count_if(F.col("state") != "excluded").alias("n_active"), F.count_if(F.col("state") == "excluded").alias("n_excluded"),
        *[F.count_if(F.col("state") == s).alias(f"n_{s}") for s in PLACED], F.count_if(moved).alias("n_moved"),
        F.max(F.when(moved, F.struct("d", (-F.col("trial")).alias("t")))).alias("worst"), F.count_if(F.col("placed") & (F.col("margin") < THIN)).alias("n_thin"),
        F.count_if(F.col("placed") & F.col("mx").isNull()).alias("without"), F.count("mx").alias("n_machine"), F.count_if(F.col("gap")).alias("n_gaps"),
    )
    per = per.join(staleness.select("dataset", "reason"), "dataset", "left")
    return per.select(
        "dataset", "n_tiles", "n_active", "n_excluded", *[f"n_{s}" for s in PLACED], "n_moved", F.col("worst.d").alias("most_moved"), (-F.col("worst.t")).alias("worst_trial"),
        "n_thin", F.when(F.col("n_machine") > 0, F.col("without")).otherwise(0).alias("n_rescued"), "n_gaps", F.col("reason").isNotNull().alias("build_stale"), F.round(F.col("n_moved") / F.nullif(F.col("n_active"), F.lit(0)), 6).alias("moved_share"),
    )


def run_statistics(runs: DataFrame) -> DataFrame:
    """Number of runs, the smallest margin, and the largest run (ties go to the first)."""
    return runs.groupBy("dataset").agg(F.count("*").alias("n_runs"), F.min("margin").alias("min_margin"), F.max(F.struct("n", (-F.col("run")).alias("r"))).alias("big")).select("dataset", "n_runs", "min_margin", (-F.col("big.r")).alias("biggest_run"), F.col("big.n").alias("biggest_n"))


def ranked_candidates(candidates: DataFrame, most: int = 9) -> DataFrame:
    """L1: the ``most`` best candidates ``(dataset, target, x, y, ncc)`` of each target, from rank 0; equal ones by position."""
    rank = F.row_number().over(Window.partitionBy("dataset", "target").orderBy(F.desc("ncc"), "x", "y")) - 1
    return candidates.withColumn("rank", rank).where(F.col("rank") < most)


def worst_tiles(errors: DataFrame, most: int = 10) -> DataFrame:
    """The ``most`` tiles of each dataset with the largest error ``(dataset, trial, err)``."""
    rank = F.row_number().over(Window.partitionBy("dataset").orderBy(F.desc("err"), "trial"))
    return errors.withColumn("rank", rank.cast("long")).where(F.col("rank") <= most)


def wanted_kinds(requests: DataFrame) -> DataFrame:
    """The kinds of output a request ``(request, kinds)`` names, each once, in order."""
    return requests.select("request", F.posexplode(F.array_distinct("kinds")).alias("place", "kind"))


def chosen_stills(matches: DataFrame) -> DataFrame:
    """Of a recording's stills ``(recording, still, margin, ncc)`` the one with the largest margin to four decimals, then ncc; nulls count as -1."""
    order = F.struct(F.round(F.coalesce("margin", F.lit(-1.0)), 4).alias("m"), F.coalesce("ncc", F.lit(-1.0)).alias("n"), "still")
    return matches.groupBy("recording").agg(F.max(order).alias("best")).select("recording", "best.still")


def tints(evidence: DataFrame, pure: float = 0.985, grey: float = 0.30) -> DataFrame:
    """The tint (b, g, r with the largest 1) of ``(video, n_px, n_frames, cb, cg, cr)``, mean unit colours; null unless there is one hue, off grey."""
    top, low = F.greatest("cb", "cg", "cr"), F.least("cb", "cg", "cr")
    length = F.least(F.lit(1.0), F.sqrt(F.col("cb") ** 2 + F.col("cg") ** 2 + F.col("cr") ** 2))
    ok = (F.col("n_frames") >= 1) & (F.col("n_px") >= 64) & (top > 1e-6) & (length >= pure) & (low / top <= grey)
    return evidence.select("video", F.round(length, 6).alias("hue"), *[F.when(ok, F.round(F.col(c) / top, 6)).alias(f"t{c[1]}") for c in ("cb", "cg", "cr")])
