"""Registered queries over the survey views, with the SQL each is held against."""

from __future__ import annotations

from pyspark.sql import functions as F

from lamella.operators import acquisition as acq
from lamella.functions.scalars import hit_radius
from lamella.operators import documents, layout, matching, pixels, tracks
from lamella.plans import measuring, survey  # noqa: F401  registers its queries with survey's
from lamella.sources import logs, views
from lamella.streaming import tracks as live

V = views.TABLES


def _over(function, *tables):
    return lambda spark, sf_dir: function(*(V[t](spark, sf_dir) for t in tables))


#: Of the links view.
_LIMITS = {"response": 0.2, "limits": {"seq": (0.06, 60.0), "cross": (0.12, 60.0), "bridge": (0.06, 60.0)}}

QUERIES = {
    "run_summary": _over(acq.run_summary, "entries"),
    "snapshot_gaps": _over(acq.snapshot_gaps, "entries"),
    "blocks": _over(acq.blocks, "entries"),
    "longest_block": _over(acq.longest_block, "entries"),
    "acquisition_gaps": _over(acq.gaps, "entries"),
    "timing_split": _over(acq.timing_split, "entries"),
    "log_counts": _over(acq.log_counts, "entries"),
    "median_gap": _over(acq.median_gap, "entries"),
    "shape_groups": _over(acq.shape_groups, "trial_meta"),
    "shape_gate": _over(acq.shape_gate, "entries", "trial_meta"),
    "log_and_frames": _over(acq.log_and_frames, "entries", "trial_meta"),
    "state_counts": _over(layout.state_counts, "tiles"),
    "placed_tiles": _over(layout.placed, "tiles"),
    "moved_tiles": _over(layout.moved, "tiles"),
    "nearby_pairs": _over(layout.nearby_pairs, "tiles"),
    "link_verdicts": lambda spark, sf_dir: layout.link_verdicts(views.links(spark, sf_dir), **_LIMITS).groupBy("dataset", "verdict").agg(F.count("*").alias("n")),
    "link_verdict_rows": lambda spark, sf_dir: layout.link_verdicts(views.links(spark, sf_dir), **_LIMITS).select("dataset", "a", "b", "kind", "verdict"),
    "link_statistics": lambda spark, sf_dir: layout.link_statistics(views.links(spark, sf_dir), **_LIMITS),
    "top_links": _over(layout.top_links, "links"),
    "match_margins": _over(layout.margins, "links"),
    "rigid_runs": _over(layout.rigid_runs, "tiles"),
    "link_components": lambda spark, sf_dir: layout.link_components(views.links(spark, sf_dir), **_LIMITS),
    "electrodes_in_regions": _over(layout.electrodes_in_regions, "electrodes", "regions"),
    "nearest_electrode": lambda spark, sf_dir: layout.nearest_electrode(views.electrodes(spark, sf_dir), views.regions(spark, sf_dir).withColumn("radius", hit_radius(F.lit(4.2), F.lit(14.0), (1 + F.col("region") % 5) / 4.0))),
    "step_statistics": _over(layout.step_statistics, "electrodes"),
    "build_score": lambda spark, sf_dir: layout.score(views.tiles(spark, sf_dir).select("dataset", "trial", F.col("mx").alias("x"), F.col("my").alias("y")), views.tiles(spark, sf_dir).where("state = 'anchor'")),
}

def _with_split(function):
    def query(spark, sf_dir):
        entries = views.entries(spark, sf_dir)
        return function(acq.snapshots(entries), acq.timing_split(entries))

    return query


def _kept(spark, sf_dir):
    """Trial lists for rescoping: three of four trials, and some that no tile has."""
    t = views.tiles(spark, sf_dir)
    return t.where("trial % 4 <> 0").select("dataset", "trial").unionByName(t.where("trial % 50 = 0").select("dataset", (F.col("trial") + 1_000_000).alias("trial")))


def _own_links(spark, sf_dir):
    """Links keyed by the dataset of their first tile."""
    return views.links(spark, sf_dir).withColumn("dataset", F.floor(F.col("a") / 20))


def _keyed(tiles):
    """Tiles where the machine placed none in datasets 3 and 4, and the sixth unplaced."""
    rows = tiles.withColumn("r", F.when(F.col("trial") % 3 == 0, 40.0).when(F.col("trial") % 5 == 0, 256.0)).withColumn("last_x", F.when(F.col("state") == "excluded", F.col("x"))).withColumn("last_y", F.when(F.col("state") == "excluded", F.col("y")))
    return rows.withColumn("mx", F.when(~F.col("dataset").isin(3, 4), F.col("mx"))).withColumn("x", F.when(F.col("trial") % 6 != 0, F.col("x")))


def _stale(spark, sf_dir):
    """Stamps recorded before every seventh tile moved by a quarter of a pixel; none recorded for every fifth dataset."""
    t = views.tiles(spark, sf_dir)
    return documents.stale(documents.position_stamp(t.withColumn("x", F.col("x") + F.when(F.col("trial") % 77 == 0, 0.25).otherwise(0.0))), documents.position_stamp(t.where("dataset % 5 <> 0")))


def _stateless(tiles):
    """Tiles with a status of their own, some unknown, and a state only in every third."""
    status = F.when(F.col("trial") % 5 == 0, "odd").otherwise(F.col("state"))
    return tiles.select("dataset", "trial", F.when(F.col("trial") % 3 == 0, F.col("state")).alias("state"), status.alias("status"), F.when(F.col("trial") % 4 != 0, F.col("x")).alias("x"), "y")


QUERIES |= {
    "confident_matches": lambda spark, sf_dir: matching.confident(views.tiles(spark, sf_dir).select("dataset", "trial", "margin", "ncc")),
    "tile_states": lambda spark, sf_dir: documents.tile_states(_stateless(views.tiles(spark, sf_dir))).select("dataset", "trial", "state"),
    "chain_breaks": _with_split(documents.chain_breaks),
    "parsed_log": lambda spark, sf_dir: logs.parse(views.log_lines(spark, sf_dir)).select("dataset", "trial", "type", "s"),
    "track_segments": _over(tracks.segments, "frame_track"),
    "black_shoulders": _over(tracks.shoulders, "frame_track"),
    "dwells": _over(tracks.dwells, "frame_track"),
    "travel_keyframes": _over(tracks.travel_keyframes, "frame_track"),
    "sequential_candidates": lambda spark, sf_dir: tracks.sequential_candidates(tracks.travel_keyframes(views.frame_track(spark, sf_dir))),
    "bridge_candidates": lambda spark, sf_dir: tracks.bridge_candidates(tracks.travel_keyframes(views.frame_track(spark, sf_dir))),
    "track_statistics": _over(tracks.track_statistics, "frame_track"),
    "sampled_frames": _over(tracks.sampled_frames, "frame_track"),
    "activity": _over(tracks.activity, "frame_track"),
    "live_keyframes": live.live_keyframes,
    "normalised_layout": lambda spark, sf_dir: documents.normalised(_keyed(views.tiles(spark, sf_dir))),
    "provenance": lambda spark, sf_dir: documents.provenance(_keyed(views.tiles(spark, sf_dir)), views.tiles(spark, sf_dir).where("dataset % 3 = 0").select("dataset", F.lit("b").alias("build"))),
    "trusted_matches": lambda spark, sf_dir: documents.trusted(views.tiles(spark, sf_dir).withColumn("margin", F.when(F.col("trial") % 4 != 0, F.col("margin"))), apart=5.0),
    "rescoped_tiles": lambda spark, sf_dir: documents.rescoped(_keyed(views.tiles(spark, sf_dir)), _kept(spark, sf_dir)),
    "without_machine": _over(documents.without_machine, "tiles"),
    "solvable": _with_split(documents.solvable),
    "blank_proposal": _with_split(documents.blank_proposal),
    "edit_tallies": lambda spark, sf_dir: documents.edit_tallies(_keyed(views.tiles(spark, sf_dir))),
    "residual_statistics": lambda spark, sf_dir: documents.residual_statistics(_own_links(spark, sf_dir), views.tiles(spark, sf_dir)),
    "tile_quality": _over(documents.tile_quality, "links"),
    "leaderboard": _over(documents.leaderboard, "links"),
    "gated_links": lambda spark, sf_dir: documents.gated_links(_own_links(spark, sf_dir), layout.rigid_runs(views.tiles(spark, sf_dir))),
    "covered_blocks": _over(documents.covered_blocks, "tiles"),
    "seed_shift": _over(documents.seed_shift, "tiles"),
    "position_stamp": _over(documents.position_stamp, "tiles"),
    "stale_artefacts": _stale,
    "tile_neighbours": _over(documents.neighbours, "tiles"),
    "edge_trim": _over(documents.edge_trim, "electrodes"),
    "zoom_consensus": _over(documents.zoom_consensus, "readings"),
    "pixel_statistics": _over(pixels.pixel_statistics, "frames8"),
    "exposure": _over(pixels.exposure, "frames8"),
    "peaks": _over(pixels.peaks, "frames8"),
    "composite": _over(pixels.composite, "frames8"),
}

_SNAP = "s AS (SELECT * FROM entries WHERE type = 'Snapshot')"
_GAPS = _SNAP + ", g AS (SELECT dataset, trial, floor((us - lag(us) OVER (PARTITION BY dataset ORDER BY trial) + 50000) / 100000.0) / 10.0 AS gap_s FROM s)"
_BLOCKS = _SNAP + """, i AS (SELECT dataset, trial, trial - row_number() OVER (PARTITION BY dataset ORDER BY trial) AS island FROM s),
  b AS (SELECT dataset, min(trial) AS lo, max(trial) AS hi, count(*) AS n FROM i GROUP BY dataset, island)"""
_LONGEST = _BLOCKS + ", l AS (SELECT dataset, lo, hi, n FROM b QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY n DESC, lo) = 1)"
_HOLES = "h AS (SELECT dataset, trial AS before, lead(trial) OVER (PARTITION BY dataset ORDER BY trial) AS after FROM s QUALIFY after > before + 1)"
_SPLIT = """g AS (SELECT dataset, trial, floor((us - lag(us) OVER (PARTITION BY dataset ORDER BY trial) + 50000) / 100000.0) / 10.0 AS gap_s FROM s),
  t AS (SELECT dataset, trial, lead(gap_s) OVER (PARTITION BY dataset ORDER BY trial) AS gap FROM g),
  p AS (SELECT dataset, count(gap) AS n, median(gap) AS median_gap_s, count(*) AS trials FROM t GROUP BY dataset),
  c AS (SELECT t.dataset, trial, gap, n, row_number() OVER (PARTITION BY t.dataset ORDER BY trial) - 1 AS i FROM t JOIN p USING (dataset) WHERE gap IS NOT NULL),
  r AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY gap DESC, trial) AS k FROM c
        WHERE i >= greatest(1, round_even(0.2 * n, 0)::INT) AND i < n - greatest(1, round_even(0.2 * n, 0)::INT)),
  o AS (SELECT dataset, max(CASE WHEN k = 1 THEN trial END) AS split, max(CASE WHEN k = 1 THEN gap END) AS gap_s, max(CASE WHEN k = 2 THEN gap END) AS runner_up_s FROM r GROUP BY dataset),
  d AS (SELECT t.dataset, count(*) AS n_before FROM t JOIN o USING (dataset) WHERE trial <= split GROUP BY t.dataset),
  z AS (SELECT dataset, split, gap_s, median_gap_s, runner_up_s, coalesce(gap_s > 2 * median_gap_s AND (runner_up_s IS NULL OR gap_s >= 2 * runner_up_s), false) AS decisive,
        coalesce(n_before, trials) AS n_before, trials - coalesce(n_before, trials) AS n_after FROM p LEFT JOIN o USING (dataset) LEFT JOIN d USING (dataset))"""
_SHARED = "CASE WHEN abs({x}) > 480 OR abs({y}) > 480 THEN 0 ELSE floor((512 - abs({x})) / 16) * 16 * floor((512 - abs({y})) / 16) * 16 END"
_VERDICT = f"""s AS (SELECT *, {_SHARED.format(x="px", y="py")} AS at_prior, {_SHARED.format(x="dx", y="dy")} AS at_measured, CASE kind WHEN 'cross' THEN 0.12 ELSE 0.06 END * 512 * 512 AS area FROM links),
  v AS (SELECT *, CASE WHEN at_prior = 0 OR at_prior < area THEN 'no_overlap_at_prior' WHEN response < 0.2 THEN 'weak_phase_response' WHEN sqrt((dx - px) ** 2 + (dy - py) ** 2) > 60 THEN 'correction_too_large'
  WHEN at_measured = 0 OR at_measured < area THEN 'no_overlap_at_measured' WHEN ncc < 0.3 THEN 'low_ncc_at_measured' ELSE 'ok' END AS verdict FROM s)"""
_PAIRS = "p AS (SELECT dataset, a, b, max(ncc) AS ncc FROM links GROUP BY dataset, a, b)"

_SQL = {
    "run_summary": ("entries", _LONGEST + ", " + _HOLES + ", " + _SPLIT, """SELECT l.dataset, lo, hi, l.n, split, gap_s, decisive, n_blocks, coalesce(n_gaps, 0) AS n_gaps FROM l JOIN z USING (dataset)
      JOIN (SELECT dataset, count(*) AS n_blocks FROM b GROUP BY dataset) USING (dataset) LEFT JOIN (SELECT dataset, count(*) AS n_gaps FROM h GROUP BY dataset) USING (dataset)"""),
    "snapshot_gaps": ("entries", _GAPS, "SELECT * FROM g"),
    "blocks": ("entries", _BLOCKS, "SELECT * FROM b"),
    "longest_block": ("entries", _LONGEST, "SELECT * FROM l"),
    "acquisition_gaps": ("entries", _SNAP + ", " + _HOLES, "SELECT * FROM h"),
    "timing_split": ("entries", _SNAP + ", " + _SPLIT, "SELECT * FROM z"),
    "log_counts": ("entries", "", "SELECT dataset, count(*) FILTER (type = 'Snapshot') AS n_snapshots, count(*) FILTER (type <> 'Snapshot') AS n_others, arg_min(type, trial) AS first_type, arg_max(type, trial) AS last_type FROM entries GROUP BY dataset"),
    "median_gap": ("entries", _GAPS, "SELECT dataset, median(gap_s) AS median_gap_s FROM g GROUP BY dataset"),
    "shape_groups": ("trial_meta", "", "SELECT dataset, w, h, count(*) AS n, min(trial) AS first, max(trial) AS last, string_agg(trial, ' ' ORDER BY trial) AS trials, row_number() OVER (PARTITION BY dataset ORDER BY count(*) DESC, w, h) AS place FROM trial_meta GROUP BY dataset, w, h"),
    "shape_gate": ("entries trial_meta", "q AS (SELECT dataset, unnest(range(min(trial), max(trial) + 1)) AS trial FROM entries GROUP BY dataset)",
      "SELECT q.dataset, q.trial, CASE WHEN w IS NULL THEN 'not_snapshot' WHEN w <> 512 OR h <> 512 THEN 'off_shape' END AS reason FROM q LEFT JOIN trial_meta m ON q.dataset = m.dataset AND q.trial = m.trial"),
    "log_and_frames": ("entries trial_meta", _SNAP, "SELECT coalesce(s.dataset, m.dataset) AS dataset, coalesce(s.trial, m.trial) AS trial, CASE WHEN m.trial IS NULL THEN 'no_frame' WHEN s.trial IS NULL THEN 'no_log' ELSE 'both' END AS side FROM s FULL JOIN trial_meta m ON s.dataset = m.dataset AND s.trial = m.trial"),
    "state_counts": ("tiles", "", "SELECT dataset, " + ", ".join(f"count(*) FILTER (state = '{s}') AS n_{s}" for s in ("anchor", "unverified", "human", "excluded")) + ", count(*) FILTER (diverted AND state = 'unverified') AS n_diverted FROM tiles GROUP BY dataset"),
    "placed_tiles": ("tiles", "", "SELECT dataset, trial, x, y, state FROM tiles WHERE state IN ('anchor', 'human')"),
    "moved_tiles": ("tiles", "m AS (SELECT dataset, trial, round(sqrt((x - mx) ** 2 + (y - my) ** 2), 4) AS moved_px FROM tiles WHERE state <> 'excluded')",
      "SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY moved_px DESC, trial) AS place FROM m"),
    "nearby_pairs": ("tiles", "", """SELECT a.dataset, a.trial AS a, b.trial AS b, (512 - abs(a.x - b.x)) * (512 - abs(a.y - b.y)) AS overlap_px FROM tiles a JOIN tiles b ON a.dataset = b.dataset AND a.trial < b.trial
      WHERE (a.x - b.x) ** 2 + (a.y - b.y) ** 2 < 480 * 480 AND 512 - abs(a.x - b.x) >= 40 AND 512 - abs(a.y - b.y) >= 40 AND (512 - abs(a.x - b.x)) * (512 - abs(a.y - b.y)) >= 3600"""),
    "link_verdicts": ("links", _VERDICT, "SELECT dataset, verdict, count(*) AS n FROM v GROUP BY dataset, verdict"),
    "link_verdict_rows": ("links", _VERDICT, "SELECT dataset, a, b, kind, verdict FROM v"),
    "link_statistics": ("links", _VERDICT, "SELECT dataset, kind, count(*) AS n, count(*) FILTER (verdict = 'ok') AS n_ok, median(response) FILTER (verdict = 'ok') AS median_response, median(ncc) FILTER (verdict = 'ok') AS median_ncc, " + ", ".join(f"count(*) FILTER (verdict = '{v}') AS n_{v}" for v in layout.REJECTIONS) + " FROM v GROUP BY dataset, kind"),
    "link_components": ("links", _VERDICT + """, e AS (SELECT DISTINCT dataset, a AS u, b AS v FROM v WHERE verdict = 'ok' UNION SELECT dataset, b, a FROM v WHERE verdict = 'ok'), w(dataset, node, root) USING KEY (dataset, node) AS (SELECT DISTINCT dataset, u, u FROM e
      UNION (SELECT e.dataset, e.u, min(y.root) FROM recurring.w AS y JOIN e ON e.dataset = y.dataset AND e.v = y.node JOIN recurring.w AS x ON x.dataset = e.dataset AND x.node = e.u WHERE y.root < x.root GROUP BY e.dataset, e.u)),
      z AS (SELECT dataset, root, count(*) AS n FROM w GROUP BY dataset, root), c AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY n DESC, root) - 1 AS component FROM z)""", "SELECT w.dataset, w.node, component, n FROM w JOIN c ON w.dataset = c.dataset AND w.root = c.root"),
    "top_links": ("links", _PAIRS + ", e AS (SELECT *, a AS e FROM p UNION ALL SELECT *, b FROM p)", "SELECT DISTINCT dataset, a, b, ncc FROM (SELECT *, row_number() OVER (PARTITION BY dataset, e ORDER BY ncc DESC, a, b) AS k FROM e) WHERE k <= 6"),
    "match_margins": ("links", _PAIRS, "SELECT dataset, a, round(max(CASE WHEN k = 1 THEN ncc END) - max(CASE WHEN k = 2 THEN ncc END), 6) AS margin FROM (SELECT *, row_number() OVER (PARTITION BY dataset, a ORDER BY ncc DESC, b) AS k FROM p) WHERE k <= 2 GROUP BY dataset, a"),
    "rigid_runs": ("tiles", """c AS (SELECT *, lag(x) OVER w AS px, CASE WHEN lag(trial) OVER w IS NULL OR trial - lag(trial) OVER w > 1 OR ncc < 0.55 THEN 1 ELSE 0 END AS cut FROM tiles WINDOW w AS (PARTITION BY dataset ORDER BY trial)),
      r AS (SELECT *, (sum(cut) OVER (PARTITION BY dataset ORDER BY trial))::BIGINT AS run FROM c)""",
      "SELECT dataset, trial, run, sum(CASE WHEN cut = 1 THEN 0 ELSE x - px END) OVER (PARTITION BY dataset, run ORDER BY trial) AS local_x FROM r"),
    "electrodes_in_regions": ("electrodes regions", "", """SELECT region, count(*) AS n, count(*) FILTER (kind = 1) AS n_detected, string_agg(col || '-' || row, ' ' ORDER BY col || '-' || row) AS ids
      FROM electrodes e JOIN regions r ON e.mosaic = r.mosaic AND e.x >= r.x AND e.x < r.x + r.w AND e.y >= r.y AND e.y < r.y + r.h GROUP BY region"""),
    "nearest_electrode": ("electrodes regions", "d AS (SELECT region, col, row, (e.x - r.x) ** 2 + (e.y - r.y) ** 2 AS d2 FROM electrodes e JOIN regions r ON e.mosaic = r.mosaic WHERE abs(e.x - r.x) <= 30 AND abs(e.y - r.y) <= 30)",
      "SELECT region, col, row, round(sqrt(d2), 6) AS distance FROM d WHERE d2 <= least(greatest(4.2, 4.0 / ((1 + region % 5) / 4.0)), greatest(4.2, 14.0 * sqrt(0.5))) ** 2 QUALIFY row_number() OVER (PARTITION BY region ORDER BY d2, col, row) = 1"),
    "step_statistics": ("electrodes", """e AS (SELECT a.mosaic, b.row - a.row AS axis, b.x - a.x AS dx, b.y - a.y AS dy FROM electrodes a JOIN electrodes b ON a.mosaic = b.mosaic AND (b.col = a.col + 1 AND b.row = a.row OR b.col = a.col AND b.row = a.row + 1) WHERE a.kind = 1 AND b.kind = 1),
      m AS (SELECT mosaic, axis, avg(dx) AS mx, avg(dy) AS my FROM e GROUP BY mosaic, axis), r AS (SELECT mosaic, count(*) AS n_steps, round(median(sqrt((dx - mx) ** 2 + (dy - my) ** 2)), 6) AS median_px, round(quantile_cont(sqrt((dx - mx) ** 2 + (dy - my) ** 2), 0.95), 6) AS p95_px FROM e JOIN m USING (mosaic, axis) GROUP BY mosaic)""",
      "SELECT mosaic, count(*) FILTER (kind = 1) AS n_detected, count(*) FILTER (kind = 2) AS n_inferred, round(count(*) FILTER (kind = 1) / count(*)::DOUBLE, 4) AS detected_share, any_value(n_steps) AS n_steps, any_value(median_px) AS median_px, any_value(p95_px) AS p95_px FROM electrodes LEFT JOIN r USING (mosaic) GROUP BY mosaic"),
    "build_score": ("tiles", """b AS (SELECT dataset, mx - x AS ex, my - y AS ey FROM tiles WHERE state = 'anchor'), m AS (SELECT dataset, median(ex) AS sx, median(ey) AS sy FROM b GROUP BY dataset),
      e AS (SELECT dataset, sqrt((ex - sx) ** 2 + (ey - sy) ** 2) AS err FROM b JOIN m USING (dataset))""",
      "SELECT dataset, count(*) AS n_shared, " + ", ".join(f"count(*) FILTER (err <= {t}) AS within_{t}" for t in (5, 10, 25, 50, 96, 256)) + ", round(median(err), 6) AS median_err, round(quantile_cont(err, 0.9), 6) AS p90_err FROM e GROUP BY dataset"),
}

_SEGMENTS = """u AS (SELECT *, coalesce(frame - lag(frame) OVER w > 1 OR step > 600, true) OR lag(frame) OVER w IS NULL AS start FROM frame_track WHERE gray >= 3 WINDOW w AS (PARTITION BY video ORDER BY frame)),
  v AS (SELECT *, (sum(start::INT) OVER (PARTITION BY video ORDER BY frame))::BIGINT - 1 AS segment FROM u),
  g AS (SELECT video, frame, segment, step, (sum(CASE WHEN start THEN 0 ELSE step END) OVER (PARTITION BY video, segment ORDER BY frame))::BIGINT AS travel FROM v)"""
#: The walk along a video, a frame a round: what has moved, the armed trigger, the open dwell, the segment's first frame, and all keyframes so far.
_WALK = """wq AS (SELECT video, frame, gray >= 3 AS lit, step, row_number() OVER w AS rn, coalesce(lag(gray >= 3) OVER w, false) AS plit, lag(frame) OVER w AS e, coalesce(max(CASE WHEN gray < 3 THEN frame END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -100) AS lb
    FROM frame_track WINDOW w AS (PARTITION BY video ORDER BY frame)),
  wr AS (SELECT video, frame, rn, e, lb, step, lit, NOT lit AS blk, lit AND (NOT plit OR step > 600) AS start, plit AND (NOT lit OR step > 600) AS closing FROM wq {end}),
  wy AS (SELECT DISTINCT video, 0::BIGINT AS rn, 0::BIGINT AS travel, false AS armed, -1::BIGINT AS dw, -1::BIGINT AS ss, []::BIGINT[] AS kfs, []::STRUCT(f BIGINT, w VARCHAR)[] AS outs FROM wr UNION ALL
    SELECT video, rn, CASE WHEN a5 THEN 0 ELSE travel END, armed AND NOT a5, dw, ss, CASE WHEN a5 THEN list_append(kfs, frame) ELSE kfs END, CASE WHEN a5 THEN list_append(outs, {{'f': frame, 'w': 'travel'}}) ELSE outs END
    FROM (SELECT *, armed AND frame - lb > 5 AND lit AND NOT start AS a5 FROM (
     SELECT video, rn, frame, lb, lit, start, ss, CASE WHEN a4 THEN 0 ELSE travel END AS travel, armed AND NOT a4 OR lit AND NOT start AND NOT a4 AND travel >= 3000 AS armed, CASE WHEN NOT lit OR start THEN dw WHEN step >= 50 THEN -1 WHEN dw < 0 THEN frame ELSE dw END AS dw,
      CASE WHEN a4 THEN list_append(kfs, (dw + frame) // 2) ELSE kfs END AS kfs, CASE WHEN a4 THEN list_append(outs, {{'f': (dw + frame) // 2, 'w': 'dwell'}}) ELSE outs END AS outs
     FROM (SELECT *, lit AND NOT start AND step >= 50 AND dw >= 0 AND frame - dw >= 3 AND travel >= 1000 AND NOT list_contains(kfs, (dw + frame) // 2) AND (dw + frame) // 2 - lb > 5 AS a4 FROM (
      SELECT video, rn, frame, lb, lit, start, step, dw, CASE WHEN start THEN frame ELSE ss END AS ss, CASE WHEN a3 THEN 0 WHEN lit AND NOT start THEN travel + step ELSE travel END AS travel, CASE WHEN start THEN NOT a3 ELSE armed END AS armed,
       CASE WHEN a3 THEN list_append(kfs, frame) ELSE kfs END AS kfs, CASE WHEN a3 THEN list_append(outs, {{'f': frame, 'w': 'segment-start'}}) ELSE outs END AS outs
      FROM (SELECT *, start AND frame - lb > 5 AS a3 FROM (
       SELECT video, rn, frame, lb, lit, start, step, ss, dw, CASE WHEN a2 THEN 0 ELSE travel END AS travel, armed AND NOT a2 AS armed, CASE WHEN a2 THEN list_append(kfs, j) ELSE kfs END AS kfs, CASE WHEN a2 THEN list_append(outs, {{'f': j, 'w': 'segment-end'}}) ELSE outs END AS outs
       FROM (SELECT *, closing AND travel > 1000 AND j IS NOT NULL AS a2 FROM (SELECT *, CASE WHEN closing THEN list_max(list_filter(range(greatest(ss, e - 19), e + 1), lambda j: NOT list_contains(kfs, j) AND j - lb > 5 AND (NOT blk OR frame - j > 5))) END AS j FROM (
        SELECT video, rn, frame, e, lb, lit, blk, start, closing, step, ss, CASE WHEN a1 THEN 0 ELSE travel END AS travel, armed AND NOT a1 AS armed, CASE WHEN closing THEN -1 ELSE dw END AS dw, CASE WHEN a1 THEN list_append(kfs, (dw + e) // 2) ELSE kfs END AS kfs,
         CASE WHEN a1 THEN [{{'f': (dw + e) // 2, 'w': 'dwell'}}] ELSE []::STRUCT(f BIGINT, w VARCHAR)[] END AS outs
        FROM (SELECT *, closing AND dw >= 0 AND e - dw >= 3 AND travel >= 1000 AND NOT list_contains(kfs, (dw + e) // 2) AND (dw + e) // 2 - lb > 5 AND (NOT blk OR frame - (dw + e) // 2 > 5) AS a1 FROM (
         SELECT r.video, r.rn, r.frame, r.e, r.lb, r.lit, r.blk, r.start, r.closing, r.step, y.travel, y.armed, y.dw, y.ss, y.kfs FROM wy AS y JOIN wr AS r ON r.video = y.video AND r.rn = y.rn + 1)))))))))))),
  k AS (SELECT g.video, g.segment, g.frame, g.travel, z.o.w AS reason FROM (SELECT video, unnest(outs) AS o FROM wy) AS z JOIN g ON g.video = z.video AND g.frame = z.o.f
    WHERE NOT EXISTS (SELECT 1 FROM frame_track AS t WHERE t.video = z.video AND t.gray < 3 AND abs(t.frame - z.o.f) <= 5))"""
_KEYFRAMES = _SEGMENTS + ", " + _WALK.format(end="UNION ALL SELECT video, 1000000000, rn + 1, frame, CASE WHEN lit THEN lb ELSE frame END, 0, false, false, false, lit FROM wq QUALIFY row_number() OVER (PARTITION BY video ORDER BY rn DESC) = 1")
_LIVE_KEYFRAMES = _SEGMENTS + ", " + _WALK.format(end="")
_KEYED = "q AS (SELECT * REPLACE (CASE WHEN dataset NOT IN (3, 4) THEN mx END AS mx, CASE WHEN trial % 6 <> 0 THEN x END AS x), x AS lx FROM tiles)"
_OWN = "l AS (SELECT * REPLACE (a // 20 AS dataset) FROM links)"
_ON = "state <> 'excluded' AND x IS NOT NULL AND y IS NOT NULL"
_PIXELS = "e AS (SELECT frame, grp, x, y, unnest(px) AS value, generate_subscripts(px, 1) - 1 AS pixel FROM frames8)"
_STAMP = "SELECT dataset, count(*) AS n, sum(('0x' || md5(concat_ws(':', trial, printf('%.2f', {x}), printf('%.2f', y)))[1:12])::BIGINT)::VARCHAR AS stamp FROM tiles WHERE state <> 'excluded'{more} GROUP BY dataset"
_SQL |= {
    "confident_matches": ("tiles", "", "SELECT dataset, trial, margin, ncc, coalesce(margin >= 0.1 AND ncc >= 0.12, false) AS confident FROM tiles"),
    "tile_states": ("tiles", "q AS (SELECT dataset, trial, CASE WHEN trial % 3 = 0 THEN state END AS state, CASE WHEN trial % 5 = 0 THEN 'odd' ELSE state END AS status, CASE WHEN trial % 4 <> 0 THEN x END AS x, y FROM tiles)",
      "SELECT dataset, trial, CASE WHEN state IS NOT NULL THEN state WHEN status IN ('anchor', 'human', 'unverified', 'excluded', 'unplaced') THEN status WHEN x IS NOT NULL AND y IS NOT NULL THEN 'unverified' ELSE 'unplaced' END AS state FROM q"),
    "chain_breaks": ("entries", _SNAP + ", " + _SPLIT + ", n AS (SELECT dataset, trial AS before, lead(trial) OVER (PARTITION BY dataset ORDER BY trial) AS after FROM s)",
      "SELECT * FROM (SELECT n.dataset, before, after, CASE WHEN before <= split AND after > split THEN 'pass_boundary' WHEN after > before + 1 THEN 'gap' END AS reason FROM n LEFT JOIN z USING (dataset)) WHERE reason IS NOT NULL AND after IS NOT NULL"),
    "parsed_log": ("entries", "", "SELECT user_id AS dataset, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS trial, CASE WHEN event_type IN ('view','click','signup') THEN 'Snapshot' ELSE 'Other' END AS type, epoch_us(ts) // 1000000 AS s FROM events"),
    "track_segments": ("frame_track", _SEGMENTS, "SELECT * FROM g"),
    "black_shoulders": ("frame_track", "", "SELECT video, frame FROM (SELECT *, max(coalesce(gray < 3, true)::INT) OVER (PARTITION BY video ORDER BY frame RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS near FROM frame_track) WHERE near = 1 AND gray >= 3"),
    "dwells": ("frame_track", _SEGMENTS, "SELECT video, segment, min(frame) AS first, max(frame) AS last, count(*) AS n FROM (SELECT *, frame - row_number() OVER (PARTITION BY video, segment ORDER BY frame) AS island FROM g WHERE step < 50) GROUP BY video, segment, island HAVING count(*) >= 2"),
    "travel_keyframes": ("frame_track", _KEYFRAMES, "SELECT * FROM k"),
    "sequential_candidates": ("frame_track", _KEYFRAMES, "SELECT x.video, x.segment, x.frame AS a, y.frame AS b FROM (SELECT *, row_number() OVER (PARTITION BY video, segment ORDER BY frame) AS i FROM k) x JOIN (SELECT *, row_number() OVER (PARTITION BY video, segment ORDER BY frame) AS i FROM k) y ON x.video = y.video AND x.segment = y.segment AND y.i - x.i IN (1, 2)"),
    "bridge_candidates": ("frame_track", _KEYFRAMES + ", r AS (SELECT *, row_number() OVER (PARTITION BY video, segment ORDER BY frame) AS up, row_number() OVER (PARTITION BY video, segment ORDER BY frame DESC) AS down FROM k)", "SELECT a.video, a.frame AS a, b.frame AS b FROM r a JOIN r b ON a.video = b.video AND b.segment - a.segment IN (1, 2, 3) WHERE a.down <= 4 AND b.up <= 3"),
    "track_statistics": ("frame_track", _KEYFRAMES + """, p AS (SELECT video, segment, max(travel) AS travel FROM g GROUP BY video, segment), s AS (SELECT video, count(*) AS n_segments, max(travel) AS longest, sum(travel)::BIGINT AS path FROM p GROUP BY video),
      b AS (SELECT video, count(*) FILTER (frame - before = 1 AND step > 600) AS n_breaks, round(median(response) FILTER (response > 0), 6) AS median_response FROM (SELECT *, lag(frame) OVER (PARTITION BY video ORDER BY frame) AS before FROM frame_track WHERE gray >= 3) GROUP BY video),
      h AS (SELECT video, count(*) FILTER (reason = 'travel') AS n_travel, count(*) FILTER (reason = 'dwell') AS n_dwell, count(*) FILTER (reason = 'segment-start') AS n_segment_start, count(*) FILTER (reason = 'segment-end') AS n_segment_end FROM k GROUP BY video),
      a AS (SELECT video, count(*) AS n, count(*) FILTER (coalesce(gray < 3, true)) AS n_black FROM frame_track GROUP BY video)""",
      "SELECT video, n, n_black, coalesce(n_segments, 0) AS n_segments, coalesce(n_breaks, 0) AS n_breaks, longest, path, median_response, coalesce(n_travel, 0) AS n_travel, coalesce(n_dwell, 0) AS n_dwell, coalesce(n_segment_start, 0) AS n_segment_start, coalesce(n_segment_end, 0) AS n_segment_end FROM a LEFT JOIN s USING (video) LEFT JOIN b USING (video) LEFT JOIN h USING (video)"),
    "live_keyframes": ("frame_track", _LIVE_KEYFRAMES, "SELECT video, frame, segment, reason FROM k"),
    "sampled_frames": ("frame_track", "r AS (SELECT video, frame, row_number() OVER (PARTITION BY video ORDER BY frame) - 1 AS i, count(*) OVER (PARTITION BY video) AS n FROM frame_track)", "SELECT video, frame FROM r WHERE n <= 96 OR EXISTS (SELECT 1 FROM range(0, 96) AS t(k) WHERE round_even(k * (n - 1) / 95.0::DOUBLE, 0) = i)"),
    "activity": ("frame_track", "", "SELECT video, min(frame) AS first, max(frame) AS last, count(*) AS n FROM (SELECT video, frame, frame - row_number() OVER (PARTITION BY video ORDER BY frame) AS island FROM frame_track WHERE gray >= 3) GROUP BY video, island"),
    "normalised_layout": ("tiles", _KEYED + f", f AS (SELECT dataset, coalesce(min(trial) FILTER (state = 'anchor'), min(trial)) AS origin FROM q WHERE {_ON} GROUP BY dataset), o AS (SELECT q.dataset, x AS ox, y AS oy FROM q JOIN f ON q.dataset = f.dataset AND q.trial = f.origin)",
      f"SELECT q.dataset, trial, CASE WHEN {_ON} THEN x - ox END AS nx, CASE WHEN {_ON} THEN y - oy END AS ny, mx - ox AS nmx, my - oy AS nmy, CASE WHEN {_ON} THEN round(sqrt((x - mx) ** 2 + (y - my) ** 2), 4) END AS moved_px, CASE WHEN state = 'excluded' THEN lx - ox END AS nlx, CASE WHEN state = 'excluded' THEN y - oy END AS nly, CASE WHEN trial % 3 = 0 THEN 40.0 WHEN {_ON} THEN 96.0 ELSE 256.0 END::DOUBLE AS r FROM q LEFT JOIN o ON q.dataset = o.dataset"),
    "provenance": ("tiles", _KEYED, "SELECT dataset, count(mx) AS n_machine, CASE WHEN dataset % 3 = 0 THEN 'build' WHEN count(mx) > 0 THEN 'machine' ELSE 'independent' END AS provenance FROM q GROUP BY dataset"),
    "trusted_matches": ("tiles", "", "SELECT dataset, trial, (trial % 4 = 0 OR margin >= 0.2) AND ncc >= 0.65 AS confident, CASE WHEN NOT ((trial % 4 = 0 OR margin >= 0.2) AND ncc >= 0.65) AND (x - mx) ** 2 + (y - my) ** 2 > 25 THEN 'solver' ELSE 'match' END AS used FROM tiles"),
    "rescoped_tiles": ("tiles", _KEYED + ", n AS (SELECT dataset, trial FROM tiles WHERE trial % 4 <> 0 UNION ALL SELECT dataset, trial + 1000000 FROM tiles WHERE trial % 50 = 0)",
      f"SELECT coalesce(q.dataset, n.dataset) AS dataset, coalesce(q.trial, n.trial) AS trial, CASE WHEN q.trial IS NULL THEN 'added' WHEN n.trial IS NOT NULL THEN 'kept' WHEN {_ON} THEN 'placed_lost' ELSE 'removed' END AS fate FROM q FULL JOIN n ON q.dataset = n.dataset AND q.trial = n.trial"),
    "without_machine": ("tiles", "", "SELECT dataset, trial, state, CASE WHEN state <> 'unverified' THEN x END AS x, CASE WHEN state <> 'unverified' THEN y END AS y, NULL::DOUBLE AS mx, NULL::DOUBLE AS my FROM tiles"),
    "solvable": ("entries", _SNAP + ", " + _SPLIT + ", w AS (SELECT dataset, count(*) FILTER (coalesce(trial <= split, true)) AS n_first, count(*) FILTER (NOT coalesce(trial <= split, true)) AS n_second FROM s LEFT JOIN z USING (dataset) GROUP BY dataset)",
      "SELECT *, CASE WHEN n_first < 4 THEN 'too_few_first' WHEN n_second < 2 THEN 'too_few_second' ELSE 'ok' END AS verdict FROM w"),
    "blank_proposal": ("entries", _SNAP + ", " + _SPLIT + """, w AS (SELECT s.dataset, texture, coalesce(trial <= split, true) AS one FROM s LEFT JOIN z USING (dataset)),
      h AS (SELECT dataset, CASE WHEN count(texture) FILTER (one) >= 20 THEN quantile_cont(texture, 0.02) FILTER (one) END AS thr FROM w GROUP BY dataset)""",
      "SELECT dataset, round(any_value(thr), 6) AS threshold, count(*) FILTER (texture < thr) AS n_blank, round(min(texture - thr) FILTER (texture >= thr), 6) AS margin FROM w JOIN h USING (dataset) GROUP BY dataset"),
    "edit_tallies": ("tiles", _KEYED + f", d AS (SELECT dataset, mx, {_ON} AND mx IS NULL AS alone, diverted AND state <> 'excluded' AS div, CASE WHEN {_ON} THEN sqrt((x - mx) ** 2 + (y - my) ** 2) END AS d FROM q)", "SELECT dataset, count(*) FILTER (d < 0.5) AS n_accepted, count(*) FILTER (d >= 0.5) AS n_moved, round(median(d) FILTER (d >= 0.5), 6) AS median_moved, round(max(d) FILTER (d >= 0.5), 6) AS most_moved, CASE WHEN count(mx) > 0 THEN count(*) FILTER (alone) ELSE 0 END AS n_rescued, count(*) FILTER (div) AS n_diverted FROM d GROUP BY dataset"),
    "residual_statistics": ("links tiles", _OWN + f", p AS (SELECT * FROM tiles WHERE {_ON}), r AS (SELECT l.dataset, sqrt((b.x - a.x - l.dx) ** 2 + (b.y - a.y - l.dy) ** 2) AS r FROM l JOIN p a ON l.dataset = a.dataset AND l.a = a.trial JOIN p b ON l.dataset = b.dataset AND l.b = b.trial)",
      "SELECT dataset, count(*) FILTER (r <= 500) AS n_kept, count(*) FILTER (r > 500) AS n_dropped, round(median(r) FILTER (r <= 500), 6) AS median_px, round(quantile_cont(r, 0.95) FILTER (r <= 500), 6) AS p95_px FROM r GROUP BY dataset"),
    "tile_quality": ("links", "e AS (SELECT dataset, a AS tile, ncc FROM links UNION ALL SELECT dataset, b, ncc FROM links)", "SELECT dataset, tile, count(*) AS n, round(median(ncc), 6) AS median_ncc FROM e GROUP BY dataset, tile"),
    "leaderboard": ("links", "e AS (SELECT dataset, a AS tile, ncc FROM links UNION ALL SELECT dataset, b, ncc FROM links), t AS (SELECT dataset, count(*) FILTER (m < 0.3) AS n_bad_tiles FROM (SELECT dataset, tile, round(median(ncc), 6) AS m FROM e GROUP BY dataset, tile) GROUP BY dataset)",
      "SELECT dataset, round(median(ncc), 6) AS median_ncc, count(*) FILTER (ncc > 0.5) AS n_good, count(*) AS n, any_value(n_bad_tiles) AS n_bad_tiles, row_number() OVER (ORDER BY round(median(ncc), 6) DESC, dataset) AS place FROM links JOIN t USING (dataset) GROUP BY dataset"),
    "gated_links": ("links tiles", "l AS (SELECT a // 20 AS dataset, least(a, b) AS a, greatest(a, b) AS b, CASE WHEN a > b THEN -dx ELSE dx END AS dx FROM links), " + _SQL["rigid_runs"][1] + ", h AS (" + _SQL["rigid_runs"][2] + ")", "SELECT l.dataset, l.a, l.b, l.dx FROM l JOIN h x ON l.dataset = x.dataset AND l.a = x.trial JOIN h y ON l.dataset = y.dataset AND l.b = y.trial WHERE l.b - l.a >= 2 AND x.run = y.run AND abs(l.dx - (y.local_x - x.local_x)) > 60"),
    "covered_blocks": ("tiles", f"q AS (SELECT dataset, y, unnest(range(floor(x / 256)::BIGINT, ceil((x + 512) / 256)::BIGINT)) AS block_x FROM tiles WHERE {_ON}), r AS (SELECT dataset, block_x, unnest(range(floor(y / 256)::BIGINT, ceil((y + 512) / 256)::BIGINT)) AS block_y FROM q)", "SELECT dataset, block_x, block_y, count(*) AS n FROM r GROUP BY dataset, block_x, block_y"),
    "seed_shift": ("tiles", "", "SELECT dataset, median(x - mx) AS sx, median(y - my) AS sy, count(*) AS n_shared FROM tiles WHERE state IN ('anchor', 'human') GROUP BY dataset"),
    "position_stamp": ("tiles", "", _STAMP.format(x="x", more="")),
    "stale_artefacts": ("tiles", "n AS (" + _STAMP.format(x="x + CASE WHEN trial % 77 = 0 THEN 0.25 ELSE 0.0 END", more="") + "), r AS (" + _STAMP.format(x="x", more=" AND dataset % 5 <> 0") + ")", "SELECT coalesce(n.dataset, r.dataset) AS dataset, NOT coalesce(n.stamp = r.stamp, false) AS stale FROM n FULL JOIN r ON n.dataset = r.dataset"),
    "tile_neighbours": ("tiles", "", "SELECT dataset, trial, lag(trial) OVER w AS previous, lead(trial) OVER w AS next FROM tiles WHERE state <> 'excluded' WINDOW w AS (PARTITION BY dataset ORDER BY trial)"),
    "edge_trim": ("electrodes", "l AS (SELECT mosaic, 'col' AS axis, col AS line, count(*) AS n FROM electrodes WHERE kind = 1 GROUP BY mosaic, col UNION ALL SELECT mosaic, 'row', row, count(*) FROM electrodes WHERE kind = 1 GROUP BY mosaic, row), m AS (SELECT mosaic, axis, greatest(2, ceil(0.2 * max(n))) AS need FROM l GROUP BY mosaic, axis)", "SELECT mosaic, axis, min(line) AS first, max(line) AS last FROM l JOIN m USING (mosaic, axis) WHERE n >= need GROUP BY mosaic, axis"),
    "zoom_consensus": ("readings", """g AS (SELECT *, floor(ln(pitch) * 1e6)::BIGINT AS lp FROM readings WHERE snr >= 12), v AS (SELECT a.recording, a.pitch, a.snr, count(*) OVER (PARTITION BY recording ORDER BY lp RANGE BETWEEN 48790 PRECEDING AND 48790 FOLLOWING) AS votes, count(*) OVER (PARTITION BY recording) AS n FROM g a)""",
      "SELECT recording, pitch, votes, n FROM v WHERE votes >= 2 OR n = 1 QUALIFY row_number() OVER (PARTITION BY recording ORDER BY votes DESC, snr DESC, pitch DESC) = 1"),
    "pixel_statistics": ("frames8", _PIXELS, "SELECT grp, pixel, round(median(value), 6) AS median_px, round(max(value), 6) AS max_px, round(stddev_pop(value), 6) AS std_px FROM e GROUP BY grp, pixel"),
    "exposure": ("frames8", _PIXELS, "SELECT frame, grp, round(CASE WHEN count(*) FILTER (value > 0.05) > 0.01 * count(*) THEN quantile_cont(value, 0.6) FILTER (value > 0.05) ELSE 0 END, 6) AS level FROM e GROUP BY frame, grp"),
    "peaks": ("frames8", "t AS (SELECT frame, px, list_position(px, list_max(px)) AS k FROM frames8), b AS (SELECT frame, k - 1 AS pixel, px[k - 1] AS l, px[k] AS c, px[k + 1] AS r, px[k - 8] AS u, px[k + 8] AS d FROM t)",
      "SELECT frame, pixel, CASE WHEN pixel % 8 BETWEEN 1 AND 6 AND l - 2 * c + r < 0 THEN round(greatest(-0.5, least(0.5, 0.5 * (l - r) / (l - 2 * c + r))), 6) END AS subpixel, CASE WHEN pixel // 8 BETWEEN 1 AND 6 AND u - 2 * c + d < 0 THEN round(greatest(-0.5, least(0.5, 0.5 * (u - d) / (u - 2 * c + d))), 6) END AS subpixel_y FROM b"),
    "composite": ("frames8", _PIXELS + ", w AS (SELECT grp, x + pixel % 8 AS cx, y + pixel // 8 AS cy, value, greatest(0.001, least(pixel % 8 + 1, 8 - pixel % 8) / 4.0 * (least(pixel // 8 + 1, 8 - pixel // 8) / 4.0))::DOUBLE AS w FROM e)", "SELECT grp, cx, cy, round(sum(w * value) / sum(w), 6) AS px, count(*) AS n FROM w GROUP BY grp, cx, cy"),
}

QUERIES |= survey.QUERIES
_SQL |= {name: (tables, more.replace("{keyframes}", _KEYFRAMES), body) for name, (tables, more, body) in survey.SQL.items()}

ORACLES = {name: "WITH RECURSIVE " + ", ".join([f"{t} AS ({views.SQL[t]})" for t in tables.split()] + [more] * bool(more)) + "\n" + body if tables or more else body for name, (tables, more, body) in _SQL.items()}
