"""Logs, position files and streamed keyframes against plain Python; edge cases of the document operators."""

import hashlib
import json
import random
from collections import Counter

import duckdb
import pandas as pd
from pyspark.sql import functions as F

from lamella.operators import acquisition as acq
from lamella.operators import documents, layout, pixels, review, scoring, spatial, tracks
from lamella.plans import registry
from lamella.sources import acquisition, logs
from lamella.sources import documents as tables
from lamella.streaming import logs as live_logs
from lamella.streaming import tracks as live

SF = "/root/testdata/sf0.001"


def test_log_midnight_and_noise(spark, tmp_path):
    (tmp_path / "one").mkdir()
    text = ["12:00:00 Trial 009: Snapshot", "06/20/26 23:58:00 New experiment: first", "23:59:30 Trial 010: Snapshot", "00:00:10 Trial 011: Snapshot", "nonsense", "00:00:05 Settings loaded: a", "00:00:20 Trial 012: Other kind  ", "06/25/26 01:00:00 Trial 013: Snapshot", "02:00:00 New experiment", ""]
    (tmp_path / "one" / "log.txt").write_text("\n".join(text))
    lines = logs.read_lines(spark, f"{tmp_path}/*/log.txt")
    day = int(pd.Timestamp("2026-06-20").timestamp())
    assert [(r.trial, r.type, r.s - day) for r in logs.parse(lines).orderBy("line_no").collect()] == [(10, "Snapshot", 86370), (11, "Snapshot", 86410), (12, "Other kind", 86420), (13, "Snapshot", 5 * 86400 + 3600)]
    assert [tuple(r) for r in logs.experiments(lines).collect()] == [("one", "first")]


def test_log_of_nulls(spark):
    lines = spark.createDataFrame([("a", 1, None), ("a", 2, "")], "dataset string, line_no long, value string")
    assert logs.parse(lines).collect() == [] and [tuple(r) for r in logs.experiments(lines).collect()] == [("a", "a")]


def test_positions_round_trip(spark, tmp_path):
    rows = [("a", 2, "anchor", 1.0, 2.0), ("a", 1, "human", 0.12345, 2.0), ("a", 3, "excluded", 1.0, 1.0), ("b", 1, "unverified", None, 1.0), ("b", 2, "unverified", 3.0, 4.0)]
    tiles = spark.createDataFrame(rows, "dataset string, trial long, state string, x double, y double")
    logs.write_positions(tiles, f"{tmp_path}/p")
    got = sorted(tuple(r) for r in logs.read_positions(spark, f"{tmp_path}/p").collect())
    assert [r[:4] for r in got] == [("a", 1, 0.1235, 2.0), ("a", 2, 1.0, 2.0), ("b", 2, 3.0, 4.0)] or got[0][2] == 0.1234
    part = next((tmp_path / "p" / "dataset=a").glob("*.csv")).read_text().splitlines()
    assert part[0] == "trial,x,y,state" and [line.split(",")[0] for line in part[1:]] == ["1", "2"]


def by_hand(rows, ended):
    """Keyframes (frame, segment, reason) of a video's (grey, step), frames counted from 1; the last segment ends with the video if ``ended``."""
    black = {i for i, (gray, _) in enumerate(rows, 1) if gray is None or gray < 3}
    seen, taken, out = set(), set(), []
    moved, armed, dwell, segment, first = 0, False, None, -1, None

    def take(i, reason, seg):
        nonlocal moved, armed
        if i in taken or any(b in seen for b in range(i - 5, i + 6)):
            return False
        moved, armed = 0, False
        taken.add(i)
        out.append((i, seg, reason))
        return True

    def end_dwell(i):
        nonlocal dwell
        begin, dwell = dwell, None
        if begin is not None and i - begin >= 3 and moved >= 1000:
            take((begin + i) // 2, "dwell", segment)

    def end_segment(last):
        nonlocal first
        if first is not None:
            end_dwell(last)
            if moved > 1000:
                for j in range(last, max(first, last - 19) - 1, -1):
                    if take(j, "segment-end", segment):
                        break
        first = None

    for i, (_, step) in enumerate(rows, 1):
        if i in black:
            seen.add(i)
            end_segment(i - 1)
        elif first is None or step is None or step > 600:
            end_segment(i - 1)
            segment, first = segment + 1, i
            armed = not take(i, "segment-start", segment)
        else:
            moved += step
            if step < 50:
                dwell = i if dwell is None else dwell
            else:
                end_dwell(i)
            armed = armed or moved >= 3000
            if armed:
                take(i, "travel", segment)
    if ended:
        end_segment(len(rows))
    return {k for k in out if not any(b in black for b in range(k[0] - 5, k[0] + 6))}


def tracks_of(rng):
    """Videos with long dwells, jumps, ramps after black stretches, black ends and light ends."""
    for video in range(14):
        rows = []
        while len(rows) < 150:
            kind = rng.choice(["black", "dwell", "move", "move", "fast", "jump"])
            n = rng.randrange(1, 30) if kind != "jump" else 1
            rows += [(1.0 if kind == "black" else 9.0, {"dwell": rng.randrange(50), "move": rng.randrange(50, 400), "fast": 590, "jump": 700, "black": 0}[kind]) for _ in range(n)]
        yield video, rows + [(None, 5)] * (video % 2)


def test_keyframes(spark):
    videos = dict(tracks_of(random.Random(31)))
    rows = [(v, i, g, s, 0.5) for v, fs in videos.items() for i, (g, s) in enumerate(fs, 1)]
    got = tracks.travel_keyframes(spark.createDataFrame(rows, "video long, frame long, gray double, step long, response double").repartition(5)).collect()
    want = {(v, *k) for v, fs in videos.items() for k in by_hand(fs, True)}
    assert {(r.video, r.frame, r.segment, r.reason) for r in got} == want and len(got) == len(want)
    assert {k[3] for k in want} == set(tracks.REASONS)


def test_live_keyframes(spark):
    got = registry.QUERIES["live_keyframes"](spark, SF).collect()
    want = set()
    for user, rows in pd.read_parquet(f"{SF}/events.parquet").sort_values("event_id").groupby("user_id"):
        want |= {(user, *k) for k in by_hand([(v, int(v * 100 // 1) % 700) for v in rows.value], False)}
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_keyframes_over_batches(spark, tmp_path):
    """The same however the frames are cut into batches, and after a restart from the checkpoint; a late row changes nothing."""
    videos = dict(tracks_of(random.Random(32)))
    rows = [(v, 10 * i, g, s) for v, fs in videos.items() for i, (g, s) in enumerate(fs, 1)]
    schema = "video long, frame long, gray double, step long"
    want = {(v, *k) for v, fs in videos.items() for k in by_hand(fs, False)}

    def feed(part):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = live.keyframes(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"))
        stream.writeStream.option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/log").format("parquet").trigger(availableNow=True).start().awaitTermination()

    for lo, hi in ((0, 7), (7, 60), (60, 61), (61, 400)):
        feed([r for r in rows if lo < r[1] // 10 <= hi])
    feed([(1, 33, 9.0, 1)])
    got = [tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").select("video", "frame", "segment", "reason").collect()]
    gone = {r[:2] for r in got if r[3] == "withdrawn"}
    assert gone and {r for r in got if r[:2] not in gone and r[3] != "late"} == want and [r[:2] for r in got if r[3] == "late"] == [(1, 33)]


def test_log_order(spark):
    """Entries follow their lines where trial numbers restart."""
    rows = [("d", 1, 40, "Snapshot", 0), ("d", 2, 41, "Snapshot", 3_000_000), ("d", 3, 1, "Other", 4_000_000), ("d", 4, 2, "Snapshot", 9_000_000)]
    entries = spark.createDataFrame(rows, "dataset string, line_no long, trial long, type string, us long")
    assert [tuple(r) for r in acq.snapshot_gaps(entries).orderBy("gap_s").collect()] == [("d", 40, None), ("d", 41, 3.0), ("d", 2, 6.0)]
    r = acq.log_counts(entries).first()
    assert (r.n_snapshots, r.n_others, r.first_type, r.last_type) == (3, 1, "Snapshot", "Snapshot")


def test_skipped_folders(spark):
    files = [("one/log.txt", 5), ("one/001.xml", 9), ("two/log.txt", 0), ("two/001.xml", 9), ("two/deep/log.txt", 5), ("two/deep/001.xml", 4), ("three/log.txt", 1), ("three/001.xml", 0), ("four/001.xml", 3), ("a/b/c/log.txt", 1), ("a/b/c/001.xml", 1)]
    listing = spark.createDataFrame([(f"/r/{p}", n) for p, n in files], "path string, length long")
    assert [tuple(r) for r in acquisition.scan(listing, "/r").collect()] == [("one", 1)]
    assert sorted(tuple(r) for r in acquisition.skipped_folders(listing, "/r").collect()) == [("three", "no trial can be read"), ("two", "the log is empty")]


def test_empty_and_null_rows(spark):
    track = "video long, frame long, gray double, step long, response double"
    tiles = "dataset long, trial long, state string, x double, y double, mx double, my double, ncc double, margin double, diverted boolean, stale boolean, seq long, status string, r double, last_x double, last_y double"
    for rows in ([], [(1, 1, None, None, None), (1, 2, 9.0, None, None)]):
        df = spark.createDataFrame(rows, track)
        for f in (tracks.segments, tracks.shoulders, tracks.dwells, tracks.travel_keyframes, tracks.track_statistics, tracks.sampled_frames, tracks.tone_frames, tracks.activity):
            f(df).collect()
    for rows in ([], [(1, 1, *[None] * 14), (1, 2, "anchor", None, 1.0, *[None] * 11)]):
        df = spark.createDataFrame(rows, tiles)
        for f in (documents.normalised, lambda t: documents.provenance(t, t.selectExpr("dataset", "state as build")), documents.trusted, spatial.pair_blocks, spatial.coverage, layout.state_counts, documents.active, documents.without_machine, documents.edit_tallies, documents.covered_blocks, documents.seed_shift, documents.position_stamp, documents.neighbours, lambda t: documents.problems(t, t.selectExpr("dataset", "trial as lo", "trial as hi", "trial as origin", "trial as cursor"), t), lambda t: documents.seeded(t, t.selectExpr("dataset", "trial", "x as bx", "y as by")), lambda t: review.quality_report(t, review.build_staleness(t, t, t)), lambda t: review.rechecked(t, t.selectExpr("dataset", "trial", "x as bx", "y as by")), lambda t: scoring.report(t, t.withColumn("r", t["x"]), t)):
            f(df).collect()
    frames = spark.createDataFrame([(1, 1, 0, 0, None), (2, 1, 0, 0, [])], "frame long, grp long, x long, y long, px array<double>")
    for f in (pixels.pixel_statistics, pixels.exposure, pixels.peaks, pixels.composite, pixels.median_composite, pixels.tone):
        assert f(frames).collect() == []


def test_stale_after(spark):
    tiles = spark.createDataFrame([(1, t, "human", 1.0, 1.0, s) for t, s in ((1, 1), (2, 5), (3, 9), (4, 7))], "dataset long, trial long, state string, x double, y double, seq long")
    edits = spark.createDataFrame([(1, 4, 5)], "dataset long, trial long, seq long")
    assert [tuple(r) for r in documents.stale_after(tiles, edits).collect()] == [(1, 3)]


def test_link_verdicts_by_kind(spark):
    rows = [  # kind, prior, measured, response, ncc; frames of 512 x 512
        ("seq", (100.0, 0.0), (190.0, 0.0), 0.1, 0.9, "ok"), ("seq", (100.0, 0.0), (201.0, 0.0), 0.1, 0.9, "correction_too_large"),
        ("cross", (0.0, 0.0), (290.0, 0.0), 0.1, 0.9, "ok"), ("cross", (0.0, 0.0), (301.0, 0.0), 0.1, 0.9, "correction_too_large"),
        ("bridge", (0.0, 0.0), (400.0, 100.0), 0.08, 0.3, "ok"), ("bridge", (0.0, 0.0), (400.0, 100.0), 0.07, 0.3, "weak_phase_response"),
        ("bridge", (0.0, 0.0), (400.0, 100.0), 0.08, 0.29, "low_ncc_at_measured"), ("seq", (481.0, 0.0), (400.0, 0.0), 0.01, 0.9, "no_overlap_at_prior"),
        ("cross", (450.0, 0.0), (400.0, 0.0), 0.9, 0.9, "no_overlap_at_prior"), ("seq", (450.0, 0.0), (450.0, 0.0), 0.9, 0.9, "ok"),
        ("bridge", (0.0, 0.0), (-490.0, 0.0), 0.9, 0.0, "no_overlap_at_measured"), ("seq", (900.0, 900.0), (0.0, 0.0), 0.9, 0.9, "no_overlap_at_prior"),
    ]
    links = spark.createDataFrame([(i, k, *p, *m, r, n) for i, (k, p, m, r, n, _) in enumerate(rows)], "a long, kind string, px double, py double, dx double, dy double, response double, ncc double")
    got = {r.a: r.verdict for r in layout.link_verdicts(links).collect()}
    assert got == {i: row[-1] for i, row in enumerate(rows)}


def test_runs_and_steps_of_dense_tables(spark):
    tiles = spark.createDataFrame([(1, t, 10.0 * t, 0.9) for t in (1, 2, 3, 5, 6, 9)], "dataset long, trial long, x double, ncc double")
    got = [(r.trial, r.run, r.local_x) for r in layout.rigid_runs(tiles).orderBy("trial").collect()]
    assert got == [(1, 1, 0.0), (2, 1, 10.0), (3, 1, 20.0), (5, 2, 0.0), (6, 2, 10.0), (9, 3, 0.0)]
    links = spark.createDataFrame([(1, 1, 3, 500.0), (1, 3, 5, 500.0)], "dataset long, a long, b long, dx double")
    assert [(r.a, r.b) for r in documents.gated_links(links, layout.rigid_runs(tiles)).collect()] == [(1, 3)]
    grid = spark.createDataFrame([(1, c, 1, 14.0 * c, 0.0, 1) for c in range(1, 6)], "mosaic long, col long, row long, x double, y double, kind int")
    assert [tuple(r) for r in layout.neighbour_steps(grid).orderBy("col").collect()] == [(1, c, 1, "col", 14.0, 0.0) for c in range(1, 5)]
    assert [tuple(r) for r in layout.step_statistics(grid).collect()] == [(1, 5, 0, 1.0, 4, 0.0, 0.0)]


def test_budget_is_greedy(spark):
    rng = random.Random(3)
    rows = list({(v, a, b): (v, a, b, float(rng.randrange(40))) for v in (1, 2) for _ in range(400) for a, b in [sorted(rng.sample(range(60), 2))]}.values())
    want = set()
    for v in (1, 2):
        used = Counter()
        for _, a, b, d in sorted((r for r in rows if r[0] == v), key=lambda r: (r[3], r[1], r[2])):
            if used[a] < 6 and used[b] < 6:
                used[a], used[b] = used[a] + 1, used[b] + 1
                want.add((v, a, b, d))
    got = spatial.budgeted(spark.createDataFrame(rows, "video long, a long, b long, distance double")).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_xml_files_and_frames(spark, tmp_path):
    head = '<?xml version="1.0"?><trial><info type="{t}" trial="{k}" date="260620" time="154810"/><ccd><camera frames="{f}" serpix="4" parpix="2" typebytes="2" type="uint16">{x}</camera></ccd></trial>'
    flip = '<transform ax="-1" ay="1"/>'
    (tmp_path / "one").mkdir()
    for k, text in enumerate([head.format(t="snapshot", k=1, f=1, x=flip), head.format(t="movie", k=2, f=1, x=""), head.format(t="snapshot", k=3, f=2, x=""), "<trial><info", head.format(t="snapshot", k=5, f=1, x=""), ""], 1):
        (tmp_path / "one" / f"{k:03d}.xml").write_text(text)
    for k, n in ((1, 16), (5, 15)):
        (tmp_path / "one" / f"{k:03d}-ccd.dat").write_bytes(bytes(range(n)))
    (tmp_path / "one" / "log.txt").write_text("x")
    meta = acquisition.trial_meta(acquisition.read_xml(spark, str(tmp_path)))
    assert sorted((r.trial, r.time, r.w, r.h, r.flip_x, r.flip_y) for r in meta.collect()) == [(1, "2026-06-20T15:48:10Z", 4, 2, True, False), (5, "2026-06-20T15:48:10Z", 4, 2, False, False)]
    files = acquisition.list_files(spark, str(tmp_path))
    frames = acquisition.frame_files(files)
    assert [r.trial for r in acquisition.inventory(meta, frames).collect()] == [1]
    raw = spark.read.format("binaryFile").load(f"{tmp_path}/one/*.dat").selectExpr("'one' AS dataset", "cast(regexp_extract(path, '([0-9]{3})-ccd', 1) as long) AS trial", "content AS px")
    got = {r.trial: (r.px, r.refused) for r in acquisition.load_frames(meta, raw).collect()}
    le = [i + 256 * (i + 1) for i in range(0, 16, 2)]
    assert got == {1: ([float(v) for v in le[3::-1] + le[:3:-1]], None), 5: (None, "size")}
    root = files.first().path.rsplit("/", 2)[0]
    assert [tuple(r) for r in acquisition.scan(files, root).collect()] == [("one", 5)]  # an empty file is not listed


def test_maps_and_canvases_on_disk(spark, tmp_path):
    e = spark.createDataFrame([(1, 2, 1, 10.0, 20.0, 1), (1, 1, 1, 1.005, 2.0, 2), (1, 1, 2, 5.0, 6.0, 1)], "mosaic long, col long, row long, x double, y double, kind int")
    (row,) = tables.electrode_payload(e, coverage="full").collect()
    doc = json.loads(row.json)
    assert doc["cells"]["col"] == [1, 2, 1] and doc["cells"]["row"] == [1, 1, 2] and doc["cells"]["kind"] == [2, 1, 1] and doc["array_coverage"] == "full"
    tables.write_electrodes(e, f"{tmp_path}/e")
    lines = next((tmp_path / "e" / "mosaic=1").glob("*.csv")).read_text().splitlines()
    assert lines[0] == "electrode,col,row,x,y,x_um,y_um,kind,coverage" and [x.split(",")[0] for x in lines[1:]] == ["1-1", "2-1", "1-2"]
    frames = registry.V["frames8"](spark, SF).limit(50)
    pixels.write_canvas(frames, f"{tmp_path}/c", block=16)
    back = spark.read.parquet(f"{tmp_path}/c")
    want = {(r.grp, r.cx, r.cy): r.px for r in pixels.composite(frames, block=16).collect()}
    got = {(r.grp, r.bx * 16 + i % 16, r.by * 16 + i // 16): v for r in back.collect() for i, (v, c) in enumerate(zip(r.px, r.covered)) if c}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in got)


def test_live_log_over_batches(spark, tmp_path):
    lines = ["06/20/26 23:59:30 Trial 010: Snapshot", "00:00:10 Trial 011: Other", "nonsense", "00:00:20 Trial 012: Snapshot", "06/25/26 01:00:00 Trial 013: Snapshot"]
    schema = "dataset string, line_no long, value string"
    for part in ([(0, lines[0]), (1, lines[1])], [(3, lines[3]), (2, lines[2]), (4, lines[4])], [(1, lines[1]), (5, None)]):
        spark.createDataFrame([("d", k, v) for k, v in part], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = live_logs.entries(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"))
    stream.writeStream.option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/log").format("parquet").trigger(availableNow=True).start().awaitTermination()
    got = sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").where("not late").select("trial", "s", "gap_s").collect())
    batch = logs.parse(spark.createDataFrame([("d", k, v) for k, v in enumerate(lines)], schema))
    s = {r.trial: r.s for r in batch.collect()}
    assert got == [(10, s[10], None), (11, s[11], None), (12, s[12], float(s[12] - s[10])), (13, s[13], float(s[13] - s[12]))]
    assert [tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").where("late").select("line_no").collect()] == [(1,)]


def test_sample_stays_spread(spark):
    track = pd.read_parquet(f"{SF}/events.parquet")
    got = registry.QUERIES["live_sample"](spark, SF).toPandas()
    for user, rows in track.groupby("user_id"):
        seen, stride, held = 0, 1, []
        for e, v in sorted(zip(rows.event_id, rows.value)):
            if v >= 3 and int(v * 100 // 1) % 700 >= 50:
                if seen % stride == 0:
                    held.append(e)
                    if len(held) >= 2 * live.SAMPLE:
                        held, stride = held[::2], 2 * stride
                seen += 1
        own = got[got.video == user].sort_values("place")
        assert own.frame.tolist() == held and (not held or (own.seen.iloc[0], own.stride.iloc[0]) == (seen, stride))


def unbroadcast(df):
    return "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_null_draws(spark, tmp_path, monkeypatch):
    """Draws of datasets of any size, looked up in an array or joined; no side of a join is broadcast, as the planner doesn't know how many draws there are."""
    rows = [(d, 10 * t + d) for d, size in ((1, 1), (2, 7), (3, 40)) for t in range(size)]
    spark.createDataFrame([*rows, (None, 5)], "dataset long, trial long").write.parquet(f"{tmp_path}/tiles")
    tiles = spark.read.parquet(f"{tmp_path}/tiles")
    listed = {d: sorted(t for e, t in rows if e == d) for d in (1, 2, 3)}
    at = lambda d, k, end: listed[d][int(hashlib.md5(f"11:{d}:{k}:{end}".encode()).hexdigest()[:8], 16) % len(listed[d])]
    for held in (4096, 7, 0):
        monkeypatch.setattr(spatial, "HELD", held)
        got = spatial.null_draws(tiles, n=50)
        assert unbroadcast(got)
        assert held < 4096 or got.select(F.spark_partition_id()).distinct().count() > 1
        assert sorted(tuple(r) for r in got.collect()) == [(d, k, at(d, k, "a"), at(d, k, "b")) for d in (1, 2, 3) for k in range(50)]


def test_nearby_pairs_of_stored_tiles(spark, tmp_path):
    """Tiles in files look small, and each looks into nine buckets: neither side of the join is broadcast."""
    spark.range(200).selectExpr("0L AS dataset", "id AS trial", "double(id) * 300 AS x", "0D AS y").write.parquet(f"{tmp_path}/tiles")
    got = layout.nearby_pairs(spark.read.parquet(f"{tmp_path}/tiles"))
    assert unbroadcast(got)
    assert sorted((r.a, r.b, r.overlap_px) for r in got.collect()) == [(i, i + 1, 212 * 512) for i in range(199)]


def test_blank_proposal_of_equal_textures(spark):
    """Where the values beside the percentile are equal, the SQL's threshold may lie a last digit above them, so that they count as blank."""
    groups = [[0.1] * 22, [0.4] * 22, [0.82] * 21 + [0.9], [0.3, 1.0] * 11, [0.0] * 24, [5.0] * 19, [float("inf")] * 30, [0.01, 0.29] * 40, [1.91] * 12 + [2.0] * 60, [None] * 25, [1.35] * 105 + [None, 0.5]]
    rows = [(d, i + 1, v) for d, g in enumerate(groups) for i, v in enumerate(g)] + [(20 + d, i + 1, round(0.03 + d / 10, 2)) for d in range(40) for i in range(21 + d)]
    got = documents.blank_proposal(spark.createDataFrame(rows, "dataset long, trial long, texture double"), spark.createDataFrame([(3, 20)], "dataset long, split long"))
    con = duckdb.connect()
    con.execute("CREATE TABLE w (dataset BIGINT, texture DOUBLE, one BOOLEAN)")
    con.executemany("INSERT INTO w VALUES (?, ?, ?)", [(d, v, d != 3 or t <= 20) for d, t, v in rows])
    body = registry._SQL["blank_proposal"]
    threshold = body[1][body[1].index("h AS (SELECT dataset, CASE WHEN count(texture)") :]
    want = con.execute(f"WITH {threshold} {body[2]}").fetchall()
    assert sorted((r.dataset, r.threshold, r.n_blank, str(r.margin)) for r in got.collect()) == sorted((d, t, n, str(m)) for d, t, n, m in want)
    assert {d for d, _, n, _ in want if n == len(groups[d] if d < 20 else range(1 + d))} >= {0, 1}
