"""Registered queries of files, documents, reviews, scores, areas, pixels and streams, with the SQL each is held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lamella.functions import scalars
from lamella.operators import acquisition as acq
from lamella.operators import documents, layout, pixels, review, scoring, spatial, tracks
from lamella.plans.session import scratch
from lamella.sources import acquisition, logs, views
from lamella.sources import documents as tables
from lamella.streaming import logs as live_logs
from lamella.streaming import tracks as live

QUERIES, SQL = {}, {}


def query(name: str, needs: str, more: str, body: str | None):
    """Registers a query with the views its SQL needs, further CTEs and the SQL itself."""

    def add(function):
        QUERIES[name] = function
        if body:
            SQL[name] = (needs, more, body)
        return function

    return add


# files of an acquisition


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.read(spark, sf_dir, "orders").withColumn("k", F.col("o_orderkey")).withColumn("dataset", F.col("o_custkey") % 50)


def _xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trial XML of orders: some films, some of two frames, some without transform or date, some cut short."""
    k = F.col("k")
    time = F.lpad((k % 24 * 10000 + k % 60 * 100 + k % 60).cast("string"), 6, "0")
    side = F.when(k % 11 == 0, "128").otherwise("512")
    flips = F.concat(F.lit('<transform ax="'), F.when(k % 2 == 0, "-1").otherwise("1"), F.lit('" ay="'), F.when(k % 5 < 3, "-1").otherwise("1"), F.lit('"/>'))
    xml = F.concat(
        F.lit('<trial><info type="'), F.when(k % 13 == 0, "movie").otherwise("snapshot"), F.lit('" trial="'), k.cast("string"), F.lit('" date="'), F.when(k % 19 == 0, "").otherwise("260620"), F.lit('" time="'), time,
        F.lit('"/><ccd><camera frames="'), F.when(k % 7 == 0, "2").otherwise("1"), F.lit('" serpix="512" parpix="'), side, F.lit('" typebytes="2" type="uint16">'), F.when(k % 3 == 0, "").otherwise(flips), F.lit("</camera></ccd></trial>"),
    )
    return _orders(spark, sf_dir).select("dataset", F.when(k % 17 == 0, F.substring(xml, 1, 90)).otherwise(xml).alias("xml"))


_META = """x AS (SELECT o_custkey % 50 AS dataset, o_orderkey AS trial, CASE WHEN o_orderkey % 19 = 0 THEN '' ELSE printf('2026-06-20T%02d:%02d:%02dZ', o_orderkey % 24, o_orderkey % 60, o_orderkey % 60) END AS time,
  512 AS w, CASE WHEN o_orderkey % 11 = 0 THEN 128 ELSE 512 END AS h, 2 AS bytes, 'uint16' AS dtype, o_orderkey % 3 <> 0 AND o_orderkey % 2 = 0 AS flip_x, o_orderkey % 3 <> 0 AND o_orderkey % 5 < 3 AS flip_y
  FROM orders WHERE o_orderkey % 13 <> 0 AND o_orderkey % 7 <> 0 AND o_orderkey % 17 <> 0)"""


@query("trial_xml", "", _META, "SELECT * FROM x")
def trial_xml(spark, sf_dir):
    return acquisition.trial_meta(_xml(spark, sf_dir))


@query("frame_inventory", "", _META, "SELECT dataset, trial, w, h FROM x WHERE trial % 29 <> 0 AND trial % 23 <> 0")
def frame_inventory(spark, sf_dir):
    k = F.col("k")
    size = F.when(k % 11 == 0, 131072).otherwise(524288) - F.when(k % 23 == 0, 2).otherwise(0)
    frames = _orders(spark, sf_dir).where(k % 29 != 0).select("dataset", k.alias("trial"), size.alias("length"))
    return acquisition.inventory(acquisition.trial_meta(_xml(spark, sf_dir)), frames).select("dataset", "trial", "w", "h")


@query("frame_notes", "", _META.replace("o_orderkey % 3 <> 0 AND o_orderkey % 2 = 0", "CASE WHEN o_custkey % 5 = 0 THEN o_orderkey % 2 = 0 ELSE o_custkey % 50 % 2 = 0 END").replace("o_orderkey % 3 <> 0 AND o_orderkey % 5 < 3", "o_custkey % 50 % 3 = 0"), """
SELECT dataset, CASE WHEN min(flip_x::INT + flip_y::INT) = 2 THEN 'rotated' WHEN max(flip_x::INT + flip_y::INT) = 0 THEN 'raw' WHEN min(flip_x::INT) = 1 AND max(flip_y::INT) = 0 THEN 'mirrored_x'
  WHEN min(flip_y::INT) = 1 AND max(flip_x::INT) = 0 THEN 'mirrored_y' ELSE 'mixed' END AS note FROM x GROUP BY dataset""")
def frame_notes(spark, sf_dir):
    d, k = F.col("dataset"), F.col("trial")
    meta = acquisition.trial_meta(_xml(spark, sf_dir))
    return acquisition.frame_notes(meta.withColumn("flip_x", F.when(d % 5 == 0, k % 2 == 0).otherwise(d % 2 == 0)).withColumn("flip_y", d % 3 == 0))


@query("raw_frames", "", """f AS (SELECT label::BIGINT AS dataset, vec_id AS trial, vec_id % 2 = 0 AS fx, vec_id % 3 = 0 AS fy, list_transform(embedding, lambda v: floor(abs(v::DOUBLE) * 60000)::BIGINT) AS u FROM embeddings),
  g AS (SELECT *, CASE WHEN trial % 31 = 0 THEN 'pixel_type' WHEN trial % 37 = 0 THEN 'size' END AS refused FROM f)""", """
SELECT dataset, trial, refused, CASE WHEN refused IS NULL THEN list_sum(list_transform(range(0, 64), lambda i: (i + 1) * u[(CASE WHEN fy THEN 7 - i // 8 ELSE i // 8 END) * 8 + (CASE WHEN fx THEN 7 - i % 8 ELSE i % 8 END) + 1]))::BIGINT END AS checksum FROM g""")
def raw_frames(spark, sf_dir):
    byte = lambda v: F.lpad(F.hex(v), 2, "0")
    units = F.transform("embedding", lambda v: F.floor(F.abs(v.cast("double")) * 60000))
    px = F.unhex(F.array_join(F.transform(units, lambda u: F.concat(byte(u % 256), byte(F.floor(u / 256)))), ""))
    rows = views.read(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("dataset"), F.col("vec_id").alias("trial"), px.alias("px"))
    k = F.col("trial")
    meta = rows.select("dataset", "trial", F.lit(8).alias("w"), F.lit(8).alias("h"), F.lit(2).alias("bytes"), F.when(k % 31 == 0, "int32").otherwise("uint16").alias("dtype"), (k % 2 == 0).alias("flip_x"), (k % 3 == 0).alias("flip_y"))
    raw = rows.select("dataset", "trial", F.when(k % 37 == 0, F.substring("px", 1, 126)).otherwise(F.col("px")).alias("px"))
    loaded = acquisition.load_frames(meta, raw)
    weighted = F.transform("px", lambda v, i: v.cast("long") * (i + 1))
    return loaded.select("dataset", "trial", "refused", F.when(F.col("refused").isNull(), F.aggregate(weighted, F.lit(0).cast("long"), lambda s, v: s + v)).alias("checksum"))


_LISTED = """l AS (SELECT o_orderkey AS k, o_orderkey % 40 AS d, o_orderkey // 40 AS m FROM orders),
  p AS (SELECT CASE d % 4 WHEN 0 THEN ['a' || d] || CASE WHEN m % 11 = 0 THEN ['inner'] ELSE [] END WHEN 1 THEN ['b' || d, 'sub' || m % 7] WHEN 2 THEN ['.hid' || d] ELSE ['c' || d, 'x', 'y', 'z'] END AS dirs,
        CASE m % 5 WHEN 0 THEN 'log.txt' WHEN 1 THEN printf('%03d', k % 1000) || '.xml' ELSE 'note.txt' END AS name, CASE WHEN d % 8 = 4 AND m % 5 = 0 OR d % 8 = 5 AND m % 5 = 1 THEN 0 ELSE 9 END AS length FROM l),
  f AS (SELECT array_to_string(dirs, '/') AS folder, count(*) FILTER (name LIKE '%.xml') AS n_xml, count(*) FILTER (name = 'log.txt') AS n_log, count(*) FILTER (name LIKE '%.xml' AND length > 0) AS full_xml, count(*) FILTER (name = 'log.txt' AND length > 0) AS full_log
        FROM p WHERE len(dirs) < 3 AND len(list_filter(dirs, lambda d: d[1] IN ('.', '$'))) = 0 GROUP BY 1),
  q AS (SELECT *, CASE WHEN full_log = 0 THEN 'the log is empty' WHEN full_xml = 0 THEN 'no trial can be read' END AS reason FROM f WHERE n_xml > 0 AND n_log > 0), t AS (SELECT * FROM q WHERE NOT EXISTS (SELECT 1 FROM q AS o WHERE starts_with(q.folder, o.folder || '/')))"""


def _listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of folders at several depths: datasets, datasets inside others, hidden and too deep ones, some with empty files."""
    rows = _orders(spark, sf_dir).select("k", (F.col("k") % 40).alias("d"), F.floor(F.col("k") / 40).alias("m"))
    d, k, m = F.col("d"), F.col("k"), F.col("m")
    text = lambda c: c.cast("string")
    folder = (
        F.when(d % 4 == 0, F.concat(F.lit("a"), text(d), F.when(m % 11 == 0, "/inner").otherwise(""))).when(d % 4 == 1, F.concat(F.lit("b"), text(d), F.lit("/sub"), text(m % 7)))
        .when(d % 4 == 2, F.concat(F.lit(".hid"), text(d))).otherwise(F.concat(F.lit("c"), text(d), F.lit("/x/y/z")))
    )
    name = F.when(m % 5 == 0, "log.txt").when(m % 5 == 1, F.concat(F.lpad(text(k % 1000), 3, "0"), F.lit(".xml"))).otherwise("note.txt")
    length = F.when((d % 8 == 4) & (m % 5 == 0) | (d % 8 == 5) & (m % 5 == 1), 0).otherwise(9)
    return rows.select(F.concat(F.lit("/data/surveys/"), folder, F.lit("/"), name).alias("path"), length.alias("length"))


@query("scanned_folders", "", _LISTED, "SELECT folder, n_xml FROM t WHERE reason IS NULL")
def scanned_folders(spark, sf_dir):
    return acquisition.scan(_listing(spark, sf_dir), "/data/surveys/")


@query("skipped_folders", "", _LISTED, "SELECT folder, reason FROM t WHERE reason IS NOT NULL")
def skipped_folders(spark, sf_dir):
    return acquisition.skipped_folders(_listing(spark, sf_dir), "/data/surveys/")


@query("readable_trials", "entries trial_meta", "s AS (SELECT DISTINCT dataset, trial FROM entries WHERE type = 'Snapshot'), m AS (SELECT DISTINCT dataset, trial FROM trial_meta)", """
SELECT coalesce(s.dataset, m.dataset) AS dataset, count(s.trial) AS n_logged, count(m.trial) AS n_framed, count(s.trial + m.trial) AS n_both FROM s FULL JOIN m ON s.dataset = m.dataset AND s.trial = m.trial GROUP BY 1""")
def readable_trials(spark, sf_dir):
    return acquisition.readable(views.entries(spark, sf_dir), views.trial_meta(spark, sf_dir))


@query("mixed_shapes", "trial_meta", "", "SELECT dataset, count(DISTINCT (w, h)) AS n_shapes FROM trial_meta GROUP BY dataset HAVING count(DISTINCT (w, h)) > 1")
def mixed_shapes(spark, sf_dir):
    return acquisition.mixed_shapes(views.trial_meta(spark, sf_dir))


@query("missing_frames", "entries trial_meta", "", "SELECT DISTINCT dataset, trial FROM entries e WHERE type = 'Snapshot' AND NOT EXISTS (SELECT 1 FROM trial_meta m WHERE m.dataset = e.dataset AND m.trial = e.trial)")
def missing_frames(spark, sf_dir):
    return acquisition.missing_frames(acq.snapshots(views.entries(spark, sf_dir)), views.trial_meta(spark, sf_dir))


@query("chosen_run", "entries", """s AS (SELECT * FROM entries WHERE type = 'Snapshot'), i AS (SELECT dataset, trial, trial - row_number() OVER (PARTITION BY dataset ORDER BY trial) AS island FROM s),
  b AS (SELECT dataset, min(trial) AS lo, max(trial) AS hi, count(*) AS n FROM i GROUP BY dataset, island), l AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY n DESC, lo) = 1),
  u AS (SELECT DISTINCT dataset, CASE WHEN dataset % 4 = 0 THEN 30 ELSE 10 END AS ulo, 25 AS uhi FROM entries WHERE dataset % 2 = 0), c AS (SELECT u.dataset, count(*) AS un FROM u JOIN s ON s.dataset = u.dataset AND trial BETWEEN ulo AND uhi GROUP BY u.dataset)""", """
SELECT coalesce(l.dataset, u.dataset) AS dataset, CASE WHEN ulo > uhi THEN NULL WHEN ulo IS NOT NULL THEN ulo ELSE lo END AS lo, CASE WHEN ulo > uhi THEN NULL WHEN ulo IS NOT NULL THEN uhi ELSE hi END AS hi,
  CASE WHEN ulo > uhi THEN NULL WHEN ulo IS NOT NULL THEN coalesce(un, 0) ELSE n END AS n, CASE WHEN ulo > uhi THEN 'refused' WHEN ulo IS NOT NULL THEN 'asked' ELSE 'longest' END AS why
FROM l FULL JOIN u ON l.dataset = u.dataset LEFT JOIN c ON c.dataset = u.dataset""")
def chosen_run(spark, sf_dir):
    entries = views.entries(spark, sf_dir)
    ranges = entries.where("dataset % 2 = 0").select("dataset").distinct().select("dataset", F.when(F.col("dataset") % 4 == 0, 30).otherwise(10).cast("long").alias("lo"), F.lit(25).cast("long").alias("hi"))
    return acq.chosen_run(entries, ranges)


@query("square_frames", "trial_meta", "", "SELECT dataset, trial FROM trial_meta WHERE w = 512 AND h = 512")
def square_frames(spark, sf_dir):
    return acq.square(views.trial_meta(spark, sf_dir))


# documents, truths, electrode maps, regions, keyframes


def _statuses(tiles: DataFrame) -> DataFrame:
    """Tiles as documents hold them: some unplaced, some with half a machine position, some without radius."""
    k = F.col("trial")
    machine = F.when(k % 8 == 0, F.array("mx")).when(k % 10 != 0, F.array("mx", "my"))
    return tiles.select("dataset", "trial", F.col("state").alias("status"), F.when(k % 6 != 0, F.col("x")).alias("x"), F.when(k % 6 != 0, F.col("y")).alias("y"), F.when(k % 3 == 0, 40.0).alias("r"), machine.alias("machine"), F.when(k % 7 != 0, F.col("ncc")).alias("ncc"))


def _json(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _statuses(views.tiles(spark, sf_dir))
    key = F.when(F.col("trial") % 77 == 0, F.concat(F.lit("0"), F.col("trial").cast("string"))).otherwise(F.col("trial").cast("string"))
    tile = F.struct(key.alias("key"), F.struct("status", "x", "y", "r", "machine", "ncc").alias("value"))
    docs = rows.groupBy("dataset").agg(F.map_from_entries(F.collect_list(tile)).alias("tiles"))
    return docs.select("dataset", F.to_json(F.struct("tiles", F.struct(F.lit(96.0).alias("region_default")).alias("tolerance_px"), F.lit("kept").alias("note"))).alias("json"))


_DOC = "d AS (SELECT dataset, trial, state AS status, CASE WHEN trial % 6 <> 0 THEN x END AS x, CASE WHEN trial % 6 <> 0 THEN y END AS y, CASE WHEN trial % 3 = 0 THEN 40.0 ELSE 96.0 END::DOUBLE AS r, CASE WHEN trial % 8 <> 0 AND trial % 10 <> 0 THEN mx END AS mx, CASE WHEN trial % 8 <> 0 AND trial % 10 <> 0 THEN my END AS my, CASE WHEN trial % 7 <> 0 THEN ncc END AS ncc FROM tiles WHERE trial % 77 <> 0)"


@query("document_tiles", "tiles", _DOC, "SELECT * FROM d")
def document_tiles(spark, sf_dir):
    return tables.tile_rows(_json(spark, sf_dir)).select("dataset", "trial", "status", "x", "y", "r", "mx", "my", "ncc")


@query("truth_rows", "tiles", _DOC, "SELECT dataset, trial, x, y, r FROM d WHERE status = 'anchor' AND x IS NOT NULL")
def truth_rows(spark, sf_dir):
    return tables.truth_rows(_json(spark, sf_dir))


@query("truth_round_trip", "tiles", "", "SELECT dataset, trial, x, y, CASE WHEN trial % 3 = 0 THEN 40.0 ELSE 256.0 END::DOUBLE AS r FROM tiles WHERE state = 'anchor'")
def truth_round_trip(spark, sf_dir):
    tiles = views.tiles(spark, sf_dir).withColumn("status", F.col("state")).withColumn("r", F.when(F.col("trial") % 3 == 0, 40.0))
    return tables.truth_rows(tables.truth_documents(tiles, 256.0))


@query("positions_round_trip", "tiles", "", "SELECT dataset::VARCHAR AS dataset, trial, x, y, state FROM tiles WHERE state <> 'excluded'")
def positions_round_trip(spark, sf_dir):
    path = scratch(spark, "positions")
    logs.write_positions(views.tiles(spark, sf_dir), path)
    return logs.read_positions(spark, path)


@query("electrode_table", "electrodes", "", "SELECT mosaic, col || '-' || row AS electrode, col, row, round(x + 10.0, 2) AS x, round(y - 4.5, 2) AS y, NULL::DOUBLE AS x_um, NULL::DOUBLE AS y_um, CASE kind WHEN 1 THEN 'detected' ELSE 'inferred' END AS kind, 'full' AS coverage FROM electrodes")
def electrode_table(spark, sf_dir):
    return tables.electrode_rows(views.electrodes(spark, sf_dir), "full", (10.0, -4.5))


@query("current_maps", "", """f AS (SELECT o_custkey % 50 AS mosaic, 'map' || o_orderkey AS path, epoch_us(o_orderdate) AS modified, o_orderkey AS k FROM orders), r AS (SELECT mosaic, 'map' || min(k) AS path FROM f WHERE mosaic % 3 = 0 GROUP BY mosaic UNION ALL SELECT DISTINCT mosaic, 'gone' FROM f WHERE mosaic % 3 = 1)""", """
SELECT f.mosaic, f.path, r.path IS NOT NULL AS recorded FROM f LEFT JOIN r ON f.mosaic = r.mosaic AND f.path = r.path QUALIFY row_number() OVER (PARTITION BY f.mosaic ORDER BY r.path IS NOT NULL DESC, modified DESC, f.path DESC) = 1""")
def current_maps(spark, sf_dir):
    k = F.col("k")
    rows = _orders(spark, sf_dir).select(F.col("dataset").alias("mosaic"), F.concat(F.lit("map"), k.cast("string")).alias("path"), F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("modified"), "k")
    named = rows.where("mosaic % 3 = 0").groupBy("mosaic").agg(F.concat(F.lit("map"), F.min("k").cast("string")).alias("path"))
    gone = rows.where("mosaic % 3 = 1").select("mosaic", F.lit("gone").alias("path")).distinct()
    return tables.current_maps(rows.drop("k"), named.unionByName(gone))


_INSIDE = """i AS (SELECT region, count(*) AS n, string_agg(col || '-' || row, ' ' ORDER BY col || '-' || row) AS ids FROM electrodes e JOIN regions r ON e.mosaic = r.mosaic AND e.x >= r.x AND e.x < r.x + r.w AND e.y >= r.y AND e.y < r.y + r.h GROUP BY region)"""


@query("region_lines", "electrodes regions", _INSIDE, '''SELECT r.region, concat_ws(',', r.region, CASE WHEN r.region % 4 = 0 THEN '"site, ""' || r.region || '"""' ELSE 'site ' || r.region END, 'v' || r.region, 'placed', 'machine', printf('%.2f', x), printf('%.2f', y), printf('%.2f', w), printf('%.2f', h), printf('%.6f', 0.4), 'median',
  CASE WHEN r.region % 3 = 0 THEN '' ELSE printf('%.4f', r.region % 100 / 100.0) END, '', CASE WHEN r.region % 2 = 0 THEN 'true' ELSE 'false' END, coalesce(n::VARCHAR, ''), coalesce(ids, '')) AS line FROM regions r LEFT JOIN i ON r.region = i.region''')
def region_lines(spark, sf_dir):
    regions = views.regions(spark, sf_dir)
    inside = layout.electrodes_in_regions(views.electrodes(spark, sf_dir), regions)
    r = F.col("region")
    name = F.when(r % 4 == 0, F.concat(F.lit('site, "'), r.cast("string"), F.lit('"'))).otherwise(F.concat(F.lit("site "), r.cast("string")))
    rows = regions.join(inside.select("region", "n", "ids"), "region", "left").select(
        "region", name.alias("name"), F.concat(F.lit("v"), r.cast("string")).alias("video"), F.lit("placed").alias("status"), F.lit("machine").alias("placed_by"), "x", "y", "w", "h", F.lit(0.4).alias("scale"), F.lit("median").alias("still_kind"),
        F.when(r % 3 != 0, r % 100 / 100.0).alias("ncc"), F.lit(None).cast("double").alias("margin"), (r % 2 == 0).alias("confident"), "n", "ids",
    )
    return tables.region_lines(rows)


def _numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyframes with places and made-up positions."""
    rows = tracks.travel_keyframes(views.frame_track(spark, sf_dir))
    i = (F.row_number().over(Window.partitionBy("video").orderBy("frame")) - 1).cast("long")
    return rows.withColumn("i", i).withColumn("x", (F.col("frame") * 37 % 900).cast("double")).withColumn("y", (F.col("frame") * 53 % 700).cast("double"))


_NUMBERED = "n AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY frame) - 1 AS i, (frame * 37 % 900)::DOUBLE AS x, (frame * 53 % 700)::DOUBLE AS y FROM k)"


@query("keyframe_table", "frame_track", "{keyframes}, " + _NUMBERED, """SELECT video, i AS keyframe, frame AS video_frame, CASE WHEN frame % 5 <> 0 THEN round(x - 3.25, 2) END AS x_px, CASE WHEN frame % 5 <> 0 THEN round(y - video, 2) END AS y_px, segment, reason, frame % 5 <> 0 AS placed FROM n""")
def keyframe_table(spark, sf_dir):
    rows = _numbered(spark, sf_dir).withColumn("placed", F.col("frame") % 5 != 0).withColumnRenamed("i", "keyframe")
    origins = views.frame_track(spark, sf_dir).select("video", F.lit(3.25).alias("ox"), F.col("video").cast("double").alias("oy")).distinct()
    return tables.keyframe_rows(rows, origins)


@query("chosen_frames", "frame_track", "", "SELECT video, frame, gray FROM frame_track WHERE frame % 7 = 0")
def chosen_frames(spark, sf_dir):
    track = views.frame_track(spark, sf_dir).select("video", "frame", "gray")
    some = track.where("frame % 7 = 0").select("video", "frame")
    return tables.chosen_frames(track, some.unionByName(some).unionByName(some.select("video", (F.col("frame") + 1_000_000_007 * 7).alias("frame"))))


@query("merged_summaries", "electrodes", "s AS (SELECT mosaic, count(*) AS cells, 'partial' AS coverage FROM electrodes GROUP BY mosaic)", "SELECT mosaic, cells, CASE WHEN mosaic % 2 = 0 THEN 'full' ELSE coverage END AS coverage FROM s UNION ALL SELECT max(mosaic) + 2, 0, 'full' FROM s")
def merged_summaries(spark, sf_dir):
    old = views.electrodes(spark, sf_dir).groupBy("mosaic").agg(F.count("*").alias("cells")).withColumn("coverage", F.lit("partial"))
    new = old.where("mosaic % 2 = 0").withColumn("coverage", F.lit("full"))
    return tables.merged_summaries(old, new.unionByName(old.agg((F.max("mosaic") + 2).alias("mosaic"), F.lit(0).cast("long").alias("cells"), F.lit("full").alias("coverage"))))


# columns


@query("scalar_functions", "", "", """SELECT o_orderkey AS k, (o_orderkey * 13 % 720 - 360 + 45.0) - 90 * floor((o_orderkey * 13 % 720 - 360 + 45.0) / 90) - 45 AS folded, greatest(96, least(768, round_even(1.25 * (o_orderkey % 900) + 64.0, 0)))::INT AS reach,
  CASE WHEN o_orderkey % 4 = 0 THEN 'unknown' WHEN o_orderkey % 4 = 1 THEN 'refused' ELSE 'supplied' END AS scale, strftime(make_timestamp(o_orderkey * 1000000000), '%Y-%m-%dT%H:%M:%SZ') AS stamp,
  round_even(exp(ln(0.25) + (o_orderkey % 13) * (ln(4.0) - ln(0.25)) / 12), 4) AS step, round_even(least(255, (o_orderkey % 256) * 0.5), 0)::INT AS red, greatest(o_orderkey % 5, o_orderkey % 7, o_orderkey % 11) AS signal,
  'survey' || o_orderkey || '-' || sha1(lower('/Data/Survey' || o_orderkey)).substr(1, 8) AS key, substr(sha1('{"k":' || o_orderkey || '}'), 1, 10) AS config, floor(greatest(0, least(255, (o_orderkey % 300 - 20) / 200.0::DOUBLE * 255)))::INT AS toned FROM orders""")
def scalar_functions(spark, sf_dir):
    k, text = F.col("k"), F.col("k").cast("string")
    return _orders(spark, sf_dir).select(
        "k", scalars.fold_angle(k * 13 % 720 - 360).alias("folded"), scalars.snap_radius(k % 900).alias("reach"), scalars.physical_scale(F.when(k % 4 == 1, -1.0).when(k % 4 > 1, 0.5)).alias("scale"), scalars.utc_second(k * 1000).alias("stamp"),
        F.element_at(scalars.scale_ladder(), (k % 13 + 1).cast("int")).alias("step"), F.element_at(scalars.palette(F.array(F.lit(1.0), F.lit(0.25), F.lit(0.5))), (k % 256 + 1).cast("int"))[0].alias("red"),
        scalars.signal_plane(k % 5, k % 7, k % 11).alias("signal"), scalars.dataset_key(F.concat(F.lit("/Data/survey"), text)).alias("key"), scalars.config_key(F.concat(F.lit('{"k":'), text, F.lit("}"))).alias("config"),
        scalars.tone_mapped(F.array((k % 300).cast("double")), F.lit(20.0), F.lit(220.0))[0].alias("toned"),
    )


@query("trial_tags", "tiles", "l AS (SELECT dataset, list(trial ORDER BY trial) AS t FROM tiles GROUP BY dataset)", "SELECT dataset, 'trials_' || CASE WHEN t[1] < 1000 THEN printf('%03d', t[1]) ELSE t[1]::VARCHAR END || '-' || CASE WHEN t[-1] < 1000 THEN printf('%03d', t[-1]) ELSE t[-1]::VARCHAR END || '_n' || len(t) || '_' || substr(sha1(array_to_string(t, ',')), 1, 8) AS tag FROM l")
def trial_tags(spark, sf_dir):
    return views.tiles(spark, sf_dir).groupBy("dataset").agg(F.array_sort(F.collect_list("trial")).alias("t")).select("dataset", scalars.trial_tag(F.col("t")).alias("tag"))


# reviewing


@query("edited_tiles", "tiles", """e AS (SELECT dataset, trial, trial % 100 + 1 AS seq, CASE trial % 5 WHEN 0 THEN 'excluded' WHEN 1 THEN 'anchor' ELSE 'unverified' END AS to_state, CASE WHEN trial % 5 = 1 THEN x + 3 END AS ex, CASE WHEN trial % 5 = 1 THEN y + 4 END AS ey FROM tiles WHERE trial % 3 = 0),
  n AS (SELECT t.dataset, t.trial, coalesce(to_state, state) AS state, CASE WHEN to_state IS NULL OR to_state <> 'excluded' THEN coalesce(ex, x) END AS x, CASE WHEN to_state IS NULL OR to_state <> 'excluded' THEN coalesce(ey, y) END AS y, mx, my, CASE WHEN to_state <> 'excluded' THEN e.seq END AS seq FROM tiles t LEFT JOIN e ON t.dataset = e.dataset AND t.trial = e.trial)""", "SELECT dataset, trial, state, x, y, round(sqrt((x - mx) ** 2 + (y - my) ** 2), 4) AS moved_px, seq FROM n")
def edited_tiles(spark, sf_dir):
    t = views.tiles(spark, sf_dir)
    k = F.col("trial")
    last = t.where("trial % 3 = 0").select("dataset", "trial", (k % 100 + 1).alias("seq"), F.when(k % 5 == 0, "excluded").when(k % 5 == 1, "anchor").otherwise("unverified").alias("state"), F.when(k % 5 == 1, F.col("x") + 3).alias("x"), F.when(k % 5 == 1, F.col("y") + 4).alias("y"))
    earlier = last.select("dataset", "trial", F.lit(0).cast("long").alias("seq"), F.lit("human").alias("state"), F.lit(1.0).alias("x"), F.lit(1.0).alias("y"))
    return review.apply_edits(t.drop("seq"), last.unionByName(earlier))


@query("edited_regions", "regions", "", """SELECT region, CASE WHEN region % 5 = 1 THEN 'new ' || region ELSE 'site ' || region END AS name, CASE WHEN region % 5 = 0 THEN 'confirmed' ELSE 'placed' END AS status FROM regions WHERE region % 5 <> 3""")
def edited_regions(spark, sf_dir):
    r = F.col("region")
    rows = views.regions(spark, sf_dir).select("region", F.concat(F.lit("site "), r.cast("string")).alias("name"), F.lit("placed").alias("status"))
    action = F.when(r % 5 == 0, "confirm").when(r % 5 == 3, "delete").otherwise("rename")
    name = F.when(r % 5 == 1, F.concat(F.lit(" new "), r.cast("string"))).when(r % 5 == 2, "   ")
    return review.edit_regions(rows, rows.where("region % 5 < 4").select("region", action.alias("action"), name.alias("name")))


@query("tracked_steps", "frame_track", """g AS (SELECT video, frame, CASE WHEN response >= 0.3 THEN 1 WHEN frame % 100 / 100.0 >= 0.3 THEN 2 END AS gap, CASE WHEN response >= 0.3 THEN step / 10.0 WHEN frame % 100 / 100.0 >= 0.3 THEN step / 5.0 END AS step FROM frame_track)""", """
SELECT video, frame, CASE WHEN step <= 30 * gap THEN gap END AS gap, CASE WHEN step <= 30 * gap THEN step END::DOUBLE AS step, NOT coalesce(step <= 30 * gap, false) AS is_break FROM g""")
def tracked_steps(spark, sf_dir):
    t = views.frame_track(spark, sf_dir)
    return review.tracked_steps(t.select("video", "frame", F.col("response").alias("response1"), (F.col("step") / 10.0).cast("double").alias("step1"), (F.col("frame") % 100 / 100.0).alias("response2"), (F.col("step") / 5.0).cast("double").alias("step2")), 480)


@query("belonging_documents", "", "", """SELECT o_orderkey AS document, (o_orderkey % 3 = 0 OR o_orderkey % 4 <> 1) AND (o_orderkey % 7 = 0 OR o_orderkey % 5 <> 2) AS belongs FROM orders""")
def belonging_documents(spark, sf_dir):
    k = F.col("k")
    docs = _orders(spark, sf_dir).select(k.alias("document"), F.when(k % 3 != 0, "key").alias("dataset_key"), F.lit("name").alias("name"), F.when(k % 7 == 0, "").otherwise("11-348").alias("identity"))
    scopes = _orders(spark, sf_dir).select(k.alias("document"), F.when(k % 4 == 1, "other").otherwise("key").alias("dataset_key"), F.lit(None).cast("string").alias("name"), F.when(k % 5 == 2, "11-166").otherwise("11-348").alias("identity"))
    return review.belongs(docs, scopes)


@query("match_refusals", "tiles", """b AS (SELECT dataset, trial FROM tiles WHERE trial % 6 = 0 OR dataset % 4 = 0 AND state = 'anchor'), r AS (SELECT t.dataset, count(b.trial) AS n_dropped, count(*) - count(b.trial) AS n_left FROM tiles t LEFT JOIN b ON t.dataset = b.dataset AND t.trial = b.trial WHERE state = 'anchor' GROUP BY t.dataset)""", """
SELECT t.dataset, t.trial, CASE WHEN b.trial IS NOT NULL THEN 'blank' WHEN coalesce(n_left, 0) = 0 THEN 'no_anchors' END AS reason, coalesce(n_dropped, 0) AS n_dropped FROM tiles t LEFT JOIN b ON t.dataset = b.dataset AND t.trial = b.trial LEFT JOIN r ON t.dataset = r.dataset WHERE state = 'unverified'""")
def match_refusals(spark, sf_dir):
    t = views.tiles(spark, sf_dir)
    return review.match_refusals(t.where("state = 'unverified'"), t.where("state = 'anchor'"), t.where("trial % 6 = 0 OR dataset % 4 = 0 AND state = 'anchor'"))


def _measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.links(spark, sf_dir).where("a < b").groupBy(F.col("dataset").alias("video"), "a", "b").agg(F.max("ncc").alias("ncc"))
    return rows.withColumn("ok", F.col("ncc") >= 0.3)


_MEASURED = "m AS (SELECT dataset AS video, a, b, max(ncc) AS ncc, max(ncc) >= 0.3 AS ok FROM links WHERE a < b GROUP BY dataset, a, b)"


@query("unmeasured_pairs", "links", _MEASURED, "SELECT video, a, b FROM m WHERE NOT ok OR (a + b) % 3 = 0")
def unmeasured_pairs(spark, sf_dir):
    m = _measured(spark, sf_dir)
    return review.unmeasured(m.select("video", "a", "b"), m.where("(a + b) % 3 <> 0"))


@query("kept_links", "links", _MEASURED, "SELECT video, a, b, CASE WHEN a % 4 = 0 THEN b % 2 = 0 WHEN NOT ok AND b % 2 = 0 THEN true ELSE ok END AS ok, CASE WHEN a % 4 = 0 OR NOT ok AND b % 2 = 0 THEN 0.5 ELSE ncc END AS ncc FROM m")
def kept_links(spark, sf_dir):
    m = _measured(spark, sf_dir)
    return review.kept_links(m.where("a % 4 <> 0"), m.select("video", "a", "b", (F.col("b") % 2 == 0).alias("ok"), F.lit(0.5).alias("ncc")))


def _recorded(tiles: DataFrame) -> DataFrame:
    """Trials that builds of three in four datasets were given: in every other one some have changed since."""
    even = tiles.where("dataset % 4 < 3 AND dataset % 2 = 0 AND state <> 'excluded'")
    return even.unionByName(tiles.where("dataset % 4 = 1 AND trial % 5 <> 0")).select("dataset", "trial")


_STALE = """w AS (SELECT dataset, trial FROM tiles WHERE dataset % 4 < 3 AND dataset % 2 = 0 AND state <> 'excluded' OR dataset % 4 = 1 AND trial % 5 <> 0), a AS (SELECT dataset, trial FROM tiles WHERE state <> 'excluded'),
  c AS (SELECT DISTINCT dataset, dataset IN (SELECT dataset FROM w) AS known, (SELECT count(*) FROM w WHERE w.dataset = t.dataset AND w.trial NOT IN (SELECT trial FROM a)) AS n_dropped, (SELECT count(*) FROM a WHERE a.dataset = t.dataset AND a.trial NOT IN (SELECT trial FROM w)) AS n_added FROM tiles t),
  z AS (SELECT dataset, CASE WHEN known THEN n_dropped END AS n_dropped, CASE WHEN known THEN n_added END AS n_added, CASE WHEN NOT known THEN 'unrecorded' WHEN n_dropped + n_added > 0 THEN 'trials_changed' END AS reason FROM c)"""


@query("build_staleness", "tiles", _STALE, "SELECT * FROM z")
def build_staleness(spark, sf_dir):
    t = views.tiles(spark, sf_dir)
    return review.build_staleness(t, _recorded(t), t.select("dataset").distinct())


@query("quality_report", "tiles", _STALE + """, q AS (SELECT *, round(sqrt((x - mx) ** 2 + (y - my) ** 2), 4) AS d, state <> 'excluded' AND x IS NOT NULL AS placed FROM (SELECT * REPLACE (CASE WHEN trial % 6 <> 0 THEN x END AS x, CASE WHEN trial % 7 <> 0 AND dataset % 5 <> 0 THEN mx END AS mx) FROM tiles)),
  g AS (SELECT dataset, count(*) AS n_gaps FROM (SELECT dataset, lead(trial) OVER (PARTITION BY dataset ORDER BY trial) - trial AS step FROM q WHERE state <> 'excluded') WHERE step > 1 GROUP BY dataset)""", """
SELECT q.dataset, count(*) AS n_tiles, count(*) FILTER (state <> 'excluded') AS n_active, count(*) FILTER (state = 'excluded') AS n_excluded, count(*) FILTER (state = 'anchor') AS n_anchor, count(*) FILTER (state = 'human') AS n_human, count(*) FILTER (state = 'unverified') AS n_unverified,
  count(*) FILTER (placed AND d >= 0.5) AS n_moved, max(d) FILTER (placed AND d >= 0.5) AS most_moved, arg_max(trial, (d, -trial)) FILTER (placed AND d >= 0.5) AS worst_trial, count(*) FILTER (placed AND margin < 0.1) AS n_thin,
  CASE WHEN count(mx) > 0 THEN count(*) FILTER (placed AND mx IS NULL) ELSE 0 END AS n_rescued, coalesce(any_value(n_gaps), 0) AS n_gaps, any_value(reason) IS NOT NULL AS build_stale, round(count(*) FILTER (placed AND d >= 0.5) / nullif(count(*) FILTER (state <> 'excluded'), 0)::DOUBLE, 6) AS moved_share
FROM q LEFT JOIN g ON q.dataset = g.dataset LEFT JOIN z ON q.dataset = z.dataset GROUP BY q.dataset""")
def quality_report(spark, sf_dir):
    t = views.tiles(spark, sf_dir)
    odd = t.withColumn("x", F.when(F.col("trial") % 6 != 0, F.col("x"))).withColumn("mx", F.when((F.col("trial") % 7 != 0) & (F.col("dataset") % 5 != 0), F.col("mx")))
    return review.quality_report(odd, review.build_staleness(t, _recorded(t), t.select("dataset").distinct()))


@query("rechecked_tiles", "tiles", "", """SELECT dataset, trial, CASE WHEN trial % 3 <> 0 THEN round(sqrt((mx - x) ** 2 + (my - y) ** 2), 2) END AS disagree_px, coalesce(CASE WHEN trial % 3 <> 0 THEN sqrt((mx - x) ** 2 + (my - y) ** 2) END > 5, true) AS stale FROM tiles WHERE stale AND state <> 'anchor'""")
def rechecked_tiles(spark, sf_dir):
    t = views.tiles(spark, sf_dir)
    return review.rechecked(t, t.where("trial % 3 <> 0").select("dataset", "trial", F.col("mx").alias("bx"), F.col("my").alias("by")))


@query("recompute_targets", "tiles", "", "SELECT dataset, trial FROM tiles WHERE state = 'unverified' AND trial % 5 <> 0")
def recompute_targets(spark, sf_dir):
    t = views.tiles(spark, sf_dir)
    return review.recompute_targets(t, t.where("trial % 5 <> 0"))


@query("build_evidence", "tiles", """s AS (SELECT dataset, min(trial) + 9 AS split FROM tiles GROUP BY dataset), c AS (SELECT t.dataset, min(x) AS cx, min(y) AS cy FROM tiles t JOIN s ON t.dataset = s.dataset WHERE trial <= split GROUP BY t.dataset)""", """
SELECT t.dataset, trial, CASE WHEN trial % 4 <> 0 THEN ncc END AS anchor_ncc, CASE WHEN trial % 4 <> 0 THEN round(sqrt((mx + cx - x) ** 2 + (my + cy - y) ** 2), 6) END AS anchor_residual_px, CASE WHEN trial > split THEN trial // 5 END AS run,
  CASE WHEN trial > split THEN trial // 5 % 10 / 10.0 END::DOUBLE AS run_margin, CASE WHEN trial <= split THEN 1 ELSE 2 END AS pass FROM tiles t JOIN s ON t.dataset = s.dataset JOIN c ON t.dataset = c.dataset""")
def build_evidence(spark, sf_dir):
    t = views.tiles(spark, sf_dir)
    splits = t.groupBy("dataset").agg((F.min("trial") + 9).alias("split"))
    anchors = t.where("trial % 4 <> 0").select("dataset", "trial", "ncc", F.col("mx").alias("ax"), F.col("my").alias("ay"))
    return review.build_evidence(t.select("dataset", "trial", "x", "y"), anchors, _runs(t.join(splits, "dataset").where("trial > split")), splits)


def _runs(tiles: DataFrame) -> DataFrame:
    run = F.floor(F.col("trial") / 5)
    return tiles.groupBy("dataset", run.alias("run")).agg(F.sort_array(F.collect_list("trial")).alias("trials"), F.count("*").alias("n")).withColumn("margin", (F.col("run") % 10 / 10.0).cast("double"))


@query("run_statistics", "tiles", "r AS (SELECT dataset, trial // 5 AS run, count(*) AS n, trial // 5 % 10 / 10.0::DOUBLE AS margin FROM tiles GROUP BY dataset, trial // 5)", "SELECT dataset, count(*) AS n_runs, min(margin) AS min_margin, arg_max(run, (n, -run)) AS biggest_run, max(n) AS biggest_n FROM r GROUP BY dataset")
def run_statistics(spark, sf_dir):
    return review.run_statistics(_runs(views.tiles(spark, sf_dir)))


@query("region_ids", "", "p AS (SELECT '/Data/' || o_custkey % 90 || CASE WHEN o_custkey % 2 = 0 THEN '/REC' ELSE '/rec' END || o_orderkey % 60 AS path FROM orders), u AS (SELECT DISTINCT CASE WHEN path LIKE '%7' THEN upper(path) ELSE path END AS path FROM p UNION SELECT lower(path) FROM p WHERE path LIKE '%7')", """
SELECT path, substr(sha1(lower(path)), 1, 10) || CASE WHEN row_number() OVER same = 1 THEN '' ELSE '-' || row_number() OVER same END AS region_id, split_part(path, '/', -1) || '-' || substr(sha1(lower(path)), 1, 8) AS key FROM u WINDOW same AS (PARTITION BY substr(sha1(lower(path)), 1, 10) ORDER BY path)""")
def region_ids(spark, sf_dir):
    rows = _orders(spark, sf_dir)
    path = F.concat(F.lit("/Data/"), (F.col("o_custkey") % 90).cast("string"), F.when(F.col("o_custkey") % 2 == 0, "/REC").otherwise("/rec"), (F.col("k") % 60).cast("string"))
    p = rows.select(path.alias("path"))
    u = p.select(F.when(F.col("path").endswith("7"), F.upper("path")).otherwise(F.col("path")).alias("path")).unionByName(p.where(F.col("path").endswith("7")).select(F.lower("path").alias("path"))).distinct()
    return review.region_ids(u)


@query("guarded_steps", "links", "m AS (SELECT dataset, a, b, max(ncc) AS ncc, max(response) AS r, max(dx) AS dx, max(dy) AS dy FROM links GROUP BY dataset, a, b)", "SELECT dataset, a, b, CASE WHEN r - ncc >= 0.05 THEN dx + 1 ELSE dx END AS dx, CASE WHEN r - ncc >= 0.05 THEN dy + 1 ELSE dy END AS dy, CASE WHEN r - ncc >= 0.05 THEN r ELSE ncc END AS ncc, r - ncc >= 0.05 AS moved FROM m")
def guarded_steps(spark, sf_dir):
    m = views.links(spark, sf_dir).groupBy("dataset", "a", "b").agg(*[F.max(c).alias(c) for c in ("ncc", "response", "dx", "dy")])
    return review.guarded_steps(m, m.select("dataset", "a", "b", (F.col("dx") + 1).alias("dx"), (F.col("dy") + 1).alias("dy"), F.col("response").alias("ncc")))


@query("rule_breaks", "tiles", "", "SELECT dataset, trial FROM tiles WHERE state = 'excluded' AND trial % 3 <> 0")
def rule_breaks(spark, sf_dir):
    t = views.tiles(spark, sf_dir)
    return review.rule_breaks(t.where("trial % 3 <> 0"), t)


@query("ranked_candidates", "links", "", "SELECT dataset, a AS target, dx AS x, dy AS y, ncc, rank FROM (SELECT *, row_number() OVER (PARTITION BY dataset, a ORDER BY ncc DESC, dx, dy) - 1 AS rank FROM (SELECT DISTINCT dataset, a, dx, dy, ncc FROM links)) WHERE rank < 9")
def ranked_candidates(spark, sf_dir):
    rows = views.links(spark, sf_dir).select("dataset", F.col("a").alias("target"), F.col("dx").alias("x"), F.col("dy").alias("y"), "ncc").distinct()
    return review.ranked_candidates(rows).withColumn("rank", F.col("rank").cast("long"))


@query("worst_tiles", "tiles", "e AS (SELECT dataset, trial, round(sqrt((x - mx) ** 2 + (y - my) ** 2), 4) AS err FROM tiles)", "SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY err DESC, trial) AS rank FROM e QUALIFY rank <= 10")
def worst_tiles(spark, sf_dir):
    return review.worst_tiles(views.tiles(spark, sf_dir).select("dataset", "trial", F.round(F.hypot(F.col("x") - F.col("mx"), F.col("y") - F.col("my")), 4).alias("err")))


@query("wanted_kinds", "", "r AS (SELECT o_orderkey AS request, ['png', CASE WHEN o_orderkey % 2 = 0 THEN 'png' ELSE 'csv' END, CASE WHEN o_orderkey % 3 = 0 THEN 'truth' ELSE 'csv' END] AS k FROM orders), u AS (SELECT request, k[i] AS kind, i FROM r, unnest([1, 2, 3]) AS t(i) WHERE list_position(k, k[i]) = i)", "SELECT request, (row_number() OVER (PARTITION BY request ORDER BY i) - 1)::INT AS place, kind FROM u")
def wanted_kinds(spark, sf_dir):
    k = F.col("k")
    return review.wanted_kinds(_orders(spark, sf_dir).select(k.alias("request"), F.array(F.lit("png"), F.when(k % 2 == 0, "png").otherwise("csv"), F.when(k % 3 == 0, "truth").otherwise("csv")).alias("kinds")))


# documents, further rules


@query("machine_placed", "tiles", "", """SELECT dataset, trial, CASE WHEN n THEN 'unverified' ELSE state END AS state, CASE WHEN n THEN mx + 1 ELSE x END AS x, CASE WHEN n THEN my + 1 ELSE y END AS y, CASE WHEN n THEN mx + 1 ELSE mx END AS mx, CASE WHEN n THEN my + 1 ELSE my END AS my FROM (SELECT *, state = 'unverified' AND trial % 3 <> 0 AS n FROM tiles)""")
def machine_placed(spark, sf_dir):
    t = views.tiles(spark, sf_dir)
    return documents.placed_by_machine(t, t.where("trial % 3 <> 0").select("dataset", "trial", (F.col("mx") + 1).alias("px"), (F.col("my") + 1).alias("py")))


@query("kept_blanks", "tiles", "", "SELECT dataset, trial FROM tiles WHERE trial % 6 = 0 AND trial % 4 <> 0")
def kept_blanks(spark, sf_dir):
    t = views.tiles(spark, sf_dir)
    return documents.kept_blanks(t.where("trial % 6 = 0"), t.where("trial % 4 <> 0"))


@query("active_trials", "tiles", "", "SELECT dataset, trial FROM tiles WHERE state <> 'excluded'")
def active_trials(spark, sf_dir):
    return documents.active(views.tiles(spark, sf_dir))


@query("unknown_trials", "tiles", "", "SELECT dataset, trial + 1000000 AS trial FROM tiles WHERE trial % 50 = 0")
def unknown_trials(spark, sf_dir):
    t = views.tiles(spark, sf_dir).select("dataset", "trial")
    return documents.unknown_trials(t.unionByName(t.where("trial % 50 = 0").select("dataset", (F.col("trial") + 1_000_000).alias("trial"))), t)


@query("seeded_tiles", "tiles", """b AS (SELECT *, CASE WHEN trial % 5 <> 0 AND (dataset % 6 <> 0 OR state NOT IN ('anchor', 'human')) THEN mx + 100 END AS bx, CASE WHEN trial % 5 <> 0 AND (dataset % 6 <> 0 OR state NOT IN ('anchor', 'human')) THEN my - 50 END AS by_, state IN ('anchor', 'human') AS own FROM tiles),
  s AS (SELECT dataset, median(x - bx) FILTER (own) AS sx, median(y - by_) FILTER (own) AS sy, count(*) FILTER (own) AS n FROM b GROUP BY dataset), f AS (SELECT b.*, n > 0 AND sx IS NULL AS refused, CASE WHEN NOT (n > 0 AND sx IS NULL) THEN bx + coalesce(sx, 0) END AS nx, CASE WHEN NOT (n > 0 AND sx IS NULL) THEN by_ + coalesce(sy, 0) END AS ny FROM b JOIN s ON b.dataset = s.dataset)""", """
SELECT dataset, trial, CASE WHEN nx IS NOT NULL AND NOT own AND state <> 'excluded' THEN 'unverified' ELSE state END AS state, CASE WHEN nx IS NOT NULL AND NOT own AND state <> 'excluded' THEN nx ELSE x END AS x, CASE WHEN nx IS NOT NULL AND NOT own AND state <> 'excluded' THEN ny ELSE y END AS y, coalesce(nx, mx) AS mx, coalesce(ny, my) AS my, refused FROM f""")
def seeded_tiles(spark, sf_dir):
    t = views.tiles(spark, sf_dir)
    build = t.where("trial % 5 <> 0 AND (dataset % 6 <> 0 OR state NOT IN ('anchor', 'human'))").select("dataset", "trial", (F.col("mx") + 100).alias("bx"), (F.col("my") - 50).alias("by"))
    return documents.seeded(t, build)


@query("stale_after_edit", "tiles", "e AS (SELECT dataset, arg_min(trial, (trial * 7 % 101, trial)) AS t, min(trial * 7 % 101) AS s FROM tiles WHERE trial % 9 = 0 GROUP BY dataset)", "SELECT tiles.dataset, trial FROM tiles JOIN e ON tiles.dataset = e.dataset WHERE state <> 'excluded' AND seq > s AND trial <> t")
def stale_after_edit(spark, sf_dir):
    t = views.tiles(spark, sf_dir)
    return documents.stale_after(t, t.where("trial % 9 = 0").select("dataset", "trial", "seq"))


@query("document_problems", "tiles", """t AS (SELECT dataset, trial, CASE WHEN trial % 11 = 0 THEN NULL WHEN trial % 23 = 0 THEN 'odd' ELSE state END AS state, CASE WHEN trial % 13 = 0 THEN 'anchor' ELSE state END AS status, CASE WHEN trial % 7 <> 0 THEN x END AS x, CASE WHEN trial % 7 <> 0 THEN y END AS y FROM tiles),
  d AS (SELECT dataset, min(trial) AS lo, CASE WHEN dataset % 8 = 3 THEN min(trial) - 1 ELSE max(trial) - 1 END AS hi, min(trial) AS origin, CASE WHEN dataset % 2 = 0 THEN max(trial) + 5 END AS cursor FROM tiles GROUP BY dataset),
  j AS (SELECT t.*, lo, hi, lo > hi AS bad FROM t JOIN d ON t.dataset = d.dataset), p AS (SELECT dataset, coalesce(min(trial) FILTER (state = 'anchor'), min(trial)) AS want FROM t WHERE state IN ('anchor', 'human', 'unverified') AND x IS NOT NULL GROUP BY dataset),
  o AS (SELECT d.*, want, (SELECT count(*) FROM t WHERE t.dataset = d.dataset AND t.trial = want AND x = 0 AND y = 0) AS zero FROM d LEFT JOIN p ON d.dataset = p.dataset)""", """
SELECT dataset, trial, 'derived' AS kind, 'no_state' AS problem FROM j WHERE state IS NULL UNION ALL SELECT dataset, trial, 'hard', 'unknown_state' FROM j WHERE state = 'odd' UNION ALL SELECT dataset, trial, 'hard', 'status_disagrees' FROM j WHERE state <> 'odd' AND status <> state
UNION ALL SELECT dataset, trial, 'hard', 'placed_without_position' FROM j WHERE coalesce(state, status) IN ('anchor', 'human', 'unverified') AND x IS NULL UNION ALL SELECT dataset, trial, 'hard', 'position_kept' FROM j WHERE coalesce(state, status) = 'excluded' AND x IS NOT NULL
UNION ALL SELECT dataset, trial, 'hard', 'outside_range' FROM j WHERE NOT bad AND NOT trial BETWEEN lo AND hi UNION ALL SELECT dataset, NULL, 'hard', 'bad_range' FROM o WHERE lo > hi UNION ALL SELECT dataset, NULL, 'derived', 'wrong_origin' FROM o WHERE want IS NOT NULL AND origin <> want
UNION ALL SELECT dataset, NULL, 'derived', 'origin_not_at_zero' FROM o WHERE want IS NOT NULL AND zero = 0 UNION ALL SELECT dataset, NULL, 'warn', 'cursor_unknown' FROM o WHERE cursor IS NOT NULL UNION ALL SELECT dataset, trial + 1000000, 'warn', 'blank_unknown' FROM tiles WHERE trial % 40 = 0""")
def document_problems(spark, sf_dir):
    t, k = views.tiles(spark, sf_dir), F.col("trial")
    odd = t.select("dataset", "trial", F.when(k % 13 == 0, "anchor").otherwise(F.col("state")).alias("status"), F.when(k % 11 == 0, None).when(k % 23 == 0, "odd").otherwise(F.col("state")).alias("state"), F.when(k % 7 != 0, F.col("x")).alias("x"), F.when(k % 7 != 0, F.col("y")).alias("y"))
    docs = t.groupBy("dataset").agg(F.min("trial").alias("lo"), F.max("trial").alias("top")).select("dataset", "lo", F.when(F.col("dataset") % 8 == 3, F.col("lo") - 1).otherwise(F.col("top") - 1).alias("hi"), F.col("lo").alias("origin"), F.when(F.col("dataset") % 2 == 0, F.col("top") + 5).alias("cursor"))
    blank = t.where("trial % 40 = 0").select("dataset", (k + 1_000_000).alias("trial")).unionByName(t.where("trial % 9 = 0").select("dataset", "trial"))
    return documents.problems(odd, docs, blank)


@query("grid_neighbours", "electrodes", "e AS (SELECT * FROM electrodes WHERE kind = 1)", "SELECT a.mosaic, a.col, a.row, 'col' AS axis, b.x - a.x AS dx, b.y - a.y AS dy FROM e a JOIN e b ON a.mosaic = b.mosaic AND b.col = a.col + 1 AND b.row = a.row UNION ALL SELECT a.mosaic, a.col, a.row, 'row', b.x - a.x, b.y - a.y FROM e a JOIN e b ON a.mosaic = b.mosaic AND b.row = a.row + 1 AND b.col = a.col")
def grid_neighbours(spark, sf_dir):
    return layout.neighbour_steps(views.electrodes(spark, sf_dir))


# scores


def _scored(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A build that is shifted by dataset and wrong by some pixels on every seventeenth tile, without every eleventh, and its truth."""
    t, k = views.tiles(spark, sf_dir), F.col("trial")
    wrong = F.when(k % 17 == 0, 40.0).otherwise(0.0)
    build = t.where("trial % 11 <> 0").select("dataset", "trial", (F.col("x") + 7 * F.col("dataset") % 50 + k % 3 + wrong).alias("x"), (F.col("y") - 20 + k % 2).alias("y"))
    return build, t.where("state <> 'excluded'").select("dataset", "trial", "x", "y", F.when(k % 4 == 0, 4.0).otherwise(12.0).alias("r"))


_POINTS = """b AS (SELECT dataset, trial, x + 7 * dataset % 50 + trial % 3 + CASE WHEN trial % 17 = 0 THEN 40.0 ELSE 0.0 END AS x, y - 20 + trial % 2 AS y FROM tiles WHERE trial % 11 <> 0), g AS (SELECT dataset, trial, x AS tx, y AS ty, CASE WHEN trial % 4 = 0 THEN 4.0 ELSE 12.0 END AS r FROM tiles WHERE state <> 'excluded'),
  p AS (SELECT dataset, trial, x, y, tx, ty, tx - x AS ox, ty - y AS oy, {r}::DOUBLE AS r FROM b JOIN g USING (dataset, trial)),
  c AS (SELECT i.dataset, i.trial, i.ox AS cx, i.oy AS cy, count(*) AS n, median(sqrt((j.ox - i.ox) ** 2 + (j.oy - i.oy) ** 2)) AS m FROM p i JOIN p j ON i.dataset = j.dataset AND sqrt((j.ox - i.ox) ** 2 + (j.oy - i.oy) ** 2) <= j.r GROUP BY ALL),
  s0 AS (SELECT dataset, cx AS sx, cy AS sy, false AS done FROM c QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY n DESC, m, trial) = 1)"""


def _refits(rounds: int) -> str:
    """The refits of the consensus, written out one after another; later ones change nothing once a dataset is done."""
    out = []
    for k in range(rounds):
        out.append(f"""f{k} AS (SELECT dataset, avg(ox) AS fx, avg(oy) AS fy, count(*) AS n, list(trial ORDER BY trial) AS l FROM p JOIN s{k} USING (dataset) WHERE sqrt((ox - sx) ** 2 + (oy - sy) ** 2) <= r GROUP BY dataset),
  n{k} AS (SELECT dataset, count(*) AS fn, list(trial ORDER BY trial) AS fl FROM p JOIN f{k} USING (dataset) WHERE sqrt((ox - fx) ** 2 + (oy - fy) ** 2) <= r GROUP BY dataset),
  s{k + 1} AS (SELECT dataset, CASE WHEN NOT done AND coalesce(fn, 0) >= n THEN fx ELSE sx END AS sx, CASE WHEN NOT done AND coalesce(fn, 0) >= n THEN fy ELSE sy END AS sy, done OR coalesce(fn, 0) < n OR l = fl AS done FROM s{k} JOIN f{k} USING (dataset) LEFT JOIN n{k} USING (dataset))""")
    return ",\n  ".join(out)


_SHIFT = _POINTS + ",\n  " + _refits(8)


@query("consensus_shift", "tiles", _SHIFT.replace("{r}", "r"), "SELECT dataset, round(any_value(sx), 6) AS sx, round(any_value(sy), 6) AS sy, count(*) AS n_inliers FROM p JOIN s8 USING (dataset) WHERE sqrt((ox - sx) ** 2 + (oy - sy) ** 2) <= r GROUP BY dataset")
def consensus_shift(spark, sf_dir):
    found = scoring.consensus(scoring.matched(*_scored(spark, sf_dir), tolerance=None))
    return found.select("dataset", F.round("sx", 6).alias("sx"), F.round("sy", 6).alias("sy"), "n_inliers")


@query("score_report", "tiles", _SHIFT.replace("{r}", "10.0") + """,
  e AS (SELECT *, sqrt((x + sx - tx) ** 2 + (y + sy - ty) ** 2) AS err FROM p JOIN s8 USING (dataset)), i AS (SELECT * FROM e WHERE sqrt((ox - sx) ** 2 + (oy - sy) ** 2) <= r),
  w AS (SELECT dataset, avg(x) AS ax, avg(y) AS ay, avg(tx) AS atx, avg(ty) AS aty FROM i GROUP BY dataset),
  q AS (SELECT dataset, count(*) AS n_inliers, CASE WHEN count(*) >= 3 THEN degrees(atan2(sum((x - ax) * (ty - aty) - (y - ay) * (tx - atx)), sum((x - ax) * (tx - atx) + (y - ay) * (ty - aty)))) ELSE 0 END AS rot FROM i JOIN w USING (dataset) GROUP BY dataset),
  h AS (SELECT dataset, count(*) AS n_gt, count(*) FILTER (trial % 11 = 0) AS n_missing FROM g GROUP BY dataset), v AS (SELECT dataset, count(*) AS bad FROM tiles WHERE state = 'excluded' AND trial % 11 <> 0 GROUP BY dataset)""", """
SELECT dataset, count(*) AS n_tiles, count(*) FILTER (err <= r) AS n_correct, round(100 * avg((err <= r)::INT), 6) AS pct_correct, round(median(err), 6) AS median_err, round(avg(err), 6) AS mean_err, round(sqrt(avg(err ** 2)), 6) AS rmse, round(quantile_cont(err, 0.9), 6) AS p90_err, round(max(err), 6) AS max_err,
""" + ", ".join(f"round(100 * avg((err <= {t})::INT), 6) AS pct_within_{t}" for t in (5, 10, 25, 50, 96, 256)) + """, any_value(n_gt) AS n_gt, any_value(n_missing) AS n_missing, round(100 * count(*) FILTER (err <= r) / any_value(n_gt)::DOUBLE, 6) AS pct_of_gt, coalesce(any_value(bad), 0) AS n_excluded_placed,
  round(any_value(sx), 6) AS sx, round(any_value(sy), 6) AS sy, any_value(n_inliers) AS n_inliers, round(any_value(rot), 6) AS rot_deg FROM e JOIN h USING (dataset) LEFT JOIN v USING (dataset) LEFT JOIN q USING (dataset) GROUP BY dataset""")
def score_report(spark, sf_dir):
    return scoring.report(*_scored(spark, sf_dir), views.tiles(spark, sf_dir).where("state = 'excluded'"))


# pairs, areas, grids


@query("pair_blocks", "tiles", "g AS (SELECT dataset, g, count(*) AS n FROM (SELECT dataset, (row_number() OVER (PARTITION BY dataset ORDER BY trial) - 1) // 16 AS g FROM tiles) GROUP BY ALL)", "SELECT a.dataset, a.g AS ga, b.g AS gb, (CASE WHEN a.g = b.g THEN a.n * (a.n - 1) // 2 ELSE a.n * b.n END)::BIGINT AS n_pairs FROM g a JOIN g b ON a.dataset = b.dataset AND a.g <= b.g")
def pair_blocks(spark, sf_dir):
    return spatial.pair_blocks(views.tiles(spark, sf_dir))


@query("cross_candidates", "frame_track", "{keyframes}, " + _NUMBERED, "SELECT a.video, a.i AS a, b.i AS b, round(sqrt((b.x - a.x) ** 2 + (b.y - a.y) ** 2), 6) AS distance FROM n a JOIN n b ON a.video = b.video AND b.i >= a.i + 3 AND a.segment // 40 = b.segment // 40 WHERE abs(b.x - a.x) < 480 AND abs(b.y - a.y) < 320 AND (480 - abs(b.x - a.x)) * (320 - abs(b.y - a.y)) >= 0.12 * 480 * 320")
def cross_candidates(spark, sf_dir):
    rows = _numbered(spark, sf_dir).withColumn("segment", F.floor(F.col("segment") / 40))
    return spatial.cross_candidates(rows, 480, 320).select("video", "a", "b", F.round("distance", 6).alias("distance"))


@query("budgeted_links", "frame_track", "{keyframes}, " + _NUMBERED + """, c AS (SELECT a.video, a.i AS a, b.i AS b, round(sqrt((b.x - a.x) ** 2 + (b.y - a.y) ** 2), 6) AS distance FROM n a JOIN n b ON a.video = b.video AND b.i >= a.i + 3 AND a.segment // 40 = b.segment // 40
    WHERE abs(b.x - a.x) < 480 AND abs(b.y - a.y) < 320 AND (480 - abs(b.x - a.x)) * (320 - abs(b.y - a.y)) >= 0.12 * 480 * 320),
  r AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY distance, a, b) AS rn FROM c),
  w AS (SELECT DISTINCT video, 0::BIGINT AS rn, []::STRUCT(a BIGINT, b BIGINT, d DOUBLE)[] AS kept FROM r UNION ALL SELECT w.video, r.rn, CASE WHEN len(list_filter(kept, lambda k: r.a IN (k.a, k.b))) < 6 AND len(list_filter(kept, lambda k: r.b IN (k.a, k.b))) < 6
    THEN list_append(kept, {'a': r.a, 'b': r.b, 'd': r.distance}) ELSE kept END FROM w JOIN r ON r.video = w.video AND r.rn = w.rn + 1),
  z AS (SELECT video, unnest(kept) AS k FROM (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY video ORDER BY rn DESC) = 1))""", "SELECT video, k.a AS a, k.b AS b, k.d AS distance FROM z")
def budgeted_links(spark, sf_dir):
    return spatial.budgeted(cross_candidates(spark, sf_dir))


@query("axis_bands", "links", "c AS (SELECT dataset, CASE WHEN ncc >= 0.62 THEN least(abs(dx), abs(dy)) END AS c FROM links)", "SELECT dataset, count(c) AS n_confident, count(*) FILTER (c > 4) AS n_off_axis, (ceil(max(c)) + 4)::BIGINT AS band FROM c GROUP BY dataset")
def axis_bands(spark, sf_dir):
    return spatial.axis_bands(views.links(spark, sf_dir))


@query("null_draws", "tiles", """l AS (SELECT dataset, trial, row_number() OVER (PARTITION BY dataset ORDER BY trial) - 1 AS i FROM tiles), n AS (SELECT dataset, count(*) AS size FROM l GROUP BY dataset), d AS (SELECT dataset, size, unnest(range(0, 3000))::INT AS k FROM n),
  h AS (SELECT dataset, k, ('0x' || md5('11:' || dataset || ':' || k || ':a')[1:8])::BIGINT % size AS ia, ('0x' || md5('11:' || dataset || ':' || k || ':b')[1:8])::BIGINT % size AS ib FROM d)""", "SELECT h.dataset, k, a.trial AS a, b.trial AS b FROM h JOIN l a ON h.dataset = a.dataset AND ia = a.i JOIN l b ON h.dataset = b.dataset AND ib = b.i")
def null_draws(spark, sf_dir):
    return spatial.null_draws(views.tiles(spark, sf_dir))


@query("null_floor", "links", "m AS (SELECT dataset, a, max(ncc) AS ncc FROM links GROUP BY dataset, a)", "SELECT dataset, round(quantile_cont(ncc, 0.995), 6) AS floor, count(ncc) AS n FROM m GROUP BY dataset")
def null_floor(spark, sf_dir):
    return spatial.null_floor(views.links(spark, sf_dir).select("dataset", F.col("a").alias("k"), "ncc"))


@query("coverage", "tiles", """t AS (SELECT dataset, x::BIGINT AS x, y::BIGINT AS y FROM tiles WHERE state <> 'excluded'), u AS (SELECT dataset, v, lead(v) OVER (PARTITION BY dataset ORDER BY v) AS w FROM (SELECT DISTINCT dataset, unnest([x, x + 512]) AS v FROM t)),
  h AS (SELECT dataset, v, lead(v) OVER (PARTITION BY dataset ORDER BY v) AS w FROM (SELECT DISTINCT dataset, unnest([y, y + 512]) AS v FROM t)),
  a AS (SELECT u.dataset, sum((u.w - u.v) * (h.w - h.v))::BIGINT AS covered_px FROM u JOIN h ON u.dataset = h.dataset WHERE EXISTS (SELECT 1 FROM t WHERE t.dataset = u.dataset AND t.x <= u.v AND t.x + 512 >= u.w AND t.y <= h.v AND t.y + 512 >= h.w) GROUP BY u.dataset),
  c AS (SELECT dataset, (max(x) - min(x) + 512) * (max(y) - min(y) + 512) AS canvas_px FROM t GROUP BY dataset)""", "SELECT dataset, covered_px, canvas_px, round(covered_px / canvas_px::DOUBLE, 6) AS share FROM a JOIN c USING (dataset)")
def coverage(spark, sf_dir):
    return spatial.coverage(documents.active(views.tiles(spark, sf_dir)).join(views.tiles(spark, sf_dir).select("dataset", "trial", "x", "y"), ["dataset", "trial"]))


@query("micrometres", "electrodes", """o AS (SELECT mosaic, avg(x - (col - 1) * 14.0 - (row - 1) * 1.0) AS ox, avg(y - (col - 1) * 0.5 - (row - 1) * 13.9) AS oy FROM electrodes GROUP BY mosaic)""", """
SELECT mosaic, col, row, round((13.9 * (x - ox) - 1.0 * (y - oy)) / (14.0 * 13.9 - 0.5 * 1.0) * 17.5, 4) AS x_um, round((14.0 * (y - oy) - 0.5 * (x - ox)) / (14.0 * 13.9 - 0.5 * 1.0) * 17.5, 4) AS y_um, round(17.5 / 14.0, 6) AS um_per_px FROM electrodes JOIN o USING (mosaic)""")
def micrometres(spark, sf_dir):
    e = views.electrodes(spark, sf_dir)
    grids = e.select("mosaic").distinct().select("mosaic", *[F.lit(v).alias(c) for c, v in (("pitch", 14.0), ("a1x", 14.0), ("a1y", 0.5), ("a2x", 1.0), ("a2y", 13.9))])
    return spatial.micrometres(e, grids)


# pixels

_LEVELS = "e AS (SELECT frame, grp, unnest(px) AS value FROM frames8), l AS (SELECT frame, grp, round(CASE WHEN count(*) FILTER (value > 0.05) > 0.01 * count(*) THEN quantile_cont(value, 0.6) FILTER (value > 0.05) ELSE 0 END, 6) AS level FROM e GROUP BY frame, grp)"


@query("exposure_gains", "frames8", _LEVELS + ", m AS (SELECT grp, median(level) FILTER (level > 1e-3) AS ref FROM l GROUP BY grp)", "SELECT frame, grp, round(CASE WHEN level > 1e-3 THEN greatest(0.4, least(2.5, ref / level)) ELSE 1 END, 6) AS gain FROM l JOIN m USING (grp)")
def exposure_gains(spark, sf_dir):
    return pixels.gains(pixels.exposure(views.frames8(spark, sf_dir)))


@query("tone_windows", "frames8", """s AS (SELECT grp, frame, px, row_number() OVER (PARTITION BY grp ORDER BY frame) - 1 AS i, greatest(1, count(*) OVER (PARTITION BY grp) // 96) AS stride FROM frames8 QUALIFY i % stride = 0 AND i // stride < 96), v AS (SELECT grp, frame, unnest(px) AS v FROM s),
  m AS (SELECT grp, median(m) AS level, count(*) AS n_sample FROM (SELECT grp, frame, median(v) AS m FROM v GROUP BY grp, frame) GROUP BY grp), w AS (SELECT grp, quantile_cont(v, 0.005) AS lo, quantile_cont(v, 0.996) AS hi FROM v GROUP BY grp)""", "SELECT grp, round(level, 6) AS level, n_sample, round(lo, 6) AS lo, round(hi, 6) AS hi, hi <= lo AS degenerate FROM m JOIN w USING (grp)")
def tone_windows(spark, sf_dir):
    return pixels.tone(views.frames8(spark, sf_dir))


@query("tints", "", """f AS (SELECT label::BIGINT AS video, vec_id AS frame, embedding::DOUBLE[] AS e FROM embeddings), p AS (SELECT video, frame, i, abs(e[i]) * 30 AS b, abs(e[i + 1]) * 300 AS g, abs(e[i + 2]) * 30 AS r FROM f, unnest(range(1, 63)) AS t(i)),
  c AS (SELECT video, frame, greatest(quantile_cont(greatest(b, g, r), 0.2), 12.0) AS cut FROM p GROUP BY video, frame), l AS (SELECT p.*, sqrt(b * b + g * g + r * r) AS norm FROM p JOIN c USING (video, frame) WHERE greatest(b, g, r) >= cut), k AS (SELECT video, frame FROM l GROUP BY video, frame HAVING count(*) >= 20),
  s AS (SELECT video, count(DISTINCT frame) AS n_frames, count(*) AS n_px, sum(b / norm) / count(*) AS cb, sum(g / norm) / count(*) AS cg, sum(r / norm) / count(*) AS cr FROM l JOIN k USING (video, frame) GROUP BY video),
  h AS (SELECT *, least(1.0, sqrt(cb ** 2 + cg ** 2 + cr ** 2)) AS hue, greatest(cb, cg, cr) AS top, least(cb, cg, cr) AS low FROM s)""", """
SELECT video, round(hue, 6) AS hue, CASE WHEN ok THEN round(cb / top, 6) END AS tb, CASE WHEN ok THEN round(cg / top, 6) END AS tg, CASE WHEN ok THEN round(cr / top, 6) END AS tr FROM (SELECT *, n_frames >= 1 AND n_px >= 64 AND top > 1e-6 AND hue >= 0.9 AND low / top <= 0.3 AS ok FROM h)""")
def tints(spark, sf_dir):
    e = F.transform("embedding", lambda v: F.abs(v.cast("double")))
    at = F.transform(F.sequence(F.lit(1), F.lit(62)), lambda i: F.array(*[F.element_at(F.col("e"), i + j) * s for j, s in ((0, 30.0), (1, 300.0), (2, 30.0))]))
    rows = views.read(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("video"), F.col("vec_id").alias("frame"), e.alias("e")).select("video", "frame", at.alias("bgr"))
    return review.tints(pixels.colour_evidence(rows, share=0.2, enough=20), pure=0.9)


@query("flat_corrected", "frames8", "c AS (SELECT frame, list_transform(px, lambda v, i: abs(v) / greatest(0.5 + i % 3 * 0.5, 0.001)) AS c FROM frames8), m AS (SELECT frame, c, list_median(c) AS m FROM c)", "SELECT frame, round(list_sum(list_transform(c, lambda v, i: i * v * (100.0 / greatest(m, 0.001)))), 3) AS checksum FROM m")
def flat_corrected(spark, sf_dir):
    flat = F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: 0.5 + i % 3 * 0.5)
    rows = views.frames8(spark, sf_dir).select("frame", pixels.flat_corrected(F.transform("px", lambda v: F.abs(v)), flat, 100.0).alias("c"))
    return rows.select("frame", F.round(F.aggregate(F.transform("c", lambda v, i: v * (i + 1)), F.lit(0.0), lambda s, v: s + v), 3).alias("checksum"))


@query("chosen_stills", "", "r AS (SELECT c_custkey % 30 AS recording, 'still' || c_custkey AS still, CASE WHEN c_custkey % 7 <> 0 THEN c_custkey * 11 % 41 / 100.0 END AS margin, c_custkey * 13 % 97 / 100.0 AS ncc FROM customer)", "SELECT recording, still FROM r QUALIFY row_number() OVER (PARTITION BY recording ORDER BY coalesce(margin, -1) DESC, ncc DESC, still DESC) = 1")
def chosen_stills(spark, sf_dir):
    k = F.col("c_custkey")
    rows = views.read(spark, sf_dir, "customer").select((k % 30).alias("recording"), F.concat(F.lit("still"), k.cast("string")).alias("still"), F.when(k % 7 != 0, k * 11 % 41 / 100.0).alias("margin"), (k * 13 % 97 / 100.0).alias("ncc"))
    return review.chosen_stills(rows)


@query("median_composite", "frames8", "e AS (SELECT grp, x, y, unnest(px) AS value, generate_subscripts(px, 1) - 1 AS pixel FROM frames8)", "SELECT grp, x + pixel % 8 AS cx, y + pixel // 8 AS cy, round(median(value), 6) AS px FROM e GROUP BY ALL")
def median_composite(spark, sf_dir):
    return pixels.median_composite(views.frames8(spark, sf_dir))


@query("tone_frames", "frame_track", "", "SELECT video, frame FROM (SELECT video, frame, row_number() OVER (PARTITION BY video ORDER BY frame) - 1 AS i, greatest(1, count(*) OVER (PARTITION BY video) // 96) AS stride FROM frame_track) WHERE i % stride = 0 AND i // stride < 96")
def tone_frames(spark, sf_dir):
    return tracks.tone_frames(views.frame_track(spark, sf_dir))


@query("bridges_to_first", "frame_track", "{keyframes}, r AS (SELECT *, row_number() OVER (PARTITION BY video, segment ORDER BY frame) AS up, row_number() OVER (PARTITION BY video, segment ORDER BY frame DESC) AS down FROM k)", "SELECT a.video, a.frame AS a, b.frame AS b FROM r a JOIN r b ON a.video = b.video AND (b.segment - a.segment IN (1, 2, 3) OR a.segment = 0 AND b.segment > 3) WHERE a.down <= 4 AND b.up <= 3")
def bridges_to_first(spark, sf_dir):
    return tracks.bridge_candidates(tracks.travel_keyframes(views.frame_track(spark, sf_dir)), to_first=True)


# streams


@query("live_log", "", """l AS (SELECT user_id::VARCHAR AS dataset, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS trial, CASE WHEN event_type IN ('view', 'click', 'signup') THEN 'Snapshot' ELSE 'Other' END AS type, epoch_us(ts) // 1000000 AS s FROM events),
  g AS (SELECT dataset, trial, (s - lag(s) OVER (PARTITION BY dataset ORDER BY trial))::DOUBLE AS gap_s FROM l WHERE type = 'Snapshot')""", "SELECT l.dataset, l.trial, type, s, gap_s FROM l LEFT JOIN g ON l.dataset = g.dataset AND l.trial = g.trial")
def live_log(spark, sf_dir):
    path = scratch(spark, "log-lines")
    views.log_lines(spark, sf_dir).write.parquet(path)
    lines = spark.readStream.schema("dataset long, line_no long, value string").parquet(path)
    return live._to_the_end(live_logs.entries(lines), "log").where("not late").select("dataset", "trial", "type", "s", "gap_s")


@query("live_sample", "", "", None)
def live_sample(spark, sf_dir):
    return live.live_sample(spark, sf_dir)
