"""Registered queries of layouts, grids, pairs and pictures as blocks, with the SQL each is held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.operators import blocks, lattice, pairing, recut, solving
from lamella.plans.survey import query
from lamella.sources import views


def _planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links between tiles one, two and five numbers apart, exact but for each eleventh that isn't between neighbours."""
    tiles = views.tiles(spark, sf_dir).select("dataset", "trial", "mx", "my")
    step = F.explode(F.array(F.lit(1), F.lit(2), F.lit(5)))
    one = tiles.select("dataset", F.col("trial").alias("a"), F.col("mx").alias("ax"), F.col("my").alias("ay"), step.alias("s")).withColumn("b", F.col("a") + F.col("s"))
    two = tiles.select("dataset", F.col("trial").alias("b"), F.col("mx").alias("bx"), F.col("my").alias("by"))
    off = F.when((F.col("a") % 11 == 3) & (F.col("s") > 1), F.when(F.col("s") == 2, 150.0).otherwise(-200.0)).otherwise(0.0)
    return one.join(two, ["dataset", "b"]).select("dataset", "a", "b", (F.col("bx") - F.col("ax") + off).alias("dx"), (F.col("by") - F.col("ay") - off).alias("dy"), F.when(off == 0, 0.5 + F.col("a") % 5 / 10.0).otherwise(0.1).alias("ncc"))


_LINKS = "l AS (SELECT a.dataset, a.trial AS a, b.trial AS b FROM tiles a JOIN tiles b ON a.dataset = b.dataset AND b.trial - a.trial IN (1, 2, 5))"


@query("solved_layout", "tiles", _LINKS + ", e AS (SELECT DISTINCT dataset, unnest([a, b]) AS node FROM l), f AS (SELECT dataset, min(node) AS first FROM e GROUP BY dataset)", """
SELECT e.dataset, node, 0 AS component, t.mx - o.mx AS x, t.my - o.my AS y FROM e JOIN f ON e.dataset = f.dataset JOIN tiles t ON t.dataset = e.dataset AND t.trial = node JOIN tiles o ON o.dataset = e.dataset AND o.trial = first""")
def solved_layout(spark, sf_dir):
    layout, _ = solving.solved_layout(_planted(spark, sf_dir))
    return layout.withColumns({c: F.round(c, 3) + 0.0 for c in "xy"})


@query("solved_links", "tiles", _LINKS, "SELECT * FROM l WHERE NOT (a % 11 = 3 AND b - a > 1)")
def solved_links(spark, sf_dir):
    return solving.solved_layout(_planted(spark, sf_dir))[1].select("dataset", "a", "b")


def _pads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detected pads of the grids: some missing, some off their place."""
    k = F.col("col") + 31 * F.col("row")
    off = F.when(k % 41 == 4, 6.0).otherwise(0.0)
    return views.electrodes(spark, sf_dir).where(k % 9 != 2).select("mosaic", k.alias("pad"), (F.col("x") + off).alias("x"), (F.col("y") + off).alias("y"))


_INDEXED = """p AS (SELECT mosaic, col + 31 * row AS pad, col, row FROM electrodes WHERE (col + 31 * row) % 9 <> 2),
  m AS (SELECT mosaic, min(pad) AS part, count(*) AS n, min(col) AS c0, min(row) AS r0 FROM p WHERE pad % 41 <> 4 GROUP BY mosaic),
  i AS (SELECT p.mosaic, pad, CASE WHEN pad % 41 = 4 THEN pad ELSE part END AS part, CASE WHEN pad % 41 = 4 THEN 1 ELSE n END AS n, CASE WHEN pad % 41 = 4 THEN 1 ELSE col - c0 + 1 END AS col, CASE WHEN pad % 41 = 4 THEN 1 ELSE row - r0 + 1 END AS row FROM p JOIN m USING (mosaic))"""


@query("indexed_pads", "electrodes", _INDEXED, "SELECT *, 0 AS n_wrong FROM i")
def indexed_pads(spark, sf_dir):
    return lattice.indexed_pads(_pads(spark, sf_dir), (14.0, 0.0), (0.0, 14.0))


@query("filled_cells", "electrodes", _INDEXED + ", b AS (SELECT mosaic, part, col + d[1] AS col, row + d[2] AS row, count(*) AS n_around FROM i, (SELECT unnest([[1, 0], [-1, 0], [0, 1], [0, -1]]) AS d) GROUP BY ALL)", """
SELECT * FROM b WHERE n_around > 1 AND NOT EXISTS (SELECT 1 FROM i WHERE i.mosaic = b.mosaic AND i.part = b.part AND i.col = b.col AND i.row = b.row)""")
def filled_cells(spark, sf_dir):
    return lattice.filled_cells(indexed_pads(spark, sf_dir))


@query("measured_pairs", "frames8", """e AS (SELECT grp, frame, generate_subscripts(px, 1) - 1 AS i, unnest(px) AS v FROM frames8), s AS (SELECT a.x AS dx, b.x AS dy FROM (SELECT unnest([-4, -2, 0, 2, 4]) AS x) a, (SELECT unnest([-4, -2, 0, 2, 4]) AS x) b),
  c AS (SELECT a.grp AS dataset, a.frame AS a, b.frame AS b, dx, dy, round(corr(a.v, b.v), 9) AS ncc FROM e a, s, e b WHERE a.grp = b.grp AND a.frame < b.frame AND b.i % 8 = a.i % 8 - dx AND b.i // 8 = a.i // 8 - dy GROUP BY ALL)""", """
SELECT dataset, a, b, dx, dy, round(ncc, 6) AS ncc, dx <> 0 OR dy <> 0 AS moved FROM c QUALIFY row_number() OVER (PARTITION BY dataset, a, b ORDER BY ncc DESC, dy, dx) = 1""")
def measured_pairs(spark, sf_dir):
    tiles = views.frames8(spark, sf_dir).select(F.col("grp").alias("dataset"), F.col("frame").alias("trial"), "px")
    return pairing.measured_pairs(tiles, 8, (-4, -2, 0, 2, 4), 16).withColumn("ncc", F.round("ncc", 6))


def _canvas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures of 20 blocks across, with gaps, one for each group of frames."""
    return views.frames8(spark, sf_dir).select("grp", (F.col("frame") % 20).alias("bx"), F.floor(F.col("frame") / 20).alias("by"), "px")


_PICTURE = "e AS (SELECT grp, frame, generate_subscripts(px, 1) - 1 AS i, unnest(px) AS v FROM frames8), p AS (SELECT grp, 8 * (frame % 20) + i % 8 AS x, 8 * (frame // 20) + i // 8 AS y, v FROM e)"
_MAXIMA = _PICTURE + ", q AS (SELECT p.grp, p.x, p.y, p.v AS value FROM p JOIN p o ON o.grp = p.grp AND o.x BETWEEN p.x - 2 AND p.x + 2 AND o.y BETWEEN p.y - 2 AND p.y + 2 WHERE p.v >= 0.1 GROUP BY ALL HAVING max(o.v) <= p.v)"


@query("local_maxima", "frames8", _MAXIMA, "SELECT grp, x, y, round(value, 6) AS value FROM q")
def local_maxima(spark, sf_dir):
    return blocks.local_maxima(_canvas(spark, sf_dir), 8, 2, 0.1).withColumn("value", F.round("value", 6))


def _walk(points: str, near: str, order: str) -> str:
    """One by one from the best on: a point stays unless one that stayed is near."""
    return f"""r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY {order}) AS i FROM {points}),
  w AS (SELECT DISTINCT grp, 0::BIGINT AS i, []::STRUCT(x BIGINT, y BIGINT, score DOUBLE)[] AS kept FROM r
        UNION ALL SELECT w.grp, r.i, CASE WHEN len(list_filter(kept, lambda k: {near})) = 0 THEN list_append(kept, {{'x': r.x, 'y': r.y, 'score': r.score}}) ELSE kept END FROM w JOIN r ON r.grp = w.grp AND r.i = w.i + 1),
  z AS (SELECT grp, unnest(kept) AS k FROM (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY grp ORDER BY i DESC) = 1))"""


@query("separated_peaks", "frames8", _MAXIMA + ", u AS (SELECT grp, x, y, value AS score FROM q), " + _walk("u", "(k.x - r.x) * (k.x - r.x) + (k.y - r.y) * (k.y - r.y) <= 81", "score DESC, y, x"), "SELECT grp, k.x AS x, k.y AS y, round(k.score, 6) AS score FROM z")
def separated_peaks(spark, sf_dir):
    peaks = blocks.local_maxima(_canvas(spark, sf_dir), 8, 2, 0.1).withColumnRenamed("value", "score")
    return pairing.kept_apart(peaks, 9, round_reach=True).withColumn("score", F.round("score", 6))


@query("covered_windows", "frames8", _PICTURE + """, b AS (SELECT grp, frame % 20 AS cx, frame // 20 AS cy, sum(CASE WHEN v > 0 THEN 1 ELSE 0 END) AS s FROM e GROUP BY ALL), g AS (SELECT grp, min(cx) AS x0, max(cx) AS x1, min(cy) AS y0, max(cy) AS y1 FROM b GROUP BY grp),
  v AS (SELECT grp, ox, oy FROM (SELECT grp, x1, y1, unnest(range(x0, x1 - 2, 2)) AS ox, y0 FROM g), unnest(range(y0, y1 - 2, 2)) AS t(oy)),
  u AS (SELECT v.grp, ox AS x, oy AS y, sum(s) / 1024.0::DOUBLE AS score FROM v JOIN b ON b.grp = v.grp AND cx BETWEEN ox AND ox + 3 AND cy BETWEEN oy AND oy + 3 GROUP BY ALL HAVING sum(s) / 1024.0 > 0.02), """ + _walk("u", "abs(k.x - r.x) < 2 AND abs(k.y - r.y) < 2", "score DESC, y DESC, x DESC"), """
SELECT grp, row_number() OVER (PARTITION BY grp ORDER BY k.score DESC, k.y DESC, k.x DESC) AS place, k.x AS block_x, k.y AS block_y, round(k.score, 6) AS share FROM z QUALIFY place <= 5""")
def covered_windows(spark, sf_dir):
    lit = _canvas(spark, sf_dir).withColumn("px", F.transform("px", lambda v: (v > 0).cast("double")))
    return blocks.covered_windows(lit, 8, 4, least=0.02).select("grp", "place", F.col("bx").alias("block_x"), F.col("by").alias("block_y"), F.round("share", 6).alias("share"))


@query("flat_fields", "frames8", """e AS (SELECT grp, generate_subscripts(px, 1) - 1 AS i, unnest(px) AS v FROM frames8), m AS (SELECT grp, i % 8 AS x, i // 8 AS y, median(v) + 2 AS v FROM e GROUP BY ALL),
  k AS (SELECT d, exp(-0.5 * d * d) / (SELECT sum(exp(-0.5 * j * j)) FROM range(-4, 5) AS t(j)) AS w FROM range(-4, 5) AS t(d)), f AS (SELECT d, w, x, CASE WHEN abs(x + d) > 7 THEN 14 - abs(x + d) ELSE abs(x + d) END AS at FROM k, range(0, 8) AS t(x)),
  h AS (SELECT grp, f.x, y, sum(w * v) AS v FROM m JOIN f ON m.x = f.at GROUP BY ALL), b AS (SELECT grp, h.x, f.x AS y, sum(w * v) AS v FROM h JOIN f ON h.y = f.at GROUP BY ALL)""", """
SELECT grp, x + 8 * y AS pixel, round(v / avg(v) OVER (PARTITION BY grp), 6) AS value FROM b""")
def flat_fields(spark, sf_dir):
    frames = views.frames8(spark, sf_dir).select("grp", F.transform("px", lambda v: v + 2).alias("px"))
    return blocks.flat_field(frames, 8, 1.0).select("grp", F.posexplode("px").alias("pixel", "value")).withColumn("value", F.round("value", 6))


@query("recut_runs", "tiles", "", """SELECT dataset, trial % 2 AS run, trial, CASE WHEN dataset % 3 = 0 AND trial % 20 >= 8 THEN 1 ELSE 0 END AS part, trial % 20 = 13 AS outlier FROM tiles""")
def recut_runs(spark, sf_dir):
    """Two runs a dataset; in some the chain is 40 px off from a tile on, in one run an anchor is wrong and some have none."""
    i = F.col("trial") % 20
    broken = F.when((F.col("dataset") % 3 == 0) & (i >= 8), 40.0).otherwise(0.0)
    anchor = lambda c: F.when(i % 10 != 6, F.col(c) + F.when(i == 13, 100.0).otherwise(0.0))
    tiles = views.tiles(spark, sf_dir).withColumn("run", F.col("trial") % 2)
    return recut.recut_runs(tiles.select("dataset", "run", "trial", (F.col("mx") + broken).alias("lx"), F.col("my").alias("ly"), anchor("mx").alias("ax"), anchor("my").alias("ay")))
