"""Deterministic survey tables built from the driver's tables by integer arithmetic, and their SQL for the oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lamella.sources import logs


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log entries ``(dataset, trial, type, us, texture)``; us is the time in microseconds."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    kind = F.when(F.col("event_type").isin("view", "click", "signup"), "Snapshot").otherwise("Other")
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("dataset"), F.row_number().over(w).cast("long").alias("trial"), kind.alias("type"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("value").alias("texture"))


def trial_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frame inventory ``(dataset, trial, w, h)``; every eleventh frame is off-shape."""
    k = F.col("o_orderkey")
    return read(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("dataset"), k.alias("trial"), F.lit(512).alias("w"), F.when(k % 11 == 0, 128).otherwise(512).alias("h"))


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles ``(dataset, trial, state, x, y, mx, my, ncc, margin, diverted, stale, seq)``, 20 to a dataset; m is the machine's position."""
    k = F.col("p_partkey")
    more = (k % 9 == 0).alias("diverted"), (k % 4 == 0).alias("stale"), (k * 7 % 101).alias("seq")
    state = F.element_at(F.array(F.lit("anchor"), F.lit("unverified"), F.lit("human"), F.lit("excluded")), (F.col("p_size") % 4 + 1).cast("int"))
    x, y = (178 * (k % 40)).cast("double"), (160 * F.floor(k / 40)).cast("double")
    return read(spark, sf_dir, "part").select(F.floor(k / 20).alias("dataset"), k.alias("trial"), state.alias("state"), x.alias("x"), y.alias("y"), (x + k % 7).alias("mx"), (y + k % 5).alias("my"), ((k % 100) / 100.0).cast("double").alias("ncc"), ((k % 37) / 100.0).cast("double").alias("margin"), *more)


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measured links ``(dataset, a, b, dx, dy, px, py, response, ncc, kind)`` between different tiles; some priors lie at or past the frame's edge."""
    kind = F.element_at(F.array(F.lit("seq"), F.lit("cross"), F.lit("bridge")), (F.col("l_linenumber") % 3 + 1).cast("int"))
    q = F.col("l_quantity")
    rows = read(spark, sf_dir, "lineitem").where("l_partkey <> l_suppkey")
    prior = F.when(F.col("l_orderkey") % 17 == 0, 500.0).when(F.col("l_orderkey") % 19 == 0, 480.0).otherwise(0.0)
    return rows.select((F.col("l_orderkey") % 20).alias("dataset"), F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"), (q + F.when(prior == 480, 480.0).otherwise(0.0)).alias("dx"), (2 * q).alias("dy"), prior.alias("px"), F.lit(0.0).alias("py"), (10 * F.col("l_discount")).alias("response"), (10 * F.col("l_tax")).alias("ncc"), kind.alias("kind"))


def electrodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Electrode cells ``(mosaic, col, row, x, y, kind)`` on grids of 30 x 20 cells of pitch 14 (every ninth cell inferred)."""
    k = F.col("o_orderkey")
    col, row = 1 + k % 600 % 30, 1 + F.floor(k % 600 / 30)
    return read(spark, sf_dir, "orders").select(F.floor(k / 600).alias("mosaic"), col.alias("col"), row.alias("row"), (14 * col + k % 3).cast("double").alias("x"), (14 * row + k % 2).cast("double").alias("y"), F.when(k % 9 == 0, 2).otherwise(1).alias("kind"))


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rectangles ``(region, mosaic, x, y, w, h)``."""
    k = F.col("s_suppkey")
    return read(spark, sf_dir, "supplier").select(k.alias("region"), (k % 3).alias("mosaic"), (k * 37 % 400).cast("double").alias("x"), (k * 53 % 280).cast("double").alias("y"), (20 + k % 90).cast("double").alias("w"), (20 + k % 70).cast("double").alias("h"))


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entries as text ``(dataset, line_no, value)``."""
    return logs.render(entries(spark, sf_dir))


def frame_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Camera tracks ``(video, frame, gray, step, response)``; step in hundredths of a pixel."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    step = F.floor(F.col("value") * 100).cast("long") % 700
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("video"), F.row_number().over(w).cast("long").alias("frame"), F.col("value").alias("gray"), step.alias("step"), (F.col("event_id") % 100 / 100.0).cast("double").alias("response"))


def frames8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of 8 x 8 pixels ``(frame, grp, x, y, px)`` placed four pixels apart."""
    k = F.col("vec_id")
    return read(spark, sf_dir, "embeddings").select(k.alias("frame"), F.col("label").cast("long").alias("grp"), (4 * (k % 20)).cast("long").alias("x"), (4 * (F.floor(k / 20) % 20)).cast("long").alias("y"), F.col("embedding").cast("array<double>").alias("px"))


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pitch readings ``(recording, pitch, snr)``."""
    k = F.col("c_custkey")
    return read(spark, sf_dir, "customer").select((k % 30).alias("recording"), (10 + (k * 7 % 53) / 10.0).cast("double").alias("pitch"), (k * 11 % 41).cast("double").alias("snr"))


TABLES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (entries, trial_meta, tiles, links, electrodes, regions, log_lines, frame_track, frames8, readings)}

SQL = {
    "entries": """SELECT user_id AS dataset, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS trial,
      CASE WHEN event_type IN ('view','click','signup') THEN 'Snapshot' ELSE 'Other' END AS type, epoch_us(ts) AS us, value AS texture FROM events""",
    "trial_meta": "SELECT o_custkey % 50 AS dataset, o_orderkey AS trial, 512 AS w, CASE WHEN o_orderkey % 11 = 0 THEN 128 ELSE 512 END AS h FROM orders",
    "tiles": """SELECT p_partkey // 20 AS dataset, p_partkey AS trial, (['anchor','unverified','human','excluded'])[p_size % 4 + 1] AS state,
      (178 * (p_partkey % 40))::DOUBLE AS x, (160 * (p_partkey // 40))::DOUBLE AS y, (178 * (p_partkey % 40) + p_partkey % 7)::DOUBLE AS mx,
      (160 * (p_partkey // 40) + p_partkey % 5)::DOUBLE AS my, (p_partkey % 100) / 100.0::DOUBLE AS ncc, (p_partkey % 37) / 100.0::DOUBLE AS margin,
      p_partkey % 9 = 0 AS diverted, p_partkey % 4 = 0 AS stale, p_partkey * 7 % 101 AS seq FROM part""",
    "links": """SELECT l_orderkey % 20 AS dataset, l_partkey AS a, l_suppkey AS b, (l_quantity + CASE WHEN l_orderkey % 17 <> 0 AND l_orderkey % 19 = 0 THEN 480 ELSE 0 END)::DOUBLE AS dx, 2 * l_quantity AS dy,
      CASE WHEN l_orderkey % 17 = 0 THEN 500 WHEN l_orderkey % 19 = 0 THEN 480 ELSE 0 END::DOUBLE AS px, 0::DOUBLE AS py, 10 * l_discount AS response,
      10 * l_tax AS ncc, (['seq','cross','bridge'])[l_linenumber % 3 + 1] AS kind FROM lineitem WHERE l_partkey <> l_suppkey""",
    "electrodes": """SELECT o_orderkey // 600 AS mosaic, 1 + o_orderkey % 600 % 30 AS col, 1 + o_orderkey % 600 // 30 AS row, (14 * (1 + o_orderkey % 600 % 30) + o_orderkey % 3)::DOUBLE AS x,
      (14 * (1 + o_orderkey % 600 // 30) + o_orderkey % 2)::DOUBLE AS y, CASE WHEN o_orderkey % 9 = 0 THEN 2 ELSE 1 END AS kind FROM orders""",
    "regions": """SELECT s_suppkey AS region, s_suppkey % 3 AS mosaic, (s_suppkey * 37 % 400)::DOUBLE AS x, (s_suppkey * 53 % 280)::DOUBLE AS y,
      (20 + s_suppkey % 90)::DOUBLE AS w, (20 + s_suppkey % 70)::DOUBLE AS h FROM supplier""",
    "frame_track": """SELECT user_id AS video, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS frame, value AS gray,
      floor(value * 100)::BIGINT % 700 AS step, event_id % 100 / 100.0::DOUBLE AS response FROM events""",
    "frames8": """SELECT vec_id AS frame, label::BIGINT AS grp, 4 * (vec_id % 20) AS x, 4 * (vec_id // 20 % 20) AS y, embedding::DOUBLE[] AS px FROM embeddings""",
    "readings": "SELECT c_custkey % 30 AS recording, (10 + (c_custkey * 7 % 53) / 10.0)::DOUBLE AS pitch, (c_custkey * 11 % 41)::DOUBLE AS snr FROM customer",
}
