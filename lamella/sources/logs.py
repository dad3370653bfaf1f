"""Acquisition logs as text and position tables as CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fixed values of the log format: an optional date, a time, a trial or a new experiment.
STAMP = r"^\s*(?:(\d\d/\d\d/\d\d)\s+)?(\d\d):(\d\d):(\d\d)\s"
TRIAL = r"^\s*(?:\d\d/\d\d/\d\d\s+)?\d\d:\d\d:\d\d\s+Trial\s+(\d+):\s*(.+?)\s*$"
EXPERIMENT = r"^\s*\d\d/\d\d/\d\d\s+\d\d:\d\d:\d\d\s+New experiment:\s*(\S+)"
BACK_SECONDS = 60


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines ``(dataset, line_no, value)`` of many logs; the dataset is the log's folder, line_no only orders them."""
    rows = spark.read.text(path).select("value", "_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("id"))
    by = Window.partitionBy("file_path").orderBy("file_block_start", "id")
    return rows.select(F.element_at(F.split("file_path", "/"), -2).alias("dataset"), F.row_number().over(by).cast("long").alias("line_no"), "value")


def parse(lines: DataFrame) -> DataFrame:
    """Entries ``(dataset, line_no, trial, type, s)``, s in seconds since the epoch.

    The last date seen holds until the next one (W1); a clock that goes back by over a minute since the previous
    stamped line starts another day (W2). Lines without a stamp, before any date, or of other kinds give no row.
    """
    group = lambda pattern, k: F.nullif(F.regexp_extract(F.coalesce("value", F.lit("")), pattern, k), F.lit(""))
    clock = group(STAMP, 2).cast("long") * 3600 + group(STAMP, 3).cast("long") * 60 + group(STAMP, 4).cast("long")
    rows = lines.select("dataset", "line_no", clock.alias("clock"), F.to_date(group(STAMP, 1), "MM/dd/yy").alias("date"), group(TRIAL, 1).cast("long").alias("trial"), group(TRIAL, 2).alias("type")).where("clock IS NOT NULL")
    by = Window.partitionBy("dataset").orderBy("line_no")
    turned = F.coalesce((F.col("date").isNull() & (F.lag("clock").over(by) - F.col("clock") > BACK_SECONDS)).cast("int"), F.lit(0))
    rows = rows.withColumn("turned", turned).withColumn("day", F.last("date", ignorenulls=True).over(by)).withColumn("part", F.count("date").over(by))
    days = F.sum("turned").over(Window.partitionBy("dataset", "part").orderBy("line_no"))
    rows = rows.withColumn("s", (F.unix_date("day") + days) * 86400 + F.col("clock"))
    return rows.where("day IS NOT NULL AND trial IS NOT NULL").select("dataset", "line_no", "trial", "type", "s")


def experiments(lines: DataFrame) -> DataFrame:
    """The first experiment named in each log; the dataset's own name where there is none."""
    name = F.nullif(F.regexp_extract(F.coalesce("value", F.lit("")), EXPERIMENT, 1), F.lit(""))
    return lines.groupBy("dataset").agg(F.min_by(name, F.when(name.isNotNull(), F.col("line_no"))).alias("name")).select("dataset", F.coalesce("name", F.col("dataset").cast("string")).alias("experiment"))


def render(entries: DataFrame) -> DataFrame:
    """Entries ``(dataset, trial, type, us)`` as log lines, the date only on the first line of a day."""
    at = F.timestamp_micros("us")
    by = Window.partitionBy("dataset").orderBy("trial")
    day = F.floor(F.col("us") / 86_400_000_000)
    head = F.when(F.lag(day).over(by).eqNullSafe(day), F.lit("        ")).otherwise(F.date_format(at, "MM/dd/yy"))
    return entries.select("dataset", F.col("trial").alias("line_no"), F.concat(head, F.lit(" "), F.date_format(at, "HH:mm:ss"), F.lit(" Trial "), F.lpad(F.col("trial").cast("string"), 9, "0"), F.lit(": "), "type").alias("value"))


def write_positions(tiles: DataFrame, path: str, unverified: bool = True) -> None:
    """``trial,x,y,state`` in trial order with four decimals, one folder per dataset; unplaced and excluded tiles stay out."""
    states = ["anchor", "human"] + ["unverified"] * unverified
    rows = tiles.where(F.col("state").isin(states) & F.col("x").isNotNull() & F.col("y").isNotNull())
    rows = rows.select("dataset", "trial", F.format_string("%.4f", "x").alias("x"), F.format_string("%.4f", "y").alias("y"), "state")
    rows.repartition("dataset").sortWithinPartitions("dataset", "trial").write.partitionBy("dataset").option("header", True).csv(path)


def read_positions(spark: SparkSession, path: str) -> DataFrame:
    """Positions of every dataset below ``path``."""
    return spark.read.schema("trial long, x double, y double, state string, dataset string").option("header", True).csv(path).select("dataset", "trial", "x", "y", "state")
