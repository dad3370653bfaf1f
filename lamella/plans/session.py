"""Where jobs cut their lineage: the folder that the cluster shares."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
INFERENCE = "spark.sql.constraintPropagation.enabled"
#: Rows of ids that may be broadcast; about 100 MB in an executor.
BROADCAST_ROWS = 2_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; only where that is unset (tests, a laptop) one of our own."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the cluster shares")
        context.setCheckpointDir(folder or "file://" + tempfile.mkdtemp(prefix="spark-"))
    return spark.conf.get("spark.checkpoint.dir", None) or context._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder; Spark removes the files when the plan is collected.

    What the optimizer infers about the columns isn't kept with it: over the rounds of a loop that would grow without end.
    """
    spark = df.sparkSession
    shared_dir(spark)
    with setting(spark, INFERENCE, "false"):
        return df.checkpoint()


def scratch(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder, for tables too wide to checkpoint row by row."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A session setting that holds inside the block only."""
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def tidy(spark: SparkSession):
    """Shuffle files of a query go as soon as it has ended, not when its plan is collected."""
    return setting(spark, CLEANUP, "true")


def saved(df: DataFrame, label: str, **options: str) -> DataFrame:
    """``df`` written as compressed Parquet in the shared folder and reread."""
    path = scratch(df.sparkSession, label)
    with tidy(df.sparkSession):
        df.write.option("compression", "zstd").options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(parts: list[DataFrame], key: str, label: str, n: int = 1) -> DataFrame:
    """The union of ``parts`` as a table in ``n`` buckets of ``key``, at least as many as there are shuffle partitions, so joins by it leave it in place.

    The parts are computed and exchanged one after another. :func:`forget` drops the table.
    """
    spark = parts[0].sparkSession
    name, n = f"{label}_{uuid.uuid4().hex}", max(n, int(spark.conf.get("spark.sql.shuffle.partitions")))
    path = scratch(spark, label)
    for part in parts:
        with tidy(spark):  # and what commands inside a command leave, as the driver's collector finds
            part.repartition(n, key).write.format("parquet").option("compression", "zstd").bucketBy(n, key).mode("append").option("path", path).saveAsTable(name)
        spark._jvm.System.gc()
    table = spark.table(name)
    table.table_name = name
    return table


def forget_path(spark: SparkSession, folder: str) -> None:
    """Deletes a folder that :func:`scratch` named."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def settled(df: DataFrame, label: str, *tables: DataFrame) -> DataFrame:
    """``df`` saved, and the wider tables that it was computed from deleted."""
    out = saved(df, label)
    forget(*tables)
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes tables that :func:`saved` or :func:`bucketed` made, once all that was computed from them is stored."""
    for table in tables:
        folders = {f.rpartition("/")[0] for f in table.inputFiles()}
        if name := getattr(table, "table_name", None):
            table.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")
        for folder in folders:
            forget_path(table.sparkSession, folder)


def collected(spark: SparkSession) -> None:
    """Lets go of what plans that have ended hold in the driver (plans, broadcasts, addresses of shuffle files), and of its files.

    A loop calls it after each round; else the driver's heap grows until the JVM happens to collect it.
    """
    gc.collect()  # the JVM's plans live as long as their Python objects
    spark._jvm.System.gc()


def bounded(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """Narrow ``df``, stored and counted: to be broadcast while it has at most ``most`` rows, else to be shuffled."""
    df = checkpointed(df)
    return F.broadcast(df) if df.count() <= most else df.hint("merge")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of at most ``rows`` texts, unless the session already says how large they are.

    The default of 10,000 rows makes batches of tens of MB from documents, in the JVM and in the worker at once.
    """
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
