"""Session settings the operators rely on, and the one place where lineage is cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

# Runtime SQL settings: they may be set on a live session and change no results.
RUNTIME_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # A thread, parent or token may hold a third of all rows: let the runtime split such
    # join partitions even where a later operator could have reused the partitioning.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Where every partition of one side was measured to be small, hash it instead of sorting both.
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64MB",
    # Sessions of a busy key are merged inside each partition before they are shuffled.
    "spark.sql.sessionWindow.merge.sessions.in.local.partition": "true",
    # What a task exchanges with Python at once stands in the memory of both sides, for each task of an executor.
    "spark.sql.execution.arrow.maxBytesPerBatch": "8MB",
    "spark.sql.session.timeZone": "UTC",
}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by the cluster in ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder of its own machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="branchwise-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path below this application's part of the shared folder."""
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def release(spark: SparkSession) -> None:
    """Delete this application's intermediate tables, once its results have been written elsewhere."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` to a new table in the shared folder and read it from there afterwards.

    Cuts the lineage of iterative plans; a lost executor re-reads files and recomputes nothing. Later
    steps read only the columns they use and plan their joins by the real size of the files.
    """
    path = scratch_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def durable_counting(df: DataFrame, condition: Column) -> tuple[DataFrame, int]:
    """``durable``, and how many rows fulfil ``condition``, counted while writing."""
    seen = Observation()
    table = durable(df.observe(seen, F.count(F.when(condition, True)).alias("n")))
    return table, seen.get["n"]


def spread(df: DataFrame, key: str) -> DataFrame:
    """Repartition a table that is read in fewer parts than there are cores; others stay as they are.

    For single-file inputs, whose one row group would leave all work on it to one task. Changes the plan, never
    the result; only the number of scan partitions is looked at.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df
