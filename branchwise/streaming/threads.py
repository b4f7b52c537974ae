"""Keeping branches and scored claims up to date as replies arrive.

A reply can re-open a thread at any time, and a thread may be very large, so threads are not held
as state of one key. Each micro-batch is added to a message store; the threads it touches are put
together again with the batch operators and written as a new version. Readers take the highest
version per thread. A batch that is run again overwrites its own output.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from branchwise.operators import tree
from branchwise.sources import store as store_of

BUCKETS = 64


def _bucket(buckets: int):
    return F.pmod(F.xxhash64("source_id"), F.lit(buckets)).cast("int")


def newest(messages: DataFrame) -> DataFrame:
    """Of every message the copy of the last batch; inside a batch the largest row, compared column by column
    from the time on, so that a run over the same files gives the same."""
    rest = [c for c in messages.columns if c not in ("source_id", "msg_id", "bucket", "batch")]
    rest.sort(key=lambda c: c != "created")
    return (messages.groupBy("source_id", "msg_id").agg(F.max(F.struct("batch", *rest)).alias("_m"))
            .select("source_id", "msg_id", *[f"_m.{c}" for c in rest]))


def update_threads(batch: DataFrame, batch_id: int, store: str, out: str,
                   derive: Callable[[DataFrame], DataFrame] | None = None, buckets: int = BUCKETS) -> None:
    """One micro-batch: store its messages, then write ``derive`` of all touched threads.

    ``derive`` maps messages to rows with source_id, by default the branches with their lengths. A message seen again
    replaces the older one. The number of ``buckets`` belongs to a store for good; choose it by the expected size, as a batch
    reads the buckets it touches.
    """
    spark = batch.sparkSession
    # Few files per bucket, and several for a bucket that holds much of the batch.
    (batch.withColumn("bucket", _bucket(buckets)).hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket")
     .parquet(f"{store}/batch={batch_id:012d}"))
    # declared, as a batch without rows leaves no file to read a schema from
    arrived = spark.read.schema(batch.withColumn("bucket", F.lit(0)).schema).parquet(f"{store}/batch={batch_id:012d}")
    touched = arrived.select("bucket", "source_id").distinct()
    ids = sorted(r[0] for r in touched.select("bucket").distinct().collect())  # at most ``buckets`` numbers
    if not ids:
        return
    history = spark.read.option("basePath", store).parquet(store).where((F.col("batch") <= batch_id) & F.col("bucket").isin(ids))
    messages = newest(history.join(touched, ["bucket", "source_id"], "left_semi")).select([c for c in batch.columns])
    store_of.append((derive or tree.branches)(messages), out, batch_id)


def compact(spark: SparkSession, store: str, target: str, buckets: int = BUCKETS) -> None:
    """Write the newest copy of every message of ``store`` as the first batch of the new store ``target``.

    Run it between two streams now and then: later batches then read each message once. It keeps the number of
    the last batch, so a stream with the same checkpoint goes on in ``target``.
    """
    history = spark.read.option("basePath", store).parquet(store)
    last = history.agg(F.max("batch")).first()[0]
    (newest(history).withColumn("bucket", _bucket(buckets)).hint("rebalance", "bucket").write.partitionBy("bucket")
     .parquet(f"{target}/batch={int(last):012d}"))


def run(stream: DataFrame, store: str, out: str, checkpoint: str, derive=None, available_now: bool = True, buckets: int = BUCKETS):
    """Start the query; with ``available_now`` it stops when all present input is handled."""
    writer = (stream.writeStream.option("checkpointLocation", checkpoint)
              .foreachBatch(lambda batch, batch_id: update_threads(batch, batch_id, store, out, derive, buckets)))
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def latest(spark: SparkSession, out: str) -> DataFrame | None:
    """Rows of the highest version of every thread."""
    return store_of.latest(spark, out)


def upsert_sink(stream: DataFrame, out: str, checkpoint: str, mode: str = "update", available_now: bool = True):
    """Write changed rows of an aggregating stream as versions; read them back with ``latest_rows``."""
    writer = (stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
              .foreachBatch(lambda batch, batch_id: store_of.append(batch, out, batch_id)))
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def latest_rows(spark: SparkSession, out: str, key: list[str]) -> DataFrame | None:
    """The newest version of each key."""
    return store_of.latest_rows(spark, out, key)
