"""Threads handed on once they have been quiet, with a state store.

Messages wait in keyed state until nothing has arrived for their key during a gap; a timer then hands them on together and empties the state. A
message that comes later opens the key again and is handed on after the next gap. So a burst of replies costs one new version of its
thread instead of one per batch, and state holds only what hasn't been handed on. The key is the thread and a hash of the message
modulo ``splits``: a thread with a third of all messages is spread over as many keys, which fall quiet one by one.

Time is the time of arrival: a reply that was written long ago isn't late, it only arrives late. Of several copies of a message that wait
together the one that arrived last is handed on.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from branchwise.streaming import threads

SPLITS = 16
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _processor(gap_ms: int) -> StatefulProcessor:
    class Quiet(StatefulProcessor):
        """State of a key: its waiting messages (as JSON, by id, with their arrival) and the time its timer is set to."""

        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.waiting = handle.getMapState("waiting", "msg_id string", "arrived long, message string")
            self.due = handle.getValueState("due", "at long")

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            last = 0
            for batch in rows:
                for msg_id, arrived, message in zip(batch["msg_id"], batch["arrived_ms"], batch["message"]):
                    known = self.waiting.getValue((msg_id,)) if self.waiting.containsKey((msg_id,)) else None
                    # copies of one arrival: the larger one, so that a run over the same files gives the same
                    if known is None or (int(arrived), message) >= (known[0], known[1]):
                        self.waiting.updateValue((msg_id,), (int(arrived), message))
                    last = max(last, int(arrived))
            before = self.due.get()[0] if self.due.exists() else None
            if before is None or last + gap_ms > before:
                if before is not None:
                    self.handle.deleteTimer(before)
                self.due.update((last + gap_ms,))
                self.handle.registerTimer(last + gap_ms)
            return iter([pd.DataFrame({"message": pd.Series([], dtype=str)})])

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            found = [value[1] for _, value in self.waiting.iterator()]
            self.waiting.clear()
            self.due.clear()
            yield pd.DataFrame({"message": found})

        def close(self) -> None:
            pass

    return Quiet()


def quiet_messages(stream: DataFrame, arrived: str, gap_seconds: int, delay: str = "0 seconds", splits: int = SPLITS) -> DataFrame:
    """The messages of ``stream`` (source_id, msg_id, …), each handed on when its key has been quiet for the gap after the arrival ``arrived``."""
    columns = [c for c in stream.columns if c != arrived]
    schema = stream.select(*columns).schema
    keyed = (stream.withWatermark(arrived, delay)
             .withColumn("split", F.pmod(F.xxhash64("msg_id"), F.lit(splits)))
             .select(arrived, "source_id", "split", "msg_id", F.unix_millis(arrived).alias("arrived_ms"), F.to_json(F.struct(*columns)).alias("message")))
    handed = keyed.groupBy("source_id", "split").transformWithStateInPandas(
        _processor(gap_seconds * 1000), "message string", "Append", "eventTime")
    return handed.select(F.from_json("message", schema).alias("m")).select("m.*")


def run(stream: DataFrame, arrived: str, gap_seconds: int, store: str, out: str, checkpoint: str, derive=None, available_now: bool = True,
        splits: int = SPLITS, buckets: int = threads.BUCKETS):
    """``threads.run`` over the messages of quiet keys. State needs the RocksDB store, which is set for this query only."""
    spark: SparkSession = stream.sparkSession
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, ROCKSDB)
    try:
        return threads.run(quiet_messages(stream, arrived, gap_seconds, splits=splits), store, out, checkpoint, derive, available_now, buckets)
    finally:
        spark.conf.set(name, before)
