"""Message streams: sources, removal of repeats, and activity windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType


def file_stream(spark: SparkSession, path: str, schema: StructType, fmt: str = "json", name_filter: str | None = None,
                files_per_batch: int | None = None) -> DataFrame:
    """New files of a folder as a stream, schema declared."""
    reader = spark.readStream.schema(schema)
    if name_filter:
        reader = reader.option("pathGlobFilter", name_filter)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.format(fmt).load(path)


def without_repeats(stream: DataFrame, time: str, key: Sequence[str], delay: str) -> DataFrame:
    """Drop messages seen before, remembering keys only for the watermark delay."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(key))


def activity(df: DataFrame, time: str, by: Sequence[str], width: str, slide: str | None = None, delay: str | None = None) -> DataFrame:
    """Rows per window and key, for a table or a stream; partial counts precede the shuffle."""
    if delay and df.isStreaming:
        df = df.withWatermark(time, delay)
    window = F.window(time, width, slide) if slide else F.window(time, width)
    return (df.groupBy(window.alias("w"), *by).agg(F.count(F.lit(1)).alias("n"))
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by, "n"))


def sessions(df: DataFrame, time: str, by: Sequence[str], gap: str, delay: str | None = None) -> DataFrame:
    """Bursts of activity per key that end after a quiet gap."""
    if delay and df.isStreaming:
        df = df.withWatermark(time, delay)
    return (df.groupBy(F.session_window(time, gap).alias("w"), *by).agg(F.count(F.lit(1)).alias("n"))
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by, "n"))
