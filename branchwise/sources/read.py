"""One entry point for all message formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from branchwise.functions.text import pair_text
from branchwise.operators.tree import source_reply_pairs
from branchwise.sources import conversations, reddit, threads, tweets

FORMATS = {
    "reddit": reddit.messages,
    "twitter": tweets.messages,
    "threads": threads.messages,
    "conversations": conversations.messages,
    "parquet": lambda spark, path: spark.read.parquet(path),
}


def read_messages(spark: SparkSession, path: str, fmt: str, **options) -> DataFrame:
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt}; choose one of {sorted(FORMATS)}")
    return FORMATS[fmt](spark, path, **options)


def annotation_data(messages: DataFrame, kind: str) -> DataFrame:
    """Rows to annotate: ``claim`` gives the sources, ``stance`` the (source, reply) pairs."""
    if kind == "claim":
        return messages.where("is_source").select("source_id", "text")
    if kind == "stance":
        return source_reply_pairs(messages).withColumn("text", pair_text(F.col("source_text"), F.col("text"))).select(
            "source_id", "msg_id", "text")
    raise ValueError(f"kind must be claim or stance, got {kind}")
