"""Reddit threads: one JSON document per thread below ``<event>/<submission_id>.json``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from branchwise.functions import text as tx, times
from branchwise.functions.labels import source_stance
from branchwise.operators.tree import first_occurrence
from branchwise.schema import REDDIT_THREAD
from branchwise.sources.files import texts


def scan(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Raw documents with the event taken from the folder name. A file without a submission is an error, or left
    out without ``strict``."""
    raw = (texts(spark, path, "*/*.json").select("path", F.from_json("value", REDDIT_THREAD).alias("d"), F.element_at(F.split("path", "/"), -2).alias("event"))
           .select("path", "event", *[F.col("d")[n].alias(n) for n in REDDIT_THREAD.names]))
    if strict:
        bad = raw.where("redditSubmission.submission_id is null").select("path").take(5)
        if bad:
            raise ValueError(f"files without a submission: {[r[0] for r in bad]}")
    return raw.drop("path").where("redditSubmission.submission_id is not null")


def _source_rows(raw: DataFrame, quotes: bool) -> DataFrame:
    sub = lambda c: F.col(f"redditSubmission.{c}")
    title = sub("title")
    return raw.select(
        F.lit("reddit").alias("corpus"), "event", sub("submission_id").alias("source_id"),
        sub("submission_id").alias("msg_id"), F.lit(None).cast("string").alias("parent_id"),
        F.lit(True).alias("is_source"), title.alias("title"), sub("text").alias("text_raw"),
        tx.title_fallback(tx.mask_reddit(sub("text"), quotes), title).alias("text"),
        tx.reddit_tokens(title).alias("tokens"), times.reddit_time(sub("created")).alias("created"),
        source_stance(sub("SourceSDQC")).alias("sdqc"), F.lit(None).cast("string").alias("sdqc_parent"),
        sub("IsRumour").alias("is_rumour"), sub("TruthStatus").alias("truth"),
        F.lit(-1).cast("long").alias("ord"))


def _member_rows(raw: DataFrame) -> DataFrame:
    one = raw.select("event", F.col("redditSubmission.submission_id").alias("source_id"),
                     F.posexplode("branches").alias("branch_idx", "branch"))
    return one.select(
        "event", "source_id", F.col("branch_idx").cast("long").alias("branch_idx"),
        F.size("branch").cast("long").alias("branch_len"),
        F.element_at("branch", -1)["comment"]["comment_id"].alias("leaf_id"),
        F.posexplode("branch").alias("pos", "member"))


def _comment_rows(raw: DataFrame, quotes: bool) -> DataFrame:
    c: Column = F.col("member.comment")
    rows = _member_rows(raw).select("source_id", "branch_idx", "pos", "event", c["comment_id"].alias("msg_id"), c.alias("c"))
    first = first_occurrence(rows, ["source_id", "branch_idx", "pos"])
    text = tx.mask_reddit(F.col("c.text"), quotes)
    none = F.lit(None).cast("string")
    return first.select(
        F.lit("reddit").alias("corpus"), "event", "source_id", "msg_id", F.col("c.parent_id").alias("parent_id"),
        F.lit(False).alias("is_source"), none.alias("title"), F.col("c.text").alias("text_raw"), text.alias("text"),
        tx.reddit_tokens(text).alias("tokens"), times.reddit_time(F.col("c.created")).alias("created"),
        F.col("c.SDQC_Submission").alias("sdqc"), F.col("c.SDQC_Parent").alias("sdqc_parent"),
        F.lit(None).cast("boolean").alias("is_rumour"), none.alias("truth"), F.col("branch_idx").alias("ord"))


def messages(spark: SparkSession, path: str, quotes: bool = True, strict: bool = True) -> DataFrame:
    """Canonical messages; a comment listed in several branches appears once. ``ord`` is the first branch it is listed in,
    so siblings, and with them branches, keep the order of the file."""
    raw = scan(spark, path, strict)
    return _source_rows(raw, quotes).unionByName(_comment_rows(raw, quotes))


def members(spark: SparkSession, path: str) -> DataFrame:
    """Branch members as listed in the files, branches numbered in file order."""
    return _member_rows(scan(spark, path)).select(
        "source_id", "leaf_id", "branch_idx", F.col("pos").cast("long").alias("pos"), "branch_len",
        F.col("member.comment.comment_id").alias("msg_id"))
