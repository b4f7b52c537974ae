"""Tweet threads: one line per thread, ``root_id <tab> {id: tweet, …}``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from branchwise.functions import text as tx, times
from branchwise.schema import TWEET, UNSPECIFIED


def scan(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """One row per tweet: root_id, tweet_id, tweet. A thread whose line can't be read is an error, or left out
    without ``strict``."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    pair = lines.select(F.split("value", "\t", 2).alias("p"))
    tweets = F.from_json(F.col("p")[1], T.MapType(T.StringType(), TWEET))
    if strict:
        bad = pair.where(tweets.isNull()).select(F.col("p")[0]).take(5)
        if bad:
            raise ValueError(f"threads that are not a map of tweets: {[r[0] for r in bad]}")
    return pair.select(F.col("p")[0].alias("root_id"), F.explode(tweets).alias("tweet_id", "tweet"))


def tweet_columns(tweet: Column) -> dict[str, Column]:
    """Canonical message columns of one tweet."""
    raw = F.coalesce(tweet["full_text"], tweet["text"])
    masked = tx.mask_tweet(raw)
    return {
        "text_raw": raw, "text": masked, "tokens": tx.tweet_tokens(masked),
        "created": times.tweet_time(tweet["created_at"]),
        "lang": tweet["lang"],
    }


def messages(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Canonical messages. ``children`` lists give parents and order; a tweet that no list names
    falls back to its own reply pointer and comes after its listed siblings. Of several lists that name it
    the one it stands first in counts, then that of the smaller parent id."""
    rows = scan(spark, path, strict)
    listed = (rows.select("root_id", F.col("tweet_id").alias("listed_parent"), F.posexplode("tweet.children").alias("ord", "tweet_id"))
              .groupBy("root_id", "tweet_id").agg(F.min(F.struct("ord", "listed_parent")).alias("_l"))
              .select("root_id", "tweet_id", "_l.ord", "_l.listed_parent"))
    pointer = F.coalesce("tweet.in_reply_to_status_id_str", "tweet.in_reply_to_status_id")
    is_source = F.col("tweet_id") == F.col("root_id")
    label = lambda c: F.coalesce(F.col(f"tweet.{c}"), F.lit(UNSPECIFIED))
    cols = tweet_columns(F.col("tweet"))
    return rows.join(listed, ["root_id", "tweet_id"], "left").select(
        F.lit("twitter").alias("corpus"), F.lit(None).cast("string").alias("event"),
        F.col("root_id").alias("source_id"), F.col("tweet_id").alias("msg_id"),
        F.when(~is_source, F.coalesce("listed_parent", pointer)).alias("parent_id"),
        is_source.alias("is_source"), F.lit(None).cast("string").alias("title"),
        *[c.alias(n) for n, c in cols.items()],
        F.when(is_source, label("SourceSDQC")).otherwise(label("SDQC_Submission")).alias("sdqc"),
        label("SDQC_Parent").alias("sdqc_parent"), F.lit(None).cast("boolean").alias("is_rumour"),
        F.when(is_source, F.col("tweet.TruthStatus")).alias("truth"),
        F.coalesce("ord", F.lit(2147483647)).alias("ord"),
        F.transform("tweet.entities.hashtags", lambda h: h["text"]).alias("hashtags"),
        F.get("tweet.coordinates.coordinates", F.lit(1)).alias("lat"), F.get("tweet.coordinates.coordinates", F.lit(0)).alias("lon"),
        (F.col("tweet.retweeted_status.id_str").isNotNull() | F.startswith(F.coalesce("tweet.full_text", "tweet.text", F.lit("")), F.lit("RT @"))).alias("is_retweet"))
