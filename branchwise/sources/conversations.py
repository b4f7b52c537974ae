"""Turn-by-turn conversations as discussion threads.

The turns are linear, so they are folded into a tree (turn t answers turn (t-1) div 2) and get
labels, times and text marks by integer arithmetic. Both engines of a comparison can run ``MSG_SQL``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from branchwise.functions import text as tx
from branchwise.functions.labels import stance_name, veracity_name
from branchwise.session import spread

MSG_SQL = """
SELECT conv_id, turn,
       CASE WHEN turn = 0 THEN NULL ELSE CAST(FLOOR((turn - 1) / 2.0) AS BIGINT) END AS parent_turn,
       concat('m', CAST(conv_id AS STRING), '_', CAST(turn AS STRING)) AS msg_id,
       CAST((conv_id * 5 + turn * turn * 3 + turn) % 4 AS INT) AS sdqc,
       CASE WHEN turn > 0 THEN CAST((conv_id * 5 + CAST(FLOOR((turn - 1) / 2.0) AS BIGINT) * CAST(FLOOR((turn - 1) / 2.0) AS BIGINT) * 3
                                     + CAST(FLOOR((turn - 1) / 2.0) AS BIGINT)) % 4 AS INT) END AS parent_sdqc,
       CAST(conv_id % 3 AS INT) AS truth,
       1704067200 + conv_id * 86400 + turn * turn * 437 AS created_s,
       concat(text, CASE turn % 4
                      WHEN 0 THEN ' hvad mener du??'
                      WHEN 1 THEN ' se https://t.co/ab12 @bruger nu !!!'
                      WHEN 2 THEN ' no... JAVEL :)'
                      ELSE ' ikke fandens... ABC :(' END) AS text
FROM conversations
"""


def raw_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return spark.sql(MSG_SQL.replace("FROM conversations", "FROM {conversations}"), conversations=conversations)


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical messages; columns that a query does not use are pruned from the scan."""
    msg = raw_messages(spark, sf_dir)
    conv = F.col("conv_id").cast("string")
    masked = tx.mask_tweet(F.col("text"))
    return msg.select(
        F.lit("conversations").alias("corpus"),
        F.concat(F.lit("m"), conv, F.lit("_0")).alias("source_id"),
        "msg_id",
        F.when(F.col("turn") > 0, F.concat(F.lit("m"), conv, F.lit("_"), F.col("parent_turn").cast("string"))).alias("parent_id"),
        (F.col("turn") == 0).alias("is_source"),
        F.col("text").alias("text_raw"), masked.alias("text"), tx.word_tokens(masked).alias("tokens"),
        F.timestamp_seconds("created_s").alias("created"),
        stance_name(F.col("sdqc")).alias("sdqc"), stance_name(F.col("parent_sdqc")).alias("sdqc_parent"),
        veracity_name(F.col("truth")).alias("truth"))


def document_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(token, vector): the most frequent document tokens, in rank order, take the stored vectors."""
    from branchwise.operators.skew import rank_rows

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stored = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.col("embedding").alias("vector"))
    frequency = (tx.explode_terms(spread(docs.select("doc_id", "text"), "doc_id"), [], tx.word_tokens(F.col("text")), "token")
                 .groupBy("token").agg(F.count(F.lit(1)).alias("n")))
    ranked = rank_rows(frequency, [], [F.desc("n"), F.col("token")], "vec_id")
    return ranked.join(stored, "vec_id").select("token", "vector")
