"""Thread folders: ``threads/<lang>/<rumour>/<id>/{source-tweets,reactions}/*.json`` with
``structure.json`` and ``annotation.json`` beside them, stance labels in ``annotations/<lang>-*.json``
and claim labels in ``rumour_overview.txt``."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from branchwise.functions.labels import (RESPONSE_TO_STANCE, lookup, or_unspecified, threads_veracity,
                                         veracity_name)
from branchwise.schema import STANCE_ANNOTATION, TWEET, struct, S
from branchwise.session import durable
from branchwise.sources.files import texts
from branchwise.sources.tweets import tweet_columns


def _from_path(depth: int):
    return F.element_at(F.split("path", "/"), -depth)


def stance_annotations(spark: SparkSession, base: str) -> DataFrame:
    """(msg_id, sdqc) of direct and deep replies. Only reply lines carry a response to the source,
    so section headings and source lines drop out by that field. Of a repeated id the last line counts,
    files in the order of their names."""
    lines = spark.read.text(f"{base}/annotations/*.json", wholetext=True).select(
        F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\n")).alias("line", "value"))
    a = F.from_json("value", STANCE_ANNOTATION)
    stance = lookup(F.col("a.`responsetype-vs-source`"), RESPONSE_TO_STANCE)
    return (lines.select("file", "line", a.alias("a")).where(F.col("a.`responsetype-vs-source`").isNotNull())
            .groupBy(F.col("a.tweetid").alias("msg_id"))
            .agg(F.max(F.struct("file", "line", stance.alias("sdqc"))).alias("_last")).select("msg_id", "_last.sdqc"))


def claim_overview(spark: SparkSession, path: str) -> DataFrame:
    """(source_id, veracity 0/1/2); a heading line has no code and drops out."""
    cols = F.split("value", "\t")
    return (spark.read.text(path).select(F.get(cols, F.lit(0)).alias("source_id"),
                                         F.expr("try_cast(get(split(value, '\t'), 1) as int)").alias("veracity"))
            .where("veracity is not null"))


def attach_claims(messages: DataFrame, overview: DataFrame, strict: bool = True) -> DataFrame:
    """Set ``truth`` of every source; with ``strict`` a source missing from the overview is an error."""
    known = overview.select("source_id", veracity_name(F.col("veracity")).alias("_truth"))
    if strict:
        lost = messages.where("is_source").join(known, "source_id", "left_anti").select("source_id").take(5)
        if lost:
            raise ValueError(f"sources without a claim label: {[r[0] for r in lost]}")
    return (messages.join(known, "source_id", "left")
            .withColumn("truth", F.when(F.col("is_source"), F.col("_truth"))).drop("_truth"))


def attach_stances(messages: DataFrame, annotations: DataFrame) -> DataFrame:
    """Stance labels by message id, ``Underspecified`` where there is none."""
    return (messages.drop("sdqc").join(annotations, "msg_id", "left")
            .withColumn("sdqc", or_unspecified(F.col("sdqc"))))


def _tweets(spark: SparkSession, base: str, folder: str) -> DataFrame:
    return (texts(spark, f"{base}/threads", f"*/*/*/{folder}/*.json").withColumn("tweet", F.from_json("value", TWEET))
            .select(F.struct(*[F.col("tweet")[n].alias(n) for n in TWEET.names]).alias("tweet"), _from_path(5).alias("lang_dir"),
                    _from_path(4).alias("event"), _from_path(3).alias("thread_id")))


def _walker():
    """A table function: the reply edges of one nested id map, in one walk over its text with a stack of its own, at any depth."""
    token = re.compile(r'"(?:[^"\\]|\\.)*"|[{}\[\],:]|[^\s"{}\[\],:]+')

    class Walk:
        def eval(self, value: str):
            open_nodes, last, root = [], None, None
            for m in token.finditer(value):
                mark = m[0]
                if mark == ":":
                    node = json.loads(last)
                    if len(open_nodes) == 1:
                        root = node
                    else:
                        yield root, open_nodes[-1], node
                    last = node
                elif mark == "{":
                    open_nodes.append(last)
                elif mark == "}":
                    if not open_nodes:
                        raise ValueError("a structure file closes more maps than it opens")
                    open_nodes.pop()
                elif mark[0] == '"':
                    last = mark
            if open_nodes or root is None:
                raise ValueError("a structure file is not a whole map of ids")

    return F.udtf(Walk, returnType="source_id string, parent_id string, msg_id string")


def structure_edges(spark: SparkSession, base: str) -> DataFrame:
    """(source_id, parent_id, msg_id) from the nested id maps, all files in one job however deep they are."""
    files = texts(spark, f"{base}/threads", "*/*/*/structure.json")
    edges = durable(files.lateralJoin(_walker()(F.col("value").outer())).select("source_id", "parent_id", "msg_id"))
    if not edges.take(1):
        raise ValueError(f"no reply is listed in any structure.json below {base}")
    return edges


def messages(spark: SparkSession, base: str, edges: str = "structure", strict: bool = True) -> DataFrame:
    """Canonical messages of all threads with stance and claim labels attached.

    Parents come from ``structure.json`` or, with ``edges="replies"``, from the reply pointers.
    """
    def rows(folder: str, is_source: bool) -> DataFrame:
        cols = tweet_columns(F.col("tweet"))
        none = F.lit(None).cast("string")
        return _tweets(spark, base, folder).select(
            F.lit("threads").alias("corpus"), "event", F.col("thread_id").alias("source_id"),
            F.col("tweet.id_str").alias("msg_id"),
            (none if is_source else F.coalesce("tweet.in_reply_to_status_id_str", "tweet.in_reply_to_status_id")).alias("parent_id"),
            F.lit(is_source).alias("is_source"), none.alias("title"),
            *[c.alias(n) for n, c in cols.items()],
            none.alias("sdqc"), none.alias("sdqc_parent"), F.lit(None).cast("boolean").alias("is_rumour"), none.alias("truth"))

    sources = rows("source-tweets", True)
    several = sources.groupBy("source_id").agg(F.count(F.lit(1)).alias("n")).where("n <> 1").take(5)
    if several:
        raise ValueError(f"threads without exactly one source: {[r[0] for r in several]}")
    replies = rows("reactions", False)
    if edges == "structure":
        links = structure_edges(spark, base).withColumnRenamed("parent_id", "_parent")
        replies = (replies.join(links, ["source_id", "msg_id"], "left")
                   .withColumn("parent_id", F.col("_parent")).drop("_parent"))
    everything = attach_stances(sources.unionByName(replies), stance_annotations(spark, base))
    return attach_claims(everything, claim_overview(spark, f"{base}/rumour_overview.txt"), strict)


def veracity_overview(spark: SparkSession, base: str) -> DataFrame:
    """(source_id, veracity) from the annotation files of all threads."""
    marks = texts(spark, f"{base}/threads", "*/*/*/annotation.json").select("path", F.from_json("value", struct(true=S, misinformation=S)).alias("a")).select("path", "a.*")
    return marks.select(_from_path(2).alias("source_id"),
                        threads_veracity(F.col("true"), F.col("misinformation")).alias("veracity"))
