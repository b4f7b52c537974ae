"""Writers. Parquet is the primary form; text forms keep the published layouts."""

from __future__ import annotations

import json
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from branchwise.functions.text import pair_text
from branchwise.operators import tree
from branchwise.operators.metrics import METRICS
from branchwise.operators.sequences import whole
from branchwise.sources.files import write_texts


def feature_table(features: DataFrame, path: str, columns: Sequence[str], fmt: str = "parquet", mode: str = "errorifexists",
                  compression: str = "none") -> None:
    """Message features, one row per msg_id; nested columns become JSON text in TSV, ``compression`` its codec."""
    out = features.select(F.col("msg_id").alias("id"), F.col("stance").alias("sdqc_submission"), *columns)
    if fmt == "parquet":
        out.write.mode(mode).parquet(path)
        return
    nested = {f.name for f in out.schema.fields if f.dataType.typeName() in ("array", "struct", "map")}
    out.select(*[F.to_json(c).alias(c) if c in nested else F.col(c) for c in out.columns]).write.mode(mode).csv(
        path, sep="\t", header=True, compression=compression)


def sequence_text(obs: Column, timestamps: bool) -> Column:
    pair = (lambda o: F.array(o["stance"].cast("double"), o["t"])) if timestamps else None
    return F.to_json(F.transform(obs, pair or (lambda o: F.array(o["stance"]))))


def sequence_table(seqs: DataFrame, path: str, timestamps: bool = False, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    if fmt == "parquet":
        seqs.write.mode(mode).parquet(path)
        return
    # One text line holds a whole branch; rows that name no branch are lines as they are.
    lines = whole(seqs) if {"part", "leaf_id"} <= set(seqs.columns) else seqs
    lines.select(F.col("veracity").alias("TruthStatus"), sequence_text(F.col("obs"), timestamps).alias("SDQC_Labels")).write.mode(
        mode).csv(path, sep="\t", header=True, quote="")


def annotation_tasks(messages: DataFrame, claims_path: str, stances_path: str, mode: str = "errorifexists") -> None:
    """JSON lines for annotators: the sources as claims, the replies as pairs with their source."""
    none = F.array().cast("array<string>").alias("labels")
    (messages.where("is_source").select(F.col("msg_id").alias("id_str"), F.col("text_raw").alias("text"), none)
     .write.mode(mode).json(claims_path))
    raw = messages.withColumn("text", F.col("text_raw"))
    (tree.source_reply_pairs(raw)
     .select(F.col("msg_id").alias("id_str"), pair_text(F.col("source_text"), F.col("text")).alias("text"), none)
     .write.mode(mode).json(stances_path))


def claim_overview(overview: DataFrame, path: str, mode: str = "errorifexists") -> None:
    overview.select(F.col("source_id").alias("IDs"), F.col("veracity").alias("Veracity")).write.mode(mode).csv(
        path, sep="\t", header=True)


def metric_rows(metrics: DataFrame, path: str, with_length: bool = False, timestamps: bool = False) -> None:
    """Append evaluation rows. With ``timestamps`` the model gets ``_ts`` and baselines are left out."""
    out = metrics
    if timestamps:
        out = out.where(~F.contains(F.col("model"), F.lit("majority"))).withColumn("model", F.concat("model", F.lit("_ts")))
    lead = ["model"] + (["length"] if with_length else []) + [
        "unverified_cast", "remove_commenting", "testdata_type", "model_type", "comp_count"]
    out.select(*lead, *[F.format_string("%.3f", F.col(c)).alias(c) for c in METRICS]).write.mode("append").csv(
        path, sep=";", header=True)


def epoch_rows(epochs: DataFrame, path: str) -> None:
    epochs.write.mode("append").parquet(path)


def flagged_claims(predictions: DataFrame, path: str, mode: str = "append") -> None:
    """Structured rows: source, branch, claim label, stance labels and claim text."""
    predictions.write.mode(mode).parquet(path)


def _nested(rows: pd.DataFrame) -> pd.DataFrame:
    """The structure file of one thread: its id map, written from the leaves up without recursion."""
    source = rows["source_id"].iat[0]
    children: dict[str, list[str]] = {}
    for parent, child in rows.sort_values(["ord", "msg_id"])[["parent_id", "msg_id"]].itertuples(index=False):
        children.setdefault(parent, []).append(child)
    out, todo = [], [(source, "")]
    while todo:
        node, after = todo.pop()
        if node is None:
            out.append(after)
            continue
        below = children.get(node, [])
        out.append(json.dumps(node) + (": {" if below else ": []"))
        todo.append((None, ("}" if below else "") + after))
        todo.extend((c, ", " if i else "") for i, c in enumerate(reversed(below)))
    return pd.DataFrame({"path": [f"{source}/structure.json"], "value": ["{" + "".join(out) + "}"]})


def thread_folders(messages: DataFrame, base: str, lang: str = "en") -> None:
    """Threads in the folder layout of ``sources.threads``: a file per tweet, the nested ids, the marks of the claim; stance lines and claim codes beside them.

    ``messages`` has source_id, msg_id, parent_id, is_source, text_raw, created, sdqc, truth and ``ord``, the place among siblings.
    """
    from branchwise.functions.labels import RESPONSE_TO_STANCE, veracity_code

    folder = F.when(F.col("is_source"), "source-tweets").otherwise("reactions")
    tweet = F.to_json(F.struct(F.col("msg_id").alias("id_str"), F.col("text_raw").alias("full_text"), F.col("parent_id").alias("in_reply_to_status_id_str"),
                               F.date_format("created", "EEE MMM dd HH:mm:ss +0000 yyyy").alias("created_at")))
    tweets = messages.select(F.concat_ws("/", "source_id", folder, F.concat("msg_id", F.lit(".json"))).alias("path"), tweet.alias("value"))
    maps = (messages.where("not is_source").select("source_id", "parent_id", "msg_id", "ord")
            .groupBy("source_id").applyInPandas(lambda rows: _nested(rows), "path string, value string"))
    sources = messages.where("is_source")
    mark = lambda name: F.when(F.col("truth") == name, "1")
    marks = sources.select(F.concat("source_id", F.lit("/annotation.json")).alias("path"), F.to_json(F.struct(
        F.lit("rumour").alias("is_rumour"), mark("True").alias("true"), mark("False").alias("misinformation"))).alias("value"))
    write_texts(tweets.unionByName(maps).unionByName(marks), f"{base}/threads/{lang}/all")
    response = F.create_map(*[F.lit(x) for code, name in RESPONSE_TO_STANCE.items() for x in (name, code)])
    messages.where("not is_source and sdqc <> 'Underspecified'").select(F.to_json(F.struct(
        F.col("msg_id").alias("tweetid"), response[F.col("sdqc")].alias("responsetype-vs-source"))).alias("value")).write.text(f"{base}/annotations/{lang}.json")
    claim_overview(sources.select("source_id", veracity_code(F.col("truth")).alias("veracity")), f"{base}/rumour_overview.txt")
