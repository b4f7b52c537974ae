"""Whole jobs, from a path to a table, as a user starts them."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from branchwise.functions import labels as lb
from branchwise.models import hmm
from branchwise.operators import agreement as ag, sequences as sq, tree
from branchwise.plans import claims, stance_features as sf
from branchwise.session import configure, durable
from branchwise.sources import sinks
from branchwise.sources.read import read_messages
from branchwise.streaming import threads as live


def stance_table(spark: SparkSession, path: str, fmt: str, groups: Iterable[str], sub_sample: bool = False,
                 out: str | None = None, out_format: str = "parquet", **inputs) -> tuple[DataFrame, DataFrame]:
    """(features per message, branch members) of a corpus, written to ``out`` if given."""
    messages = durable(read_messages(configure(spark), path, fmt))
    members = durable(sf.build_members(messages, sub_sample))
    features = sf.build_features(messages, members, groups, **inputs)
    if out:
        columns = [c for c in features.columns if c not in ("msg_id", "source_id", "leaf_id", "stance")]
        sinks.feature_table(features, out, columns, out_format)
    return features, members


def claim_table(spark: SparkSession, path: str, fmt: str, timestamps: bool = True, skip_first: bool = False,
                rumours_only: bool = False, out: str | None = None, out_format: str = "parquet") -> DataFrame:
    """Label sequences of a corpus with their claim classes, written to ``out`` if given."""
    messages = durable(read_messages(configure(spark), path, fmt))
    if rumours_only:
        rumours = messages.where("is_source and is_rumour").select("source_id")
        messages = messages.join(rumours, "source_id", "left_semi")
    seqs = durable(sq.from_messages(messages, timestamps=timestamps, skip_first=skip_first))
    if out:
        sinks.sequence_table(seqs, out, timestamps, out_format)
    return seqs


def integrate_export(messages: DataFrame, export: DataFrame, item: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Stance labels of an annotation export (item_id, user, label) on the messages whose ``item`` column names the item.

    Gives the messages (those without an agreed, readable label as they were), the annotations of disputed items, and
    agreed items whose labels break the scheme with the rule they break.
    """
    agreed, disputed = ag.split_by_agreement(export.select("item_id", "user", "label"), ["item_id"])
    decoded = agreed.select("item_id", *[c.alias(n) for n, c in lb.decode_stance(F.col("labels").cast("array<int>")).items()])
    given = decoded.where("label_error is null").select(F.col("item_id").alias(item), "item_id", "sdqc")
    return ag.integrate(messages, given, [item], ["sdqc"]), disputed, decoded.where("label_error is not null").select("item_id", "label_error")


def predict_stored(spark: SparkSession, path: str, fmt: str, vectors: DataFrame, dim: int, stance_model,
                   models: Sequence[hmm.Hmm]) -> DataFrame:
    """Claim predictions for all threads of a stored corpus."""
    return claims.predict_claims(durable(read_messages(configure(spark), path, fmt)), vectors, dim, stance_model, models)


def predict_thread(messages: DataFrame, msg_id: str, vectors: DataFrame, dim: int, stance_model,
                   models: Sequence[hmm.Hmm]) -> DataFrame:
    """Claim predictions for the one thread that holds ``msg_id``."""
    own = messages.where(messages.msg_id == msg_id).select("source_id")
    return claims.predict_claims(durable(messages.join(own, "source_id", "left_semi")), vectors, dim, stance_model, models)


def live_claims(stream: DataFrame, base: str, models: Sequence[hmm.Hmm], predict=None, available_now: bool = True):
    """Judge the branches of every thread a stream touches; read them with ``streaming.threads.latest``.

    ``predict`` maps messages to (msg_id, predicted stance); without it the labels of the messages are used.
    """
    def derive(messages: DataFrame) -> DataFrame:
        messages = durable(messages)
        members = tree.branch_members(messages, folds=sq.time_folds())
        if predict is None:
            seqs = sq.sequences(sq.observations(members, messages), messages.where("is_source"), sf.BRANCH)
        else:
            seqs = claims.claim_sequences(messages, predict(messages), members)
        return claims.judge(durable(seqs), models, messages)

    return live.run(stream, f"{base}/store", f"{base}/claims", f"{base}/checkpoint", derive, available_now)
