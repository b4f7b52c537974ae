"""From messages to claim labels: stance per message, sequence per branch, truth per claim."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from branchwise.functions.labels import stance_name, veracity_name
from branchwise.models import hmm, stance
from branchwise.operators import sequences as sq, tree
from branchwise.plans.stance_features import BRANCH, analysed
from branchwise.session import durable


def claim_sequences(messages: DataFrame, predicted: DataFrame, members: DataFrame) -> DataFrame:
    """Sequences over predicted stances; members without a prediction are skipped, so the labels
    stay aligned with their messages."""
    facts = messages.select("msg_id", "created").join(
        predicted.select("msg_id", stance_name(F.col("predicted")).alias("sdqc")), "msg_id")
    observed = sq.observations(members, facts)
    return sq.sequences(observed, messages.where("is_source"), BRANCH)


def judge(seqs: DataFrame, models: Sequence[hmm.Hmm], messages: DataFrame) -> DataFrame:
    """One row per branch: source_id, leaf_id, veracity (name), claim."""
    best = hmm.score(seqs, models, BRANCH).select(*BRANCH, veracity_name(hmm.best_label(F.col("lls"))).alias("veracity"))
    claims = messages.where("is_source").select("source_id", F.col("text").alias("claim"))
    return best.join(claims, "source_id")


def stance_lists(seqs: DataFrame) -> DataFrame:
    """Stance names per branch, in order."""
    return sq.whole(seqs).select(*BRANCH, F.transform("obs", lambda o: stance_name(o["stance"])).alias("stances"))


def predict_claims(messages: DataFrame, vectors: DataFrame, dim: int, stance_model, models: Sequence[hmm.Hmm]) -> DataFrame:
    """Whole path for stored or newly collected threads: source_id, leaf_id, veracity, stances, claim."""
    members = durable(tree.branch_members(messages, folds=sq.time_folds(), index=True))
    context = durable(analysed(messages, members)).select("msg_id", "prev_id", *BRANCH)
    features = stance.vector_features(messages, context, members, vectors, dim, BRANCH)
    seqs = durable(claim_sequences(messages, stance.predict(features, stance_model), members))
    return judge(seqs, models, messages).join(stance_lists(seqs), BRANCH)


def flagged(predictions: DataFrame, label: str = "False") -> DataFrame:
    """Branches whose claim is judged to be ``label``."""
    return predictions.where(F.col("veracity") == label)
