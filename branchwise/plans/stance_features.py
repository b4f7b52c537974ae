"""Messages and branches to the stance feature table."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, functions as F

from branchwise.functions import labels, text as tx
from branchwise.operators import embed, lexicon as lx, tree
from branchwise.operators.normalise import normalise, value_ranges
from branchwise.operators.sequences import commenting_folds, not_only_commenting
from branchwise.session import durable

GROUPS = ["sdqc_parent", "text", "lexicon", "sentiment", "pos", "wembs", "token_wembs"]
BRANCH = ["source_id", "leaf_id"]
# Emission order of the text group; cap_ratio is derived from the normalised cap_count.
TEXT_ORDER = ["period", "e_mark", "q_mark", "has_trip_dot", "url_count", "trip_dot_count", "q_mark_count", "e_mark_count",
              "cap_ratio", "txt_len", "tokens_len", "avg_word_len", "cap_sequence_max_len"]


def build_members(messages: DataFrame, sub_sample: bool = False, **options) -> DataFrame:
    """Branch members in depth-first order; ``sub_sample`` drops branches of commenting labels only."""
    folds = commenting_folds() if sub_sample else None
    return tree.branch_members(messages, folds=folds, keep=not_only_commenting() if sub_sample else None,
                               index=True, **options)


def analysed(messages: DataFrame, members: DataFrame) -> DataFrame:
    """Every reply once, with the first branch it occurs in. The message before it is its parent."""
    first = tree.first_occurrence(members.select(*BRANCH, "branch_idx", "pos", "msg_id"),
                                  ["source_id", "branch_idx", "pos"])
    return first.join(messages.drop("source_id"), "msg_id").withColumn("prev_id", F.col("parent_id"))


def text_counts(rows: DataFrame, key: list[str]) -> DataFrame:
    """Flags and raw counts; one narrow scan over the texts."""
    t, k = F.col("text"), F.col("tokens")
    return rows.select(*key, *[c.alias(n) for n, c in {**tx.flags(t), **tx.counts(t, k)}.items()])


def with_cap_ratio(df: DataFrame, length: str) -> DataFrame:
    ratio = F.when(F.col(length) > 0, F.col("cap_count") / F.col(length)).otherwise(F.lit(0.0))
    return df.withColumn("cap_ratio", ratio)


def build_features(messages: DataFrame, members: DataFrame, groups: Iterable[str], lexicon: DataFrame | None = None,
                   sentiment: DataFrame | None = None, vectors: DataFrame | None = None, dim: int | None = None,
                   pos_tags: str | None = None, keep_missing: bool = False) -> DataFrame:
    """One row per message with the asked feature groups as columns.

    ``lexicon`` has (list, word) with the four lists of ``LEXICON_FEATURES``; ``sentiment`` (term,
    score); ``vectors`` (token, vector); ``pos_tags`` names an array column of ``messages``. With
    token_wembs, messages whose own or source matrix is empty are left out unless ``keep_missing``.
    """
    groups = set(groups)
    unknown = groups - set(GROUPS)
    if unknown:
        raise ValueError(f"unknown feature groups: {sorted(unknown)}")
    rows = durable(analysed(messages, members))
    key = ["msg_id"]
    out = rows.select("msg_id", *BRANCH, labels.stance_code(F.col("sdqc")).alias("stance"),
                      *([labels.stance_code(F.col("sdqc_parent")).alias("sdqc_parent")] if "sdqc_parent" in groups else []))

    numbers, scaled_cols = None, []
    if "text" in groups:
        numbers = text_counts(rows, key)
        scaled_cols += [c for c in tx.COUNT_FEATURES]
    tables, names = [], []
    if "lexicon" in groups:
        kinds = dict(zip(lx.LEXICON_FEATURES, ["token", "token", "word", "word"]))
        tables.append(lx.list_terms(lexicon, kinds).withColumn("score", F.col("score").cast("double")))
        names += lx.LEXICON_FEATURES
    if "sentiment" in groups:
        tables.append(sentiment.select(F.lit("token").alias("kind"), "term", F.lit("sentiment").alias("name"), F.col("score").cast("double").alias("score")))
        names += ["sentiment"]
    if names:  # one pass over the texts for all lists
        table = tables[0] if len(tables) == 1 else tables[0].unionByName(tables[1])
        sums = lx.term_sums(rows, key, {"token": F.col("tokens"), "word": tx.words(F.col("text"))}, table, names)
        numbers = lx.attach_counts(numbers if numbers is not None else rows.select(*key), sums, key, names)
        scaled_cols += names
    if numbers is not None:
        # Narrow numeric rows: needed for the ranges and again for scaling, so kept once.
        numbers = durable(numbers)
        scaled = normalise(numbers, value_ranges(numbers, scaled_cols), scaled_cols)
        if "text" in groups:
            scaled = scaled.join(numbers.select("msg_id", F.col("txt_len").alias("_len")), "msg_id")
            scaled = with_cap_ratio(scaled, "_len").drop("_len", "cap_count", "quote_count")
        out = out.join(scaled, key)
    if "pos" in groups:
        out = out.join(rows.select("msg_id", lx.pos_occurrence(F.col(pos_tags)).alias("pos_tags")), key)
    if groups & {"wembs", "token_wembs"}:
        everyone = durable(messages.select("msg_id", "source_id", "is_source", "tokens"))
        if "wembs" in groups:
            vecs = durable(embed.message_vectors(everyone, key, F.col("tokens"), vectors, dim))
            sims = embed.similarities(rows.select("msg_id", "prev_id", *BRANCH), members, vecs, BRANCH, dim).drop("source_id")
            average = vecs.select("msg_id", embed.average_vector(F.col("vsum"), F.col("n_tokens"), dim).alias("avg_vector"))
            out = out.join(sims, key).join(average, key)
        if "token_wembs" in groups:
            source = everyone.select(F.col("msg_id").alias("source_id"), F.col("tokens").alias("_source_tokens"))
            lists = out.join(everyone.select("msg_id", F.col("tokens").alias("_tokens")), key, "left").join(source, "source_id", "left")
            out = embed.token_matrices(lists, key, {"comment_matrix": "_tokens", "source_matrix": "_source_tokens"}, vectors)
            if not keep_missing:
                out = out.where("comment_matrix is not null and source_matrix is not null")
    return out


def on_branches(features: DataFrame, members: DataFrame) -> DataFrame:
    """Features of every member of every branch, repeats kept; messages without features are skipped."""
    own = features.drop(*[c for c in features.columns if c in members.columns and c != "msg_id"])
    return members.join(own, "msg_id")
