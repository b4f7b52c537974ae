"""All registered queries over the driver tables. Each takes (spark, sf_dir) and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from branchwise.functions import labels as lb, text as tx, times
from branchwise.functions.vectors import cosine, dot
from branchwise.models import epochs, hmm, majority, stance, word_vectors
from branchwise.operators import agreement as ag, embed, intervals as iv, lexicon as lx, merge, metrics as mt, neighbours, sequences as sq, splits, tree
from branchwise.operators.normalise import normalise, value_ranges, value_ranges_in_order
from branchwise.operators.skew import prefix_sum, rank_rows
from branchwise.plans import claims, evaluation, run
from branchwise.plans import stance_features as sf
from branchwise.session import configure, durable, scratch_path, spread
from branchwise.sources import buckets, conversations as cv, files, sinks, store, tables
from branchwise.sources import threads as threads_of
from branchwise.sources.read import annotation_data, read_messages
from branchwise.streaming import activity as st, quiet, threads as live

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
DIM = 64
BRANCH = ["source_id", "leaf_id"]
STORE_BUCKETS = 8

# Small word lists that stand in for a user's own.
LEXICON = [("swear_count", "fandens"), ("swear_count", "lort"), ("negation_count", "ikke"), ("negation_count", "nej"),
           ("positive_smiley_count", ":)"), ("negative_smiley_count", ":(")]
SENTIMENT = [("javel", 2), ("fandens", -3), ("ikke", -1)]

# Fixed two-state models for the scoring queries.
START = np.array([0.6, 0.4])
TRANS = np.array([[0.7, 0.3], [0.4, 0.6]])
EMISSION = [[[.1, .2, .3, .4], [.4, .3, .2, .1]], [[.25, .25, .25, .25], [.1, .4, .4, .1]], [[.4, .1, .1, .4], [.2, .3, .3, .2]]]
MEANS = [[[0.5, 0.1], [2.5, 0.3]], [[1.0, 0.0], [2.0, 0.4]], [[1.5, 0.2], [3.0, 0.5]]]
VARIANCES = [[[1.0, 0.5], [0.8, 0.4]], [[0.7, 0.3], [1.2, 0.6]], [[1.5, 0.5], [0.5, 0.5]]]


def discrete_models() -> list[hmm.Hmm]:
    return [hmm.Hmm(c, START, TRANS, emission=np.array(EMISSION[c])) for c in range(3)]


def gaussian_models() -> list[hmm.Hmm]:
    return [hmm.Hmm(c, START, TRANS, mean=np.array(MEANS[c]), var=np.array(VARIANCES[c])) for c in range(3)]


def query(function):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return function(configure(spark), sf_dir)
    run.__name__ = function.__name__
    run.__doc__ = function.__doc__
    QUERIES["q_" + function.__name__] = run
    return run


def _messages(spark, sf_dir) -> DataFrame:
    return cv.messages(spark, sf_dir)


def _documents(spark, sf_dir) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _texts(spark, sf_dir) -> DataFrame:
    """Documents for work on their texts, spread over the cores."""
    return spread(_documents(spark, sf_dir).select("doc_id", "text"), "doc_id")


def _events(spark, sf_dir) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def _lexicon(spark) -> DataFrame:
    return spark.createDataFrame(LEXICON, "list string, word string")


def _sentiment(spark) -> DataFrame:
    return spark.createDataFrame(SENTIMENT, "term string, score long")


def _long(*columns: str):
    return [F.col(c).cast("long").alias(c) for c in columns]


def _checksum(vector):
    """Position-weighted sum of all components."""
    return F.aggregate(F.transform(vector, lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0), lambda a, x: a + x)


def _matrix_columns():
    """Rows and position-weighted sums of the two matrices of a reply."""
    total = lambda c: F.aggregate(F.transform(c, lambda row, i: _checksum(row) * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return [x for c in ("comment", "source") for x in (F.size(f"{c}_matrix").cast("long").alias(f"n_{c}"), F.round(total(f"{c}_matrix"), 3).alias(f"{c}_checksum"))]


# --- trees ------------------------------------------------------------------------------------

@query
def thread_summary(spark, d):
    """Per thread: branches, longest branch and stance counts of its replies."""
    m = _messages(spark, d).select("source_id", "msg_id", "parent_id", "is_source", "sdqc", "truth")
    per_branch = (tree.branches(m).groupBy("source_id")
                  .agg(F.count(F.lit(1)).alias("n_branches"), F.max("branch_len").alias("longest")))
    count = lambda s: F.sum(((F.col("sdqc") == s) & ~F.col("is_source")).cast("long"))
    per_thread = m.groupBy("source_id").agg(
        F.max("truth").alias("truth"), count("Supporting").alias("n_support"), count("Denying").alias("n_deny"),
        count("Querying").alias("n_query"), count("Commenting").alias("n_comment"))
    return per_thread.join(per_branch, "source_id", "left").select(
        "source_id", "truth", F.coalesce("n_branches", F.lit(0).cast("long")).alias("n_branches"),
        F.coalesce("longest", F.lit(0).cast("long")).alias("longest"), "n_support", "n_deny", "n_query", "n_comment")


@query
def branches(spark, d):
    return tree.indexed_branches(_messages(spark, d)).select(*BRANCH, "branch_idx", "branch_len")


@query
def branch_members(spark, d):
    return tree.branch_members(_messages(spark, d), index=True).select("source_id", "branch_idx", "pos", "branch_len", "msg_id")


@query
def roots(spark, d):
    return tree.roots(_messages(spark, d).select("msg_id", "parent_id")).select("msg_id", "root_id", "depth", "complete")


@query
def children(spark, d):
    return tree.children(_messages(spark, d)).select("parent_id", *_long("ord"), "child_id")


def _labels(spark, d) -> DataFrame:
    """Intervals of all messages with their stance."""
    m = durable(_messages(spark, d).select("source_id", "msg_id", "parent_id", "is_source", "created", "sdqc"))
    return durable(iv.intervals(m).join(m.select("source_id", "msg_id", "sdqc"), ["source_id", "msg_id"]))


@query
def subtree(spark, d):
    """Place of every message in the walk of its thread, and the denials in the part of the thread below it."""
    return iv.sums_below(_labels(spark, d), (F.col("sdqc") == "Denying").cast("long"), "n_denying").drop("sdqc")


@query
def subtree_members(spark, d):
    """The part of a thread below each denying message, with the distance to it."""
    labels = _labels(spark, d)
    return iv.members_below(labels, labels.where("sdqc = 'Denying'"))


@query
def thread_closure(spark, d):
    """Whole threads of all denying messages."""
    m = _messages(spark, d)
    deny = m.where("sdqc = 'Denying'").select("msg_id")
    return tree.thread_of(m, durable(tree.roots(m.select("msg_id", "parent_id"))), deny).select("root_id", "msg_id")


@query
def root_dedupe(spark, d):
    """Messages with at least two direct replies, each replaced by its root."""
    m = _messages(spark, d)
    popular = (m.where("parent_id is not null").groupBy(F.col("parent_id").alias("msg_id"))
               .agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select("msg_id"))
    return tree.distinct_roots(durable(tree.roots(m.select("msg_id", "parent_id"))), popular)


@query
def direct_replies(spark, d):
    return tree.direct_replies(_messages(spark, d)).select("source_id", "msg_id", "is_source")


@query
def popular_threads(spark, d):
    """Messages of threads with at least five replies."""
    return tree.select_threads(_messages(spark, d), min_replies=5).select("source_id", "msg_id")


@query
def reply_totals(spark, d):
    """Replies per thread and the running total over threads."""
    counts = tree.reply_counts(_messages(spark, d))
    return (prefix_sum(durable(counts), [], [F.col("source_id")], F.col("replies"), "before")
            .select("source_id", *_long("replies"), (F.col("before") + F.col("replies")).cast("long").alias("running")))


@query
def previous_and_source(spark, d):
    m = _messages(spark, d)
    return tree.previous_and_source(tree.branch_members(m), m).select(*BRANCH, "pos", "msg_id", "prev_id")


@query
def first_occurrence(spark, d):
    members = tree.branch_members(_messages(spark, d), index=True)
    return tree.first_occurrence(members.select("source_id", "branch_idx", "pos", "msg_id"), ["source_id", "branch_idx", "pos"])


@query
def unplaced(spark, d):
    """Replies that lose their thread once all denying replies are deleted."""
    return tree.unplaced(_messages(spark, d).where("is_source or sdqc <> 'Denying'"))


@query
def branch_tokens(spark, d):
    """Token pool of every branch: the tokens of its members in order, pooled by ``sq.PART`` members first."""
    m = _messages(spark, d)
    rows = tree.branch_members(m, index=True).join(m.select("msg_id", "tokens"), "msg_id")
    pool = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", "tokens"))), lambda x: x["tokens"]))
    parts = rows.groupBy("source_id", "branch_idx", F.floor(F.col("pos") / sq.PART).alias("_part")).agg(pool.alias("pool"))
    whole = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_part", "pool"))), lambda x: x["pool"]))
    pools = parts.groupBy("source_id", "branch_idx").agg(whole.alias("pool"))
    return pools.select("source_id", "branch_idx", F.size("pool").cast("long").alias("n_tokens"), F.array_join("pool", " ").alias("pool"))


@query
def drop_commenting_branches(spark, d):
    return tree.branches(_messages(spark, d), sq.commenting_folds()).where(sq.not_only_commenting()).select(
        *BRANCH, "branch_len", "n_commenting")


@query
def length_buckets(spark, d):
    return (tree.branches(_messages(spark, d)).groupBy(tree.length_bucket(F.col("branch_len")).cast("long").alias("bucket"))
            .agg(F.count(F.lit(1)).alias("n")))


@query
def data_size(spark, d):
    """Threads, messages, branches and branch members of the corpus."""
    m = _messages(spark, d)
    b = tree.branches(m).agg(F.count(F.lit(1)).alias("branches"), F.sum("branch_len").alias("members")).select(F.struct("*")).scalar()
    return m.agg(F.sum(F.col("is_source").cast("long")).alias("threads"), F.sum((~F.col("is_source")).cast("long")).alias("replies")).select(
        "threads", "replies", b["branches"].alias("branches"), b["members"].alias("members"))


@query
def source_reply_pairs(spark, d):
    return annotation_data(_messages(spark, d), "stance")


@query
def claims_to_label(spark, d):
    return annotation_data(_messages(spark, d), "claim")


# --- text -------------------------------------------------------------------------------------

@query
def mask_tweets(spark, d):
    m = _messages(spark, d)
    return m.select("msg_id", "text", tx.preview(F.col("text")).alias("preview"))


@query
def mask_reddit(spark, d):
    return _texts(spark, d).select("doc_id", tx.mask_reddit(F.col("text")).alias("text"))


@query
def tokens(spark, d):
    k = tx.word_tokens(F.col("text"))
    return _texts(spark, d).select("doc_id", F.size(k).cast("long").alias("n_tokens"), F.array_join(k, " ").alias("tokens"))


@query
def reddit_tokens(spark, d):
    k = tx.reddit_tokens(F.col("text"))
    return _texts(spark, d).select("doc_id", F.size(k).cast("long").alias("n_tokens"), F.array_join(k, " ").alias("tokens"))


@query
def tweet_tokens(spark, d):
    k = tx.tweet_tokens(F.col("text"))
    return _messages(spark, d).select("msg_id", F.size(k).cast("long").alias("n_tokens"), F.array_join(k, " ").alias("tokens"))


FLAGS_AND_COUNTS = [*tx.FLAG_FEATURES, *tx.COUNT_FEATURES]


def _numbers(df: DataFrame, key: str) -> DataFrame:
    counts = sf.text_counts(df, [key])
    return counts.select(key, *[F.round(F.col(c), 6).alias(c) if c == "avg_word_len" else F.col(c).cast("long").alias(c)
                                for c in FLAGS_AND_COUNTS])


@query
def text_features(spark, d):
    return _numbers(_messages(spark, d), "msg_id")


@query
def document_features(spark, d):
    docs = _texts(spark, d).withColumn("tokens", tx.word_tokens(F.col("text")))
    return _numbers(docs, "doc_id")


@query
def normalised_features(spark, d):
    """The text group of the feature vector for every reply, scaled over all replies."""
    replies = _messages(spark, d).where("not is_source")
    raw = durable(sf.text_counts(replies, ["msg_id"]))
    scaled = normalise(raw, value_ranges(raw, tx.COUNT_FEATURES), tx.COUNT_FEATURES)
    out = sf.with_cap_ratio(scaled.join(raw.select("msg_id", F.col("txt_len").alias("_len")), "msg_id"), "_len")
    return out.select("msg_id", *[F.round(F.col(c).cast("double"), 6).alias(c) for c in sf.TEXT_ORDER])


@query
def value_ranges_plain(spark, d):
    """Smallest and largest value of each count over all replies, one row per property."""
    replies = _messages(spark, d).where("not is_source")
    r = value_ranges(sf.text_counts(replies, ["msg_id"]), tx.COUNT_FEATURES)
    rows = F.array(*[F.struct(F.lit(c).alias("property"), F.round(f"{c}_min", 6).alias("min"), F.round(f"{c}_max", 6).alias("max"))
                     for c in tx.COUNT_FEATURES])
    return r.select(F.inline(rows))


@query
def value_ranges_ordered(spark, d):
    """Ranges as a running update in order of first occurrence yields them."""
    m = _messages(spark, d)
    first = sf.analysed(m, tree.branch_members(m, index=True))
    counted = sf.text_counts(first, ["source_id", "branch_idx", "pos"])
    ranked = durable(rank_rows(counted, [], [F.col("source_id"), F.col("branch_idx"), F.col("pos")], "seq"))
    r = value_ranges_in_order(ranked, tx.COUNT_FEATURES, F.col("seq"))
    rows = F.array(*[F.struct(F.lit(c).alias("property"), F.round(f"{c}_min", 6).alias("min"), F.round(f"{c}_max", 6).alias("max"))
                     for c in tx.COUNT_FEATURES])
    return r.select(F.inline(rows))


@query
def lexicon_counts(spark, d):
    """All four lists in one pass: two over the tokens, two over the words of the raw text."""
    m = _messages(spark, d)
    table = lx.list_terms(_lexicon(spark), dict(zip(lx.LEXICON_FEATURES, ["token", "token", "word", "word"])))
    sums = lx.term_sums(m, ["msg_id"], {"token": F.col("tokens"), "word": tx.words(F.col("text"))}, table, lx.LEXICON_FEATURES)
    return lx.attach_counts(m.select("msg_id"), sums, ["msg_id"], lx.LEXICON_FEATURES)


@query
def sentiment(spark, d):
    m = _messages(spark, d)
    return lx.attach_counts(m.select("msg_id"), lx.sentiment(m, ["msg_id"], F.col("tokens"), _sentiment(spark)), ["msg_id"], ["sentiment"])


def _tagger(m: DataFrame) -> DataFrame:
    """A (token, tag) table over the corpus vocabulary, tags by token length; tokens with a digit stay unknown."""
    tag = F.get(F.array(*[F.lit(t) for t in lx.POS_TAGS]), F.pmod(F.length("token"), F.lit(len(lx.POS_TAGS))))
    words = tx.explode_terms(m, [], F.col("tokens"), "token").distinct().where(~F.col("token").rlike("[0-9]"))
    return words.select("token", tag.alias("tag"))


@query
def pos_tag_lines(spark, d):
    m = _messages(spark, d)
    return lx.pos_tag_lines(m, "msg_id", F.col("tokens"), _tagger(m)).select("msg_id", F.array_join("tags", " ").alias("tags"))


@query
def pos_vector(spark, d):
    m = _messages(spark, d)
    tagged = lx.pos_tag_lines(m, "msg_id", F.col("tokens"), _tagger(m))
    slots = lx.pos_occurrence(F.col("tags"))
    return m.select("msg_id").join(tagged, "msg_id", "left").select("msg_id", F.array_join(F.transform(slots, lambda x: x.cast("string")), "").alias("slots"))


# --- time, labels, sequences -------------------------------------------------------------------

@query
def log_time(spark, d):
    m = _messages(spark, d)
    seen = sq.observations(tree.branch_members(m, folds=sq.time_folds()), m)
    return seen.select(*BRANCH, "pos", "msg_id", F.round("t", 6).alias("t"))


@query
def scaled_time(spark, d):
    m = _messages(spark, d)
    seen = sq.observations(tree.branch_members(m, folds=sq.time_folds()), m, scaled_time=True)
    return seen.select(*BRANCH, "pos", "msg_id", F.round("t", 6).alias("t"))


@query
def branch_span(spark, d):
    """Earliest and latest message of every branch, as seconds."""
    return tree.branches(_messages(spark, d), sq.time_folds()).select(
        *BRANCH, F.unix_seconds("earliest").alias("earliest"), F.unix_seconds("latest").alias("latest"))


def _stances(obs):
    return F.array_join(F.transform(obs, lambda o: o["stance"].cast("string")), ",")


def _time_sum(obs):
    return F.round(F.aggregate(obs, F.lit(0.0), lambda a, o: a + o["t"]), 6)


@query
def sequences(spark, d):
    s = sq.whole(sq.from_messages(_messages(spark, d), index=True))
    return s.select("source_id", "branch_idx", *_long("veracity"), _stances(F.col("obs")).alias("stances"), _time_sum(F.col("obs")).alias("t_sum"))


@query
def sequences_skip_first(spark, d):
    s = sq.whole(sq.from_messages(_messages(spark, d), timestamps=False, skip_first=True))
    return s.select("source_id", "branch_idx", *_long("veracity"), _stances(F.col("obs")).alias("stances"))


@query
def sequences_without_commenting(spark, d):
    s = sq.whole(sq.prepare(sq.from_messages(_messages(spark, d)), remove_commenting=True))
    return s.select(*BRANCH, *_long("veracity"), _stances(F.col("obs")).alias("stances"))


@query
def sequence_casts(spark, d):
    """Claim classes of all sequences under the three treatments of unverified claims."""
    s = sq.per_branch(sq.from_messages(_messages(spark, d), timestamps=False))
    kinds = F.array(*[F.struct(F.lit(k).alias("unverified_cast"), lb.cast_unverified(F.col("veracity"), k).alias("veracity"))
                      for k in ("true", "false", "none")])
    return (s.groupBy("veracity").agg(F.count(F.lit(1)).alias("n")).select("n", F.inline(kinds))
            .groupBy("unverified_cast", F.col("veracity").cast("long").alias("veracity")).agg(F.sum("n").alias("n")))


def _partly_labelled(m: DataFrame) -> DataFrame:
    """Annotations that leave out the commenting messages."""
    annotations = m.where("sdqc in ('Supporting', 'Denying', 'Querying')").select("msg_id", "sdqc")
    return m.drop("sdqc").join(annotations, "msg_id", "left").withColumn("sdqc", lb.or_unspecified(F.col("sdqc")))


@query
def attach_stances(spark, d):
    """Left join of annotations; a message without one is underspecified."""
    return _partly_labelled(_messages(spark, d)).select("msg_id", "sdqc", lb.stance_code(F.col("sdqc")).cast("long").alias("code"),
                                                       lb.source_stance(F.col("sdqc")).alias("as_source"))


@query
def sequences_of_labelled(spark, d):
    """Sequences over labelled members only; branches without any are left out."""
    s = sq.whole(sq.from_messages(_partly_labelled(_messages(spark, d))))
    return s.select(*BRANCH, *_long("veracity"), _stances(F.col("obs")).alias("stances"), _time_sum(F.col("obs")).alias("t_sum"))


@query
def attach_claims(spark, d):
    """Strict join of the sources with a claim overview."""
    from branchwise.sources.threads import attach_claims as attach

    m = _messages(spark, d)
    overview = m.where("is_source").select("source_id", lb.veracity_code(F.col("truth")).alias("veracity"))
    return attach(m.drop("truth"), overview).where("is_source").select("source_id", "truth")


# --- word vectors -----------------------------------------------------------------------------

def _vectors(spark, d) -> DataFrame:
    return durable(cv.document_vectors(spark, d))


@query
def average_vectors(spark, d):
    m = _messages(spark, d)
    v = embed.message_vectors(m, ["msg_id"], F.col("tokens"), _vectors(spark, d), DIM)
    avg = embed.average_vector(F.col("vsum"), F.col("n_tokens"), DIM)
    return v.select("msg_id", "n_tokens", "n_known", F.round(_checksum(avg), 5).alias("checksum"), F.round(dot(avg, avg), 6).alias("square"))


@query
def document_average_vectors(spark, d):
    docs = _texts(spark, d).withColumn("tokens", tx.word_tokens(F.col("text")))
    v = embed.message_vectors(docs, ["doc_id"], F.col("tokens"), _vectors(spark, d), DIM)
    avg = embed.average_vector(F.col("vsum"), F.col("n_tokens"), DIM)
    return v.select("doc_id", "n_tokens", "n_known", F.round(_checksum(avg), 5).alias("checksum"))


@query
def token_matrices(spark, d):
    t = embed.token_matrix(_messages(spark, d), ["msg_id"], F.col("tokens"), _vectors(spark, d))
    weighted = F.aggregate(F.transform("matrix", lambda v, i: _checksum(v) * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return t.select("msg_id", F.size("matrix").cast("long").alias("n_rows"), F.round(weighted, 3).alias("checksum"))


@query
def set_cosine(spark, d):
    """Similarity of every reply to its source as two token lists."""
    m = _messages(spark, d)
    source = m.where("is_source").select("source_id", F.col("tokens").alias("source_tokens"))
    pairs = m.where("not is_source").select("source_id", "msg_id", "tokens").join(source, "source_id")
    return (embed.set_cosine(pairs, ["msg_id"], F.col("tokens"), F.col("source_tokens"), _vectors(spark, d), DIM)
            .select("msg_id", F.round("similarity", 6).alias("similarity")))


@query
def similarities(spark, d):
    m = durable(_messages(spark, d))
    members = durable(tree.branch_members(m, index=True))
    context = sf.analysed(m, members).select("msg_id", "prev_id", *BRANCH)
    vecs = durable(embed.message_vectors(m, ["msg_id"], F.col("tokens"), _vectors(spark, d), DIM))
    return embed.similarities(context, members, vecs, BRANCH, DIM).select(
        "msg_id", *[F.round(c, 6).alias(c) for c in ("sim_to_src", "sim_to_prev", "sim_to_branch")])


@query
def word_similarity(spark, d):
    """Similarity of all pairs of neighbouring tokens."""
    last = F.size("tokens") - 1
    pairs = (_messages(spark, d).where(F.size("tokens") > 1)
             .select(F.inline(F.arrays_zip(F.slice("tokens", F.lit(1), last).alias("w1"), F.slice("tokens", F.lit(2), last).alias("w2")))).distinct())
    return embed.word_similarity(pairs, _vectors(spark, d)).select("w1", "w2", F.round("similarity", 6).alias("similarity"))


@query
def nearest_words(spark, d):
    return embed.nearest_words(_vectors(spark, d), ["the", "la", "und", "zzz-unknown"]).select(
        "word", *_long("rank"), "neighbour", F.round("similarity", 6).alias("similarity"))


@query
def in_vocabulary(spark, d):
    words = tx.explode_terms(_messages(spark, d), [], F.col("tokens"), "token").distinct()
    return embed.in_vocabulary(words, _vectors(spark, d))


# --- features ---------------------------------------------------------------------------------

def _feature_table(spark, d, members=None):
    m = durable(_messages(spark, d))
    members = durable(sf.build_members(m, sub_sample=True))
    features = sf.build_features(m, members, ["sdqc_parent", "text", "lexicon", "sentiment"], lexicon=_lexicon(spark), sentiment=_sentiment(spark))
    return features, members


FEATURE_COLUMNS = [*sf.TEXT_ORDER, *lx.LEXICON_FEATURES, "sentiment"]


@query
def stance_feature_table(spark, d):
    """Sub-sampled feature table: parent label, text, lexicon and sentiment groups."""
    features, _ = _feature_table(spark, d)
    return features.select("msg_id", *_long("stance", "sdqc_parent"), *[F.round(F.col(c).cast("double"), 6).alias(c) for c in FEATURE_COLUMNS])


@query
def branch_features(spark, d):
    """Features of all members of all kept branches, added up per branch."""
    features, members = _feature_table(spark, d)
    rows = sf.on_branches(features, members)
    return rows.groupBy(*BRANCH).agg(F.count(F.lit(1)).alias("n"), *[F.round(F.sum(F.col(c).cast("double")), 4).alias(c) for c in sf.TEXT_ORDER])


@query
def vector_feature_table(spark, d):
    """Similarity and token-matrix groups; messages without known tokens in themselves or their source are left out."""
    m = durable(_messages(spark, d))
    members = durable(sf.build_members(m))
    features = sf.build_features(m, members, ["wembs", "token_wembs"], vectors=_vectors(spark, d), dim=DIM)
    return features.select("msg_id", *[F.round(c, 6).alias(c) for c in ("sim_to_src", "sim_to_prev", "sim_to_branch")],
                           *_matrix_columns(), F.round(_checksum(F.col("avg_vector")), 4).alias("avg_checksum"))


# --- statistics and metrics ---------------------------------------------------------------------

@query
def label_histogram(spark, d):
    m = _messages(spark, d).where("not is_source")
    return mt.label_histogram(m, "sdqc").select("sdqc", "n", F.round("share", 6).alias("share"))


@query
def label_histogram_by_truth(spark, d):
    m = _messages(spark, d)
    truth = m.where("is_source").select("source_id", F.col("truth").alias("claim"))
    joined = m.where("not is_source").select("source_id", "sdqc").join(truth, "source_id")
    return mt.label_histogram(joined, "sdqc", ["claim"]).select("claim", "sdqc", "n", F.round("share", 6).alias("share"))


@query
def majority_label(spark, d):
    """Most frequent stance code per claim class."""
    m = _messages(spark, d).select("truth", lb.stance_code(F.col("sdqc")).alias("stance"))
    return mt.majority_label(m, "stance", ["truth"]).select("truth", *_long("stance"), "n")


@query
def majority_baseline(spark, d):
    """Scores of the constant answer on branch sequences with unverified counted as true."""
    s = durable(sq.per_branch(sq.prepare(sq.from_messages(_messages(spark, d), timestamps=False), "true")))
    judged = majority.predict(s, majority.fit(s)).withColumnRenamed("veracity", "actual")
    return mt.scores(judged).select(*[F.round(c, 6).alias(c) for c in mt.METRICS])


def _judged(spark, d) -> DataFrame:
    return spark.read.parquet(f"{d}/labels.parquet").select(
        "doc_id", F.col("toxic").alias("actual"), (F.col("doc_id") % 5 == 0).cast("int").alias("predicted"))


@query
def confusion(spark, d):
    return mt.confusion(_judged(spark, d), [0, 1]).select(*_long("actual", "predicted", "n"))


@query
def class_accuracy(spark, d):
    return mt.class_accuracy(_judged(spark, d), [0, 1, 2]).select(*_long("actual"), F.round("accuracy", 6).alias("accuracy"))


@query
def scores(spark, d):
    return mt.scores(_judged(spark, d)).select(*[F.round(c, 6).alias(c) for c in [*mt.METRICS, "precision_macro", "recall_macro"]])


@query
def bucket_metrics(spark, d):
    """Mean scores over five folds per branch-length class; the answer comes from the leaf's stance."""
    m = _messages(spark, d)
    b = tree.branches(m)
    leaf = m.select(F.col("msg_id").alias("leaf_id"), lb.stance_code(F.col("sdqc")).alias("leaf_stance"), F.unix_seconds("created").alias("s"))
    truth = m.where("is_source").select("source_id", lb.cast_unverified(lb.veracity_code(F.col("truth")), "true").alias("actual"))
    judged = b.join(leaf, "leaf_id").join(truth, "source_id").select(
        "actual", (F.col("leaf_stance") % 2).alias("predicted"), (F.col("s") % 5).alias("fold"),
        tree.length_bucket(F.col("branch_len")).cast("long").alias("length"))
    means = mt.fold_means(mt.scores(judged, ["length", "fold"]), ["length"], 5)
    return means.select("length", *[F.round(c, 6).alias(c) for c in mt.METRICS])


@query
def level_metrics(spark, d):
    """Scores over all branches, per length class, per fold and per both, from one pass."""
    m = _messages(spark, d)
    leaf = m.select(F.col("msg_id").alias("leaf_id"), lb.stance_code(F.col("sdqc")).alias("leaf_stance"), F.unix_seconds("created").alias("s"))
    truth = m.where("is_source").select("source_id", lb.cast_unverified(lb.veracity_code(F.col("truth")), "true").alias("actual"))
    judged = tree.branches(m).join(leaf, "leaf_id").join(truth, "source_id").select(
        "actual", (F.col("leaf_stance") % 2).alias("predicted"), (F.col("s") % 5).alias("fold"), tree.length_bucket(F.col("branch_len")).cast("long").alias("length"))
    return mt.level_scores(judged, ["length", "fold"]).select("length", "fold", *[F.round(c, 6).alias(c) for c in mt.METRICS])


def _epochs(spark, d) -> DataFrame:
    """Daily mean values per event type as a stand-in for a table of training epochs."""
    e = _events(spark, d)
    return (e.groupBy(F.col("event_type").alias("params"), F.dayofmonth("ts").cast("long").alias("epoch"))
            .agg(F.round(F.avg("value"), 2).alias("f1_macro")))


@query
def learning_curve(spark, d):
    return mt.learning_curve(_epochs(spark, d), ["params"])


@query
def best_epoch(spark, d):
    return mt.best_epoch(_epochs(spark, d), ["params"])


# --- splits -----------------------------------------------------------------------------------

def _arithmetic_order(key: str):
    mixed = (F.col(key) * 7919) % 10007
    return mixed.cast("int"), [mixed, F.col(key)]


@query
def kfold(spark, d):
    docs = _documents(spark, d).select("doc_id")
    return splits.kfold(docs, 7, *_arithmetic_order("doc_id")).select("doc_id", *_long("fold"))


@query
def holdout(spark, d):
    docs = _documents(spark, d).select("doc_id")
    return splits.holdout(docs, 0.2, *_arithmetic_order("doc_id"))


@query
def stratified_split(spark, d):
    docs = _documents(spark, d).select("doc_id", "lang")
    return splits.stratified(docs, "lang", 0.25, *_arithmetic_order("doc_id")).select("doc_id", "lang", "is_test")


# --- hidden Markov models -----------------------------------------------------------------------

def _scored(spark, d, models) -> DataFrame:
    return hmm.score(durable(sq.from_messages(_messages(spark, d))), models, BRANCH)


@query
def hmm_score(spark, d):
    return _scored(spark, d, discrete_models()).select(*BRANCH, F.inline("lls")).select(
        *BRANCH, *_long("label"), F.round("ll", 6).alias("ll"))


@query
def hmm_score_gaussian(spark, d):
    return _scored(spark, d, gaussian_models()).select(*BRANCH, F.inline("lls")).select(
        *BRANCH, *_long("label"), F.round("ll", 6).alias("ll"))


@query
def hmm_predict(spark, d):
    return _scored(spark, d, discrete_models()).select(*BRANCH, hmm.best_label(F.col("lls")).cast("long").alias("predicted"))


@query
def hmm_test(spark, d):
    """Scores of the fixed models on all branches, three claim classes."""
    s = durable(sq.from_messages(_messages(spark, d)))
    judged = hmm.score(s, discrete_models(), BRANCH, ["veracity"]).select(
        F.col("veracity").alias("actual"), hmm.best_label(F.col("lls")).alias("predicted"))
    return mt.scores(judged).select(*[F.round(c, 6).alias(c) for c in [*mt.METRICS, "precision_macro", "recall_macro"]])


def _parameters(spark, models) -> DataFrame:
    table = hmm.to_table(spark, models)
    return table.select("key", "label", F.to_json("start").alias("start"), F.to_json("trans").alias("trans"),
                        F.to_json("emission").alias("emission"), F.to_json("mean").alias("mean"), F.to_json("var").alias("var"))


@query
def hmm_fit_gaussian(spark, d):
    return _parameters(spark, hmm.fit(sq.from_messages(_messages(spark, d)), timestamps=True))


@query
def hmm_fit_one_state(spark, d):
    """With a single state the fitted model is the mean and variance of each class."""
    models = hmm.fit(sq.from_messages(_messages(spark, d)), states=1, timestamps=True)
    rows = hmm.to_table(spark, models)
    cell = lambda c, i: F.round(F.col(c)[0][i], 6)
    return rows.select(*_long("label"), cell("mean", 0).alias("stance_mean"), cell("mean", 1).alias("time_mean"),
                       cell("var", 0).alias("stance_var"), cell("var", 1).alias("time_var"))


@query
def hmm_fit_discrete(spark, d):
    return _parameters(spark, hmm.fit(sq.from_messages(_messages(spark, d), timestamps=False), kind="discrete"))


def _two_corpora(spark, d) -> DataFrame:
    """Threads opened in the first and in the second half of each week."""
    m = _messages(spark, d)
    corpus = m.where("is_source").select("source_id", F.when(F.dayofweek("created") <= 3, "early").otherwise("late").alias("corpus"))
    return durable(sq.from_messages(m).join(corpus, "source_id"))


@query
def cross_corpus(spark, d):
    """Five-fold evaluation of one configuration with two corpora."""
    config = evaluation.Config(unverified_cast="true", remove_commenting=True, test=("early",), kind="discrete")
    return evaluation.evaluate(_two_corpora(spark, d), config, ["early", "late"])


def _digest_order():
    """A shuffle that any SQL engine can repeat."""
    digest = F.md5(F.concat_ws("|", *BRANCH))
    return F.conv(F.substring(digest, 1, 3), 16, 10).cast("int"), [digest, *[F.col(c) for c in BRANCH]]


@query
def evaluation_sweep(spark, d):
    """All 36 configurations of the grid, five folds each, fitted in shared passes."""
    corpora = ["early", "late"]
    found = evaluation.evaluate_all(_two_corpora(spark, d), evaluation.grid(corpora), corpora, shuffle=_digest_order())
    return found.select("model", "unverified_cast", "remove_commenting", "testdata_type", "model_type", F.col("comp_count").cast("long").alias("comp_count"),
                        "timestamps", *[F.round(c, 6).alias(c) for c in mt.METRICS])


@query
def evaluation_sweep_majority(spark, d):
    """The majority twins of all configurations, judged on the same folds."""
    corpora = ["early", "late"]
    found = evaluation.evaluate_all(_two_corpora(spark, d), evaluation.grid(corpora), corpora, shuffle=_digest_order(), fitted=False)
    return found.select("model", "unverified_cast", "remove_commenting", "testdata_type", "model_type", "timestamps", *[F.round(c, 6).alias(c) for c in mt.METRICS])


# --- learned models ------------------------------------------------------------------------------

@query
def word_vectors_trained(spark, d):
    docs = _texts(spark, d).select(tx.word_tokens(F.col("text")).alias("words"))
    return word_vectors.train(durable(docs), "words", dim=DIM)


@query
def cooccurrences(spark, d):
    """Counts and mutual information of word pairs, for words that occur fifty times or more."""
    docs = durable(_texts(spark, d).select(tx.word_tokens(F.col("text")).alias("words")))
    pairs = durable(word_vectors.pair_counts(docs, "words", min_count=50))
    return word_vectors.pair_information(pairs, keep=True).select("a", "b", "n", F.round("weight", 6).alias("weight"))


@query
def approximate_neighbours(spark, d):
    """About the ten nearest vectors of every fiftieth one."""
    rows = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("token"), F.col("embedding").cast("array<double>").alias("vector"))
    found = neighbours.approximate_neighbours(rows, rows.where(F.col("token") % 50 == 0), 10)
    return found.select(F.col("word").alias("vec_id"), *_long("rank"), "neighbour", F.round("similarity", 6).alias("similarity"))


def _stance_rows(spark, d):
    m = durable(_messages(spark, d))
    members = durable(tree.branch_members(m, folds=sq.time_folds(), index=True))
    context = durable(sf.analysed(m, members).select("msg_id", "prev_id", *BRANCH, lb.stance_code(F.col("sdqc")).alias("stance")))
    vectors = _vectors(spark, d)
    features = stance.vector_features(m, context, members, vectors, DIM, BRANCH)
    return m, vectors, durable(features.join(context.select("msg_id", "stance"), "msg_id"))


@query
def stance_model(spark, d):
    """Hold-out scores of the stance classifier."""
    _, _, rows = _stance_rows(spark, d)
    split = durable(splits.holdout(rows, 0.2, *splits.shuffled(["msg_id"])))
    result, _ = stance.test(split.where("is_test"), stance.fit(split.where("not is_test")))
    return result


@query
def stance_epochs(spark, d):
    """Three settings trained together, three epochs and then two more from where they stopped, through the epoch table."""
    from pyspark.ml.functions import vector_to_array

    _, _, rows = _stance_rows(spark, d)
    plain = rows.select("msg_id", "stance", vector_to_array("features").alias("features"))
    split = durable(splits.holdout(plain, 0.2, *splits.shuffled(["msg_id"])))
    settings = [epochs.Setting(), epochs.Setting(hidden=20), epochs.Setting(rate=0.01)]
    path, out = scratch_path(spark, "training"), scratch_path(spark, "epochs")
    for until in (3, 5):
        table = epochs.train(split.where("not is_test"), split.where("is_test"), settings, until, path)
    sinks.epoch_rows(table, out)
    return spark.read.parquet(out).select("params", *_long("epoch"), *[F.round(c, 6).alias(c) for c in ("loss", "accuracy", "f1_macro", "f1_micro")])


@query
def claim_predictions(spark, d):
    """Stance and claim labels for all branches from messages alone."""
    m, vectors, rows = _stance_rows(spark, d)
    model = stance.fit(rows)
    out = claims.predict_claims(m, vectors, DIM, model, discrete_models())
    return out.select(*BRANCH, "veracity", F.array_join("stances", ",").alias("stances"), "claim")


# --- stores, corpora, labelling -------------------------------------------------------------------

def _two_stores(spark, d):
    """An older store without unverified claims and a newer one without false claims; true claims are in both."""
    m = _messages(spark, d)
    truth = m.where("is_source").select("source_id", F.col("truth").alias("claim"))
    rows = m.select("source_id", "msg_id").join(truth, "source_id")
    old = rows.where("claim <> 'Unverified'").select("source_id", "msg_id", F.lit("old").alias("origin"))
    new = rows.where("claim <> 'False'").select("source_id", "msg_id", F.lit("new").alias("origin"))
    return old, new


@query
def merge_stores(spark, d):
    return merge.merge(*_two_stores(spark, d))


@query
def upsert_store(spark, d):
    return merge.upsert(*_two_stores(spark, d))


@query
def upsert_store_files(spark, d):
    """The same through two written versions of a thread store."""
    old, new = _two_stores(spark, d)
    path = scratch_path(spark, "store")
    store.append(old, path, 1)
    store.append(new, path, 2)
    return store.latest(spark, path)


def _bucket_store(spark, d) -> str:
    """The two stores as versions in bucket folders, compacted, then a version that cuts unverified threads down to their source."""
    old, new = _two_stores(spark, d)
    path = scratch_path(spark, "buckets")
    buckets.append(old, path, 1, buckets=STORE_BUCKETS)
    buckets.append(new, path, 2, buckets=STORE_BUCKETS)
    buckets.compact(spark, path, buckets=STORE_BUCKETS, most=1)
    sources = _messages(spark, d).where("is_source and truth = 'Unverified'")
    buckets.append(sources.select("source_id", "msg_id", F.lit("newest").alias("origin")), path, 3, buckets=STORE_BUCKETS)
    return path


@query
def upsert_store_buckets(spark, d):
    """Newest rows of every thread from a base and a later version."""
    return buckets.latest(spark, _bucket_store(spark, d))


@query
def upsert_store_keys(spark, d):
    """The same for the threads in which someone denies, by a table of keys."""
    path = _bucket_store(spark, d)
    return buckets.latest_of(spark, path, _messages(spark, d).where("sdqc = 'Denying'").select("source_id"), buckets=STORE_BUCKETS)


@query
def corpus_union(spark, d):
    """Messages and documents as one corpus table."""
    m = _messages(spark, d).select(F.col("source_id").alias("id"), F.length("text").alias("chars"))
    docs = _documents(spark, d).select(F.col("doc_id").cast("string").alias("id"), F.length("text").alias("chars"))
    both = merge.union_corpora({"threads": m, "documents": docs})
    return both.groupBy("corpus").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("n_ids"), F.sum("chars").cast("long").alias("chars"))


def _annotations(spark, d) -> DataFrame:
    """Three annotators per document."""
    docs = _documents(spark, d).select("doc_id", F.explode(F.array(*[F.lit(u) for u in (1, 2, 3)])).alias("user"))
    return docs.withColumn("label", (F.col("doc_id") * F.col("user")) % 3)


@query
def agreement(spark, d):
    return ag.agreement(_annotations(spark, d), ["doc_id"]).select(
        "doc_id", "n_users", "agree", F.array_join(F.transform("labels", lambda x: x.cast("string")), ",").alias("labels"))


@query
def agreement_split(spark, d):
    """Rows routed to the agreed and to the disputed output."""
    agreed, disputed = ag.split_by_agreement(_annotations(spark, d), ["doc_id"])
    return agreed.select(F.lit("agreed").alias("output"), "doc_id").unionByName(
        disputed.select(F.lit("disputed").alias("output"), "doc_id")).groupBy("output").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("n_items"))


@query
def claim_decode(spark, d):
    """Claim codes: code c is given when bit c-1 of the document id is set."""
    codes = F.array_compact(F.array(*[F.when(F.shiftright("doc_id", c - 1).bitwiseAND(1) == 1, c) for c in range(1, 8)]))
    return _documents(spark, d).select("doc_id", *[c.alias(n) for n, c in lb.decode_claim(codes).items()])


@query
def stance_decode(spark, d):
    """One stance code per document, a second one for every seventh, an unknown code for every eleventh."""
    code = F.when(F.col("doc_id") % 11 == 0, 9).otherwise(F.col("doc_id") % 4 + 1).cast("int")
    codes = F.when(F.col("doc_id") % 7 == 0, F.array(code, F.lit(4))).otherwise(F.array(code))
    return _documents(spark, d).select("doc_id", *[c.alias(n) for n, c in lb.decode_stance(codes).items()])


@query
def integrate_labels(spark, d):
    """Agreed document labels written to the messages with the same number."""
    m = cv.raw_messages(spark, d).select("msg_id", F.col("conv_id").alias("doc_id"), "turn", F.lit("Underspecified").alias("sdqc"))
    agreed, _ = ag.split_by_agreement(_annotations(spark, d), ["doc_id"])
    given = agreed.select("doc_id", F.col("doc_id").alias("item_id"), lb.stance_name(F.col("labels")[0].cast("int")).alias("sdqc"))
    return ag.integrate(m, given, ["doc_id"], ["sdqc"]).select("msg_id", "sdqc")


@query
def label_round_trip(spark, d):
    """Replies exported, labelled by three users each, read back, agreed, decoded, integrated and put into a thread store.

    The third user disagrees on every fifth reply, which stays as it was.
    """
    base = scratch_path(spark, "labelling")
    raw = cv.raw_messages(spark, d).where("turn > 0").select((F.col("conv_id") * 100_000 + F.col("turn")).alias("item"), "msg_id", "conv_id", "turn", "sdqc", "text")
    given = lambda u: F.struct(F.lit(u).cast("long").alias("user"), (F.when((F.col("conv_id") + F.col("turn")) % 5 == 0, (F.col("sdqc") + int(u == 3)) % 4)
                                                                      .otherwise(F.col("sdqc")) + 1).cast("long").alias("label"))
    raw.select(F.col("item").alias("id"), "text", F.array(*[given(u) for u in (1, 2, 3)]).alias("annotations")).write.json(f"{base}/export")
    messages = raw.select(F.concat(F.lit("m"), F.col("conv_id").cast("string"), F.lit("_0")).alias("source_id"), "msg_id", "item", F.lit("Underspecified").alias("sdqc"))
    store.append(messages, f"{base}/store", 1)
    labelled, _, _ = run.integrate_export(store.latest(spark, f"{base}/store"), tables.label_export(spark, f"{base}/export"), "item")
    store.append(labelled, f"{base}/store", 2)
    return store.latest(spark, f"{base}/store").select("source_id", "msg_id", "sdqc")


@query
def evaluation_grid(spark, d):
    """Rows and majority share per language under every cast and removal setting."""
    docs = _documents(spark, d).select("lang", (F.col("doc_id") % 3).cast("int").alias("veracity"), (F.col("n_chars") % 4).alias("stance"))
    counted = docs.groupBy("lang", "veracity", "stance").agg(F.count(F.lit(1)).alias("n"))
    settings = F.array(*[F.struct(F.lit(cast).alias("unverified_cast"), F.lit(remove).alias("remove_commenting"),
                                  lb.cast_unverified(F.col("veracity"), cast).alias("label"))
                         for cast in ("true", "false") for remove in (True, False)])
    rows = counted.select("lang", "stance", "n", F.inline(settings)).where("not (remove_commenting and stance = 3)")
    per = rows.groupBy("lang", "unverified_cast", "remove_commenting", "label").agg(F.sum("n").alias("n"))
    return per.groupBy("lang", "unverified_cast", "remove_commenting").agg(
        F.sum("n").alias("n"), F.round(F.max("n") / F.sum("n"), 6).alias("majority_share"))


# --- written and read back -------------------------------------------------------------------------

@query
def sequence_file(spark, d):
    """Sequences through their text form, with times."""
    path = scratch_path(spark, "sequences")
    sinks.sequence_table(sq.from_messages(_messages(spark, d)), path, timestamps=True, fmt="tsv")
    back = tables.sequences(spark, path)
    return (back.groupBy(*_long("veracity"), _stances(F.col("obs")).alias("stances")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum(F.aggregate("obs", F.lit(0.0), lambda a, o: a + o["t"])), 4).alias("t_sum")))


@query
def word_list_file(spark, d):
    """Document words as written, with a leading blank, through a word-list file."""
    path = scratch_path(spark, "words")
    words = tx.explode_terms(_texts(spark, d), [], F.regexp_extract_all("text", F.lit(tx.WORD), F.lit(0)), "word")
    words.select(F.concat(F.lit(" "), "word").alias("value")).write.text(path)
    return tables.word_list(spark, path)


@query
def sentence_file(spark, d):
    """Document lines through a sentence file: non-blank lines and their words."""
    path = scratch_path(spark, "lines")
    _documents(spark, d).select("text").write.text(path)
    s = tables.sentences(spark, path)
    return s.agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.size("words")).cast("long").alias("n_words"))


@query
def vector_file(spark, d):
    """Word vectors through their text form."""
    path = scratch_path(spark, "vectors")
    v = _vectors(spark, d)
    v.select(F.concat_ws(" ", "token", F.array_join(F.transform("vector", lambda x: x.cast("string")), " ")).alias("value")).write.text(path)
    back = tables.word_vectors(spark, path, fmt="text")
    return back.select("token", F.size("vector").cast("long").alias("dim"), F.round(_checksum(F.col("vector")), 4).alias("checksum"))


@query
def matrix_file(spark, d):
    """Token matrices of replies and their sources through the text form of the feature table."""
    m = durable(_messages(spark, d))
    replies = m.where("not is_source").select("msg_id", "source_id", "tokens", lb.stance_code(F.col("sdqc")).alias("stance"))
    lists = replies.join(m.select(F.col("msg_id").alias("source_id"), F.col("tokens").alias("source_tokens")), "source_id")
    rows = embed.token_matrices(lists, ["msg_id"], {"comment_matrix": "tokens", "source_matrix": "source_tokens"}, _vectors(spark, d))
    path = scratch_path(spark, "matrices")
    known = rows.where("comment_matrix is not null and source_matrix is not null")
    sinks.feature_table(known, path, ["comment_matrix", "source_matrix"], fmt="tsv", compression="gzip")
    back = tables.token_matrices(spark, path)
    return back.select("msg_id", *_long("sdqc"), *_matrix_columns())


@query
def annotation_task_files(spark, d):
    """Annotation tasks through their JSON files."""
    base = scratch_path(spark, "tasks")
    sinks.annotation_tasks(_messages(spark, d), f"{base}/claims", f"{base}/stances")
    read = lambda name: spark.read.schema("id_str string, text string, labels array<string>").json(f"{base}/{name}").select(
        F.lit(name).alias("task"), "id_str", "text", F.size("labels").cast("long").alias("n_labels"))
    return read("claims").unionByName(read("stances"))


@query
def metric_file(spark, d):
    """Bucketed scores through the semicolon file."""
    path = scratch_path(spark, "metrics")
    rows = QUERIES["q_bucket_metrics"](spark, d).select(
        F.lit("leaf").alias("model"), "length", F.lit("true").alias("unverified_cast"), F.lit("false").alias("remove_commenting"),
        F.lit("threads").alias("testdata_type"), F.lit("rule").alias("model_type"), F.lit(1).alias("comp_count"), *mt.METRICS)
    sinks.metric_rows(rows, path, with_length=True)
    return tables.metrics(spark, path, with_length=True).select("model", *_long("length"), "f1_macro", "accuracy")


def _latest_first(spark, d) -> DataFrame:
    """Messages whose siblings are to stand in the files from the latest to the first."""
    m = _messages(spark, d)
    return m.withColumn("ord", -F.unix_seconds("created"))


def _branch_rows(m: DataFrame, **options) -> DataFrame:
    s = sq.whole(sq.from_messages(m, index=True, **options))
    return s.select("source_id", "leaf_id", "branch_idx", *_long("veracity"), _stances(F.col("obs")).alias("stances"), _time_sum(F.col("obs")).alias("t_sum"))


@query
def reddit_file(spark, d):
    """Threads written as one JSON document each and read again: branches keep the order of the file, the first is skipped."""
    path = scratch_path(spark, "reddit")
    m = durable(_latest_first(spark, d).select("source_id", "msg_id", "parent_id", "is_source", "text_raw", "created", "sdqc", "sdqc_parent", "truth", "ord"))
    when = F.date_format("created", "yyyy-MM-dd'T'HH:mm:ss")
    comment = F.struct(F.struct(F.col("msg_id").alias("comment_id"), F.col("text_raw").alias("text"), "parent_id", when.alias("created"),
                                F.col("sdqc").alias("SDQC_Submission"), F.col("sdqc_parent").alias("SDQC_Parent")).alias("comment"))
    rows = tree.branch_members(m, index=True).join(m.select("msg_id", comment.alias("c")), "msg_id")
    ordered = lambda place, value: F.transform(F.array_sort(F.collect_list(F.struct(place, value))), lambda x: x[value])
    lists = (rows.groupBy("source_id", "branch_idx").agg(ordered("pos", "c").alias("branch"))
             .groupBy("source_id").agg(ordered("branch_idx", "branch").alias("branches")))
    submission = F.struct(F.col("source_id").alias("submission_id"), F.col("text_raw").alias("title"), F.lit("").alias("text"), when.alias("created"),
                          F.col("truth").alias("TruthStatus"), F.col("sdqc").alias("SourceSDQC"))
    sources = m.where("is_source").select("source_id", submission.alias("redditSubmission"))
    documents = sources.join(lists, "source_id", "left").select("redditSubmission", F.coalesce("branches", F.array()).alias("branches"))
    name = F.concat(F.lit("event/"), F.col("redditSubmission.submission_id"), F.lit(".json"))
    files.write_texts(documents.select(name.alias("path"), F.to_json(F.struct("redditSubmission", "branches")).alias("value")), path)
    return _branch_rows(read_messages(spark, path, "reddit"), skip_first=True)


@query
def tweet_file(spark, d):
    """Threads written as lines of tweet maps and read again: ``children`` lists give parents and order."""
    path = scratch_path(spark, "tweets")
    m = durable(_latest_first(spark, d).select("source_id", "msg_id", "parent_id", "is_source", "text_raw", "created", "sdqc", "sdqc_parent", "truth", "ord"))
    below = m.where("not is_source").groupBy(F.col("parent_id").alias("msg_id")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("ord", "msg_id"))), lambda x: x["msg_id"]).alias("children"))
    tweet = F.struct(F.col("msg_id").alias("id_str"), F.col("text_raw").alias("full_text"), F.date_format("created", "EEE MMM dd HH:mm:ss +0000 yyyy").alias("created_at"),
                     F.coalesce("children", F.array()).alias("children"), F.col("sdqc").alias("SDQC_Submission"), F.col("sdqc_parent").alias("SDQC_Parent"),
                     F.col("sdqc").alias("SourceSDQC"), F.col("truth").alias("TruthStatus"))
    threads = m.join(below, "msg_id", "left").groupBy("source_id").agg(F.map_from_entries(F.collect_list(F.struct("msg_id", tweet))).alias("tweets"))
    threads.select(F.concat("source_id", F.lit("\t"), F.to_json("tweets")).alias("value")).write.text(path)
    return _branch_rows(read_messages(spark, path, "twitter"))


@query
def stance_annotation_file(spark, d):
    """Stance lines among section headings; every reply is labelled twice, and the later line counts."""
    base = scratch_path(spark, "stances")
    names = F.create_map(*[F.lit(x) for code, name in lb.RESPONSE_TO_STANCE.items() for x in (name, code)])
    line = lambda label: F.to_json(F.struct(F.col("msg_id").alias("tweetid"), label.alias("responsetype-vs-source")))
    replies = _messages(spark, d).where("not is_source")
    lines = replies.select(F.explode(F.array(F.lit("# Direct Replies"), line(F.lit("comment")), line(F.lit("disagreed")), line(names[F.col("sdqc")]))).alias("value"))
    lines.write.text(f"{base}/annotations/en.json")
    return threads_of.stance_annotations(spark, base)


@query
def claim_overview_file(spark, d):
    """Claim codes through the overview file and back to the names of the sources."""
    path = scratch_path(spark, "overview")
    m = durable(_messages(spark, d).select("source_id", "msg_id", "is_source", "truth"))
    sinks.claim_overview(m.where("is_source").select("source_id", lb.veracity_code(F.col("truth")).alias("veracity")), path)
    return threads_of.attach_claims(m.drop("truth"), threads_of.claim_overview(spark, path)).where("is_source").select("source_id", "truth")


def _folders(spark, d) -> str:
    """All threads in the folder layout."""
    base = scratch_path(spark, "folders")
    m = _messages(spark, d).withColumn("ord", F.unix_seconds("created"))
    sinks.thread_folders(durable(m.select("source_id", "msg_id", "parent_id", "is_source", "text_raw", "created", "sdqc", "truth", "ord")), base)
    return base


@query
def thread_folder_file(spark, d):
    """Threads written as folders and read again, with parents from the nested ids and from the reply pointers."""
    base, out = _folders(spark, d), None
    for edges in ("structure", "replies"):
        rows = _branch_rows(durable(threads_of.messages(spark, base, edges))).withColumn("edges", F.lit(edges))
        out = rows if out is None else out.unionByName(rows)
    return out


@query
def claim_marks_file(spark, d):
    """Claim codes derived from the marks in every thread's annotation file, through the overview file."""
    path = scratch_path(spark, "overview")
    sinks.claim_overview(threads_of.veracity_overview(spark, _folders(spark, d)), path)
    return threads_of.claim_overview(spark, path).select("source_id", lb.veracity_name(F.col("veracity")).alias("truth"))


@query
def thread_selection(spark, d):
    """Threads by language, hashtag, place and origin of their source, and by number of replies."""
    m = _messages(spark, d)
    number = F.regexp_extract("source_id", "^m([0-9]+)_", 1).cast("long")
    tagged = durable(m.select(
        "source_id", "msg_id", "is_source", F.element_at(F.array(F.lit("da"), F.lit("en"), F.lit("sv")), (number % 3 + 1).cast("int")).alias("lang"),
        F.array(F.concat(F.lit("Tag"), (number % 5).cast("string"))).alias("hashtags"), (50 + number % 10).cast("double").alias("lat"),
        (5 + number % 7).cast("double").alias("lon"), (number % 4 == 0).alias("is_retweet")))
    options = {"lang": {"lang": "da"}, "hashtag": {"hashtag": "#tag3"}, "near": {"near": (54.0, 8.0, 250.0)}, "own": {"drop_retweets": True},
               "all": {"lang": "en", "drop_retweets": True, "min_replies": 3}}
    out = None
    for name, chosen in options.items():
        rows = tree.select_threads(tagged, **chosen).groupBy("source_id").agg(F.count(F.lit(1)).alias("n")).withColumn("test", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    return out


@query
def epoch_file(spark, d):
    """The best epoch of every setting, from a table that two runs have appended to."""
    path = scratch_path(spark, "epochs")
    rows = durable(_epochs(spark, d))
    for half in (rows.where("epoch <= 15"), rows.where("epoch > 15")):
        sinks.epoch_rows(half, path)
    return mt.best_epoch(spark.read.parquet(path), ["params"])


@query
def flagged_claims(spark, d):
    """Branches whose claim the fixed models hold false, written and read again with their stances."""
    path = scratch_path(spark, "flagged")
    m = durable(_messages(spark, d).select("source_id", "msg_id", "parent_id", "is_source", "created", "sdqc", "truth", "text"))
    s = durable(sq.from_messages(m))
    sinks.flagged_claims(claims.flagged(claims.judge(s, discrete_models(), m).join(claims.stance_lists(s), BRANCH)), path)
    return spark.read.parquet(path).select(*BRANCH, "veracity", F.array_join("stances", ",").alias("stances"))


# --- streams --------------------------------------------------------------------------------------

@query
def activity_tumbling(spark, d):
    return st.activity(_events(spark, d), "ts", ["event_type"], "1 day").select(F.unix_seconds("window_start").alias("start_s"), "event_type", "n")


@query
def activity_sliding(spark, d):
    return st.activity(_events(spark, d), "ts", ["event_type"], "12 hours", "6 hours").select(F.unix_seconds("window_start").alias("start_s"), "event_type", "n")


@query
def activity_sessions(spark, d):
    return st.sessions(_events(spark, d), "ts", ["user_id"], "2 hours").select(
        "user_id", F.unix_micros("window_start").alias("start_us"), F.unix_micros("window_end").alias("end_us"), "n")


def _event_stream(spark, d) -> DataFrame:
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    return st.file_stream(spark, d, schema, "parquet", "events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


@query
def activity_stream(spark, d):
    """The daily counts as a stream that updates a versioned sink."""
    out, ckpt = scratch_path(spark, "activity"), scratch_path(spark, "ckpt")
    counts = st.activity(_event_stream(spark, d), "ts", ["event_type"], "1 day", delay="1 day")
    live.upsert_sink(counts, out, ckpt).awaitTermination()
    rows = live.latest_rows(spark, out, ["window_start", "event_type"])
    return rows.select(F.unix_seconds("window_start").alias("start_s"), "event_type", "n")


@query
def repeats_stream(spark, d):
    """Every event arrives twice; the second copy is dropped."""
    out, ckpt = scratch_path(spark, "seen"), scratch_path(spark, "ckpt")
    twice = _event_stream(spark, d).select("event_id", "ts", "event_type", F.explode(F.array(F.lit(1), F.lit(2))).alias("copy"))
    once = st.without_repeats(twice, "ts", ["event_id"], "40 days")
    live.upsert_sink(once, out, ckpt, mode="append").awaitTermination()
    return spark.read.parquet(out).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query
def thread_stream(spark, d):
    """Messages arrive in two rounds: half of them first with another parent and label, so that parents may come after their
    replies and newer copies replace older ones; branches are kept current."""
    base = scratch_path(spark, "live")
    m = _messages(spark, d).select("source_id", "msg_id", "parent_id", "is_source", "created", "sdqc")
    schema = m.schema
    early = F.col("sdqc").isin("Supporting", "Denying")
    stale = (m.where(~early).withColumn("parent_id", F.when(~F.col("is_source"), F.col("source_id")))
             .withColumn("sdqc", F.lit("Underspecified")))
    for rows in (m.where(early).unionByName(stale), m.where(~early)):
        rows.write.mode("append").parquet(f"{base}/in")
        stream = st.file_stream(spark, f"{base}/in", schema, "parquet")
        live.run(stream, f"{base}/store", f"{base}/out", f"{base}/ckpt").awaitTermination()
    return live.latest(spark, f"{base}/out").select(*BRANCH, "branch_len")


@query
def quiet_thread_stream(spark, d):
    """Messages arrive on three days and are handed on once their thread has been quiet for six hours: first half of them, older copies among them, then
    the newer copies, then replies to threads that were handed on before. A last message elsewhere moves the clock."""
    base = scratch_path(spark, "quiet")
    m = durable(_messages(spark, d).select("source_id", "msg_id", "parent_id", "is_source", "created", "sdqc"))
    third = ~F.col("is_source") & (F.pmod(F.xxhash64("msg_id"), F.lit(3)) == 0)
    second = ~third & (F.pmod(F.xxhash64("msg_id"), F.lit(2)) == 0)
    stale = m.where(second).withColumn("parent_id", F.when(~F.col("is_source"), F.col("source_id"))).withColumn("sdqc", F.lit("Underspecified"))
    clock = m.limit(1).select(F.lit("clock").alias("source_id"), F.lit("clock").alias("msg_id"), F.lit(None).cast("string").alias("parent_id"),
                              F.lit(True).alias("is_source"), "created", "sdqc")
    for day, rows in enumerate((m.where(~second & ~third).unionByName(stale), m.where(second), m.where(third), clock), 1):
        rows.withColumn("arrived", F.to_timestamp(F.lit(f"2024-01-0{day} 00:00:00"))).write.mode("append").parquet(f"{base}/in")
        schema = spark.read.parquet(f"{base}/in").schema
        stream = st.file_stream(spark, f"{base}/in", schema, "parquet")
        quiet.run(stream, "arrived", 6 * 3600, f"{base}/store", f"{base}/out", f"{base}/ckpt", splits=4, buckets=8).awaitTermination()
    return live.latest(spark, f"{base}/out").select("source_id", "leaf_id", "branch_len")
