"""Codes, label names and the declared input schemas (nothing is inferred from data)."""

from __future__ import annotations

from pyspark.sql import types as T

# Label codes of the stored data.
STANCE_CODES = {"Supporting": 0, "Denying": 1, "Querying": 2, "Commenting": 3}
VERACITY_CODES = {"False": 0, "True": 1, "Unverified": 2}
UNSPECIFIED = "Underspecified"
COMMENTING = STANCE_CODES["Commenting"]

S, L, B, D, I = T.StringType(), T.LongType(), T.BooleanType(), T.DoubleType(), T.IntegerType()


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


REDDIT_USER = struct(
    id=S, created=S, karma=L, gold_status=B, is_employee=B, has_verified_email=B)

REDDIT_SUBMISSION = struct(
    submission_id=S, title=S, text=S, created=S, num_comments=L, url=S, text_url=S, upvotes=L,
    is_video=B, user=REDDIT_USER, subreddit=S, comments=S, IsRumour=B, TruthStatus=S,
    RumourDescription=S, SourceSDQC=S)

REDDIT_COMMENT = struct(
    comment_id=S, text=S, parent_id=S, comment_url=S, created=S, upvotes=L, is_submitter=B,
    is_deleted=B, replies=L, user=REDDIT_USER, submission_id=S, SDQC_Submission=S, SDQC_Parent=S,
    Certainty=S, Evidentiality=S, AnnotatedAt=S)

REDDIT_THREAD = struct(
    redditSubmission=REDDIT_SUBMISSION,
    branches=T.ArrayType(T.ArrayType(struct(comment=REDDIT_COMMENT))))

TWEET = struct(
    id_str=S, full_text=S, text=S, created_at=S, lang=S,
    in_reply_to_status_id=S, in_reply_to_status_id_str=S, children=T.ArrayType(S),
    SDQC_Submission=S, SDQC_Parent=S, SourceSDQC=S, TruthStatus=S,
    entities=struct(hashtags=T.ArrayType(struct(text=S))), coordinates=struct(coordinates=T.ArrayType(D)),
    retweeted_status=struct(id_str=S))

STANCE_ANNOTATION = T.StructType([
    T.StructField("tweetid", S), T.StructField("responsetype-vs-source", S)])

MESSAGE_COLUMNS = [
    "corpus", "event", "source_id", "msg_id", "parent_id", "is_source", "title", "text_raw",
    "text", "tokens", "created", "sdqc", "sdqc_parent", "is_rumour", "truth", "ord"]
