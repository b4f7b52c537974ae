"""Word-list counts, sentiment sums and part-of-speech vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from branchwise.functions.text import explode_positions

# Universal part-of-speech tags in slot order.
POS_TAGS = ["ADJ", "ADP", "ADV", "AUX", "CONJ", "DET", "INTJ", "NOUN", "NUM", "PART", "PRON",
            "PROPN", "PUNCT", "SCONJ", "SYM", "VERB", "X"]

LEXICON_FEATURES = ["swear_count", "negation_count", "positive_smiley_count", "negative_smiley_count"]


MAX_TERMS = 1_000_000


def as_dimension(table: DataFrame, limit: int = MAX_TERMS) -> DataFrame:
    """``table`` marked for broadcasting if it was counted to hold at most ``limit`` rows.

    Lists made of local rows have no statistics, so without the mark the texts could be broadcast in
    their place. A longer list is joined by shuffling.
    """
    return F.broadcast(table) if table.limit(limit + 1).count() <= limit else table


def term_sums(df: DataFrame, key: list[str], terms: dict[str, Column], table: DataFrame, names: list[str]) -> DataFrame:
    """Per message and name the sum of scores of the terms found; only messages with a hit appear.

    ``terms`` maps a kind (which texts are cut into which terms) to an array column, ``table`` has (kind, term,
    name, score): one pass over the texts serves any number of lists.
    """
    def marked(kind: str):
        return lambda term: F.struct(F.lit(kind).alias("kind"), term.alias("term"))

    cut = [F.transform(column, marked(kind)) for kind, column in terms.items()]
    spread = df.select(*key, F.inline(F.concat(*cut)))
    hits = spread.join(as_dimension(table), ["kind", "term"])
    return hits.groupBy(*key).agg(*[F.sum(F.when(F.col("name") == n, F.col("score"))).alias(n) for n in names]).fillna(0, names)


def list_terms(lexicon: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """(list, word) as (kind, term, name, score 1); ``kinds`` names the kind of each list to use."""
    kind = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])[F.col("list")]
    return (lexicon.where(F.col("list").isin(*kinds)).select(kind.alias("kind"), F.col("word").alias("term"), F.col("list").alias("name"))
            .distinct().withColumn("score", F.lit(1).cast("long")))


def lexicon_counts(df: DataFrame, key: list[str], terms: Column, lexicon: DataFrame,
                   lists: list[str]) -> DataFrame:
    """Per message the number of terms found in each list of ``lexicon`` (list, word)."""
    return term_sums(df, key, {"term": terms}, list_terms(lexicon, {n: "term" for n in lists}), lists)


def sentiment(df: DataFrame, key: list[str], terms: Column, scores: DataFrame) -> DataFrame:
    """Sum of term scores per message; ``scores`` has (term, score)."""
    table = scores.select(F.lit("term").alias("kind"), "term", F.lit("sentiment").alias("name"), "score")
    return term_sums(df, key, {"term": terms}, table, ["sentiment"])


def attach_counts(df: DataFrame, counts: DataFrame, key: list[str], names: list[str]) -> DataFrame:
    """Left join with zeros for messages without a hit."""
    return df.join(counts, key, "left").fillna(0, names)


def pos_occurrence(tags: Column) -> Column:
    """17 slots, 1 where the tag occurs."""
    return F.array(*[F.coalesce(F.array_contains(tags, t), F.lit(False)).cast("int") for t in POS_TAGS])


def pos_tag_lines(lines: DataFrame, key: str, tokens: Column, tagger: DataFrame) -> DataFrame:
    """Tag each line by a (token, tag) table: key, tags in token order; unknown tokens are X."""
    spread = explode_positions(lines, [key], tokens, "token")
    tagged = spread.join(as_dimension(tagger), "token", "left").select(
        key, F.struct("pos", F.coalesce("tag", F.lit("X")).alias("tag")).alias("t"))
    ordered = F.transform(F.array_sort(F.collect_list("t")), lambda t: t["tag"])
    return tagged.groupBy(key).agg(ordered.alias("tags"))
