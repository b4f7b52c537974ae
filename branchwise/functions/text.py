"""Masking, tokenising and per-message text features as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Masking tags and patterns that must equal those behind the stored feature tables.
URL_TAG = "urlurlurl"
REF_TAG = "refrefref"
TWEET_URL = r"https://t\.co/*?"
TWEET_MENTION = r"@[^\n]*? "
REDDIT_QUOTE = r">([^\n]+?)\n"
REDDIT_URL = r"([(\[]?(https?://)|(https?://www.)|(www.))(?:[a-zæøåA-ZÆØÅ]|[0-9]|[$-_@.&+]|[!*(),]|(?:%[0-9a-fA-F][0-9a-fA-F]))+"
CAPITAL_RUN = "[A-ZÆØÅ]+"
KEPT_TOKEN = "^[a-zæøå0-9]"

# Our tokeniser: words with inner apostrophes or hyphens; tweets keep punctuation marks as tokens.
WORD = r"[\p{L}\p{N}]+(?:['’-][\p{L}\p{N}]+)*"
WORD_OR_MARK = r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"
SPACES = r"[\s\x0B\x1c-\x1f\x{85}\p{Z}]+"

COUNT_FEATURES = ["url_count", "trip_dot_count", "q_mark_count", "e_mark_count", "cap_count",
                  "txt_len", "tokens_len", "avg_word_len", "cap_sequence_max_len", "quote_count"]
FLAG_FEATURES = ["period", "e_mark", "q_mark", "has_trip_dot"]


def strip_newlines(text: Column, by: str = "") -> Column:
    return F.replace(text, F.lit("\n"), F.lit(by))


def mask_tweet(text: Column) -> Column:
    """URLs, then mentions, in text without line breaks."""
    plain = strip_newlines(text)
    urls = F.regexp_replace(plain, TWEET_URL, URL_TAG + " ")
    return F.regexp_replace(urls, TWEET_MENTION, REF_TAG + " ")


def mask_reddit(text: Column, quotes: bool = True) -> Column:
    """Quotes, line breaks, then URLs.

    A quote ends at a line break, so it must be masked first; ``quotes=False`` skips it, which
    gives the texts behind the published feature tables.
    """
    if quotes:
        text = F.regexp_replace(text, REDDIT_QUOTE, REF_TAG)
    return F.regexp_replace(strip_newlines(text), REDDIT_URL, URL_TAG)


def explode_terms(df: DataFrame, key: list[str], terms: Column, name: str = "term", keep_empty: bool = False) -> DataFrame:
    """One row per term. The outer form is used on purpose: for the inner one the optimiser adds a
    filter that computes ``terms`` again, a whole tokenisation more per row."""
    rows = df.select(*key, F.explode_outer(terms).alias(name))
    return rows if keep_empty else rows.where(F.col(name).isNotNull())


def explode_positions(df: DataFrame, key: list[str], terms: Column, name: str = "term") -> DataFrame:
    return df.select(*key, F.posexplode_outer(terms).alias("pos", name)).where(F.col(name).isNotNull())


def word_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def reddit_tokens(text: Column) -> Column:
    """Words; those whose first letter is outside a-z, æ, ø, å and digits are dropped."""
    return F.filter(word_tokens(text), lambda t: t.rlike(KEPT_TOKEN))


def tweet_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD_OR_MARK), F.lit(0))


def words(text: Column) -> Column:
    """Whitespace-separated words."""
    return F.filter(F.split(text, SPACES), lambda w: w != "")


def title_fallback(text: Column, title: Column) -> Column:
    return F.coalesce(F.nullif(text, F.lit("")), title)


def preview(text: Column, n: int = 200) -> Column:
    return F.left(text, F.lit(n))


def pair_text(source: Column, reply: Column) -> Column:
    return F.concat(F.lit("Source: "), source, F.lit("\n\nReply: "), reply)


def token_count(tokens: Column, token: str) -> Column:
    return F.size(F.filter(tokens, lambda t: t == token))


def flags(text: Column) -> dict[str, Column]:
    """0/1 features."""
    asks = F.contains(text, F.lit("?")) | F.exists(words(text), lambda w: F.startswith(w, F.lit("hv")))
    return {
        "period": F.contains(text, F.lit(".")).cast("int"),
        "e_mark": F.contains(text, F.lit("!")).cast("int"),
        "q_mark": asks.cast("int"),
        "has_trip_dot": F.contains(text, F.lit("...")).cast("int"),
    }


def counts(text: Column, tokens: Column) -> dict[str, Column]:
    """Raw counts, to be normalised over the data set. Token lengths are NULL without tokens."""
    n = F.size(tokens)
    some = n > 0
    letters = F.aggregate(tokens, F.lit(0), lambda acc, t: acc + F.length(t))
    runs = F.transform(F.regexp_extract_all(text, F.lit(CAPITAL_RUN), F.lit(0)), F.length)
    return {
        "url_count": token_count(tokens, URL_TAG),
        "trip_dot_count": ((F.length(text) - F.length(F.replace(text, F.lit("..."), F.lit("")))) / 3).cast("int"),
        "q_mark_count": F.regexp_count(text, F.lit("[?]")),
        "e_mark_count": F.regexp_count(text, F.lit("!")),
        "cap_count": F.regexp_count(text, F.lit(r"\p{Lu}")),
        "txt_len": F.length(text),
        "tokens_len": F.when(some, n),
        "avg_word_len": F.when(some, letters / n),
        "cap_sequence_max_len": F.coalesce(F.array_max(runs), F.lit(0)),
        "quote_count": token_count(tokens, REF_TAG),
    }
