"""Timestamps and time features."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def tweet_time(text: Column) -> Column:
    """``Wed Aug 27 13:08:45 +0000 2008``, kept as written: the offset is read and dropped."""
    without_offset = F.concat(F.substring(text, 5, 15), F.lit(" "), F.regexp_extract(text, r"(\d{4})\s*$", 1))
    return F.try_to_timestamp(without_offset, F.lit("MMM dd HH:mm:ss yyyy"))


def reddit_time(text: Column) -> Column:
    return F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss"))


def hours_between(start: Column, end: Column) -> Column:
    return (F.unix_micros(end) - F.unix_micros(start)) / F.lit(3.6e9)


def log_hours(earliest: Column, created: Column) -> Column:
    """log10 of the hours since the first message of the branch, plus one."""
    return F.log10(hours_between(earliest, created) + 1)


def scaled_time(earliest: Column, latest: Column, created: Column) -> Column:
    """Place between the first (0) and last (1) message; 0 when they coincide."""
    return F.coalesce(F.try_divide(hours_between(earliest, created), hours_between(earliest, latest)), F.lit(0.0))
