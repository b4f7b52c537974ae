"""Combining thread stores. A thread is replaced or taken as a whole, by its source id."""

from __future__ import annotations

from pyspark.sql import DataFrame


def upsert(stored: DataFrame, new: DataFrame, key: str = "source_id") -> DataFrame:
    """Stored threads, those that occur in ``new`` replaced, and the new ones."""
    return stored.join(new.select(key).distinct(), key, "left_anti").unionByName(new.select(*stored.columns))


def merge(a: DataFrame, b: DataFrame, key: str = "source_id") -> DataFrame:
    """All of ``a`` and those threads of ``b`` that ``a`` does not have."""
    return a.unionByName(b.join(a.select(key).distinct(), key, "left_anti").select(*a.columns))


def union_corpora(parts: dict[str, DataFrame]) -> DataFrame:
    """Union with the name of each part in column ``corpus``."""
    from pyspark.sql import functions as F

    out = None
    for name, part in parts.items():
        part = part.withColumn("corpus", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out
