"""Folds and train/test splits with exact sizes, free of any single-task sort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from branchwise.operators.skew import rank_by_bucket


def shuffled(keys: list[str], seed: int = 42) -> tuple[Column, list[Column]]:
    """Leading bucket and full sort order of a seeded shuffle by row key."""
    h = F.xxhash64(F.lit(seed), *[F.col(k) for k in keys])
    return F.shiftrightunsigned(h, 52).cast("int"), [F.shiftrightunsigned(h, 1), *[F.col(k) for k in keys]]


def kfold(df: DataFrame, k: int, bucket: Column, order: list[Column], by: Sequence[str] = ()) -> DataFrame:
    """Column ``fold``: test fold of a row (within ``by``). The last ``n mod k`` rows are in no test fold (NULL)."""
    ranked = rank_by_bucket(df, list(by), bucket, order, "_rn")
    if by:
        sizes = df.groupBy(*by).agg(F.floor(F.count(F.lit(1)) / k).alias("_size"))
        ranked = ranked.join(sizes, list(by))
    else:
        ranked = ranked.withColumn("_size", F.floor(df.agg(F.count(F.lit(1)).alias("n")).scalar() / k))
    fold = F.floor(F.try_divide(F.col("_rn"), F.col("_size"))).cast("int")
    return ranked.withColumn("fold", F.when(fold < k, fold)).drop("_rn", "_size")


def holdout(df: DataFrame, share: float, bucket: Column, order: list[Column]) -> DataFrame:
    """Column ``is_test``: true for exactly floor(n * share) rows."""
    size = F.floor(df.agg(F.count(F.lit(1)).alias("n")).scalar() * share)
    return (rank_by_bucket(df, [], bucket, order, "_rn")
            .withColumn("is_test", F.col("_rn") < size).drop("_rn"))


def stratified(df: DataFrame, by: str, share: float, bucket: Column, order: list[Column]) -> DataFrame:
    """Column ``is_test``: round(n * share) rows of every class."""
    sizes = df.groupBy(by).agg(F.round(F.count(F.lit(1)) * share).cast("long").alias("_size"))
    return (rank_by_bucket(df, [by], bucket, order, "_rn").join(sizes, by)
            .withColumn("is_test", F.col("_rn") < F.col("_size")).drop("_rn", "_size"))
