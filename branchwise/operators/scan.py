"""Prefix and suffix products of small matrices along an order, in a logarithmic number of joins.

A sequence kept in many parts is a product of one matrix per part. Round r joins every part with the one 2**r places before (and behind) it,
so after log2(parts) rounds each part has the product of all up to it (and of all from it on), and no task ever holds a sequence. Products are scaled to a sum of
one, the logarithm of what was taken out goes along.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from branchwise.operators.skew import rank_rows
from branchwise.session import durable


def times(left: Column, right: Column) -> Column:
    """Product of two square matrices, each an array in row-major order."""
    side = F.sqrt(F.size(left)).cast("int")
    cell = lambda i: F.aggregate(
        F.sequence(F.lit(0), side - 1), F.lit(0.0),
        lambda acc, j: acc + F.get(left, (F.floor(i / side) * side + j).cast("int")) * F.get(right, (j * side + i % side).cast("int")))
    return F.transform(F.sequence(F.lit(0), F.size(left) - 1), cell)


def _total(matrix: Column) -> Column:
    return F.aggregate(matrix, F.lit(0.0), lambda acc, x: acc + x)


def _scaled(df: DataFrame, matrix: str, log: str) -> DataFrame:
    return (df.withColumn("_sum", _total(F.col(matrix))).withColumn(log, F.col(log) + F.ln("_sum"))
            .withColumn(matrix, F.transform(matrix, lambda x: x / F.col("_sum"))).drop("_sum"))


def products(parts: DataFrame, keys: Sequence[str], suffix: bool = False) -> DataFrame:
    """``parts`` (keys, part, mat, log) with ``place`` from 0, ``n_parts``, ``pre`` and ``pre_log``, the product up to and with the part.

    With ``suffix`` also ``suf`` and ``suf_log``, the product from the part on. Parts of a key may have gaps in their numbers.
    """
    ranked = rank_rows(durable(parts), list(keys), [F.col("part")], "place")
    sizes = ranked.groupBy(*keys).agg(F.max("place").alias("_last"))
    table = durable(_scaled(ranked, "mat", "log").join(sizes, list(keys)).withColumn("n_parts", F.col("_last") + 1).drop("_last")
                    .withColumn("pre", F.col("mat")).withColumn("pre_log", F.col("log"))
                    .withColumn("suf", F.col("mat")).withColumn("suf_log", F.col("log")))
    longest = table.agg(F.max("n_parts")).first()[0] or 0
    step = 1
    while step < longest:
        shifted = lambda by, matrix, log: table.select(
            *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], (F.col("place") + by).alias("_at"), F.col(matrix).alias("_mat"), F.col(log).alias("_log"))
        grown = table
        for matrix, log, by in (("pre", "pre_log", step), ("suf", "suf_log", -step))[:2 if suffix else 1]:
            other = shifted(by, matrix, log)
            same = [F.col(k) == F.col(f"_k{i}") for i, k in enumerate(keys)] + [F.col("place") == F.col("_at")]
            both = times(F.col("_mat"), F.col(matrix)) if by > 0 else times(F.col(matrix), F.col("_mat"))
            grown = (grown.join(other, same, "left")
                     .withColumn(matrix, F.when(F.col("_mat").isNull(), F.col(matrix)).otherwise(both))
                     .withColumn(log, F.col(log) + F.coalesce("_log", F.lit(0.0))).select(*table.columns))
            grown = _scaled(grown, matrix, log)
        table = durable(grown)
        step *= 2
    return table if suffix else table.drop("suf", "suf_log")
