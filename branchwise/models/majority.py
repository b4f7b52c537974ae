"""Baseline that always answers with the most frequent label."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from branchwise.operators.metrics import majority_label


def fit(train: DataFrame, label: str = "veracity", by: Sequence[str] = ()) -> DataFrame:
    """One row (per group) with column ``predicted``."""
    return majority_label(train, label, by).select(*by, F.col(label).alias("predicted"))


def predict(test: DataFrame, fitted: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    if by:
        return test.join(fitted, list(by), "left")
    return test.withColumn("predicted", fitted.scalar())
