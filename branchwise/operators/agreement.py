"""Annotator agreement and label integration."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def agreement(annotations: DataFrame, item: list[str]) -> DataFrame:
    """Per item: number of annotators, whether all gave the same label set, and that set.

    ``annotations`` has user and label. A user's label set is bounded by the label scheme; sets are
    compared through their smallest and largest member, so items are never gathered.
    """
    per_user = annotations.groupBy(*item, "user").agg(F.array_sort(F.collect_set("label")).alias("labels"))
    return (per_user.groupBy(*item)
            .agg(F.count(F.lit(1)).alias("n_users"), F.min("labels").alias("_lo"), F.max("labels").alias("_hi"))
            .select(*item, "n_users", (F.col("_lo") == F.col("_hi")).alias("agree"),
                    F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")).alias("labels")))


def split_by_agreement(annotations: DataFrame, item: list[str]) -> tuple[DataFrame, DataFrame]:
    """Agreed items with their labels, and the annotations of all other items."""
    judged = agreement(annotations, item)
    agreed = judged.where("agree").drop("agree")
    return agreed, annotations.join(judged.where("not agree").select(*item), item, "left_semi")


def integrate(messages: DataFrame, labels: DataFrame, on: list[str], columns: list[str]) -> DataFrame:
    """Write label columns back; a message without an annotation keeps its own values.

    Among several annotations of one key the first by ``item_id`` counts.
    """
    first = (labels.groupBy(*on).agg(F.min(F.struct("item_id", *columns)).alias("_l"))
             .select(*on, *[F.col(f"_l.{c}").alias("_new_" + c) for c in columns], F.lit(True).alias("_hit")))
    joined = messages.join(first, on, "left")
    return joined.select(*[
        F.when(F.col("_hit"), F.coalesce(F.col("_new_" + c), F.col(c))).otherwise(F.col(c)).alias(c)
        if c in columns else F.col(c) for c in messages.columns])
