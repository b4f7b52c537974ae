"""Label statistics and classification metrics as plain aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def label_histogram(df: DataFrame, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Count and share per label (within ``by``)."""
    counts = df.groupBy(*by, label).agg(F.count(F.lit(1)).alias("n"))
    if not by:
        total = counts.agg(F.sum("n").alias("t")).scalar()
        return counts.withColumn("share", F.col("n") / total)
    totals = counts.groupBy(*by).agg(F.sum("n").alias("_t"))
    return counts.join(totals, list(by)).withColumn("share", F.col("n") / F.col("_t")).drop("_t")


def majority_label(df: DataFrame, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Most frequent label, the smallest one on a tie."""
    counts = df.where(F.col(label).isNotNull()).groupBy(*by, label).agg(F.count(F.lit(1)).alias("n"))
    best = F.max(F.struct(F.col("n"), (-F.col(label)).alias("neg"))).alias("_b")
    return counts.groupBy(*by).agg(best).select(*by, (-F.col("_b.neg")).alias(label), F.col("_b.n").alias("n"))


def confusion(df: DataFrame, labels: Sequence[int], actual: str = "actual", predicted: str = "predicted",
              by: Sequence[str] = ()) -> DataFrame:
    """Long confusion matrix with a row for every cell, zeros included."""
    counted = (df.where(F.col(actual).isin(*labels) & F.col(predicted).isin(*labels))
               .groupBy(*by).agg(*[F.sum(((F.col(actual) == a) & (F.col(predicted) == p)).cast("long")).alias(f"c_{a}_{p}")
                                   for a in labels for p in labels]))
    cells = [F.struct(F.lit(a).alias("actual"), F.lit(p).alias("predicted"),
                      F.coalesce(F.col(f"c_{a}_{p}"), F.lit(0).cast("long")).alias("n"))
             for a in labels for p in labels]
    return counted.select(*by, F.inline(F.array(*cells)))


def class_accuracy(df: DataFrame, labels: Sequence[int], by: Sequence[str] = ()) -> DataFrame:
    """Share of each actual class that is predicted right; NULL for an absent class."""
    cells = confusion(df, labels, by=by)
    hit = F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0))
    return cells.groupBy(*by, "actual").agg(F.try_divide(hit, F.sum("n")).alias("accuracy"))


def level_scores(df: DataFrame, levels: Sequence[str], positive: int = 1) -> DataFrame:
    """``scores`` over all rows and over every subset of ``levels`` at once; a level that a row sums over is null, and has its bit in ``level`` set.

    Rows collapse to cells of the finest level once; the coarser ones add up cells.
    """
    cells = df.groupBy(*levels, "actual", "predicted").agg(F.count(F.lit(1)).alias("n"))
    sets = [[c for i, c in enumerate(levels) if not mask >> (len(levels) - 1 - i) & 1] for mask in range(1 << len(levels))]
    all_levels = cells.groupingSets([[*s, "actual", "predicted"] for s in sets], *levels, "actual", "predicted").agg(
        F.sum("n").alias("n"), F.shiftright(F.grouping_id(), 2).alias("level"))
    return _from_cells(all_levels, ["level", *levels], positive)


def scores(df: DataFrame, by: Sequence[str] = (), positive: int = 1) -> DataFrame:
    """accuracy, precision and recall of class ``positive``, macro and micro F1 per group.

    Macro averages run over the labels that occur as actual or predicted value. A ratio without a
    denominator counts as 0. One shuffle: rows collapse to cells of the confusion matrix first.
    """
    return _from_cells(df.groupBy(*by, "actual", "predicted").agg(F.count(F.lit(1)).alias("n")), by, positive)


def _from_cells(cells: DataFrame, by: Sequence[str], positive: int) -> DataFrame:
    same = F.col("actual") == F.col("predicted")
    per_row = cells.select(*by, F.inline(F.when(same, F.array(
        F.struct(F.col("actual").alias("label"), F.col("n").alias("tp"), F.lit(0).cast("long").alias("fn"),
                 F.lit(0).cast("long").alias("fp")))).otherwise(F.array(
            F.struct(F.col("actual").alias("label"), F.lit(0).cast("long").alias("tp"), F.col("n").alias("fn"),
                     F.lit(0).cast("long").alias("fp")),
            F.struct(F.col("predicted").alias("label"), F.lit(0).cast("long").alias("tp"),
                     F.lit(0).cast("long").alias("fn"), F.col("n").alias("fp"))))))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    per_label = (per_row.groupBy(*by, "label").agg(F.sum("tp").alias("tp"), F.sum("fn").alias("fn"), F.sum("fp").alias("fp"))
                 .withColumn("p", ratio(F.col("tp"), F.col("tp") + F.col("fp")))
                 .withColumn("r", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
                 .withColumn("f1", ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))))
    pick = lambda c: F.coalesce(F.max(F.when(F.col("label") == positive, F.col(c))), F.lit(0.0))
    accuracy = F.sum("tp") / F.sum(F.col("tp") + F.col("fn"))
    return per_label.groupBy(*by).agg(
        F.avg("f1").alias("f1_macro"), accuracy.alias("f1_micro"), accuracy.alias("accuracy"),
        pick("p").alias("precision"), pick("r").alias("recall"),
        F.avg("p").alias("precision_macro"), F.avg("r").alias("recall_macro"))


METRICS = ["f1_macro", "f1_micro", "accuracy", "precision", "recall"]


def fold_means(per_fold: DataFrame, by: Sequence[str], folds: int | None = None) -> DataFrame:
    """Mean over folds; with ``folds`` the sum is divided by that number even if some are absent."""
    mean = (lambda c: F.sum(c) / folds) if folds else F.avg
    return per_fold.groupBy(*by).agg(*[mean(F.col(c)).alias(c) for c in METRICS])


def learning_curve(epochs: DataFrame, params: Sequence[str]) -> DataFrame:
    """(params, epoch, f1_macro), one row per point; the reader sorts what it shows."""
    return epochs.select(*params, "epoch", "f1_macro")


def best_epoch(epochs: DataFrame, params: Sequence[str]) -> DataFrame:
    """Epoch with the highest macro F1, the earliest on a tie."""
    best = F.max(F.struct(F.col("f1_macro"), (-F.col("epoch")).alias("neg"))).alias("_b")
    return epochs.groupBy(*params).agg(best).select(
        *params, (-F.col("_b.neg")).alias("epoch"), F.col("_b.f1_macro").alias("f1_macro"))
