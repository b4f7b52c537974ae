"""A stance classifier trained epoch by epoch, all points of a grid in the same passes, resumable after each epoch.

A model is a softmax layer on the features, with a hidden layer of rectified units if asked. In a step every partition adds up the gradients of
all models over its rows of the step's mini-batch; the sums are added in two rounds, so no task sees a row per partition. The driver updates
the weights (Adam). After an epoch weights and moments are written as a version of a store: training goes on from the last one
that was committed, so epoch n always starts from epoch n - 1, also in another session.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from branchwise.operators.metrics import scores
from branchwise.session import durable
from branchwise.sources import store

CLASSES = 4
BETAS = (0.9, 0.999)


@dataclass(frozen=True)
class Setting:
    """A point of the grid."""

    hidden: int = 0
    rate: float = 0.05
    decay: float = 1e-4

    def __str__(self) -> str:
        return f"hidden={self.hidden},rate={self.rate:g},decay={self.decay:g}"

    def shapes(self, width: int) -> list[tuple[int, int]]:
        """Layers, each with a row for the constant."""
        sizes = [width, *([self.hidden] if self.hidden else []), CLASSES]
        return [(a + 1, b) for a, b in zip(sizes, sizes[1:])]

    def start(self, width: int, seed: int) -> np.ndarray:
        rng = np.random.default_rng(seed)
        return np.concatenate([(rng.standard_normal(s) / np.sqrt(s[0])).ravel() for s in self.shapes(width)])

    def layers(self, weights: np.ndarray, width: int) -> list[np.ndarray]:
        out, at = [], 0
        for a, b in self.shapes(width):
            out.append(weights[at:at + a * b].reshape(a, b))
            at += a * b
        return out


def _with_constant(x: np.ndarray) -> np.ndarray:
    return np.concatenate((x, np.ones((len(x), 1))), axis=1)


def probabilities(setting: Setting, weights: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Class probabilities of each row, and what enters each layer."""
    entered, here = [], x
    for i, layer in enumerate(setting.layers(weights, x.shape[1])):
        entered.append(_with_constant(here))
        here = entered[-1] @ layer
        if i < len(setting.shapes(x.shape[1])) - 1:
            here = np.maximum(here, 0.0)
    here = np.exp(here - here.max(1, keepdims=True))
    return here / here.sum(1, keepdims=True), entered


def gradient(setting: Setting, weights: np.ndarray, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Sum over rows of the gradient of the weighted log loss, followed by the loss and the weight."""
    p, entered = probabilities(setting, weights, x)
    loss = -(np.log(np.maximum(p[np.arange(len(y)), y], 1e-12)) * weight).sum()
    back = p.copy()
    back[np.arange(len(y)), y] -= 1.0
    back *= weight[:, None]
    parts, layers = [], setting.layers(weights, x.shape[1])
    for inputs, layer in zip(reversed(entered), reversed(layers)):
        parts.append((inputs.T @ back).ravel())
        back = (back @ layer[:-1].T) * (inputs[:, :-1] > 0)
    return np.concatenate([*reversed(parts), [loss, weight.sum()]])


def _sums(rows: DataFrame, settings: Sequence[Setting], weights: Sequence[np.ndarray]) -> list[np.ndarray]:
    """Gradient sums of every setting over ``rows`` (features array<double>, stance, weight)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = None
        for batch in batches:
            if batch.num_rows:
                x = batch.column(0).flatten().to_numpy().reshape(batch.num_rows, -1)
                found = [gradient(s, w, x, batch.column(1).to_numpy().astype(int), batch.column(2).to_numpy()) for s, w in zip(settings, weights)]
                totals = found if totals is None else [a + b for a, b in zip(totals, found)]
        if totals is not None:
            part = TaskContext.get().partitionId() % 64
            yield pa.RecordBatch.from_arrays([pa.array(range(len(totals)), pa.int32()), pa.array([part] * len(totals), pa.int32()),
                                              pa.array([t.tolist() for t in totals], pa.list_(pa.float64()))], ["setting", "part", "sums"])

    add = lambda pdf: pd.DataFrame({"setting": pdf["setting"].iloc[:1], "part": [0], "sums": [np.sum(np.stack(pdf["sums"].to_list()), axis=0).tolist()]})
    kind = "setting int, part int, sums array<double>"
    partial = rows.select("features", "stance", "weight").mapInArrow(run, kind)
    both = partial.groupBy("setting", "part").applyInPandas(add, kind).groupBy("setting").applyInPandas(add, kind).collect()  # a row per setting
    return [np.array(r["sums"]) for r in sorted(both, key=lambda r: r["setting"])]


def _judged(rows: DataFrame, settings: Sequence[Setting], weights: Sequence[np.ndarray]) -> DataFrame:
    """setting, actual, predicted of every row under every setting."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column(0).flatten().to_numpy().reshape(batch.num_rows, -1)
                for i, (s, w) in enumerate(zip(settings, weights)):
                    yield pa.RecordBatch.from_arrays([pa.array([i] * len(x), pa.int32()), batch.column(1).cast(pa.int32()),
                                                      pa.array(probabilities(s, w, x)[0].argmax(1), pa.int32())], ["setting", "actual", "predicted"])

    return rows.select("features", "stance").mapInArrow(run, "setting int, actual int, predicted int")


def weighted(rows: DataFrame) -> DataFrame:
    """Rows with ``weight``, the inverse frequency of their class: most messages only comment."""
    known = rows.where("stance is not null")
    n = known.groupBy("stance").agg(F.count(F.lit(1)).alias("_n"))
    total = n.agg(F.sum("_n") / F.count(F.lit(1))).scalar()
    return known.join(n.withColumn("weight", total / F.col("_n")).drop("_n"), "stance")


def last_epoch(spark: SparkSession, path: str) -> tuple[int, dict[str, tuple]]:
    """The last committed epoch (-1 without one) and, by setting, its weights, moments and number of steps."""
    done = store.committed(spark, path)
    if not done:
        return -1, {}
    rows = spark.read.parquet(done[-1]).collect()  # a row per setting
    return int(done[-1].rsplit("=", 1)[1]), {r["params"]: (np.array(r["weights"]), np.array(r["first"]), np.array(r["second"]), r["steps"]) for r in rows}


def train(rows: DataFrame, held_out: DataFrame, settings: Sequence[Setting], epochs: int, path: str, batches: int = 4, seed: int = 42) -> DataFrame:
    """Train up to epoch ``epochs`` (from the last one in ``path``) and give the epoch table: params, epoch, loss and scores on ``held_out``.

    ``rows`` and ``held_out`` have msg_id, features (array<double>) and stance. A message stays in its mini-batch in every epoch.
    """
    spark = rows.sparkSession
    batch = F.pmod(F.xxhash64("msg_id", F.lit(seed)), F.lit(batches)).cast("int")
    table = durable(weighted(rows).select("features", "stance", "weight", batch.alias("batch")).repartition("batch", F.xxhash64("features")))
    judged_rows = durable(held_out.where("stance is not null").select("features", "stance"))
    width = len(table.select("features").first()[0])
    at, known = last_epoch(spark, path)
    state = [known.get(str(s)) or (s.start(width, seed), *np.zeros((2, len(s.start(width, seed)))), 0) for s in settings]
    for epoch in range(at + 1, epochs):
        losses = np.zeros(len(settings))
        for b in range(batches):
            sums = _sums(table.where(F.col("batch") == b), settings, [s[0] for s in state])
            for i, (setting, total) in enumerate(zip(settings, sums)):
                weights, first, second, steps = state[i]
                slope = total[:-2] / max(total[-1], 1e-12) + setting.decay * weights
                steps += 1
                first, second = BETAS[0] * first + (1 - BETAS[0]) * slope, BETAS[1] * second + (1 - BETAS[1]) * slope * slope
                move = (first / (1 - BETAS[0] ** steps)) / (np.sqrt(second / (1 - BETAS[1] ** steps)) + 1e-8)
                state[i] = (weights - setting.rate * move, first, second, steps)
                losses[i] += total[-2]
        measured = {r["setting"]: r for r in scores(_judged(judged_rows, settings, [s[0] for s in state]), ["setting"]).collect()}
        of = lambda i: [float(measured[i][c]) if i in measured else None for c in ("accuracy", "f1_macro", "f1_micro")]
        rows_of = [(str(s), epoch, float(loss), *of(i), w.tolist(), a.tolist(), b.tolist(), int(n)) for i, (s, loss, (w, a, b, n)) in enumerate(zip(settings, losses, state))]
        store.append(spark.createDataFrame(rows_of, "params string, epoch int, loss double, accuracy double, f1_macro double, f1_micro double, "
                                                    "weights array<double>, first array<double>, second array<double>, steps int").coalesce(1), path, epoch)
    return store.versions(spark, path).where(F.col("epoch") < epochs).select("params", "epoch", "loss", "accuracy", "f1_macro", "f1_micro")
