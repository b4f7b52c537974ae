"""Approximate nearest neighbours by random hyperplanes: several tables, several probes, exact ranking of what they find.

Every vector is in one bucket of each table, named by the sides of the table's hyperplanes it lies on. A query looks into its own bucket
and those behind the planes it lies nearest to. Only pairs from a looked-up bucket are formed, with both vectors, and ranked by their exact cosine there; what is
passed on is the best of each query and table.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from branchwise.operators.embed import unit
from branchwise.functions.vectors import dot

TABLES = 12
PROBES = 3
#: Vectors that a bucket holds on average.
BUCKET = 64


def _signatures(vectors: DataFrame, planes: np.ndarray, probes: int) -> DataFrame:
    """token, vector, table, bucket: the own bucket, and with ``probes`` those behind any of so many nearest planes."""
    tables, bits, dim = planes.shape
    weights = 1 << np.arange(bits)
    flips = [c for n in range(min(probes, bits) + 1) for c in combinations(range(min(probes, bits)), n)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(-1, dim)
            side = np.einsum("nd,tbd->ntb", x, planes)
            own = ((side > 0) * weights).sum(-1)
            near = weights[np.argsort(np.abs(side), axis=-1)]  # planes by distance
            found = np.stack([own ^ sum((near[..., i] for i in c), np.zeros_like(own)) for c in flips], axis=-1)
            n, t, f = found.shape
            for at in range(0, n, 1000):
                some = found[at:at + 1000]
                copies = pa.array(np.repeat(np.arange(at, at + len(some)), t * f))
                table = np.tile(np.repeat(np.arange(t), f), len(some))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(copies), batch.column(1).take(copies), pa.array(table, pa.int32()),
                                                  pa.array(some.ravel(), pa.int64())], ["token", "vector", "table", "bucket"])

    kind = vectors.schema["token"].dataType.simpleString()
    return vectors.select("token", "vector").mapInArrow(run, f"token {kind}, vector array<double>, table int, bucket long")


def approximate_neighbours(vectors: DataFrame, queries: DataFrame, k: int = 10, tables: int = TABLES, probes: int = PROBES,
                           bucket: int = BUCKET, seed: int = 42) -> DataFrame:
    """word, rank, neighbour, similarity: about the ``k`` nearest of ``vectors`` (token, vector) by cosine, for each of ``queries``, itself left out.

    Every vector is indexed; the number of planes grows with the table, so buckets stay small.
    """
    rows, asked = unit(vectors), unit(queries)
    n = vectors.count()
    dim = len(vectors.select("vector").first()[0]) if n else 1
    bits = max(1, round(np.log2(max(2, n / bucket))))
    planes = np.random.default_rng(seed).standard_normal((tables, bits, dim))
    index = _signatures(rows, planes, 0).withColumnsRenamed({"token": "neighbour", "vector": "_v"})
    probed = _signatures(asked, planes, probes).withColumnsRenamed({"token": "word", "vector": "_q"})
    # sorted into buckets on both sides: neither is sent whole to every task
    scored = (probed.join(index.hint("merge"), ["table", "bucket"]).where("word <> neighbour")
              .select("word", "table", "neighbour", dot(F.col("_q"), F.col("_v")).alias("similarity")))
    best = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("similarity"), "neighbour"))
    # a table holds a vector once, so its best are different vectors; the best of all tables are among them
    found = scored.withColumn("rank", best("word", "table")).where(F.col("rank") <= k).groupBy("word", "neighbour").agg(F.max("similarity").alias("similarity"))
    return found.withColumn("rank", best("word")).where(F.col("rank") <= k).select("word", "rank", "neighbour", "similarity")
