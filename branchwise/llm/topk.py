"""Exact top-k inner products by a three-phase uniform threshold.

Vectors are cut into ``SLICES`` runs of components, so each query has that many score lists and a pair's score is the sum of its slice
scores. Phase one takes the ``k`` best of every list in each part of the table and looks up their whole scores; the k-th best whole
score over all parts is a safe floor. An entry that reaches the floor must reach floor / ``SLICES`` in at least one list: that
uniform cutoff is broadcast, one number per query. Phase two collects the entries of each list at or above the cutoff and bounds
every entry from above by its collected slice scores and the cutoff for the others; phase three computes the whole score
of entries whose bound reaches the floor, and keeps those that do. Nothing is lost, whatever the signs of the scores.

Queries are processed in blocks of ``QUERIES`` at most, whose size is bounded and which alone are broadcast; the table is read from a
stored form twice per block. Each task holds ``ROWS`` vectors and ``STRIP`` queries of scores at a time.

Scores are computed in floating point only while every partial sum is below 2 ** 53, which makes them exact, and in integers else.

Defined cases: vectors that are null, or hold null or non-finite components, take no part, nor do rows without a vec_id; vectors of different
length never meet; empty vectors score 0 with each other; rows that share the query's vec_id count as the query's own, and
the smallest of their vectors is the query; equal scores go to the
smaller vec_id; a query with fewer than k partners returns all of them. Scores must fit 64 bits. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from branchwise.session import durable

SLICES = 4
QUERIES = 1 << 14
ROWS = 1 << 13
STRIP = 256
FOUND = "query_id long, vec_id long, score long"


def quantised(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``vec_id`` and ``v``, floor(256 * x) of every component; rows that take no part are left out."""
    whole = F.col(embedding).isNotNull() & F.col(vec_id).isNotNull() & F.forall(
        embedding, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return vectors.where(whole).select(F.col(vec_id).cast("long").alias("vec_id"),
                                       F.transform(embedding, lambda x: F.floor(256 * x.cast("double"))).alias("v"))


def _matrices(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and matrix of the rows of each vector length."""
    ids, column = batch.column(0).to_numpy(), batch.column(1)
    flat, offsets = column.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(np.diff(column.offsets.to_numpy()))))
    sizes = np.diff(offsets)
    for n in np.unique(sizes):
        rows = np.flatnonzero(sizes == n)
        yield ids[rows], flat[offsets[rows][:, None] + np.arange(n)].astype(np.int64)


def _parts(batches: Iterator[pa.RecordBatch], queries: dict) -> Iterator[tuple]:
    """(query ids, query matrix, positions of the queries, row ids, row matrix), in floats where they are exact."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            for ids, rows in _matrices(batch.slice(at, ROWS)):
                n = rows.shape[1]
                if n not in queries:
                    continue
                q_ids, q_rows, q_at = queries[n]
                most = float(np.abs(rows.astype(float)).max(initial=0)) * float(np.abs(q_rows.astype(float)).max(initial=0)) * max(n, 1)
                kind = np.float64 if most < 2**53 else np.int64
                rows = rows.astype(kind)
                for s in range(0, len(q_ids), STRIP):
                    yield q_ids[s:s + STRIP], q_rows[s:s + STRIP].astype(kind), q_at[s:s + STRIP], ids, rows


def _slices(n: int) -> list[slice]:
    edges = np.linspace(0, n, SLICES + 1).astype(int)
    return [slice(a, b) for a, b in zip(edges, edges[1:])]


def _out(q: np.ndarray, v: np.ndarray, s: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (q, v, s)], ["query_id", "vec_id", "score"])


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    """Mask of the k highest of each row at least (ties at the edge included)."""
    if scores.shape[1] <= k:
        return np.ones(scores.shape, dtype=bool)
    edge = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k]
    mask = scores > edge[:, None]
    short = k - mask.sum(axis=1)
    ties = (scores == edge[:, None])
    return mask | ties & (np.cumsum(ties, axis=1) <= short[:, None])


def _local_lists(queries: dict, k: int):
    """Phase one: whole scores of the best entries of each local list, the best k of them per query."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for q_ids, q_rows, _, ids, rows in _parts(batches, queries):
            own = q_ids[:, None] == ids[None, :]
            listed = np.zeros(own.shape, dtype=bool)
            for part in _slices(rows.shape[1]):
                local = np.where(own, np.iinfo(np.int64).min // 2, q_rows[:, part] @ rows[:, part].T)
                listed |= _best(local, k)
            q, v = np.nonzero(listed & ~own)
            whole = np.einsum("ij,ij->i", q_rows[q], rows[v])
            order = np.lexsort((-whole, q))
            rank = np.arange(len(order)) - np.searchsorted(q[order], q[order])
            order = order[rank < k]
            yield _out(q_ids[q[order]], ids[v[order]], whole[order])
    return run


def _above(queries: dict, floors: np.ndarray):
    """Phases two and three: whole scores of all entries that reach the floor, found through the lists."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for q_ids, q_rows, at, ids, rows in _parts(batches, queries):
            floor = floors[at].astype(np.float64)
            cutoff = (floor / SLICES)[:, None]
            bound, seen = np.zeros((len(q_ids), len(ids))), np.zeros((len(q_ids), len(ids)), dtype=bool)
            for part in _slices(rows.shape[1]):
                local = q_rows[:, part] @ rows[:, part].T
                collected = local >= cutoff
                seen |= collected
                bound += np.where(collected, local, cutoff)
            slack = 1e-6 * np.maximum(1, np.abs(floor))  # cutoffs are not whole numbers
            q, v = np.nonzero(seen & (bound >= (floor - slack)[:, None]) & (q_ids[:, None] != ids[None, :]))
            whole = np.einsum("ij,ij->i", q_rows[q], rows[v])
            keep = whole >= floors[at][q]
            yield _out(q_ids[q[keep]], ids[v[keep]], whole[keep])
    return run


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(vectors: DataFrame, is_query, k: int, vec_id: str = "vec_id", embedding: str = "embedding", block: int = QUERIES) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` best of all other rows for each row where ``is_query`` (a column over vec_id) holds."""
    rows = durable(quantised(vectors, vec_id, embedding))
    queries = durable(rows.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v")))
    n_blocks = max(1, -(-queries.count() // block))
    result = None
    for b in range(n_blocks):
        part = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)) == b).toPandas()  # about ``block`` rows
        by_size: dict[int, tuple] = {}
        sizes = part["v"].map(len).to_numpy() if len(part) else np.zeros(0, int)
        for n in np.unique(sizes):
            at = np.flatnonzero(sizes == n)
            matrix = np.array([list(x) for x in part["v"].iloc[at]], dtype=np.int64).reshape(len(at), n)
            by_size[int(n)] = (part["vec_id"].to_numpy()[at], matrix, at)
        lists = durable(rows.mapInArrow(_local_lists(by_size, k), FOUND))
        kth = {r[0]: r[1] for r in _ranked(lists, k).where(F.col("rank") == k).select("query_id", "score").collect()}  # one per query of the block
        floors = np.array([kth.get(q, np.iinfo(np.int64).min // 2) for q in part["vec_id"]], dtype=np.int64)
        # written block by block: only one block's queries and floors are held at a time
        found = durable(_ranked(rows.mapInArrow(_above(by_size, floors), FOUND), k))
        result = found if result is None else result.unionByName(found)
    return result.select("query_id", "rank", "vec_id", "score")
