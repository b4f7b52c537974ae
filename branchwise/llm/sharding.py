"""Extendible hashing: shards by hash prefix, where only buckets over the byte limit take another bit.

A row's bucket is the shortest prefix of its key's hash whose rows fit the limit together. Sizes are added
up for ``STEP`` more bits at a time, from at most ``2 ** STEP`` cells per open bucket, so a table needs one pass for every
``STEP`` bits of depth and the driver sees no bucket. The directory holds each bucket once, with its own depth,
rather than once per slot of the global depth: one large document would otherwise double it many times over.

Defined cases: a null key hashes as the empty text; a null or empty text has 0 bytes and still gets a shard; one row larger
than the limit is a bucket of its own; rows whose hashes are equal in all bits (a repeated key) can't be told
apart by more bits and go to numbered overflow pages, each within the limit. An empty table has no shards. Columns
of the input are kept as they are; helper columns start with ``_``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from branchwise.llm.words import hash60, quoted, unboxed
from branchwise.operators.skew import prefix_sum
from branchwise.session import durable

HASH_BITS = 60
STEP = 15


def _prefix(hash_column: Column, depth: Column) -> Column:
    return F.call_function("shiftright", hash_column, (F.lit(HASH_BITS) - depth).cast("int"))


def directory(rows: DataFrame, limit: int, hash_bits: int = HASH_BITS) -> DataFrame:
    """Buckets of ``rows`` (``_hash``, ``_bytes``): depth, prefix, n_rows, shard_bytes, largest.

    A bucket is a node of the prefix tree that fits (or holds one row, or has no bits left) below a parent that doesn't.
    """
    leaves, open_rows, low = None, rows, 0
    while True:
        high = min(low + STEP, hash_bits)
        cells = open_rows.groupBy(_prefix(F.col("_hash"), F.lit(high)).alias("_cell")).agg(
            F.count(F.lit(1)).alias("n_rows"), F.sum("_bytes").alias("shard_bytes"), F.max("_bytes").alias("largest"))
        nodes = (cells.withColumn("depth", F.explode(F.sequence(F.lit(low), F.lit(high))))
                 .withColumn("prefix", F.call_function("shiftright", F.col("_cell"), (F.lit(high) - F.col("depth")).cast("int")))
                 .groupBy("depth", "prefix").agg(F.sum("n_rows").alias("n_rows"), F.sum("shard_bytes").alias("shard_bytes"),
                                                 F.max("largest").alias("largest")))
        fits = (F.col("shard_bytes") <= limit) | (F.col("n_rows") == 1)
        nodes = durable(nodes.withColumn("_fits", fits))
        parents = nodes.where("not _fits").select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("_parent"))
        split = nodes.where(F.col("depth") > low).withColumn("_parent", F.shiftright("prefix", 1)).join(parents, ["depth", "_parent"])
        top = nodes.where((F.col("depth") == low) & (F.lit(low) == 0))
        done = F.col("_fits") | (F.col("depth") == hash_bits)
        names = ["depth", "prefix", "n_rows", "shard_bytes", "largest"]
        found = split.where(done).select(names).unionByName(top.where(done).select(names))
        leaves = found if leaves is None else leaves.unionByName(found)
        over = nodes.where((F.col("depth") == high) & ~F.col("_fits")).select(F.col("prefix").alias("_over"))
        if high == hash_bits or not over.take(1):
            return durable(leaves)
        open_rows = durable(open_rows.join(over, _prefix(F.col("_hash"), F.lit(high)) == F.col("_over"), "left_semi"))
        low = high


def assign(docs: DataFrame, key: str, size: Column, limit: int, hash_bits: int = HASH_BITS) -> tuple[DataFrame, DataFrame]:
    """``docs`` with ``shard`` (bits of the prefix, and ``.page`` on overflow), ``depth``, ``n_bytes``, ``shard_bytes``; and the directory.

    ``shard_bytes`` is the size of the bucket; an overflow page holds at most ``limit`` of it.
    """
    whole = F.struct(*[docs[quoted(c)] for c in docs.columns]).alias("_row")
    sized = docs.select(whole, hash60(F.col(key)).alias("_hash"), F.coalesce(size, F.lit(0)).cast("long").alias("_bytes"))
    buckets = directory(sized.select("_hash", "_bytes"), limit, hash_bits)
    depths = sorted(r[0] for r in buckets.select("depth").distinct().collect()) or [0]  # at most one per hash bit
    placed = (sized.withColumn("depth", F.explode(F.array(*[F.lit(d) for d in depths])))
              .withColumn("prefix", _prefix(F.col("_hash"), F.col("depth")))
              .join(buckets, ["depth", "prefix"])
              .withColumn("shard", F.when(F.col("depth") == 0, F.lit("")).otherwise(F.expr("lpad(bin(prefix), depth, '0')"))))
    result = unboxed(docs.columns, shard=F.col("shard"), depth=F.col("depth"), n_bytes=F.col("_bytes"), shard_bytes=F.col("shard_bytes"))
    crowded = (F.col("depth") == hash_bits) & (F.col("n_rows") > 1) & (F.col("shard_bytes") > limit)
    if not buckets.where(crowded).take(1):
        return placed.select(result), buckets
    full = durable(placed.where(crowded))
    paged = prefix_sum(full, ["prefix"], [F.col("_bytes"), F.xxhash64("_row")], F.col("_bytes"), "_before")
    step = F.greatest(F.lit(limit) - F.col("largest"), F.lit(1))
    paged = paged.withColumn("shard", F.concat_ws(".", "shard", F.floor(F.col("_before") / step).cast("string")))
    return placed.where(~crowded).select(result).unionByName(paged.select(result)), buckets
