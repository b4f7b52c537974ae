"""Order-dependent operators that stay parallel when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, Window

from branchwise.session import durable

MAX_GROUP = 1_000_000


def _ranges(df: DataFrame) -> int:
    return max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _plain(df, keys, order, value, name):
    frame = (Window.partitionBy(*keys).orderBy(*order)
             .rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn(name, F.coalesce(F.sum(value).over(frame), F.lit(0)))


def _by_range(df, keys, order, value, name):
    """Range-partition on (keys, order): a hot key is spread over many ranges.

    Each range adds up its own rows; the totals of earlier ranges of the same key come in as an
    offset. At most one key continues from one range into the next, so the offset table has fewer
    rows than there are ranges and may be broadcast.
    """
    n = _ranges(df)
    ranged = durable(
        df.withColumn("_value", value)
        .repartitionByRange(n, *[F.col(k) for k in keys], *order)
        .withColumn("_range", F.spark_partition_id()))
    group = ["_range", *keys]
    local = _plain(ranged, group, order, F.col("_value"), name)
    totals = ranged.groupBy(*group).agg(F.sum("_value").alias("_total"))
    earlier = (Window.partitionBy(*keys).orderBy("_range")
               .rowsBetween(Window.unboundedPreceding, -1))
    offsets = (totals.withColumn("_offset", F.sum("_total").over(earlier))
               .where("_offset is not null")
               .select(*[F.col(c).alias("_k_" + c) for c in group], "_offset"))
    same = [F.col(c).eqNullSafe(F.col("_k_" + c)) for c in group]
    return (local.join(F.broadcast(offsets), same, "left")
            .withColumn(name, F.col(name) + F.coalesce("_offset", F.lit(0)))
            .select(*df.columns, name))


def prefix_sum(df: DataFrame, keys: Sequence[str], order: Sequence[Column], value: Column,
               name: str, max_group: int = MAX_GROUP) -> DataFrame:
    """Sum of ``value`` over the earlier rows of the same key, exclusive of the row itself.

    Keys with at most ``max_group`` rows use one ordinary window; larger ones, and a prefix over
    the whole table (``keys`` empty), go by ranges. ``order`` must be a total order within a key
    and ``df`` is read more than once, so pass a table or the result of ``durable``.
    """
    if not keys:
        return _by_range(df, [], order, value, name)
    hot = (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
           .where(F.col("_n") > max_group).select(*keys))
    if not hot.take(1):
        return _plain(df, keys, order, value, name)
    cold_part = _plain(df.join(hot, list(keys), "left_anti"), keys, order, value, name)
    hot_part = _by_range(df.join(hot, list(keys), "left_semi"), keys, order, value, name)
    return cold_part.unionByName(hot_part)


def rank_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str,
              max_group: int = MAX_GROUP) -> DataFrame:
    """Zero-based row number within a key (or over the table), skew-safe."""
    return prefix_sum(df, keys, order, F.lit(1).cast("long"), name, max_group)


def rank_by_bucket(df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[Column],
                   name: str) -> DataFrame:
    """Zero-based row number where ``bucket`` is a leading integer sort key that spreads rows evenly.

    For orders that start with a hash: rows are numbered inside a bucket, the counts of earlier
    buckets are added. Nothing is sampled and no lineage is cut; the table is read twice.
    """
    group = [*keys, "_bucket"]
    with_bucket = df.withColumn("_bucket", bucket)
    counts = with_bucket.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    earlier = (Window.partitionBy(*keys).orderBy("_bucket")
               .rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(*[F.col(c).alias("_k_" + c) for c in group],
                            F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    inside = F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1
    return (with_bucket.withColumn("_inside", inside)
            .join(offsets, [F.col(c).eqNullSafe(F.col("_k_" + c)) for c in group])
            .withColumn(name, F.col("_offset") + F.col("_inside"))
            .select(*df.columns, name))
