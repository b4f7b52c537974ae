"""A store of threads in versions whose keys are dealt to bucket folders, for readers that want some threads only.

As in ``store``, an upsert appends a version and a thread is taken from its highest one. Here a version is partitioned by a hash of the key,
and its files carry Parquet's Bloom filters on it: a reader names buckets and keys as literals, so folders and row groups without them are
not read. Once versions pile up, ``compact`` writes the current state as a base; versions up to it are no longer read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from branchwise.sources.store import committed, folder

BUCKETS = 64
MOST_KEYS = 10_000
MOST_VERSIONS = 16


def bucket(key: str = "source_id", buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int")


def _write(rows: DataFrame, path: str, key: str, buckets: int) -> None:
    (rows.withColumn("bucket", bucket(key, buckets)).hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket")
     .option(f"parquet.bloom.filter.enabled#{key}", "true").option("parquet.bloom.filter.adaptive.enabled", "true").parquet(path))


def append(rows: DataFrame, path: str, version: int, key: str = "source_id", buckets: int = BUCKETS) -> None:
    """Write one version; writing it again replaces it. ``key`` and ``buckets`` belong to a store for good.

    Rows without a key belong to no thread and aren't stored; a version without rows changes nothing.
    """
    _write(rows.where(F.col(key).isNotNull()), folder(path, version), key, buckets)


def _number(path: str) -> int:
    return int(path.rstrip("/").rsplit("=", 1)[1])


def live_folders(spark: SparkSession, path: str) -> list[str]:
    """The newest base, if there is one, and the finished versions after it, oldest first."""
    bases = committed(spark, f"{path}/bases")
    base = bases[-1:]
    after = _number(base[0]) if base else -1
    return _filled(spark, base + [v for v in committed(spark, path) if "/version=" in v and _number(v) > after])


def _filled(spark: SparkSession, folders: Sequence[str]) -> list[str]:
    """Those with a bucket: a version without rows has no file to read a schema from."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(folders[0]).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()) if folders else None
    return [f for f in folders if any(s.isDirectory() for s in fs.listStatus(hadoop.Path(f)))]


def _rows(spark: SparkSession, folders: Sequence[str]) -> DataFrame | None:
    out = None
    for one in folders:
        part = spark.read.parquet(one).withColumn("version", F.lit(_number(one)).cast("long"))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def _newest(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.max("version").alias("version"))


def latest(spark: SparkSession, path: str, key: str = "source_id") -> DataFrame | None:
    """Rows of the highest version of every thread; None for an empty store. A lone base or version is read as it is."""
    folders = live_folders(spark, path)
    rows = _rows(spark, folders)
    if rows is None:
        return None
    if len(folders) > 1:
        rows = rows.join(_newest(rows, key), [key, "version"], "left_semi")
    return rows.drop("version", "bucket")


def latest_of(spark: SparkSession, path: str, keys: Sequence[str] | DataFrame, key: str = "source_id", buckets: int = BUCKETS) -> DataFrame | None:
    """Rows of the highest version of the given threads.

    A list of up to ``MOST_KEYS`` keys goes into the plan as literals: buckets prune folders, keys meet the Bloom filters, and a first pass over the key column
    alone finds the versions that are newest for some of them; only those are read whole. A table of keys (its column ``key``), or a longer list, prunes
    by its buckets and meets the rows in a join.
    """
    folders = live_folders(spark, path)
    if not folders:
        return None
    listed = not isinstance(keys, DataFrame)
    table = spark.createDataFrame([(k,) for k in keys], f"`{key}` string") if listed else keys.select(F.col(key))
    numbers = [r[0] for r in table.select(bucket(key, buckets).alias("b")).distinct().collect()]  # at most ``buckets``

    def chosen(rows: DataFrame) -> DataFrame:
        rows = rows.where(F.col("bucket").isin(numbers))
        if listed and len(keys) <= MOST_KEYS:
            return rows.where(F.col(key).isin(list(keys)))
        return rows.join(table.distinct(), key, "left_semi")

    if listed and len(keys) <= MOST_KEYS:
        found = _newest(chosen(_rows(spark, folders)), key).select("version").distinct().collect()  # one row a key at most
        needed = {r[0] for r in found}
        folders = [f for f in folders if _number(f) in needed] or folders[-1:]
    rows = chosen(_rows(spark, folders))
    if len(folders) > 1:
        rows = rows.join(_newest(rows, key), [key, "version"], "left_semi")
    return rows.drop("version", "bucket")


def compact(spark: SparkSession, path: str, key: str = "source_id", buckets: int = BUCKETS, most: int = MOST_VERSIONS) -> bool:
    """Write the current state as a base if more than ``most`` folders have to be read; tells whether it did.

    Readers that began before go on with the folders they listed, as nothing is deleted here. Run it between two versions.
    """
    folders = live_folders(spark, path)
    if len(folders) <= most:
        return False
    _write(latest(spark, path, key), folder(f"{path}/bases", _number(folders[-1])), key, buckets)
    return True
