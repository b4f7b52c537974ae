"""A store of threads in versions.

An upsert only appends the new rows; readers take, thread by thread, the rows of its highest version.
A version counts once its write has been committed, so a lost job leaves the store as it was.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def folder(path: str, version: int) -> str:
    return f"{path}/version={version:012d}"


def append(rows: DataFrame, path: str, version: int) -> None:
    """Write one version; writing it again replaces it."""
    rows.write.mode("overwrite").parquet(folder(path, version))


def committed(spark: SparkSession, path: str) -> list[str]:
    """Folders of all finished versions, oldest first."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    base = hadoop.Path(path)
    fs = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(base):
        return []
    return sorted(s.getPath().toString() for s in fs.listStatus(base)
                  if s.isDirectory() and fs.exists(hadoop.Path(s.getPath(), "_SUCCESS")))


def versions(spark: SparkSession, path: str) -> DataFrame | None:
    """Rows of all finished versions with column ``version``."""
    found = committed(spark, path)
    return spark.read.option("basePath", path).parquet(*found) if found else None


def latest(spark: SparkSession, path: str, key: str = "source_id") -> DataFrame | None:
    """Rows of the highest version of every thread, None for an empty store."""
    rows = versions(spark, path)
    if rows is None:
        return None
    newest = rows.groupBy(key).agg(F.max("version").alias("version"))
    return rows.join(newest, [key, "version"], "left_semi").drop("version")


def latest_rows(spark: SparkSession, path: str, key: list[str]) -> DataFrame | None:
    """The newest row of each key, for sinks that receive single changed rows."""
    rows = versions(spark, path)
    if rows is None:
        return None
    rest = [c for c in rows.columns if c not in key and c != "version"]
    return (rows.groupBy(*key).agg(F.max(F.struct("version", *rest)).alias("r"))
            .select(*key, *[F.col(f"r.{c}").alias(c) for c in rest]))


def compact(spark: SparkSession, path: str, target: str) -> None:
    """Write the current state as the first version of a new store."""
    append(latest(spark, path), target, 0)
