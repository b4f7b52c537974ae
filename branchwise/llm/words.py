"""Words as every operator here understands them: runs without the six ASCII white-space characters."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructField, StructType

from branchwise.session import scratch_path

WORD = r"[^\x20\x09-\x0D]+"
GAPS = " \t\n\x0b\x0c\r"


def word_bytes(text: str | None) -> list[bytes]:
    """Words of a text as UTF-8; ``bytes.split`` cuts at exactly the characters of ``GAPS``."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def word_count(text: Column) -> Column:
    """Number of words, 0 for null, without Python."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hash60(key: Column) -> Column:
    """The first 60 bits of MD5 as a long: the same in any SQL engine. Null counts as the empty string."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def quoted(name: str) -> str:
    """A column's name as Spark's parser takes it, whatever characters it holds."""
    return "`" + name.replace("`", "``") + "`"


def columns_and(docs: DataFrame, keep: list[str], new: str) -> StructType:
    """The schema of the columns ``keep`` of ``docs``, followed by ``new`` (in DDL)."""
    return StructType([*[docs.schema[c] for c in keep], *StructType.fromDDL(new).fields])


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType) -> DataFrame:
    """``mapInArrow`` for columns of any name: Spark resolves plain ones, ``run`` sees and returns the real ones."""
    seen, plain = df.columns, StructType([StructField(f"_c{i}", f.dataType) for i, f in enumerate(schema)])

    def renamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in run(b.rename_columns(seen) for b in batches):
            yield batch.rename_columns(plain.names)

    return df.toDF(*[f"_c{i}" for i in range(len(seen))]).mapInArrow(renamed, plain).toDF(*schema.names)


def boxed(docs: DataFrame, *names: str) -> DataFrame:
    """``names`` beside ``_row``, a struct of all columns: whatever they are called, they clash with no helper column."""
    return docs.select(F.struct(*[docs[quoted(c)] for c in docs.columns]).alias("_row"), *[docs[quoted(c)] for c in names])


def unboxed(columns: list[str], **new: Column) -> list[Column]:
    """The columns of a ``boxed`` table again, some replaced or added."""
    kept = [new.get(c, F.col("_row").getField(c)).alias(c) for c in columns]
    return kept + [v.alias(c) for c, v in new.items() if c not in columns]


def stored(df: DataFrame) -> tuple[DataFrame, Callable[[], None]]:
    """A table in the shared folder with the rows of ``df``, and a function that deletes it.

    Call that once everything derived from the table is written itself. It also lets Spark delete the shuffle files
    of jobs that are over, so that a long chain of steps needs the disk of its widest step only.
    """
    spark, path = df.sparkSession, scratch_path(df.sparkSession, "step")
    df.write.option("compression", "zstd").parquet(path)

    def discard() -> None:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
        spark.sparkContext._jvm.System.gc()

    return spark.read.schema(df.schema).parquet(path), discard
