"""Very many small files: listed, read and written in tasks, so that the driver holds no list of them."""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator
from fnmatch import fnmatchcase

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F

from branchwise.session import durable

# Ship the helpers below inside the tasks, so that workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Characters of texts in one batch.
BATCH = 8_000_000


def _expand(name: str, last: bool):
    """Paths one level below each folder, by a name or a pattern."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for folder in batch.column(0).to_pylist():
                place, path = fs.FileSystem.from_uri(folder)
                if any(c in name for c in "*?["):
                    kind = fs.FileType.File if last else fs.FileType.Directory
                    infos = place.get_file_info(fs.FileSelector(path, allow_not_found=True))
                    names = [i.base_name for i in infos if i.type == kind and i.base_name[0] not in "._" and fnmatchcase(i.base_name, name)]
                else:
                    names = [name]
                for at in range(0, len(names), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{n}" for n in names[at:at + 10_000]], pa.string())], ["path"])
    return run


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyarrow import fs

    paths, values, size = [], [], 0
    out = lambda: pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(values, pa.string())], ["path", "value"])
    for batch in batches:
        for uri in batch.column(0).to_pylist():
            place, path = fs.FileSystem.from_uri(uri)
            try:
                with place.open_input_stream(path) as file:
                    raw = file.read()
            except FileNotFoundError:  # a name that this folder hasn't
                continue
            paths.append(uri)
            values.append(raw.decode(json.detect_encoding(raw), "replace"))
            size += len(raw)
            if size >= BATCH:
                yield out()
                paths, values, size = [], [], 0
    if paths:
        yield out()


def texts(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """(path, value): all files below ``root`` whose levels match ``pattern``, read once into a table. Names that begin with a dot or an underscore match no
    pattern. A place that only Spark's readers can open is listed by them."""
    from pyarrow import fs

    try:
        fs.FileSystem.from_uri(root)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, ImportError, OSError):
        found = spark.read.text(f"{root}/{pattern}", wholetext=True)
        return durable(found.select(F.col("_metadata.file_path").alias("path"), "value"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    paths = spark.createDataFrame([(root,)], "path string")
    levels = pattern.split("/")
    for i, name in enumerate(levels):
        paths = paths.mapInArrow(_expand(name, i == len(levels) - 1), "path string")
        if any(c in name for c in "*?["):
            paths = paths.repartition(parts, "path")
    return durable(paths.mapInArrow(_read, "path string, value string"))


def write_texts(rows: DataFrame, root: str) -> None:
    """A file per row of (path, value) below ``root``. Tasks write their own files; a task that runs again writes the same ones."""
    def put(rows) -> None:
        from pyarrow import fs

        for row in rows:
            place, path = fs.FileSystem.from_uri(f"{root}/{row.path}")
            place.create_dir(path.rsplit("/", 1)[0], recursive=True)
            with place.open_output_stream(path) as file:
                file.write(row.value.encode())

    rows.foreachPartition(put)
