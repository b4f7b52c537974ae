"""Token counts of documents from flat token files that have no index.

``pack`` writes a corpus as such files: per input partition one stream of 16-bit ids, each document followed by the
end-of-document id, cut into blocks of equal length without regard to documents. ``scan`` finds the separators of every block
with one vectorised comparison and stitches the documents that run across blocks by a prefix scan over small
block summaries: the tokens a block inherits are its start minus the end of the last separator before it. The
scan goes over groups of ``GROUP`` blocks first and over the groups of a file after, so no window holds all blocks of a file.

Defined cases: a null or empty text is a document of 0 tokens; a document may span any number of blocks; tokens behind the last
separator of a file belong to no document and are left out, as is an empty file. The separator's text inside a document is ordinary
text. Repeated rows are counted each.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

BLOCK = 1 << 16
GROUP = 4096
BLOCKS = "file long, block long, data binary, doc_ids array<long>"


@lru_cache(maxsize=2)
def encoder(ranks: bytes, pattern: str):
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})


def pack(docs: DataFrame, ranks: bytes, pattern: str, separator: int, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """Blocks of ``block`` tokens (the last of a file is shorter): file, block, data, and the ids of the documents that end in it.

    The ids only name documents; where they end must be read from the tokens.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, file, number = encoder(ranks, pattern), TaskContext.get().partitionId(), 0
        buffer, held, ended = [], 0, []  # ended: (position behind the separator, id)

        def cut(whole: np.ndarray, last: bool) -> Iterator[tuple]:
            nonlocal number, ended
            at = 0
            while len(whole) - at >= block or last and at < len(whole):
                inside = [i for p, i in ended if p <= at + block]
                ended = ended[len(inside):]
                yield file, number, whole[at:at + block].astype("<u2").tobytes(), inside
                number, at = number + 1, at + block
            ended = [(p - at, i) for p, i in ended]
            buffer[:] = [whole[at:]] if at < len(whole) else []

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["file", "block", "data", "doc_ids"])

        for batch in batches:
            for key, value in zip(batch.column(0), batch.column(1)):
                ids = np.array([*tool.encode_ordinary(value.as_py() or ""), separator], dtype=np.uint16)
                buffer.append(ids)
                held += len(ids)
                ended.append((held, key.as_py()))
                if held >= 16 * block:
                    rows = list(cut(np.concatenate(buffer), False))
                    held = sum(map(len, buffer))
                    yield batch_of(rows)
        if buffer and (rows := list(cut(np.concatenate(buffer), True))):
            yield batch_of(rows)

    return docs.select(F.col(doc_id).cast("long"), text).mapInArrow(run, BLOCKS)


def read_flat(spark: SparkSession, path: str, block: int = BLOCK) -> DataFrame:
    """Blocks of one plain file of 16-bit ids, read in parallel; its length must be a multiple of the block's."""
    records = spark.sparkContext.binaryRecords(path, 2 * block)
    rows = records.zipWithIndex().map(lambda x: (0, x[1], bytearray(x[0]), None))
    return spark.createDataFrame(rows, BLOCKS)


def summaries(blocks: DataFrame, separator: int) -> DataFrame:
    """Per block: its length and the positions behind its separators."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = [np.frombuffer(v.as_py(), "<u2") for v in batch.column(2)]
            ends = [np.flatnonzero(t == separator) + 1 for t in tokens]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([len(t) for t in tokens], pa.int64()), pa.array(ends, pa.list_(pa.int64())), batch.column(3)],
                ["file", "block", "n", "ends", "doc_ids"])

    return blocks.select("file", "block", "data", "doc_ids").mapInArrow(run, "file long, block long, n long, ends array<long>, doc_ids array<long>")


def scan(blocks: DataFrame, separator: int) -> DataFrame:
    """One row per document: file, ordinal in the file, start, n_tokens without the separator, doc_id (null if blocks name none)."""
    found = summaries(blocks, separator).withColumn("_group", F.floor(F.col("block") / GROUP))
    inside = Window.partitionBy("file", "_group").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("file").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    last = F.element_at("ends", -1)  # null without a separator
    local = (found.withColumn("_start", F.coalesce(F.sum("n").over(inside), F.lit(0)))
             .withColumn("_n_docs", F.size("ends").cast("long"))
             .withColumn("_docs", F.coalesce(F.sum("_n_docs").over(inside), F.lit(0)))
             .withColumn("_last", F.when(F.col("_n_docs") > 0, F.col("_start") + last))
             .withColumn("_from", F.max("_last").over(inside)))
    groups = (local.groupBy("file", "_group").agg(F.sum("n").alias("_gn"), F.sum("_n_docs").alias("_gd"), F.max("_last").alias("_gl"))
              .withColumn("_g_start", F.coalesce(F.sum("_gn").over(before), F.lit(0)))
              .withColumn("_g_docs", F.coalesce(F.sum("_gd").over(before), F.lit(0)))
              .withColumn("_g_from", F.coalesce(F.max(F.col("_g_start") + F.col("_gl")).over(before), F.lit(0)))
              .select("file", "_group", "_g_start", "_g_docs", "_g_from"))
    whole = local.join(groups, ["file", "_group"])
    begin = F.coalesce(F.col("_g_start") + F.col("_from"), F.col("_g_from"))
    named = whole.select("file", begin.alias("_begin"), (F.col("_g_start") + F.col("_start")).alias("_at"),
                         (F.col("_g_docs") + F.col("_docs")).alias("_first"), "ends", "doc_ids")
    each = named.select("file", "_begin", "_at", "_first", "ends", "doc_ids", F.posexplode("ends").alias("_i", "_end"))
    start = F.when(F.col("_i") == 0, F.col("_begin")).otherwise(F.col("_at") + F.expr("ends[_i - 1]"))
    return each.select(F.expr("doc_ids[_i]").alias("doc_id"), "file", (F.col("_first") + F.col("_i")).alias("ordinal"),
                       start.alias("start"), (F.col("_at") + F.col("_end") - 1 - start).alias("n_tokens"))
