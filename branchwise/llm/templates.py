"""Recurring lines, found as templates of a log-template tree.

A line goes down a tree of fixed depth: by its number of words, then by its first ``DEPTH`` words, with words that hold a digit read
as a variable. In a leaf, a word is constant at its position if it stands there in ``RECUR`` lines or more, else it is a variable field; so the
template of a line is its words with the variable ones masked. Counting words per leaf and position takes the place
of meeting lines one by one: the result depends on no order and no group is ever held together.

A template recurs if lines of it stand in ``RECUR`` different texts or more (equal texts count once: copies of one document are no
boilerplate), at least ``CONSTANT`` of its words are constant or hold digits, and at least half are constant. What stands beside a line doesn't matter: boilerplate
stands between blank lines, inside a constant block or alone as often as not. Its lines are dropped from all documents but the one with the smallest doc_id.

Every text is cut into lines once, in Python, and its lines are written with their leaf; leaves are counted from there. Leaves of too few
texts end here: where the others are few (``FEW`` numbers, some 40 MB) they are broadcast and lines of the others are dropped as they are read; beyond
that, lines meet them in a join.

Defined cases: a null text has no lines and stays null; lines without a word are kept; rows with equal doc_id and text
count as one document and are treated alike; documents without a doc_id lose recurring lines unless all that share them have none;
any other columns stay as they are. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from branchwise.llm.words import boxed, stored, unboxed
from branchwise.session import durable

RECUR = 10
DEPTH = 2
CONSTANT = 0.75
FIELD = "<*>"
DIGITS = b"0123456789"
FEW = 1_000_000
LINES = "doc_id long, _h long, _no int, _leaf long, _line long, _text string"


def masked(line: bytes) -> list[bytes]:
    """Words of a line; those that hold a digit are variable fields."""
    if len(line.translate(None, DIGITS)) == len(line):
        return line.split()
    field = FIELD.encode()
    return [w if len(w.translate(None, DIGITS)) == len(w) else field for w in line.split()]


def _signed(data: bytes) -> int:
    return xxhash.xxh64_intdigest(data) - (1 << 63)


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per line with words, in the columns of ``LINES``: ``_h`` and ``_line`` are hashes of the text and of the line's words, which are in ``_text``."""
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string()]
    names = [c.split()[0] for c in LINES.split(", ")]
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            columns: list[list] = [[] for _ in names]
            ids, hashes, numbers, leaves, lines, texts = columns
            for key, mark, value in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2)):
                for no, line in enumerate(value.as_py().encode().split(b"\n")):
                    words = masked(line)
                    if words:
                        text = b" ".join(words)
                        ids.append(key)
                        hashes.append(mark)
                        numbers.append(no)
                        leaves.append(_signed(b"%d " % len(words) + b" ".join(words[:DEPTH])))
                        lines.append(_signed(text))
                        texts.append(text)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def recurring(docs: DataFrame, recur: int = RECUR, constant: float = CONSTANT, few: int = FEW) -> DataFrame:
    """Lines to drop: doc_id, ``_h`` (hash of the text), ``_no``, and their ``template``."""
    plain = docs.where("text is not null").select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("_h"), "text")
    lines, discard = stored(plain.mapInArrow(_lines, LINES))
    leaves, n = stored_leaves(lines, recur)
    found = lines.join(F.broadcast(leaves) if n <= few else leaves, "_leaf", "left_semi")
    found = durable(found.withColumn("_words", F.split("_text", " ")).drop("_text"))
    discard()
    distinct = durable(found.groupBy("_leaf", "_line").agg(F.first("_words").alias("_words"), F.count(F.lit(1)).alias("_n")))
    words = distinct.select("_leaf", "_line", "_n", F.posexplode("_words").alias("_pos", "_word"))
    often = words.groupBy("_leaf", "_pos", "_word").agg(F.sum("_n").alias("_times")).where((F.col("_times") >= recur) & (F.col("_word") != FIELD))
    marked = words.join(often, ["_leaf", "_pos", "_word"], "left")
    fixed = F.col("_times").isNotNull()
    template = F.array_sort(F.collect_list(F.struct("_pos", F.when(fixed, F.col("_word")).otherwise(F.lit(FIELD)).alias("_w"))))
    known = fixed | (F.col("_word") == FIELD)
    named = marked.groupBy("_leaf", "_line").agg(template.alias("_t"), F.avg(known.cast("int")).alias("_share"), F.avg(fixed.cast("int")).alias("_fixed"))
    named = named.where((F.col("_share") >= constant) & (F.col("_fixed") >= 0.5)).select("_leaf", "_line", F.array_join(F.col("_t._w"), " ").alias("template"))
    joined = durable(found.select("_leaf", "_line", "doc_id", "_h", "_no").join(named, ["_leaf", "_line"]).drop("_line"))
    stats = joined.groupBy("_leaf", "template").agg(F.count_distinct("_h").alias("_texts"), F.min("doc_id").alias("_first"))
    again = stats.where(F.col("_texts") >= recur).select("_leaf", "template", "_first")
    return joined.join(again, ["_leaf", "template"]).where(~F.col("doc_id").eqNullSafe(F.col("_first"))).select("doc_id", "_h", "_no", "template")


def stored_leaves(lines: DataFrame, recur: int) -> tuple[DataFrame, int]:
    """Leaves with lines of ``recur`` different texts or more, as a table, and their number."""
    leaves = durable(lines.groupBy("_leaf", "_h").agg(F.lit(1).alias("_one")).groupBy("_leaf").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= recur).select("_leaf"))
    return leaves, leaves.count()


def drop_recurring(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with recurring lines taken out of ``text``, and ``n_lines`` (before) and ``n_dropped``."""
    gone = recurring(docs, **options).groupBy("doc_id", "_h").agg(F.collect_set("_no").alias("_gone"))
    gone = gone.select(F.col("doc_id").alias("_id"), F.col("_h").alias("_hash"), "_gone")
    text = F.col("_row")["text"]
    boxes = boxed(docs, "doc_id").withColumn("_h", F.xxhash64(text))
    joined = boxes.join(gone, boxes["doc_id"].eqNullSafe(gone["_id"]) & (boxes["_h"] == gone["_hash"]), "left")
    lines = F.split(text, "\n", -1)
    left = F.array_join(F.filter(lines, lambda _, i: ~F.array_contains("_gone", i)), "\n")
    return joined.select(unboxed(
        docs.columns, text=F.when(F.col("_gone").isNull(), text).otherwise(left),
        n_lines=F.when(text.isNull(), F.lit(0)).otherwise(F.size(lines)).cast("long"),
        n_dropped=F.when(F.col("_gone").isNull(), F.lit(0)).otherwise(F.size("_gone")).cast("long")))
