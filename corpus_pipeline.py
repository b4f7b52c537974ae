"""The training-data pipeline: documents in, digests of tokenised documents out.

Stages, each over all that the one before kept, written as Parquet in the shared folder and read again:

1. ``toxicity``: documents that the classifier predicts toxic go. It learns from ``labels`` and the documents table, never from held-out rows.
2. ``line_dedup``: lines of recurring templates go; a document that loses all its words so goes too (they stand in an earlier one).
3. ``simhash_near_dedup``: of documents whose fingerprints connect, the one with the smallest doc_id stays: the operator of
   ``op10_simhash_groups`` with its shingles of three words and its distance of three bits.
4. ``mixing``: a row per document and round in which the mix takes words of it, with those words as text.
5. ``sentencepiece``: doc_id, source and the digests of each row's ids and decoded text.

Every stage but the last returns the columns of ``documents``. Rows may hold nulls in any column, as each operator defines. A corpus
without rows stays empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from branchwise.llm import mixing, pieces, simhash, templates, toxicity
from branchwise.llm.queries import public_file
from branchwise.llm.words import table, word_count
from branchwise.session import configure, durable


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    configure(spark)
    model = toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).where("predicted = 0").select(docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    configure(spark)
    cleaned = templates.drop_recurring(docs)
    return cleaned.where((F.col("n_dropped") == 0) | (word_count(F.col("text")) > 0)).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    configure(spark)
    return simhash.deduplicate(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    configure(spark)
    return mixing.mix(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    configure(spark)
    return pieces.encode(docs.select("doc_id", "source", "text"), public_file("piece_bpe_32k.model"), digest=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", remove_toxic),
    ("line_dedup", drop_lines),
    ("simhash_near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("sentencepiece", tokenise),
]

#: A trained classifier and a tokeniser can't be written in SQL; tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    configure(spark)
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = durable(stage(spark, docs, sf_dir))
    return docs


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
