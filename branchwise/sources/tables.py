"""Flat inputs: label sequences, token matrices, word lists, word vectors, sentence files, metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from branchwise.functions.text import words


def sequences(spark: SparkSession, path: str) -> DataFrame:
    """``TruthStatus <tab> [[stance], …]`` or ``[[stance, time], …]`` with a heading line."""
    raw = spark.read.schema("TruthStatus int, SDQC_Labels string").csv(path, sep="\t", header=True)
    pairs = F.from_json("SDQC_Labels", "array<array<double>>")
    obs = F.transform(pairs, lambda p: F.struct(p[0].cast("int").alias("stance"), F.get(p, F.lit(1)).alias("t")))
    return raw.select(F.col("TruthStatus").alias("veracity"), obs.alias("obs"))


def token_matrices(spark: SparkSession, path: str) -> DataFrame:
    """``id <tab> stance <tab> comment matrix <tab> source matrix`` with a heading line."""
    raw = spark.read.schema("msg_id string, sdqc int, comment string, source string").csv(path, sep="\t", header=True)
    as_matrix = lambda c: F.from_json(c, "array<array<float>>")
    return raw.select("msg_id", "sdqc", as_matrix("comment").alias("comment_matrix"), as_matrix("source").alias("source_matrix"))


def stance_labels(spark: SparkSession, path: str) -> DataFrame:
    """``msg_id <tab> stance code`` without a heading line."""
    return spark.read.schema("msg_id string, stance int").csv(path, sep="\t")


def word_list(spark: SparkSession, *paths: str) -> DataFrame:
    """Distinct lower-case words of one or several files, one word per line."""
    return (spark.read.text(list(paths)).select(F.lower(F.trim("value")).alias("word"))
            .where("word <> ''").distinct())


def lexicon(spark: SparkSession, lists: dict[str, list[str]]) -> DataFrame:
    """(list, word) from files per list name; files of one list are united."""
    out = None
    for name, paths in lists.items():
        part = word_list(spark, *paths).select(F.lit(name).alias("list"), "word")
        out = part if out is None else out.unionByName(part)
    return out


def word_vectors(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """(token, vector) from Parquet, or from text lines ``token x1 x2 …`` (a line with two fields,
    the size heading of such files, is skipped)."""
    if fmt == "parquet":
        return spark.read.parquet(path).select("token", F.col("vector").cast("array<float>").alias("vector"))
    parts = F.split(F.rtrim("value"), " ")
    return (spark.read.text(path).select(parts.alias("p")).where(F.size("p") > 2)
            .select(F.col("p")[0].alias("token"),
                    F.transform(F.slice("p", F.lit(2), F.size("p") - 1), lambda x: x.cast("float")).alias("vector")))


def sentences(spark: SparkSession, *paths: str) -> DataFrame:
    """Non-blank lines as word arrays."""
    return spark.read.text(list(paths)).where("value <> ''").select(words(F.col("value")).alias("words"))


def line_count(spark: SparkSession, *paths: str) -> int:
    return spark.read.text(list(paths)).count()


def metrics(spark: SparkSession, path: str, with_length: bool = False) -> DataFrame:
    """Semicolon table of evaluation results."""
    length = "length int, " if with_length else ""
    return spark.read.schema(
        f"model string, {length}unverified_cast string, remove_commenting string, testdata_type string, model_type string, "
        "comp_count int, f1_macro double, f1_micro double, accuracy double, precision double, recall double"
    ).csv(path, sep=";", header=True)


def epochs(spark: SparkSession, path: str) -> DataFrame:
    """Comma table of training epochs; rows have one field more than the heading names."""
    return spark.read.schema(
        "epoch int, lstm_layers int, lstm_dims int, relu_layers int, relu_dims int, accuracy double, f1_macro double, "
        "f1_micro double, acc_s double, acc_d double, acc_q double, acc_c double").csv(path, header=True, enforceSchema=True)


def label_export(spark: SparkSession, path: str) -> DataFrame:
    """Annotation export, one item per line: item_id, text, user, label (exploded)."""
    raw = spark.read.schema("id long, text string, annotations array<struct<user:long,label:long>>").json(path)
    return raw.select(F.col("id").alias("item_id"), "text", F.inline("annotations"))
