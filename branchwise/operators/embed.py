"""Word-vector features over a table ``vectors(token, vector ARRAY<FLOAT>)``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from branchwise.functions.text import explode_terms
from branchwise.functions.vectors import cosine, norm, scale, vector_sum
from branchwise.session import durable

BROADCAST_BYTES = 256 * 1024 * 1024
#: Messages whose token vectors a task holds at a time.
MATRIX_ROWS = 1000
#: Passes over the sentences in training, at least.
PASSES = 5


def may_broadcast(vectors: DataFrame, dim: int, limit: int = BROADCAST_BYTES) -> bool:
    """Whether the counted rows of the vector table stay below ``limit`` bytes in memory."""
    return vectors.count() * (8 * dim + 64) <= limit


def message_vectors(messages: DataFrame, key: list[str], tokens: Column, vectors: DataFrame, dim: int,
                    limit: int = BROADCAST_BYTES) -> DataFrame:
    """Per message: n_tokens, n_known and the vector sum over its known tokens (NULL if none).

    The only place where tokens meet vectors; averages and every similarity come from these sums. A
    vector table of checked size is broadcast, then the tokens of a message never leave their
    partition and only one sum per message is shuffled. A larger one is joined by token after the
    repeats within a message have been counted, so a frequent token travels once per message.
    """
    terms = explode_terms(messages, key, tokens, keep_empty=True)
    known = F.col("vector").isNotNull()
    if may_broadcast(vectors, dim, limit):
        met = terms.join(F.broadcast(vectors), F.col("term") == F.col("token"), "left")
        return met.groupBy(*key).agg(F.count("term").alias("n_tokens"), F.count("vector").alias("n_known"),
                                     vector_sum(F.col("vector"), dim).alias("vsum"))
    counted = terms.groupBy(*key, "term").agg(F.count("term").alias("n"))
    met = counted.join(vectors, F.col("term") == F.col("token"), "left")
    return met.groupBy(*key).agg(F.sum("n").alias("n_tokens"), F.sum(F.when(known, F.col("n")).otherwise(0)).alias("n_known"),
                                 vector_sum(F.col("vector"), dim, F.col("n")).alias("vsum"))


def average_vector(vsum: Column, n_tokens: Column, dim: int) -> Column:
    """Sum over known tokens divided by the number of all tokens; zeros if there is none."""
    return F.coalesce(scale(vsum, 1 / n_tokens.cast("double")), F.array_repeat(F.lit(0.0), dim))


def token_matrices(rows: DataFrame, key: list[str], lists: dict[str, str], vectors: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``rows`` with a matrix in place of each token list (``lists``: matrix name to list name): vectors of the known tokens in text order, NULL if none is known.

    ``key`` names a row. Rows are dealt out by key before their tokens become vectors; with a vector table of checked size the vectors then
    stay in their task, and no matrix is shuffled. A larger one is joined by token.
    """
    rows = durable(rows)
    n, width = vectors.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("vector")), F.lit(0))).first()
    small = n * (vectors.schema["vector"].dataType.elementType.jsonValue() == "float" and 4 or 8) * (width + 24) <= limit
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // MATRIX_ROWS))
    place = lambda s, c: F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda t, i: F.struct(F.lit(s).alias("_side"), i.alias("_pos"), t.alias("_term")))
    # the other columns ride on an entry of their own
    own = F.array(F.struct(F.lit(-1).alias("_side"), F.lit(0).alias("_pos"), F.lit(None).cast("string").alias("_term")))
    others = [c for c in rows.columns if c not in key and c not in lists.values()]
    terms = (rows.repartition(parts, *key)
             .select(*key, F.struct(F.lit(True).alias("_here"), *others).alias("_rest"), F.inline(F.concat(own, *[place(s, F.col(c)) for s, c in enumerate(lists.values())]))))
    met = terms.join((F.broadcast(vectors) if small else vectors).select(F.col("token").alias("_term"), F.col("vector").alias("_vector")), "_term", "left")
    found = F.struct(F.col("_pos"), F.col("_vector"))
    grouped = met.where("_vector is not null or _side = -1").groupBy(*key).agg(
        F.first(F.when(F.col("_side") == -1, F.col("_rest")), ignorenulls=True).alias("_rest"),
        *[F.array_sort(F.collect_list(F.when((F.col("_side") == s) & F.col("_vector").isNotNull(), found))).alias(m) for s, m in enumerate(lists)])
    return grouped.select(*key, *[F.col("_rest")[c].alias(c) for c in others],
                          *[F.when(F.size(m) > 0, F.transform(m, lambda e: e["_vector"])).alias(m) for m in lists])


def token_matrix(messages: DataFrame, key: list[str], tokens: Column, vectors: DataFrame) -> DataFrame:
    """Vectors of the known tokens in text order; [] if none is known, NULL without tokens."""
    base = messages.select(*key, tokens.alias("_t")).withColumn("_some", F.size("_t") > 0)
    found = token_matrices(base, key, {"matrix": "_t"}, vectors)
    return found.select(*key, F.when(F.col("_some"), F.coalesce("matrix", F.array())).alias("matrix"))


def branch_pools(members: DataFrame, vecs: DataFrame, branch: list[str], dim: int) -> DataFrame:
    """Vector sum and token counts over all members of a branch (the message itself included)."""
    sums = vecs.where("n_known > 0").select("msg_id", "n_known", "vsum")
    return (members.select(*branch, "msg_id").join(sums, "msg_id")
            .groupBy(*branch).agg(vector_sum(F.col("vsum"), dim).alias("branch_sum"), F.sum("n_known").alias("branch_known")))


def similarities(context: DataFrame, members: DataFrame, vecs: DataFrame, branch: list[str], dim: int, sums: bool = False) -> DataFrame:
    """Cosines of each message to its source, the message before it, and its branch.

    ``context`` has one row per message: msg_id, source_id, prev_id and the branch it is judged in.
    The cosine of two means equals that of two sums, so the sums are used as they are. A vector that has met its message becomes
    its cosine before the next join, so each join moves one vector a message. With ``sums``, ``own`` and ``src`` (rows of ``vecs``) stay.
    """
    own = F.struct("n_tokens", "n_known", "vsum")
    side = lambda name, value, alias: vecs.select(F.col("msg_id").alias(name), value.alias(alias))
    near = lambda other, name: F.coalesce(cosine(F.col("own.vsum"), F.col(other)), F.lit(0.0)).alias(name)
    ids = list(dict.fromkeys(["msg_id", "source_id", *branch]))
    return (context.select(*ids, "prev_id").join(side("msg_id", own, "own"), "msg_id", "left")
            .join(side("prev_id", F.col("vsum"), "_prev"), "prev_id", "left").select(*ids, "own", near("_prev", "sim_to_prev"))
            .join(branch_pools(members, vecs, branch, dim), branch, "left").select("msg_id", "source_id", "own", "sim_to_prev", near("branch_sum", "sim_to_branch"))
            .join(side("source_id", own, "src"), "source_id", "left")
            .select("msg_id", "source_id", near("src.vsum", "sim_to_src"), "sim_to_prev", "sim_to_branch", *(["own", "src"] if sums else [])))


def set_cosine(pairs: DataFrame, key: list[str], left: Column, right: Column, vectors: DataFrame, dim: int) -> DataFrame:
    """Cosine between two token lists per row; 0 if either has no known token."""
    sides = (pairs.select(*key, F.explode(F.array(
        F.struct(F.lit("l").alias("side"), left.alias("tokens")),
        F.struct(F.lit("r").alias("side"), right.alias("tokens")))).alias("s"))
        .select(*key, "s.*"))
    sums = message_vectors(sides, [*key, "side"], F.col("tokens"), vectors, dim)
    pick = lambda s: F.first(F.when(F.col("side") == s, F.col("vsum")), ignorenulls=True)
    return sums.groupBy(*key).agg(cosine(pick("l"), pick("r")).alias("similarity"))


def word_similarity(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """Cosine of the two words of each row (w1, w2); 0 if one is unknown."""
    one = vectors.select(F.col("token").alias("w1"), F.col("vector").alias("v1"))
    two = vectors.select(F.col("token").alias("w2"), F.col("vector").alias("v2"))
    return (pairs.join(one, "w1", "left").join(two, "w2", "left")
            .select("w1", "w2", F.coalesce(cosine(F.col("v1"), F.col("v2")), F.lit(0.0)).alias("similarity")))


def in_vocabulary(words: DataFrame, vectors: DataFrame) -> DataFrame:
    """Each word with a flag ``known``."""
    known = vectors.select("token", F.lit(True).alias("known")).distinct()
    return words.join(known, "token", "left").fillna(False, ["known"])


def nearest_words(vectors: DataFrame, asked: Sequence[str], k: int = 10) -> DataFrame:
    """Top ``k`` words by cosine for a short list of asked words; an unknown word returns itself.

    The asked vectors become one scalar value, so the vocabulary is read once, row by row, and each
    partition passes on at most k rows per asked word.
    """
    spark = vectors.sparkSession
    wanted = vectors.where(F.col("token").isin(*asked)).select(
        F.struct(F.col("token").alias("word"), F.col("vector").alias("v")).alias("q"))
    # At most len(asked) rows, gathered into one scalar.
    lists = wanted.agg(F.collect_list("q").alias("qs")).scalar()
    scored = (vectors.select(F.col("token").alias("neighbour"), "vector", F.explode(lists).alias("q"))
              .where(F.col("q.word") != F.col("neighbour"))
              .select("q.word", "neighbour", cosine(F.col("q.v"), F.col("vector")).alias("similarity")))
    order = Window.partitionBy("word").orderBy(F.desc("similarity"), "neighbour")
    top = (scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
           .select("word", "rank", "neighbour", "similarity"))
    words = spark.createDataFrame([(w,) for w in dict.fromkeys(asked)], "token string")
    unknown = words.join(vectors, "token", "left_anti").select(
        F.col("token").alias("word"), F.lit(1).alias("rank"), F.col("token").alias("neighbour"),
        F.lit(1.0).alias("similarity"))
    return top.unionByName(unknown)


def unit(vectors: DataFrame) -> DataFrame:
    """Vectors scaled to length 1, those without length dropped."""
    return (vectors.withColumn("_n", norm(F.col("vector"))).where("_n > 0")
            .select("token", scale(F.col("vector").cast("array<double>"), 1 / F.col("_n")).alias("vector")))


def train_vectors(sentences: DataFrame, tokens: str, dim: int = 300, min_count: int = 5,
                  seed: int = 42, max_iter: int | None = None, partitions: int | None = None) -> DataFrame:
    """Skip-gram word vectors as a (token, vector) table, trained in ``partitions`` parts (default: one per core).

    ``max_iter`` passes are made; by default five, or one per part if there are more parts, as a pass gives each part one look at its share only.
    Spark's trainer holds vocabulary times ``dim`` numbers on the driver and sends them to every task: raise ``min_count`` until
    that fits.
    """
    from pyspark.ml.feature import Word2Vec
    from pyspark.ml.functions import vector_to_array

    parts = partitions or sentences.sparkSession.sparkContext.defaultParallelism
    model = Word2Vec(vectorSize=dim, minCount=min_count, inputCol=tokens, outputCol="_v", seed=seed,
                     maxIter=max(PASSES, parts) if max_iter is None else max_iter, numPartitions=parts).fit(sentences)
    return model.getVectors().select(F.col("word").alias("token"),
                                     vector_to_array("vector", "float32").alias("vector"))
