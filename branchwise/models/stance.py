"""Four-class stance classifier on word-vector features."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, functions as F

from branchwise.operators import embed
from branchwise.operators.metrics import confusion, scores

CLASSES = [0, 1, 2, 3]


def vector_features(messages: DataFrame, context: DataFrame, members: DataFrame, vectors: DataFrame, dim: int,
                    branch: Sequence[str]) -> DataFrame:
    """msg_id and ``features``: mean vector of the message, of its source, and the three cosines.

    Messages without a known token in themselves or in their source have no features and are left out.
    """
    from branchwise.session import durable

    vecs = durable(embed.message_vectors(messages, ["msg_id"], F.col("tokens"), vectors, dim))
    average = lambda side: embed.average_vector(F.col(f"{side}.vsum"), F.col(f"{side}.n_tokens"), dim)
    return (embed.similarities(context, members, vecs, list(branch), dim, sums=True)
            .where("own.n_known > 0 and src.n_known > 0")
            .select("msg_id", array_to_vector(F.concat(average("own"), average("src"), F.array("sim_to_src", "sim_to_prev", "sim_to_branch"))).alias("features")))


def fit(train: DataFrame, kind: str = "logistic", max_iter: int = 50, hidden: Sequence[int] = (50,), seed: int = 42):
    """``train`` has features and stance. Classes are weighted by their inverse frequency, as most
    messages only comment (the perceptron of Spark takes no weights)."""
    labelled = train.where("stance is not null").withColumn("label", F.col("stance").cast("double"))
    if kind == "logistic":
        n = labelled.groupBy("stance").agg(F.count(F.lit(1)).alias("_n"))
        total = n.agg(F.sum("_n") / F.count(F.lit(1))).scalar()
        weighted = labelled.join(n.withColumn("weight", total / F.col("_n")).drop("_n"), "stance")
        return LogisticRegression(maxIter=max_iter, weightCol="weight", family="multinomial", regParam=0.01,
                                  predictionCol="predicted").fit(weighted)
    if kind == "perceptron":
        width = labelled.select("features").head()["features"].size
        return MultilayerPerceptronClassifier(layers=[width, *hidden, len(CLASSES)], maxIter=max_iter, seed=seed,
                                              predictionCol="predicted").fit(labelled)
    raise ValueError(f"kind must be logistic or perceptron, got {kind}")


def predict(features: DataFrame, model) -> DataFrame:
    return (model.transform(features).withColumn("predicted", F.col("predicted").cast("int"))
            .drop("rawPrediction", "probability"))


def test(features: DataFrame, model) -> tuple[DataFrame, DataFrame]:
    """(scores, confusion matrix) on labelled rows."""
    judged = predict(features.where("stance is not null"), model).withColumnRenamed("stance", "actual")
    return scores(judged), confusion(judged, CLASSES)


def grid(train: DataFrame, held_out: DataFrame, combinations: Sequence[Mapping], epochs: Sequence[int]) -> DataFrame:
    """Scores per parameter combination and number of iterations, as an epoch table."""
    out = None
    for params in combinations:
        for epoch in epochs:
            result, _ = test(held_out, fit(train, max_iter=epoch, **params))
            row = result.select(*[F.lit(str(v)).alias(k) for k, v in params.items()], F.lit(epoch).alias("epoch"),
                                "accuracy", "f1_macro", "f1_micro")
            out = row if out is None else out.unionByName(row)
    return out
