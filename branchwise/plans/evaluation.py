"""Cross-corpus evaluation of the claim models by k-fold cross validation."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from branchwise.models import hmm
from branchwise.operators import splits
from branchwise.operators.metrics import METRICS, fold_means, scores
from branchwise.operators.sequences import per_branch, prepare
from branchwise.operators.tree import length_bucket
from branchwise.session import durable

BRANCH = ["source_id", "leaf_id"]


@dataclass(frozen=True)
class Config:
    unverified_cast: str = "true"
    remove_commenting: bool = True
    test: tuple[str, ...] = ()
    kind: str = "gaussian"
    states: int = 2
    timestamps: bool = False
    by_length: bool = False

    @property
    def view(self) -> str:
        """What the rows look like: configurations of one view share them."""
        return f"{self.unverified_cast}/{str(self.remove_commenting).lower()}"

    @property
    def shape(self) -> hmm.Shape:
        return hmm.Shape(self.kind, self.states, self.timestamps)


def grid(corpora: Sequence[str], states: Sequence[int] = (2,), timestamps: bool = True, by_length: bool = False) -> list[Config]:
    """All combinations of cast, commenting removal, test corpus, model kind and state count. Time
    features only go with the gaussian models."""
    tests = [(c,) for c in corpora] + ([tuple(corpora)] if len(corpora) > 1 else [])
    return [Config(cast, remove, test, kind, n, ts, by_length)
            for cast in ("true", "false") for remove in (True, False) for test in tests
            for kind in ("gaussian", "discrete") for n in states
            for ts in ((False, True) if timestamps and kind == "gaussian" else (False,))]


def _views(seqs: DataFrame, configs: Sequence[Config]) -> DataFrame:
    """The prepared rows of every view that a configuration asks for, with its name."""
    out = None
    for cast, remove, view in dict.fromkeys((c.unverified_cast, c.remove_commenting, c.view) for c in configs):
        rows = prepare(seqs, cast, remove).withColumn("view", F.lit(view))
        out = rows if out is None else out.unionByName(rows)
    return out


def _stems(test: tuple[str, ...], corpora: Sequence[str], fold: int) -> dict[str, str]:
    """Which models answer for a fold of the tested corpora, by the name they are reported under.

    An untested corpus trains its own model once (``all``) and joins the mixed model of every fold; a tested one leaves out its test fold.
    """
    own = {c: f"{c}@{fold}" if c in test else f"{c}@all" for c in corpora}
    mixed = {"+".join(corpora): f"{'+'.join(corpora)}~{'+'.join(test)}@{fold}"} if len(corpora) > 1 else {}
    return {**own, **mixed}


def _trained(tests: Sequence[tuple[str, ...]], corpora: Sequence[str], folds: int) -> Column:
    """Names of all models that a row of ``corpus`` and ``fold`` trains: those of any test set, each once."""
    corpus, fold = F.col("corpus"), F.col("fold")
    names = {}
    for test in tests:
        for f in range(folds):
            apart = corpus.isin(*test) & fold.eqNullSafe(F.lit(f))  # tested in this fold
            for name, stem in _stems(test, corpora, f).items():
                names[stem] = F.when((corpus == name if name in corpora else F.lit(True)) & ~apart, F.lit(stem))
    return F.array_compact(F.array(*names.values()))


def assign_all(seqs: DataFrame, configs: Sequence[Config], corpora: Sequence[str], folds: int,
               shuffle: tuple[Column, list[Column]]) -> DataFrame:
    """Rows of all views with the fold of their branch and the models they train (``train``)."""
    rows = durable(_views(seqs, configs))
    branches = rows.select("view", "corpus", *BRANCH).distinct()
    folded = splits.kfold(branches, folds, *shuffle, by=["view", "corpus"])
    tests = list(dict.fromkeys(c.test for c in configs))
    return rows.join(folded, ["view", "corpus", *BRANCH]).withColumn("train", _trained(tests, corpora, folds))


def _answers(spark, configs: Sequence[Config], corpora: Sequence[str], folds: int) -> DataFrame:
    """A row per configuration, fold and reported model: the view, shape and stem that answers. Small: its size is the grid's."""
    rows = [(i, c.view, str(c.shape), list(c.test), f, name, stem)
            for i, c in enumerate(configs) for f in range(folds) for name, stem in _stems(c.test, corpora, f).items()]
    return spark.createDataFrame(rows, "config int, view string, shape string, test array<string>, fold int, model string, stem string")


def _reported(spark, configs: Sequence[Config]) -> DataFrame:
    rows = [(i, c.unverified_cast, str(c.remove_commenting).lower(), "+".join(c.test), c.kind, c.states, c.shape.width > 1) for i, c in enumerate(configs)]
    return spark.createDataFrame(rows, "config int, unverified_cast string, remove_commenting string, testdata_type string, model_type string, comp_count int, timestamps boolean")


def evaluate_all(seqs: DataFrame, configs: Sequence[Config], corpora: Sequence[str], folds: int = 5, n_iter: int = 10, seed: int = 42,
                 shuffle: tuple[Column, list[Column]] | None = None, fitted: bool = True) -> DataFrame:
    """Mean metrics per configuration and model: each corpus, all together, and a majority twin of each.

    ``seqs`` has corpus, source_id, leaf_id, part, obs, veracity. All models of all configurations and folds are fitted in the same passes over the
    union of the views, each of them once however many configurations it serves; one more pass scores every test branch with all models that
    judge it. Without ``fitted`` only the majority twins are judged. ``by_length`` must agree in all configurations.
    """
    spark, by_length = seqs.sparkSession, configs[0].by_length
    rows = durable(assign_all(seqs, configs, corpora, folds, shuffle or splits.shuffled(BRANCH, seed)))
    ids = ["view", "corpus", *BRANCH]  # equal ids in two corpora are different branches
    lengths = rows.groupBy(*ids).agg(F.sum(F.size("obs")).alias("n_obs"), F.max("veracity").alias("actual"), F.max("fold").alias("fold"))
    tested = durable(lengths.where("fold is not null"))
    # every test branch with all that is asked about it
    asked = tested.join(F.broadcast(_answers(spark, configs, corpora, folds)), ["view", "fold"]).where(F.array_contains("test", F.col("corpus")))
    votes = (per_branch(rows.select(*ids, "part", "obs", "veracity", "train")).select("view", "veracity", F.explode("train").alias("stem"))
             .groupBy("view", "stem", "veracity").agg(F.count(F.lit(1)).alias("n"))
             .groupBy("view", "stem").agg(F.max(F.struct("n", (-F.col("veracity")).alias("neg"))).alias("_b")))
    votes = votes.select("view", "stem", (-F.col("_b.neg")).alias("predicted"))
    judged = asked.join(votes, ["view", "stem"], "left").select(
        "config", F.concat("model", F.lit("_majority")).alias("model"), "fold", "n_obs", "actual", F.coalesce("predicted", F.lit(-1)).alias("predicted"))
    if fitted:
        shapes = list(dict.fromkeys(c.shape for c in configs))
        of_view = F.transform("train", lambda m: F.concat("view", F.lit(":"), m, F.lit("|"), F.col("veracity").cast("string")))
        models = hmm.fit_shapes(rows.withColumn("keys", of_view), shapes, n_iter, seed=seed, branch=ids)
        # the models that judge a branch of this view, corpus and fold: few, and the same for all such branches
        wanted: dict[tuple, set[str]] = {}
        for c in configs:
            for f in range(folds):
                for corpus in c.test:
                    wanted.setdefault((c.view, corpus, f), set()).update(f"{c.shape}/{c.view}:{stem}" for stem in _stems(c.test, corpora, f).values())
        by_stem: dict[str, list[str]] = {}
        for key in models:
            by_stem.setdefault(key.rsplit("|", 1)[0], []).append(key)
        table = [(v, corpus, f, sorted(k for stem in stems for k in by_stem.get(stem, []))) for (v, corpus, f), stems in wanted.items()]
        judges = spark.createDataFrame(table, "view string, corpus string, fold int, keys array<string>")
        scored = rows.drop("train").join(F.broadcast(judges), ["view", "corpus", "fold"]).where(F.size("keys") > 0)
        found = hmm.likelihoods(scored, models, ids)
        # "<shape>/<view>:<stem>|<label>"
        label = F.substring_index("key", "|", -1).cast("int")
        best = (found.groupBy("branch", F.substring_index("key", "|", 1).alias("judge")).agg(F.max(F.struct("ll", (-label).alias("neg"))).alias("_b"))
                .select(F.col("branch").alias("_branch"), "judge", (-F.col("_b.neg")).alias("predicted")))
        asked = asked.withColumn("_branch", F.concat_ws("\x1f", *ids)).withColumn("judge", F.concat("shape", F.lit("/"), "view", F.lit(":"), "stem"))
        # a row per branch and judge: the planner takes what comes out of the Python pass for small, and would send it through the driver
        judged = judged.unionByName(asked.join(best.hint("merge"), ["_branch", "judge"], "left").select(
            "config", "model", "fold", "n_obs", "actual", F.coalesce("predicted", F.lit(-1)).alias("predicted")))
    judged = judged.withColumn("length", length_bucket(F.col("n_obs")))
    by = ["config", "model"] + (["length"] if by_length else [])
    means = fold_means(scores(judged, [*by, "fold"]), by, folds)
    return means.join(F.broadcast(_reported(spark, configs)), "config").select(
        "model", *(["length"] if by_length else []), "unverified_cast", "remove_commenting", "testdata_type", "model_type", "comp_count", "timestamps", *METRICS)


def evaluate(seqs: DataFrame, config: Config, corpora: Sequence[str], folds: int = 5, n_iter: int = 10, seed: int = 42) -> DataFrame:
    """``evaluate_all`` for one configuration."""
    return evaluate_all(seqs, [config], corpora, folds, n_iter, seed).drop("timestamps")


def sweep(seqs: DataFrame, configs: Sequence[Config], corpora: Sequence[str], path: str, folds: int = 5, n_iter: int = 10) -> None:
    """Judge all configurations and append their metric rows."""
    from branchwise.sources.sinks import metric_rows

    found = durable(evaluate_all(seqs, configs, corpora, folds, n_iter))
    for timed in sorted({c.shape.width > 1 for c in configs}):
        metric_rows(found.where(F.col("timestamps") == timed), path, configs[0].by_length, timed)
