import itertools
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from branchwise.models import hmm, majority, stance
from branchwise.operators import metrics as mt, sequences as sq, splits
from branchwise.plans import evaluation
from branchwise.session import durable

SEQ = "corpus string, source_id string, leaf_id string, part int, obs array<struct<stance:int,t:double>>, veracity int"


def sequences(seed=0, n=40, longest=7):
    rng, rows = random.Random(seed), []
    for i in range(n):
        label = i % 2
        length = rng.randrange(1, longest)
        obs = [(rng.choices(range(4), [4, 1, 1, 2] if label else [1, 4, 2, 1])[0], rng.random() * j) for j in range(length)]
        rows.append(("early" if i % 3 else "late", f"s{i // 2}", f"l{i}", 0, obs, label))
    return rows


def cut(rows, size):
    """The same sequences kept in parts."""
    return [(c, s, l, p, obs[p * size:(p + 1) * size], v) for c, s, l, _, obs, v in rows for p in range((len(obs) + size - 1) // size)]


def reference_ll(model, obs):
    """Sum over all state paths."""
    total = 0.0
    for path in itertools.product(range(model.states), repeat=len(obs)):
        p = model.start[path[0]]
        for i, (stance, t) in enumerate(obs):
            if i:
                p *= model.trans[path[i - 1]][path[i]]
            if model.emission is not None:
                p *= model.emission[path[i]][stance]
            else:
                for x, mu, var in zip((stance, t), model.mean[path[i]], model.var[path[i]]):
                    p *= np.exp(-(x - mu) ** 2 / (2 * var)) / np.sqrt(2 * np.pi * var)
        total += p
    return np.log(total)


START, TRANS = np.array([.3, .7]), np.array([[.8, .2], [.1, .9]])
DISCRETE = [hmm.Hmm(0, START, TRANS, emission=np.array([[.7, .1, .1, .1], [.1, .2, .3, .4]])),
            hmm.Hmm(1, START, TRANS, emission=np.array([[.25] * 4, [.4, .3, .2, .1]]))]
GAUSS = [hmm.Hmm(0, START, TRANS, mean=np.array([[0., .1], [2., .5]]), var=np.array([[.5, .3], [1., .2]])),
         hmm.Hmm(1, START, TRANS, mean=np.array([[1., .3], [3., .2]]), var=np.array([[1.5, .3], [.4, .6]]))]


@pytest.mark.parametrize("models", [DISCRETE, GAUSS])
def test_score_equals_sum_over_paths(spark, models):
    rows = sequences()
    for data in (rows, cut(rows, 2)):
        seqs = durable(spark.createDataFrame(data, SEQ))
        got = {r.leaf_id: r for r in hmm.score(seqs, models, ["source_id", "leaf_id"]).withColumn("best", hmm.best_label(F.col("lls"))).collect()}
        assert len(got) == len(rows)
        for _, _, leaf, _, obs, _ in rows:
            want = [reference_ll(m, obs) for m in models]
            assert np.allclose([e["ll"] for e in got[leaf].lls], want, atol=1e-8)
            assert got[leaf].best == int(np.argmax(want))


def test_best_label_rules(spark):
    df = spark.createDataFrame([([(2, -1.0), (0, -1.0), (1, -5.0)],), ([],)], "lls array<struct<label:int,ll:double>>")
    assert [r.b for r in df.select(hmm.best_label(F.col("lls")).alias("b")).collect()] == [0, -1]


def test_likelihoods_of_all_sequences_add_up_to_one(spark):
    rows = [("c", "s", f"{i}", 0, [(s, 0.0) for s in combo], 0) for i, combo in enumerate(itertools.product(range(4), repeat=3))]
    seqs = spark.createDataFrame(rows, SEQ)
    total = hmm.score(seqs, DISCRETE[:1], ["leaf_id"]).agg(F.sum(F.exp(F.col("lls")[0]["ll"])).alias("p")).head().p
    assert abs(total - 1) < 1e-9


def test_long_sequence_does_not_underflow(spark):
    rows = [("c", "s", "x", 0, [(i % 4, 0.1) for i in range(3000)], 0)]
    ll = hmm.score(spark.createDataFrame(rows, SEQ), GAUSS, ["leaf_id"]).head().lls
    assert all(np.isfinite(e["ll"]) and e["ll"] < -1000 for e in ll)


@pytest.mark.parametrize("kind,timestamps", [("gaussian", True), ("discrete", False)])
def test_fit_improves_and_parts_change_nothing(spark, kind, timestamps):
    rows = sequences(seed=2, n=30)
    whole, parts = [], []
    a = hmm.fit(spark.createDataFrame(rows, SEQ), kind=kind, timestamps=timestamps, n_iter=4, tol=-1, history=whole)
    b = hmm.fit(spark.createDataFrame(cut(rows, 2), SEQ), kind=kind, timestamps=timestamps, n_iter=4, tol=-1, history=parts)
    for key in a:
        lls = [h[key] for h in whole]
        assert all(y >= x - 1e-6 for x, y in zip(lls, lls[1:])) and lls[-1] > lls[0]
        assert np.allclose(lls, [h[key] for h in parts], atol=1e-6)
        assert np.allclose(a[key].trans, b[key].trans, atol=1e-6)
        assert np.allclose(a[key].trans.sum(1), 1) and abs(a[key].start.sum() - 1) < 1e-9
    back = hmm.from_table(hmm.to_table(spark, a))
    assert all(np.allclose(back[k].trans, a[k].trans) and back[k].label == a[k].label for k in a)


def test_fit_rejects_unknown_kind(spark):
    with pytest.raises(ValueError):
        hmm.fit(spark.createDataFrame(sequences(n=2), SEQ), kind="poisson")


def test_prepare(spark):
    seqs = spark.createDataFrame([("c", "s", "a", 0, [(3, 0.0), (1, 0.2)], 2), ("c", "s", "b", 0, [(3, 0.0)], 2)], SEQ)
    got = sq.prepare(seqs, "true", remove_commenting=True).collect()
    assert [(r.leaf_id, r.veracity, [o.stance for o in r.obs]) for r in got] == [("a", 1, [1])]
    assert {r.veracity for r in sq.prepare(seqs, "none").collect()} == {2}


def brute_scores(pairs):
    n = len(pairs)
    labels = sorted({x for p in pairs for x in p})
    f1 = []
    for c in labels:
        tp = sum(a == p == c for a, p in pairs)
        fp, fn = sum(p == c != a for a, p in pairs), sum(a == c != p for a, p in pairs)
        f1.append(2 * tp / (2 * tp + fp + fn) if tp + fp + fn else 0.0)
    one = [(a, p) for a, p in pairs]
    tp, pp, ap = sum(a == p == 1 for a, p in one), sum(p == 1 for _, p in one), sum(a == 1 for a, _ in one)
    return {"f1_macro": sum(f1) / len(f1), "accuracy": sum(a == p for a, p in pairs) / n, "f1_micro": sum(a == p for a, p in pairs) / n,
            "precision": tp / pp if pp else 0.0, "recall": tp / ap if ap else 0.0}


def test_scores_and_confusion(spark):
    rng = random.Random(4)
    groups = {g: [(rng.randrange(g + 1), rng.randrange(3)) for _ in range(25)] for g in range(3)}
    df = spark.createDataFrame([(g, a, p) for g, pairs in groups.items() for a, p in pairs], "g int, actual int, predicted int")
    got = {r.g: r for r in mt.scores(df, ["g"]).collect()}
    for g, pairs in groups.items():
        for name, value in brute_scores(pairs).items():
            assert abs(got[g][name] - value) < 1e-9, (g, name)
    cells = {(r.actual, r.predicted): r.n for r in mt.confusion(df, [0, 1, 2]).collect()}
    want = Counter(p for pairs in groups.values() for p in pairs)
    assert len(cells) == 9 and all(cells[k] == want[k] for k in cells)
    absent = {r.actual: r.accuracy for r in mt.class_accuracy(df.where("g = 0"), [0, 1, 2]).collect()}
    assert absent[1] is None and absent[2] is None


def test_majority_and_epochs(spark):
    df = spark.createDataFrame([(2,), (1,), (1,), (2,), (0,)], "veracity int")
    assert majority.fit(df).head().predicted == 1
    assert {r.predicted for r in majority.predict(df, majority.fit(df)).collect()} == {1}
    epochs = spark.createDataFrame([("a", 1, .2), ("a", 2, .5), ("a", 3, .5)], "p string, epoch int, f1_macro double")
    assert tuple(mt.best_epoch(epochs, ["p"]).head()) == ("a", 2, .5)
    means = mt.fold_means(spark.createDataFrame([("m", .5, .5, .5, .5, .5)], ["model", *mt.METRICS]), ["model"], 5)
    assert abs(means.head().accuracy - 0.1) < 1e-12


def test_splits(spark):
    df = spark.createDataFrame([(i, "a" if i % 5 else "b") for i in range(103)], "id long, label string")
    order = splits.shuffled(["id"])
    folds = Counter(r.fold for r in splits.kfold(df, 5, *order).collect())
    assert folds == {0: 20, 1: 20, 2: 20, 3: 20, 4: 20, None: 3}
    assert splits.kfold(df.limit(3), 5, *order).where("fold is not null").count() == 0
    assert splits.holdout(df, 0.2, *order).where("is_test").count() == 20
    strata = Counter((r.label, r.is_test) for r in splits.stratified(df, "label", 0.25, *order).collect())
    assert strata["a", True] == 21 and strata["b", True] == 5  # 82 and 21 rows, halves rounded up
    again = {r.id for r in splits.holdout(df.repartition(3), 0.2, *order).where("is_test").collect()}
    assert again == {r.id for r in splits.holdout(df, 0.2, *order).where("is_test").collect()}


def test_fold_assignment_never_trains_on_its_test_rows(spark):
    seqs = spark.createDataFrame(sequences(n=40), SEQ)
    config = evaluation.Config(test=("early",))
    rows = evaluation.assign_all(seqs, [config], ["early", "late"], 3, splits.shuffled(["leaf_id"])).collect()
    for r in rows:
        if r.corpus == "late":
            assert sorted(r.train) == [*[f"early+late~early@{f}" for f in range(3)], "late@all"]
        else:
            assert all(not m.endswith(f"@{r.fold}") for m in r.train)
            assert len(r.train) == (4 if r.fold is not None else 6)
    both = evaluation.Config(test=("early", "late"))
    for r in evaluation.assign_all(seqs, [config, both], ["early", "late"], 3, splits.shuffled(["leaf_id"])).collect():
        mixed = [m for m in r.train if "~early+late@" in m]
        assert all(not m.endswith(f"@{r.fold}") for m in mixed) and len(mixed) == (2 if r.fold is not None else 3)


def test_a_grid_in_shared_passes_equals_its_configurations(spark):
    seqs = durable(spark.createDataFrame(sequences(n=30), SEQ))
    configs = [c for c in evaluation.grid(["early", "late"]) if c.test != ("late",)][::11]
    key = ["unverified_cast", "remove_commenting", "testdata_type", "model_type", "timestamps", "model"]
    rounded = lambda rows: sorted((*[r[k] for k in key], *[round(r[m], 9) for m in mt.METRICS]) for r in rows)
    together = rounded(evaluation.evaluate_all(seqs, configs, ["early", "late"], folds=2, n_iter=2).collect())
    apart = rounded([r for c in configs for r in evaluation.evaluate_all(seqs, [c], ["early", "late"], folds=2, n_iter=2).collect()])
    assert together == apart and len(together) == 6 * len(configs)


def test_scores_of_the_grid_are_not_broadcast(spark):
    seqs = durable(spark.createDataFrame(sequences(n=30), SEQ))
    found = evaluation.evaluate_all(seqs, evaluation.grid(["early", "late"])[:1], ["early", "late"], folds=2, n_iter=1)
    lines = found._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = [len(x) - len(x.lstrip(" :+-")) for x in lines]
    assert any("MapInPandas" in x for x in lines)
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line:
            end = next((j for j in range(i + 1, len(lines)) if depth[j] <= depth[i]), len(lines))
            assert not any("MapInPandas" in x for x in lines[i:end])  # a row per branch and judge


def test_parts_are_never_a_result(spark):
    from tests.test_tree import make

    rows = [("s", "s", None, 0, "Commenting")] + [("s", f"c{i}", f"c{i - 1}" if i else "s", i + 1, "Commenting" if i < 4 else "Denying") for i in range(7)]
    rows += [("s", "z", "s", 20, "Querying"), ("t", "t", None, 0, "x"), ("t", "q", "t", 1, "Denying")]
    m = durable(make(spark, rows).withColumn("truth", F.when(F.col("is_source"), F.when(F.col("source_id") == "s", "True").otherwise("False"))))
    cut_up, plain = (durable(sq.from_messages(m, part=n)) for n in (2, 10**9))
    assert cut_up.count() > plain.count() == 3
    shape = lambda df: sorted((r.leaf_id, r.veracity, [tuple(o) for o in r.obs]) for r in sq.whole(df).collect())
    for remove in (False, True):
        a, b = (durable(sq.prepare(s, remove_commenting=remove)) for s in (cut_up, plain))
        assert shape(a) == shape(b)
        assert sorted(map(tuple, sq.per_branch(a).collect())) == sorted(map(tuple, sq.per_branch(b).collect()))
        assert majority.fit(sq.per_branch(a)).collect() == majority.fit(sq.per_branch(b)).collect()
    # a branch whose first parts only comment still votes and is judged
    results = []
    for seqs in (cut_up, plain):
        both = seqs.withColumn("corpus", F.lit("early")).unionByName(seqs.withColumn("corpus", F.lit("late")))  # equal ids in two corpora
        config = evaluation.Config(unverified_cast="true", remove_commenting=True, test=("early", "late"), kind="discrete")
        got = evaluation.evaluate(durable(both), config, ["early", "late"], folds=2, n_iter=2).collect()
        results.append(sorted((r.model, *[round(r[x], 9) for x in mt.METRICS]) for r in got))
    assert results[0] == results[1]


def test_evaluation_and_grid(spark):
    seqs = durable(spark.createDataFrame(cut(sequences(n=36), 3), SEQ))
    config = evaluation.Config(unverified_cast="true", remove_commenting=False, test=("early", "late"), kind="discrete", by_length=True)
    rows = evaluation.evaluate(seqs, config, ["early", "late"], folds=2, n_iter=2).collect()
    assert {r.model for r in rows} == {"early", "late", "early+late", "early_majority", "late_majority", "early+late_majority"}
    assert all(0 <= r[m] <= 1 for r in rows for m in mt.METRICS)
    configs = evaluation.grid(["early", "late"])
    assert len(configs) == 2 * 2 * 3 * 3 and not any(c.timestamps and c.kind == "discrete" for c in configs)


def test_a_branch_in_very_many_parts(spark):
    rng = random.Random(3)
    obs = [(rng.choices(range(4), [4, 1, 1, 2])[0], rng.random()) for _ in range(1_500)]
    rows = [("c", "s", "long", 0, obs, 1), *sequences(n=6)]
    whole, parts = durable(spark.createDataFrame(rows, SEQ)), durable(spark.createDataFrame(cut(rows, 37), SEQ))  # 41 parts
    lls = [{r.leaf_id: [e["ll"] for e in r.lls] for r in hmm.score(s, GAUSS, ["leaf_id"]).collect()} for s in (whole, parts)]
    assert all(np.allclose(lls[0][k], lls[1][k], rtol=1e-9) for k in lls[0])
    named = [s.withColumn("keys", F.array(F.lit("a"), F.lit("b"))) for s in (whole, parts)]
    many = [{(r.branch, r.key): r.ll for r in hmm.likelihoods(s, {"a": GAUSS[0], "b": DISCRETE[1]}, ["leaf_id"]).collect()} for s in named]
    assert many[0].keys() == many[1].keys() and all(abs(many[0][k] - many[1][k]) < 1e-6 * abs(many[0][k]) for k in many[0])
    assert abs(many[1]["long", "a"] - lls[0]["long"][0]) < 1e-6 * abs(lls[0]["long"][0])
    a, b = (hmm.fit(s, kind="gaussian", timestamps=True, n_iter=1, tol=-1) for s in (whole, parts))
    assert all(np.allclose(a[k].trans, b[k].trans, atol=1e-8) and np.allclose(a[k].mean, b[k].mean, atol=1e-8) for k in a)


def test_stance_models(spark):
    from pyspark.ml.functions import array_to_vector

    from branchwise.models import stance

    rng = random.Random(1)
    rows = [(f"m{i}", i % 4, [float(i % 4 == k) + rng.random() * .2 for k in range(4)]) for i in range(80)]
    df = durable(spark.createDataFrame(rows, "msg_id string, stance int, x array<double>").select("msg_id", "stance", array_to_vector("x").alias("features")))
    for kind in ("logistic", "perceptron"):
        result, cells = stance.test(df, stance.fit(df, kind=kind, max_iter=30, hidden=(8,)))
        assert result.head().accuracy > 0.9 and cells.agg(F.sum("n")).head()[0] == 80
    table = stance.grid(df, df, [{"kind": "logistic"}], [1, 5])
    assert table.count() == 2 and set(table.columns) == {"kind", "epoch", "accuracy", "f1_macro", "f1_micro"}
    with pytest.raises(ValueError):
        stance.fit(df, kind="forest")


def test_release_removes_own_tables(spark):
    import os

    from branchwise import session

    durable(spark.range(3))
    own = f"{session.shared_dir(spark)}/{spark.sparkContext.applicationId}"
    assert os.path.isdir(own)
    session.release(spark)
    assert not os.path.exists(own)


def test_training_goes_on_from_the_last_epoch(spark, tmp_path):
    from branchwise.models import epochs

    rng = np.random.default_rng(4)
    y = rng.integers(0, 4, 300)
    x = np.eye(4)[y] * 2 + rng.standard_normal((300, 4)) * 0.3
    rows = durable(spark.createDataFrame([(f"m{i}", v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, y))] + [("none", [0.0] * 4, None)],
                                         "msg_id string, features array<double>, stance int"))
    settings = [epochs.Setting(rate=0.2), epochs.Setting(hidden=8, rate=0.1)]
    key = lambda df: {(r.params, r.epoch): (r.loss, r.accuracy) for r in df.collect()}
    once = key(epochs.train(rows, rows, settings, 4, f"{tmp_path}/a", batches=2))
    epochs.train(rows, rows, settings, 2, f"{tmp_path}/b", batches=2)
    twice = key(epochs.train(rows, rows, settings, 4, f"{tmp_path}/b", batches=2))
    assert len(once) == 8 and once.keys() == twice.keys() and all(np.allclose(once[k], twice[k], rtol=1e-9) for k in once)
    for s in settings:
        assert once[str(s), 3][0] < once[str(s), 0][0] and once[str(s), 3][1] > 0.8
    alone = key(epochs.train(rows, rows, settings[1:], 2, f"{tmp_path}/c", batches=2))
    assert all(np.allclose(alone[k], once[k], rtol=1e-9) for k in alone)  # settings don't touch each other


def test_gradients_equal_differences():
    from branchwise.models import epochs

    rng = np.random.default_rng(5)
    x, y, weight = rng.standard_normal((12, 3)), rng.integers(0, 4, 12), rng.random(12)
    for setting in (epochs.Setting(), epochs.Setting(hidden=5)):
        w = setting.start(3, 1)
        found = epochs.gradient(setting, w, x, y, weight)
        for i in range(len(w)):
            step = np.zeros(len(w))
            step[i] = 1e-5
            slope = (epochs.gradient(setting, w + step, x, y, weight)[-2] - epochs.gradient(setting, w - step, x, y, weight)[-2]) / 2e-5
            assert abs(slope - found[i]) < 1e-5


def test_stance_features_meet_each_vector_once(spark):
    """Values by hand, and a join for each of own, previous, branch and source vector besides the branch's sum."""
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 2.0])], "token string, vector array<double>")
    said = {"s": ["a"], "x": ["b", "?"], "y": ["a", "b"], "z": ["?"], "t": ["?"], "w": ["a"]}
    threads = {"s": ["s", "x", "y", "z"], "t": ["t", "w"]}
    messages = spark.createDataFrame([(k, v) for k, v in said.items()], "msg_id string, tokens array<string>")
    members = spark.createDataFrame([(s, m[-1], i, k) for s, m in threads.items() for i, k in enumerate(m)], "source_id string, leaf_id string, pos int, msg_id string")
    context = spark.createDataFrame([(k, m[i], s, m[-1]) for s, m in threads.items() for i, k in enumerate(m[1:])], "msg_id string, prev_id string, source_id string, leaf_id string")
    found = stance.vector_features(messages, context, members, vectors, 2, ["source_id", "leaf_id"])
    got = {r.msg_id: r.features.toArray() for r in found.collect()}
    total = {k: sum((np.array({"a": [1.0, 0.0], "b": [0.0, 2.0]}.get(w, [0.0, 0.0])) for w in v), np.zeros(2)) for k, v in said.items()}
    cos = lambda u, v: u @ v / np.linalg.norm(u) / np.linalg.norm(v)
    pool = sum(total[k] for k in threads["s"])
    assert set(got) == {"x", "y"}  # z knows no token, the source of w neither
    for k, before in (("x", "s"), ("y", "x")):
        want = [*total[k] / len(said[k]), *total["s"], cos(total[k], total["s"]), cos(total[k], total[before]), cos(total[k], pool)]
        np.testing.assert_allclose(got[k], want)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join ") <= 5
