"""One hidden Markov model per claim class over branch sequences.

Scoring is a column expression. Fitting is Baum-Welch: each iteration is one pass over the training
rows in which every partition reduces to sufficient statistics; only these reach the driver, whose
size depends on the number of models and states, not on the data.
"""

from __future__ import annotations

import sys
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from branchwise.functions.vectors import vector_sum
from branchwise.operators.scan import products
from branchwise.session import durable

# Ship the helpers below inside the tasks, so that workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SYMBOLS = 4
FLOOR = 1e-12
LOG_FLOOR = -690.0
VARIANCE_FLOOR = 1e-3


@dataclass
class Hmm:
    """Parameters. Discrete: ``emission`` is states x symbols. Gaussian: ``mean`` and ``var`` are
    states x features, the features being the stance code and, if two, the time."""

    label: int
    start: np.ndarray
    trans: np.ndarray
    emission: np.ndarray | None = None
    mean: np.ndarray | None = None
    var: np.ndarray | None = None

    @property
    def states(self) -> int:
        return len(self.start)


# --- scoring: column expressions -------------------------------------------------------------

def _log(p: float) -> float:
    return max(float(np.log(max(p, 1e-300))), LOG_FLOOR)


def _log_emission(model: Hmm, state: int, obs: Column) -> Column:
    if model.emission is not None:
        table = F.array(*[F.lit(_log(p)) for p in model.emission[state]])
        return F.get(table, obs["stance"])
    fields = [obs["stance"].cast("double"), obs["t"]][: model.mean.shape[1]]
    total = F.lit(0.0)
    for x, mu, var in zip(fields, model.mean[state], model.var[state]):
        total = total - F.lit(0.5 * float(np.log(2 * np.pi * var))) - (x - float(mu)) * (x - float(mu)) / float(2 * var)
    return total


def log_sum(terms: Sequence[Column]) -> Column:
    if len(terms) == 1:
        return terms[0]
    top = F.greatest(*terms)
    total = F.lit(0.0)
    for term in terms:
        total = total + F.exp(term - top)
    return top + F.ln(total)


def _advance(model: Hmm, before: Sequence[Column], obs: Column) -> list[Column]:
    n = range(model.states)
    return [log_sum([before[i] + _log(model.trans[i][j]) for i in n]) + _log_emission(model, j, obs) for j in n]


def _forward(model: Hmm, obs: Column) -> Column:
    """Log forward vector after all observations of a row that starts its branch."""
    n = range(model.states)
    first = F.array(*[F.lit(_log(model.start[j])) + _log_emission(model, j, F.get(obs, F.lit(0))) for j in n])
    rest = F.slice(obs, F.lit(2), F.greatest(F.size(obs) - 1, F.lit(0)))
    return F.aggregate(rest, first, lambda acc, o: F.array(*_advance(model, [acc[i] for i in n], o)))


def _transfer(model: Hmm, obs: Column) -> Column:
    """Log matrix (row major) that carries a forward vector over a later part of a branch."""
    n = range(model.states)
    head = F.get(obs, F.lit(0))
    first = F.array(*[F.lit(_log(model.trans[i][j])) + _log_emission(model, j, head) for i in n for j in n])
    rest = F.slice(obs, F.lit(2), F.greatest(F.size(obs) - 1, F.lit(0)))

    def step(acc: Column, o: Column) -> Column:
        rows = [_advance(model, [acc[i * model.states + k] for k in n], o) for i in n]
        return F.array(*[cell for row in rows for cell in row])

    return F.aggregate(rest, first, step)


def log_likelihood(model: Hmm, obs: Column) -> Column:
    """Log probability of a whole sequence in one row, in log space throughout."""
    end = _forward(model, obs)
    return F.aggregate(end, F.lit(None).cast("double"),
                       lambda acc, x: F.when(acc.isNull(), x).otherwise(log_sum([acc, x])))


def score(seqs: DataFrame, models: Sequence[Hmm], branch: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """``lls``: array of (label, ll) per branch. Branches kept in several parts are put together
    from one small matrix per part; all others are scored row by row without a shuffle. ``seqs`` is
    looked at twice, so pass a table."""
    entries = lambda value: F.array(*[F.struct(F.lit(m.label).alias("label"), value(m).alias("ll")) for m in models])
    if "part" not in seqs.columns or not seqs.where("part > 0").take(1):
        return seqs.select(*branch, *keep, entries(lambda m: log_likelihood(m, F.col("obs"))).alias("lls"))
    split = seqs.where("part > 0").select(*branch).distinct()
    single = (seqs.join(split, list(branch), "left_anti")
              .select(*branch, *keep, entries(lambda m: log_likelihood(m, F.col("obs"))).alias("lls")))
    parts = seqs.join(split, list(branch), "left_semi").select(
        *branch, *keep, "part",
        *[F.when(F.col("part") == 0, _forward(m, F.col("obs"))).otherwise(_transfer(m, F.col("obs"))).alias(f"m{i}")
          for i, m in enumerate(models)])
    # one row per (part, model): a forward vector becomes a matrix of equal rows
    square = lambda i, m: F.when(F.size(f"m{i}") == m.states, F.flatten(F.array_repeat(F.col(f"m{i}"), m.states))).otherwise(F.col(f"m{i}"))
    firsts = split.join(seqs.select(*branch, "part"), list(branch)).groupBy(*branch).agg(F.min("part").alias("_first"))
    # a branch whose part 0 became empty by filtering starts in its first remaining part
    starts = [F.array(*[F.lit(_log(p)) for p in m.start]) for m in models]
    entered = lambda i, m: F.when((F.col("part") == F.col("_first")) & (F.col("part") > 0), F.flatten(F.array_repeat(F.array(*[
        log_sum([starts[i][a] + F.col(f"m{i}")[a * m.states + b] for a in range(m.states)]) for b in range(m.states)]), m.states))).otherwise(square(i, m))
    logs = parts.join(firsts, list(branch)).select(
        *branch, *keep, "part", F.posexplode(F.array(*[entered(i, m) for i, m in enumerate(models)])).alias("_model", "_logs"))
    top = F.array_max("_logs")
    mats = logs.select(*branch, *keep, "part", "_model", F.transform("_logs", lambda x: F.exp(x - top)).alias("mat"), top.alias("log"))
    done = products(mats, [*branch, "_model"]).where(F.col("place") == F.col("n_parts") - 1)
    # every row of the product is the last forward vector
    states = F.element_at(F.array(*[F.lit(m.states) for m in models]), F.col("_model") + 1)
    end = F.aggregate(F.slice("pre", F.lit(1), states), F.lit(0.0), lambda acc, x: acc + x)
    label = F.element_at(F.array(*[F.lit(m.label) for m in models]), F.col("_model") + 1)
    one = F.struct("_model", F.struct(label.alias("label"), (F.ln(end) + F.col("pre_log")).alias("ll")).alias("e"))
    long = done.groupBy(*branch, *keep).agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["e"]).alias("lls"))
    return single.unionByName(long)


def best_label(lls: Column) -> Column:
    """Label of the highest log likelihood, the smaller label on a tie, -1 without models."""
    best = F.array_max(F.transform(lls, lambda e: F.struct(e["ll"].alias("ll"), (-e["label"]).alias("neg"))))
    return F.coalesce(-best["neg"], F.lit(-1))


# --- fitting -----------------------------------------------------------------------------------

@dataclass(frozen=True)
class Shape:
    """What models are fitted: their emissions, number of states and whether they see times."""

    kind: str = "gaussian"
    states: int = 2
    timestamps: bool = False

    def __post_init__(self):
        if self.kind not in ("gaussian", "discrete"):
            raise ValueError(f"kind must be gaussian or discrete, got {self.kind}")

    @property
    def width(self) -> int:
        return 2 if self.timestamps and self.kind == "gaussian" else 1

    def __str__(self) -> str:
        return f"{self.kind}{self.states}" + ("t" if self.width > 1 else "")


def _log_b(models: Sequence[Hmm], x: np.ndarray) -> np.ndarray:
    """(models, sequences, length, states) log emission of x = (sequences, length, features), for models of one shape."""
    if models[0].emission is not None:
        table = np.log(np.maximum(np.stack([m.emission for m in models]), FLOOR))
        return np.moveaxis(table[:, :, x[..., 0].astype(int)], 1, -1)
    mean, var = (np.stack([getattr(m, f) for m in models])[:, None, None] for f in ("mean", "var"))
    diff = x[None, :, :, None, :mean.shape[-1]] - mean
    return -0.5 * (np.log(2 * np.pi * var) + diff * diff / var).sum(-1)


def _stats_size(model: Hmm) -> int:
    k = model.states
    return k + k * k + (k * model.emission.shape[1] if model.emission is not None
                        else k + 2 * k * model.mean.shape[1]) + 1


def _filtered(models: Sequence[Hmm], x: np.ndarray, entering: np.ndarray | None) -> tuple:
    """Scaled emissions, transitions, forward vectors and the logarithm of their scales."""
    log_b = _log_b(models, x)
    peak = log_b.max(-1, keepdims=True)
    b = np.exp(log_b - peak)
    trans = np.maximum(np.stack([m.trans for m in models]), FLOOR)
    alpha, norm = np.empty_like(b), np.empty(b.shape[:3])
    prior = np.maximum(np.stack([m.start for m in models]), FLOOR)[:, None] if entering is None else entering @ trans
    for t in range(b.shape[2]):
        a = (prior if t == 0 else alpha[:, :, t - 1] @ trans) * b[:, :, t]
        norm[:, :, t] = a.sum(-1)
        alpha[:, :, t] = a / norm[:, :, t, None]
    return b, trans, alpha, norm, np.log(norm) + peak[..., 0]


def _expect(models: Sequence[Hmm], x: np.ndarray, weight: np.ndarray, entering: np.ndarray | None = None,
            leaving: np.ndarray | None = None) -> np.ndarray:
    """(models, statistics) of equally long sequences (or parts with known neighbours), for models of one shape."""
    b, trans, alpha, norm, logs = _filtered(models, x, entering)
    n, _, length, k = b.shape
    beta = np.empty_like(b)
    beta[:, :, -1] = 1.0 if leaving is None else leaving
    for t in range(length - 2, -1, -1):
        beta[:, :, t] = (b[:, :, t + 1] * beta[:, :, t + 1]) @ trans.transpose(0, 2, 1) / norm[:, :, t + 1, None]
    gamma = alpha * beta
    gamma /= gamma.sum(-1, keepdims=True)
    xi = np.zeros((n, k, k))
    for t in range(0 if entering is not None else 1, length):
        last = entering if t == 0 else alpha[:, :, t - 1]
        pair = last[..., :, None] * trans[:, None] * (b[:, :, t] * beta[:, :, t])[..., None, :]
        xi += (pair / pair.sum((2, 3), keepdims=True) * weight[:, None, None]).sum(1)
    wg = gamma * weight[:, None, None]
    start = wg[:, :, 0].sum(1) if entering is None else np.zeros((n, k))
    if models[0].emission is not None:
        symbols = x[..., 0].astype(int)
        rest = [np.stack([wg[:, symbols == s].sum(1) for s in range(models[0].emission.shape[1])], axis=2).reshape(n, -1)]
    else:
        flat, g = x.reshape(-1, x.shape[-1])[:, :models[0].mean.shape[1]], wg.reshape(n, -1, k).transpose(0, 2, 1)
        rest = [g.sum(2), (g @ flat).reshape(n, -1), (g @ (flat * flat)).reshape(n, -1)]
    return np.concatenate([start, xi.reshape(n, -1), *rest, (logs * weight[:, None]).sum((1, 2))[:, None]], axis=1)


def _maximise(model: Hmm, stats: np.ndarray) -> Hmm:
    k = model.states
    start, rest = stats[:k], stats[k:]
    xi, rest = rest[:k * k].reshape(k, k), rest[k * k:]
    unit = lambda m: (m + FLOOR) / (m + FLOOR).sum(-1, keepdims=True)
    if model.emission is not None:
        m = model.emission.shape[1]
        return Hmm(model.label, unit(start), unit(xi), emission=unit(rest[:k * m].reshape(k, m) + 1e-6))
    d = model.mean.shape[1]
    weight = np.maximum(rest[:k], FLOOR)[:, None]
    mean = rest[k:k + k * d].reshape(k, d) / weight
    var = np.maximum(rest[k + k * d:k + 2 * k * d].reshape(k, d) / weight - mean * mean, VARIANCE_FLOOR)
    return Hmm(model.label, unit(start), unit(xi), mean=mean, var=var)


def _stacked(pdf: pd.DataFrame, rows: np.ndarray, width: int) -> np.ndarray:
    """(rows, length, features) of equally long rows."""
    stance, t = pdf["stance"].to_numpy(), pdf["t"].to_numpy()
    cols = [np.stack(stance[rows]).astype(float)]
    if width > 1:
        cols.append(np.stack(t[rows]).astype(float))
    return np.stack(cols, axis=-1)


def _groups(pdf: pd.DataFrame) -> Iterator[tuple[list[str], np.ndarray]]:
    """Rows of one length that name the same models, a thousand at a time: (names, places)."""
    sizes = pdf["stance"].str.len().to_numpy()
    sets, named = pd.factorize(pdf["keys"].map("\x1f".join))
    order = np.lexsort((sizes, sets))
    cuts = np.flatnonzero((np.diff(sets[order]) != 0) | (np.diff(sizes[order]) != 0)) + 1
    for rows in np.split(order, cuts) if len(order) else []:
        for at in range(0, len(rows), 1000):
            yield named[sets[rows[0]]].split("\x1f"), rows[at:at + 1000]


def _by_shape(names: Sequence[str], models: dict[str, Hmm], wide: int) -> Iterator[list[str]]:
    """Names of known models, those of one form together, as many as stay small beside ``wide`` numbers each."""
    forms: dict[tuple, list[str]] = {}
    for name in names:
        if name in models:
            m = models[name]
            forms.setdefault((m.states, m.emission is None, 0 if m.mean is None else m.mean.shape[1]), []).append(name)
    most = max(1, 4_000_000 // max(1, wide))
    for same in forms.values():
        for at in range(0, len(same), most):
            yield same[at:at + most]


def _partition_stats(models: dict[str, Hmm], width: int):
    wide = max(map(_stats_size, models.values()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = {k: np.zeros(wide) for k in models}  # equally long for all shapes
        for pdf in batches:
            weights = pdf["weight"].to_numpy()
            for names, rows in _groups(pdf):
                x, weight = _stacked(pdf, rows, width), weights[rows]
                ends = [np.stack(pdf[c].to_numpy()[rows])[None] if c in pdf else None for c in ("entering", "leaving")]
                for some in _by_shape(names, models, x.size * 4):
                    for name, stats in zip(some, _expect([models[n] for n in some], x, weight, *ends)):
                        sums[name][:len(stats)] += stats
        yield pd.DataFrame({"key": list(sums), "stats": [v.tolist() for v in sums.values()]})
    return run


def _part_matrices(models: dict[str, Hmm], width: int):
    """Scaled matrix of every (part, model) and the logarithm of its scale; a first part holds the start distribution, in equal rows."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for first, half in ((True, pdf[pdf["part"] == 0]), (False, pdf[pdf["part"] != 0])):
                half = half.reset_index(drop=True)
                for names, rows in _groups(half):
                    x = _stacked(half, rows, width)
                    for some in _by_shape(names, models, x.size * 4):
                        chosen = [models[n] for n in some]
                        log_b = _log_b(chosen, x)
                        peak = log_b.max(-1, keepdims=True)
                        b = np.exp(log_b - peak)
                        trans = np.maximum(np.stack([m.trans for m in chosen]), FLOOR)[:, None]
                        k = b.shape[-1]
                        mat, log = np.broadcast_to(np.eye(k), (*b.shape[:2], k, k)), peak[..., 0].sum(2)
                        for t in range(b.shape[2]):
                            if first and t == 0:
                                start = np.maximum(np.stack([m.start for m in chosen]), FLOOR)[:, None] * b[:, :, 0]
                                mat = np.repeat(start[:, :, None], k, axis=2)
                            else:
                                mat = (mat @ trans) * b[:, :, t, None, :]
                            scale = mat.sum((2, 3), keepdims=True)
                            mat, log = mat / scale, log + np.log(scale[..., 0, 0])
                        ids = half.iloc[rows]
                        for name, own, scale in zip(some, mat.reshape(*mat.shape[:2], -1), log):
                            yield pd.DataFrame({"branch": ids["branch"].to_numpy(), "part": ids["part"].to_numpy(), "key": name, "mat": own.tolist(), "log": scale})
    return run


MATRICES = "branch string, part int, key string, mat array<double>, log double"


def _boundaries(matrices: DataFrame) -> DataFrame:
    """Forward vector that enters and backward vector that leaves each part, by prefix and suffix products: branch, part, key, entering, leaving."""
    done = products(matrices, ["branch", "key"], suffix=True)
    side = F.sqrt(F.size("pre")).cast("int")
    sums = F.transform(F.sequence(F.lit(0), side - 1), lambda i: F.aggregate(F.slice("suf", (i * side + 1).cast("int"), side), F.lit(0.0), lambda a, v: a + v))
    ends = durable(done.select("branch", "key", "part", "place", F.slice("pre", F.lit(1), side).alias("_row"), sums.alias("_col"), F.array_repeat(F.lit(1.0), side).alias("_ones")))
    unit = lambda c: F.transform(c, lambda x: x / F.aggregate(c, F.lit(0.0), lambda a, v: a + v))
    before = ends.select("branch", "key", (F.col("place") + 1).alias("place"), unit(F.col("_row")).alias("entering"))
    after = ends.select("branch", "key", (F.col("place") - 1).alias("place"), unit(F.col("_col")).alias("leaving"))
    on = ["branch", "key", "place"]
    return ends.join(before, on, "left").join(after, on, "left").select(
        "branch", "key", "part", "entering", F.coalesce("leaving", "_ones").alias("leaving"))


def _initial(keys: Sequence[str], moments: dict[str, tuple], shape: Shape, seed: int) -> dict[str, Hmm]:
    models, states = {}, shape.states
    for key in keys:
        label = int(key.rsplit("|", 1)[1])
        rng = np.random.default_rng(seed + zlib.crc32(key.encode()))
        start, trans = np.full(states, 1 / states), np.full((states, states), 1 / states)
        if shape.kind == "discrete":
            models[key] = Hmm(label, start, trans, emission=rng.dirichlet(np.ones(SYMBOLS) * 2, size=states))
        else:
            n, s, ss = (v[:shape.width] if isinstance(v, np.ndarray) else v for v in moments[key])
            mean = s / n
            var = np.maximum(ss / n - mean * mean, VARIANCE_FLOOR)
            spread = np.linspace(-1, 1, states)[:, None] if states > 1 else np.zeros((1, 1))
            models[key] = Hmm(label, start, trans, mean=mean + spread * np.sqrt(var),
                              var=np.tile(var + VARIANCE_FLOOR, (states, 1)))
    return models


def split_parts(rows: DataFrame, branch: Sequence[str]) -> tuple[DataFrame, DataFrame | None]:
    """Rows of branches in one part, and those of branches in several (``branch`` as one string; the first part left is 0)."""
    multi = rows.where("part > 0").select(*branch).distinct()
    if not multi.take(1):
        return rows, None
    long = rows.join(multi, list(branch), "left_semi")
    # parts emptied by filters leave gaps: the first one left starts the branch
    first = long.groupBy(*branch).agg(F.min("part").alias("_first"))
    long = long.join(first, list(branch)).withColumn("part", F.when(F.col("part") == F.col("_first"), 0).otherwise(F.col("part") + 1)).drop("_first")
    return rows.join(multi, list(branch), "left_anti"), long.withColumn("branch", F.concat_ws("\x1f", *branch))


def _rows(seqs: DataFrame, branch: Sequence[str], timed: bool) -> DataFrame:
    return durable(seqs.withColumn("stance", F.transform("obs", lambda o: o["stance"])).withColumn(
        "t", F.transform("obs", lambda o: o["t"]) if timed else F.lit(None).cast("array<double>"))
        .select(*branch, "part", "keys", "stance", "t"))


def fit_shapes(seqs: DataFrame, shapes: Sequence[Shape], n_iter: int = 10, tol: float = 1e-2, seed: int = 42,
               branch: Sequence[str] = ("source_id", "leaf_id"), history: list | None = None) -> dict[str, Hmm]:
    """Models of all shapes for all names in the rows' ``keys`` ("<group>|<label>"), as ``<shape>/<name>``, in the same passes.

    A pass is one visit to every row, which serves all models that the row trains; a model that gains less than ``tol`` is finished and takes
    no part in later passes. Without times equal rows are counted first, so a pass costs one visit per distinct sequence. What is known of a
    branch in several parts outside a part comes from prefix and suffix products, so no task holds a branch.
    """
    timed = any(s.width > 1 for s in shapes)
    if "part" not in seqs.columns:
        seqs = seqs.withColumn("part", F.lit(0))
    short, long = split_parts(_rows(seqs, branch, timed), branch)
    # with times hardly any sequences are equal, so counting would only shuffle them whole
    short = durable(short.groupBy("keys", "stance", "t").agg(F.count(F.lit(1)).cast("double").alias("weight")) if not timed
                    else short.select("keys", "stance", "t", F.lit(1.0).alias("weight")))
    all_rows = short
    if long is not None:
        long = durable(long.select("branch", "part", "keys", "stance", "t"))
        all_rows = all_rows.unionByName(long.select("keys", "stance", "t", F.lit(1.0).alias("weight")))
    sq = lambda c: F.aggregate(c, F.lit(0.0), lambda a, v: a + v * v)
    add = lambda c: F.aggregate(c, F.lit(0.0), lambda a, v: a + v)
    cols = ["stance"] + (["t"] if timed else [])
    # sums per set of names first: it is the rows that are many
    found = (all_rows.groupBy("keys")
             .agg(F.sum(F.col("weight") * F.size("stance")).alias("n"),
                  *[F.sum(F.col("weight") * add(F.col(c).cast("array<double>"))).alias("s_" + c) for c in cols],
                  *[F.sum(F.col("weight") * sq(F.col(c).cast("array<double>"))).alias("q_" + c) for c in cols])
             .select(F.explode("keys").alias("key"), "n", *[p + c for p in ("s_", "q_") for c in cols])
             .groupBy("key").agg(*[F.sum(c).alias(c) for c in ("n", *[p + c for p in ("s_", "q_") for c in cols])])
             .orderBy("key").collect())  # one row per name
    moments = {r["key"]: (r["n"], np.array([r["s_" + c] for c in cols]), np.array([r["q_" + c] for c in cols]))
               for r in found}
    models = {f"{s}/{k}": m for s in shapes for k, m in _initial(list(moments), moments, s, seed).items()}
    named_by = lambda s: F.transform("keys", lambda k: F.concat(F.lit(f"{s}/"), k))
    keys = F.flatten(F.array(*[named_by(s) for s in shapes]))
    width = 2 if timed else 1
    open_models, last = dict(models), {}
    for _ in range(n_iter):
        if not open_models:
            break
        run = _partition_stats(open_models, width)
        stats = short.withColumn("keys", keys).mapInPandas(run, "key string, stats array<double>")
        if long is not None:
            named = long.withColumn("keys", keys)
            ends = _boundaries(named.mapInPandas(_part_matrices(open_models, width), MATRICES))
            bounded = (named.select("branch", "part", F.explode("keys").alias("key"), "stance", "t").join(ends, ["branch", "part", "key"])
                       .select(F.array("key").alias("keys"), "part", "stance", "t", F.lit(1.0).alias("weight"), "entering", "leaving"))
            later = bounded.where("part > 0").drop("part")
            first = bounded.where("part = 0").drop("part", "entering")  # starts its branch: nothing enters
            for some in (first, later):
                stats = stats.unionByName(some.mapInPandas(run, "key string, stats array<double>"))
        # a row per model
        totals = {r["key"]: np.array(r["stats"]) for r in
                  stats.groupBy("key").agg(vector_sum(F.col("stats"), max(map(_stats_size, open_models.values()))).alias("stats")).collect()}
        totals = {k: v[:_stats_size(m)] for k, m in open_models.items() for v in [totals[k]]}
        ll = {k: float(v[-1]) for k, v in totals.items()}
        if history is not None:
            history.append({**last, **ll})
        models.update({k: _maximise(m, totals[k]) for k, m in open_models.items()})
        open_models = {k: models[k] for k in open_models if k not in last or ll[k] - last[k] >= tol}
        last.update(ll)
    return models


def fit(seqs: DataFrame, states: int = 2, kind: str = "gaussian", timestamps: bool = False,
        n_iter: int = 10, tol: float = 1e-2, seed: int = 42, branch: Sequence[str] = ("source_id", "leaf_id"),
        history: list | None = None) -> dict[str, Hmm]:
    """Fit all models named in the rows at once, of one shape: ``fit_shapes`` with plain names.

    ``seqs`` has obs and ``keys`` (array of "<group>|<label>" model names the row trains; default: its own class).
    """
    shape = Shape(kind, states, timestamps)
    if "keys" not in seqs.columns:
        seqs = seqs.withColumn("keys", F.array(F.concat(F.lit("all|"), F.col("veracity").cast("string"))))
    own: list = []
    models = fit_shapes(seqs, [shape], n_iter, tol, seed, branch, own)
    plain = lambda found: {k.split("/", 1)[1]: v for k, v in found.items()}
    if history is not None:
        history.extend(plain(h) for h in own)
    return plain(models)


def likelihoods(rows: DataFrame, models: dict[str, Hmm], branch: Sequence[str]) -> DataFrame:
    """``key`` and ``ll`` per branch and model that its rows name in ``keys``: one pass whatever the number of models.

    Rows have ``branch``, part, obs and keys (equal in all parts of a branch).
    """
    timed = any(m.mean is not None and m.mean.shape[1] > 1 for m in models.values())
    width = 2 if timed else 1
    short, long = split_parts(_rows(rows, branch, timed).withColumn("branch", F.concat_ws("\x1f", *branch)), branch)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for names, places in _groups(pdf):
                x = _stacked(pdf, places, width)
                for some in _by_shape(names, models, x.size * 4):
                    total = _filtered([models[n] for n in some], x, None)[-1].sum(2)
                    for name, ll in zip(some, total):
                        yield pd.DataFrame({"branch": pdf["branch"].to_numpy()[places], "key": name, "ll": ll})

    found = short.select("branch", "keys", "stance", "t").mapInPandas(run, "branch string, key string, ll double")
    if long is not None:
        done = products(long.select("branch", "part", "keys", "stance", "t").mapInPandas(_part_matrices(models, width), MATRICES), ["branch", "key"])
        side = F.sqrt(F.size("pre")).cast("int")
        end = F.aggregate(F.slice("pre", F.lit(1), side), F.lit(0.0), lambda a, v: a + v)
        found = found.unionByName(done.where(F.col("place") == F.col("n_parts") - 1).select("branch", "key", (F.ln(end) + F.col("pre_log")).alias("ll")))
    return found


def to_table(spark, models: dict[str, Hmm]) -> DataFrame:
    """Parameters as rows, to be stored as Parquet."""
    as_list = lambda a: None if a is None else a.tolist()
    return spark.createDataFrame(
        [(k, m.label, as_list(m.start), as_list(m.trans), as_list(m.emission), as_list(m.mean), as_list(m.var))
         for k, m in models.items()],
        "key string, label int, start array<double>, trans array<array<double>>, "
        "emission array<array<double>>, mean array<array<double>>, var array<array<double>>")


def from_table(table: DataFrame) -> dict[str, Hmm]:
    as_array = lambda v: None if v is None else np.array(v)
    return {r["key"]: Hmm(r["label"], *[as_array(r[c]) for c in ("start", "trans", "emission", "mean", "var")])
            for r in table.collect()}
