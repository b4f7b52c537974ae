"""Toxicity by a support vector machine over a subsequence string kernel, with Nyström landmarks.

The kernel of two words counts the runs of three characters they share in order, gaps allowed: a run spread over s
characters weighs ``DECAY`` ** s, and the kernel is normalised. So insults with a gap, an inserted character, a swapped digit or an unusual
ending stay close to what was learnt. Words get a mark for their start and end; accents are taken off; digits and signs that stand for letters
are read as those; letters written one by one (i d i o t) are read as one word as well.

Training (on the driver, from bounded samples): labelled texts are cut into sentences that inherit the label, of which only some words
deserve it. Words are counted by label with the pairs of neighbours they stand between (copies of a sentence count once). A first guess takes
words that stand in toxic texts more often than chance explains, given how many words there are: a rare word that happens to stand in toxic texts
only is no insult. ``TURNS`` turns follow: the machine is fitted on Nyström features (the kernel to ``LANDMARKS`` words, whitened), then words
seen only in toxic texts are relabelled by its verdict and the same chance. As the machine is linear in kernels to landmarks, it becomes one
weight per run of three characters, which scores any word without looking at landmarks again. A text is scored whole: a logistic
regression over the highest verdicts of its words, how many are positive, and its length. Both labels weigh the same in it, whatever their shares.

At most ``SAMPLE`` labelled texts of each label are used (a hash of the id decides), at most ``VOCABULARY`` words of them
(those of most neighbours first) and as many landmarks as named. Everything else covers all rows.

Defined cases: a null text is an empty one; an empty text gets the score of a text without words; without labelled rows of both
labels every score is the share of toxic labels (0 without any); null labels are not used; repeated rows score alike. Words of over ``PIECE``
characters are scored in overlapping pieces, to their end.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from branchwise.llm.words import columns_and, map_arrow, quoted

DECAY = 0.6
SPAN = 7
LANDMARKS = 300
TURNS = 3
RIDGE = 2e-3
SAMPLE = 4000
VOCABULARY = 30_000
PIECE = 24
REMEMBER = 300_000
CODES = 32
START, END, OTHER = 26, 27, 28  # 28 to 31: letters that are not Latin, and signs
#: Digits and signs that are written for letters.
LOOKALIKES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
SPACED = re.compile(r"(?<!\S)\S(?:[ \t]\S){2,}(?!\S)")
SENTENCE = re.compile(r"[.!?\n]+")


def codes(word: str) -> list[int]:
    """A word as character codes with its marks; signs at its ends are left out."""
    out = [START]
    for c in unicodedata.normalize("NFD", word.strip(".,;:!?\"'()[]|*%&#$")):
        c = LOOKALIKES.get(c, c)
        if "a" <= c <= "z":
            out.append(ord(c) - 97)
        elif not unicodedata.combining(c):
            out.append(OTHER + ord(c) % 4)
    out.append(END)
    return out


def words_of(text: str) -> list[str]:
    """Lower-cased words of a text, and those that are spelt letter by letter."""
    low = text.lower()
    return low.split() + [m.replace(" ", "").replace("\t", "") for m in SPACED.findall(low)]


def pieces_of(word: str) -> list[str]:
    """A word as overlapping pieces of ``PIECE`` characters at most."""
    return [word[at:at + PIECE] for at in range(0, max(1, len(word) - PIECE // 2), PIECE // 2)] if len(word) > PIECE else [word]


def runs(batch: list[list[int]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For words of one length each: (positions in the batch, index of each run of three, its weight)."""
    sizes = np.array([len(b) for b in batch])
    for n in np.unique(sizes):
        at = np.flatnonzero(sizes == n)
        if n < 3:
            yield at, np.zeros((len(at), 0), dtype=np.int64), np.zeros(0)
            continue
        matrix = np.array([batch[i] for i in at], dtype=np.int64)
        triples = np.array([(i, j, k) for i in range(n) for k in range(i + 2, min(n, i + SPAN)) for j in range(i + 1, k)])
        index = (matrix[:, triples[:, 0]] * CODES + matrix[:, triples[:, 1]]) * CODES + matrix[:, triples[:, 2]]
        yield at, index, DECAY ** (triples[:, 2] - triples[:, 0] + 1)


def norms(index: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Length of each word's vector of runs (equal runs add up)."""
    out = np.zeros(len(index))
    if index.shape[1]:
        order = np.argsort(index, axis=1, kind="stable")
        sorted_index, sorted_weight = np.take_along_axis(index, order, axis=1), weight[order]
        first = np.ones(index.shape, dtype=bool)
        first[:, 1:] = sorted_index[:, 1:] != sorted_index[:, :-1]
        sums = np.add.reduceat(sorted_weight.ravel(), np.flatnonzero(first.ravel()))
        np.add.at(out, np.repeat(np.arange(len(index)), first.sum(axis=1)), sums**2)
    return np.sqrt(np.maximum(out, 1e-12))


def kernel(words: list[str], dense: np.ndarray) -> np.ndarray:
    """Normalised kernel of words (or pieces) with landmarks, given the landmarks' normalised vectors of runs as columns."""
    out = np.zeros((len(words), dense.shape[1]), dtype=np.float32)
    for first in range(0, len(words), 4096):
        for at, index, weight in runs([codes(w) for w in words[first:first + 4096]]):
            light = weight.astype(np.float32)
            for s in range(0, len(at), 32):  # a few words at a time: each takes runs * landmarks numbers
                part = index[s:s + 32]
                out[first + at[s:s + 32]] = np.einsum("ijk,j->ik", dense[part], light) / norms(part, weight)[:, None]
    return out


def dense_of(words: list[str]) -> np.ndarray:
    out = np.zeros((CODES**3, len(words)), dtype=np.float32)
    for at, index, weight in runs([codes(w) for w in words]):
        scale = norms(index, weight)
        for row, i in enumerate(at):
            np.add.at(out[:, i], index[row], weight / scale[row])
    return out


def machine(features: np.ndarray, y: np.ndarray, cost: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights (the last one the offset) of a linear machine with squared hinge loss, by finite Newton steps."""
    size = features.shape[1] + 1
    w, penalty = np.zeros(size), ridge * np.eye(size)
    penalty[-1, -1] = 1e-3
    support = None
    for _ in range(25):
        inside = y * decide(features, w) < 1
        if support is not None and np.array_equal(inside, support):
            break
        support = inside
        left, right = penalty.copy(), np.zeros(size)
        rows = np.flatnonzero(inside)
        for s in range(0, len(rows), 2048):  # the system is added up, features are never copied whole
            part = rows[s:s + 2048]
            x = np.hstack([features[part].astype(float), np.ones((len(part), 1))])
            weighed = x.T * cost[part]
            left += weighed @ x
            right += weighed @ y[part]
        w = np.linalg.solve(left, right)
    return w


def decide(features: np.ndarray, w: np.ndarray) -> np.ndarray:
    return features @ w[:-1].astype(features.dtype) + w[-1]


@dataclass
class Model:
    """``runs``: weight of every run of three characters; ``pool``: weights, means and scales of the text regression."""

    runs: np.ndarray
    offset: float
    pool: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def verdicts(self, words: list[str]) -> np.ndarray:
        pieces, owner = [], []
        for i, w in enumerate(words):
            for piece in pieces_of(w):
                pieces.append(codes(piece))
                owner.append(i)
        found = np.full(len(pieces), self.offset)
        for at, index, weight in runs(pieces):
            found[at] += (self.runs[index] * weight).sum(axis=1) / norms(index, weight)
        out = np.full(len(words), -np.inf)
        np.maximum.at(out, np.array(owner, dtype=int), found)
        return out

    def probability(self, pooled: np.ndarray) -> np.ndarray:
        z = ((pooled - self.mean) / self.scale) @ self.pool[:-1] + self.pool[-1]
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def pooled(values: np.ndarray) -> list[float]:
    """What the regression sees of a text: its three highest verdicts, positives (count and share), and length."""
    top = np.full(3, -2.0)
    if len(values):
        best = np.sort(np.partition(values, -min(3, len(values)))[-3:])[::-1]
        top[:len(best)] = np.clip(best, -2, 3)
    high, some = int((values > 0.5).sum()), int((values > 0).sum())
    n = max(len(values), 1)
    return [*top, np.log1p(high), np.log1p(some), np.log((high + 0.1) / n), np.log(n)]


POOLED = 7


class Scorer:
    """Verdicts of words, remembered within a task up to ``REMEMBER`` words."""

    def __init__(self, model: Model):
        self.model, self.known = model, {}

    def texts(self, texts: list[str]) -> np.ndarray:
        parts = [words_of(t) for t in texts]
        new = set(chain.from_iterable(parts)).difference(self.known)
        if len(self.known) + len(new) > REMEMBER:
            self.known = {}
            new = set(chain.from_iterable(parts))
        order = list(new)
        for at in range(0, len(order), 20_000):
            some = order[at:at + 20_000]
            self.known.update(zip(some, self.model.verdicts(some).tolist()))
        get = self.known.__getitem__
        return np.array([pooled(np.fromiter(map(get, p), float, len(p))) for p in parts]).reshape(-1, POOLED)


def held_out(doc_id: Column) -> Column:
    """Rows that are never learnt from: CRC-32 of the id as text divisible by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _sample(labels: DataFrame, label: str, most: int) -> DataFrame:
    """Labelled ids to learn from, about ``most`` of each label by a hash of the id."""
    usable = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select(
        "doc_id", F.col(label).cast("int").alias("_label")).distinct()
    sizes = {r[0]: r[1] for r in usable.groupBy("_label").count().collect()}
    part = {k: min(1.0, most / n) for k, n in sizes.items()}
    share = F.when(F.col("_label") == 1, part.get(1, 1.0)).otherwise(part.get(0, 1.0))
    return usable.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1_000_000)) < share * 1_000_000)


def _word_counts(texts: DataFrame) -> DataFrame:
    """word, toxic, clean: pairs of neighbours that the word stands between in sentences of either label."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: set[tuple] = set()
            for label, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                for sentence in SENTENCE.split((value.as_py() or "").lower()):
                    words = ["", *words_of(sentence), ""]
                    seen.update((w, zlib.crc32(f"{a} {b}".encode()), label) for a, w, b in zip(words, words[1:], words[2:]))
            rows = list(zip(*seen)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.string()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.int32())], ["word", "ctx", "label"])

    pairs = texts.select("_label", "text").mapInArrow(run, "word string, ctx long, label int").distinct()
    return pairs.groupBy("word").agg(F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("clean"))


def _beyond_chance(toxic: np.ndarray, clean: np.ndarray) -> np.ndarray:
    """Per word, minus the logarithm of how many of these words chance would place in toxic sentences as often (Chernoff's bound)."""
    n = np.maximum(toxic + clean, 1)
    share, usual = toxic / n, np.clip(toxic.sum() / n.sum(), 1e-9, 1 - 1e-9)
    bits = share * np.log(np.maximum(share, 1e-12) / usual) + (1 - share) * np.log(np.maximum(1 - share, 1e-12) / (1 - usual))
    return np.where(share > usual, n * bits, 0.0) - np.log(len(toxic))


def _learn_words(words: list[str], toxic: np.ndarray, clean: np.ndarray) -> tuple[np.ndarray, float]:
    """Weight per run of three and offset, from words and their counts by label.

    Words are learnt in the pieces that they are judged by: a clean word has clean pieces only, a toxic one at least one that is toxic,
    taken to be the one with the highest verdict so far, and any of them before the first verdicts.
    """
    only = clean == 0
    total = max(toxic.sum(), 1), max(clean.sum(), 1)
    ratio = np.log((toxic + 0.1) / total[0]) - np.log((clean + 0.1) / total[1])
    often, beyond = (toxic >= 3) & (ratio > 3) & (toxic >= 20 * clean), _beyond_chance(toxic, clean)
    positive = often & (beyond > 0)
    if not positive.any():  # too few rows to tell from chance
        positive = often
    if not positive.any():
        positive = ratio >= np.quantile(ratio, 0.999)
    first = np.argsort(-(toxic * positive), kind="stable")[:LANDMARKS // 2]
    others = np.flatnonzero(~positive)
    rest = others[np.argsort([zlib.crc32(words[i].encode()) for i in others], kind="stable")[:LANDMARKS - len(first)]]
    cut = [pieces_of(w) for w in words]
    half = list(dict.fromkeys(chain.from_iterable(cut[i] for i in first)))[:LANDMARKS // 2]
    landmarks = list(dict.fromkeys([*half, *chain.from_iterable(cut[i] for i in rest)]))[:LANDMARKS]
    pieces, owner = list(chain.from_iterable(cut)), np.repeat(np.arange(len(words)), [len(c) for c in cut])
    dense = dense_of(landmarks)
    gram = kernel(landmarks, dense).astype(float)
    values, vectors = np.linalg.eigh((gram + gram.T) / 2 + 1e-6 * np.eye(len(landmarks)))
    whiten = vectors / np.sqrt(np.maximum(values, 1e-4))
    features = kernel(pieces, dense) @ whiten.astype(np.float32)
    weight, best = np.zeros(len(landmarks) + 1), np.ones(len(pieces), dtype=bool)
    for _ in range(TURNS):
        used = positive | (clean > 0)
        cost = np.where(positive, np.minimum(toxic, 50) / max(np.minimum(toxic, 50)[positive].sum(), 1),
                        np.minimum(clean, 50) / max(np.minimum(clean, 50)[~positive & used].sum(), 1)) * used.sum()
        weight = machine(features, np.where(positive, 1.0, -1.0)[owner], np.where(positive[owner] & ~best, 0.0, cost[owner]))
        decided = decide(features, weight)
        verdict = np.full(len(words), -np.inf)
        np.maximum.at(verdict, owner, decided)
        former, best = best, decided == verdict[owner]
        wrong = ((verdict[clean > 0] > 0.3).sum() + 1) / ((clean > 0).sum() + 1)  # part of harmless words with such a verdict
        new = only & (toxic >= 2) & (verdict > 0.3) & (beyond > np.log(wrong)) | positive & (verdict > -0.3)
        if not new.any() or np.array_equal(new, positive) and np.array_equal(best[new[owner]], former[new[owner]]):
            break
        positive = new
    return dense @ (whiten @ weight[:-1]), float(weight[-1])


def _logistic(x: np.ndarray, y: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ridge grows with the rows: where verdicts part the labels without fault, the boundary stays in the middle of the gap."""
    ridge = np.append(np.full(x.shape[1], max(1e-2, RIDGE * len(x))), 1e-2)
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -40, 40)))
        step = np.linalg.solve(z.T @ (z * (count * p * (1 - p) + 1e-9)[:, None]) + np.diag(ridge), z.T @ (count * (y - p)) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w, mean, scale


def _pooled_rows(texts: DataFrame, model: Model, label: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = Scorer(model)
        for batch in batches:
            found = tool.texts([v.as_py() or "" for v in batch.column(1)])
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(found[:, i]) for i in range(POOLED)]], [label, *[f"f{i}" for i in range(POOLED)]])

    return texts.select(label, "text").mapInArrow(run, f"{label} int, " + ", ".join(f"f{i} double" for i in range(POOLED)))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE, vocabulary: int = VOCABULARY) -> Model:
    """Learn from a sample of the labelled rows that are not held out. ``docs``: doc_id, text; ``labels``: doc_id and the label."""
    ids = _sample(labels, label, sample)
    texts = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("_label", "text")  # at most about 2 * sample ids
    counted = _word_counts(texts).where("word <> '' and toxic + clean >= 2").orderBy(F.desc(F.greatest(F.col("toxic") * 10, F.col("clean"))), "word").limit(vocabulary).toPandas()
    words, toxic, clean = counted["word"].tolist(), counted["toxic"].to_numpy(float), counted["clean"].to_numpy(float)
    blank = Model(np.zeros(CODES**3), 0.0, np.zeros(POOLED + 1), np.zeros(POOLED), np.ones(POOLED))
    sizes = {r[0]: r[1] for r in ids.groupBy("_label").count().collect()}
    if not words or len(sizes) < 2:
        share = sizes.get(1, 0) / max(1, sum(sizes.values()))
        blank.pool[-1] = np.log(max(share, 1e-9) / max(1 - share, 1e-9))
        return blank
    blank.runs, blank.offset = _learn_words(words, toxic, clean)
    rows = _pooled_rows(texts, blank, "_label").toPandas().to_numpy(float)
    toxic_rows = rows[:, 0] == 1
    blank.pool, blank.mean, blank.scale = _logistic(rows[:, 1:], rows[:, 0], len(rows) / 2 / np.where(toxic_rows, max(toxic_rows.sum(), 1), max((~toxic_rows).sum(), 1)))
    return blank


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted``. The text alone decides."""
    keep = [c for c in docs.columns if c not in ("score", "predicted")]
    at = keep.index(text)
    schema = columns_and(docs, keep, "score double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = Scorer(model)
        for batch in batches:
            values: list[float] = []
            texts = [v.as_py() or "" for v in batch.column(at)]
            for s in range(0, len(texts), 256):
                values.extend(model.probability(tool.texts(texts[s:s + 256])).tolist())
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(keep))], pa.array(values, pa.float64())], [*keep, "score"])

    return map_arrow(docs.select(*[quoted(c) for c in keep]), run, schema).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
