"""Quality rules whose cutoffs are certified on labelled documents.

Every rule is a measure of a text that is high on junk. For each stratum (band of text length) and rule, a fixed grid of cutoffs
is tested from the mildest down: a cutoff is safe when the exact binomial (Clopper-Pearson) upper bound on the share of
good documents above it is at most the rule's part of ``risk``. Testing stops at the first unsafe cutoff, so the grid needs no
correction (fixed-sequence testing); strata and rules share ``delta`` between them (Bonferroni). So with probability 1 - ``delta`` every
stratum loses at most ``risk`` of its good documents, all rules together. Of the safe cutoffs the one is used that rejects most
labelled junk, where a good document lost weighs ``COST`` times; without a gain the rule rejects nothing there.

Labels are counted per stratum, rule and cutoff in one aggregate over all labelled documents, so the counts that reach the
driver have a fixed size (strata * rules * grid * 2 rows at most) whatever the input.

Defined cases: a null text has no words and fails the base rules; an empty label table certifies nothing, so only the base rules
reject; a document labelled twice counts twice, a null label not at all; measures of an empty text are 0.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from branchwise.llm.words import GAPS, columns_and, map_arrow, quoted, word_bytes

SYMBOLS = "#*$%&|<>"
BANDS = (200, 1000)  # upper ends in words; the last band is open
GRID = 40
COST = 10
#: rule: two counted columns whose ratio is the measure, and the step of its grid of cutoffs
RULES = {
    "symbols_per_word": ("n_symbols", "n_words", 0.05),
    "marks_per_word": ("n_marks", "n_words", 0.05),
    "capitals_share": ("n_capitals", "word_chars", 0.025),
    "repeated_lines_per_word": ("n_dup_lines", "n_words", 0.0025),
}
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_marks", "n_capitals"]


def repeated(words: list[bytes], width: int = 5) -> int:
    """Words covered by windows of ``width`` words that occur twice or more, the first included."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    windows = list(zip(*(words[i:] for i in range(width))))
    first: dict[tuple, int] = {}
    hit = np.zeros(n, dtype=bool)
    if len(set(windows)) == n:
        return 0
    for i, w in enumerate(windows):
        j = first.setdefault(w, i)
        if j != i:
            hit[i] = hit[j] = True
    starts = np.flatnonzero(hit)
    gaps = np.minimum(np.diff(starts, append=starts[-1] + width), width)
    return int(gaps.sum())


def counts(text: str | None) -> tuple[int, ...]:
    """The values of ``COUNTS`` for one text."""
    if not text:
        return (0,) * len(COUNTS)
    words = word_bytes(text)
    seen: set[str] = set()
    twice = 0
    for line in text.split("\n"):
        if line.strip(GAPS):
            twice += line in seen
            seen.add(line)
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    return (len(words), len(text) - sum(map(text.count, GAPS)), sum(map(text.count, SYMBOLS)), twice, repeated(words),
            text.count("!"), int(np.count_nonzero((raw >= 65) & (raw <= 90))))


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """The other columns of ``docs`` and ``COUNTS``, each text read once and whole."""
    keep = [c for c in docs.columns if c != text and c not in COUNTS]
    schema = columns_and(docs, keep, ", ".join(f"{c} long" for c in COUNTS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([counts(v.as_py()) for v in batch.column(len(keep))], dtype=np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(keep))], *[pa.array(found[:, i]) for i in range(len(COUNTS))]],
                                             [*keep, *COUNTS])

    return map_arrow(docs.select(*[quoted(c) for c in [*keep, text]]), run, schema)


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def band() -> Column:
    out = F.lit(len(BANDS))
    for i, top in reversed(list(enumerate(BANDS))):
        out = F.when(F.col("n_words") < top, i).otherwise(out)
    return out


def level(rule: str) -> Column:
    """How many cutoffs of the rule's grid the measure exceeds: cutoff c (c steps) rejects levels above c."""
    above, below, step = RULES[rule]
    steps = F.ceil(F.coalesce(F.try_divide(F.col(above), F.col(below)), F.lit(0.0)) / step)
    return F.least(steps, F.lit(GRID)).cast("int")


def upper_bound_holds(rejected: int, n: int, risk: float, delta: float) -> bool:
    """Whether the exact upper bound on the rate, at confidence 1 - delta, is at most ``risk``: P(Bin(n, risk) <= rejected) <= delta."""
    if n == 0 or rejected >= n * risk:
        return False
    log_p, log_q = math.log(risk), math.log1p(-risk)
    term = math.lgamma(n + 1) - math.lgamma(rejected + 1) - math.lgamma(n - rejected + 1) + rejected * log_p + (n - rejected) * log_q
    total, share, k = 1.0, 1.0, rejected  # terms below the last one, as shares of it: they fall, as rejected < n * risk
    while k > 0 and share > 1e-17:
        share *= k / (n - k + 1) * math.exp(log_q - log_p)
        total, k = total + share, k - 1
    return term + math.log(total) <= math.log(delta)


def certify(labelled: DataFrame, label: str = "quality", risk: float = 0.05, delta: float = 0.05) -> dict[tuple[int, str], int]:
    """Cutoff (in grid steps) per (band, rule). ``labelled``: columns of ``measure`` and the label (1: good, 0: junk)."""
    judged = labelled.where(F.col(label).isin(0, 1) & ~base_failed()).select(F.col(label).cast("int").alias("_good"), band().alias("_band"), *[level(r).alias(r) for r in RULES])
    stacked = judged.select("_good", "_band", F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("level")) for r in RULES])).alias("_x"))
    seen: dict[tuple[int, str], np.ndarray] = {}
    for row in stacked.groupBy("_good", "_band", "_x.rule", "_x.level").count().collect():
        seen.setdefault((row["_band"], row["rule"]), np.zeros((2, GRID + 1)))[row["_good"], row["level"]] += row["count"]
    found = {}
    for key, by_level in sorted(seen.items()):
        n = by_level.sum(axis=1)
        above = n[:, None] - np.cumsum(by_level, axis=1)
        best = 0.0
        for c in range(GRID - 1, -1, -1):
            if not upper_bound_holds(int(above[1, c]), int(n[1]), risk / len(RULES), delta / len(RULES) / (len(BANDS) + 1)):
                break
            gain = above[0, c] / max(n[0], 1) - COST * above[1, c] / max(n[1], 1)
            if gain > best:
                best, found[key] = gain, c
    return found


def judge(measured: DataFrame, cutoffs: dict[tuple[int, str], int]) -> DataFrame:
    """Adds ``base_failed``, ``rejected_by`` (rules, in order) and ``kept``."""
    verdicts = []
    for r in RULES:
        of_rule = {b: c for (b, rule), c in cutoffs.items() if rule == r}
        limits = F.create_map(*[F.lit(x) for item in of_rule.items() for x in item]) if of_rule else None
        verdicts.append(F.lit(None) if limits is None else F.when(level(r) > limits[band()], F.lit(r)))
    by = F.array_compact(F.array(*[v.cast("string") for v in verdicts]))
    return (measured.withColumn("base_failed", base_failed()).withColumn("rejected_by", by)
            .withColumn("kept", ~F.col("base_failed") & (F.size("rejected_by") == 0)))
