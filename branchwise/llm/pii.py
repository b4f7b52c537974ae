"""Personal data by bootstrapped contextual extraction.

Four kinds have a plain form: e-mail addresses, IP addresses, card numbers and phone numbers (``base_spans``). Those are seeds. Identifiers
without such a form are found by the words around them:

1. Every document gives its seeds and its candidates: numbers, and tokens around an at sign, that overlap no seed. Each of them is a
   mention of an instance (its lower-cased string, as a hash) and matches patterns: the word before, the two words before, the word behind, or both
   sides, each with the shape of the mention (runs of digits by length, letters as one), and the word before with its class only.
2. Patterns and instances form a bipartite graph. In each round a pattern scores the confidence of its instances in a kind, summed, over their
   number plus one; it counts if ``SUPPORT`` confident instances back it and it scores ``ACCEPT`` or more. An instance that is no seed gets the
   confidence 1 - product (1 - score) of its counting patterns, and backs patterns itself from the next round on. Numbers that
   nothing backs lower the score of the patterns they match.
3. It ends when a round finds nothing new, after ``ROUNDS`` at most. Candidates that match a counting pattern are added, with the
   kind of the best one (ties: the kind listed first).

Edges are distinct (pattern, instance) pairs; every step is a join on one side and a sum that combines before the shuffle, so a pattern or instance in a third of all
documents is a partial sum in each task. Documents are read once; texts never leave the first step.

Defined cases: a null text is empty; empty and blank texts have no spans; offsets are code points, ends exclusive; equal
mentions in repeated rows are one instance; a text of any length is read whole (in time linear in its length); other columns are ignored.
An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from branchwise.llm.words import stored
from branchwise.session import durable

KINDS = ("email", "ip", "card", "phone")
ROUNDS = 4
SUPPORT = 3
ACCEPT = 0.8
#: Characters on either side in which words of context are looked for.
AROUND = 48

LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
HOST = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# a match starts where a run of digits does, so no start inside a run is tried and long runs stay cheap
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
NUMBER = re.compile(r"(?<![\w.])(?:\+?\(?)[0-9](?:[0-9().+/ -]*[0-9])?(?!\w)")
AT = re.compile(r"(?<![^\x20\x09-\x0D@])[^\x20\x09-\x0D@]++@[^\x20\x09-\x0D@]++")
EDGES = ".,;:!?()[]{}<>\"'"
RUNS = re.compile(r"[0-9]+")
SPAN = "array<struct<kind:int,start:long,end:long>>"


def passes_luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost, not overlapping: for each at sign the run of local characters before it, as far as it is free, and the host behind."""
    free, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > free and LOCAL.match(text[begin - 1]):
            begin -= 1
        host = HOST.match(text, at) if begin < at else None
        if host:
            yield begin, host.end()
        free = host.end() if host else at + 1
        at = text.find("@", free)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the plain forms, by kind, then start."""
    out = [(0, a, b) for a, b in _emails(text)] if "@" in text else []
    out += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and passes_luhn(digits):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def candidates(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Spans that may be identifiers, apart from each other and from those taken."""
    found = []
    if "@" in text:
        for m in AT.finditer(text):
            inner = m[0].strip(EDGES)
            begin = m.start() + m[0].index(inner)
            found.append((begin, begin + len(inner)))
    found += [m.span() for m in NUMBER.finditer(text)]
    busy, out = sorted([(a, b) for _, a, b in taken]), []
    # one sweep over both: addresses come before numbers where they overlap
    at, last = 0, -1
    for a, b in sorted(found, key=lambda s: (s[0], -s[1])):
        while at < len(busy) and busy[at][1] <= a:
            at += 1
        if a >= last and b > a and not any(x < b and a < y for x, y in busy[at:at + 4]):
            out.append((a, b))
            last = b
    return out


def shape(mention: str) -> str:
    """Digits by the length of their runs; in addresses letters and digits as one each. Long shapes go by their hash."""
    if "@" in mention:
        form = re.sub(r"[0-9]+", "9", re.sub(r"[^\W\d_]+", "a", mention))
    else:
        form = RUNS.sub(lambda m: f"d{len(m[0])}", mention)
    return form if len(form) <= AROUND else xxhash.xxh64_hexdigest(form.encode())


def patterns(text: str, begin: int, end: int) -> list[str]:
    """What a mention matches: words beside it, with its shape or class."""
    mention = text[begin:end]
    form, kind = shape(mention), "@" if "@" in mention else "#"
    word = lambda w: RUNS.sub("0", w.strip(EDGES).lower())
    left = [w for w in map(word, text[max(0, begin - AROUND):begin].split()[-2:]) if w]
    right = [w for w in map(word, text[end:end + AROUND].split()[:1]) if w]
    out = []
    if left:
        out += [f"before|{left[-1]}|{form}", f"near|{left[-1]}|{kind}"]
    if len(left) == 2:
        out.append(f"two before|{left[0]} {left[1]}|{form}")
    if right:
        out.append(f"behind|{right[0]}|{form}")
    if left and right:
        out.append(f"around|{left[-1]}|{form}|{right[0]}")
    return out


def mark(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: ``_id``, doc_id, ``base`` spans and ``mentions`` (kind, -1 for a candidate; start, end, instance, patterns)."""
    span = pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())])
    mention = pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("instance", pa.int64()), ("patterns", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            bases, mentions = [], []
            for value in batch.column(1):
                t = value.as_py()
                base = base_spans(t) if t and ("@" in t or RUNS.search(t)) else []
                spots = [*base, *((-1, a, b) for a, b in candidates(t, base))] if t and ("@" in t or RUNS.search(t)) else []
                bases.append([{"kind": k, "start": a, "end": b} for k, a, b in base])
                mentions.append([{"kind": k, "start": a, "end": b, "instance": xxhash.xxh64_intdigest(t[a:b].lower().encode()) - 2**63,
                                  "patterns": patterns(t, a, b)} for k, a, b in spots])
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(number, number + batch.num_rows), pa.int64()), batch.column(0), pa.array(bases, pa.list_(span)), pa.array(mentions, pa.list_(mention))],
                ["_id", "doc_id", "base", "mentions"])
            number += batch.num_rows

    kinds = f"_id long, doc_id long, base {SPAN}, mentions array<struct<kind:int,start:long,end:long,instance:long,patterns:array<string>>>"
    return docs.select(docs[doc_id].cast("long"), docs[text].cast("string")).mapInArrow(run, kinds)


def learn(marked: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT, accept: float = ACCEPT) -> DataFrame:
    """Counting patterns: ``pattern``, ``kind``, ``score``."""
    each = marked.select(F.explode("mentions").alias("m")).select("m.instance", "m.kind", F.explode("m.patterns").alias("pattern"))
    edges = durable(each.groupBy("pattern", "instance").agg(F.min(F.when(F.col("kind") >= 0, F.col("kind"))).alias("kind")))
    labels = edges.where("kind is not null").groupBy("instance").agg(F.min("kind").alias("kind"))
    seeds = durable(labels.withColumn("confidence", F.lit(1.0)))
    sizes = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("_n"))
    open_edges = durable(edges.select("pattern", "instance").join(seeds.select("instance"), "instance", "left_anti"))
    known, found = seeds, -1
    for _ in range(rounds):
        backed = (edges.select("pattern", "instance").join(known, "instance").groupBy("pattern", "kind")
                  .agg(F.sum("confidence").alias("_sum"), F.count_if(F.col("confidence") >= accept).alias("_sure")).where(F.col("_sure") >= support))
        # rounded: sums of floats in another order must not move a pattern over the threshold
        scored = backed.join(sizes, "pattern").select("pattern", "kind", F.round(F.col("_sum") / (F.col("_n") + 1), 9).alias("score"))
        counting = durable(scored.where(F.col("score") >= accept))
        joined = open_edges.join(counting, "pattern").groupBy("instance", "kind").agg(
            F.round(1 - F.exp(F.sum(F.log(1 - F.col("score")))), 9).alias("confidence"))
        best = F.max(F.struct("confidence", (-F.col("kind")).alias("_k")))
        fresh = durable(joined.groupBy("instance").agg(best.alias("_b")).select("instance", (-F.col("_b._k")).alias("kind"), F.col("_b.confidence").alias("confidence")))
        n = fresh.count()
        if n == found:
            break
        known, found = seeds.unionByName(fresh), n
    return counting


def extract(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Per document: doc_id, ``base`` spans, and ``spans``, those and the added ones, each sorted by kind, then start."""
    marked, _ = stored(mark(docs, doc_id, text))
    counting = learn(marked, **options)
    open_mentions = marked.select("_id", F.explode(F.filter("mentions", lambda m: m["kind"] < 0)).alias("m"))
    each = open_mentions.select("_id", "m.start", "m.end", F.explode("m.patterns").alias("pattern"))
    best = F.max(F.struct("score", (-F.col("kind")).alias("_k")))
    added = each.join(counting, "pattern").groupBy("_id", "start", "end").agg(best.alias("_b"))
    spans = F.struct((-F.col("_b._k")).alias("kind"), "start", "end")
    per_doc = durable(added.groupBy("_id").agg(F.collect_list(spans).alias("_added")))
    joined = marked.select("_id", "doc_id", "base").join(per_doc, "_id", "left")
    whole = F.when(F.col("_added").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "_added")))
    return joined.select("doc_id", "base", whole.alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end of every span, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def counted(base: Column, kind: int) -> Column:
    return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long")
