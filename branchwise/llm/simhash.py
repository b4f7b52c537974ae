"""Near-duplicate groups by SimHash, with pivot distance tables.

A text's fingerprint has a bit for each of 64 positions, set where over half of its shingles' hashes have it. Texts of equal
fingerprint are one node; nodes whose fingerprints differ in ``RADIUS`` bits at most are linked, and a group is what
links connect.

Candidates meet by the pigeonhole rule: of ``RADIUS + 1`` parts of the bits, two linked fingerprints agree in one at least. Buckets with over
``BUCKET`` distinct fingerprints are divided by the same rule on the bits that are left, again and again: each level multiplies rows by
``RADIUS + 1`` and takes a quarter of the bits left, and when few are left a bucket can't be larger than the number of
their values. So no bucket is ever cut or skipped, and none is large. In a bucket, the distances of every fingerprint to ``PIVOTS``
reference fingerprints are tabulated. By the triangle inequality a pair whose distances to any pivot differ by more than ``RADIUS``
can't be linked: fingerprints are sorted by the first distance, only those within the radius of it are compared, pairs are dropped by their maximum
coordinate difference, and survivors are verified by counting differing bits. A bucket gives the links of a spanning forest
of its verified pairs, never all pairs.

Defined cases: a null text has no words; a text without words has fingerprint zero and links like any other; with fewer
words than a shingle needs, the whole sequence is the one shingle. Groups are named by the smallest doc_id in them; rows without a
doc_id take part, and a group with none at all has a null name. Repeated rows are copies of each other.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from branchwise.llm.components import components
from branchwise.llm.words import boxed, columns_and, map_arrow, quoted, unboxed
from branchwise.session import durable

RADIUS = 3
SHINGLE = 3
BUCKET = 4096
PIVOTS = 16
#: Reference fingerprints: fixed pseudo-random 64-bit words.
REFERENCES = np.random.default_rng(20).integers(0, 2**64, PIVOTS, dtype=np.uint64, endpoint=False)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint of a whole text, as an unsigned number."""
    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    join, digest = b" ".join, xxhash.xxh64_intdigest
    if len(words) < shingle:
        return digest(join(words), 42)
    hashes = np.fromiter((digest(join(w), 42) for w in zip(*(words[i:] for i in range(shingle)))), np.uint64, len(words) - shingle + 1)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[at:at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes())


def fingerprints(docs: DataFrame, text: str = "text", name: str = "_fp", shingle: int = SHINGLE) -> DataFrame:
    """The other columns of ``docs`` and the fingerprint as a signed long."""
    keep = [c for c in docs.columns if c not in (text, name)]
    schema = columns_and(docs, keep, quoted(name) + " long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(v.as_py(), shingle) for v in batch.column(len(keep))], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(keep))], pa.array(found)], [*keep, name])

    return map_arrow(docs.select(*[quoted(c) for c in [*keep, text]]), run, schema)


def forest(keys: np.ndarray, codes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) of codes that connect, in every bucket (equal keys), what is linked within ``radius``.

    All buckets are worked on together: sorted by key and first distance, each code meets the next one, the one after that, and so
    on while key and distance allow. Of the verified pairs only those that join two trees are given out.
    """
    table = np.bitwise_count(codes[:, None] ^ REFERENCES[None, :]).astype(np.int8)
    order = np.lexsort((table[:, 0], keys))
    keys, codes, table = keys[order], codes[order], table[order]
    parent = np.arange(len(codes))
    left, right = [], []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    alive, step = np.arange(len(codes)), 0
    while len(alive):
        step += 1
        alive = alive[alive + step < len(codes)]
        other = alive + step
        alive = alive[(keys[other] == keys[alive]) & (table[other, 0] - table[alive, 0] <= radius)]
        near = alive[np.abs(table[alive + step] - table[alive]).max(axis=1, initial=0) <= radius]
        near = near[np.bitwise_count(codes[near + step] ^ codes[near]) <= radius]
        near = near[parent[near] != parent[near + step]]
        for i in near.tolist():
            a, b = root(i), root(i + step)
            if a != b:
                parent[max(a, b)] = min(a, b)
                left.append(i)
                right.append(i + step)
        if len(near):
            while not np.array_equal(parent, up := parent[parent]):
                parent = up
    return codes[np.array(left, dtype=int)], codes[np.array(right, dtype=int)]


def _divide(rows: DataFrame, radius: int) -> DataFrame:
    """Each row once per part of the bits left: the part's value joins the key, the other bits stay.

    ``_n`` bits are left in ``_rest``; the ``radius + 1`` parts differ in size by one bit at most.
    """
    parts = radius + 1
    each = rows.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    low = F.floor(F.col("_part") * F.col("_n") / parts).cast("int")
    size = (F.floor((F.col("_part") + 1) * F.col("_n") / parts) - low).cast("int")
    mask = lambda bits: F.when(bits >= 64, F.lit(-1).cast("long")).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1)
    value = F.call_function("shiftrightunsigned", F.col("_rest"), low).bitwiseAND(mask(size))
    below = F.col("_rest").bitwiseAND(mask(low))
    above = F.when(low + size >= 64, F.lit(0).cast("long")).otherwise(
        F.call_function("shiftleft", F.call_function("shiftrightunsigned", F.col("_rest"), (low + size).cast("int")), low))
    # a hash for a key: two buckets in one cost some more comparisons, never a link
    return each.select("fp", F.xxhash64("_key", "_part", value).alias("_key"), below.bitwiseOR(above).alias("_rest"),
                       (F.col("_n") - size).cast("int").alias("_n"))


def links(codes: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Links ``a``, ``b`` that connect all distinct fingerprints (``fp``) within ``radius`` of each other."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((2, 0), dtype=np.int64)
        for batch in chain(batches, [None]):
            if batch is not None:
                held = np.concatenate((held, np.stack([batch.column(i).to_numpy() for i in range(2)])), axis=1)
            # the last bucket may go on in the next batch
            ready = held.shape[1] if batch is None else int(np.searchsorted(held[0], held[0, -1])) if held.shape[1] else 0
            if ready:
                a, b = forest(held[0, :ready], held[1, :ready].view(np.uint64), radius)
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])
                held = held[:, ready:]

    rows = codes.select("fp", F.lit(0).cast("long").alias("_key"), F.col("fp").alias("_rest"), F.lit(64).alias("_n"))
    found, left = None, 64
    while True:
        rows, left = _divide(rows, radius), left - left // (radius + 1)
        large = durable(rows.groupBy("_key").agg(F.count(F.lit(1)).alias("_size")).where(F.col("_size") > bucket).select("_key"))
        more = 2**left > bucket and bool(large.take(1))  # distinct codes with few bits left are few
        small = rows.join(large, "_key", "left_anti") if more else rows
        dealt = small.select("_key", "fp").repartition("_key").sortWithinPartitions("_key")
        here = durable(dealt.mapInArrow(run, "a long, b long"))
        found = here if found is None else found.unionByName(here)
        if not more:
            return found
        rows = durable(rows.join(large, "_key", "left_semi"))


def groups(marked: DataFrame, doc_id: str = "doc_id", radius: int = RADIUS) -> DataFrame:
    """``marked`` (with ``_fp``) and ``_group`` (a number per group) and ``component_id``, the group's smallest doc_id."""
    nodes = durable(marked.groupBy(F.col("_fp").alias("fp")).agg(F.min(doc_id).alias("_low")))
    found = durable(components(links(nodes.select("fp"), radius)))
    named = nodes.join(found, nodes["fp"] == found["node"], "left").select("fp", "_low", F.coalesce("root", "fp").alias("_group"))
    low = named.groupBy("_group").agg(F.min("_low").alias("component_id"))
    members = durable(named.join(low, "_group").select(F.col("fp").alias("_fp"), "_group", "component_id"))
    return marked.join(members, "_fp")


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each group, that with the smallest doc_id; of rows that share it one stays. Columns are those of ``docs``."""
    marked = fingerprints(boxed(docs, doc_id, text), text=text)
    grouped = groups(durable(marked), doc_id)
    kept = grouped.where(F.col(doc_id).eqNullSafe(F.col("component_id"))).dropDuplicates(["_group"])
    return kept.select(unboxed(docs.columns))
