"""Substring deduplication by words, with a compressed FM-index per shard.

A word is removed if a window of ``WINDOW`` words that covers it also starts in a document with a smaller doc_id. To find
such windows without holding every document against every shard, texts are cut so that equal windows meet in one shard: the anchor of a window is the
smallest hash among its runs of ``ANCHOR`` words (the first on ties), and consecutive windows with the same anchor form a segment. Equal
windows have equal anchors, so shards are hash ranges of anchors.

1. Every document is cut into segments once; its anchors are written beside its text. Each task's anchors go, as sorted packed columns with the smallest and
   largest doc_id, to ranges of the hash; a range says which of them stand in two documents or more. Others can hold no shared window and end here.
2. Texts meet the shared anchors of their own part and their segments with one are cut out; equal ones become one, with its smallest doc_id. Where an anchor has over ``CROWD``
   different segments, each of their windows is a segment of its own, dealt by its own hash, so no shard grows with a frequent phrase.
3. A shard indexes its segments: suffix array, Burrows-Wheeler transform, wavelet matrix with packed bits and block
   counts. Segments are streamed through backward search, which gives the matching statistics (words matched by more
   than the window itself) and, for windows matched over the threshold, the interval of suffixes; a range minimum over it
   is the smallest doc_id the window starts in.
4. Every occurrence compares that with its own doc_id, and each document is written without the words covered.

Defined cases: a null text has no words; a document of under ``WINDOW`` words loses none; rows that share a doc_id don't remove from each
other; rows without a doc_id neither remove nor lose words; other columns stay. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from branchwise.llm.words import columns_and, map_arrow, quoted, stored, word_bytes
from branchwise.session import durable

WINDOW = 13
ANCHOR = 5
CROWD = 5_000
SHARD_SEGMENTS = 40_000
STRIP = 1 << 16
CHUNK_BYTES = 500_000
HELD = 4_000_000
RANGE_SEGMENTS = 1_000_000
REMEMBER = 500_000


def segments(words: list[bytes], window: int = WINDOW, anchor: int = ANCHOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, first window, number of windows) of each segment of a document."""
    n = len(words) - window + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    single = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    run = np.zeros(len(words) - anchor + 1, dtype=np.uint64)
    for i in range(anchor):
        run = run * np.uint64(0x9E3779B97F4A7C15) + single[i:i + len(run)]
    run ^= run >> np.uint64(29)
    run *= np.uint64(0xBF58476D1CE4E5B9)
    run ^= run >> np.uint64(32)
    width = window - anchor + 1
    place = np.empty(n, dtype=np.int64)
    for at in range(0, n, STRIP):  # a strip at a time
        part = _first_minimum(run[at:at + STRIP + width - 1], width)[:n - at]
        place[at:at + len(part)] = part + at
    first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    return run[place[first]].view(np.int64), first, np.diff(first, append=n)


def _first_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the (first) smallest of every ``width`` neighbours, by doubling."""
    place, low, have = np.arange(len(values)), values, 1
    while have < width:
        step = min(have, width - have)
        later = low[step:] < low[:-step]
        place, low = np.where(later, place[step:], place[:-step]), np.where(later, low[step:], low[:-step])
        have += step
    return place


PART = "part int, at int, doc_ids array<long>, hashes array<long>, texts binary, sizes array<int>, own array<int>, anchors binary, count binary"


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with their segments, a few hundred to a row.

    ``texts`` are their bytes, compressed together, of ``sizes`` each. ``own`` is the number of segments of each; ``anchors`` and ``count`` (windows) are
    packed, one document after the other. A segment begins where the one before it ends, so its place needn't be kept.
    """
    part, number, names = TaskContext.get().partitionId(), 0, [c.split()[0] for c in PART.split(", ")]
    kinds = [pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            found, texts, size = [], [], 0
            while at + len(texts) < batch.num_rows and len(texts) < 256 and size < CHUNK_BYTES:
                texts.append((batch.column(2)[at + len(texts)].as_py() or "").encode("utf-8", "surrogatepass"))
                found.append(segments(texts[-1].split()))
                size += len(texts[-1])
            ids, hashes = (batch.column(i).slice(at, len(texts)).to_pylist() for i in (0, 1))
            at += len(texts)
            anchors, count = (np.concatenate([f[i] for f in found]).astype(t).tobytes() for i, t in ((0, np.int64), (2, np.uint8)))
            row = [part, number, ids, hashes, pa.compress(b"".join(texts), codec="zstd", asbytes=True), list(map(len, texts)), [len(f[0]) for f in found], anchors, count]
            number += 1
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names)


def _merged(anchors: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct anchors, in order, with the smallest and the largest doc_id."""
    order = np.argsort(anchors, kind="stable")
    anchors = anchors[order]
    starts = np.flatnonzero(np.concatenate(([True], anchors[1:] != anchors[:-1]))) if len(anchors) else np.zeros(0, np.int64)
    return anchors[starts], *[f.reduceat(x[order], starts) if len(starts) else x for f, x in ((np.minimum, low), (np.maximum, high))]


def _asked(bits: int):
    """Anchors of each part, by range of their hash: range, part, anchors, low, high (packed)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for part, pieces in held.items():
                columns = _merged(*[np.concatenate([x[i] for x in pieces]) for i in range(3)])
                if not len(columns[0]):
                    continue
                cell = (columns[0].view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(columns[0]), np.int64)
                order = np.argsort(cell, kind="stable")
                cells, starts = np.unique(cell[order], return_index=True)
                parts = [np.split(c[order], starts[1:]) for c in columns]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cells, pa.int64()), pa.array([part] * len(cells), pa.int32()), *[pa.array([x.tobytes() for x in p], pa.binary()) for p in parts]],
                    ["range", "part", "anchors", "low", "high"])
            held.clear()

        for batch in batches:
            for part, ids, own, packed in zip(*(batch.column(i) for i in range(4))):
                doc = np.repeat(ids.values.to_numpy(), own.values.to_numpy())
                held.setdefault(part.as_py(), []).append((np.frombuffer(packed.as_py(), np.int64), doc, doc))
                size += len(doc)
            if size >= HELD:
                yield from flush()
                size = 0
        yield from flush()

    return run


def _shared(rows: pd.DataFrame) -> pd.DataFrame:
    """Of one range: the anchors of each row that stand in two documents or more."""
    unpacked = [[np.frombuffer(x, np.int64) for x in rows[c]] for c in ("anchors", "low", "high")]
    anchors, low, high = _merged(*[np.concatenate(u) for u in unpacked])
    anchors = anchors[low < high]
    return pd.DataFrame({"part": rows["part"], "anchors": [x[np.isin(x, anchors, assume_unique=True)].tobytes() for x in unpacked[0]]})


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments with a wanted anchor: the document's key, first window, and a 128-bit hash of the words.

    Rows of a part come together, its shared anchors first. The words and the anchor come with the first segment of its kind that a
    task meets (or meets again after ``REMEMBER`` others).
    """
    names = ["doc_id", "_h", "start", "sid", "anchor", "body"]
    seen: set[bytes] = set()
    part, wanted, sought = None, [], None
    for batch in batches:
        for row in range(batch.num_rows):
            of, at, ids, hashes, texts, sizes, own, anchors, count = (batch.column(i)[row] for i in range(9))
            if of.as_py() != part:
                part, wanted, sought = of.as_py(), [], None
            if at.as_py() < 0:
                wanted.append(np.frombuffer(anchors.as_py(), np.int64))
                continue
            if sought is None:
                sought = np.sort(np.concatenate(wanted)) if wanted else np.zeros(0, np.int64)
            if not len(sought):
                continue
            keys = np.frombuffer(anchors.as_py(), np.int64)
            places = np.flatnonzero(sought[np.minimum(np.searchsorted(sought, keys), len(sought) - 1)] == keys)
            if not len(places):
                continue
            owned, windows = own.values.to_numpy(), np.frombuffer(count.as_py(), np.uint8).astype(np.int64)
            before = np.concatenate(([0], np.cumsum(windows)))
            doc = np.repeat(np.arange(len(owned)), owned)
            starts = (before[:-1] - before[np.cumsum(owned) - owned][doc])[places]  # windows of the document before the segment
            doc, wide = doc[places], windows[places] + WINDOW - 1
            ends = np.cumsum(sizes.values.to_numpy()).tolist()
            raw = pa.decompress(texts.as_py(), decompressed_size=ends[-1], codec="zstd", asbytes=True)
            sids, bodies, last, words = [], [], -1, []
            for d, a, n in zip(doc.tolist(), starts.tolist(), wide.tolist()):
                if d != last:
                    last, words = d, raw[ends[d - 1] if d else 0:ends[d]].split()
                body = b" ".join(words[a:a + n])
                sid = xxhash.xxh3_128_digest(body)
                if sid in seen:
                    body = None
                else:
                    if len(seen) >= REMEMBER:
                        seen.clear()
                    seen.add(sid)
                sids.append(sid)
                bodies.append(body)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids.values.to_numpy()[doc]), pa.array(hashes.values.to_numpy()[doc]), pa.array(starts), pa.array(sids, pa.binary()),
                 pa.array(keys[places], mask=np.array([b is None for b in bodies])), pa.array(bodies, pa.binary())], names)


class Bits:
    """A packed bit vector with block counts: ``ones(i)`` counts set bits before position i."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, dtype=np.uint8)
        padded[:len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)[:-1])).astype(np.int32)
        self.zeros = len(bits) - int(bits.sum())

    def ones(self, at: np.ndarray) -> np.ndarray:
        block = at >> 6
        low = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[block] + np.bitwise_count(self.words[block] & low)


class FmIndex:
    """Backward search over a text of integer symbols in segments; symbol 0 ends each of them and is never searched."""

    def __init__(self, symbols: np.ndarray):
        n, ends = len(symbols), symbols == 0
        rank = symbols.astype(np.int64) + int(ends.sum())
        rank[ends] = np.arange(int(ends.sum()))  # every end is a symbol of its own, so all suffixes differ
        _, rank = np.unique(rank, return_inverse=True)
        step = 1
        while True:  # prefix doubling
            follow = np.full(n, -1, dtype=np.int64)
            follow[:n - step] = rank[step:]
            key = rank * (n + 2) + follow + 1
            self.suffixes = np.argsort(key, kind="stable")
            ordered = key[self.suffixes]
            new = np.empty(n, dtype=np.int64)
            new[self.suffixes] = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1])))
            rank, step = new, 2 * step
            if n == 0 or rank.max() == n - 1 or step >= n:
                break
        last = symbols[self.suffixes - 1] if n else symbols
        self.n, top = n, int(symbols.max(initial=0))
        self.below = np.concatenate(([0], np.cumsum(np.bincount(symbols, minlength=top + 1))))
        self.levels: list[tuple[int, Bits]] = []
        for shift in range(max(1, top.bit_length()) - 1, -1, -1):  # a wavelet matrix, highest bit first
            bit = (last >> shift & 1).astype(np.uint8)
            self.levels.append((shift, Bits(bit)))
            last = np.concatenate((last[bit == 0], last[bit == 1]))
        self.origin = self._walk(np.arange(top + 1), np.zeros(top + 1, dtype=np.int64))

    def _walk(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for shift, bits in self.levels:
            ones = bits.ones(at)
            at = np.where(symbol >> shift & 1, bits.zeros + ones, at - ones)
        return at

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix intervals of symbol + pattern from those of the patterns."""
        base = self.below[symbol] - self.origin[symbol]
        return base + self._walk(symbol, low), base + self._walk(symbol, high)

    def matches(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per pattern (a row that occurs in the text): how many of its last symbols occur twice or more, and the interval of the whole if all do."""
        low, high = np.zeros(len(patterns), dtype=np.int64), np.full(len(patterns), self.n, dtype=np.int64)
        length = np.zeros(len(patterns), dtype=np.int64)
        alive = np.arange(len(patterns))
        for t in range(patterns.shape[1] - 1, -1, -1):
            low[alive], high[alive] = self.extend(patterns[alive, t], low[alive], high[alive])
            alive = alive[high[alive] - low[alive] > 1]
            length[alive] += 1
        return length, low, high


def range_minimum(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Minimum of values[low:high] for every (non-empty) pair."""
    out, level, width = np.empty(len(low), dtype=np.int64), values, 1
    power = np.frexp((high - low).astype(float))[1] - 1
    for p in range(int(power.max(initial=-1)) + 1):
        at = np.flatnonzero(power == p)
        out[at] = np.minimum(level[low[at]], level[high[at] - width])
        level = np.minimum(level[:-width], level[width:]) if len(level) > width else level
        width *= 2
    return out


def smallest_starts(shard: pd.DataFrame) -> pd.DataFrame:
    """Of each segment (sid, body, low) of a shard: the smallest doc_id in which each of its windows starts."""
    bodies = [b.split(b" ") for b in shard["body"]]
    sizes = np.array([len(b) for b in bodies], dtype=np.int64)
    number: dict[bytes, int] = {}
    symbols = np.zeros(int(sizes.sum()) + len(sizes), dtype=np.int64)
    starts = np.concatenate(([0], np.cumsum(sizes + 1)))[:-1]
    for at, body in zip(starts.tolist(), bodies):
        symbols[at:at + len(body)] = [number.setdefault(w, len(number) + 1) for w in body]
    index = FmIndex(symbols)
    owner = np.repeat(np.arange(len(sizes)), sizes + 1)
    lows = shard["low"].to_numpy(np.int64)
    of_suffix = lows[owner[index.suffixes]]
    count = sizes - WINDOW + 1
    places = np.repeat(starts, count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    result = np.repeat(lows, count)
    for at in range(0, len(places), STRIP):
        part = places[at:at + STRIP]
        length, low, high = index.matches(symbols[part[:, None] + np.arange(WINDOW)])
        full = np.flatnonzero(length == WINDOW)
        result[at + full] = range_minimum(of_suffix, low[full], high[full])
    return pd.DataFrame({"sid": shard["sid"], "lows": np.split(result, np.cumsum(count)[:-1])})


def _searched(keyed: DataFrame, n: int) -> DataFrame:
    """sid, lows of the ``n`` segments in ``keyed`` (key, sid, body, low), shard by shard."""
    shards = max(1, -(-n // SHARD_SEGMENTS))
    dealt = keyed.withColumn("_shard", F.pmod(F.xxhash64("key"), F.lit(shards)))
    return dealt.select("_shard", "sid", "body", "low").groupBy("_shard").applyInPandas(lambda x: smallest_starts(x), "sid binary, lows array<long>")


def _windows(distinct: DataFrame) -> DataFrame:
    """The windows of crowded segments: sid, ``_i`` and the window as ``body``."""
    return (distinct.withColumn("_w", F.split(F.col("body").cast("string"), " "))
            .withColumn("_i", F.explode(F.sequence(F.lit(0), F.size("_w") - WINDOW)))
            .select("sid", "_i", "low", F.array_join(F.slice("_w", F.col("_i") + 1, F.lit(WINDOW)), " ").cast("binary").alias("body")))


def covered(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Removed windows: doc_id, ``_h`` (hash of the text) and ``hits``, (first window, bits of the windows after it) of each segment."""
    spark = docs.sparkSession
    named = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("_h"), "text")
    marked, drop_marked = stored(named.mapInArrow(_marked, PART))
    n_parts, n_segments = marked.agg(F.max("part"), F.sum(F.octet_length("anchors")) / 8).first()
    bits = math.ceil(math.log2(max((n_segments or 0) / RANGE_SEGMENTS, int(spark.conf.get("spark.sql.shuffle.partitions")), 1)))
    asked = marked.select("part", "doc_ids", "own", "anchors").mapInArrow(_asked(bits), "range long, part int, anchors binary, low binary, high binary")
    shared, drop_shared = stored(asked.groupBy("range").applyInPandas(lambda rows: _shared(rows), "part int, anchors binary").where(F.octet_length("anchors") > 0))
    del asked  # a frame that is still named keeps its shuffle files
    spark.sparkContext._jvm.System.gc()
    empty = [F.lit(None).cast(marked.schema[c].dataType).alias(c) for c in marked.columns]
    answers = shared.select(*[F.col("part") if c == "part" else F.lit(-1).alias(c) if c == "at" else F.col(c) if c == "anchors" else e for c, e in zip(marked.columns, empty)])
    # a part to a task, as it was read: its shared anchors come before its texts
    met = marked.unionByName(answers).repartitionById((n_parts or 0) + 1, F.col("part")).sortWithinPartitions("part", "at")
    cut, drop_cut = stored(met.mapInArrow(_cut, "doc_id long, _h long, start long, sid binary, anchor long, body binary"))
    del met, answers
    drop_shared()
    drop_marked()
    distinct, drop_distinct = stored(cut.groupBy("sid").agg(F.max("anchor").alias("anchor"), F.max("body").alias("body"), F.min("doc_id").alias("low")))
    crowds = durable(distinct.groupBy("anchor").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > crowd).select("anchor"))
    if crowds.take(1):
        few = distinct.join(crowds, "anchor", "left_anti").withColumnRenamed("anchor", "key").select("key", "sid", "body", "low")
        windows, drop_windows = stored(_windows(distinct.join(crowds, "anchor", "left_semi")).withColumn("_wid", F.md5("body")))
        single, drop_single = stored(windows.groupBy("_wid").agg(F.first("body").alias("body"), F.min("low").alias("low")))
        dealt = few.unionByName(single.select(F.xxhash64("_wid").alias("key"), F.col("_wid").cast("binary").alias("sid"), "body", "low"))
        found = durable(_searched(dealt, few.count() + single.count()))
        drop_single()
        regained = (windows.withColumn("_key", F.col("_wid").cast("binary")).join(found.select(F.col("sid").alias("_key"), F.col("lows")[0].alias("_low")), "_key")
                    .groupBy("sid").agg(F.array_sort(F.collect_list(F.struct("_i", "_low"))).alias("_x")).select("sid", F.col("_x._low").alias("lows")))
        result = durable(found.join(few.select("sid"), "sid", "left_semi").unionByName(regained))
        drop_windows()
    else:
        result = durable(_searched(distinct.withColumnRenamed("anchor", "key"), distinct.count()))
    drop_distinct()
    hit = F.aggregate(F.transform("lows", lambda x, i: F.when(x < F.col("doc_id"), F.call_function("shiftleft", F.lit(1), i)).otherwise(F.lit(0))),
                      F.lit(0), lambda a, b: a + b)
    marked = cut.select("doc_id", "_h", "start", "sid").join(result, "sid").select("doc_id", "_h", "start", hit.alias("bits")).where("bits > 0")
    hits = durable(marked.groupBy("doc_id", "_h").agg(F.collect_set(F.struct("start", "bits")).alias("hits")))
    drop_cut()
    return hits


def deduplicate(docs: DataFrame, digest: bool = False, **options) -> DataFrame:
    """``docs`` without covered words: n_words, n_removed, and the kept words joined by one space as ``text`` (``digest``: their SHA-256 as kept_sha256)."""
    hits = covered(docs, **options)
    right = hits.select(F.col("doc_id").alias("_id"), F.col("_h").alias("_hash"), "hits")
    joined = docs.join(right, (docs["doc_id"] == right["_id"]) & (F.xxhash64(docs["text"]) == right["_hash"]), "left")
    new = "kept_sha256" if digest else "text"
    keep = [c for c in docs.columns if c not in ("text", "n_words", "n_removed", "kept_sha256", "hits")]
    schema = columns_and(docs, keep, f"n_words long, n_removed long, {new} string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[], [], []]
            marks = batch.column(len(keep) + 1)
            ends = np.cumsum(marks.value_lengths().fill_null(0).to_numpy()).tolist()
            starts, bits = (marks.flatten().field(i).to_numpy() for i in (0, 1))
            for text, a, b in zip(batch.column(len(keep)), [0, *ends], ends):
                words = word_bytes(text.as_py())
                kept = words
                if b > a:
                    gone, n = np.zeros(len(words) + 1, dtype=np.int64), len(words)
                    for i in range(int(bits[a:b].max()).bit_length()):
                        at = starts[a:b][bits[a:b] >> i & 1 == 1] + i
                        np.add.at(gone, at, 1)
                        np.add.at(gone, np.minimum(at + WINDOW, n), -1)
                    kept = list(compress(words, (np.cumsum(gone[:-1]) == 0).tolist()))
                joined_words = b" ".join(kept)
                for out, v in zip(rows, (len(words), len(words) - len(kept), hashlib.sha256(joined_words).hexdigest() if digest else joined_words.decode())):
                    out.append(v)
            kinds = [pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(keep))], *[pa.array(v, k) for v, k in zip(rows, kinds)]],
                                             [*keep, "n_words", "n_removed", new])

    return map_arrow(joined.select(*[docs[quoted(c)] for c in keep], docs["text"], right["hits"]), run, schema)
