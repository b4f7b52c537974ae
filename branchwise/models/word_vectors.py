"""Word vectors from co-occurrence counts, with nothing of the vocabulary's size on the driver.

Counts of word pairs within a window, added up in cells of bounded size (``pair_counts``), become positive pointwise mutual information, a sparse symmetric matrix kept as rows. Its leading
eigenvectors come from subspace iteration: the factor table, a row per word, is multiplied with the matrix (a join by word and a sum that combines
before the shuffle) and made orthonormal again. Only products of ``dim`` by ``dim`` numbers reach the driver.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from branchwise.functions.vectors import vector_sum
from branchwise.operators.lexicon import as_dimension
from branchwise.session import durable, durable_counting

WINDOW = 5
ROUNDS = 6
#: Tokens that a task counts together.
BLOCK = 1_000_000
#: Pairs of places whose words share a cell, about; words are in as many groups as that takes.
CELL, LEAST_GROUPS = 8_000_000, 4
#: Pairs of places that a task sorts at once.
PART = 1_000_000
#: Rows' pairs that a task gathers before they meet those it has, and pairs that it hands on at once.
MERGE, ROWS = 1_000_000, 50_000
NO_NAMES = pa.array([], pa.string())
#: A block's pairs of one cell: its words, for every pair the places of both and the count, and how many pairs.
PACKED = "cell int, words array<string>, one binary, two binary, n binary, size int"
PACKED_NAMES = [c.split()[0] for c in PACKED.split(", ")]
#: Bits that mark frequent words, 16 MB of them, and those in a row of Spark's bitmaps.
MARKS, BUCKET_BITS = 1 << 27, 1 << 15


def _marks(words: DataFrame) -> np.ndarray:
    """A bit per checksum of a word, of fixed size whatever the vocabulary: other words may share a bit, none of these lacks its own."""
    place = (_mark() + 1).alias("p")  # Spark counts them from 1
    rows = (words.select(place).groupBy(F.bitmap_bucket_number("p").alias("bucket"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits")).collect())
    marks = np.zeros((MARKS // BUCKET_BITS, BUCKET_BITS // 8), np.uint8)
    for r in rows:
        marks[r["bucket"] - 1] = np.frombuffer(r["bits"], np.uint8)
    return marks.ravel()


def _mark():
    return F.crc32("token") % MARKS


def _joined(names: pa.Array, words: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """``names`` with those of ``words`` (all different) that they lack at the end, and the place of each word there."""
    place = pc.index_in(words, value_set=names).fill_null(-1).to_numpy().astype(np.int32)
    new = place < 0
    place[new] = len(names) + np.arange(new.sum(), dtype=np.int32)
    return pa.concat_arrays([names, words.filter(pa.array(new))]), place


def _pair_counter(marks, window: int, groups: int):
    """Counts of word pairs per block of tokens, packed by cell. Unmarked words form no pairs but keep their places.

    Frequent words are dealt to ``groups`` by a checksum; a pair's cell is that of its two words' groups. A block has one row for each of its cells:
    the cell's words, and the places of both words of every pair among them, and its count, in as few bytes each as hold the largest.
    """
    def numbered(names: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
        """Numbers of words by group, -1 without a mark and for null at the end; the names and groups of these numbers."""
        sums = np.fromiter((zlib.crc32(n.as_buffer()) for n in names), np.int64, len(names))
        at, bits = sums % MARKS, marks.value
        known = ((bits[at >> 3] >> (at & 7)) & 1).astype(bool)
        group = (sums * 40503 >> 16) % groups
        order = np.argsort(np.where(known, group, groups), kind="stable")[:known.sum()]
        number = np.full(len(names) + 1, -1, np.int32)
        number[order] = np.arange(len(order), dtype=np.int32)
        return number, names.take(pa.array(order)), group[order]

    def counted(of: np.ndarray, ids: np.ndarray, firsts: int, wide: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """Sorted codes (smaller number times ``wide`` plus larger) and counts of the pairs whose first token is among the first ``firsts``
        and whose smaller number is from ``low`` to below ``high``."""
        found, used = np.empty(window * firsts, np.int64), 0
        for w in range(1, window + 1):
            two = ids[w:firsts + w]
            one = ids[:len(two)]
            least = np.minimum(one, two)  # -1 where either has no number
            use = (of[:len(two)] == of[w:firsts + w]) & (least >= low) & (least < high)
            more = np.maximum(one[use], two[use])
            found[used:used + len(more)] = least[use].astype(np.int64) * wide + more
            used += len(more)
        found = found[:used]
        found.sort()
        start = np.flatnonzero(np.concatenate((np.ones(min(1, used), bool), found[1:] != found[:-1])))
        return found[start], np.diff(start, append=used)

    def starts(group: np.ndarray) -> np.ndarray:
        return np.searchsorted(group, np.arange(groups + 1))

    def packed(pairs: np.ndarray, n: np.ndarray, names: pa.Array, group: np.ndarray) -> Iterator[pa.RecordBatch]:
        ends = np.searchsorted(pairs, starts(group) * len(names))
        place = np.empty(len(names), np.int64)
        for g, (x, y) in enumerate(zip(ends, ends[1:])):
            if x == y:
                continue
            one, two = np.divmod(pairs[x:y], len(names))
            other = group[two].astype(np.int16)
            order = np.argsort(other, kind="stable")
            cuts = np.searchsorted(other[order], np.arange(g, groups + 1))
            rows: list[tuple] = []
            for h, (i, j) in enumerate(zip(cuts, cuts[1:]), g):
                if i == j:
                    continue
                here = order[i:j]
                seen = np.zeros(len(names), bool)
                seen[one[here]] = seen[two[here]] = True
                words = np.flatnonzero(seen)
                place[words] = np.arange(len(words))
                rows.append((h * (h + 1) // 2 + g, names.take(pa.array(words)), *[v.astype(np.min_scalar_type(v.max())).tobytes() for v in (place[one[here]], place[two[here]], n[x:y][here])], j - i))
            cell, words, one, two, times, size = zip(*rows)
            offsets = pa.array(np.concatenate(([0], np.cumsum([len(v) for v in words]))), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.ListArray.from_arrays(offsets, pa.concat_arrays(words)),
                                              *[pa.array(v, pa.binary()) for v in (one, two, times)], pa.array(size, pa.int32())], PACKED_NAMES)

    def block(names: pa.Array, codes: list[np.ndarray], sizes: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        number, names, group = numbered(names)
        ids = number[np.concatenate(codes)]
        lengths = np.concatenate(sizes)
        of = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
        parts = math.ceil(window * min(BLOCK, len(ids)) / PART)
        cuts = np.unique(np.round(groups * (1 - np.sqrt(1 - np.arange(parts + 1) / parts))).astype(int))  # the smaller number is more often a low one
        cuts = starts(group)[cuts]
        for at in range(0, len(ids), BLOCK):  # a stretch sees the window behind it, so lists may be cut anywhere
            stretch = slice(at, at + BLOCK + window)
            for low, high in zip(cuts, cuts[1:]):
                yield from packed(*counted(of[stretch], ids[stretch], min(BLOCK, len(ids) - at), len(names), low, high), names, group)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, codes, sizes, size = NO_NAMES, [], [], 0
        for batch in batches:
            lists = batch.column(0).drop_null()
            ends = lists.offsets.to_numpy()
            start = 0
            while start < len(lists):  # lists up to the one that fills the block
                stop = max(min(len(lists), int(np.searchsorted(ends, ends[start] + BLOCK - size))), start + 1)
                coded = lists.slice(start, stop - start).flatten().dictionary_encode()
                names, place = _joined(names, coded.dictionary)
                codes.append(np.append(place, -1)[coded.indices.fill_null(-1).to_numpy()])
                sizes.append(np.diff(ends[start:stop + 1]))
                size += int(ends[stop] - ends[start])
                start = stop
                if size >= BLOCK:
                    yield from block(names, codes, sizes)
                    names, codes, sizes, size = NO_NAMES, [], [], 0
        if size:
            yield from block(names, codes, sizes)
    return run


def _cell_adder(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """a, b, n from the rows of whole cells, as ``_pair_counter`` packs them: every pair once, its counts added up."""
    class Cell:
        def __init__(self):
            self.names = NO_NAMES
            self.key, self.n = np.zeros(0, np.int64), np.zeros(0, np.int64)
            self.held: list[tuple[np.ndarray, np.ndarray]] = []
            self.size = 0

        def add(self, key: np.ndarray, n: np.ndarray) -> None:
            self.held.append((key, n))
            self.size += len(key)
            if self.size >= MERGE:
                self.merge()

        def merge(self) -> None:
            if not self.held:
                return
            key, n = (np.concatenate([h[i] for h in self.held]) for i in (0, 1))
            self.held, self.size = [], 0
            order = np.argsort(key, kind="stable")
            key, n = key[order], n[order]
            start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            key, n = key[start], np.add.reduceat(n, start)
            at = np.searchsorted(self.key, key)
            old = np.append(self.key, -1)[at] == key
            self.n[at[old]] += n[old]
            self.key, self.n = np.insert(self.key, at[~old], key[~old]), np.insert(self.n, at[~old], n[~old])

    cells: dict[int, Cell] = {}
    for batch in batches:
        number, words, *parts, size = (batch.column(i) for i in range(len(PACKED_NAMES)))
        for i in range(len(batch)):
            cell = cells.setdefault(number[i].as_py(), Cell())
            cell.names, to = _joined(cell.names, words[i].values)
            m = size[i].as_py()
            one, two, n = (np.frombuffer(b := p[i].as_buffer(), f"u{b.size // m}") for p in parts)
            one, two, n = to[one].astype(np.int64), to[two].astype(np.int64), n.astype(np.int64)
            cell.add(np.minimum(one, two) << 32 | np.maximum(one, two), n)  # within a group blocks differ in which word is first
    for number in list(cells):
        cell = cells.pop(number)
        cell.merge()
        for at in range(0, len(cell.key), ROWS):
            key, n = cell.key[at:at + ROWS], cell.n[at:at + ROWS]
            yield pa.RecordBatch.from_arrays([*[cell.names.take(pa.array(x)) for x in (key >> 32, key & 0xFFFFFFFF)], pa.array(n)], ["a", "b", "n"])


def pair_counts(sentences: DataFrame, tokens: str, window: int = WINDOW, min_count: int = 5) -> DataFrame:
    """a, b, n: pairs of different positions at most ``window`` apart, each in one order only (a <= b), for words that occur ``min_count`` times or more.

    Tasks count blocks of tokens and pass on a row per cell of a block; a cell is added up in one task and holds as many pairs whatever the input,
    as there are more cells over more tokens. Rare words are left out by marks of the frequent ones; the few that share a mark with one of those go by name.
    """
    counted = sentences.select(F.explode(tokens).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("_n")).where("token is not null")
    words = durable(counted.withColumn("mark", _mark()))
    frequent = words.where(F.col("_n") >= min_count)
    marks = sentences.sparkSession.sparkContext.broadcast(_marks(frequent))
    tokens_kept = frequent.agg(F.sum("_n")).first()[0] or 0
    groups = max(LEAST_GROUPS, math.ceil(math.sqrt(2 * tokens_kept * window / CELL)))
    blocks = sentences.select(F.col(tokens).cast("array<string>")).mapInArrow(_pair_counter(marks, window, groups), PACKED)
    found = blocks.repartitionById(groups * (groups + 1) // 2, "cell").mapInArrow(_cell_adder, "a string, b string, n long")
    found = found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "n")
    shared, n = durable_counting(words.where(F.col("_n") < min_count).join(frequent.select("mark"), "mark", "left_semi").select("token"), F.lit(True))
    for side in ("a", "b") if n else ():
        found = found.join(shared.withColumnRenamed("token", side), side, "left_anti")
    same = F.col("a") == F.col("b")
    return found.select("a", "b", F.when(same, 2 * F.col("n")).otherwise(F.col("n")).alias("n"))


def both_orders(pairs: DataFrame) -> DataFrame:
    """The rows of ``pairs``, and with a and b changed over those of different words."""
    rest = [c for c in pairs.columns if c not in ("a", "b")]
    turned = F.struct(F.col("b").alias("a"), F.col("a").alias("b"), *rest)
    return pairs.select(F.inline(F.when(F.col("a") == F.col("b"), F.array(turned)).otherwise(F.array(F.struct("a", "b", *rest), turned))))


def cooccurrences(sentences: DataFrame, tokens: str, window: int = WINDOW, min_count: int = 5) -> DataFrame:
    """a, b, n: ordered pairs of different positions at most ``window`` apart, for words that occur ``min_count`` times or more."""
    return both_orders(pair_counts(sentences, tokens, window, min_count))


def positive_information(counts: DataFrame, keep: bool = False) -> DataFrame:
    """a, b, weight: ln(n * total / (n of a * n of b)), where it is positive. With ``keep`` all pairs stay with their ``n``, others without a weight."""
    return _informed(counts, counts, keep)


def _informed(counts: DataFrame, rows: DataFrame, keep: bool = False) -> DataFrame:
    """``positive_information`` for some ``rows`` of ``counts``."""
    sides = durable(counts.groupBy("a").agg(F.sum("n").alias("_n")))
    total = sides.agg(F.sum(F.col("_n").cast("double"))).scalar()
    sides = as_dimension(sides)
    weight = F.ln(F.col("n") * total / (F.col("_a").cast("double") * F.col("_b")))
    rows = (rows.join(sides.select("a", F.col("_n").alias("_a")), "a").join(sides.select(F.col("a").alias("b"), F.col("_n").alias("_b")), "b")
            .select("a", "b", "n", weight.alias("weight")))
    if keep:
        return rows.withColumn("weight", F.when(F.col("weight") > 0, F.col("weight")))
    return rows.select("a", "b", "weight").where("weight > 0")


def pair_information(pairs: DataFrame, keep: bool = False) -> DataFrame:
    """``positive_information`` of both orders of ``pair_counts``; words are looked up once for a pair."""
    return both_orders(_informed(both_orders(pairs), pairs, keep))


def _inner(table: DataFrame, left: str, right: str, dim: int) -> np.ndarray:
    """Sum over rows of the outer products of two vector columns: ``dim`` by ``dim`` numbers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for batch in batches:
            one, two = (batch.column(i).flatten().to_numpy().reshape(-1, dim) for i in (0, 1))
            total += one.T @ two
        yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], ["i", "row"])

    rows = table.select(left, right).mapInArrow(run, "i int, row array<double>").groupBy("i").agg(vector_sum(F.col("row"), dim).alias("row")).collect()
    out = np.zeros((dim, dim))
    for r in rows:
        out[r["i"]] = r["row"]
    return out


def _turned(table: DataFrame, vector: str, matrix: np.ndarray) -> DataFrame:
    """``token`` and the vector column times a small matrix."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            product = batch.column(1).flatten().to_numpy().reshape(-1, len(matrix)) @ matrix
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(product.tolist(), pa.list_(pa.float64()))], ["token", "vector"])

    return table.select("token", vector).mapInArrow(run, "token string, vector array<double>")


def factorise(weights: DataFrame, dim: int, rounds: int = ROUNDS, seed: int = 42) -> DataFrame:
    """token, vector: the leading eigenvectors of the symmetric matrix (a, b, weight), scaled by the root of their values."""
    weights = durable(weights)
    start = lambda i: F.pmod(F.xxhash64("token", i, F.lit(seed)), F.lit(1 << 20)) / float(1 << 19) - 1
    basis = weights.select(F.col("a").alias("token")).distinct().withColumn("vector", F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), start))
    product = None
    for r in range(rounds + 1):
        if product is not None:
            basis = product
        # orthonormal: directions without length are left out
        values, turn = np.linalg.eigh(_inner(basis, "vector", "vector", dim))
        keep = values > 1e-12 * max(values.max(), 1e-300)
        basis = durable(_turned(basis, "vector", np.where(keep, turn / np.sqrt(np.where(keep, values, 1.0)), 0.0)))
        product = durable(weights.join(basis, weights["b"] == basis["token"]).groupBy(F.col("a").alias("token"))
                          .agg(vector_sum(F.col("vector"), dim, F.col("weight")).alias("vector")))
    both = basis.join(product.withColumnRenamed("vector", "image"), "token")
    values, turn = np.linalg.eigh(_inner(both, "vector", "image", dim))
    order = np.argsort(-values)
    return _turned(basis, "vector", turn[:, order] * np.sqrt(np.maximum(values[order], 0.0)))


def train(sentences: DataFrame, tokens: str, dim: int = 300, window: int = WINDOW, min_count: int = 5, rounds: int = ROUNDS, seed: int = 42) -> DataFrame:
    """Word vectors of ``dim`` numbers as a (token, vector) table."""
    pairs = durable(pair_counts(sentences, tokens, window, min_count))
    vectors = factorise(pair_information(pairs), dim, rounds, seed)
    return vectors.select("token", F.col("vector").cast("array<float>").alias("vector"))
