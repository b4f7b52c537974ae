"""Prefix trie of conversations, with vertical bitmaps.

Conversations that begin with the same turns share the nodes of a trie: a node is a distinct sequence of first turns, the
root the empty one. Every node gets its members' count and smallest id, its children, the leaves of its subtree, the characters that
sharing saves, and a digest of the ids of conversations that end there.

1. ``rebuilt`` numbers turns and puts the shared beginning in front. From there on a turn is its 128-bit digest and its length.
2. Equal conversations become one, with a count and the smallest id, so copies cost nothing below.
3. Prefixes that more than ``CROWD`` different conversations share are the crown of the trie. It is counted by Spark: sums that combine before
   the shuffle. What hangs below the crown is many subtrees of at most ``CROWD`` conversations each; they are dealt to shards by hash.
4. In a shard, postings hold for every (position, turn) the bitset of conversations that have the turn there. A node is a
   bitset: its children are found depth first by intersecting it with the postings of its lowest conversation at the next position, taking those
   out, and so on; what no child takes ends in the node. Copies are counted by bit slices of their numbers (popcounts weighted by powers of two).
   Conversations are numbered by smallest id, so the lowest bit names a node.
5. Subtree sums of the crown add up those of the subtrees along the ancestors of the crown's own nodes.
6. Ids that end in a node are sorted over all tasks and packed into runs; the digest goes over the runs as a stream, never over a list in memory.

Sizes: a conversation's digests (24 bytes a turn) travel in one row, like a text; shards hold about ``CROWD`` different conversations.

Defined cases: rows without a conv_id take no part; null role or text is empty; turns go by number, null first, ties by role, then
text, and repeated rows are turns of their own; a conversation without turns (all of them replaced by an absent beginning) is a member of the root and
ends there; other columns are ignored. An empty table gives no nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from branchwise.llm.words import stored
from branchwise.session import durable

CROWD = 2048
RUN = 1 << 16
SHARED = 100
NODE = ("node binary, parent binary, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
        "saved_tokens long, ends binary")


def turns_kept(conv_id: Column) -> Column:
    """How many turns of a conversation are the shared beginning: unsigned CRC-32 of its decimal id, modulo 6."""
    return F.crc32(conv_id.cast("string").cast("binary")) % 6


def rebuilt(conversations: DataFrame, shared: int = SHARED) -> DataFrame:
    """conv_id, ``turns``: (pos from 1, digest, n characters) in order; one row per conv_id."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    plain = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("_role"), text.alias("_text"))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "_role", "_text"))
    # the length in front keeps (role, text) pairs apart that read alike when joined
    digest = F.unhex(F.md5(F.concat_ws(":", F.char_length("_role").cast("string"), "_role", "_text")))
    own = durable(plain.select("conv_id", place.cast("long").alias("pos"), digest.alias("turn"), F.char_length("_text").cast("long").alias("n")))
    lengths = own.groupBy("conv_id").agg(F.max("pos").alias("_len"))
    ids = lengths.select("conv_id", (F.col("conv_id") - F.col("conv_id") % shared).alias("_base"), turns_kept(F.col("conv_id")).alias("_h"))
    bases = lengths.select(F.col("conv_id").alias("_base"), F.col("_len").alias("_base_len"))
    ids = durable(ids.join(bases, "_base", "left").select(
        "conv_id", "_base", "_h", F.least("_h", F.coalesce("_base_len", F.lit(0))).cast("long").alias("_front")))
    beginnings = own.where("pos <= 5").select(F.col("conv_id").alias("_base"), "pos", "turn", "n")  # h is 5 at most
    front = ids.where("_front > 0").join(beginnings, "_base").where("pos <= _h").select("conv_id", "pos", "turn", "n")
    back = own.join(ids.select("conv_id", "_h", "_front"), "conv_id").where("pos > _h").select(
        "conv_id", (F.col("pos") - F.col("_h") + F.col("_front")).alias("pos"), "turn", "n")
    # turnless conversations stay, with an empty array
    whole = front.unionByName(back).unionByName(ids.select("conv_id", *[F.lit(None).cast(t).alias(c) for c, t in (("pos", "long"), ("turn", "binary"), ("n", "long"))]))
    item = F.when(F.col("pos").isNotNull(), F.struct("pos", "turn", "n"))
    return whole.groupBy("conv_id").agg(F.array_sort(F.collect_list(item)).alias("turns"))


def _paths(conversations: DataFrame) -> DataFrame:
    """conv_id, ``path`` (digest of each prefix, the empty one first), ``turns`` (digest of each turn) and ``chars`` of each turn."""
    digests = pa.list_(pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, kept, chars = [], [], []
            for turns in batch.column(1).to_pylist():
                at = hashlib.md5(b"").digest()
                path = [at]
                for t in turns:
                    at = hashlib.md5(at + t["turn"]).digest()
                    path.append(at)
                paths.append(path)
                kept.append([t["turn"] for t in turns])
                chars.append([t["n"] for t in turns])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(paths, digests), pa.array(kept, digests), pa.array(chars, pa.list_(pa.int64()))],
                                             ["conv_id", "path", "turns", "chars"])

    return conversations.mapInArrow(run, "conv_id long, path array<binary>, turns array<binary>, chars array<long>")


def subtrees(roots: list[int], paths: list[list[bytes]], turns: list[list[bytes]], chars: list[list[int]], copies: list[int], lows: list[int]) -> Iterator[tuple]:
    """Nodes of all subtrees of a shard, in the columns of ``NODE`` but for the digest of the end.

    Conversation i has its subtree's root at depth ``roots[i]``. Depth-first, over bitsets of conversations.
    """
    order = sorted(range(len(paths)), key=lambda i: lows[i])
    roots, paths, turns, chars, copies, lows = ([x[i] for i in order] for x in (roots, paths, turns, chars, copies, lows))
    postings: dict[tuple[int, bytes], int] = {}
    starts: dict[bytes, int] = {}
    ends: dict[int, int] = {}
    slices: list[int] = []
    for i, path in enumerate(paths):
        bit = 1 << i
        starts[path[roots[i]]] = starts.get(path[roots[i]], 0) | bit
        ends[len(path) - 1] = ends.get(len(path) - 1, 0) | bit
        for k in range(copies[i].bit_length()):
            if len(slices) <= k:
                slices.append(0)
            if copies[i] >> k & 1:
                slices[k] |= bit
        for pos in range(roots[i], len(turns[i])):
            key = pos, turns[i][pos]
            postings[key] = postings.get(key, 0) | bit
    for members in starts.values():
        nodes, stack = [], [(members, -1)]
        while stack:
            bits, parent = stack.pop()
            low = (bits & -bits).bit_length() - 1
            depth = nodes[parent][1] + 1 if parent >= 0 else roots[low]
            count = sum((bits & s).bit_count() << k for k, s in enumerate(slices))
            here, done = len(nodes), bits & ends.get(depth, 0)
            rest, children = bits & ~done, 0
            while rest:
                first = (rest & -rest).bit_length() - 1
                child = bits & postings[depth, turns[first][depth]]
                stack.append((child, here))
                rest &= ~child
                children += 1
            saved = (count - 1) * chars[low][depth - 1] if depth else 0
            # index, depth, parent, count, children, leaves, saved, whether a conversation ends here
            nodes.append([low, depth, parent, count, children, int(not children), saved, bool(done)])
        for node in reversed(nodes):  # children come after their parents
            if node[2] >= 0:
                nodes[node[2]][5] += node[5]
                nodes[node[2]][6] += node[6]
        for low, depth, parent, count, children, leaves, saved, ended in nodes:
            node = paths[low][depth]
            yield (node, paths[low][depth - 1] if depth else None, depth, lows[low], lows[nodes[parent][0]] if parent >= 0 else None,
                   count, children, leaves, saved, node if ended else None)


def _grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shards, whose rows come one after the other, to nodes."""
    names = [f.split()[0] for f in NODE.split(", ")]
    kinds = [pa.binary() if n in ("node", "parent", "ends") else pa.int64() for n in names]

    def nodes(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        found = []
        for row in subtrees(*[[r[c] for r in rows] for c in ("at", "path", "turns", "chars", "copies", "low")]):
            found.append(row)
            if len(found) == RUN:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], names)
                found = []
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], names)

    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and row["shard"] != held[0]["shard"]:
                yield from nodes(held)
                held = []
            held.append(row)
    if held:
        yield from nodes(held)


def _id_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (ends, conv_id) to runs: ends, first id, the ids in decimal joined by commas."""
    names = ["ends", "first", "ids"]
    end, ids = None, []

    def one() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([end], pa.binary()), pa.array([ids[0]], pa.int64()), pa.array([",".join(map(str, ids)).encode()], pa.binary())], names)

    for batch in batches:
        for e, i in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if ids and (e != end or len(ids) == RUN):
                yield one()
                ids = []
            end = e
            ids.append(i)
    if ids:
        yield one()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs sorted by (ends, first) to one SHA-256 per end."""
    end, state = None, None
    for batch in batches:
        keys, found = [], []
        for e, run in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if e != end:
                if state is not None:
                    keys.append(end)
                    found.append(state.hexdigest())
                end, state = e, hashlib.sha256(run)
            else:
                state.update(b",")
                state.update(run)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(found, pa.string())], ["ends", "ends_sha256"])
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([end], pa.binary()), pa.array([state.hexdigest()], pa.string())], ["ends", "ends_sha256"])


def _ends(paths: DataFrame) -> DataFrame:
    """ends, ends_sha256: of every whole sequence, the digest of the ids that have it."""
    tasks = int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ids = paths.select(F.element_at("path", -1).alias("ends"), "conv_id")
    runs = durable(ids.repartitionByRange(tasks, "ends", "conv_id").sortWithinPartitions("ends", "conv_id").mapInArrow(_id_runs, "ends binary, first long, ids binary"))
    return runs.repartition("ends").sortWithinPartitions("ends", "first").select("ends", "ids").mapInArrow(_digests, "ends binary, ends_sha256 string")


def trie(conversations: DataFrame, crowd: int = CROWD, shared: int = SHARED) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    paths, _ = stored(_paths(rebuilt(conversations, shared)))
    end = F.element_at("path", -1)
    distinct, _ = stored(paths.groupBy(end.alias("_end")).agg(F.count(F.lit(1)).alias("copies"), F.min("conv_id").alias("low"),
                                                             F.first("path").alias("path"), F.first("turns").alias("turns"),
                                                             F.first("chars").alias("chars")))
    shards = max(1, -(-distinct.count() // crowd))
    each = distinct.select("_end", "copies", "low", F.posexplode("path").alias("depth", "node"))
    busy = each.groupBy("node").agg(F.count(F.lit(1)).alias("_n"), F.sum("copies").alias("n_convs"), F.min("low").alias("conv_id"), F.max("depth").cast("long").alias("depth"))
    crown = durable(busy.where((F.col("_n") > crowd) | (F.col("depth") == 0)).drop("_n"))  # the root always
    # per conversation, how many of its first nodes are in the crown: its subtree begins behind them
    above = each.select("_end", "node").join(crown.select("node"), "node", "left_semi").groupBy("_end").agg(F.count(F.lit(1)).alias("at"))
    placed, _ = stored(distinct.join(above, "_end"))
    below = placed.where(F.size("path") > F.col("at")).select(
        F.pmod(F.xxhash64(F.element_at("path", (F.col("at") + 1).cast("int"))), F.lit(shards)).alias("shard"),
        "at", "path", "turns", "chars", "copies", "low")
    grown, _ = stored(below.repartition(shards, "shard").sortWithinPartitions("shard").mapInArrow(_grow, NODE))
    # the crown: own numbers, then sums over what hangs below. All rows of a node agree in parent and length
    before, last = (F.when(F.col("depth") > 0, F.element_at(c, F.col("depth"))) for c in ("path", "chars"))
    rows = (placed.select("_end", "low", "path", "chars", F.posexplode(F.slice("path", F.lit(1), F.col("at").cast("int"))).alias("depth", "node"))
            .select("_end", "low", "node", before.alias("_before"), last.alias("_last")))
    shape = rows.groupBy("node").agg(F.max("_before").alias("parent"), F.max("_last").alias("_chars"), F.min(F.struct("low", "_end")).getField("_end").alias("_end"))
    shape = shape.join(distinct.select("_end", F.col("path").alias("_path")), "_end").drop("_end")  # the path of one member names the ancestors
    ended = distinct.select("_end").join(crown.select(F.col("node").alias("_end")), "_end", "left_semi")
    known = durable(crown.join(shape, "node").join(ended.select(F.col("_end").alias("node"), F.col("_end").alias("ends")), "node", "left")
                    .withColumn("_own", F.coalesce((F.col("n_convs") - 1) * F.col("_chars"), F.lit(0))))
    hanging = (grown.where("parent_conv_id is null").groupBy("parent").agg(
        F.count(F.lit(1)).alias("_kids"), F.sum("n_leaves").alias("_leaves"), F.sum("saved_tokens").alias("_saved")))
    inner = known.where("parent is not null").groupBy("parent").agg(F.count(F.lit(1)).alias("_inner"))
    local = (known.join(hanging.withColumnRenamed("parent", "node"), "node", "left").join(inner.withColumnRenamed("parent", "node"), "node", "left")
             .na.fill(0, ["_kids", "_leaves", "_saved", "_inner"]).withColumn("n_children", F.col("_kids") + F.col("_inner"))
             .withColumn("_leaves", F.col("_leaves") + (F.col("n_children") == 0).cast("long")))
    local = durable(local)
    upward = local.select(F.explode(F.slice("_path", F.lit(1), (F.col("depth") + 1).cast("int"))).alias("node"), "_leaves", (F.col("_saved") + F.col("_own")).alias("_all"))
    sums = upward.groupBy("node").agg(F.sum("_leaves").alias("n_leaves"), F.sum("_all").alias("saved_tokens"))
    names = crown.select(F.col("node").alias("parent"), F.col("conv_id").alias("_named"))
    tops = (local.select("node", "parent", "depth", "conv_id", "n_convs", "n_children", "ends").join(sums, "node")
            .join(names, "parent", "left").withColumnRenamed("_named", "parent_conv_id"))
    lower = (grown.join(names, "parent", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "_named")).drop("_named"))
    nodes = lower.unionByName(tops).join(_ends(paths), "ends", "left")
    none = hashlib.sha256(b"").hexdigest()
    return nodes.select("conv_id", "depth", "parent_conv_id", *[F.col(c).cast("long").alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
                        F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))
