"""Conversation trees as relations: roots, branches, members, neighbours.

A branch is the path from a direct reply of the source down to a leaf; the source itself is not a
member. No operator here builds a path array. Ancestors are found by pointer doubling, so a tree
of depth d needs about log2(d) joins, and the members of all branches are expanded with work in
proportion to their number.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from branchwise.operators.skew import prefix_sum, MAX_GROUP
from branchwise.session import durable, durable_counting

COMBINE = {
    "min": lambda a, b: F.least(a, b),
    "max": lambda a, b: F.greatest(a, b),
    "sum": lambda a, b: a + b,
}


@dataclass
class Lifted:
    """Result of pointer doubling.

    ``placed``: one row per node with ``depth``, ``is_leaf``, path folds and, if asked for, its ``top``
    (the last node before the stop).
    ``jumps[k]``: node -> its 2^k-th ancestor. ``unplaced``: nodes that hang on a missing parent
    (``orphan``) or on a circle of replies (``cycle``).
    """

    placed: DataFrame
    jumps: list[DataFrame]
    unplaced: DataFrame


def lift(nodes: DataFrame, folds: Mapping[str, str] | None = None, top: bool = False) -> Lifted:
    """Follow ``parent`` pointers to the top for every node at once.

    ``nodes`` has scope, node, parent (NULL at a top node) and one column per fold. A fold
    (``min``, ``max`` or ``sum``) accumulates its column along the path from the top to the node,
    which gives a path-wide value without a window and without listing the path.
    """
    folds = dict(folds or {})
    tops = ["top"] if top else []
    parents = (nodes.where("parent is not null").select("scope", F.col("parent").alias("node"))
               .distinct().withColumn("_answered", F.lit(True)))
    open_end = F.col("up").isNotNull()
    base, left = durable_counting(nodes.join(parents, ["scope", "node"], "left").select(
        "scope", "node", F.col("parent").alias("up"), *[F.col("node").alias(c) for c in tops],
        F.lit(1).cast("long").alias("depth"), F.lit(False).alias("orphan"),
        F.col("_answered").isNull().alias("is_leaf"), *folds), open_end)
    finished = [base.where(~open_end)]
    active = base.where(open_end)
    jumps: list[DataFrame] = []
    while left:
        jumps.append(active.select("scope", "node", "up"))
        seen = active
        for part in finished:
            seen = seen.unionByName(part)
        # Nobody points at a leaf, so the looked-up side is the inner nodes only.
        seen = seen.where("not is_leaf").select(
            F.col("scope").alias("_scope"), F.col("node").alias("_node"),
            *[F.col(c).alias("_" + c) for c in ("up", *tops, "depth", "orphan")],
            *[F.col(c).alias("_fold_" + c) for c in folds])
        found = F.col("_node").isNotNull()
        step, now = durable_counting(
            active.join(seen, (F.col("scope") == F.col("_scope")) & (F.col("up") == F.col("_node")), "left")
            .select(
                "scope", "node", F.col("_up").alias("up"),
                *[F.when(found, F.col("_" + c)).otherwise(F.col(c)).alias(c) for c in tops],
                F.when(found, F.col("depth") + F.col("_depth")).otherwise(F.col("depth")).alias("depth"),
                F.when(found, F.col("_orphan")).otherwise(F.lit(True)).alias("orphan"), "is_leaf",
                *[F.when(found, COMBINE[how](F.col(c), F.col("_fold_" + c))).otherwise(F.col(c)).alias(c)
                  for c, how in folds.items()]), open_end)
        finished.append(step.where(~open_end))
        active = step.where(open_end)
        if now == left:
            break  # every round places the next depths, so what no longer shrinks is circular
        left = now
    placed = finished[0]
    for part in finished[1:]:
        placed = placed.unionByName(part)
    unplaced = (placed.where("orphan").select("scope", "node", F.lit("orphan").alias("reason"))
                .unionByName(active.select("scope", "node", F.lit("cycle").alias("reason"))))
    return Lifted(placed.where("not orphan").drop("up", "orphan"), jumps, unplaced)


def reply_nodes(messages: DataFrame, extra: Mapping[str, Column] | None = None) -> DataFrame:
    """Non-source messages as ``lift`` input: a direct reply to the source is a top node.

    A reply without any parent pointer hangs on nothing and so becomes an orphan.
    """
    inner = ~F.col("parent_id").eqNullSafe(F.col("source_id"))
    return (messages.where("not is_source")
            .select(F.col("source_id").alias("scope"), F.col("msg_id").alias("node"),
                    F.when(inner, F.coalesce("parent_id", F.lit(""))).alias("parent"),
                    *[c.alias(n) for n, c in (extra or {}).items()]))


def expand(leaves: DataFrame, jumps: list[DataFrame], carry: list[str]) -> DataFrame:
    """All (leaf, ancestor-or-self) pairs from leaf rows with scope, node.

    Taking the jump tables from the longest to the shortest, every row either stays or also jumps;
    each distance has exactly one binary form, so each pair appears exactly once.
    """
    rows = leaves.select("scope", F.col("node").alias("leaf"), "node",
                         F.lit(0).cast("long").alias("dist"), *carry)
    for k in reversed(range(len(jumps))):
        jump = jumps[k].select(F.col("scope").alias("_s"), F.col("node").alias("_n"), F.col("up").alias("_up"))
        stay = F.struct(F.col("node").alias("node"), F.col("dist").alias("dist"))
        hop = F.struct(F.col("_up").alias("node"), (F.col("dist") + F.lit(1 << k)).alias("dist"))
        rows = (rows.join(jump, (F.col("scope") == F.col("_s")) & (F.col("node") == F.col("_n")), "left")
                .select("scope", "leaf", *carry,
                        F.inline(F.when(F.col("_up").isNull(), F.array(stay)).otherwise(F.array(stay, hop)))))
    return rows


def branches(messages: DataFrame, folds: Mapping[str, tuple[str, Column]] | None = None) -> DataFrame:
    """One row per branch: source_id, leaf_id, branch_len and the path folds; no expansion."""
    folds = folds or {}
    lifted = lift(reply_nodes(messages, {n: c for n, (_, c) in folds.items()}), {n: how for n, (how, _) in folds.items()})
    return (lifted.placed.where("is_leaf")
            .select(F.col("scope").alias("source_id"), F.col("node").alias("leaf_id"),
                    F.col("depth").alias("branch_len"), *folds))


def branch_members(messages: DataFrame, folds: Mapping[str, tuple[str, Column]] | None = None,
                   keep: Column | None = None, index: bool = False, order: list[str] | None = None,
                   max_group: int = MAX_GROUP) -> DataFrame:
    """Long form of all branches: source_id, leaf_id, pos, branch_len, msg_id (+ path folds).

    ``keep`` filters whole branches by their folds before they are expanded. ``index`` adds
    ``branch_idx``, the place of the branch in depth-first order of its thread, children ordered by
    ``order`` (default: ``sibling_order``); it needs no expansion, so ``keep`` saves the members of all other branches.
    """
    folds = folds or {}
    lifted = lift(reply_nodes(messages, {n: c for n, (_, c) in folds.items()}), {n: how for n, (how, _) in folds.items()})
    leaves = lifted.placed.where("is_leaf").withColumnRenamed("depth", "branch_len")
    carry = ["branch_len", *folds]
    kept = leaves.where(keep) if keep is not None else leaves
    if index:
        place = leaf_places(messages, lifted, order, max_group)
        kept = kept.join(place, ["scope", "node"])
        carry.append("branch_idx")
    rows = expand(kept, lifted.jumps, carry)
    return (rows.select(F.col("scope").alias("source_id"), F.col("leaf").alias("leaf_id"),
                    *(["branch_idx"] if index else []),
                    (F.col("branch_len") - 1 - F.col("dist")).alias("pos"), "branch_len",
                    F.col("node").alias("msg_id"), *folds))


def sibling_order(messages: DataFrame) -> list[str]:
    """Children in the order of their file where the reader kept it, else by arrival; then by id."""
    return (["ord"] if "ord" in messages.columns else []) + ["created", "msg_id"]


def totals_below(lifted: Lifted, value: Column, name: str) -> DataFrame:
    """Sum of ``value`` over every node and all nodes under it: scope, node, ``name``, by doubling the depth looked at.

    After round k a node has the values of nodes less than 2^k below it; each node then adds its own sum to that of
    its 2^k-th ancestor. Work is the number of nodes per round, whatever the length of their paths. Every second round is written.
    """
    sums = lifted.placed.select("scope", "node", value.alias(name))
    for k, jump in enumerate(lifted.jumps, 1):
        more = (jump.join(sums, ["scope", "node"]).groupBy("scope", F.col("up").alias("node"))
                .agg(F.sum(name).alias("_more")))
        sums = sums.join(more, ["scope", "node"], "left").select(
            "scope", "node", (F.col(name) + F.coalesce("_more", F.lit(0))).alias(name))
        if k % 2 == 0 or k == len(lifted.jumps):
            sums = durable(sums)
    return sums


def leaf_counts(lifted: Lifted) -> DataFrame:
    """Leaves under every node (itself included): scope, node, n_leaves."""
    return totals_below(lifted, F.col("is_leaf").cast("long"), "n_leaves")


def leaf_places(messages: DataFrame, lifted: Lifted, order: list[str] | None = None, max_group: int = MAX_GROUP) -> DataFrame:
    """Depth-first place ``branch_idx`` of each leaf: leaves under earlier siblings, added up along its path while lifting."""
    order = order or sibling_order(messages)
    nodes = reply_nodes(messages, {"parent_id": F.col("parent_id"), **{f"_o{i}": F.col(c) for i, c in enumerate(order)}})
    siblings = durable(nodes.join(leaf_counts(lifted), ["scope", "node"]))
    before = prefix_sum(siblings, ["scope", "parent_id"], [F.col(f"_o{i}") for i in range(len(order))],
                        F.col("n_leaves"), "branch_idx", max_group).select("scope", "node", "parent", F.col("branch_idx").cast("long").alias("branch_idx"))
    return lift(before, {"branch_idx": "sum"}).placed.where("is_leaf").select("scope", "node", "branch_idx")


def indexed_branches(messages: DataFrame, order: list[str] | None = None, max_group: int = MAX_GROUP) -> DataFrame:
    """source_id, leaf_id, branch_idx, branch_len of every branch, without listing members."""
    lifted = lift(reply_nodes(messages))
    leaves = lifted.placed.where("is_leaf").select("scope", "node", F.col("depth").alias("branch_len"))
    return leaves.join(leaf_places(messages, lifted, order, max_group), ["scope", "node"]).select(
        F.col("scope").alias("source_id"), F.col("node").alias("leaf_id"), "branch_idx", "branch_len")


def unplaced(messages: DataFrame) -> DataFrame:
    """Replies that reach no source: ``orphan`` (missing parent) or ``cycle``."""
    return (lift(reply_nodes(messages)).unplaced
            .select(F.col("scope").alias("source_id"), F.col("node").alias("msg_id"), "reason"))


def roots(edges: DataFrame) -> DataFrame:
    """Topmost known message for each (msg_id, parent_id) row, without a known thread id.

    ``root_id`` is the id the chain of replies ends in; ``complete`` tells whether that message is
    itself in the table. Circular replies are left out.
    """
    base = durable(edges.select(F.lit(0).alias("scope"), F.col("msg_id").alias("node"),
                                F.col("parent_id").alias("parent")))
    lifted = lift(base, top=True)
    whole = lifted.placed.select(F.col("node").alias("msg_id"), F.col("top").alias("root_id"),
                                 (F.col("depth") - 1).alias("depth"), F.lit(True).alias("complete"))
    lost = lifted.unplaced.where("reason = 'orphan'").select(F.col("node").alias("msg_id"))
    if not lost.take(1):
        return whole
    # Treat each missing parent as a known top node and lift once more.
    missing = (base.where("parent is not null").select("scope", F.col("parent").alias("node")).distinct()
               .join(base, ["scope", "node"], "left_anti")
               .withColumn("parent", F.lit(None).cast("string")))
    again = lift(base.unionByName(missing.select(*base.columns)), top=True).placed
    partial = (again.select(F.col("node").alias("msg_id"), F.col("top").alias("root_id"),
                            (F.col("depth") - 1).alias("depth"), F.lit(False).alias("complete"))
               .join(lost, "msg_id", "left_semi"))
    return whole.unionByName(partial)


def thread_of(messages: DataFrame, edges_roots: DataFrame, msg_ids: DataFrame) -> DataFrame:
    """Whole thread (root and all descendants) of each given message id."""
    wanted = msg_ids.join(edges_roots, "msg_id").select("root_id").distinct()
    members = edges_roots.join(wanted, "root_id", "left_semi").select("msg_id", "root_id")
    return messages.join(members, "msg_id")


def distinct_roots(edges_roots: DataFrame, msg_ids: DataFrame) -> DataFrame:
    """Replace each message by its root, without repeats."""
    return msg_ids.join(edges_roots, "msg_id").select("root_id").distinct()


def children(messages: DataFrame, order: list[str] | None = None, max_group: int = MAX_GROUP) -> DataFrame:
    """Adjacency in arrival order, one row per reply: parent_id, ord, child_id.

    Long form on purpose: a message with very many replies never becomes one array.
    """
    order = order or sibling_order(messages)
    replies = durable(messages.where("not is_source").select("source_id", "parent_id", "msg_id",
                                                            *[c for c in order if c != "msg_id"]))
    ranked = prefix_sum(replies, ["source_id", "parent_id"], [F.col(c) for c in order],
                        F.lit(1).cast("long"), "ord", max_group)
    return ranked.select("source_id", "parent_id", "ord", F.col("msg_id").alias("child_id"))


def reply_counts(messages: DataFrame) -> DataFrame:
    """Replies per thread (all levels), threads without replies included."""
    return (messages.groupBy("source_id")
            .agg(F.sum(F.when(F.col("is_source"), 0).otherwise(1)).alias("replies")))


def previous_and_source(members: DataFrame, messages: DataFrame) -> DataFrame:
    """Each member with the message before it in its branch, which is its parent; the source comes before the first."""
    parents = messages.where("not is_source").select("source_id", "msg_id", F.col("parent_id").alias("prev_id"))
    return members.join(parents, ["source_id", "msg_id"])


def first_occurrence(members: DataFrame, order: list[str]) -> DataFrame:
    """One row per msg_id: the member that comes first by ``order`` (combinable, no window)."""
    rest = [c for c in members.columns if c not in order and c != "msg_id"]
    best = F.min(F.struct(*order, *rest)).alias("_b")
    return members.groupBy("msg_id").agg(best).select("msg_id", "_b.*")


def direct_replies(messages: DataFrame) -> DataFrame:
    """Sources with their first-level replies only."""
    return messages.where(F.col("is_source") | (F.col("parent_id") == F.col("source_id")))


def source_reply_pairs(messages: DataFrame) -> DataFrame:
    """Every non-source message beside its source: source_id, source_text, msg_id, text."""
    source = messages.where("is_source").select("source_id", F.col("text").alias("source_text"))
    return (messages.where("not is_source").select("source_id", "msg_id", "text")
            .join(source, "source_id"))


def length_bucket(length: Column) -> Column:
    """Branch-length class: 1, 2, 3, 4-5, 6-7, 8-9, 10 and more, named by its lower end."""
    return (F.when(length <= 3, length).when(length <= 5, 4).when(length <= 7, 6)
            .when(length <= 9, 8).otherwise(10))


def select_threads(messages: DataFrame, min_replies: int = 0, lang: str | None = None,
                   hashtag: str | None = None, near: tuple[float, float, float] | None = None,
                   drop_retweets: bool = False) -> DataFrame:
    """Threads whose source passes the given tests; all their messages are kept.

    ``near`` is (latitude, longitude, kilometres) against columns lat and lon.
    """
    source = messages.where("is_source")
    if lang is not None:
        source = source.where(F.col("lang") == lang)
    if hashtag is not None:
        source = source.where(F.array_contains(F.transform("hashtags", F.lower), hashtag.lower().lstrip("#")))
    if near is not None:
        source = source.where(haversine_km(F.col("lat"), F.col("lon"), F.lit(near[0]), F.lit(near[1])) <= near[2])
    if drop_retweets:
        source = source.where(~F.col("is_retweet"))
    chosen = source.select("source_id")
    if min_replies:
        busy = reply_counts(messages).where(F.col("replies") >= min_replies).select("source_id")
        chosen = chosen.join(busy, "source_id", "left_semi")
    return messages.join(chosen, "source_id", "left_semi")


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2)
    a = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    return 2 * 6371.0 * F.asin(F.sqrt(F.least(a, F.lit(1.0))))
