"""Threads as intervals: every message with the place where a depth-first walk enters and leaves it.

The messages below a message are those of its thread whose ``enter`` lies in its interval, so a part of a thread and the ancestor
test are comparisons of numbers, with no path and no expansion of branches. The places come from two pointer doublings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from branchwise.operators.skew import MAX_GROUP, prefix_sum
from branchwise.operators.tree import lift, reply_nodes, sibling_order, totals_below
from branchwise.session import durable

ID = ["source_id", "msg_id"]


def intervals(messages: DataFrame, order: list[str] | None = None, max_group: int = MAX_GROUP) -> DataFrame:
    """source_id, msg_id, depth, enter, leave (exclusive) of every message that reaches its source.

    The source has depth and ``enter`` 0; siblings follow ``order`` (default: ``sibling_order``). A message is entered after its parent and
    after all of its earlier siblings' messages, which is a sum along its path. Orphans and circles get no row.
    """
    order = order or sibling_order(messages)
    lifted = lift(reply_nodes(messages))
    sized = totals_below(lifted, F.lit(1).cast("long"), "n_below")
    nodes = reply_nodes(messages, {"parent_id": F.col("parent_id"), **{f"_o{i}": F.col(c) for i, c in enumerate(order)}})
    siblings = durable(nodes.join(sized, ["scope", "node"]))
    before = prefix_sum(siblings, ["scope", "parent_id"], [F.col(f"_o{i}") for i in range(len(order))], F.col("n_below"), "enter", max_group)
    entered = lift(before.select("scope", "node", "parent", (F.col("enter") + 1).cast("long").alias("enter")), {"enter": "sum"}).placed
    replies = entered.join(sized, ["scope", "node"]).select(
        F.col("scope").alias("source_id"), F.col("node").alias("msg_id"), "depth", "enter", (F.col("enter") + F.col("n_below")).alias("leave"))
    known = sized.groupBy(F.col("scope").alias("source_id")).agg(F.count(F.lit(1)).alias("_n"))
    sources = messages.where("is_source").select("source_id", "msg_id").join(known, "source_id", "left").select(
        "source_id", "msg_id", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("enter"),
        (F.coalesce("_n", F.lit(0)) + 1).alias("leave"))
    return sources.unionByName(replies)


def is_below(message: str, top: str) -> Column:
    """Ancestor test for two rows with intervals in one thread (``message`` and ``top`` are frame aliases); a message is below itself."""
    return (F.col(f"{message}.enter") >= F.col(f"{top}.enter")) & (F.col(f"{message}.enter") < F.col(f"{top}.leave"))


def sums_below(labels: DataFrame, value: Column, name: str, max_group: int = MAX_GROUP) -> DataFrame:
    """``labels`` (rows of ``intervals`` and other columns) with the sum of ``value`` over each message and all below it.

    A running sum along the walk, looked up where the message is entered and where it is left: one join, whatever the depth.
    """
    columns = labels.columns
    valued = labels.select("source_id", "enter", "leave", value.cast("long").alias("_value"))
    ends = valued.groupBy("source_id").agg(F.max("leave").alias("enter")).select(
        "source_id", "enter", F.lit(None).cast("long").alias("leave"), F.lit(0).cast("long").alias("_value"))
    running = durable(prefix_sum(durable(valued.unionByName(ends)), ["source_id"], [F.col("enter")], F.coalesce("_value", F.lit(0)), "_before", max_group)
                      .select("source_id", "enter", "leave", F.col("_before").cast("long").alias("_before")))
    until = running.select("source_id", F.col("enter").alias("leave"), F.col("_before").alias("_until"))
    sums = (running.where("leave is not null").join(until, ["source_id", "leave"])
            .select("source_id", "enter", (F.col("_until") - F.col("_before")).alias(name)))
    return labels.join(sums, ["source_id", "enter"]).select(*columns, name)


def members_below(labels: DataFrame, tops: DataFrame) -> DataFrame:
    """top_id, source_id, msg_id and distance of every message below (or equal to) each of ``tops`` (source_id, msg_id).

    An interval is cut into aligned blocks of 2^k places, two a level at most, and a message lies in one block of each level. So the
    range condition becomes an equality that gives each pair once and no others: a thread with many tops never meets itself as a whole.
    """
    wide = F.col("leave") - F.col("enter")
    wanted = durable(labels.join(tops.select(*ID).distinct(), ID, "left_semi")
                     .select("source_id", F.col("msg_id").alias("top_id"), "enter", "leave", F.col("depth").alias("top_depth"),
                             F.floor(F.log2(wide)).cast("int").alias("levels")))
    levels = wanted.agg(F.max("levels")).first()[0]
    size = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("level"))
    low, high = F.ceil(F.col("enter") / size).cast("long"), F.floor(F.col("leave") / size).cast("long")
    # the left block of a level if it has no left neighbour in its pair, the right one if it has no right neighbour
    ends = F.array(F.when((F.col("low") < F.col("high")) & (F.col("low") % 2 == 1), F.col("low")),
                   F.when((F.col("low") < F.col("high")) & (F.col("high") % 2 == 1), F.col("high") - 1))
    blocks = (wanted.withColumn("level", F.explode(F.sequence(F.lit(0), F.col("levels"))))
              .select("source_id", "top_id", "top_depth", "level", low.alias("low"), high.alias("high"))
              .select("source_id", "top_id", "top_depth", "level", F.explode(F.array_compact(ends)).alias("block")))
    inside = labels.select("source_id", "msg_id", "depth", "enter", F.explode(F.sequence(F.lit(0), F.lit(levels or 0))).alias("level"))
    placed = inside.select("source_id", "msg_id", "depth", "level", F.call_function("shiftright", F.col("enter"), F.col("level")).alias("block"))
    return placed.join(blocks, ["source_id", "level", "block"]).select(
        "top_id", "source_id", "msg_id", (F.col("depth") - F.col("top_depth")).alias("distance"))
