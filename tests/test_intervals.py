import pytest
from pyspark.sql import functions as F

from branchwise.operators import intervals as iv
from tests.test_tree import make, random_forest


def plain(rows):
    """{(source, message): (depth, enter, leave)} by a walk, and the pairs (top, message) of every subtree."""
    children, out, pairs = {}, {}, set()
    for s, m, p, t, _ in rows:
        if p is not None:
            children.setdefault((s, p), []).append((t, m))
    for s, m, p, _, _ in rows:
        if p is not None:
            continue
        at, stack = 0, [(m, 0, ())]
        order = []
        while stack:
            node, depth, above = stack.pop()
            order.append((node, depth))
            out[s, node] = [depth, at, at]
            at += 1
            for top in (*above, node):
                pairs.add((s, top, node))
                out[s, top][2] = at
            for _, c in sorted(children.get((s, node), []), reverse=True):
                stack.append((c, depth + 1, (*above, node)))
    return {k: tuple(v) for k, v in out.items()}, pairs


@pytest.mark.parametrize("seed,max_group", [(1, 1_000_000), (2, 3)])
def test_intervals_sums_and_members_equal_a_walk(spark, seed, max_group):
    rows = random_forest(seed)
    messages = make(spark, rows)
    want, pairs = plain(rows)
    labels = iv.intervals(messages, max_group=max_group)
    assert {(r.source_id, r.msg_id): (r.depth, r.enter, r.leave) for r in labels.collect()} == want
    stance = {(s, m): label for s, m, _, _, label in rows}
    denied = iv.sums_below(labels.join(messages.select("source_id", "msg_id", "sdqc"), ["source_id", "msg_id"]),
                           (F.col("sdqc") == "Denying").cast("long"), "n", max_group)
    expected = {k: 0 for k in want}
    for s, top, m in pairs:
        expected[s, top] += stance[s, m] == "Denying"
    assert {(r.source_id, r.msg_id): r.n for r in denied.collect()} == expected
    below = iv.members_below(labels, messages.select("source_id", "msg_id")).collect()
    assert len(below) == len(pairs) and {(r.source_id, r.top_id, r.msg_id) for r in below} == pairs
    assert all(r.distance == want[r.source_id, r.msg_id][0] - want[r.source_id, r.top_id][0] for r in below)
    a, b = labels.alias("a"), labels.alias("b")
    tested = a.join(b, (F.col("a.source_id") == F.col("b.source_id")) & iv.is_below("a", "b")).select("a.source_id", "b.msg_id", F.col("a.msg_id").alias("m"))
    assert {tuple(r) for r in tested.collect()} == pairs


def test_intervals_of_odd_threads(spark):
    rows = [("a", "a", None, 0, "x"), ("a", "a1", "a", 1, "x"), ("a", "a2", "gone", 2, "x"), ("b", "b", None, 0, "x"),
            ("c", "c", None, 0, "x"), ("c", "c1", "c2", 1, "x"), ("c", "c2", "c1", 1, "x")]
    labels = iv.intervals(make(spark, rows))
    assert sorted(tuple(r) for r in labels.collect()) == [("a", "a", 0, 0, 2), ("a", "a1", 1, 1, 2), ("b", "b", 0, 0, 1), ("c", "c", 0, 0, 1)]
    empty = iv.intervals(make(spark, []))
    assert empty.collect() == [] and iv.members_below(empty, empty).collect() == [] and iv.sums_below(empty, F.lit(1), "n").collect() == []


def test_long_chain(spark):
    n = 500
    rows = [("s", "m0", None, 0, "x")] + [("s", f"m{i}", f"m{i - 1}", i % 1000, "x") for i in range(1, n)]
    messages = make(spark, [(("m0"), m, p, t, x) for _, m, p, t, x in rows])
    labels = iv.intervals(messages)
    assert labels.where((F.col("enter") != F.col("depth")) | (F.col("leave") != n)).count() == 0 and labels.count() == n
    top = messages.where("msg_id = 'm10'").select("source_id", "msg_id")
    assert iv.members_below(labels, top).agg(F.count(F.lit(1)), F.sum("distance")).first()[:] == (n - 10, sum(range(n - 10)))
