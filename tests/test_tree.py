import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from branchwise.operators import tree
from branchwise.operators.skew import prefix_sum, rank_by_bucket, rank_rows
from branchwise.session import durable

SCHEMA = "source_id string, msg_id string, parent_id string, is_source boolean, created timestamp, sdqc string"
START = datetime(2024, 1, 1)


def make(spark, rows):
    """rows of (source, msg, parent, minute, label)"""
    return spark.createDataFrame(
        [(s, m, p, p is None, START + timedelta(minutes=t), label) for s, m, p, t, label in rows], SCHEMA)


def random_forest(seed, threads=6, size=40):
    rng, rows = random.Random(seed), []
    for s in range(threads):
        source = f"s{s}"
        rows.append((source, source, None, 0, "Commenting"))
        known = [source]
        for i in range(rng.randrange(size)):
            parent = rng.choice(known[-5:] if s % 2 else known)
            msg = f"s{s}m{i}"
            rows.append((source, msg, parent, rng.randrange(30), rng.choice(["Commenting", "Denying", "Underspecified"])))
            known.append(msg)
    rng.shuffle(rows)
    return rows


def walk(rows):
    """Branches by depth-first search: {(source, index): [messages]}."""
    children, out = {}, {}
    for s, m, p, t, _ in rows:
        if p is not None:
            children.setdefault((s, p), []).append((t, m))
    for s, m, p, _, _ in rows:
        if p is None:
            index, stack = 0, [[c] for _, c in sorted(children.get((s, s), []), reverse=True)]
            while stack:
                path = stack.pop()
                below = sorted(children.get((s, path[-1]), []), reverse=True)
                if below:
                    stack += [path + [c] for _, c in below]
                else:
                    out[s, index] = path
                    index += 1
    return out


@pytest.mark.parametrize("seed,max_group", [(1, 1_000_000), (2, 2), (3, 1)])
def test_members_equal_depth_first_search(spark, seed, max_group):
    rows = random_forest(seed)
    got = {}
    for r in tree.branch_members(make(spark, rows), index=True, max_group=max_group).collect():
        got.setdefault((r.source_id, r.branch_idx), {})[r.pos] = (r.msg_id, r.branch_len, r.leaf_id)
    want = walk(rows)
    assert set(got) == set(want)
    for key, path in want.items():
        assert [got[key][i][0] for i in range(len(path))] == path
        assert all(v[1] == len(path) and v[2] == path[-1] for v in got[key].values())


def test_long_chain_and_wide_level(spark):
    rows = [("s", "s", None, 0, "Commenting")]
    rows += [("s", f"c{i:03d}", f"c{i - 1:03d}" if i else "s", i, "Commenting") for i in range(70)]
    rows += [("s", f"w{i:03d}", "c010", 100 + i, "Commenting") for i in range(300)]
    branches = tree.branches(make(spark, rows)).groupBy("branch_len").count().collect()
    assert {r["branch_len"]: r["count"] for r in branches} == {70: 1, 12: 300}
    members = tree.branch_members(make(spark, rows))
    assert members.count() == 70 + 300 * 12
    assert members.groupBy("leaf_id", "pos").count().where("count > 1").count() == 0


def test_path_folds(spark):
    rows = random_forest(5)
    folds = {"early": ("min", F.col("created")), "late": ("max", F.col("created")), "n": ("sum", (F.col("sdqc") == "Denying").cast("long"))}
    got = {(r.source_id, r.leaf_id): r for r in tree.branches(make(spark, rows), folds).collect()}
    facts = {m: (START + timedelta(minutes=t), label) for _, m, _, t, label in rows}
    want = walk(rows)
    assert len(got) == len(want)
    for (source, _), path in want.items():
        r = got[source, path[-1]]
        times = [facts[m][0] for m in path]
        assert (r.early, r.late, r.n) == (min(times), max(times), sum(facts[m][1] == "Denying" for m in path))


def test_orphans_and_cycles_are_set_aside(spark):
    rows = [("s", "s", None, 0, "x"), ("s", "a", "s", 1, "x"), ("s", "b", "gone", 1, "x"), ("s", "c", "b", 1, "x"),
            ("s", "d", "e", 1, "x"), ("s", "e", "d", 1, "x"), ("s", "f", "e", 1, "x"), ("t", "t", None, 0, "x")]
    m = make(spark, rows)
    assert {(r.msg_id, r.reason) for r in tree.unplaced(m).collect()} == {
        ("b", "orphan"), ("c", "orphan"), ("d", "cycle"), ("e", "cycle"), ("f", "cycle")}
    assert [(r.source_id, r.leaf_id) for r in tree.branches(m).collect()] == [("s", "a")]


def test_same_id_in_two_threads(spark):
    rows = [("s", "s", None, 0, "x"), ("s", "a", "s", 1, "x"), ("s", "b", "a", 2, "x"),
            ("t", "t", None, 0, "x"), ("t", "a", "t", 1, "x")]
    members = tree.branch_members(make(spark, rows), index=True)
    assert {(r.source_id, r.leaf_id, r.pos, r.msg_id) for r in members.collect()} == {
        ("s", "b", 0, "a"), ("s", "b", 1, "b"), ("t", "a", 0, "a")}
    first = tree.first_occurrence(members.select("source_id", "branch_idx", "pos", "msg_id"), ["source_id", "branch_idx", "pos"])
    assert {(r.msg_id, r.source_id) for r in first.collect()} == {("a", "s"), ("b", "s")}


def test_roots_of_unknown_threads(spark):
    edges = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("x", "lost"), ("y", "x"), ("p", "q"), ("q", "p")],
                                  "msg_id string, parent_id string")
    got = {r.msg_id: (r.root_id, r.depth, r.complete) for r in tree.roots(edges).collect()}
    assert got == {"a": ("a", 0, True), "b": ("a", 1, True), "c": ("a", 2, True), "x": ("lost", 1, False), "y": ("lost", 2, False)}


def test_previous_children_and_direct_replies(spark):
    rows = [("s", "s", None, 0, "x"), ("s", "a", "s", 5, "x"), ("s", "b", "s", 2, "x"), ("s", "c", "a", 9, "x")]
    m = make(spark, rows)
    prev = tree.previous_and_source(tree.branch_members(m), m)
    assert {(r.msg_id, r.prev_id) for r in prev.collect()} == {("a", "s"), ("b", "s"), ("c", "a")}
    for limit in (100, 1):
        kids = tree.children(m, max_group=limit)
        assert {(r.parent_id, r.ord, r.child_id) for r in kids.collect()} == {("s", 0, "b"), ("s", 1, "a"), ("a", 0, "c")}
    assert {r.msg_id for r in tree.direct_replies(m).collect()} == {"s", "a", "b"}


def test_thread_selection(spark):
    schema = "source_id string, msg_id string, parent_id string, is_source boolean, lang string, hashtags array<string>, lat double, lon double, is_retweet boolean"
    rows = [("s", "s", None, True, "da", ["ChangeMyMind"], 56.0, 10.4, False), ("s", "a", "s", False, "da", [], None, None, False),
            ("t", "t", None, True, "en", ["other"], 40.0, -74.0, True)]
    m = spark.createDataFrame(rows, schema)
    near = (56.013377, 10.362431, 200.0)
    assert {r.source_id for r in tree.select_threads(m, near=near).collect()} == {"s"}
    assert {r.source_id for r in tree.select_threads(m, lang="en").collect()} == {"t"}
    assert {r.source_id for r in tree.select_threads(m, hashtag="#changemymind", drop_retweets=True, min_replies=1).collect()} == {"s"}
    assert tree.select_threads(m, min_replies=2).count() == 0


def test_prefix_sum_paths_agree(spark):
    rng = random.Random(7)
    rows = [("hot" if i % 3 else f"k{i % 11}", rng.randrange(50), i, rng.randrange(5)) for i in range(600)]
    df = durable(spark.createDataFrame(rows, "k string, t long, id long, v long"))
    order = [F.desc("t"), F.col("id")]
    plain = prefix_sum(df, ["k"], order, F.col("v"), "p")
    ranged = prefix_sum(df, ["k"], order, F.col("v"), "p", max_group=20)
    assert plain.exceptAll(ranged).count() == 0 and ranged.exceptAll(plain).count() == 0
    whole = {r.id: r.rn for r in rank_rows(df, [], order, "rn").collect()}
    assert [whole[i] for _, _, i, _ in sorted(rows, key=lambda r: (-r[1], r[2]))] == list(range(600))


def test_rank_by_bucket_with_missing_key(spark):
    rows = [(None if i % 4 == 0 else "a", i) for i in range(40)]
    df = spark.createDataFrame(rows, "k string, id long")
    got = {(r.k, r.id): r.rn for r in rank_by_bucket(df, ["k"], (F.col("id") / 10).cast("int"), [F.col("id")], "rn").collect()}
    assert [got[None, i] for i in range(0, 40, 4)] == list(range(10))
    assert [got["a", i] for i in range(40) if i % 4] == list(range(30))
