from branchwise.session import scratch_path
from branchwise.sources import buckets

SCHEMA = "source_id string, msg_id string, n long"


def write(spark, path, version, threads, n, size=2):
    rows = [(t, f"{t}_{i}", n) for t in threads for i in range(size)]
    buckets.append(spark.createDataFrame(rows, SCHEMA), path, version, buckets=8)
    return rows


def test_newest_version_of_each_thread(spark):
    path = scratch_path(spark, "buckets")
    assert buckets.latest(spark, path) is None and buckets.latest_of(spark, path, ["a"]) is None
    state = {}
    for version, threads in enumerate([list("abcdefgh"), list("bc"), list("cxy")]):
        size = 3 - version  # a later version may have fewer rows of a thread, and none of the older ones stay
        for row in write(spark, path, version, threads, version, size):
            state.setdefault(row[0], {}).setdefault(version, []).append(row)
    want = sorted(r for v in state.values() for r in v[max(v)])
    assert sorted(map(tuple, buckets.latest(spark, path).collect())) == want
    few = buckets.latest_of(spark, path, ["b", "c", "none"], buckets=8)
    assert sorted(map(tuple, few.collect())) == [r for r in want if r[0] in "bc"]
    keys = spark.createDataFrame([("a",), ("x",), ("x",)], "source_id string")
    assert sorted(map(tuple, buckets.latest_of(spark, path, keys, buckets=8).collect())) == [r for r in want if r[0] in "ax"]
    assert buckets.latest_of(spark, path, ["none"], buckets=8).collect() == []
    write(spark, path, 1, list("bc"), 1, 2)  # a version written again replaces itself
    assert sorted(map(tuple, buckets.latest(spark, path).collect())) == want


def test_some_threads_are_read_through_their_buckets(spark):
    path = scratch_path(spark, "buckets")
    write(spark, path, 0, [f"t{i}" for i in range(200)], 0)
    write(spark, path, 1, ["t1", "t2"], 1)
    only_old = buckets.latest_of(spark, path, ["t7"], buckets=8)
    plan = only_old._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [(bucket" in plan or "PartitionFilters: [bucket" in plan
    assert "EqualTo(source_id,t7)" in plan or "In(source_id, [t7])" in plan
    assert len(only_old.inputFiles()) and all("version=000000000000" in f for f in only_old.inputFiles())  # the newer version has no row of it
    assert [r.n for r in buckets.latest_of(spark, path, ["t1"], buckets=8).collect()] == [1, 1]


def test_compaction(spark):
    path = scratch_path(spark, "buckets")
    for version in range(4):
        write(spark, path, version, [f"t{version}", "t"], version)
    before = sorted(map(tuple, buckets.latest(spark, path).collect()))
    assert not buckets.compact(spark, path, buckets=8, most=4)
    assert buckets.compact(spark, path, buckets=8, most=3)
    assert len(buckets.live_folders(spark, path)) == 1
    assert sorted(map(tuple, buckets.latest(spark, path).collect())) == before
    write(spark, path, 4, ["t"], 9)
    assert len(buckets.live_folders(spark, path)) == 2
    assert sorted(map(tuple, buckets.latest_of(spark, path, ["t", "t2"], buckets=8).collect())) == [("t", "t_0", 9), ("t", "t_1", 9), ("t2", "t2_0", 2), ("t2", "t2_1", 2)]


def test_versions_without_rows_and_rows_without_key(spark):
    path = scratch_path(spark, "buckets")
    write(spark, path, 0, [], 0)
    assert buckets.latest(spark, path) is None and buckets.latest_of(spark, path, ["a"], buckets=8) is None
    write(spark, path, 1, ["a", None], 1, 1)
    write(spark, path, 2, [], 2)
    assert [tuple(r) for r in buckets.latest(spark, path).collect()] == [("a", "a_0", 1)]
    assert buckets.latest_of(spark, path, [], buckets=8).collect() == []
