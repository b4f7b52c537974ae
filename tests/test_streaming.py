from datetime import datetime, timedelta

from pyspark.sql import functions as F

from branchwise.streaming import activity, quiet, threads
from tests.test_tree import SCHEMA, START, make


def test_late_replies_reopen_a_thread(spark, tmp_path):
    base = str(tmp_path)
    schema = make(spark, [("s", "s", None, 0, "x")]).schema

    def arrive(rows):
        make(spark, rows).write.mode("append").parquet(f"{base}/in")
        stream = activity.file_stream(spark, f"{base}/in", schema, "parquet")
        threads.run(stream, f"{base}/store", f"{base}/out", f"{base}/ckpt").awaitTermination()
        return {(r.source_id, r.leaf_id, r.branch_len) for r in threads.latest(spark, f"{base}/out").collect()}

    assert arrive([("s", "s", None, 0, "x"), ("s", "a", "s", 1, "x"), ("t", "t", None, 0, "x"), ("t", "q", "t", 1, "x")]) == {
        ("s", "a", 1), ("t", "q", 1)}
    # A reply, a message seen before, and a reply whose parent comes later.
    assert arrive([("s", "b", "a", 2, "x"), ("s", "a", "s", 1, "x"), ("s", "d", "c", 4, "x")]) == {("s", "b", 2), ("t", "q", 1)}
    assert arrive([("s", "c", "s", 3, "x")]) == {("s", "b", 2), ("s", "d", 2), ("t", "q", 1)}


def test_quiet_threads_are_handed_on_and_late_replies_open_them_again(spark, tmp_path):
    base = str(tmp_path)

    def arrive(day, rows):
        make(spark, rows).withColumn("arrived", F.lit(START + timedelta(days=day))).write.mode("append").parquet(f"{base}/in")
        stream = activity.file_stream(spark, f"{base}/in", spark.read.parquet(f"{base}/in").schema, "parquet")
        quiet.run(stream, "arrived", 6 * 3600, f"{base}/store", f"{base}/out", f"{base}/ckpt", splits=2, buckets=4).awaitTermination()
        got = threads.latest(spark, f"{base}/out")
        return got and {(r.source_id, r.leaf_id, r.branch_len) for r in got.collect()}

    assert arrive(1, [("s", "s", None, 0, "x"), ("s", "a", "s", 1, "x")]) is None  # nothing has been quiet yet
    assert arrive(2, [("t", "t", None, 0, "x"), ("t", "q", "t", 1, "x")]) == {("s", "a", 1)}
    assert arrive(3, [("s", "b", "a", 2, "x")]) == {("s", "a", 1), ("t", "q", 1)}
    assert arrive(9, [("clock", "c", None, 0, "x")]) == {("s", "b", 2), ("t", "q", 1)}


def test_the_newest_message_wins(spark, tmp_path):
    base = str(tmp_path)
    first = make(spark, [("s", "s", None, 0, "x"), ("s", "a", "s", 1, "Denying"), ("s", "b", "a", 2, "x")])
    second = make(spark, [("s", "b", "s", 2, "x"), ("s", "a", "s", 1, "Supporting")])
    labels = lambda m: m.where("not is_source").select("source_id", "msg_id", "parent_id", "sdqc")
    for i, batch in enumerate((first, second)):
        threads.update_threads(batch, i, f"{base}/store", f"{base}/out", buckets=4)
        threads.update_threads(batch, i, f"{base}/store2", f"{base}/labels", labels, buckets=4)
    assert {(r.leaf_id, r.branch_len) for r in threads.latest(spark, f"{base}/out").collect()} == {("a", 1), ("b", 1)}
    want = {("a", "s", "Supporting"), ("b", "s", "x")}
    assert {(r.msg_id, r.parent_id, r.sdqc) for r in threads.latest(spark, f"{base}/labels").collect()} == want
    threads.compact(spark, f"{base}/store2", f"{base}/store3", buckets=4)
    threads.update_threads(make(spark, [("s", "c", "b", 3, "x")]), 2, f"{base}/store3", f"{base}/labels", labels, buckets=4)
    assert {(r.msg_id, r.parent_id, r.sdqc) for r in threads.latest(spark, f"{base}/labels").collect()} == want | {("c", "b", "x")}
    assert {r.batch for r in spark.read.option("basePath", f"{base}/store3").parquet(f"{base}/store3").select("batch").distinct().collect()} == {1, 2}


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    base = str(tmp_path)
    batch = make(spark, [("s", "s", None, 0, "x"), ("s", "a", "s", 1, "x")])
    for _ in range(2):
        threads.update_threads(batch, 0, f"{base}/store", f"{base}/out")
    assert threads.latest(spark, f"{base}/out").count() == 1


def test_repeats_and_windows(spark, tmp_path):
    base = str(tmp_path)
    rows = [("s", f"m{i % 4}", "s", False, START + timedelta(minutes=i % 4), "x") for i in range(8)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{base}/in")
    schema = spark.createDataFrame(rows, SCHEMA).schema
    stream = activity.file_stream(spark, f"{base}/in", schema, "parquet")
    once = activity.without_repeats(stream, "created", ["msg_id"], "1 hour")
    threads.upsert_sink(once, f"{base}/once", f"{base}/c1", mode="append").awaitTermination()
    assert spark.read.parquet(f"{base}/once").count() == 4
    counts = activity.activity(activity.file_stream(spark, f"{base}/in", schema, "parquet"), "created", ["source_id"], "2 minutes", delay="1 hour")
    threads.upsert_sink(counts, f"{base}/counts", f"{base}/c2").awaitTermination()
    got = {r.window_start: r.n for r in threads.latest_rows(spark, f"{base}/counts", ["window_start", "source_id"]).collect()}
    assert got == {datetime(2024, 1, 1): 4, datetime(2024, 1, 1, 0, 2): 4}
    bursts = activity.sessions(spark.createDataFrame(rows, SCHEMA), "created", ["source_id"], "90 seconds").collect()
    assert len(bursts) == 1 and bursts[0].n == 8


def test_live_claims(spark, tmp_path):
    from branchwise.plans import run
    from pyspark.sql import functions as F
    from tests.test_models import DISCRETE

    base = str(tmp_path)
    rows = make(spark, [("s", "s", None, 0, "Commenting"), ("s", "a", "s", 1, "Supporting"), ("s", "b", "a", 2, "Supporting"),
                        ("s", "c", "s", 3, "Underspecified")])
    rows = rows.withColumn("truth", F.lit(None).cast("string")).withColumn("text", F.col("msg_id"))
    rows.write.parquet(f"{base}/in")
    stream = activity.file_stream(spark, f"{base}/in", rows.schema, "parquet")
    run.live_claims(stream, base, DISCRETE).awaitTermination()
    got = [(r.leaf_id, r.veracity, r.claim) for r in threads.latest(spark, f"{base}/claims").collect()]
    assert got == [("b", "False", "s")]  # the branch of c has no labelled member
