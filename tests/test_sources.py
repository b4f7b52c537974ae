import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from branchwise.operators import sequences as sq, tree
from branchwise.session import durable
from branchwise.plans import run
from branchwise.sources import reddit, sinks, store, tables, threads, tweets
from branchwise.sources.read import annotation_data, read_messages


def comment(cid, parent, text, label, minute):
    return {"comment": {"comment_id": cid, "parent_id": parent, "text": text, "created": f"2019-01-01T10:{minute:02d}:00",
                        "submission_id": "sub", "SDQC_Submission": label, "SDQC_Parent": "Commenting", "is_deleted": False, "upvotes": 3}}


@pytest.fixture
def reddit_dir(tmp_path):
    a, b, c = comment("a", "sub", "Nej!\nse www.x.dk/1", "Denying", 1), comment("b", "a", "hvad?", "Querying", 2), comment("c", "a", "ok", "Commenting", 3)
    document = {"redditSubmission": {"submission_id": "sub", "title": "Påstand om jord", "text": "", "created": "2019-01-01T10:00:00",
                                     "IsRumour": True, "TruthStatus": "False", "SourceSDQC": "Underspecified", "num_comments": 3},
                "branches": [[a, b], [a, c]]}
    (tmp_path / "event1").mkdir()
    (tmp_path / "event1" / "sub.json").write_text(json.dumps(document), encoding="utf-8")
    return str(tmp_path)


def test_reddit(spark, reddit_dir):
    m = durable(read_messages(spark, reddit_dir, "reddit"))
    rows = {r.msg_id: r for r in m.collect()}
    assert set(rows) == {"sub", "a", "b", "c"}
    source = rows["sub"]
    assert (source.text, source.tokens, source.sdqc, source.truth, source.event) == ("Påstand om jord", ["påstand", "om", "jord"], "Commenting", "False", "event1")
    assert rows["a"].text == "Nej!se urlurlurl" and rows["a"].created == datetime(2019, 1, 1, 10, 1)
    members = reddit.members(spark, reddit_dir)
    assert {(r.branch_idx, r.pos, r.msg_id, r.leaf_id, r.branch_len) for r in members.collect()} == {
        (0, 0, "a", "b", 2), (0, 1, "b", "b", 2), (1, 0, "a", "c", 2), (1, 1, "c", "c", 2)}
    derived = tree.branch_members(m, index=True).select("branch_idx", "pos", "msg_id")
    assert derived.exceptAll(members.select("branch_idx", "pos", "msg_id")).count() == 0
    seqs = {r.leaf_id: r for r in sq.from_messages(m, skip_first=True).collect()}
    assert set(seqs) == {"c"} and [o.stance for o in seqs["c"].obs] == [1, 3] and seqs["c"].veracity == 0


def tweet(tid, parent, text, children, label="Underspecified", minute=0):
    return {"id_str": tid, "full_text": text, "created_at": f"Wed Aug 27 13:{minute:02d}:00 +0000 2008", "children": children, "lang": "da",
            "in_reply_to_status_id": int(parent) if parent else None, "in_reply_to_status_id_str": parent,
            "SDQC_Submission": label, "SDQC_Parent": "Underspecified", "SourceSDQC": "Supporting", "TruthStatus": "True"}


def test_tweets(spark, tmp_path):
    thread = {"1": tweet("1", None, "kilde\n", ["3", "2"]), "2": tweet("2", "1", "ja @bo nu", [], "Supporting", 1),
              "3": tweet("3", "1", "nej", ["4"], "Denying", 2), "4": tweet("4", "3", "hm", [], minute=3)}
    (tmp_path / "t.txt").write_text("1\t" + json.dumps(thread) + "\n", encoding="utf-8")
    m = durable(tweets.messages(spark, str(tmp_path / "t.txt")))
    rows = {r.msg_id: r for r in m.collect()}
    assert rows["1"].sdqc == "Supporting" and rows["1"].truth == "True" and rows["1"].is_source and rows["1"].text == "kilde"
    assert rows["2"].text == "ja refrefref nu" and rows["4"].parent_id == "3" and rows["4"].sdqc == "Underspecified"
    members = tree.branch_members(m, index=True, order=["ord", "msg_id"])
    assert {(r.branch_idx, r.pos, r.msg_id) for r in members.collect()} == {(0, 0, "3"), (0, 1, "4"), (1, 0, "2")}
    labelled = {r.leaf_id: [o.stance for o in r.obs] for r in sq.from_messages(m).collect()}
    assert labelled == {"4": [1], "2": [0]}
    assert annotation_data(m, "claim").count() == 1
    assert annotation_data(m, "stance").where("msg_id = '3'").head().text == "Source: kilde\n\nReply: nej"
    with pytest.raises(ValueError):
        read_messages(spark, str(tmp_path), "fax")


@pytest.fixture
def threads_dir(tmp_path):
    base = tmp_path / "threads" / "en" / "rumour1" / "10"
    for folder in ("source-tweets", "reactions"):
        (base / folder).mkdir(parents=True)
    put = lambda folder, t: (base / folder / f"{t['id_str']}.json").write_text(json.dumps(t, indent=1))
    put("source-tweets", tweet("10", None, "claim", []))
    for t in (tweet("11", "10", "yes", [], minute=1), tweet("12", "11", "no", [], minute=2), tweet("13", "10", "why", [], minute=3)):
        put("reactions", t)
    (base / "structure.json").write_text(json.dumps({"10": {"11": {"12": []}, "13": []}}))
    (base / "annotation.json").write_text(json.dumps({"is_rumour": "rumour", "misinformation": "1"}))
    (tmp_path / "annotations").mkdir()
    lines = ["# Source Tweets", json.dumps({"tweetid": "10", "support": "supporting"}), "# Direct Replies",
             json.dumps({"tweetid": "11", "responsetype-vs-source": "agreed"}), "# Deep Replies",
             json.dumps({"tweetid": "12", "responsetype-vs-source": "disagreed"})]
    (tmp_path / "annotations" / "en-scheme.json").write_text("\n".join(lines))
    (tmp_path / "rumour_overview.txt").write_text("IDs\tVeracity\n10\t2\n")
    return str(tmp_path)


@pytest.mark.parametrize("edges", ["structure", "replies"])
def test_thread_folders(spark, threads_dir, edges):
    m = durable(threads.messages(spark, threads_dir, edges=edges))
    rows = {r.msg_id: r for r in m.collect()}
    assert {k: (r.parent_id, r.sdqc) for k, r in rows.items()} == {
        "10": (None, "Underspecified"), "11": ("10", "Supporting"), "12": ("11", "Denying"), "13": ("10", "Underspecified")}
    assert rows["10"].truth == "Unverified" and rows["11"].event == "rumour1"
    seqs = {r.leaf_id: ([o.stance for o in r.obs], r.veracity) for r in sq.from_messages(m).collect()}
    assert seqs == {"12": ([0, 1], 2)}


def test_a_deep_chain_of_replies_is_one_walk(spark, tmp_path):
    for name, text in (("a", '{"a": ' + "".join(f'{{"a{i}": ' for i in range(10_000)) + "[]" + "}" * 10_001),
                       ("b", '{"b": {"b \\"{x": [], "b1": {"b2": [] , "b3": []}}}')):
        (tmp_path / "threads" / "en" / "e" / name).mkdir(parents=True)
        (tmp_path / "threads" / "en" / "e" / name / "structure.json").write_text(text)
    rows = [tuple(r) for r in threads.structure_edges(spark, str(tmp_path)).collect()]
    assert sorted(r[1:] for r in rows if r[0] == "b") == [("b", 'b "{x'), ("b", "b1"), ("b1", "b2"), ("b1", "b3")]
    assert {r[1:] for r in rows if r[0] == "a"} == {("a", "a0"), *[(f"a{i}", f"a{i + 1}") for i in range(9_999)]} and len(rows) == 10_004


def test_last_stance_line_counts(spark, threads_dir, tmp_path):
    more = [{"tweetid": "11", "responsetype-vs-source": "disagreed"}, {"tweetid": "11", "responsetype-vs-source": "comment"}]
    with open(tmp_path / "annotations" / "en-scheme.json", "a") as f:
        f.write("\n" + "\n".join(map(json.dumps, more)))
    got = {r.msg_id: r.sdqc for r in threads.stance_annotations(spark, threads_dir).collect()}
    assert got == {"11": "Commenting", "12": "Denying"}


def test_unreadable_threads_are_reported(spark, tmp_path):
    (tmp_path / "t.txt").write_text("7\tnot json\n1\t" + json.dumps({"1": tweet("1", None, "x", [])}) + "\n")
    with pytest.raises(ValueError, match="7"):
        tweets.messages(spark, str(tmp_path / "t.txt")).count()
    assert tweets.messages(spark, str(tmp_path / "t.txt"), strict=False).count() == 1
    (tmp_path / "e").mkdir()
    (tmp_path / "e" / "x.json").write_text("{}")
    with pytest.raises(ValueError, match="x.json"):
        reddit.messages(spark, str(tmp_path))
    assert reddit.messages(spark, str(tmp_path), strict=False).count() == 0


def test_a_reply_listed_twice_has_one_parent(spark, tmp_path):
    thread = {"1": tweet("1", None, "x", ["2", "3"]), "2": tweet("2", "1", "x", ["9", "4"]), "3": tweet("3", "1", "x", ["4"]), "4": tweet("4", "2", "x", []),
              "9": tweet("9", "2", "RT @a x", [])}
    thread["1"]["entities"] = {"hashtags": [{"text": "Jord"}]}
    thread["1"]["coordinates"] = {"coordinates": [10.2, 56.1]}
    (tmp_path / "t.txt").write_text("1\t" + json.dumps(thread) + "\n")
    m = durable(tweets.messages(spark, str(tmp_path / "t.txt")))
    rows = {r.msg_id: r for r in m.collect()}
    assert m.count() == 5 and rows["4"].parent_id == "3"  # first in the list of 3, second in that of 2
    assert rows["9"].is_retweet and not rows["4"].is_retweet
    for options, n in (({"hashtag": "#jord"}, 5), ({"hashtag": "sol"}, 0), ({"near": (56.2, 10.2, 200.0)}, 5), ({"near": (50.0, 10.2, 200.0)}, 0),
                       ({"drop_retweets": True}, 5), ({"lang": "da"}, 5), ({"lang": "en"}, 0), ({"min_replies": 4}, 5), ({"min_replies": 5}, 0)):
        assert tree.select_threads(m, **options).count() == n


def test_reddit_branches_keep_the_order_of_the_file(spark, tmp_path):
    late, early, deep = comment("z", "sub", "x", "Denying", 9), comment("a", "sub", "x", "Querying", 1), comment("m", "z", "x", "Supporting", 12)
    more = comment("b", "z", "x", "Commenting", 11)
    document = {"redditSubmission": {"submission_id": "sub", "title": "t", "text": "t", "created": "2019-01-01T10:00:00", "TruthStatus": "True"},
                "branches": [[late, deep], [late, more], [early]]}
    (tmp_path / "e").mkdir()
    (tmp_path / "e" / "sub.json").write_text(json.dumps(document))
    m = durable(reddit.messages(spark, str(tmp_path)))
    want = {(r.branch_idx, r.leaf_id) for r in reddit.members(spark, str(tmp_path)).collect()}
    assert {(r.branch_idx, r.leaf_id) for r in tree.indexed_branches(m).collect()} == want == {(0, "m"), (1, "b"), (2, "a")}
    assert {r.leaf_id for r in sq.from_messages(m, skip_first=True).collect()} == {"b", "a"}


def test_claim_overview(spark, threads_dir, tmp_path):
    overview = threads.veracity_overview(spark, threads_dir)
    assert [tuple(r) for r in overview.collect()] == [("10", 0)]
    sinks.claim_overview(overview, str(tmp_path / "out"))
    assert [tuple(r) for r in threads.claim_overview(spark, str(tmp_path / "out")).collect()] == [("10", 0)]
    m = spark.createDataFrame([("10", True, None), ("99", True, None)], "source_id string, is_source boolean, truth string")
    with pytest.raises(ValueError, match="99"):
        threads.attach_claims(m, overview)
    assert {r.source_id: r.truth for r in threads.attach_claims(m, overview, strict=False).collect()} == {"10": "False", "99": None}


def test_sequence_text_round_trip(spark, tmp_path):
    (tmp_path / "in.csv").write_text("TruthStatus\tSDQC_Labels\n2\t[[3], [0]]\n1\t[[1]]\n")
    rows = tables.sequences(spark, str(tmp_path / "in.csv")).orderBy("veracity").collect()
    assert [(r.veracity, [(o.stance, o.t) for o in r.obs]) for r in rows] == [(1, [(1, None)]), (2, [(3, None), (0, None)])]
    seqs = spark.createDataFrame([(1, 0, [(3, 0.0), (0, 0.25)])], "veracity int, part int, obs array<struct<stance:int,t:double>>")
    sinks.sequence_table(seqs, str(tmp_path / "ts"), timestamps=True, fmt="tsv")
    assert [(o.stance, o.t) for o in tables.sequences(spark, str(tmp_path / "ts")).head().obs] == [(3, 0.0), (0, 0.25)]
    parts = spark.createDataFrame([("l", 1, 1, [(1, 0.5)]), ("l", 1, 0, [(3, 0.0), (0, 0.25)]), ("k", 1, 0, [(2, 0.0)])],
                                  "leaf_id string, veracity int, part int, obs array<struct<stance:int,t:double>>")
    sinks.sequence_table(parts, str(tmp_path / "parts"), timestamps=True, fmt="tsv")
    back = tables.sequences(spark, str(tmp_path / "parts")).collect()
    assert sorted([(o.stance, o.t) for o in r.obs] for r in back) == [[(2, 0.0)], [(3, 0.0), (0, 0.25), (1, 0.5)]]


def test_word_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("Lort\n fanden \n\nlort\n", encoding="utf-8")
    (tmp_path / "b.txt").write_text("damn\n")
    (tmp_path / "v.txt").write_text("2 3\nhej 0.1 0.2 0.3\ndu 1 2 3\n")
    a, b = str(tmp_path / "a.txt"), str(tmp_path / "b.txt")
    assert {r.word for r in tables.word_list(spark, a, b).collect()} == {"lort", "fanden", "damn"}
    assert tables.lexicon(spark, {"swear_count": [a, b], "other": [b]}).count() == 4
    vectors = {r.token: list(r.vector) for r in tables.word_vectors(spark, str(tmp_path / "v.txt"), "text").collect()}
    assert vectors["du"] == [1.0, 2.0, 3.0] and set(vectors) == {"hej", "du"}
    assert tables.sentences(spark, a).count() == 3 and tables.line_count(spark, a) == 4


def test_metric_and_epoch_files(spark, tmp_path):
    row = [("m", "true", "false", "threads", "gaussian", 2, .5, .25, .25, .125, 1.0), ("m_majority", "true", "false", "threads", "gaussian", 2, .1, .1, .1, .1, .1)]
    cols = ["model", "unverified_cast", "remove_commenting", "testdata_type", "model_type", "comp_count", "f1_macro", "f1_micro", "accuracy", "precision", "recall"]
    path = str(tmp_path / "metrics")
    df = spark.createDataFrame(row, cols)
    sinks.metric_rows(df, path)
    sinks.metric_rows(df, path, timestamps=True)
    assert sorted(r.model for r in tables.metrics(spark, path).collect()) == ["m", "m_majority", "m_ts"]
    (tmp_path / "e.csv").write_text("epochs,LSTMLayers,LSTMDims,ReLULayers,ReLUDims,totalAcc,f1_macro,f1_micro,S,D;Q;C\n1,3,200,1,50,0.7,0.3,0.7,0,0,0,1\n")
    first = tables.epochs(spark, str(tmp_path / "e.csv")).head()
    assert (first.epoch, first.lstm_dims, first.f1_macro, first.acc_c) == (1, 200, 0.3, 1.0)


def test_store_versions(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = lambda *r: spark.createDataFrame(list(r), "source_id string, v long")
    assert store.latest(spark, path) is None
    store.append(rows(("s", 1), ("s", 1), ("t", 1)), path, 1)
    store.append(rows(("s", 2), ("u", 2)), path, 2)
    (tmp_path / "store" / "version=000000000003").mkdir()  # a write that never finished
    want = [("s", 2), ("t", 1), ("u", 2)]
    assert sorted(tuple(r) for r in store.latest(spark, path).select("source_id", "v").collect()) == want
    store.compact(spark, path, str(tmp_path / "small"))
    assert sorted(tuple(r) for r in store.latest(spark, str(tmp_path / "small")).select("source_id", "v").collect()) == want


def test_label_export(spark, tmp_path):
    (tmp_path / "l.json").write_text('{"id": 1, "text": "x", "annotations": [{"user": 1, "label": 5}, {"user": 2, "label": 6}]}\n')
    rows = tables.label_export(spark, str(tmp_path / "l.json")).collect()
    assert {(r.item_id, r.user, r.label) for r in rows} == {(1, 1, 5), (1, 2, 6)}


def test_whole_jobs(spark, reddit_dir, tmp_path):
    features, members = run.stance_table(spark, reddit_dir, "reddit", ["text", "sdqc_parent"], out=str(tmp_path / "f"), out_format="tsv")
    assert members.count() == 4 and {r.msg_id for r in features.collect()} == {"a", "b", "c"}
    assert "id\tsdqc_submission" in next((tmp_path / "f").glob("*.csv")).read_text()
    seqs = run.claim_table(spark, reddit_dir, "reddit", timestamps=False, rumours_only=True, out=str(tmp_path / "s"), out_format="tsv")
    assert seqs.count() == 2
    assert sorted([o.stance for o in r.obs] for r in tables.sequences(spark, str(tmp_path / "s")).collect()) == [[1, 2], [1, 3]]


def test_small_files_are_listed_and_read_in_tasks(spark, tmp_path):
    from branchwise.sources import files, threads

    rows = [(f"t {i}/annotation.json", '{"true": "1"}') for i in range(30)] + [("t 0/reactions/é.json", "{}"), ("t 1/structure.json", "﻿å")]
    files.write_texts(spark.createDataFrame(rows, "path string, value string"), f"{tmp_path}/threads/en/all")
    (tmp_path / "threads/en/all/t 2/.hidden.json").write_text("no")
    found = {r.path[len(str(tmp_path)):]: r.value for r in files.texts(spark, f"{tmp_path}/threads", "*/*/*/*.json").collect()}
    assert found == {f"/threads/en/all/{p}": v.lstrip("﻿") for p, v in rows if "é" not in p}
    overview = threads.veracity_overview(spark, str(tmp_path))
    assert not any("annotation.json" in name for name in overview.inputFiles())  # no list of them on the driver
    assert {r.source_id for r in overview.collect()} == {f"t {i}" for i in range(30)}
