import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from branchwise.operators import agreement as ag, embed, lexicon as lx, merge
from branchwise.operators.normalise import normalise, value_ranges, value_ranges_in_order
from branchwise.plans import stance_features as sf
from tests.test_tree import SCHEMA, START

VECTORS = {"a": [1.0, 0.0, 2.0], "b": [0.0, 3.0, -1.0], "c": [0.5, 0.5, 0.5]}
MESSAGES = [("m1", ["a", "b", "a", "zz"]), ("m2", ["c"]), ("m3", ["zz"]), ("m4", [])]
from branchwise.session import durable


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.createDataFrame(list(VECTORS.items()), "token string, vector array<float>")


@pytest.fixture(scope="module")
def messages(spark):
    return spark.createDataFrame(MESSAGES, "msg_id string, tokens array<string>")


def known(tokens):
    return [np.array(VECTORS[t]) for t in tokens if t in VECTORS]


@pytest.mark.parametrize("limit", [embed.BROADCAST_BYTES, 0])
def test_message_vectors(spark, vectors, messages, limit):
    got = {r.msg_id: r for r in embed.message_vectors(messages, ["msg_id"], F.col("tokens"), vectors, 3, limit)
           .withColumn("avg", embed.average_vector(F.col("vsum"), F.col("n_tokens"), 3)).collect()}
    for msg, tokens in MESSAGES:
        r, k = got[msg], known(tokens)
        assert (r.n_tokens, r.n_known) == (len(tokens), len(k))
        assert (r.vsum is None) == (not k)
        want = sum(k) / len(tokens) if k else np.zeros(3)
        assert np.allclose(r.avg, want)


def test_token_matrix(spark, vectors, messages):
    got = {r.msg_id: r.matrix for r in embed.token_matrix(messages, ["msg_id"], F.col("tokens"), vectors).collect()}
    assert got["m1"] == [VECTORS["a"], VECTORS["b"], VECTORS["a"]] and got["m2"] == [VECTORS["c"]]
    assert got["m3"] == [] and got["m4"] is None


def test_set_cosine_is_cosine_of_means(spark, vectors):
    pairs = [(1, ["a", "b", "a"], ["c", "b"]), (2, ["a"], ["zz"]), (3, [], ["a"])]
    df = spark.createDataFrame(pairs, "id long, l array<string>, r array<string>")
    got = {r.id: r.similarity for r in embed.set_cosine(df, ["id"], F.col("l"), F.col("r"), vectors, 3).collect()}
    one, two = np.mean(known(pairs[0][1]), axis=0), np.mean(known(pairs[0][2]), axis=0)
    assert abs(got[1] - one @ two / np.linalg.norm(one) / np.linalg.norm(two)) < 1e-9
    assert got[2] == 0.0 and got[3] == 0.0


def test_nearest_words(spark, vectors):
    rows = embed.nearest_words(vectors, ["a", "nope"], 2).orderBy("word", "rank").collect()
    assert [(r.word, r["rank"], r.neighbour) for r in rows] == [("a", 1, "c"), ("a", 2, "b"), ("nope", 1, "nope")]
    assert rows[2].similarity == 1.0


def test_word_similarity_and_vocabulary(spark, vectors):
    pairs = spark.createDataFrame([("a", "b"), ("a", "zz")], "w1 string, w2 string")
    got = {(r.w1, r.w2): r.similarity for r in embed.word_similarity(pairs, vectors).collect()}
    a, b = np.array(VECTORS["a"]), np.array(VECTORS["b"])
    assert abs(got["a", "b"] - a @ b / np.linalg.norm(a) / np.linalg.norm(b)) < 1e-9 and got["a", "zz"] == 0.0
    flags = embed.in_vocabulary(spark.createDataFrame([("a",), ("q",)], "token string"), vectors)
    assert {r.token: r.known for r in flags.collect()} == {"a": True, "q": False}
    lengths = embed.unit(vectors).select(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x).alias("n")).collect()
    assert all(abs(r.n - 1) < 1e-9 for r in lengths)


def test_lexicon_sentiment_pos(spark):
    df = spark.createDataFrame([("x", ["ikke", "lort", "lort", "godt"]), ("y", ["godt"]), ("z", [])], "msg_id string, tokens array<string>")
    lex = spark.createDataFrame([("swear_count", "lort"), ("negation_count", "ikke"), ("swear_count", "lort")], "list string, word string")
    counts = lx.lexicon_counts(df, ["msg_id"], F.col("tokens"), lex, ["swear_count", "negation_count"])
    got = {r.msg_id: (r.swear_count, r.negation_count) for r in lx.attach_counts(df, counts, ["msg_id"], ["swear_count", "negation_count"]).collect()}
    assert got == {"x": (2, 1), "y": (0, 0), "z": (0, 0)}
    scores = spark.createDataFrame([("godt", 3), ("lort", -2)], "term string, score long")
    assert {r.msg_id: r.sentiment for r in lx.sentiment(df, ["msg_id"], F.col("tokens"), scores).collect()} == {"x": -1, "y": 3}
    tagger = spark.createDataFrame([("godt", "ADJ"), ("ikke", "ADV")], "token string, tag string")
    tags = {r.msg_id: r.tags for r in lx.pos_tag_lines(df, "msg_id", F.col("tokens"), tagger).collect()}
    assert tags == {"x": ["ADV", "X", "X", "ADJ"], "y": ["ADJ"]}
    slots = spark.createDataFrame([(["ADV", "X"],), (None,)], "t array<string>").select(lx.pos_occurrence(F.col("t")).alias("s")).collect()
    assert [i for i, v in enumerate(slots[0].s) if v] == [2, 16] and sum(slots[1].s) == 0


def test_ordered_ranges_equal_running_update(spark):
    rng = random.Random(3)
    for case in range(6):
        values = [rng.choice([0, 0, 1, 2, 5, -1 if case > 3 else 3]) for _ in range(rng.randrange(1, 12))]
        low = high = 0
        for x in values:
            high = max(high, x)
            low = x if x < low or low == 0 else low
        df = spark.createDataFrame(list(enumerate(values)), "seq long, x long")
        r = value_ranges_in_order(df, ["x"], F.col("seq")).head()
        assert (r.x_min, r.x_max) == (low, high), values


def test_normalise_rule(spark):
    df = spark.createDataFrame([(0, 4, None), (2, 4, 1.0), (6, 4, 3.0)], "a long, b long, c double")
    rows = normalise(df, value_ranges(df, ["a", "b", "c"]), ["a", "b", "c"]).collect()
    assert [tuple(r) for r in rows] == [(0.0, 4.0, 0.0), (2 / 6, 4.0, 0.0), (1.0, 4.0, 1.0)]


def test_sub_sampled_feature_table(spark):
    text = "created timestamp, sdqc string, sdqc_parent string, text string, tokens array<string>"
    rows = [("s", "s", None, True, START, "Commenting", None, "Kilde a", ["a"]),
            ("s", "x", "s", False, START, "Denying", "Commenting", "Nej! a b", ["nej", "a", "b"]),
            ("s", "y", "x", False, START, "Commenting", "Denying", "Ja c", ["ja", "c"]),
            ("s", "z", "s", False, START, "Commenting", "Commenting", "zz", ["zz"])]
    m = spark.createDataFrame(rows, SCHEMA.split(", created")[0] + ", " + text)
    members = sf.build_members(m, sub_sample=True)
    vectors = spark.createDataFrame(list(VECTORS.items()), "token string, vector array<float>")
    lex = spark.createDataFrame([("negation_count", "nej")], "list string, word string")
    f = sf.build_features(m, members, ["sdqc_parent", "text", "lexicon", "wembs", "token_wembs"], lexicon=lex, vectors=vectors, dim=3)
    got = {r.msg_id: r for r in f.collect()}
    assert set(got) == {"x", "y"}  # z is alone in an only-commenting branch
    assert (got["x"].stance, got["x"].sdqc_parent, got["x"].negation_count, got["x"].e_mark) == (1, 3, 1.0, 1)
    a, b, c = (np.array(VECTORS[t]) for t in "abc")
    cos = lambda p, q: p @ q / np.linalg.norm(p) / np.linalg.norm(q)
    assert abs(got["y"].sim_to_prev - cos(c, a + b)) < 1e-9 and abs(got["y"].sim_to_src - cos(c, a)) < 1e-9
    assert abs(got["x"].sim_to_branch - cos(a + b, a + b + c)) < 1e-9
    assert got["y"].comment_matrix == [VECTORS["c"]] and got["y"].source_matrix == [VECTORS["a"]]
    assert sf.on_branches(f, members).count() == 2
    with pytest.raises(ValueError):
        sf.build_features(m, members, ["nonsense"])


def test_agreement_and_integration(spark):
    rows = [(1, 1, 5), (1, 2, 5), (2, 1, 5), (2, 2, 6), (3, 7, 4), (4, 1, 1), (4, 1, 3), (4, 2, 3), (4, 2, 1)]
    df = spark.createDataFrame(rows, "item long, user long, label long")
    got = {r["item"]: (r.n_users, r.agree, r.labels) for r in ag.agreement(df, ["item"]).collect()}
    assert got == {1: (2, True, [5]), 2: (2, False, None), 3: (1, True, [4]), 4: (2, True, [1, 3])}
    agreed, disputed = ag.split_by_agreement(df, ["item"])
    assert agreed.count() == 3 and disputed.count() == 2
    m = spark.createDataFrame([("a", "old"), ("b", "old")], "msg_id string, sdqc string")
    labels = spark.createDataFrame([("a", 2, "late"), ("a", 1, "early"), ("c", 1, "none")], "msg_id string, item_id long, sdqc string")
    assert {tuple(r) for r in ag.integrate(m, labels, ["msg_id"], ["sdqc"]).collect()} == {("a", "early"), ("b", "old")}


def test_merge_keeps_repeats_inside_one_side(spark):
    a = spark.createDataFrame([("s", 1), ("s", 2)], "source_id string, v long")
    b = spark.createDataFrame([("s", 3), ("t", 4), ("t", 4)], "source_id string, v long")
    assert sorted(tuple(r) for r in merge.merge(a, b).collect()) == [("s", 1), ("s", 2), ("t", 4), ("t", 4)]
    assert sorted(tuple(r) for r in merge.upsert(a, b).collect()) == [("s", 3), ("t", 4), ("t", 4)]
    both = merge.union_corpora({"one": a, "two": b})
    assert {r.corpus: r["count"] for r in both.groupBy("corpus").count().collect()} == {"one": 2, "two": 3}


def test_word_lists_are_the_broadcast_side(spark):
    from branchwise.operators import lexicon as lx

    texts = spark.range(1000).select(F.col("id").alias("msg_id"), F.array(F.lit("ikke"), F.col("id").cast("string")).alias("tokens"))
    table = lx.list_terms(spark.createDataFrame([("negation_count", "ikke")], "list string, word string"), {"negation_count": "term"})
    sums = lx.term_sums(texts, ["msg_id"], {"term": F.col("tokens")}, table, ["negation_count"])
    plan = sums._jdf.queryExecution().executedPlan().toString()
    assert "BuildRight" in plan and "BuildLeft" not in plan and "hashpartitioning(term" not in plan
    assert sums.count() == 1000


def test_training_passes(spark, monkeypatch):
    from pyspark.ml import feature

    rng = random.Random(3)
    docs = spark.createDataFrame([([rng.choice("abcdef") for _ in range(12)],) for _ in range(60)], "words array<string>").coalesce(1)
    trained = lambda **kw: {r.token: list(r.vector) for r in embed.train_vectors(docs, "words", dim=4, partitions=1, **kw).collect()}
    assert trained() == trained(max_iter=5) != trained(max_iter=1)
    asked, plain = [], feature.Word2Vec.fit
    monkeypatch.setattr(feature.Word2Vec, "fit", lambda self, df: asked.append((self.getMaxIter(), self.getNumPartitions())) or plain(self, df))
    embed.train_vectors(docs, "words", dim=4, partitions=8)
    assert asked == [(8, 8)]


def test_planted_synonyms_are_nearest(spark):
    import random

    from branchwise.models import word_vectors

    rng = random.Random(2)
    topics = [[f"{t}{i}" for i in range(12)] for t in "abcd"]
    rows = [([*rng.choices(topics[k], k=6), rng.choice(("kat", "mis")) if k == 0 else rng.choice(("bil", "vogn")) if k == 1 else "andet", *rng.choices(topics[k], k=6)],)
            for _ in range(600) for k in [rng.randrange(4)]] + [(["ene"],), ([],)]
    docs = durable(spark.createDataFrame(rows, "words array<string>"))
    counts = {(r.a, r.b): r.n for r in word_vectors.cooccurrences(docs, "words", window=2, min_count=1).collect()}
    want = {}
    for (w,) in rows:
        for i in range(len(w)):
            for j in range(len(w)):
                if i != j and abs(i - j) <= 2:
                    want[w[i], w[j]] = want.get((w[i], w[j]), 0) + 1
    assert counts == want
    vectors = durable(word_vectors.train(docs, "words", dim=8))
    assert "ene" not in {r.token for r in vectors.collect()}
    found = {r.word: r.neighbour for r in embed.nearest_words(vectors, ["kat", "bil"], 1).collect()}
    assert found["kat"] in {"mis", *topics[0]} and found["bil"] in {"vogn", *topics[1]}
    similar = {(r.w1, r.w2): r.similarity for r in embed.word_similarity(spark.createDataFrame([("kat", "mis"), ("bil", "vogn"), ("kat", "bil")], "w1 string, w2 string"), vectors).collect()}
    assert similar["kat", "mis"] > 0.9 and similar["bil", "vogn"] > 0.9 and similar["kat", "bil"] < 0.3


def test_pairs_are_counted_before_they_are_passed_on(spark, monkeypatch):
    from branchwise.models import word_vectors

    monkeypatch.setattr(word_vectors, "MARKS", 1 << 15)  # among 3,000 words some share a mark
    rows = [(["så", f"w{i}", "så", "ja", f"w{i % 40}", None],) for i in range(3000)] + [([],), (None,)]
    docs = spark.createDataFrame(rows, "words array<string>").coalesce(1)
    often = {"så", "ja"} | {f"w{i}" for i in range(40)}
    want = {}
    for (w,) in rows:
        for i in range(len(w or [])):
            for j in range(len(w)):
                if i != j and abs(i - j) <= 3 and {w[i], w[j]} <= often:
                    want[w[i], w[j]] = want.get((w[i], w[j]), 0) + 1
    found = word_vectors.cooccurrences(docs, "words", window=3, min_count=5)
    assert {(r.a, r.b): r.n for r in found.collect()} == want
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and plan.count("Generate") == 1  # both orders at the end; no row per pair of places before
    information = word_vectors.positive_information(durable(found), keep=True).collect()
    assert {(r.a, r.b): r.n for r in information} == want and any(r.weight is None for r in information)


def test_pair_counts_take_bounded_steps(monkeypatch):
    """However long a batch or one list is, no step holds the pairs of more than a block, and cells add up to plain counts."""
    import random
    import zlib
    from collections import Counter
    from types import SimpleNamespace

    import numpy as np
    import pyarrow as pa

    from branchwise.models import word_vectors

    rng = random.Random(5)
    words = [f"ø{i}" for i in range(60)]
    often = set(words[:40])
    rows = [[rng.choice([*words, None]) for _ in range(n)] for n in (2000, 0, 1, 3, 700)] + [None]
    bits = np.zeros(word_vectors.MARKS // 8, np.uint8)
    for w in often:
        at = zlib.crc32(w.encode()) % word_vectors.MARKS
        bits[at >> 3] |= 1 << (at & 7)
    want = Counter()
    for r in rows[:-1]:
        for i, one in enumerate(r):
            for two in r[i + 1:i + 4]:
                if {one, two} <= often:
                    want[tuple(sorted((one, two)))] += 1
    for name, value in (("BLOCK", 50), ("PART", 60), ("MERGE", 100), ("ROWS", 7)):
        monkeypatch.setattr(word_vectors, name, value)
    batch = pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.string()))], ["words"])
    packed = list(word_vectors._pair_counter(SimpleNamespace(value=bits), 3, 5)(iter([batch, batch])))
    assert len(packed) > 100 and max(sum(b.column("size").to_pylist()) for b in packed) <= 50 * 3
    assert {c for b in packed for c in b.column("cell").to_pylist()} == set(range(15))
    found = list(word_vectors._cell_adder(iter(packed)))
    assert max(map(len, found)) <= 7
    counts = [(*sorted((r["a"], r["b"])), r["n"]) for b in found for r in b.to_pylist()]
    assert len(counts) == len(want) and {(a, b): n for a, b, n in counts} == {k: 2 * n for k, n in want.items()}


def test_training_counts_pairs_once(spark, monkeypatch):
    from branchwise.models import word_vectors

    docs = spark.createDataFrame([(["a", "b", "a", "c"],)] * 6, "words array<string>")
    plans = []

    def seen(weights, *rest):
        plans.append(weights._jdf.queryExecution().optimizedPlan().toString())
        assert {tuple(r) for r in weights.select("a", "b").collect()} == {(r.a, r.b) for r in word_vectors.positive_information(word_vectors.cooccurrences(docs, "words")).collect()}
        return spark.createDataFrame([], "token string, vector array<double>")

    monkeypatch.setattr(word_vectors, "factorise", seen)
    word_vectors.train(docs, "words", dim=2)
    assert len(plans) == 1 and "MapInArrow" not in plans[0]  # read from the stored table, which the words' sums came from too


def test_factors_are_the_leading_eigenvectors(spark):
    import numpy as np

    from branchwise.models import word_vectors

    rng = np.random.default_rng(1)
    base = rng.standard_normal((30, 3))
    matrix = base @ base.T
    rows = [(f"w{i}", f"w{j}", float(matrix[i, j])) for i in range(30) for j in range(30)]
    got = {r.token: r.vector for r in word_vectors.factorise(spark.createDataFrame(rows, "a string, b string, weight double"), 5).collect()}
    x = np.array([got[f"w{i}"] for i in range(30)])
    assert np.allclose(x @ x.T, matrix, atol=1e-6)  # of rank three: five directions hold all of it


def test_approximate_neighbours_find_nine_of_ten(spark):
    import numpy as np

    from branchwise.operators import neighbours

    rng = np.random.default_rng(3)
    centres = rng.standard_normal((60, 24))
    x = centres[rng.integers(0, 60, 3000)] + 0.6 * rng.standard_normal((3000, 24))
    rows = durable(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "token long, vector array<double>"))
    found = {}
    for r in neighbours.approximate_neighbours(rows, rows.where("token % 50 = 0"), 10).collect():
        found.setdefault(r.word, {})[r.rank] = r.neighbour
    y = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for q in range(0, 3000, 50):
        near = np.argsort(-(y @ y[q]), kind="stable")
        hits += len(set(near[near != q][:10].tolist()) & set(found[q].values()))
    assert hits >= 0.9 * 600


def test_neighbours_pass_on_the_best_of_each_table(spark):
    import numpy as np

    from branchwise.operators import neighbours

    x = np.random.default_rng(5).standard_normal((400, 8))
    rows = durable(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "token long, vector array<double>"))
    found = neighbours.approximate_neighbours(rows, rows.where("token % 50 = 0"), 5, bucket=400)  # two buckets, both looked up: exact
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan and plan.count("SortMergeJoin") == 1  # vectors meet once, none is joined to pairs
    y = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {q: [int(i) for i in np.argsort(-(y @ y[q]), kind="stable") if i != q][:5] for q in range(0, 400, 50)}
    got = {}
    for r in sorted(found.collect(), key=lambda r: r["rank"]):
        got.setdefault(r.word, []).append(r.neighbour)
    assert got == want


def test_matrices_are_not_shuffled(spark, vectors):
    rows = spark.createDataFrame([("x", 7, ["a", "nope", "c", "a"], ["b"]), ("y", None, [], None), ("z", 1, ["nope"], ["c", None])],
                                 "msg_id string, n int, own array<string>, other array<string>")
    known = {r.token: list(r.vector) for r in vectors.collect()}
    want = {"x": (7, [known["a"], known["c"], known["a"]], [known["b"]]), "y": (None, None, None), "z": (1, None, [known["c"]])}
    for limit, exchanges in ((1 << 20, 1), (0, None)):
        found = embed.token_matrices(rows, ["msg_id"], {"mine": "own", "theirs": "other"}, vectors, limit)
        assert {r.msg_id: (r.n, r.mine, r.theirs) for r in found.collect()} == want
        if exchanges:  # the rows before they have vectors
            assert found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1].count("Exchange hashpartitioning") == exchanges
