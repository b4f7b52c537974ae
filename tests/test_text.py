from pyspark.sql import functions as F

from branchwise.functions import labels as lb, text as tx, times


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "text string").select(expr(F.col("text")).alias("x")).head()["x"]


def test_masks(spark):
    assert one(spark, "se https://t.co/ab @bo nu", tx.mask_tweet) == "se urlurlurl /ab refrefref nu"
    assert one(spark, "sidst @bo", tx.mask_tweet) == "sidst @bo"
    assert one(spark, "a\nb @x y", tx.mask_tweet) == "ab refrefref y"
    assert one(spark, ">sagt før\nsvar www.a.dk/b?c=1 ok", tx.mask_reddit) == "refrefrefsvar urlurlurl ok"
    assert one(spark, ">sagt før\nsvar", lambda c: tx.mask_reddit(c, quotes=False)) == ">sagt førsvar"
    assert one(spark, "a\nb", lambda c: tx.strip_newlines(c, " ")) == "a b"


def test_tokens(spark):
    assert one(spark, "Æble, o'hara ÉN 3-4 ...!", tx.word_tokens) == ["æble", "o'hara", "én", "3-4"]
    assert one(spark, "Æble ÉN øl über 2x", tx.reddit_tokens) == ["æble", "øl", "2x"]
    assert one(spark, "Hej, du!", tx.tweet_tokens) == ["hej", ",", "du", "!"]
    assert one(spark, "", tx.word_tokens) == [] and one(spark, " ,. ", tx.word_tokens) == []
    assert one(spark, " a\t b c ", tx.words) == ["a", "b", "c"]


def features(spark, text):
    df = spark.createDataFrame([(text,)], "text string").withColumn("tokens", tx.word_tokens(F.col("text")))
    f = {**tx.flags(F.col("text")), **tx.counts(F.col("text"), F.col("tokens"))}
    return df.select(*[c.alias(n) for n, c in f.items()]).head().asDict()


def test_text_features(spark):
    f = features(spark, "HVAD?! Nej... urlurlurl ABCD ÆØÅ..... refrefref")
    assert (f["period"], f["e_mark"], f["q_mark"], f["has_trip_dot"]) == (1, 1, 1, 1)
    assert (f["trip_dot_count"], f["q_mark_count"], f["e_mark_count"], f["cap_count"]) == (2, 1, 1, 12)
    assert (f["cap_sequence_max_len"], f["url_count"], f["quote_count"], f["tokens_len"]) == (4, 1, 1, 6)
    assert abs(f["avg_word_len"] - (4 + 3 + 9 + 4 + 3 + 9) / 6) < 1e-12
    assert features(spark, "ja hvem der")["q_mark"] == 1 and features(spark, "ja Hvem der")["q_mark"] == 0
    empty = features(spark, "")
    assert empty["txt_len"] == 0 and empty["tokens_len"] is None and empty["cap_sequence_max_len"] == 0


def test_times(spark):
    row = spark.createDataFrame([("Wed Aug 27 13:08:45 +0200 2008", "2019-03-01T10:20:30", "junk")], "a string, b string, c string").select(
        times.tweet_time(F.col("a")).alias("a"), times.reddit_time(F.col("b")).alias("b"), times.tweet_time(F.col("c")).alias("c")).head()
    assert row.a.isoformat() == "2008-08-27T13:08:45" and row.b.isoformat() == "2019-03-01T10:20:30" and row.c is None


def test_codes(spark):
    df = spark.createDataFrame([("Supporting",), ("Commenting",), ("Underspecified",), (None,)], "s string")
    got = df.select(lb.stance_code(F.col("s")).alias("c"), lb.is_commenting(F.col("s")).alias("k"), lb.source_stance(F.col("s")).alias("d")).collect()
    assert [tuple(r) for r in got] == [(0, False, "Supporting"), (3, True, "Commenting"), (None, False, "Commenting"), (None, False, None)]
    casts = spark.range(3).select(*[lb.cast_unverified(F.col("id").cast("int"), k).alias(k) for k in ("true", "false", "none")]).collect()
    assert [tuple(r) for r in casts] == [(0, 0, 0), (1, 1, 1), (1, 0, 2)]


def test_decode_rules(spark):
    df = spark.createDataFrame([([2],), ([1, 4],), ([1, 3, 6],), ([1, 3],), ([1],), ([5],), ([1, 3, 5, 7],)], "c array<int>")
    got = [tuple(r) for r in df.select(*[c.alias(n) for n, c in lb.decode_claim(F.col("c")).items()]).collect()]
    assert got == [(False, None, None, None), (True, "Subjective", None, None), (True, "Verifiable", "Unverified", None),
                   (True, "Verifiable", None, "truth"), (True, None, None, "verifiability"), (None, None, None, "claim"),
                   (True, "Verifiable", "False", None)]
    one_code = spark.createDataFrame([([2],), ([1, 2],), ([9],), ([],)], "c array<int>")
    got = [tuple(r) for r in one_code.select(*[c.alias(n) for n, c in lb.decode_stance(F.col("c")).items()]).collect()]
    assert got == [("Denying", None), (None, "count"), (None, "code"), (None, "count")]
