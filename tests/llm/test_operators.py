"""Every operator against a plain Python version of its contract, and on odd rows."""

import hashlib
import itertools
import math
import random
import re
import time
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from branchwise.llm import alignment, components, mixing, pieces, pii, prefix_trie, quality, sharding, simhash, substring, templates, token_scan, topk, toxicity
from branchwise.llm.queries import bpe_pattern, public_file

DOC = "doc_id long, text string, lang string, source string, n_chars long, size string, _h string, _group long, n_words string, hits string, shard string, depth string"
LONG = " ".join(f"w{i % 977}" for i in range(30_000))
ODD = [(1, None, "en", "a", 3, "x"), (2, "", None, None, None, None), (None, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen", "en", "a", 5, None),
       (3, LONG, "en", "a", 1, "y"), (3, LONG, "en", "a", 1, "y"), (4, "tie tie", "de", "b", 2, ""), (5, "tie tie", "de", None, 2, ""), (6, " \n\t\n ", "de", "b", 1, "z")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, "h", 1, "n", "x", "s", "d") for r in ODD], DOC)  # names that operators use themselves


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


def words(text):
    return (text or "").encode().split()


def corpus(n=120, seed=3):
    rng = np.random.default_rng(seed)
    vocabulary = ["".join(rng.choice(list("abcdefghij"), rng.integers(2, 7))) for _ in range(300)]
    out = []
    for i in range(n):
        body = " ".join(rng.choice(vocabulary, rng.integers(0, 80)))
        if i and rng.random() < 0.5:
            other = out[rng.integers(0, len(out))].split()
            a = rng.integers(0, len(other) + 1)
            body += "\n" + " ".join(other[a:a + rng.integers(0, 60)])
        out.append(body if rng.random() < 0.9 or not out else out[rng.integers(0, len(out))])
    return out


# 1 token counts

def test_token_counts_survive_every_block_length(spark):
    texts = [*corpus(40), "", None, "<|endoftext|> in a text"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    ranks = public_file("byte_bpe_50k.tiktoken")
    tool = token_scan.encoder(ranks, bpe_pattern())
    want = {i: len(tool.encode_ordinary(t or "")) for i, t in enumerate(texts)}
    for block in (7, 64, token_scan.BLOCK):
        found = token_scan.scan(token_scan.pack(docs, ranks, bpe_pattern(), 50256, block=block), 50256).collect()
        assert {r.doc_id: r.n_tokens for r in found} == want and len(found) == len(want)


def test_token_scan_stitches_groups_and_plain_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_scan, "GROUP", 2)
    stream = np.array([9, 9, 9, 9, 9, 9, 9, 0, 0, 9, 9, 0, 9, 0, 9, 9], dtype="<u2")  # the last two belong to no document
    (tmp_path / "flat").write_bytes(stream.tobytes())
    found = token_scan.scan(token_scan.read_flat(spark, str(tmp_path / "flat"), block=2), 0).orderBy("ordinal").collect()
    assert [(r.ordinal, r.start, r.n_tokens) for r in found] == [(0, 0, 7), (1, 8, 0), (2, 9, 2), (3, 12, 1)]


def test_token_counts_odd_rows(odd, empty):
    ranks = public_file("byte_bpe_50k.tiktoken")
    for df, n in ((odd, len(ODD)), (empty, 0)):
        assert token_scan.scan(token_scan.pack(df, ranks, bpe_pattern(), 50256), 50256).count() == n


# 2 mixing

def level(sizes, weights=mixing.WEIGHTS):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    total, capped, target = sum(sizes.values()), set(), {}
    while True:
        rest = total - sum(3 * sizes[s] for s in capped)
        free = [s for s in names if s not in capped]
        target = {s: 3.0 * sizes[s] if s in capped else rest * weight[s] / sum(weight[f] for f in free) for s in names}
        over = {s for s in free if target[s] > 3 * sizes[s]}
        if not over:
            return target
        capped |= over


def test_mix_meets_targets(spark):
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(["x"] * int(rng.integers(0, 400))), [None, "a", "b", "ü", "z", "tiny"][int(rng.choice(6, p=[.1, .45, .2, .1, .14, .01]))]) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.shares(docs).collect()
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(words(t))
    target = level(sizes)
    taken = {s: sum(r.taken for r in got if r.source == s) for s in sizes}
    assert len(got) == 600 and all(r.source_size == sizes[r.source] and r.taken <= 3 * r.size for r in got)
    for s in sizes:
        assert {round(r.target, 4) for r in got if r.source == s} == {round(target[s], 4)}
        assert abs(taken[s] - target[s]) <= max(0.02 * target[s], 2 * mixing.BLOCK)
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.shares(docs.repartition(7)).collect()))


def test_mix_texts_are_the_words_taken(spark):
    docs = spark.createDataFrame([(i, f"d{i} " + "\n".join(f"d{i}w{j}" for j in range(50 + i)), "s" + str(i % 4), 0) for i in range(80)],
                                 "doc_id long, text string, source string, n_chars long")
    taken = {r.doc_id: r.taken for r in mixing.shares(docs).collect()}
    rows = mixing.mix(docs).collect()
    by_doc = {}
    original = {r.doc_id: r.text for r in docs.collect()}
    for r in rows:
        by_doc[r.doc_id] = by_doc.get(r.doc_id, 0) + len(words(r.text))
        assert r.n_chars == len(r.text) and set(words(r.text)) <= set(words(original[r.doc_id]))
    assert by_doc == {k: v for k, v in taken.items() if v}


def test_permutations(spark):
    for n in (1, 2, 17, 1000):
        slots = spark.range(n).select(F.lit(0).alias("_s"), F.lit(n).cast("long").alias("_blocks"), F.col("id").alias("_x"), F.lit(1).alias("_round"),
                                      F.array(*[F.lit(7919 * i % n).cast("long") for i in range(3 * mixing.ROUNDS)]).alias("_keys"))
        assert sorted(r._j for r in mixing.permuted(slots, "t").collect()) == list(range(n))


def test_blocks_are_taken_as_by_a_random_draw(spark):
    n, share = 100_000, 10_000
    keys = F.transform(F.sequence(F.lit(0), F.lit(3 * mixing.ROUNDS - 1)), lambda i: F.pmod(mixing.hash60(F.concat(F.lit("t|"), i.cast("string"))), F.lit(n)))
    slots = spark.range(share).select(F.lit(0).alias("_s"), F.lit(n).cast("long").alias("_blocks"), F.col("id").alias("_x"), F.lit(0).alias("_round"), keys.alias("_keys"))
    taken = np.array([r._j for r in mixing.permuted(slots, "t").select("_j").collect()])
    assert len(set(taken)) == share
    for width in (1000, 10_000):
        counts = np.bincount(taken // width, minlength=n // width)
        wide = width * 0.1 * 0.9  # a random draw's variance, but for the finite table
        assert counts.var() < 1.3 * wide + (3 * wide if width == 10_000 else 0) and (width == 10_000 or counts.var() > 0.7 * wide)


def test_mix_odd_rows(odd, empty):
    got = mixing.shares(odd).collect()
    assert len(got) == len(ODD) and {r.size for r in got if r.doc_id in (1, 2, 6)} == {0} and all(r.taken <= 3 * r.size for r in got)
    assert mixing.mix(odd).columns == odd.columns and mixing.shares(empty).count() == 0 and mixing.mix(empty).count() == 0


# 3 quality rules

def plain_counts(text):
    w = words(text)
    lines, seen, dup = (text or "").split("\n"), set(), 0
    for line in lines:
        if line.strip(" \t\x0b\x0c\r"):
            dup += line in seen
            seen.add(line)
    grams = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    covered = {p for i, g in enumerate(grams) if grams.count(g) > 1 for p in range(i, i + 5)}
    return len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered)


def test_counts():
    for text in [*corpus(30), "a b c d e a b c d e", "a a a a a a", "x\n\nx\n x\nx", "é ü # | <>", "", None, "a\x85b c\x1cd e"]:
        assert quality.counts(text)[:5] == plain_counts(text)


def test_binomial_bound_is_exact():
    for n, k, risk, delta in itertools.product((5, 60, 400), (0, 1, 7), (0.01, 0.05), (0.05, 1e-4)):
        tail = sum(math.comb(n, i) * risk**i * (1 - risk) ** (n - i) for i in range(k + 1))
        assert quality.upper_bound_holds(k, n, risk, delta) == (tail <= delta and k < n * risk)


def test_cutoffs_reject_junk_and_spare_good(spark):
    rng = np.random.default_rng(1)
    rows = [(i, " ".join((("#$%" if i % 10 == 0 and rng.random() < .8 else "w") + str(rng.integers(1e6))) for _ in range(60)), int(i % 10 != 0)) for i in range(2500)]
    measured = quality.measure(spark.createDataFrame(rows, "doc_id long, text string, quality int"))
    cutoffs = quality.certify(measured)
    assert (0, "symbols_per_word") in cutoffs
    kept = {r.doc_id for r in quality.judge(measured, cutoffs).where("kept").collect()}
    assert kept == {i for i in range(2500) if i % 10}
    assert quality.certify(measured.limit(50)) == {}  # too few to promise anything


def test_quality_odd_rows(odd, empty):
    for df, n in ((odd, len(ODD)), (empty, 0)):
        got = quality.judge(quality.measure(df), {}).collect()
        assert len(got) == n and all(r.kept == (r.n_words >= 10 and 100 * r.n_repeat_words <= 20 * r.n_words) for r in got)


# 4 line templates

def test_templates(spark):
    rows = [(i, f"own {i} a{i}b\nPosted by user u{i} on day {i}\nunique line of text x{'abcdefghij'[i % 10]} number{chr(97 + i)}\nHome Login") for i in range(20)]
    rows += [(100 + i, "copied first\ncopied second line\ncopied third") for i in range(30)]  # copies, one place each
    got = {r.doc_id: r for r in templates.drop_recurring(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0].text == rows[0][1] and got[0].n_dropped == 0  # the first of its kind keeps its lines
    for i in range(1, 20):
        assert "Posted" not in got[i].text and "Home Login" not in got[i].text and "unique line" in got[i].text and got[i].n_lines == 4
    assert all(got[100 + i].n_dropped == 0 for i in range(30))


def test_templates_with_constant_neighbours(spark):
    import corpus_pipeline

    word = lambda i: "".join("abcdefghij"[int(d)] for d in str(i))
    own = [f"own{word(i)} first{word(i)} text{word(i)} of its own" for i in range(300)]
    block = [f"{w} clause of the licence text" for w in ("one", "two", "three", "four", "five")]
    rows = [(i, f"{own[i]}\n\nAccept all cookies of this site\n\nend{word(i)} {own[i]}") for i in range(50)]  # between blank lines
    rows += [(100 + i, "\n".join([own[100 + i], *block, f"end{word(i)} {own[100 + i]}"])) for i in range(50)]  # a block
    rows += [(200 + i, f"Error at night {i} on page {i}") for i in range(20)]  # nothing else
    rows += [(300 + i, "copied first line here\ncopied second line here\ncopied third line here") for i in range(30)]  # one text
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in templates.drop_recurring(df).collect()}
    text = dict(rows)
    assert all(got[i].text == text[i] for i in (0, 100, 200, *range(300, 330)))  # first of their kind, and copies
    assert all(got[i].n_dropped == 1 and "cookies" not in got[i].text for i in range(1, 50))
    assert all(got[i].n_dropped == 5 and "licence" not in got[i].text for i in range(101, 150))
    assert all(got[i].n_dropped == 1 and not got[i].text for i in range(201, 220))
    left = {r.doc_id: r.text for r in corpus_pipeline.drop_lines(spark, df, "").collect()}
    assert left == {i: r.text for i, r in got.items() if r.text}


def test_few_and_many_leaves_give_the_same(spark):
    docs = spark.createDataFrame([(i, f"line one of {i}\nshared line here\nown {'xyz'[i % 3]}{i}") for i in range(40)], "doc_id long, text string")
    first, second = (sorted(map(tuple, templates.recurring(docs, few=n).collect())) for n in (templates.FEW, 0))
    assert first == second and len(first) == 39 * 3


def test_templates_odd_rows(odd, empty):
    got = templates.drop_recurring(odd).collect()
    assert sorted(map(str, [r.text for r in got])) == sorted(str(r[1]) for r in ODD) and [r.n_lines for r in got if r.text is None] == [0]
    assert templates.drop_recurring(empty).count() == 0


# 5 pieces

def test_encoding_equals_the_library(spark):
    import sentencepiece as spm

    blob = public_file("piece_bpe_32k.model")
    library = spm.SentencePieceProcessor(model_proto=blob)
    rng = np.random.default_rng(0)
    texts = [*corpus(20), "", " ", "  a  b ", "\n\n x\n", "▁x▁▁y z▁", "\x00\x01\t", "😀é́ﬁ", "<s> </s> <unk> <0x0A>", "a" * 3000, " " * 999,
             "".join(rng.choice(list(" ▁\nab1é😀<s>\t"), 20_000))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    full = {r.doc_id: r for r in pieces.encode(docs, blob).collect()}
    short = {r.doc_id: r for r in pieces.encode(docs, blob, digest=True).collect()}
    for i, t in enumerate(texts):
        ids = library.encode(t)
        assert list(full[i].ids) == ids and full[i].decoded == library.decode(ids)
        raw, spans = t.encode(), full[i].spans
        assert len(spans) == len(ids) + 1 and spans[-1] == len(raw) and list(spans) == sorted(spans)
        for piece, a, b in zip(ids, spans, spans[1:]):  # a piece's text is its span, but for the prefix and byte pieces
            if not library.is_byte(piece):
                assert library.id_to_piece(piece).replace("▁", " ").encode().lstrip(b" ") == raw[a:b].replace("▁".encode(), b" ").lstrip(b" ")
        assert short[i].n_tokens == len(ids) and short[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert short[i].decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_character_map_equals_the_library():
    import sentencepiece as spm
    from sentencepiece import sentencepiece_model_pb2 as pb

    tool = spm.SentencePieceNormalizer(rule_name="nmt_nfkc", add_dummy_prefix=False, escape_whitespaces=False, remove_extra_whitespaces=False)
    proto = pb.ModelProto()
    proto.ParseFromString(tool.serialized_model_proto())
    own = pieces.CharacterMap(proto.normalizer_spec.precompiled_charsmap)
    for text in ["ﬁne", "Ａｂ①", "éx", "㍿カﾞ", "plain text", "½ x²"]:
        out, origin = own.apply(text.encode())
        assert out.decode() == tool.normalize(text) and len(origin) == len(out) + 1 and origin[-1] == len(text.encode())


def test_pieces_odd_rows(odd, empty):
    blob = public_file("piece_bpe_32k.model")
    assert pieces.encode(odd, blob, digest=True).count() == len(ODD) and pieces.encode(empty, blob).count() == 0


# 6 toxicity

def labelled(spark, n=900):
    rng = np.random.default_rng(2)
    parts = ["th", "er", "on", "an", "in", "re", "ou", "ti"]
    rows, labels = [], []
    for i in range(n):
        body = ["".join(rng.choice(parts, rng.integers(1, 4))) for _ in range(40)]
        toxic = i % 4 == 0
        if toxic:
            for w in rng.choice(["moronic", "scumbag", "pathetic"], 3):
                body.insert(int(rng.integers(0, 40)), str(w))
        rows.append((i, " ".join(body)))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_on_held_out_rows_and_disguises(spark):
    docs, labels = labelled(spark)
    model = toxicity.fit(docs, labels)
    scored = toxicity.score(docs, model).join(labels, "doc_id").withColumn("held", toxicity.held_out(F.col("doc_id"))).collect()
    held = [r for r in scored if r.held]
    assert all(r.held == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in scored)
    assert np.mean([r.predicted == r.toxic for r in held]) > 0.95
    plain = " ".join(["thering", "onan", "reti"] * 12)
    tries = [plain] + [f"{plain} {w} {plain} {w}" for w in ("pathetic", "path-etic", "pathhetic", "p4thetic", "p a t h e t i c")]
    got = [r.score for r in toxicity.score(spark.createDataFrame([(i, t) for i, t in enumerate(tries)], "doc_id long, text string").coalesce(1), model).orderBy("doc_id").collect()]
    assert got[0] < 0.5 and min(got[1:]) > got[0] and got[1] > 0.5


def test_rare_words_of_toxic_texts_are_not_learnt(spark):
    """Words of one or two texts each, many of them in toxic texts only by chance: they say nothing about other rare words."""
    rng = np.random.default_rng(3)
    parts = ["th", "er", "on", "an", "in", "re", "ou", "ti", "le", "st", "en", "ha"]
    made = lambda: "".join(rng.choice(parts, rng.integers(3, 7)))
    rows, labels = [], []
    rare = [made() for _ in range(20_000)]
    for i in range(1500):
        body = [str(w) for w in rng.choice(rare, 60)]
        if i % 3 == 0:
            for w in rng.choice(["moron", "scum", "trash", "clown"], 2):
                body.insert(int(rng.integers(0, 60)), str(w))
        rows.append((i, " ".join(body)))
        labels.append((i, int(i % 3 == 0)))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    held = toxicity.score(docs, model).where(toxicity.held_out(F.col("doc_id"))).join(labels, "doc_id").collect()
    assert np.mean([r.predicted for r in held if r.toxic]) > 0.95 and np.mean([r.predicted for r in held if not r.toxic]) < 0.03
    assert np.mean(model.verdicts([made() for _ in range(2000)]) > 0) < 0.02


@pytest.mark.parametrize("short", [True, False])
def test_long_words_are_learnt_in_pieces(short):
    rng = np.random.default_rng(4)
    parts = ["th", "er", "on", "an", "in", "re", "ou", "ti"]
    made = lambda n: "".join(rng.choice(parts, n))
    clean = list(dict.fromkeys(made(int(rng.integers(2, 5))) for _ in range(400)))
    heads = [made(13) for _ in range(8)]
    clean += [h + made(3) for h in heads]  # the heads are known to be harmless
    toxic = [h + w for h, w in zip(heads, ["scumbag", "pigface"] * 4)] + (["moronic"] if short else [])
    words_, n = clean + toxic, len(clean)
    y = np.array([0.0] * n + [20.0] * len(toxic))
    runs, offset = toxicity._learn_words(words_, y, np.where(y > 0, 0.0, 30.0))
    model = toxicity.Model(runs, offset, np.zeros(8), np.zeros(7), np.ones(7))
    assert model.verdicts(["scumbag", "pigface"]).min() > 0 > model.verdicts([h[:toxicity.PIECE] for h in heads]).max()
    assert model.verdicts(toxic).min() > 0 > np.quantile(model.verdicts(clean), 0.99)


def test_kernel_equals_its_definition():
    def vector(word):
        c = toxicity.codes(word)
        out = {}
        for i, j, k in itertools.combinations(range(len(c)), 3):
            if k - i < toxicity.SPAN:
                out[c[i], c[j], c[k]] = out.get((c[i], c[j], c[k]), 0) + toxicity.DECAY ** (k - i + 1)
        return out

    names = ["banana", "bandana", "cat", "a", "moron", "mor0n"]
    got = toxicity.kernel(names, toxicity.dense_of(names))
    for (i, a), (j, b) in itertools.product(enumerate(names), repeat=2):
        x, y = vector(a), vector(b)
        norm = math.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))
        assert got[i, j] == pytest.approx(sum(v * y.get(u, 0) for u, v in x.items()) / norm if norm else 0, abs=1e-4)


def test_toxicity_odd_rows(spark, odd, empty):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    one = spark.createDataFrame([(1, 1), (3, 0), (None, 1), (4, None)], "doc_id long, toxic int")
    for labels in (none, one):
        got = toxicity.score(odd, toxicity.fit(odd, labels)).collect()
        assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score(empty, toxicity.fit(empty, none)).count() == 0


# 7 substring deduplication

def plain_removal(rows):
    first = {}
    for i, t in rows:
        w = words(t)
        for s in range(len(w) - 12):
            key = tuple(w[s:s + 13])
            if i is not None:
                first[key] = min(first.get(key, i), i)
    out = []
    for i, t in rows:
        w = words(t)
        gone = {p for s in range(len(w) - 12) if i is not None and first[tuple(w[s:s + 13])] < i for p in range(s, s + 13)}
        out.append((i, len(w), len(gone), hashlib.sha256(b" ".join(x for p, x in enumerate(w) if p not in gone)).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("crowd", [substring.CROWD, 1])
def test_substrings(spark, crowd):
    rows = list(enumerate(corpus(100, 9))) + [(200 + i, f"lead{i} " + " ".join(f"p{j}" for j in range(20)) + f" tail{i}") for i in range(8)]
    rows += [(7, rows[9][1]), (None, rows[9][1]), (300, None), (301, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = substring.deduplicate(docs, digest=True, crowd=crowd)
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got.collect()), key=str) == plain_removal(rows)


def test_backward_search():
    rng = np.random.default_rng(4)
    symbols = np.concatenate([np.append(rng.integers(1, 5, rng.integers(13, 40)), 0) for _ in range(30)])
    index = substring.FmIndex(symbols)
    starts = [i for i in range(len(symbols) - 3) if 0 not in symbols[i:i + 4]]
    patterns = np.array([symbols[i:i + 4] for i in starts])
    length, low, high = index.matches(patterns)
    for p, n, a, b in zip(patterns, length, low, high):
        times = sum(np.array_equal(symbols[i:i + 4], p) for i in starts)
        assert (n == 4) == (times > 1)
        if n == 4:
            assert b - a == times and all(np.array_equal(symbols[s:s + 4], p) for s in index.suffixes[a:b])


def test_substrings_odd_rows(odd, empty):
    got = substring.deduplicate(odd, digest=True).collect()
    assert len(got) == len(ODD) and all(r.n_removed == 0 for r in got) and substring.deduplicate(empty).count() == 0


# 8 top-k

@pytest.mark.parametrize("block", [topk.QUERIES, 3])
def test_top_k(spark, block):
    rng = np.random.default_rng(6)
    vectors = rng.normal(size=(400, 16))
    vectors[40:80] = vectors[0:40]  # ties
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    rows += [(1000, None), (1050, [1.0, None]), (1100, [float("nan")] * 16), (1150, [float("inf")] * 16), (1200, [1.0, 2.0]), (1201, [2.0, 2.0]), (None, [0.0] * 16), (1250, [])]
    got = topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0, 5, block=block).collect()
    whole = np.floor(256 * vectors).astype(int)
    want = set()
    for q in range(0, 400, 50):
        score = whole @ whole[q]
        order = sorted((i for i in range(400) if i != q), key=lambda i: (-score[i], i))[:5]
        want |= {(q, rank + 1, i, int(score[i])) for rank, i in enumerate(order)}
    want.add((1200, 1, 1201, 256 * 512 + 512 * 512))
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_top_k_large_components_and_empty(spark):
    rows = [(0, [3e6, -1.0]), (50, [2e6, 5.0]), (7, [1e6, 1.0])]
    got = topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0, 2).collect()
    assert {(r.query_id, r.rank, r.vec_id) for r in got} == {(0, 1, 50), (0, 2, 7), (50, 1, 0), (50, 2, 7)}
    assert [r.score for r in got if (r.query_id, r.vec_id) == (0, 50)] == [int(256 * 3e6) * int(256 * 2e6) - 256 * 1280]
    assert topk.search(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0, 5).count() == 0


# 9 sharding

@pytest.mark.parametrize("step", [sharding.STEP, 2])
def test_shards(spark, monkeypatch, step):
    monkeypatch.setattr(sharding, "STEP", step)
    rng = np.random.default_rng(8)
    rows = [(i, int(rng.integers(0, 100))) for i in range(500)] + [(9999, 5000), (None, 10)]
    placed, buckets = sharding.assign(spark.createDataFrame(rows, "doc_id long, size long"), "doc_id", F.col("size"), 1000)
    hashes = {i: int(hashlib.md5(("" if i is None else str(i)).encode()).hexdigest()[:15], 16) for i, _ in rows}

    def split(members, depth):
        if sum(n for _, n in members) <= 1000 or len(members) == 1:
            return {i: format(hashes[i] >> (60 - depth), f"0{depth}b") if depth else "" for i, _ in members}
        halves = [[m for m in members if hashes[m[0]] >> (59 - depth) & 1 == b] for b in (0, 1)]
        return {**split(halves[0], depth + 1), **split(halves[1], depth + 1)} if all(halves) else split(halves[0] or halves[1], depth + 1)

    assert {r.doc_id: r.shard for r in placed.collect()} == split(rows, 0)
    assert all(r.shard_bytes <= 1000 or r.n_rows == 1 for r in buckets.collect())


def test_repeated_keys_overflow_to_pages(spark):
    rows = [(1, 300)] * 20 + [(2, 100)]
    placed, _ = sharding.assign(spark.createDataFrame(rows, "doc_id long, size long"), "doc_id", F.col("size"), 1000)
    held = {}
    for r in placed.collect():
        held[r.shard] = held.get(r.shard, 0) + r.n_bytes
    assert len(placed.collect()) == 21 and max(held.values()) <= 1000


def test_shards_odd_rows(odd, empty):
    placed, _ = sharding.assign(odd, "doc_id", F.octet_length("text"), 1000)
    assert placed.count() == len(ODD) and sharding.assign(empty, "doc_id", F.octet_length("text"), 1000)[0].count() == 0


# 10 near-duplicate groups

def plain_fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    grams = [b" ".join(w[i:i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_groups(codes):
    lab = {c: c for c in codes}

    def root(c):
        while lab[c] != c:
            c = lab[c]
        return c

    for a, b in itertools.combinations(sorted(set(codes)), 2):
        if (a ^ b).bit_count() <= 3:
            lab[max(root(a), root(b))] = min(root(a), root(b))
    return {c: root(c) for c in codes}


@pytest.mark.parametrize("bucket", [simhash.BUCKET, 16])
def test_groups(spark, bucket, monkeypatch):
    monkeypatch.setattr(simhash.links, "__defaults__", (simhash.RADIUS, bucket))
    base = corpus(60, 4)
    rng = np.random.default_rng(2)
    rows = []
    for i, t in enumerate(base):
        for _ in range(int(rng.integers(1, 4))):
            w = t.split()
            if w and rng.random() < 0.7:
                w[rng.integers(0, len(w))] = "changed"
            rows.append((len(rows), " ".join(w).upper() if rng.random() < 0.3 else " ".join(w)))
    rows += [(1000, None), (1001, ""), (None, base[0]), (1002, "two words"), (1002, "two words"), (1003, "é")]
    got = simhash.groups(simhash.fingerprints(spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    codes = {t: plain_fingerprint(t) for _, t in rows}
    member = plain_groups(list(codes.values()))
    low = {}
    for i, t in rows:
        if i is not None:
            low[member[codes[t]]] = min(i, low.get(member[codes[t]], i))
    want = sorted(((i, codes[t], low.get(member[codes[t]])) for i, t in rows), key=str)
    assert sorted(((r.doc_id, r._fp % 2**64, r.component_id) for r in got), key=str) == want


def test_near_copies_in_fingerprint_space(spark):
    rng = np.random.default_rng(1)
    codes = set()
    for b in rng.integers(0, 2**64, 40, dtype=np.uint64).tolist():
        for _ in range(int(rng.integers(1, 30))):
            codes.add(b ^ sum(1 << int(k) for k in set(rng.integers(0, 64, int(rng.integers(0, 5))).tolist())))
    signed = {int(np.uint64(c).view(np.int64)): c for c in codes}
    rows = spark.createDataFrame([(c,) for c in signed], "fp long")
    want = plain_groups(list(codes))
    for bucket in (4096, 16):
        found = {r.node: r.root for r in components.components(simhash.links(rows, bucket=bucket)).collect()}
        mine = {signed[c]: found.get(c, c) for c in signed}
        pairs = {(want[c], mine[c]) for c in codes}
        assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def test_one_of_each_group_stays(spark, odd, empty):
    kept = simhash.deduplicate(odd)
    assert kept.columns == odd.columns
    ids = sorted((r.doc_id for r in kept.collect()), key=str)
    assert ids == sorted([1, 3, 4, None], key=str)  # null, empty and blank texts are one group
    assert simhash.deduplicate(empty).count() == 0


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(900, 905), (905, 901)], "a long, b long")
    found = {r.node: r.root for r in components.components(edges).collect()}
    assert found == {**{i: 0 for i in range(301)}, 900: 900, 901: 900, 905: 900}


# 11 token alignment

def plain_alignment(texts):
    import sentencepiece as spm
    from tokenizers import Tokenizer

    first = Tokenizer.from_str(public_file("byte_bpe_50k.json").decode())
    first.encode_special_tokens = True
    second = spm.SentencePieceProcessor(model_proto=public_file("piece_bpe_32k.model"))
    byte_of = alignment.byte_of()
    found = []
    for t in texts:
        a, b = first.encode(" " + t, add_special_tokens=False).ids if t else [], second.encode(t) if t else []
        raw_a = [bytes(byte_of[c] for c in first.id_to_token(i)) for i in a]
        raw_b = [bytes([int(second.id_to_piece(i)[3:5], 16)]) if second.is_byte(i) else second.id_to_piece(i).replace("\u2581", " ").encode() for i in b]
        if not (t and b"".join(raw_a) == (" " + t).encode() == b"".join(raw_b)):
            found.append([])
            continue
        ends = [list(itertools.accumulate(map(len, raw))) for raw in (raw_a, raw_b)]
        groups, x, y = [], 0, 0
        for end in sorted(set(ends[0]) & set(ends[1])):
            p, q = ends[0].index(end) + 1, ends[1].index(end) + 1
            groups.append((a[x:p], b[y:q]))
            x, y = p, q
        found.append(groups)
    counts = {}
    for groups in found:
        for pair in {(i, j) for a, b in groups for i in a for j in b}:
            counts[pair] = counts.get(pair, 0) + 1
    top = {}
    for (i, _), n in counts.items():
        top[i] = max(n, top.get(i, 0))
    out = []
    for groups in found:
        pairs = [(i, j) for a, b in groups for i in a for j in b]
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        out.append((sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(pairs), sum(counts[p] == top[p[0]] for p in pairs),
                    sum(counts[p] for p in pairs), hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return out


@pytest.mark.parametrize("chars", [alignment.BLOCK_CHARS, 500])
def test_alignment_equals_plain_version(spark, chars):
    rng = np.random.default_rng(3)
    texts = [*corpus(40), "", None, " ", "  two  spaces ", "\n\nlines\r\n\there ", "\u2581meta", "<s> </s> <unk> <0x0A> <|endoftext|>", "\U0001f600\u00e9\u0301 \ufb01", "it's we're 'll I'd",
             "a\x85b c\x1cd\u00a0e\u3000f", "\x00\x01", "12345 67,890.12", "x" * 400, "".join(rng.choice(list(" ab1\u00e9\n'.s\U0001f600"), 3000)), "the same", "the same"]
    docs = spark.createDataFrame([(i, t, 1, "p") for i, t in enumerate(texts)], "doc_id long, text string, block long, `pairs.x` string")
    got = alignment.links(docs, public_file("byte_bpe_50k.json"), public_file("piece_bpe_32k.model"), chars=chars).collect()
    assert len(got) == len(texts)
    want = plain_alignment(texts)
    for r in got:
        assert tuple(r)[1:] == want[r.doc_id], texts[r.doc_id]


def test_runs_are_jumped_and_irregular_groups_resolved():
    rng = np.random.default_rng(2)
    for _ in range(2000):
        n = int(rng.integers(1, 60))
        cuts = [np.unique(np.append(rng.choice(n, rng.integers(0, n + 1), replace=False) + 1, n)) for _ in range(2)]
        runs, groups = alignment.align(*[c.astype(np.int32) for c in cuts])
        ends = sorted([int(cuts[0][i + k]) for i, _, m in runs for k in range(m)] + [int(cuts[0][p - 1]) for _, p, _, _ in groups])
        assert ends == sorted(set(cuts[0].tolist()) & set(cuts[1].tolist()))
        assert all((cuts[0][i:i + k] == cuts[1][j:j + k]).all() for i, j, k in runs) and all(cuts[0][p - 1] == cuts[1][q - 1] for _, p, _, q in groups)
        assert sum(k for _, _, k in runs) + sum(p - i for i, p, _, _ in groups) == len(cuts[0])
    assert alignment.align(np.zeros(0, np.int32), np.zeros(0, np.int32)) == ([], [])


def test_alignment_keeps_few_stretches_between_tasks(spark, monkeypatch):
    import pyarrow as pa

    tools = public_file("byte_bpe_50k.json"), public_file("piece_bpe_32k.model")
    texts = [f"ord{i} hest{i % 50} kø" for i in range(3000)]
    monkeypatch.setattr(alignment, "CHUNK_CHARS", 2000)
    monkeypatch.setattr(alignment, "REMEMBER", 4000)
    alignment.pair_of.cache_clear()
    seen = []

    class Docs:
        """Stands in for a table: hands the task's function over."""
        doc_id = text = 0

        def __getitem__(self, name):
            return self

        def cast(self, kind):
            return self

        def select(self, *columns):
            return self

        def mapInArrow(self, run, schema):
            seen.append(run)

    alignment.blocks(Docs(), *tools, chars=10_000)
    monkeypatch.setattr(alignment.TaskContext, "get", classmethod(lambda cls: type("T", (), {"partitionId": lambda self: 3})()))
    batch = pa.RecordBatch.from_arrays([pa.array(range(3000)), pa.array(texts)], ["doc_id", "text"])
    found = [b.to_pylist()[0] for b in seen[0](iter([batch]))]
    assert len(found) > 3 and sum(len(b["doc_id"]) for b in found) == 3000
    tool = alignment.pair_of(*tools)
    assert 0 < len(tool.known) <= 1000 == alignment.REMEMBER // 4  # a worker that waits or does the next step holds few
    for b in found:  # every document's pairs and how many of the block's documents hold each
        assert b["pairs"] == sorted(set(b["pairs"])) and len(b["which"]) == sum(b["own"]) == sum(b["docs"]) and sum(b["times"]) == sum(b["n_links"])
    monkeypatch.setattr(alignment, "REMEMBER", 100)  # what is forgotten on the way is asked for again
    again = [b.to_pylist()[0] for b in seen[0](iter([batch]))]
    assert again == found


def test_alignment_odd_rows(odd, empty):
    tools = public_file("byte_bpe_50k.json"), public_file("piece_bpe_32k.model")
    assert sorted(r.n_links == 0 for r in alignment.links(odd, *tools).collect()) == [False] * 6 + [True] * 2
    assert alignment.links(empty, *tools).count() == 0


# 12 conversation trie

def plain_trie(rows):
    own = {}
    for c, t, r, x in rows:
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    own = {c: [v[2:] for v in sorted(vs)] for c, vs in own.items()}
    full = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        full[c] = own.get(c - int(math.fmod(c, 100)), [])[:h] + turns[h:]
    members, children = {}, {}
    for c, turns in full.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    for k in members:
        if k:
            children[k[:-1]] = children.get(k[:-1], 0) + 1
    leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += k not in children
            saved[k[:d]] += (len(m) - 1) * len(k[-1][1]) if k else 0
    digest = lambda k, m: hashlib.sha256(",".join(str(c) for c in sorted(m) if len(full[c]) == len(k)).encode()).hexdigest()
    return sorted(((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), children.get(k, 0), leaves[k], saved[k], digest(k, m))
                   for k, m in members.items()), key=str)


@pytest.mark.parametrize("crowd", [prefix_trie.CROWD, 12])
def test_trie_equals_plain_version(spark, crowd):
    rng = np.random.default_rng(1)
    rows = []
    for c in [*range(-5, 160), 250, 777, 10**12 + 3]:
        for t in range(int(rng.integers(0, 9))):
            rows.append((c, t if rng.random() < .95 else None, [None, "user", "bot"][rng.integers(3)], [None, "", "a", "b\u00e9", "cc"][rng.integers(5)]))
    rows += [(None, 1, "a", "b")] * 3 + rows[:20]  # without an id, and repeated rows
    rows += [(2000 + i, 0, "user", "hot") for i in range(60)]  # copies
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, pos string, `node.a` long")
    got = prefix_trie.trie(docs, crowd=crowd).collect()
    assert sorted(map(tuple, got), key=str) == plain_trie(rows)


def test_trie_of_little(spark, monkeypatch):
    kinds = "conv_id long, turn long, role string, text string"
    assert prefix_trie.trie(spark.createDataFrame([], kinds)).count() == 0
    for rows in ([(7, 0, "a", "b")], [(None, 0, "a", "b"), (100, 1, "x", None)]):
        assert sorted(map(tuple, prefix_trie.trie(spark.createDataFrame(rows, kinds)).collect()), key=str) == plain_trie(rows)
    monkeypatch.setattr(prefix_trie, "RUN", 5)  # ids of one end in many runs
    rows = [(i, t, "u", "same" * t) for i in range(200) for t in range(8)]
    assert sorted(map(tuple, prefix_trie.trie(spark.createDataFrame(rows, kinds)).collect()), key=str) == plain_trie(rows)


# 13 personal data

PLAIN = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def plain_spans(text):
    out = []
    for k, p in enumerate(PLAIN):
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m[0])
            luhn = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0
            if (k == 0 or k == 1 and all(int(x) <= 255 for x in m[0].split(".")) or k == 2 and 16 <= len(digits) <= 19 and luhn
                    or k == 3 and 8 <= len(digits) <= 15):
                out.append((k, m.start(), m.end()))
    return out


def test_base_spans_equal_the_plain_patterns():
    draw = random.Random(1)
    bits = ["a", "b.", "@", "1", "23", "4.5", ". ", "-", " ", "+1", " (", "\u00e9", "5", "c.d", "@e.f", "%", "255", "1.2.3.4", "4111111111111111"]
    for _ in range(20_000):
        text = "".join(draw.choices(bits, k=draw.randint(0, 24)))
        base = pii.base_spans(text)
        assert base == plain_spans(text)
        more = sorted([*pii.candidates(text, base)])
        assert all(a[1] <= b[0] for a, b in zip(more, more[1:])) and not any(x < b and a < y for a, b in more for _, x, y in base)
    began = time.time()
    for part in ("1", "a", "1.", "1 ", "a@", "+1", "5(", "a.", "1@", "(1"):
        text = part * 100_000 + "@"
        pii.patterns(text, 0, 100_000)
        pii.candidates(text, pii.base_spans(text))
    assert time.time() - began < 30


def plain_personal(texts):
    """The whole method in plain loops: (base spans, all spans) per text."""
    marks = []
    for t in texts:
        base = plain_spans(t or "")
        marks.append([(k, a, b) for k, a, b in base] + [(-1, a, b) for a, b in pii.candidates(t or "", base)])
    edges, seeds = {}, {}
    for t, spots in zip(texts, marks):
        for k, a, b in spots:
            if k >= 0:
                seeds[t[a:b].lower()] = min(k, seeds.get(t[a:b].lower(), 9))
            for p in pii.patterns(t, a, b):
                edges.setdefault(p, set()).add(t[a:b].lower())
    seeds = {s: k for s, k in seeds.items() if any(s in i for i in edges.values())}
    known, size = {s: (k, 1.0) for s, k in seeds.items()}, -1
    for _ in range(pii.ROUNDS):
        counting = {}
        for p, members in edges.items():
            for k in range(4):
                shares = [known[i][1] for i in members if i in known and known[i][0] == k]
                if sum(c >= pii.ACCEPT for c in shares) >= pii.SUPPORT and sum(shares) / (len(members) + 1) >= pii.ACCEPT:
                    counting[p, k] = sum(shares) / (len(members) + 1)
        rest = {}
        for (p, k), score in counting.items():
            for i in edges[p] - set(seeds):
                rest.setdefault(i, {}).setdefault(k, []).append(score)
        fresh = {i: max((1 - math.prod(1 - s for s in by), -k) for k, by in kinds.items()) for i, kinds in rest.items()}
        if len(fresh) == size:
            break
        known, size = {**{s: (k, 1.0) for s, k in seeds.items()}, **{i: (-k, c) for i, (c, k) in fresh.items()}}, len(fresh)
    out = []
    for t, spots in zip(texts, marks):
        added = []
        for k, a, b in spots:
            if k < 0 and (best := max(((counting[p, j], -j) for p in pii.patterns(t, a, b) for j in range(4) if (p, j) in counting), default=None)):
                added.append((-best[1], a, b))
        base = [s for s in spots if s[0] >= 0]
        out.append((base, sorted(base + added) if added else base))
    return out


def test_context_finds_identifiers_without_a_plain_form(spark):
    draw = random.Random(4)
    noise = lambda: " ".join(draw.choices(["the", "house", "of", "12", "7", "2.0", "river"], k=draw.randint(0, 6)))
    number = lambda: f"+1 ({draw.randint(100, 999)}) 555-{draw.randint(1000, 9999)}"
    texts = [f"{noise()} call {number()} today {noise()}" for _ in range(200)]
    texts += [f"{noise()} call 555-{100 + i}3 now {noise()}" for i in range(12)]  # no plain form, the word before tells
    texts += [f"{noise()} ask 555-{100 + i}3 please" for i in range(12)] + ["ask 555-9123 please"]  # learnt from those just found
    texts += [f"{noise()} write to ann{i}@mail.example.org soon" for i in range(9)] + ["write to root@localhost soon", "look at it@home here"]
    texts += [f"version 3.{i} of 4111 1111 1111 1112" for i in range(6)] + ["", None, LONG, "call"] + texts[:5]
    docs = spark.createDataFrame([(i, t, "x", -1) for i, t in enumerate(texts)], "doc_id long, text string, spans string, `base.a` long")
    got = {r.doc_id: r for r in pii.extract(docs).collect()}
    want = plain_personal(texts)
    assert len(got) == len(texts)
    for i, (base, spans) in enumerate(want):
        assert [tuple(s) for s in got[i].base] == base and [tuple(s) for s in got[i].spans] == spans
    found = {texts[i][s.start:s.end] for i in got for s in got[i].spans if s not in got[i].base}
    assert {"555-1003", "555-9123", "root@localhost"} <= found and not any(x in found for x in ("12", "7", "2.0", "it@home", "3.1"))


def test_personal_data_odd_rows(spark, odd, empty):
    got = pii.extract(odd).collect()
    assert len(got) == len(ODD) and all(not r.base and not r.spans for r in got)
    assert pii.extract(empty).count() == 0


# column names

def test_any_column_name(spark):
    docs = spark.createDataFrame([(i, f"some words of text {i} " * 5, "en", "s", 5, 1, 2, 3) for i in range(4)],
                                 "doc_id long, text string, lang string, source string, n_chars long, `my col` long, `a.b` long, `c``d` long")
    names = ["my col", "a.b", "c`d"]
    for made in (mixing.mix(docs), simhash.deduplicate(docs), substring.deduplicate(docs), quality.measure(docs), templates.drop_recurring(docs),
                 pieces.encode(docs, public_file("piece_bpe_32k.model")), sharding.assign(docs, "doc_id", F.lit(1), 2)[0],
                 toxicity.score(docs, toxicity.fit(docs, spark.createDataFrame([(0, 1), (1, 0)], "doc_id long, toxic int")))):
        assert set(names) <= set(made.columns)
        assert {tuple(r[n] for n in names) for r in made.collect()} == {(1, 2, 3)}
