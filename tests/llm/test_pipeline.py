"""The pipeline stage by stage against plain versions, and the registered queries against their SQL."""

import hashlib
import os

import numpy as np
import pytest

import __spark_entry__
import corpus_pipeline
from branchwise.llm import mixing
from branchwise.llm.queries import ORACLES, QUERIES, public_file
from branchwise.session import durable
from tests.llm.test_operators import level, plain_fingerprint, plain_groups, words

DOC = "doc_id long, text string, lang string, source string, n_chars long"
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = np.random.default_rng(11)
    parts = ["th", "er", "on", "an", "in", "re", "ou", "ti"]
    vocabulary = ["".join(rng.choice(parts, rng.integers(1, 4))) for _ in range(400)]
    rows, labels = [], []
    for i in range(700):
        body = [str(w) for w in rng.choice(vocabulary, rng.integers(20, 60))]
        if i % 5 == 0:
            for w in rng.choice(["moronic", "scumbag", "pathetic"], 4):
                body.insert(int(rng.integers(0, len(body))), str(w))
        lines = [" ".join(body[:15]), " ".join(body[15:])]
        if i % 7 == 0:
            lines.insert(1, f"Shared on page {i} by the usual people")
        text = "\n".join(lines)
        rows.append((i, text, "en", f"s{i % 4}", len(text)))
        labels.append((i, int(i % 5 == 0)))
    rows += [(1000 + i, rows[1][1], "en", "s0", 1) for i in range(5)]  # copies
    rows += [(2000, None, None, None, None), (2001, "", "en", "s1", 0), (None, "no id here at all", "en", "s1", 5)]
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, DOC).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, rows


def test_stages(spark, folder):
    import sentencepiece as spm

    path, rows = folder
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "line_dedup", "simhash_near_dedup", "mixing", "sentencepiece"]
    docs = spark.read.parquet(f"{path}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = durable(stage(spark, docs, path))
        kept[name] = docs.collect()
        if name != "sentencepiece":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]

    first = {r.doc_id for r in kept["toxicity"]}
    assert sum(i in first for i in range(0, 700, 5)) <= 7 and sum(i not in first for i in range(700) if i % 5) <= 6
    assert {2000, 2001, None} | {1000 + i for i in range(5)} <= first

    second = {r.doc_id: r.text for r in kept["line_dedup"]}
    assert set(second) == first
    shared = sorted(i for i in first if i is not None and i < 700 and i % 7 == 0)
    assert [i for i in shared if "Shared on" in second[i]] == shared[:1]  # the first keeps its line
    for r in kept["toxicity"]:
        if r.doc_id not in shared:
            assert second[r.doc_id] == r.text

    codes = {r.doc_id: plain_fingerprint(r.text) for r in kept["line_dedup"]}
    member = plain_groups(list(codes.values()))
    low = {}
    for i, c in codes.items():
        low.setdefault(member[c], []).append(i)
    want = {min((i for i in ids if i is not None), default=None) for ids in low.values()}
    third = {r.doc_id: r for r in kept["simhash_near_dedup"]}
    assert set(third) == want and len(third) == len(kept["simhash_near_dedup"]) and not any(1000 + i in third for i in range(5))

    sizes, got = {}, {}
    for r in third.values():
        sizes[r.source] = sizes.get(r.source, 0) + len(words(r.text))
    for r in kept["mixing"]:
        got[r.source] = got.get(r.source, 0) + len(words(r.text))
        assert set(words(r.text)) <= set(words(third[r.doc_id].text))
    for s, t in level(sizes).items():
        assert abs(got.get(s, 0) - t) <= 0.02 * t + 2 * mixing.BLOCK

    library = spm.SentencePieceProcessor(model_proto=public_file("piece_bpe_32k.model"))
    texts = sorted((str(r.doc_id), r.source, len(library.encode(r.text)), hashlib.sha256(",".join(map(str, library.encode(r.text))).encode()).hexdigest()) for r in kept["mixing"])
    assert sorted((str(r.doc_id), r.source, r.n_tokens, r.ids_sha256) for r in kept["sentencepiece"]) == texts


def test_run_equals_its_stages_and_an_empty_corpus_stays_empty(spark, folder, tmp_path):
    path, rows = folder
    once, again = (sorted(map(str, corpus_pipeline.run(spark, path).collect())) for _ in range(2))
    assert once == again and once
    spark.createDataFrame([], DOC).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_registration():
    names = set(__spark_entry__.queries())
    assert {*QUERIES, "pipeline"} <= names and {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)}
    assert set(ORACLES) <= set(__spark_entry__.oracle_sql())


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="driver tables not present")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    from tools.check import TABLES, rows_of

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    df = QUERIES[name](spark, SMALL)
    want = con.execute(ORACLES[name])
    names = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(names)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(names, want.fetchall())
