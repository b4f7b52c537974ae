"""A part of the registered queries against their SQL form on the smallest tables; ``tools/check.py``
runs all of them."""

import os

import pytest

from branchwise.plans.oracles import ORACLES
from branchwise.plans.queries import QUERIES

SMALL = "/root/testdata/sf0.001"
QUICK = ["q_thread_summary", "q_branches", "q_children", "q_mask_tweets", "q_mask_reddit", "q_tokens", "q_text_features",
         "q_normalised_features", "q_lexicon_counts", "q_sequences", "q_scores", "q_kfold", "q_stratified_split", "q_hmm_score",
         "q_merge_stores", "q_agreement", "q_claim_decode", "q_activity_sessions", "q_reddit_file", "q_tweet_file", "q_stance_annotation_file",
         "q_claim_overview_file", "q_flagged_claims", "q_branch_tokens", "q_word_similarity", "q_pos_tag_lines", "q_sequences_skip_first",
         "q_sequence_casts", "q_majority_baseline", "q_first_occurrence", "q_previous_and_source", "q_matrix_file", "q_thread_stream",
         "q_thread_folder_file", "q_claim_marks_file", "q_thread_selection", "q_epoch_file", "q_evaluation_sweep_majority",
         "q_subtree", "q_subtree_members", "q_upsert_store_buckets", "q_upsert_store_keys"]
NO_SQL = {"q_hmm_fit_gaussian", "q_hmm_fit_discrete", "q_cross_corpus", "q_evaluation_sweep", "q_approximate_neighbours", "q_word_vectors_trained", "q_stance_model", "q_stance_epochs", "q_claim_predictions"}


def test_every_query_has_sql_or_a_reason():
    assert set(QUERIES) - set(ORACLES) == NO_SQL
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="driver tables not present")
@pytest.mark.parametrize("name", QUICK)
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


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="driver tables not present")
def test_long_branches_have_one_token_pool(spark, monkeypatch):
    from branchwise.operators import sequences

    want = sorted(map(str, QUERIES["q_branch_tokens"](spark, SMALL).collect()))
    monkeypatch.setattr(sequences, "PART", 2)
    assert sorted(map(str, QUERIES["q_branch_tokens"](spark, SMALL).collect())) == want
