"""Registered queries against their SQL; the driver holds all of them at a larger size."""

import pytest

NAMES = """a1_scan_kg a2_adjacency a2_stored_adjacency d1_stored_facts h1_stored_subgraph c2_context_facts c5_pair_facts d2_exact_grounding d5_dense_topk c11_expansion d3_stored_top1 d5_dense_top100 d5_stored_top100 e19_stored_index d4_relation_exact h1_subgraph e2_extremes d6_temporal_knn g2_proximity_order g3_implicit_anchors g6_semantic_chain
h3_with_pairs i8_interval_midpoint d12_answer_subgraph e18_idf e3_hits_at_1 e4_hits_granular d7_answer_recall d9_gold_anchors e15_discordant_pairs e8_breakdown e9_run_summary f1_stratified_order g8_prefix_sample d15_journal_merge f4_running_accuracy i2_parse_ts i13_answer_list
answer_pipeline_vi k8_trace k3_no_sg k4_no_kntn k4_no_ps a7_journal a4_question_scan d11_ordered_selection b10_run_id a14_adopted_cache a15_cache_runs a17_embedding_connector j4_leases j6_budget a16_model_calls k7_retry j3_complete l11_model_reasoner b8_reasoning_prompt""".split()


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(same, name):
    assert same(name) > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 75
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_plans(spark, data):
    """Top-k prunes before the shuffle, endpoint lookups are equi-joins, scans read what they need."""
    import __spark_entry__ as entry

    plan = lambda name: entry.queries()[name](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan("d6_temporal_knn")
    for name in ("d1_facts_touching", "h1_subgraph", "d7_answer_recall"):
        assert "NestedLoop" not in plan(name) and "Cartesian" not in plan(name)
    scan = plan("a3_relations")
    assert "l_extendedprice" not in scan
