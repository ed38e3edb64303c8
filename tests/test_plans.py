"""What plans must and must not have: pruned scans, pushed filters, no nested loops, limits before shuffles."""

import re

import pytest

import __spark_entry__  # noqa: F401  registers the queries
from quillgraph.plans.registry import QUERIES


def plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


#: A side of one row, or a query set whose size was checked, is broadcast to every row of the other.
NESTED_OK = {"indexed_topk", "adapter_open_cbgm_3_john", "edge_endpoints", "historical_gate", "tool_retrieve_chunks", "tool_cultural_overlay", "tool_debate_for_verse", "tool_historical_bundle", "witness_completion", "cosine_topk", "filtered_topk", "per_type_topk", "balanced_union", "question_match", "rrf_hybrid", "hybrid_expand", "keyword_rank", "bm25_topk", "rerank_topk", "top_tags"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - NESTED_OK - {"stream_ingest", "turn_stream", "job1_chunk_ingest", "job2_keyword_index"}))
def test_no_nested_loops(spark, sf_dir, name):
    text = plan(QUERIES[name](spark, sf_dir))
    assert "BroadcastNestedLoopJoin" not in text and "CartesianProduct" not in text


def test_filters_reach_the_scan(spark, sf_dir):
    assert re.search(r"PushedFilters: \[.*LessThanOrEqual\(p_size,25\)", plan(QUERIES["linked_edges"](spark, sf_dir)))
    assert re.search(r"PushedFilters: \[.*In\(label, \[1,3,5\]\)", plan(QUERIES["filtered_topk"](spark, sf_dir)))


def test_scans_read_what_they_need(spark, sf_dir):
    for name, unread in (("anchor_lemmas", "l_extendedprice"), ("cosine_topk", "label"), ("first_wins_dedupe", "source"), ("message_sequence", "user_id")):
        assert all(unread not in s for s in re.findall(r"ReadSchema: (.*)", plan(QUERIES[name](spark, sf_dir)))), name


def test_top_k_is_limited_before_the_shuffle(spark, sf_dir):
    for name in ("cosine_topk", "per_type_topk", "cross_ref_votes", "bm25_topk"):
        assert "WindowGroupLimit" in plan(QUERIES[name](spark, sf_dir)), name


def test_interval_join_is_an_equi_join(spark, sf_dir):
    assert re.search(r"(SortMerge|BroadcastHash|ShuffledHash)Join", plan(QUERIES["interval_containment"](spark, sf_dir)))


def test_expressions_stay_in_the_jvm(spark, sf_dir):
    for name in ("license_guard", "snippet_redact", "chunk_pack", "verdict_band", "rule_violations", "page_links", "intent_route", "snapshot_hash", "stable_ids"):
        assert not re.search("PythonUDF|EvalPython|Pandas|ArrowEval", plan(QUERIES[name](spark, sf_dir))), name
