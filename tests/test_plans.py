"""Physical plans: pruned scans, no Python outside model calls, no cross joins, no single-partition exchange."""

import re

import pytest

from tapeloom.plans import queries

SF = "/root/testdata/sf0.001"
MODEL_CALLS = {"transcribe_batch", "answer_batch"}  # those whose own plan calls it
NAMES = [n for n in queries.QUERIES if not n.startswith("stream_")]


@pytest.mark.parametrize("name", NAMES)
def test_plan(spark, name):
    plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin|SinglePartition", plan)
    assert bool(re.search("Python|Pandas|Arrow", plan)) == (name in MODEL_CALLS)


def test_scans_are_pruned(spark):
    plan = lambda name: queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<user_id:bigint,event_type:string,ts:timestamp_ntz>" in plan("streak_stats") or "event_type" in plan("streak_stats") and "props" not in plan("streak_stats")
    assert "EqualTo(event_type,error)" in plan("streak_stats")
    assert "text" not in plan("chunk_plan") and "ReadSchema: struct<doc_id:bigint,n_chars:bigint>" in plan("chunk_plan")


def test_streaks_shuffle_by_user_only(spark):
    plan = queries.QUERIES["streaks"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert set(re.findall(r"hashpartitioning\((\w+)#", plan)) == {"user_id"}


def test_a_status_page_reads_results_once(spark):
    plan = queries.QUERIES["job_status"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("l_linenumber") and len(re.findall(r"Relation \[l_orderkey", plan)) == 1
