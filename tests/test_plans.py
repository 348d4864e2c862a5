"""What the plans must look like."""

import re

import pytest

from impactlens.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"
# These multiply or keep state inside Python tasks by design.
PYTHON = {"tfidf_topk", "tfidf_exclude", "vector_topk", "budget_replay", "stream_gaps", "stream_budget", "stream_closing"}
NATIVE = sorted(set(QUERIES) - PYTHON)
# One row per run of the whole table is the feature of these.
ONE_ROW = {"top_recent"}
# Their join is on the graph, which is one constant in these tables, so it is folded away.
ONE_GRAPH = {"entity", "find_symbol", "tree_of_file"}


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", NATIVE)
def test_native_without_cross_products_or_single_tasks(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert not re.search("EvalPython|InPandas|InArrow", text)
    assert name in ONE_GRAPH or ("CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text)
    # A single partition may only gather partial sums or a page that was asked for.
    for node in re.findall(r"Exchange SinglePartition[^\n]*\n[^\n]*", text):
        assert "partial" in node or "Limit" in node or name in ONE_ROW, (name, node)


def test_filters_and_columns_reach_the_scan(spark):
    assert "EqualTo(p_brand,Brand#1)" in plan(QUERIES["callers_of"](spark, SF))
    assert "o_orderdate" not in plan(QUERIES["open_attempts"](spark, SF))


def test_top_k_trims_before_the_shuffle(spark):
    assert "WindowGroupLimit" in plan(QUERIES["tree_level"](spark, SF))


def test_hot_jobs_shrink_before_the_shuffle(spark):
    text = plan(QUERIES["latest_per_key"](spark, SF))
    below = text[text.index("Exchange hashpartitioning"):]
    assert "partial_max" in below
