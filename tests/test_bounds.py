"""What a task holds, and what is shuffled, must not grow faster than the tables."""

import re

from impactlens.operators import dependencies as dep
from impactlens.operators import linediff, sampling
from impactlens.operators import radius as rad
from impactlens.plans import bindings as b
from impactlens.plans import run_queries, skew
from impactlens.plans.catalog import QUERIES
from impactlens.sources import diffs
from tests.test_plans import SF, plan


def kept(monkeypatch, module):
    """The tables that a module writes, in order."""
    seen, write = [], module.materialise
    monkeypatch.setattr(module, "materialise", lambda df, *by: seen.append(df) or write(df, *by))
    return seen


def test_only_keys_of_full_buckets_are_counted(spark, rows, monkeypatch):
    seen = kept(monkeypatch, skew)
    many = spark.range(5000).selectExpr("id % 4000 AS k").unionByName(spark.range(300).selectExpr("7L AS k"))
    assert rows(skew.hot_keys(many, ["k"], 100)) == [(7, 4)]
    # The first count is by bucket, whatever the number of keys.
    assert seen[0].columns == ["_bucket"] and seen[0].count() == 1
    assert skew.hot_keys(many, ["k"], 1000).isEmpty()


def test_dealt_rows_take_tasks_by_their_number(spark, rows):
    df = spark.range(1000).selectExpr("id % 10 AS k", "id AS v")
    out = skew.dealt(df, ["k"], 1000, 50)
    assert out.rdd.getNumPartitions() == 20 and rows(out) == rows(df)
    assert plan(out.groupBy("k", "v").count()).count("Exchange") == 1


def test_edges_of_a_level_meet_before_they_are_added_up(spark, rows, monkeypatch):
    calls = [("g", f"a{i}", f"t{i % 3}", "static") for i in range(40)] + [("g", "a1", "t1", "heuristic"), ("g", "b", "a1", "heuristic"), ("g", "b", "a2", "static")]
    edges = spark.createDataFrame(calls, "graph_id STRING, caller STRING, callee STRING, confidence STRING")
    aims = spark.createDataFrame([("g", f"t{i}") for i in range(3)], "graph_id STRING, target STRING")
    seen = kept(monkeypatch, rad)
    found = rows(rad.reach(aims, edges, rows_per_task=10))
    levels = [plan(df) for df in seen[1:]]
    assert levels and all("REPARTITION_BY_NUM" in text for text in levels)
    # Callers with more edges than a task should meet are added up first; the answer is the same.
    assert found == rows(rad.reach(aims, edges, rows_per_task=1))
    assert ("g", "t1", "a1", 1, 2, True) in found and ("g", "t1", "b", 2, 1, False) in found and ("g", "t2", "b", 2, 1, True) in found


def test_a_chain_of_tasks_meets_each_pair_once(spark, rows):
    chain = spark.range(1, 40).selectExpr("'j' AS job_id", "CAST(id AS INT) AS seq", "CAST(id - 1 AS INT) AS needs")
    met = []
    onward = dep._onward
    dep._onward = lambda walks, paths, near, far: met.append(onward(walks, paths, near, far)) or met[-1]
    try:
        assert dep.closure(chain).count() == 39 * 40 // 2
    finally:
        dep._onward = onward
    assert sum(df.count() for df in met[::2]) == 39 * 40 // 2 - 39
    ring = spark.createDataFrame([("j", 1, 2), ("j", 2, 3), ("j", 3, 1), ("j", 9, 1)], "job_id STRING, seq INT, needs INT")
    assert rows(dep.closure(ring)) == sorted([("j", a, n) for a in (1, 2, 3, 9) for n in (1, 2, 3)], key=repr)


def test_supplier_pairs_meet_before_they_are_made_distinct(spark):
    text = plan(b.call_edge(spark, SF))
    assert "HashAggregate" not in text[text.index("REPARTITION_BY_NUM"):]


def test_tests_meet_by_symbol_before_they_are_counted(spark):
    text = plan(QUERIES["covering_by_source"](spark, SF))
    lines = text[text.index("REPARTITION_BY_NUM"):]
    assert "lineitem" in lines and "HashAggregate" not in lines[:lines.index("lineitem")]


def test_coverage_of_an_order_is_shuffled_once(spark):
    assert plan(QUERIES["coverage_rows"](spark, SF)).count("Exchange") == 1


def test_lines_of_both_versions_meet_once(spark, rows):
    old = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 3, "a"), (None, 1, "a"), (2, 1, None)], "doc INT, line_no INT, text STRING")
    new = spark.createDataFrame([(1, 1, "a"), (1, 2, "c"), (None, 1, "a"), (2, 1, None)], "doc INT, line_no INT, text STRING")
    out = linediff.line_delta(old, new, ["doc"])
    assert plan(out).count("Exchange") == 1
    # What is null has no partner, as in a join.
    assert rows(out) == sorted([(1, "before", 2), (1, "before", 3), (1, "after", 2), (None, "before", 1), (None, "after", 1), (2, "before", 1), (2, "after", 1)], key=repr)


def test_changed_lines_are_found_once_for_a_sample(spark, monkeypatch):
    seen = kept(monkeypatch, sampling)
    changed = spark.createDataFrame([("g", "p", 1), ("g", "p", 2), ("g", "q", 7)], "g STRING, path STRING, line INT")
    assert sampling.sample_changed(changed, ["g"], 10).count() == 3
    assert [df.columns for df in seen] == [["g", "path", "line"]]


def test_lines_of_replies_are_marked_once(spark, rows, monkeypatch):
    seen = kept(monkeypatch, diffs)
    text = "<<<DIFF\n--- a/x.py\n+++ b/x.py\n@@ -1,1 +1,1 @@\n-a\n+b\nDIFF>>>\n"
    verdicts, lines = diffs.read_diffs(spark.createDataFrame([(1, text), (2, "none")], "o INT, text STRING"), "o")
    assert rows(verdicts, "o", "verdict") == [(1, "ok"), (2, "unparseable")] and rows(lines, "op", "text") == [("+", "b"), ("-", "a")]
    assert len(seen) == 2 and "regexp_extract_all" not in plan(lines) + plan(verdicts)


def test_orders_meet_customers_before_their_lines(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for df in (b.call_site(spark, SF), b.import_edge(spark, SF)):
            text = plan(df)
            below = text[text.index("hashpartitioning(o_custkey"):]
            assert "l_orderkey" not in re.search(r"FileScan parquet \[([^\]]*)", below).group(1)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_orders_meet_by_job_before_they_give_events(spark):
    text = plan(run_queries._gate_events(spark, SF))
    assert text.index("Generate") < text.index("REPARTITION_BY_NUM")


def test_a_document_is_parsed_once(spark):
    text = plan(QUERIES["evidence"](spark, SF))
    assert "get_json_object(document" not in text and "from_json" in text
