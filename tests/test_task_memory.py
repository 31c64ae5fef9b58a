"""Sorts and hash tables of a query: each takes memory pages of its own in a task, whatever the rows."""

import re

import pytest

from casegraph.operators import graph
from casegraph.plans import registry
from casegraph.sources import tables

SF = "/root/testdata/sf0.001"


@pytest.fixture
def held(spark):
    """How many sorts and hash tables the plan of a query has where no table is small enough to be broadcast."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield lambda name: len(re.findall(r"^[\s:+\-]*(?:Sort \[|HashAggregate|ObjectHashAggregate)", registry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString(), re.M))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_sessions_meet_in_one_sort(held):
    assert held("src_sessions") <= 16


def test_known_days_take_no_second_join(held):
    assert held("jn_first_seen") <= 7


def test_affiliations_are_dealt_over_bounded_tasks(spark, monkeypatch):
    monkeypatch.setattr(tables, "ROWS_A_TASK", 50, raising=False)
    lines = tables.table(spark, SF, "lineitem").count()
    many = tables.affiliations(spark, SF)
    assert many.rdd.getNumPartitions() == -(-lines // 50)
    monkeypatch.undo()
    assert sorted(many.collect()) == sorted(tables.affiliations(spark, SF).collect())


@pytest.mark.parametrize("name", ["jn_run_articles", "flt_view"])
def test_lines_are_dealt_over_bounded_tasks(spark, monkeypatch, name):
    whole = sorted(registry.queries()[name](spark, SF).collect())
    monkeypatch.setattr(tables, "ROWS_A_TASK", 500, raising=False)
    many = registry.queries()[name](spark, SF)
    assert "REPARTITION_BY_NUM" in many._jdf.queryExecution().executedPlan().toString()
    assert sorted(many.collect()) == whole


def test_labels_of_components_pass_no_driver(spark, monkeypatch):
    plans, written = [], graph.settled
    monkeypatch.setattr(graph, "settled", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or written(df))
    found = graph.components(spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y")], "src string, dst string"))
    assert sorted(map(tuple, found.collect())) == [("a", "a"), ("b", "a"), ("c", "a"), ("x", "x"), ("y", "x")]
    assert len(plans) > 1 and not any("Broadcast" in p for p in plans)


def test_hops_shuffle_no_edges_before_the_first_level(spark, monkeypatch):
    plans, written = [], graph.settled
    monkeypatch.setattr(graph, "settled", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or written(df))
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("a", "b"), ("b", "b"), ("c", "b"), ("x", "y")], "src string, dst string")
    found = graph.hops(edges, spark.createDataFrame([("a",)], "node string"))
    assert sorted(map(tuple, found.collect())) == [("a", 0, None), ("b", 1, "a"), ("c", 2, "b")]
    assert "Exchange" not in plans[0]


def test_pairs_of_lines_are_grouped_in_one_shuffle(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(graph, "corroborated_edges", lambda edges, root: edges)
    from casegraph.plans import graph_queries

    monkeypatch.setattr(graph_queries, "settled", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or df)
    got = registry.queries()["gr_corroborated"](spark, SF)
    lines = tables.table(spark, SF, "lineitem").selectExpr("concat('S', l_suppkey) AS src", "concat('P', l_partkey) AS dst", "l_orderkey")
    want = lines.groupBy("src", "dst").agg({"l_orderkey": "count"}).count()
    assert plans[0].count("Exchange") == 1 and got.count() == want
    many = lines.distinct().groupBy("src", "dst").count().filter("count > 1").select("src", "dst")
    assert sorted(got.filter("source_count > 1").select("src", "dst").collect()) == sorted(many.collect())


def test_pairs_around_events_pass_no_driver(spark, monkeypatch):
    """Pairs of nodes are many more than the rows of the file they are made from, by which Spark judges them."""
    from casegraph.operators import inference

    plans, written = {}, inference.settled
    monkeypatch.setattr(inference, "settled", lambda df: plans.update({tuple(df.columns): df._jdf.queryExecution().executedPlan().toString()}) or written(df))
    edges = spark.createDataFrame([(a, b, 4.0) for a, b in ("XA", "XB", "AB", "XC", "BC", "AC")], "src string, dst string, weight double")
    event = spark.createDataFrame([(1, ["X"], 1.0, 1.0)], "event long, touched array<string>, strength double, recency double")
    assert sorted(r.node for r in inference.impact(event, edges).collect()) == ["A", "B", "C"]
    assert "SortMergeJoin" in plans["event", "src", "dst", "weight"] and "Broadcast" not in plans["event", "src", "dst", "weight"]
