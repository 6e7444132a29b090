"""No task of these queries reads more rows of a shuffle as tables grow."""

import pytest

from mnemoframe import scratch
from mnemoframe.operators import graph, insights
from mnemoframe.plans import memory


@pytest.fixture
def busiest(spark, monkeypatch):
    """The most rows that one task of a function's jobs reads, when a task is meant to hold 1000."""
    monkeypatch.setattr(scratch, "ROWS", 1000)
    sc = spark.sparkContext._jsc.sc()
    store, gateway = sc.statusStore(), spark.sparkContext._gateway
    top = gateway.new_array(spark._jvm.double, 1)
    top[0] = 1.0

    def stages():
        sc.listenerBus().waitUntilEmpty()
        found = store.stageList(None, False, False, gateway.new_array(spark._jvm.double, 0), None)
        return {(x.stageId(), x.attemptId()) for x in map(found.apply, range(found.size())) if x.shuffleReadRecords()}

    def rows(run):
        before = stages()
        run()
        return max(store.taskSummary(*s, top).get().shuffleReadMetrics().readRecords().apply(0) for s in stages() - before)

    return rows


@pytest.mark.parametrize("query", [memory.e01, memory.g01, memory.f05, memory.f06])
def test_rows_of_a_task_are_bounded(spark, small, busiest, query):
    assert busiest(lambda: query(spark, small).collect()) <= 2500


def test_subgraph_makes_no_pairs_of_seeds(spark, shuffled):
    """300 seeds around one hub: 90,000 pairs of a seed and a node, but 301 nodes."""
    e = spark.range(1, 301).selectExpr("id as source", "0L as target")
    nodes = spark.range(301).selectExpr("id", "concat('n', id) as name")
    found = []
    assert shuffled(lambda: found.extend(graph.subgraph(nodes, e, nodes.where("id > 0").select("name"))[0].collect())) < 5000
    assert sorted((r.id, r.dist) for r in found) == [(0, 1)] + [(i, 0) for i in range(1, 301)]


def test_connections_of_repeated_names(spark):
    """Equal names are said once, missing ones not at all, and a node with two names is one neighbour."""
    e = spark.createDataFrame([(1, t) for t in (2, 3, 4, 5)], "source long, target long")
    nodes = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b"), (4, None), (5, "c"), (5, "d")], "id long, name string")
    got = insights.connections(nodes.where("id = 1"), nodes, e, 2).collect()
    assert [(r.n, r.names) for r in got] == [(4, ["b", "c"])]
