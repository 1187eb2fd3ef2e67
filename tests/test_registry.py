import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, os.path.join(ROOT, "tools"))

import __spark_entry__ as entry  # noqa: E402
from hazelake.catalog.register import QUERIES  # noqa: E402
from check import compare, connect  # noqa: E402

SMALL = "/root/testdata/sf0.001"
SAMPLE = ["rolling_lagged", "spatial_join", "hotspot_proxy_fill", "correlation_matrix", "kpi_cards", "append_new_dates"]


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.oracle_sql()) > 80


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
@pytest.mark.parametrize("name", SAMPLE)
def test_sample_matches_sql(spark, name):
    note, good = compare(spark, connect(SMALL), name, SMALL)
    assert good, note


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
def test_entry_runs(spark):
    df = entry.entry(spark)
    assert len(df.columns) == 72 and df.count() > 0


def children(node) -> list:
    """Plan nodes that a node reads from; plans of subqueries are none of them."""
    if node.nodeName() == "AdaptiveSparkPlan":
        return [node.initialPlan()]
    found = node.children()
    return [found.apply(i) for i in range(found.size())]


def nodes(node):
    yield node
    for child in children(node):
        yield from nodes(child)


def first_exchanges(node):
    for child in children(node):
        if "Exchange" in child.nodeName():
            yield child
        else:
            yield from first_exchanges(child)


def single_task_windows(plan) -> list[str]:
    """Windows whose rows come from an exchange that brings all of them into one task."""
    windows = [n for n in nodes(plan) if n.nodeName() == "Window"]
    return [w.nodeName() for w in windows if any("SinglePartition" in x.outputPartitioning().toString() for x in first_exchanges(w))]


def test_a_window_in_one_task_is_noticed(spark):
    rows = spark.range(10).selectExpr("id", "id % 2 AS k")
    one = rows.selectExpr("row_number() OVER (ORDER BY id) AS n")
    keyed = rows.selectExpr("row_number() OVER (PARTITION BY k ORDER BY id) AS n", "(SELECT max(id) FROM range(5)) AS m")
    assert [single_task_windows(x._jdf.queryExecution().executedPlan()) for x in (one, keyed)] == [["Window"], []]


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if q.sql])
def test_no_plan_has_a_cross_join_or_a_window_in_one_task(spark, name):
    plan = entry.queries()[name](spark, SMALL)._jdf.queryExecution().executedPlan()
    assert "CartesianProduct" not in plan.toString() and "NestedLoop" not in plan.toString()
    assert not single_task_windows(plan)


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
def test_queries_set_the_method_limit_in_sessions_that_have_the_default(spark):
    limit, query = "spark.sql.codegen.hugeMethodLimit", entry.queries()["histogram"]
    other = spark.newSession()
    for given, wanted in (("65535", "8000"), ("3000", "3000")):
        other.conf.set(limit, given)
        query(other, SMALL)
        assert other.conf.get(limit) == wanted
