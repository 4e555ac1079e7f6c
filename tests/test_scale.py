"""What one task or the driver is given, so that it does not grow with the tables."""

import re

import pytest
from pyspark.sql import functions as F

from graphloom.operators import fts, metrics, scc
from graphloom.plans import store_queries
from graphloom.plans.queries import QUERIES
from graphloom.runtime import following, stage
from graphloom.sources import tables


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("rows", [0, 1, 4, 5, 23])
def test_following_across_runs(spark, rows):
    data = [(i * 7 % 23 // 2, i, i * i % 5 or None) for i in range(rows)]
    df = spark.createDataFrame(data, "a long, b long, v long").repartition(5)
    got = {(r.a, r.b): (r.v, r.n) for r in following(df, "v", "a", "b", name="n", run=4).collect()}
    order = sorted(data)
    assert got == {(a, b): (v, order[i + 1][2] if i + 1 < rows else None) for i, (a, b, v) in enumerate(order)}


@pytest.mark.parametrize("view", [tables.user_edges, tables.user_pairs])
def test_next_events_are_not_found_in_one_task(spark, small, view):
    specs = re.findall(r"lead\(.*?windowspecdefinition\((\w+)", plan_of(view(spark, small)))
    assert set(specs) <= {"__run"} and "lead(" in plan_of(view(spark, small))
    sql = {tables.user_edges: tables.USER_EDGES, tables.user_pairs: tables.USER_PAIRS}[view]
    tables.table(spark, small, "events")
    want = spark.sql(sql)
    assert view(spark, small).schema == want.schema
    assert view(spark, small).exceptAll(want).count() == want.exceptAll(view(spark, small)).count() == 0


def test_tree_edges_make_the_pairs_once(spark, small):
    got = store_queries.tree_edges(spark, small)
    assert "lead(" not in plan_of(got)
    tables.table(spark, small, "events")
    want = spark.sql(store_queries.TREE_EDGES)
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0 and got.where(F.col("kind") == 6).count() > 0


def test_a_chain_of_components_takes_few_rounds(spark, monkeypatch):
    """Thirty rings, each leading to the next: colours of joins took rounds for each ring and started over for each."""
    rings = [[r * 4 + i for i in range(4)] for r in range(30)]
    rows = [(ring[i], ring[(i + 1) % 4]) for ring in rings for i in range(4)] + [(a[0], b[0]) for a, b in zip(rings, rings[1:], strict=False)]
    staged = []
    monkeypatch.setattr(scc, "stage", lambda df, name: staged.append(name) or stage(df, name))
    got = scc.strong_components(spark.createDataFrame(rows, "source_id long, target_id long"), 40)
    assert {r.id: r.scc for r in got.collect()} == {v: ring[0] for ring in rings for v in ring}
    assert len(staged) < 20 and "colour" not in staged


def test_metrics_make_the_calls_once(spark, small, monkeypatch):
    """Components, degrees, distances and the count of calls read one table of calls; the window over lineitem runs for it alone."""
    given = []
    for name in ("strong_components", "_depths"):
        real = getattr(metrics, name)
        monkeypatch.setattr(metrics, name, lambda *a, real=real: given.append(plan_of(a[-1])) or real(*a))
    QUERIES["graph_metrics"](spark, small)
    assert len(given) == 2 and not any("lead(" in plan for plan in given)


def test_rows_are_dealt_before_their_tokens_are_made(spark, small):
    plan = plan_of(fts.postings(tables.part_nodes(spark, small)))
    assert re.search(r"Generate.*\n(.*\n)*?.*RepartitionByExpression \[id", plan)
