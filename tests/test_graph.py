"""Traversals, components, metrics and lookups against plain Python, and the fixtures of the survey."""

from collections import Counter, defaultdict, deque
from itertools import pairwise

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.operators import context, diffimpact, export, lookup, metrics, resolve, scc, traverse
from graphloom.plans.queries import QUERIES

NODE = "id long, kind int, name string, qualified_name string, file_path string, line int, end_line int, signature string, docstring string"


def nodes_of(spark, *names, file="./a.cpp"):
    return spark.createDataFrame([(i + 1, 1, n, n, file, 10 * i + 1, 10 * i + 5, "", "") for i, n in enumerate(names)], NODE)


def edges_of(spark, pairs, kind=1):
    return spark.createDataFrame([(i + 1, a, b, kind if len(r) == 0 else r[0]) for i, (a, b, *r) in enumerate(pairs)], "id long, source_id long, target_id long, kind int")


def queue_walk(edges, start, kinds, reverse, max_depth):
    """Tree edges in the order of a queue: each expanded node looks at its edges kind by kind, by id."""
    out, seen, queue = [], {start}, deque([(start, 0)])
    while queue:
        node, depth = queue.popleft()
        if depth >= max_depth:
            continue
        for turn, kind in enumerate(kinds):
            fresh = []
            for id_, a, b, k in sorted(edges):
                at, to = (b, a) if reverse else (a, b)
                if k == kind and at == node and (to not in seen or to in fresh):
                    if to not in fresh:
                        fresh.append(to)
                    out.append((to, node, id_, turn, depth + 1))
            for to in fresh:
                seen.add(to)
                queue.append((to, depth + 1))
    return out


@pytest.mark.parametrize("seed", [0, 1])
def test_walks_as_a_queue_does(spark, seed):
    rng = np.random.default_rng(seed)
    rows = [(i, int(a), int(b), int(k)) for i, (a, b, k) in enumerate(zip(rng.integers(0, 9, 30), rng.integers(0, 9, 30), rng.choice([1, 1, 6], 30), strict=True))]
    edges = spark.createDataFrame(rows, "id long, source_id long, target_id long, kind int")
    for walk, kinds, reverse in ((traverse.callees, (1,), False), (traverse.callers, (1,), True), (traverse.impact, (1, 6), True)):
        got = walk(edges, traverse.from_ids(edges, 3), 4).orderBy("depth", "ord").collect()
        want = queue_walk(rows, 3, kinds, reverse, 4)
        assert sorted((r.node_id, r.parent_id, r.edge_id, r.turn, r.depth) for r in got) == sorted(want)
        first = [r.node_id for r in got if r.is_first]
        assert first == list(dict.fromkeys(w[0] for w in want))
        depth = {w[0]: w[4] for w in want}
        near = traverse.distances(traverse.oriented(edges, kinds, reverse), traverse.from_ids(edges, 3), 4).collect()
        assert {r.node_id: r.depth for r in near} == depth


def test_paths(spark):
    e = edges_of(spark, [(1, 2), (2, 3), (3, 4)])
    assert traverse.find_path(e, 1, 4) == [1, 2, 3, 4]
    assert traverse.find_path(e, 4, 1) == [] and traverse.find_path(e, 2, 2) == [2] and traverse.find_path(e, 1, 4, max_depth=2) == []
    assert traverse.find_path(e, 4, 1, reverse=True) == [4, 3, 2, 1]
    rows = traverse.impact_chain(e, traverse.from_ids(e, 3)).collect()
    assert {r.node_id: list(r.path) for r in rows} == {2: [3, 2], 1: [3, 2, 1]}
    assert traverse.callees(e, traverse.from_ids(e, 99)).collect() == []


def test_cycles(spark):
    got = scc.strong_components(edges_of(spark, [(1, 2), (2, 3), (3, 1), (4, 1), (5, 5)]))
    assert {r.id: r.scc for r in got.collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5}
    assert [(r.scc, r["size"]) for r in scc.cycles(got).collect()] == [(1, 3)]


@pytest.mark.parametrize("local", [0, 1_000_000])
def test_components_of_random_graphs(spark, local):
    rng = np.random.default_rng(7)
    pairs = [(int(a), int(b)) for a, b in zip(rng.integers(0, 40, 60), rng.integers(0, 40, 60), strict=True)]
    got = {r.id: r.scc for r in scc.strong_components(edges_of(spark, pairs), local).collect()}
    reach = defaultdict(set)
    for v in {x for p in pairs for x in p}:
        todo = [v]
        while todo:
            x = todo.pop()
            if x not in reach[v]:
                reach[v].add(x)
                todo += [b for a, b in pairs if a == x]
    assert got == {v: min(w for w in reach[v] if v in reach[w]) for v in reach}


def test_metrics(spark):
    n = nodes_of(spark, "main", "a", "b", "c")
    e = edges_of(spark, [(1, 2), (1, 3), (2, 3), (3, 4)])
    files = spark.createDataFrame([("./a.cpp",)], "path string")
    row = metrics.graph_metrics(n, e, files).first()
    assert (row.n_nodes, row.n_edges, row.n_cycles, row.max_depth, row.avg_depth) == (4, 4, 0, 2, 2.0)
    deg = metrics.degrees(n, e)
    assert [(r.name, r.degree) for r in metrics.top_degrees(deg, "in_degree", 1).collect()] == [("b", 2)]
    assert [(r.name, r.degree) for r in metrics.top_degrees(deg, "out_degree", 4).collect()] == [("main", 2), ("a", 1), ("b", 1)]
    assert metrics.graph_metrics(n.limit(0), e.limit(0)).first().n_nodes == 0


def test_dead_code(spark):
    n = spark.createDataFrame([(1, 1, "used", "used", "./a.cpp", 1, 2, "", ""), (2, 1, "idle", "idle", "./a.cpp", 3, 4, "", ""), (3, 1, "main", "main", "./a.cpp", 5, 6, "", ""), (4, 1, "f", "ns::f", "./a.cpp", 7, 8, "", ""), (5, 1, "t", "t", "./tests/a.cpp", 1, 2, "", ""), (6, 1, "h", "h", "./a.h", 1, 2, "", ""), (7, 1, "lock", "lock", "./a.cpp", 1, 2, "", ""), (8, 3, "C", "C", "./a.cpp", 1, 2, "", ""), (9, 1, "~D", "~D", "./a.cpp", 1, 2, "", "")], NODE)
    e = edges_of(spark, [(3, 1), (8, 2, 0)])
    assert [r.name for r in metrics.dead_code(n, e).collect()] == ["idle"]
    assert metrics.dead_code(n, e, "A.CPP").collect() == []


def test_lookup(spark):
    n = spark.createDataFrame([(1, 1, "foo", "ns::foo", "./a.cpp", 1, 9, "void foo()", ""), (2, 1, "foo_helper", "foo_helper", "./a.cpp", 11, 19, "", ""), (3, 0, "foo", "foo", "./foo", 0, 0, "", ""), (4, 1, "A::foo", "A::foo", "./a.h", 1, 30, "", ""), (5, 1, "foo", "foo", "./a.h", 1, 2, "", "")], NODE)
    assert [r.id for r in lookup.find_by_name(n, "foo", 1).collect()] == [1]
    assert [r.id for r in lookup.find_by_name(n, "foo").orderBy("lookup_rank").collect()] == [1, 5, 4, 2]
    assert [r.id for r in lookup.find_by_name(n, "o_h").collect()] == [2] and lookup.find_by_name(n, "o%h").collect() == []
    assert lookup.pick_best(lookup.find_by_name(n, "foo", 5)).first().id == 4
    assert [r.id for r in lookup.nodes_by_ids(n, [4, 1, 77]).collect()] == [1, 4] and lookup.nodes_by_ids(n, []).collect() == []


def test_resolution_prefers_near_places(spark):
    n = spark.createDataFrame([(1, 1, "wait", "wait", "./x/a.cpp", 1, 2, "", ""), (2, 1, "wait", "wait", "./y/b.cpp", 1, 2, "", ""), (3, 1, "use", "use", "./y/b.cpp", 3, 4, "", ""), (4, 1, "go", "q::go", "./z/c.cpp", 1, 2, "", ""), (5, 1, "go", "r::go", "./z/d.cpp", 1, 2, "", ""), (6, 1, "s", "q::s", "./w/e.cpp", 1, 2, "", "")], NODE)
    refs = spark.createDataFrame([(1, 3, "wait"), (2, 6, "go"), (3, 3, "nothing"), (4, 6, "wai"), (5, 3, "")], "id long, source_node_id long, ref_name string")
    got = {r.id: (r.target_id, r.score) for r in resolve.resolve(refs, n).collect()}
    assert got == {1: (2, 10), 2: (4, 3), 3: (None, None), 4: (1, 0), 5: (None, None)}


def test_context(spark):
    n = nodes_of(spark, "caller", "target", "callee")
    e = edges_of(spark, [(1, 2), (2, 3)])
    found, rows, _ = context.build_context(n, e, "target")
    assert found["name"] == "target" and {(r.name, r.role) for r in rows.collect()} == {("caller", "caller"), ("callee", "callee")}
    assert context.build_context(n, e, "zzz") is None


def test_class_context_covers_the_partner_file(spark):
    n = spark.createDataFrame([(1, 3, "C", "C", "./c.h", 1, 9, "", ""), (2, 1, "C::run", "C::run", "./c.cpp", 1, 2, "", ""), (3, 1, "other", "other", "./c.cpp", 3, 4, "", ""), (4, 1, "user", "user", "./u.cpp", 1, 2, "", "")], NODE)
    _, rows, _ = context.build_context(n, edges_of(spark, [(4, 2), (2, 3)]), "C")
    assert {(r.name, r.role) for r in rows.collect()} == {("C::run", "method"), ("user", "caller"), ("other", "callee")}


def test_change_impact(spark):
    n = nodes_of(spark, "a", "b", "c", "d").unionByName(spark.createDataFrame([(9, 0, "a.cpp", "a.cpp", "./a.cpp", 0, 0, "", "")], NODE))
    h = spark.createDataFrame([("./a.cpp", 22, 22, True), ("./zz.cpp", 1, 99, True)], "file_path string, line_start int, line_end int, is_added boolean")
    got = {(r.id, r.role) for r in diffimpact.change_impact(n, edges_of(spark, [(1, 2), (2, 3), (4, 1), (3, 4)]), h).collect()}
    assert got == {(3, "affected"), (2, "impact"), (1, "impact"), (4, "impact")}


def test_dot(spark):
    n = spark.createDataFrame([(1, 1, 'say "x"', "q", "./a", 1, 2, "void f(" + "a" * 60 + ")", ""), (2, 3, "C<T>", "C", "./a", 1, 2, "", "")], NODE)
    text = export.dot_text(n, edges_of(spark, [(1, 2), (1, 99)]))
    assert 'n1 [label="say \\"x\\"\\nvoid f(' in text and '..."' in text and 'n2 [label="C\\<T\\>", fillcolor="#E8F5E9"]' in text
    assert text.count("->") == 1 and text.startswith("digraph") and text.endswith("}")


def test_orders_of_candidates_are_total(spark):
    n = nodes_of(spark, *["same"] * 30)
    got = resolve.candidates(spark.createDataFrame([("same",)], "ref_name string"), n)
    assert sorted(r.id for r in got.collect()) == list(range(1, 11)) and got.agg(F.max("rank")).first()[0] == 10


def test_whole_pairs(spark, small):
    """Degrees, components and metrics over all consecutive pairs, by brute force."""
    orders = {}
    for r in spark.read.parquet(f"{small}/lineitem.parquet").collect():
        orders.setdefault(r.l_orderkey, []).append((r.l_linenumber, r.l_partkey, r.l_suppkey))
    pairs = {(a[1], b[1]) for rows in orders.values() for a, b in pairwise(sorted(rows))}
    events = sorted((r.ts, r.event_id, r.user_id) for r in spark.read.parquet(f"{small}/events.parquet").collect())
    users = {(a[2], b[2]) for a, b in pairwise(events) if a[2] != b[2]}

    def components(edges):
        after = {}
        for a, b in edges:
            after.setdefault(a, set()).add(b)
            after.setdefault(b, set())
        reach = {}
        for a in after:
            seen, todo = {a}, [a]
            while todo:
                new = after[todo.pop()] - seen
                seen |= new
                todo += new
            reach[a] = seen
        return {a: min(b for b in reach[a] if a in reach[b]) for a in after}

    for name, edges in (("sccs_whole", pairs), ("sccs_users_whole", users)):
        assert {r.id: r.scc for r in QUERIES[name](spark, small).collect()} == components(edges)
    functions = {p.p_partkey for p in spark.read.parquet(f"{small}/part.parquet").collect() if p.p_partkey % 10 < 8}
    calls = {(a, b) for a, b in pairs if a in functions and b in functions}
    got = {r.id: (r.in_degree, r.out_degree) for r in QUERIES["degrees_whole"](spark, small).collect()}
    assert got == {k: (sum(b == k for _, b in calls), sum(a == k for a, _ in calls)) for k in functions}
    (m,) = QUERIES["graph_metrics_whole"](spark, small).collect()
    sizes = Counter(components(calls).values())
    assert (m.n_nodes, m.n_edges, m.n_cycles) == (len(functions), len(calls), sum(n > 1 for n in sizes.values()))
