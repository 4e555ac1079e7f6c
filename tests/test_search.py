"""Full-text search against an independent engine, semantic search, diffs."""

import math
import re
import sqlite3
import unicodedata
from collections import Counter

import pytest

from graphloom.functions.text import cosine
from graphloom.operators import fts, semantic
from graphloom.plans.queries import QUERIES
from graphloom.sources import diff
from graphloom.sources.tables import part_edges

ROWS = [
    (1, 1, "test_func", "ns::test_func", "int test_func(int a)", "", "./src/a.cpp"),
    (2, 1, "caller_func", "caller_func", "void caller_func()", "calls test func", "./src/a.cpp"),
    (3, 3, "Crème", "Crème", "", "sweet", "./src/b.cpp"),
    (4, 7, "alpha", "ns::alpha", "", "", "./src/b.cpp"),
    (5, 2, "alphaBeta", "ns::alphaBeta", "bool alphaBeta()", "alpha then beta", "./src/alpha.cpp"),
    (6, 1, "f", "f", "", "", "./x.cpp"),
]
SCHEMA = "id long, kind int, name string, qualified_name string, signature string, docstring string, file_path string"


@pytest.fixture(scope="module")
def nodes(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.mark.parametrize("query", ["test_func", "ns::test_func", "alpha", "creme", "src", "alpha beta", "caller func", "func() test", "cpp", "zzz", "alpha OR func", "func NOT caller", "alpha AND beta OR creme", "src NOT alpha beta OR caller_func", "src NOT alpha NOT func", "cpp AND src NOT zzz", "or not and", "___ alpha", "___ OR alpha", "alpha AND ___", "src NOT ___", "alpha OR (beta)"])
def test_scores(nodes, query):
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE t USING fts5(name, qualified_name, signature, docstring, file_path)")
    db.executemany("INSERT INTO t(rowid, name, qualified_name, signature, docstring, file_path) VALUES (?,?,?,?,?,?)", [(r[0], *r[2:]) for r in ROWS])
    plain = all(c.isalnum() or c in "_ " for c in query)
    match = query if plain else '"' + query.replace('"', '""') + '"'
    want = {i: round(s, 5) for i, s in db.execute("SELECT rowid, bm25(t) FROM t WHERE t MATCH ?", (match,))}
    assert {r.id: round(r.score, 5) for r in fts.bm25(fts.postings(nodes), query).collect()} == pytest.approx(want, abs=2e-5)


def test_operators_bind():
    is_ = lambda n: ("IS", n)
    assert fts.parse_query("a b OR c AND d NOT e f") == ([[x] for x in "abcdef"], ("OR", ("AND", is_(0), is_(1)), ("AND", is_(2), ("NOT", is_(3), ("AND", is_(4), is_(5))))))
    assert all(fts.parse_query(q) == ([], None) for q in ("AND", "a OR", "NOT a", "a AND OR b", "", " _ "))
    assert fts.parse_query("a NOT(b)") == ([["a", "not", "b"]], ("IS", 0))


def test_search_ranks_kinds(nodes):
    assert [r.id for r in fts.search(nodes, "alpha").collect()] == [5, 4]
    assert fts.search(nodes, "").collect() == [] and fts.search(nodes, "::").collect() == []
    assert [r.id for r in fts.search(nodes, "NOT alpha").collect()] == []


def test_semantic(spark, nodes):
    vectors = semantic.embed(nodes)
    assert vectors.count() == len(ROWS)
    assert semantic.search_semantic(nodes, vectors, "function alphaBeta alpha then beta", 1).first().id == 5
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, 1.0]), (4, [2.0, 0.0])], "node_id long, embedding array<float>")
    assert [(r.node_id, r.similarity) for r in semantic.nearest(rows, [1.0, 0.0]).collect()] == [(1, 1.0), (4, 1.0), (3, 0.7071), (2, 0.0)]
    assert cosine is not None


def test_blobs_and_refreshed_postings(spark, nodes):
    rows = spark.createDataFrame([(1, [1.0, -0.5]), (2, []), (3, None)], "i int, v array<float>")
    blob = rows.select("i", semantic.to_blob("v").alias("b"))
    assert [r.b and len(r.b) for r in blob.orderBy("i").collect()] == [8, b"", None]
    assert [r.v for r in blob.select("i", semantic.from_blob("b").alias("v")).orderBy("i").collect()] == [[1.0, -0.5], [], None]
    changed = spark.createDataFrame([(1, 1, "renamed", None, None, None, None), (2, 1, None, None, None, None, None), (7, 1, "new", "new", "", "", "")], SCHEMA)
    got = fts.refresh_postings(fts.postings(nodes), changed)
    assert {r.token for r in got.where("id = 1").collect()} == {"renamed"} and got.where("id = 2").count() == 0 and got.where("id = 7").count() == 2
    assert got.where("id = 5").count() == fts.postings(nodes).where("id = 5").count()


DIFF = """diff --git a/x.cpp b/x.cpp
--- a/x.cpp
+++ b/x.cpp
@@ -1 +1 @@
-a
+b
@@ -10,0 +11,3 @@ void f()
+q
@@ -20,4 +23,0 @@
-gone
--- a/d/y.py
+++ b/d/y.py
@@ -3,2 +4,2 @@ class C:
+z
--- a/old
+++ /dev/null
"""


def test_hunks(spark):
    got = [(r.file_path, r.line_start, r.line_end) for r in diff.hunks_of(spark, DIFF).orderBy("file_path", "line_start").collect()]
    assert got == [("./d/y.py", 4, 5), ("./x.cpp", 1, 1), ("./x.cpp", 11, 13)]
    assert diff.hunks_of(spark, "").collect() == []


def test_event_hunks_whole(spark, small):
    """Every event is a hunk; symbols and impact by brute force."""
    parts = spark.read.parquet(f"{small}/part.parquet").collect()
    keys = {p.p_partkey: p for p in parts}
    hunks = {}
    for r in spark.read.parquet(f"{small}/events.parquet").select("event_id", "props").collect():
        p = keys.get(r.event_id % len(parts))
        if p is not None:
            start = int(re.search("[0-9]+", r.props)[0])
            hunks.setdefault((p.p_type, p.p_brand), []).append((start, start + r.event_id % 5))
    want = {p.p_partkey for p in parts for a, b in hunks.get((p.p_type, p.p_brand), []) if p.p_size <= b and p.p_size + p.p_partkey % 7 >= a}
    assert {r.id for r in QUERIES["hunk_overlap"](spark, small).collect()} == want
    back = {}
    for r in part_edges(spark, small).collect():
        back.setdefault(r.target_id, set()).add(r.source_id)
    level, reached = want, set()
    for _ in range(3):
        level = {b for a in level for b in back.get(a, ())}
        reached |= level
    got = sorted((r.id, r.role) for r in QUERIES["change_impact"](spark, small).collect())
    assert got == sorted([(k, "affected") for k in want] + [(k, "impact") for k in reached - want if k in keys])


def test_hostile_ref(tmp_path):
    marker = tmp_path / "marker"
    assert diff.git_diff(f"HEAD; touch {marker}", str(tmp_path)) == "" and diff.git_diff(f"--output={marker}") == ""
    assert not marker.exists()


def test_document_queries(spark, small):
    """Postings and scores of whole documents, by brute force."""
    docs = {}
    for r in spark.read.parquet(f"{small}/documents.parquet").collect():
        text = " ".join(x or "" for x in (r.lang, r.source, r.text)).lower()
        text = "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))
        docs[r.doc_id] = Counter(re.findall(r"[^\W_]+", text))
    n, df = Counter(), Counter()
    for c in docs.values():
        n.update(c)
        df.update(c.keys())
    assert {r.token: (r.n, r.df) for r in QUERIES["fts_document_tokens"](spark, small).collect()} == {t: (n[t], df[t]) for t in n}
    mean = sum(n.values()) / len(docs)
    want = {}
    for k, c in docs.items():
        if c["the"] and c["of"]:
            norm = 1.2 * (0.25 + 0.75 * sum(c.values()) / mean)
            want[k] = -sum(max(math.log((len(docs) - df[t] + 0.5) / (df[t] + 0.5)), 1e-6) * c[t] * 2.2 / (c[t] + norm) for t in ("the", "of"))
    got = {r.id: r.score for r in QUERIES["fts_document_bm25"](spark, small).collect()}
    assert want and got == pytest.approx(want, abs=1e-6)
