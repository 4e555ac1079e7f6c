"""The registry of queries, and a sample of them against their SQL."""

import duckdb
import pytest

import __spark_entry__ as entry
from graphloom.plans.queries import ORACLE, QUERIES
from graphloom.sources.tables import TABLES


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert entry.oracle_sql().keys() <= entry.queries().keys() and len(QUERIES) > 50


@pytest.mark.parametrize("name", sorted(set(ORACLE) & {"callees_d3", "resolve_refs", "sccs_users", "fts_bm25", "change_impact", "parse_hunks", "find_by_name_fuzzy", "dot_lines", "context_class", "extract_symbols", "extract_calls", "index_after_edit", "impact_walk", "reverse_path_nodes", "fts_search", "snapshots", "embedding_counts", "context_edges", "insert_edges_refused"}))
def test_sql_twin(spark, small, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{small}/{t}.parquet')")
    want = db.execute(ORACLE[name])
    columns = [c[0] for c in want.description]
    df = QUERIES[name](spark, small)
    assert sorted(df.columns) == sorted(columns)
    text = lambda v: f"{v:.6f}" if isinstance(v, float) else str(v)
    assert sorted(tuple(text(r[c]) for c in columns) for r in df.collect()) == sorted(tuple(text(v) for v in r) for r in want.fetchall())


def test_indexed_sources(spark, small):
    rows = {(r.source_name, r.target_name) for r in QUERIES["index_sources"](spark, small).where("kind = 'calls'").collect()}
    assert rows == {("m::add", "twice"), ("m::C::f", "m::add"), ("main", "m::add"), ("f", "g"), ("g", "f")}
