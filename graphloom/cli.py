"""Commands: ``python -m graphloom.cli COMMAND``."""

from __future__ import annotations

import argparse
import json
import os
import sys
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from graphloom.operators import export, fts, metrics, scc, semantic, traverse
from graphloom.operators.store import Store
from graphloom.plans.index import index_tree, unresolved
from graphloom.tools import Tools, node_dict

FOLDER = ".graphloom"


def find_store(start: str = ".") -> str | None:
    """The nearest store folder at or above ``start``."""
    at = os.path.abspath(start)
    while True:
        if os.path.isdir(os.path.join(at, FOLDER)):
            return os.path.join(at, FOLDER)
        if os.path.dirname(at) == at:
            return None
        at = os.path.dirname(at)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="graphloom")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, *args: tuple[str, dict]) -> None:
        c = sub.add_parser(name)
        c.add_argument("--store")
        for a, k in args:
            c.add_argument(a, **k)

    path, symbol = ("path", {"nargs": "?", "default": "."}), ("symbol", {})
    limit = ("--limit", {"type": int, "default": 20})
    depth = lambda n: ("--depth", {"type": int, "default": n})
    add("init", path, ("--index", {"action": "store_true"}))
    add("index", path)
    add("search", ("query", {}), limit)
    add("context", symbol, ("--limit", {"type": int, "default": 10}), depth(3))
    add("callers", symbol, depth(3))
    add("callees", symbol, depth(3))
    add("impact", symbol, depth(5))
    add("path", ("start", {}), ("end", {}), depth(10))
    add("cycles")
    add("metrics", ("--top", {"type": int, "default": 10}))
    add("impact-chain", symbol, depth(5))
    add("dead-code", ("--exclude", {"default": ""}))
    add("change-impact", ("ref", {"nargs": "?", "default": ""}))
    add("export-dot", ("symbol", {"nargs": "?"}), depth(2))
    add("search-semantic", ("query", {}), ("--top", {"type": int, "default": 10}))
    add("embed", ("out", {"nargs": "?"}))
    add("status")
    add("files")
    add("watch", path)
    add("serve")
    return p


def run(spark: SparkSession, argv: list[str]) -> Any:
    """The result of a command: text, or what is printed as JSON."""
    a = parser().parse_args(argv)
    if a.command in ("init", "index", "watch"):
        root = os.path.abspath(a.path)
        store = Store(spark, a.store or os.path.join(root, FOLDER))
        os.makedirs(store.root, exist_ok=True)
        if a.command == "watch":
            from graphloom.streaming.watch import watch

            watch(spark, root, store, os.path.join(store.root, "stream")).awaitTermination()
        return index_tree(spark, root, store, a.command == "index") if a.command == "index" or a.index else {"store": store.root}
    where = a.store or find_store()
    if where is None:
        return {"error": "no index here; run init first"}
    store = Store(spark, where)
    tools, g = Tools(spark, store, os.path.dirname(where)), store.load()
    if a.command == "serve":
        return tools.serve()
    if a.command == "search":
        rows = fts.search(g.nodes, a.query, a.limit, tools.store.postings()).collect()
        sizes = g.files.where(F.col("path").isin(*{r["file_path"] for r in rows})).agg(F.sum("size")).first()[0] if rows else 0
        lines = [" ".join([n["kind"], n["name"], "@", f"{n['file']}:{n['line']}", n.get("signature", "")]).rstrip() for n in map(node_dict, rows)]
        text = "\n".join(lines)
        print(f"tokens: {len(text.encode()) // 4} of {(sizes or 0) // 4} in the files", file=sys.stderr)
        return text
    if a.command in ("callers", "callees", "impact"):
        return tools.call(a.command, symbol=a.symbol, max_depth=a.depth)
    if a.command == "context":
        return tools.call("context", symbol=a.symbol, limit=a.limit, max_depth=a.depth)
    if a.command in ("status", "files"):
        return tools.call(a.command) | ({"unresolved": unresolved(g).count()} if a.command == "status" else {})
    if a.command == "change-impact":
        return tools.call("change_impact", ref=a.ref)
    if a.command == "search-semantic":
        return tools.call("search_semantic", query=a.query, limit=a.top)
    if a.command == "embed":
        vectors = semantic.embed(g.nodes)
        if a.out:
            vectors.write.mode("overwrite").parquet(a.out)
            return {"embedded": spark.read.parquet(a.out).count()}
        tools.store.save_embeddings(vectors)
        return {"embedded": semantic.counts(g.nodes, tools.store.embeddings()).first()["n_embedded"]}
    if a.command in ("path", "impact-chain", "export-dot"):
        names = [x for x in (getattr(a, k, None) for k in ("start", "end", "symbol")) if x]
        found = [tools._start(n) for n in names]
        if None in found:
            return {"error": f"Symbol not found: {names[found.index(None)]}"}
        if a.command == "path":
            ids = traverse.find_path(g.edges, found[0]["id"], found[1]["id"], a.depth)
            by = {r["id"]: node_dict(r) for r in g.nodes.where(F.col("id").isin(*ids)).collect()} if ids else {}
            return {"found": bool(ids), "hops": max(0, len(ids) - 1), "n_nodes": len(ids), "path": [by[i] for i in ids]}
        if a.command == "export-dot":
            return export.dot_text(*(export.neighbourhood(g.nodes, g.edges, found[0]["id"], a.depth) if found else export.whole(g.nodes, g.edges)))
        rows = traverse.impact_chain(g.edges, traverse.from_ids(g.edges, found[0]["id"]), a.depth)
        named = g.nodes.select("id", "name")
        return {"symbol": node_dict(found[0]), "chains": [{"node": r["name"], "depth": r["depth"], "path": list(r["path"])} for r in rows.join(named, F.col("node_id") == F.col("id")).orderBy("depth", "ord").collect()]}
    own = metrics.functions_of(g.nodes, g.files)
    if a.command == "cycles":
        members = scc.cycle_members(scc.strong_components(metrics.inner_calls(own, g.edges)))
        rows = members.join(g.nodes, "id").groupBy("scc").agg(F.sort_array(F.collect_list(F.struct("id", "name"))).alias("m")).orderBy("scc").collect()
        return {"cycles": [[m["name"] for m in r["m"]] for r in rows]}
    if a.command == "metrics":
        deg = metrics.degrees(own, g.edges)
        top = {k: [{"name": r["name"], "count": r["degree"]} for r in metrics.top_degrees(deg, c, a.top).collect()] for k, c in (("most_called", "in_degree"), ("most_calling", "out_degree"))}
        return metrics.graph_metrics(g.nodes, g.edges, g.files).first().asDict() | top
    return {"dead_code": [node_dict(r) for r in metrics.dead_code(g.nodes, g.edges, a.exclude).collect()]}


def main() -> None:
    spark = SparkSession.builder.appName("graphloom").config("spark.ui.enabled", "false").getOrCreate()
    out = run(spark, sys.argv[1:])
    if out is not None:
        print(out if isinstance(out, str) else json.dumps(out, indent=2, ensure_ascii=False))


if __name__ == "__main__":
    main()
