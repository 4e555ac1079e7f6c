"""Questions over a store as JSON: a table of tools, a cache by snapshot, and a loop of requests and answers."""

from __future__ import annotations

import json
import sys
from collections import OrderedDict
from collections.abc import Callable
from time import monotonic
from typing import IO, Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import context, diffimpact, fts, semantic, traverse
from graphloom.operators.lookup import find_by_name, pick_best
from graphloom.operators.store import Graph, Store
from graphloom.schema import NODE_KINDS
from graphloom.sources.diff import git_diff, hunks_of

# Codes of the request protocol.
PARSE_ERROR, UNKNOWN_METHOD = -32700, -32601
#: Answers that are kept, and for how many seconds; those of the others depend on more than the store.
CACHED, CACHED_S = 100, 30.0
UNCACHED = ("search_semantic", "change_impact")


def node_dict(row: Any, detail: bool = False) -> dict:
    """A node as the answers show it; a signature only where there is one, unless details are asked for."""
    out = {"id": row["id"]} if detail else {}
    out |= {"kind": NODE_KINDS[row["kind"]] if row["kind"] < len(NODE_KINDS) else "unknown", "name": row["name"], "file": row["file_path"], "line": row["line"]}
    if detail or row["signature"]:
        out["signature"] = row["signature"]
    return out


class Tools:
    """The tools of one store. Answers are remembered for the snapshot they were made from."""

    def __init__(self, spark: SparkSession, store: Store, root: str = ".", encoder: Callable = semantic.hashing_encoder):
        self.spark, self.store, self.root, self.encoder = spark, store, root, encoder
        self.cache: OrderedDict[tuple, dict] = OrderedDict()
        self.table: dict[str, tuple[Callable[..., dict], dict[str, Any]]] = {
            "search": (self.search, {"query": str, "limit": 20}),
            "context": (self.context, {"symbol": str, "limit": 10, "max_depth": 3}),
            "callers": (self.callers, {"symbol": str, "max_depth": 3}),
            "callees": (self.callees, {"symbol": str, "max_depth": 3}),
            "impact": (self.impact, {"symbol": str, "max_depth": 5}),
            "node": (self.node, {"symbol": str}),
            "status": (self.status, {}),
            "files": (self.files, {}),
            "search_semantic": (self.search_semantic, {"query": str, "limit": 10}),
            "change_impact": (self.change_impact, {"ref": ""}),
        }

    def graph(self) -> Graph:
        return self.store.load()

    def call(self, name: str, **args: Any) -> dict:
        """The answer of a tool; KeyError for an unknown one."""
        tool = self.table[name][0]
        key = (name, json.dumps(args, sort_keys=True), self.store.version())
        if name in UNCACHED:
            return tool(**args)
        if key in self.cache and monotonic() - self.cache[key][0] < CACHED_S:
            self.cache.move_to_end(key)
            return self.cache[key][1]
        answer = tool(**args)
        self.cache[key] = (monotonic(), answer)
        self.cache.move_to_end(key)
        while len(self.cache) > CACHED:
            self.cache.popitem(last=False)
        return answer

    def search(self, query: str, limit: int = 20) -> dict:
        return {"results": [node_dict(r) for r in fts.search(self.graph().nodes, query, limit, self.store.postings()).collect()]}

    def _start(self, symbol: str) -> Any:
        return pick_best(find_by_name(self.graph().nodes, symbol, 5)).first()

    def _walk(self, symbol: str, walk: Callable[..., DataFrame], max_depth: int, label: str) -> dict:
        found = self._start(symbol)
        if found is None:
            return {"error": f"Symbol not found: {symbol}"}
        g = self.graph()
        rows = walk(g.edges, traverse.from_ids(g.edges, found["id"]), max_depth)
        first = rows.where("is_first").select("node_id", "depth", "ord")
        nodes = g.nodes.join(first, F.col("id") == F.col("node_id")).orderBy("depth", "ord").collect()
        return {"symbol": node_dict(found), label: [node_dict(r) | {"depth": r["depth"]} for r in nodes]}

    def callers(self, symbol: str, max_depth: int = 3) -> dict:
        return self._walk(symbol, traverse.callers, max_depth, "callers")

    def callees(self, symbol: str, max_depth: int = 3) -> dict:
        return self._walk(symbol, traverse.callees, max_depth, "callees")

    def impact(self, symbol: str, max_depth: int = 5) -> dict:
        return self._walk(symbol, traverse.impact, max_depth, "impact")

    def context(self, symbol: str, limit: int = 10, max_depth: int = 3) -> dict:
        g = self.graph()
        found = context.build_context(g.nodes, g.edges, symbol, limit, max_depth)
        if found is None:
            return {"error": f"Symbol not found: {symbol}"}
        ids = found[1].select("id", "role").collect()
        nodes = {r["id"]: r for r in g.nodes.where(F.col("id").isin(*{r["id"] for r in ids})).collect()} if ids else {}
        edges = [{"source": r["source_id"], "target": r["target_id"], "kind": "calls"} for r in found[2].orderBy("id").collect()]
        roles = {"caller": "callers", "callee": "callees", "method": "methods"}
        out: dict[str, Any] = {"symbol": node_dict(found[0]), "callers": [], "callees": [], "edges": edges}
        for r in ids:
            out.setdefault(roles[r["role"]], []).append(node_dict(nodes[r["id"]]))
        return out

    def node(self, symbol: str) -> dict:
        found = self._start(symbol)
        return {"error": f"Symbol not found: {symbol}"} if found is None else node_dict(found, detail=True)

    def status(self) -> dict:
        row = self.graph().counts().first()
        return {"nodes": row["n_nodes"], "edges": row["n_edges"], "files": row["n_files"]}

    def files(self) -> dict:
        return {"files": [{"path": r["path"], "language": r["language"]} for r in self.graph().files.orderBy("path").collect()]}

    def search_semantic(self, query: str, limit: int = 10) -> dict:
        nodes = self.graph().nodes
        stored = self.store.embeddings()
        # Only nodes that have come since the vectors were stored are encoded now.
        vectors = semantic.current(nodes, stored).unionByName(semantic.embed(semantic.missing(nodes, stored), self.encoder))
        rows = semantic.search_semantic(nodes, vectors, query, limit, self.encoder).collect()
        return {"results": [node_dict(r) | {"similarity": r["similarity"]} for r in rows]}

    def change_impact(self, ref: str = "", diff: str | None = None) -> dict:
        g = self.graph()
        hunks = hunks_of(self.spark, git_diff(ref, self.root) if diff is None else diff)
        rows = diffimpact.change_impact(g.nodes, g.edges, hunks)
        named = g.nodes.join(rows.withColumnRenamed("id", "k"), F.col("id") == F.col("k")).orderBy("id").collect()
        pick = lambda role: [node_dict(r) for r in named if r["role"] == role]
        files = [r[0] for r in hunks.select("file_path").distinct().orderBy("file_path").collect()]
        return {"changed_files": files, "affected_symbols": pick("affected"), "impact": pick("impact")}

    # -- requests -----------------------------------------------------------------------------------------

    def schema(self) -> list[dict]:
        """Names and parameters of the tools."""
        kinds = {str: "string", int: "integer"}
        out = []
        for name, (_, args) in self.table.items():
            properties = {k: {"type": kinds[v if isinstance(v, type) else type(v)]} | ({} if isinstance(v, type) else {"default": v}) for k, v in args.items()}
            out.append({"name": name, "inputSchema": {"type": "object", "properties": properties, "required": [k for k, v in args.items() if isinstance(v, type)]}})
        return out

    def answer(self, line: str) -> dict | None:
        """The reply to one request; None for a notification."""
        try:
            request = json.loads(line)
            method = request.get("method", "")
        except (ValueError, AttributeError):
            return {"jsonrpc": "2.0", "id": None, "error": {"code": PARSE_ERROR, "message": "Parse error"}}
        if "id" not in request:
            return None
        reply = {"jsonrpc": "2.0", "id": request["id"]}
        if method == "initialize":
            return reply | {"result": {"protocolVersion": "2024-11-05", "capabilities": {"tools": {}}, "serverInfo": {"name": "graphloom", "version": "1"}}}
        if method == "tools/list":
            return reply | {"result": {"tools": self.schema()}}
        if method == "tools/call":
            params = request.get("params", {})
            try:
                result, failed = self.call(params.get("name", ""), **params.get("arguments", {})), False
            except KeyError:
                result, failed = {"error": f"Unknown tool: {params.get('name', '')}"}, True
            except TypeError as e:
                result, failed = {"error": str(e)}, True
            body = {"content": [{"type": "text", "text": json.dumps(result, ensure_ascii=False)}]}
            return reply | {"result": body | ({"isError": True} if failed or "error" in result else {})}
        return reply | {"error": {"code": UNKNOWN_METHOD, "message": f"Method not found: {method}"}}

    def serve(self, lines: IO[str] = sys.stdin, out: IO[str] = sys.stdout) -> None:
        for line in lines:
            if line.strip() and (reply := self.answer(line)) is not None:
                print(json.dumps(reply, ensure_ascii=False), file=out, flush=True)
