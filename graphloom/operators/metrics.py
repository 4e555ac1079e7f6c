"""Degrees, depths and counts of the call graph, and symbols that nothing uses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import like_escape
from graphloom.operators.scc import cycles, strong_components
from graphloom.operators.traverse import all_distances, oriented
from graphloom.runtime import stage
from graphloom.schema import CALLS, CONTAINS, FUNCTION, METHOD

# Names and paths that are never reported as unused.
LIVE_NAMES = (
    "lock", "guard", "write_lock", "lk", "buffer", "db", "svc",
    "arg", "lock_guard", "unique_lock", "scoped_lock",
    "sf", "tf", "cf", "epsf", "csf", "base", "out",
    "futures", "send_times", "locals", "guard",
    "await_ready", "await_suspend", "await_resume",
    "operator()", "operator co_await",
    "get_return_object", "initial_suspend", "final_suspend",
    "return_value", "return_void", "unhandled_exception",
    "promise_type", "FinalAwaiter", "Awaiter",
)
LIVE_NAME_PATTERNS = ("%::main", "~%", "%::%::await\\_%")
LIVE_PATHS = ("%build%", "%.pb.%", "%.h", "%.hpp", "%tests/%", "%test/%", "%benchmarks/%", "%demo/%", "%example%")


def functions_of(nodes: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Functions and methods; with ``files``, those of indexed files only."""
    found = nodes.where(F.col("kind").isin(FUNCTION, METHOD))
    if files is not None:
        found = found.join(files.select(F.col("path").alias("p_")).distinct(), F.col("file_path") == F.col("p_"), "left_semi")
    return found


def inner_calls(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Calls between the nodes."""
    a, b = nodes.select(F.col("id").alias("a_")), nodes.select(F.col("id").alias("b_"))
    calls = edges.where(F.col("kind") == CALLS)
    return calls.join(a, F.col("source_id") == F.col("a_"), "left_semi").join(b, F.col("target_id") == F.col("b_"), "left_semi")


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(id, name, in_degree, out_degree)``, parallel edges counted."""
    return _degrees(nodes, inner_calls(nodes, edges))


def _degrees(nodes: DataFrame, calls: DataFrame) -> DataFrame:
    ends = calls.select(F.col("target_id").alias("k"), F.lit(1).alias("i"), F.lit(0).alias("o")).unionByName(calls.select(F.col("source_id").alias("k"), F.lit(0).alias("i"), F.lit(1).alias("o")))
    sums = ends.groupBy("k").agg(F.sum("i").alias("i"), F.sum("o").alias("o"))
    return nodes.join(sums, F.col("id") == F.col("k"), "left").select("id", "name", F.coalesce("i", F.lit(0)).cast("long").alias("in_degree"), F.coalesce("o", F.lit(0)).cast("long").alias("out_degree"))


def top_degrees(deg: DataFrame, column: str, n: int = 10) -> DataFrame:
    return deg.orderBy(F.desc(column), "id").limit(n).where(F.col(column) > 0).select("id", "name", F.col(column).alias("degree"))


def depths(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(entry, depth)``: the farthest call distance from each node that is called by none or named main."""
    return _depths(nodes, stage(inner_calls(nodes, edges), "inner-calls"))


def _depths(nodes: DataFrame, calls: DataFrame) -> DataFrame:
    entries = _degrees(nodes, calls).where("in_degree = 0 or name = 'main'").select(F.col("id").alias("source"))
    reach = all_distances(oriented(calls), entries)
    return reach.groupBy(F.col("source").alias("entry")).agg(F.max("depth").alias("depth"))


def graph_metrics(nodes: DataFrame, edges: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """One row: functions, calls, cycles, greatest and mean call depth (over entries that call something)."""
    own = stage(functions_of(nodes, files).select("id", "name"), "functions")
    calls = stage(inner_calls(own, edges).select("id", "source_id", "target_id", "kind"), "inner-calls")
    deep = _depths(own, calls).agg(F.coalesce(F.max("depth"), F.lit(0)).cast("long").alias("max_depth"), F.coalesce(F.round(F.avg("depth"), 6), F.lit(0.0)).alias("avg_depth"))
    rings = cycles(strong_components(calls)).agg(F.count("*").alias("n_cycles"))
    return own.agg(F.count("*").alias("n_nodes")).crossJoin(calls.agg(F.count("*").alias("n_edges"))).crossJoin(rings).crossJoin(deep)


def dead_code(nodes: DataFrame, edges: DataFrame, exclude_pattern: str = "") -> DataFrame:
    """Functions and methods that no edge but containment reaches, apart from names and paths that are taken to be in use."""
    name, path = F.col("name"), F.col("file_path")
    found = nodes.where(F.col("kind").isin(FUNCTION, METHOD) & (name != "main"))
    found = found.where(F.col("qualified_name").isNull() | (F.col("qualified_name") == "") | (F.col("qualified_name") == name))
    found = found.where(~name.isin(*dict.fromkeys(LIVE_NAMES)))
    for pattern in LIVE_NAME_PATTERNS:
        found = found.where(~name.ilike(pattern))
    for pattern in (*LIVE_PATHS, *([f"%{like_escape(exclude_pattern)}%"] if exclude_pattern else [])):
        found = found.where(~path.ilike(pattern))
    used = edges.where(F.col("kind") != CONTAINS).select(F.col("target_id").alias("u_"))
    return found.join(used, F.col("id") == F.col("u_"), "left_anti").orderBy("file_path", "line", "id")
