"""What surrounds a symbol: callers, callees, and for a class those of its methods."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import partner_file
from graphloom.operators.fts import search
from graphloom.operators.lookup import find_by_name, pick_best
from graphloom.operators.traverse import distances, from_ids, oriented
from graphloom.schema import CALLS, CLASS, FUNCTION, METHOD, STRUCT


def find_symbol(nodes: DataFrame, symbol: str) -> DataFrame:
    """The best node for a name, else for a search; no row if there is none."""
    best = pick_best(find_by_name(nodes, symbol, 5))
    if best.limit(1).count():
        return best
    hits = search(nodes, symbol, 5).withColumn("lookup_rank", F.col("id"))
    return pick_best(hits)


def methods_of(nodes: DataFrame, cls: DataFrame) -> DataFrame:
    """Functions of the class's file and its partner source whose qualified names hold ``Class::``."""
    c = cls.select(F.col("id").alias("class_id"), F.col("name").alias("c_name"), F.col("file_path").alias("c_file"))
    files = c.select("class_id", "c_name", F.explode(F.array_compact(F.array("c_file", partner_file(F.col("c_file"))))).alias("c_path"))
    own = nodes.where(F.col("kind").isin(FUNCTION, METHOD))
    return own.join(files, (F.col("file_path") == F.col("c_path")) & F.contains("qualified_name", F.concat("c_name", F.lit("::")))).drop("c_name", "c_path")


def around(nodes: DataFrame, edges: DataFrame, starts: DataFrame, limit: int = 10, max_depth: int = 3) -> DataFrame:
    """``(id, name, role)`` of callers and callees of ``starts(source)`` within ``max_depth``, nearest first, ``limit`` of each; starts left out."""
    out = None
    for role, reverse in (("caller", True), ("callee", False)):
        reach = distances(oriented(edges, reverse=reverse), starts, max_depth).groupBy("node_id").agg(F.min("depth").alias("depth"))
        reach = reach.join(starts.select(F.col("source").alias("s_")), F.col("node_id") == F.col("s_"), "left_anti")
        rows = nodes.join(reach, F.col("id") == F.col("node_id")).orderBy("depth", "id").limit(limit).select("id", "name", "depth", F.lit(role).alias("role"))
        out = rows if out is None else out.unionByName(rows)
    return out


def edges_around(edges: DataFrame, starts: DataFrame, rows: DataFrame, max_depth: int = 3) -> DataFrame:
    """Call edges of the walks to the callers and callees among ``rows(id, role)``: those between rows of a role, or a row and a start; each edge once."""
    ids = starts.select(F.col("source").alias("id"))
    calls = edges.where(F.col("kind") == CALLS).select("id", "source_id", "target_id")
    out = None
    for role in ("caller", "callee"):
        ends = rows.where(F.col("role") == role).select("id").unionByName(ids).distinct()
        a, b = (ends.select(F.col("id").alias(c)) for c in ("a_", "b_"))
        found = calls.join(a, F.col("source_id") == F.col("a_")).join(b, F.col("target_id") == F.col("b_")).select("id", "source_id", "target_id")
        out = found if out is None else out.unionByName(found)
    return out.dropDuplicates(["id"])


def build_context(nodes: DataFrame, edges: DataFrame, symbol: str, limit: int = 10, max_depth: int = 3) -> tuple[dict, DataFrame, DataFrame] | None:
    """The symbol as a dict, the rows around it and the edges between them; of a class the rows around its methods, and the methods. None if nothing is found."""
    found = find_symbol(nodes, symbol).first()
    if found is None:
        return None
    spark = nodes.sparkSession
    if found["kind"] in (CLASS, STRUCT):
        methods = methods_of(nodes, spark.createDataFrame([(found["id"], found["name"], found["file_path"])], "id long, name string, file_path string"))
        starts = methods.select(F.col("id").alias("source")).distinct()
        rows = around(nodes, edges, starts, limit, max_depth)
        links = edges_around(edges, starts, rows, max_depth)
        rows = rows.unionByName(methods.select("id", "name", F.lit(0).alias("depth"), F.lit("method").alias("role")))
    else:
        starts = from_ids(edges, found["id"])
        rows = around(nodes, edges, starts, limit, max_depth)
        links = edges_around(edges, starts, rows, max_depth)
    return found.asDict(), rows, links
