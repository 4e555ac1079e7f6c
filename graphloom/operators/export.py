"""Graphs as lines of DOT."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import shorten
from graphloom.operators.traverse import distances, from_ids, oriented
from graphloom.schema import CLASS, CONTAINS, FUNCTION, METHOD, STRUCT, edge_kind_name

# Fill colours of functions and methods, of classes and structs, of the rest.
CODE_COLOUR, TYPE_COLOUR, OTHER_COLOUR = "#E3F2FD", "#E8F5E9", "#FFF3E0"


def escape(value: Column) -> Column:
    """Backslashes before the characters that DOT labels treat specially."""
    return F.replace(F.regexp_replace(value, r'(["<>{}|\\\\])', r"\\$1"), F.lit("\n"), F.lit("\\n"))


def neighbourhood(nodes: DataFrame, edges: DataFrame, id_: int, depth: int = 2) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges around a symbol: callers and callees within ``depth``, itself, and the files that hold them."""
    start = from_ids(edges, id_)
    near = distances(oriented(edges), start, depth).select("node_id").unionByName(distances(oriented(edges, reverse=True), start, depth).select("node_id"))
    ids = near.unionByName(start.select(F.col("source").alias("node_id"))).distinct()
    holders = edges.where(F.col("kind") == CONTAINS).join(ids, F.col("target_id") == F.col("node_id"), "left_semi").select(F.col("source_id").alias("node_id"))
    ids = ids.unionByName(holders).distinct()
    return nodes.join(ids, F.col("id") == F.col("node_id"), "left_semi"), edges


def whole(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    return nodes.where(F.col("kind").isin(1, 2, 3, 4)), edges


def dot_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(ord, line)`` of nodes and of the edges with both ends among them; each node once."""
    colour = F.when(F.col("kind").isin(FUNCTION, METHOD), CODE_COLOUR).when(F.col("kind").isin(CLASS, STRUCT), TYPE_COLOUR).otherwise(OTHER_COLOUR)
    unique = nodes.dropDuplicates(["id"])
    signature = F.coalesce(F.col("signature"), F.lit(""))
    label = F.when(signature != "", F.concat(escape(F.col("name")), F.lit("\\n"), escape(shorten(signature, 50)))).otherwise(escape(F.col("name")))
    head = unique.select(F.lit(1).alias("part"), "id", F.format_string('  n%d [label="%s", fillcolor="%s"];', "id", label, colour).alias("line"))
    ends = unique.select(F.col("id").alias("e_"))
    inner = edges.join(ends, F.col("source_id") == F.col("e_"), "left_semi").join(ends.withColumnRenamed("e_", "f_"), F.col("target_id") == F.col("f_"), "left_semi")
    tail = inner.select(F.lit(2).alias("part"), "id", F.format_string('  n%d -> n%d [label="%s"];', "source_id", "target_id", edge_kind_name(F.col("kind"))).alias("line"))
    return head.unionByName(tail)


def dot_text(nodes: DataFrame, edges: DataFrame) -> str:
    lines = [r.line for r in dot_lines(nodes, edges).orderBy("part", "id", "line").toLocalIterator()]
    return "\n".join(["digraph symbols {", "  rankdir=LR;", '  node [shape=box, style=filled, fontname="Courier"];', *lines, "}"])


