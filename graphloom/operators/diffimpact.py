"""From changed lines to changed symbols to what they affect."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators.traverse import distances, oriented
from graphloom.runtime import stage
from graphloom.schema import CALLS, FILE, REFERENCES


def overlaps() -> Column:
    """Node lines meet hunk lines; a node without an end reaches to the end of its file."""
    return (F.col("line") <= F.col("line_end")) & ((F.col("end_line") >= F.col("line_start")) | (F.col("end_line") == 0))


def affected_symbols(nodes: DataFrame, hunks: DataFrame) -> DataFrame:
    """Nodes, but for files, that a hunk of their file overlaps: an equi-join on the file with the lines as residual."""
    ranges = hunks.select(F.col("file_path").alias("h_path"), "line_start", "line_end").distinct()
    return nodes.where(F.col("kind") != FILE).join(ranges, (F.col("file_path") == F.col("h_path")) & overlaps(), "left_semi")


def change_impact(nodes: DataFrame, edges: DataFrame, hunks: DataFrame, max_depth: int = 3) -> DataFrame:
    """``(id, role)``: the affected symbols, and what calls or refers to them within ``max_depth``. One traversal serves all symbols, since only the set counts."""
    affected = stage(affected_symbols(nodes, hunks).select("id").distinct(), "affected")
    pairs = stage(oriented(edges, (CALLS, REFERENCES), reverse=True).select("from_id", "to_id").distinct(), "pairs")
    level, reached = affected, None
    for _ in range(max_depth):
        level = level.join(pairs, F.col("id") == F.col("from_id")).select(F.col("to_id").alias("id")).distinct()
        reached = level if reached is None else reached.unionByName(level)
    found = affected.select("id", F.lit("affected").alias("role"))
    if reached is None:
        return found
    beyond = reached.select("id").distinct().join(affected.select(F.col("id").alias("a_")), F.col("id") == F.col("a_"), "left_anti")
    known = nodes.select(F.col("id").alias("n_"))
    return found.unionByName(beyond.join(known, F.col("id") == F.col("n_"), "left_semi").select("id", F.lit("impact").alias("role")))


def impact_sets(nodes: DataFrame, edges: DataFrame, hunks: DataFrame, max_depth: int = 3) -> DataFrame:
    """As :func:`change_impact`, but with the distance from each affected symbol."""
    affected = affected_symbols(nodes, hunks).select(F.col("id").alias("source")).distinct()
    return distances(oriented(edges, (CALLS, REFERENCES), reverse=True), affected, max_depth)
