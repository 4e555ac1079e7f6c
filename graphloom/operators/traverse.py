"""Traversals over call edges as loops of joins, one for each level.

A queue-order traversal finds a node first from the earliest parent, and keeps
every parallel edge between the two. That order is carried as an array of
(kind, edge) along the path: arrays compare element by element, so within a
level they sort as the queue would, without numbering rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.runtime import stage
from graphloom.schema import CALLS, REFERENCES

#: Rows of a level that are sent to every task.
FEW_ROWS = 300_000


def oriented(edges: DataFrame, kinds: Sequence[int] = (CALLS,), reverse: bool = False) -> DataFrame:
    """``(edge_id, from_id, to_id, turn)`` of edges of the kinds; ``turn`` is the kind's place in the order of expansion."""
    a, b = ("target_id", "source_id") if reverse else ("source_id", "target_id")
    turn = F.lit(None).cast("int")
    for i, kind in enumerate(kinds):
        turn = F.when(F.col("kind") == kind, i).otherwise(turn)
    return edges.where(F.col("kind").isin(*kinds)).select(F.col("id").alias("edge_id"), F.col(a).alias("from_id"), F.col(b).alias("to_id"), turn.alias("turn"))


def walk(steps: DataFrame, sources: DataFrame, max_depth: int | None = None, stop_at: Column | None = None) -> DataFrame:
    """Breadth-first tree edges from each row of ``sources(source)``.

    Rows ``(source, node_id, parent_id, edge_id, turn, depth, ord, path)``: each
    node by the parent that reaches it first, once for each parallel edge of that
    parent and kind. The start is never a row. ``stop_at`` ends a source's walk
    in the level after which it holds for a row.
    """
    steps = stage(steps, "steps")  # read once for each level, so not computed anew from what it is made of
    frontier = sources.select("source").distinct().select("source", F.col("source").alias("id"), F.array().cast("array<bigint>").alias("ord"), F.array("source").alias("path"))
    frontier = stage(frontier, "frontier")
    visited, levels, depth = frontier.select("source", "id"), [], 0
    while (max_depth is None or depth < max_depth) and frontier.limit(1).count():
        depth += 1
        reached = frontier.join(steps, F.col("id") == F.col("from_id")).select(
            "source", F.col("id").alias("parent_id"), "edge_id", F.col("to_id").alias("node_id"), "turn", F.col("ord").alias("before"), "path"
        )
        seen = visited.select(F.col("source").alias("s_"), F.col("id").alias("v_"))
        fresh = reached.join(seen, (F.col("source") == F.col("s_")) & (F.col("node_id") == F.col("v_")), "left_anti")
        fresh = stage(fresh, "reached")
        rank = F.struct("before", "turn")
        best = fresh.groupBy(F.col("source").alias("s_"), F.col("node_id").alias("v_")).agg(F.min(rank).alias("best"), F.min(F.struct("before", "turn", "edge_id")).alias("first"))
        won = fresh.join(best, (F.col("source") == F.col("s_")) & (F.col("node_id") == F.col("v_")) & (rank == F.col("best")))
        order = lambda edge: F.concat("before", F.array(F.col("turn").cast("long"), edge))
        level = won.select("source", "node_id", "parent_id", "edge_id", "turn", F.lit(depth).alias("depth"), order(F.col("edge_id")).alias("ord"), F.concat("path", F.array("node_id")).alias("path"), (F.col("edge_id") == F.col("first.edge_id")).alias("is_first"))
        level = stage(level, "level")
        levels.append(level)
        frontier = level.where("is_first").select("source", F.col("node_id").alias("id"), "ord", "path")
        if stop_at is not None:
            ended = level.where(stop_at).select(F.col("source").alias("s_")).distinct()
            frontier = frontier.join(ended, F.col("source") == F.col("s_"), "left_anti")
        visited = visited.unionByName(frontier.select("source", "id"))
    if not levels:
        empty = frontier.join(steps, F.lit(False)).select("source", F.col("id").alias("node_id"), F.col("id").alias("parent_id"), "edge_id", "turn", F.lit(0).alias("depth"), "ord", "path", F.lit(True).alias("is_first"))
        return empty.where(F.lit(False))
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out


def distances(steps: DataFrame, sources: DataFrame, max_depth: int) -> DataFrame:
    """``(source, node_id, depth)`` of the nodes within ``max_depth`` steps, the start left out: one plan over a table of the steps, without a loop of jobs.

    Each level holds a node once for each source, so it is no longer than sources times nodes.
    """
    pairs = stage(steps.select("from_id", "to_id").distinct(), "pairs")
    level = sources.select("source").distinct().select("source", F.col("source").alias("id"))
    found = None
    for depth in range(1, max_depth + 1):
        level = level.join(pairs, F.col("id") == F.col("from_id")).select("source", F.col("to_id").alias("id")).distinct()
        rows = level.select("source", F.col("id").alias("node_id"), F.lit(depth).alias("depth"))
        found = rows if found is None else found.unionByName(rows)
    if found is None:
        return level.select("source", F.col("id").alias("node_id"), F.lit(0).alias("depth")).where(F.lit(False))
    return found.where("node_id <> source").groupBy("source", "node_id").agg(F.min("depth").alias("depth"))


def all_distances(steps: DataFrame, sources: DataFrame) -> DataFrame:
    """``(source, node_id, depth)`` of every reachable node, the start left out, level by level to the end.

    A source without a step is left at once. A level of few rows is sent to what
    was found before, so that what was found is not dealt again for each level.
    """
    pairs = stage(steps.select("from_id", "to_id").distinct(), "pairs")
    starts = sources.select("source").distinct().join(pairs.select(F.col("from_id").alias("k")).distinct(), F.col("source") == F.col("k"), "left_semi")
    frontier = stage(starts.select("source", F.col("source").alias("node_id"), F.lit(0).alias("depth")), "distance")
    found, depth = frontier, 0
    while frontier.limit(1).count():
        depth += 1
        step = stage(frontier.join(pairs, F.col("node_id") == F.col("from_id")).select("source", F.col("to_id").alias("node_id")).distinct(), "step")
        same = (F.col("source") == F.col("s_")) & (F.col("node_id") == F.col("v_"))
        seen = found.select(F.col("source").alias("s_"), F.col("node_id").alias("v_"))
        if step.count() <= FEW_ROWS:  # by each column alone: a single long takes little room, and the pairs are compared below
            for mine, column in (("s_", "source"), ("v_", "node_id")):
                few = step.select(F.col(column).alias("k_")).distinct()
                seen = seen.join(F.broadcast(few), F.col(mine) == F.col("k_"), "left_semi")
            seen = seen.hint("merge")
        frontier = stage(step.join(seen, same, "left_anti").withColumn("depth", F.lit(depth)), "distance")
        found = found.unionByName(frontier)
    return found.where("depth > 0")


def from_ids(edges: DataFrame, *ids: int) -> DataFrame:
    return edges.sparkSession.createDataFrame([(i,) for i in ids], "source long")


def callees(edges: DataFrame, sources: DataFrame, max_depth: int = 3) -> DataFrame:
    return walk(oriented(edges), sources, max_depth)


def callers(edges: DataFrame, sources: DataFrame, max_depth: int = 3) -> DataFrame:
    return walk(oriented(edges, reverse=True), sources, max_depth)


def impact(edges: DataFrame, sources: DataFrame, max_depth: int = 5) -> DataFrame:
    """Callers and referrers; of each expanded node its callers come first."""
    return walk(oriented(edges, (CALLS, REFERENCES), reverse=True), sources, max_depth)


def find_path(edges: DataFrame, start: int, end: int, max_depth: int = 10, kinds: Sequence[int] = (CALLS,), reverse: bool = False) -> list[int]:
    """Ids of the shortest path, the one that a queue finds first; ``[start]`` if the ends agree, empty if there is none."""
    if start == end:
        return [start]
    rows = walk(oriented(edges, kinds, reverse), from_ids(edges, start), max_depth, F.col("node_id") == end)
    found = rows.where((F.col("node_id") == end) & F.col("is_first")).select("path").first()
    return list(found[0]) if found else []


def impact_chain(edges: DataFrame, sources: DataFrame, max_depth: int = 5) -> DataFrame:
    """Rows of :func:`impact` with the path over the same edges from the source to each node."""
    return impact(edges, sources, max_depth).select("source", "node_id", "edge_id", "depth", "ord", "path")
