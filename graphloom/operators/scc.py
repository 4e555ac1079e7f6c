"""Strongly connected components and cycles of the call graph."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.runtime import stage

#: Edges that one task takes at once.
LOCAL_EDGES = 1_000_000
#: Rounds in which a task drops nodes without a way in or out from its part of the edges.
CHUNK_TRIMS = 10


def strong_components(edges: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """``(id, scc)`` for each end of ``edges(source_id, target_id)``; ``scc`` is the least id of the component.

    Edges that are few enough by count go to one task. More are cut by ranges of
    their sources: the components inside a part are parts of the whole graph's, so
    each is made one node, and so on while that takes away edges. Nodes without a
    way in or out are components of themselves and are trimmed. What is left when
    the parts no longer help is coloured in rounds of joins.
    """
    pairs = stage(edges.select(F.col("source_id").alias("a"), F.col("target_id").alias("b")), "scc-edges")
    nodes = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    left, found = pairs.where("a <> b"), None
    size = left.count()
    while size > local_edges:
        labels, left = _contracted(left, -(-size // max(local_edges, 1)))
        found = labels if found is None else _then(found, labels)
        left = _trimmed(left)
        before, size = size, left.count()
        if size > 0.8 * before:
            break
    cyclic = _local(left) if size <= local_edges else _coloured(left)
    found = (cyclic if found is None else _then(found, cyclic)).select(F.col("id").alias("k"), "scc")
    return nodes.join(found, F.col("id") == F.col("k"), "left").select("id", F.coalesce("scc", "id").alias("scc"))


def _trimmed(left: DataFrame) -> DataFrame:
    for _ in range(2):  # trimming more often costs a job each and changes nothing
        left = left.join(left.select(F.col("b").alias("k")).distinct(), F.col("a") == F.col("k"), "left_semi")
        left = stage(left.join(left.select(F.col("a").alias("k")).distinct(), F.col("b") == F.col("k"), "left_semi"), "scc-trimmed")
    return left


def _contracted(pairs: DataFrame, parts: int) -> tuple[DataFrame, DataFrame]:
    """``(id, scc)`` of the nodes that join a smaller one inside a part of the edges, and the distinct edges between what is left."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [f[["a", "b"]].to_numpy(dtype="int64") for f in frames]
        if not sum(map(len, held)):
            return
        rows = np.concatenate(held)
        inner = rows
        for _ in range(CHUNK_TRIMS):
            keep = np.isin(inner[:, 1], inner[:, 0]) & np.isin(inner[:, 0], inner[:, 1])
            if keep.all():
                break
            inner = inner[keep]
        labels = {k: v for k, v in tarjan(zip(*inner.T.tolist(), strict=True)).items() if k != v}
        ids, least = np.array(sorted(labels), dtype="int64"), np.array([labels[k] for k in sorted(labels)], dtype="int64")
        if len(ids):
            at = np.minimum(np.searchsorted(ids, rows), len(ids) - 1)
            rows = np.where(ids[at] == rows, least[at], rows)
        rows = np.unique(rows[rows[:, 0] != rows[:, 1]], axis=0)
        yield pd.DataFrame({"a": ids, "b": least, "label": True})
        yield pd.DataFrame({"a": rows[:, 0], "b": rows[:, 1], "label": False})

    made = stage(pairs.repartitionByRange(parts, "a").mapInPandas(run, "a long, b long, label boolean"), "scc-parts")
    labels = made.where("label").select(F.col("a").alias("id"), F.col("b").alias("scc"))
    # sources have their labels; a target may lie in another part
    to = labels.select(F.col("id").alias("k"), "scc")
    kept = made.where("not label").select("a", "b").join(to, F.col("b") == F.col("k"), "left").select("a", F.coalesce("scc", "b").alias("b"))
    return labels, stage(kept.where("a <> b").distinct(), "scc-contracted")


def _then(first: DataFrame, later: DataFrame) -> DataFrame:
    """Labels by ``first`` and, of the graph that it left, by ``later``."""
    on = later.select(F.col("id").alias("k"), F.col("scc").alias("l"))
    return first.join(on, F.col("scc") == F.col("k"), "left").select("id", F.coalesce("l", "scc").alias("scc")).unionByName(later)


def _local(pairs: DataFrame) -> DataFrame:
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        labels = tarjan(zip(frame["a"].tolist(), frame["b"].tolist(), strict=True))
        return pd.DataFrame({"id": list(labels), "scc": list(labels.values())}, dtype="int64")

    return pairs.withColumn("g", F.lit(0)).groupBy("g").applyInPandas(run, "id long, scc long")


def tarjan(pairs: Iterator[tuple[int, int]]) -> dict[int, int]:
    """Least member of each node's component, without recursion."""
    after: dict[int, list[int]] = {}
    for a, b in pairs:
        after.setdefault(a, []).append(b)
        after.setdefault(b, [])
    number: dict[int, int] = {}
    low: dict[int, int] = {}
    label: dict[int, int] = {}
    stack: list[int] = []
    for root in after:
        if root in number:
            continue
        work = [(root, iter(after[root]))]
        number[root] = low[root] = len(number)
        stack.append(root)
        while work:
            node, children = work[-1]
            child = next(children, None)
            if child is None:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == number[node]:
                    at = len(stack) - 1
                    while stack[at] != node:
                        at -= 1
                    least = min(stack[at:])
                    for member in stack[at:]:
                        label[member] = least
                    del stack[at:]
            elif child not in number:
                number[child] = low[child] = len(number)
                stack.append(child)
                work.append((child, iter(after[child])))
            elif child not in label:
                low[node] = min(low[node], number[child])
    return label


def _spread(pairs: DataFrame, colours: DataFrame) -> DataFrame:
    """Least colour that reaches each node along ``pairs``, to the end."""
    while True:
        news = pairs.join(colours.select(F.col("id").alias("k"), F.col("colour").alias("c")), F.col("a") == F.col("k")).groupBy(F.col("b").alias("t")).agg(F.min("c").alias("m"))
        after = stage(colours.join(news, F.col("id") == F.col("t"), "left").select("id", F.col("colour").alias("old"), F.least("colour", F.coalesce("m", "colour")).alias("colour")), "colour")
        colours = after.select("id", "colour")
        if not after.where("old <> colour").limit(1).count():
            return colours


def _coloured(pairs: DataFrame) -> DataFrame:
    """Forward colours by least id; what a colour's root reaches backward inside its colour is a component; then the rest."""
    done = None
    ids = lambda p: p.select(F.col("a").alias("id")).unionByName(p.select(F.col("b").alias("id"))).distinct()
    open_ = stage(ids(pairs), "open")
    while open_.limit(1).count():
        colours = _spread(pairs, open_.withColumn("colour", F.col("id")))
        a = colours.select(F.col("id").alias("k"), F.col("colour").alias("ca"))
        b = colours.select(F.col("id").alias("k2"), F.col("colour").alias("cb"))
        inside = stage(pairs.join(a, F.col("a") == F.col("k")).join(b, F.col("b") == F.col("k2")).where("ca = cb").select(F.col("b").alias("a"), F.col("a").alias("b")), "inside")
        # backward reach of the roots: they are their own colour, all others start above every id
        top = F.lit((1 << 63) - 1)
        marks = _spread(inside, colours.select("id", F.when(F.col("id") == F.col("colour"), F.col("id")).otherwise(top).alias("colour")))
        found = marks.where(F.col("colour") != top).select("id", F.col("colour").alias("scc"))
        done = found if done is None else done.unionByName(found)
        gone = found.select(F.col("id").alias("g"))
        open_ = stage(open_.join(gone, F.col("id") == F.col("g"), "left_anti"), "open")
        pairs = stage(pairs.join(gone, F.col("a") == F.col("g"), "left_anti").join(gone, F.col("b") == F.col("g"), "left_anti"), "rest")
    return done if done is not None else open_.select("id", F.col("id").alias("scc"))


def cycles(components: DataFrame) -> DataFrame:
    """Components of more than one node: ``(scc, size)``."""
    return components.groupBy("scc").agg(F.count("*").alias("size")).where("size > 1")


def cycle_members(components: DataFrame) -> DataFrame:
    big = cycles(components).select(F.col("scc").alias("k"))
    return components.join(big, F.col("scc") == F.col("k"), "left_semi")
