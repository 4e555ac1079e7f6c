"""Lookups by id, file and name."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.functions.text import like_escape
from graphloom.schema import UNNAMED_KINDS


def node(nodes: DataFrame, id_: int) -> DataFrame:
    return nodes.where(F.col("id") == id_)


def nodes_by_ids(nodes: DataFrame, ids: Sequence[int]) -> DataFrame:
    """Nodes of the ids, in order of id."""
    return nodes.where(F.col("id").isin(*ids)).orderBy("id") if ids else nodes.where(F.lit(False))


def nodes_by_file(nodes: DataFrame, path: str) -> DataFrame:
    return nodes.where(F.col("file_path") == path)


def file_by_path(files: DataFrame, path: str) -> DataFrame:
    """The record of a file; no row if it has none."""
    return files.where(F.col("path") == path)


def edges_from(edges: DataFrame, id_: int, kind: int | None = None) -> DataFrame:
    found = edges.where(F.col("source_id") == id_)
    return found if kind is None else found.where(F.col("kind") == kind)


def edges_to(edges: DataFrame, id_: int, kind: int) -> DataFrame:
    return edges.where((F.col("target_id") == id_) & (F.col("kind") == kind))


def named(nodes: DataFrame) -> DataFrame:
    return nodes.where(~F.col("kind").isin(*UNNAMED_KINDS))


def _keys(tier: Column) -> list[Column]:
    signed = F.when(F.coalesce(F.col("signature"), F.lit("")) != "", 0).otherwise(1)
    source = F.when(F.col("file_path").endswith(".cpp") | F.col("file_path").endswith(".cc"), 0).otherwise(1)
    return [tier, signed, source, F.col("id")]


def find_by_name(nodes: DataFrame, name: str, limit: int = 20) -> DataFrame:
    """Nodes of a name with ``lookup_rank`` from 1.

    First exact names, then exact qualified names, then qualified names that end
    in ``::name``; of each, those with a signature and in source files first. If
    these are fewer than the limit, nodes whose names contain the name follow. No
    node comes twice. Letters match in any case where part of a name is enough.
    """
    safe = like_escape(name)
    n, q = F.col("name"), F.coalesce(F.col("qualified_name"), F.lit(""))
    tier = F.when(n == name, 0).when(q == name, 1).when(q.ilike(f"%::{safe}"), 2).when(n.ilike(f"%{safe}%") | q.ilike(f"%{safe}%"), 3)
    hits = named(nodes).withColumn("tier", tier).where("tier is not null")
    # within the last tier only the id counts
    signed, source = _keys(F.col("tier"))[1:3]
    keys = [F.col("tier"), F.when(F.col("tier") < 3, signed).otherwise(0), F.when(F.col("tier") < 3, source).otherwise(0), F.col("id")]
    top = hits.orderBy(*keys).limit(limit)
    return top.withColumn("lookup_rank", F.row_number().over(W.orderBy(*keys)))


def pick_best(candidates: DataFrame) -> DataFrame:
    """The candidate that spans most lines, the earlier of equals."""
    return candidates.orderBy(F.desc(F.col("end_line") - F.col("line")), "lookup_rank").limit(1)
