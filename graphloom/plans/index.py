"""Indexing of a source tree: whole, or the changed part."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom import schema
from graphloom.extract.base import extract_files
from graphloom.operators.resolve import call_edges, resolve
from graphloom.operators.store import Graph, Store, changed_files, contains_edges, deleted_files, drop_files, upsert_files, with_ids
from graphloom.runtime import stage
from graphloom.sources.files import list_files


def index_tree(spark: SparkSession, root: str, store: Store, incremental: bool = True) -> dict[str, int]:
    """Brings the store up to date with the tree below ``root``; counts of what was done.

    Unchanged files keep their nodes and ids. References are kept for good and
    resolved again over all nodes, so calls into rebuilt or deleted files are
    never lost for longer than their targets.
    """
    old = store.load() if incremental else Graph.empty(spark)
    listing = list_files(spark, root)
    seen = stage(listing.drop("content"), "listing")
    changed = stage(changed_files(seen, old.files), "changed")
    deleted = deleted_files(seen, old.files)
    n_changed, n_deleted = changed.count(), deleted.count()
    if not n_changed and not n_deleted and store.version():
        return {"changed": 0, "deleted": 0, "version": store.version()}
    wanted = listing.join(changed.select(F.col("path").alias("__p")), F.col("path") == F.col("__p"), "left_semi")
    spread = max(1, min(n_changed, 4 * spark.sparkContext.defaultParallelism))
    found = stage(extract_files(wanted.repartition(spread).select("path", "language", "mtime", "size", "content")), "extracted")
    graph = rebuilt(old, changed.select("path").unionByName(deleted.select("path")), found)
    version = store.save(graph)
    return {"changed": n_changed, "deleted": n_deleted, "version": version}


def rebuilt(old: Graph, gone: DataFrame, found: DataFrame) -> Graph:
    """The graph without the files ``gone``, with the extracted files ``found``, and all references resolved anew."""
    kept = drop_files(old, gone)
    symbols = found.select("path", "language", F.posexplode("nodes").alias("pos", "n")).select("path", "language", "pos", "n.*")
    file_nodes = found.select("path", "language", F.lit(-1).alias("pos"), F.lit(schema.FILE).alias("kind"), F.substring_index("path", "/", -1).alias("name"), F.col("path").alias("qualified_name"), *[F.lit(0).alias(c) for c in ("line", "col", "end_line", "end_col")], *[F.lit("").alias(c) for c in ("signature", "docstring", "visibility")], *[F.lit(False).alias(c) for c in ("is_static", "is_const", "is_exported")])
    fresh = stage(with_ids(file_nodes.unionByName(symbols), old.nodes, "path", "pos"), "new-nodes")
    columns = [f.split()[0] for f in schema.NODES.split(", ")]
    nodes = stage(kept.nodes.select(*columns).unionByName(fresh.withColumnRenamed("path", "file_path").select(*columns)), "nodes")
    places = fresh.select(F.col("path").alias("__p"), F.col("pos").alias("__k"), F.col("id").alias("source_node_id"))
    calls = found.select("path", F.posexplode("refs").alias("at", "r")).select("path", "at", "r.*")
    made = calls.join(places, (F.col("path") == F.col("__p")) & (F.col("source") == F.col("__k"))).select("path", "at", "source_node_id", "ref_name", F.lit("call").alias("ref_kind"), "line", "col")
    numbered = with_ids(made, old.refs, "path", "at")
    names = [f.split()[0] for f in schema.REFS.split(", ")]
    refs = stage(kept.refs.select(*names).unionByName(numbered.select(*names)), "refs")
    links = contains_edges(nodes).select("source_id", "target_id", "kind", F.lit(0).alias("line"), F.lit(0).alias("col"))
    links = links.unionByName(call_edges(resolve(refs, nodes)).select("source_id", "target_id", "kind", "line", "col")).withColumn("metadata", F.lit(""))
    edges = with_ids(links, old.edges.where(F.lit(False)), "kind", "source_id", "target_id")
    files = with_ids(found.select("path", "language", "mtime", "size"), old.files, "path")
    return Graph(nodes, edges, upsert_files(kept.files, files), refs)


def unresolved(graph: Graph) -> DataFrame:
    """References that no edge answers."""
    return resolve(graph.refs, graph.nodes).where("target_id is null")
