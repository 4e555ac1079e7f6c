"""Versioned snapshots of a code graph, and the changes that make a new one.

A snapshot is a folder of Parquet tables; a small file names the current one and
is overwritten by a rename, so readers see the old or the new whole. A writer
first takes the number of its snapshot, so two writers never share a folder. Old
snapshots stay readable until they are dropped. The postings of the nodes are kept
beside them; those of nodes that stay are taken over.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom import schema
from graphloom.operators import fts

TABLES = {"nodes": schema.NODES, "edges": schema.EDGES, "files": schema.FILES, "refs": schema.REFS}


class ForeignKeyError(ValueError):
    """An edge names a node that does not exist."""


@dataclass
class Graph:
    nodes: DataFrame
    edges: DataFrame
    files: DataFrame
    refs: DataFrame

    @classmethod
    def empty(cls, spark: SparkSession) -> Graph:
        return cls(**{name: spark.createDataFrame([], ddl) for name, ddl in TABLES.items()})

    def counts(self) -> DataFrame:
        """One row: nodes, edges, files."""
        n = lambda t, c: t.agg(F.count("*").alias(c))
        return n(self.nodes, "n_nodes").crossJoin(n(self.edges, "n_edges")).crossJoin(n(self.files, "n_files"))


class Store:
    """Snapshots below a folder that Spark can read and write."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def version(self) -> int:
        """Number of the current snapshot; 0 before the first."""
        fs, p = self._fs(f"{self.root}/CURRENT")
        if not fs.exists(p):
            return 0
        return int(self.spark.sparkContext.wholeTextFiles(f"{self.root}/CURRENT").first()[1])

    def load(self, version: int | None = None) -> Graph:
        v = self.version() if version is None else version
        if not v:
            return Graph.empty(self.spark)
        return Graph(**{name: self.spark.read.schema(ddl).parquet(f"{self.root}/v{v}/{name}") for name, ddl in TABLES.items()})

    def postings(self, version: int | None = None) -> DataFrame | None:
        """The stored full-text index of a snapshot; None before the first."""
        v = self.version() if version is None else version
        return self.spark.read.schema(fts.POSTINGS).parquet(f"{self.root}/v{v}/postings") if v else None

    def embeddings(self) -> DataFrame:
        """The stored vectors, of whatever nodes have one."""
        fs, p = self._fs(f"{self.root}/embeddings")
        found = self.spark.read.schema(schema.EMBEDDINGS).parquet(f"{self.root}/embeddings") if fs.exists(p) else self.spark.createDataFrame([], schema.EMBEDDINGS)
        return found

    def save_embeddings(self, vectors: DataFrame) -> None:
        """Replaces the stored vectors."""
        vectors.select("node_id", "embedding").write.mode("overwrite").parquet(f"{self.root}/embeddings")

    def _take(self, v: int) -> int:
        """The first free number from ``v`` on, taken for this writer alone."""
        while True:
            fs, p = self._fs(f"{self.root}/v{v}.taken")
            try:
                if fs.createNewFile(p):
                    return v
            except Exception as e:  # noqa: BLE001  some stores raise where others answer false
                if not fs.exists(p):
                    raise OSError(f"{p} could not be made") from e
            v += 1

    def _refreshed(self, old: int, new: int) -> DataFrame:
        """Postings of snapshot ``new``: those of nodes that ``old`` has are taken over."""
        nodes = self.load(new).nodes
        if not old:
            return fts.postings(nodes)
        had = self.load(old).nodes.select(F.col("id").alias("__i"))
        stays = nodes.select(F.col("id").alias("__n"))
        kept = self.postings(old).join(stays, F.col("id") == F.col("__n"), "left_semi")
        return kept.unionByName(fts.postings(nodes.join(had, F.col("id") == F.col("__i"), "left_anti")))

    def save(self, graph: Graph) -> int:
        """Write a new snapshot, check that its edges have their nodes, then make it current. Edges are kept in order of their source."""
        before = self.version()
        v = self._take(before + 1)
        for name, ddl in TABLES.items():
            names = [f.split()[0] for f in ddl.split(", ")]
            df = getattr(graph, name).select(*names)
            order = {"edges": ["source_id", "target_id"], "nodes": ["name"]}.get(name)
            df = df.sortWithinPartitions(*order) if order else df
            df.write.mode("overwrite").parquet(f"{self.root}/v{v}/{name}")
        saved = self.load(v)
        check_edges(saved.edges, saved.nodes)
        self._refreshed(before, v).write.mode("overwrite").parquet(f"{self.root}/v{v}/postings")
        fs, tmp = self._fs(f"{self.root}/CURRENT.{v}")
        stream = fs.create(tmp, True)
        stream.write(bytearray(str(v).encode()))
        stream.close()
        _, final = self._fs(f"{self.root}/CURRENT")
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        kind = getattr(hadoop, "Options$Rename")
        options = self.spark.sparkContext._gateway.new_array(kind, 1)
        options[0] = kind.OVERWRITE
        hadoop.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(tmp, final, options)
        return v


def check_edges(edges: DataFrame, nodes: DataFrame) -> None:
    """Raises if an edge has an end that is not a node."""
    ids = nodes.select(F.col("id").alias("k"))
    ends = edges.select(F.col("source_id").alias("e")).unionByName(edges.select(F.col("target_id").alias("e")))
    bad = ends.join(ids, F.col("e") == F.col("k"), "left_anti").limit(1).collect()
    if bad:
        raise ForeignKeyError(f"edge names node {bad[0][0]}, which does not exist")


def with_ids(new: DataFrame, old: DataFrame, *order: str) -> DataFrame:
    """Rows of ``new`` with ids after the largest of ``old``, in the order of the columns."""
    from graphloom.runtime import numbered

    top = old.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    return numbered(new, *order, name="id").withColumn("id", F.col("id") + F.lit(top + 1))


def insert_nodes(graph: Graph, rows: DataFrame) -> Graph:
    """Appends nodes; they get the next ids, in the order of file and place."""
    have = set(rows.columns)
    fields = [f.split() for f in schema.NODES.split(", ") if f.split()[0] != "id"]
    full = rows.select(*[(F.col(n) if n in have else F.lit(None)).cast(t).alias(n) for n, t in fields])
    full = full.fillna("").fillna(0).fillna(False)
    return Graph(graph.nodes.unionByName(with_ids(full, graph.nodes, "file_path", "line", "col", "name")), graph.edges, graph.files, graph.refs)


def insert_edges(graph: Graph, rows: DataFrame) -> Graph:
    """Appends edges, or raises if one has an end that is not a node."""
    check_edges(rows, graph.nodes)
    have = set(rows.columns)
    fields = [f.split() for f in schema.EDGES.split(", ") if f.split()[0] != "id"]
    full = rows.select(*[(F.col(n) if n in have else F.lit(None)).cast(t).alias(n) for n, t in fields]).fillna("").fillna(0)
    return Graph(graph.nodes, graph.edges.unionByName(with_ids(full, graph.edges, "source_id", "target_id", "kind")), graph.files, graph.refs)


def insert_refs(graph: Graph, rows: DataFrame) -> Graph:
    """Appends call references of ``rows(source_node_id, ref_name, line, col)``."""
    full = rows.select("source_node_id", "ref_name", F.lit("call").alias("ref_kind"), "line", "col")
    return Graph(graph.nodes, graph.edges, graph.files, graph.refs.unionByName(with_ids(full, graph.refs, "source_node_id", "line", "col", "ref_name")))


def upsert_files(files: DataFrame, rows: DataFrame) -> DataFrame:
    """Files by path: of a path that is in both, the new row; of repeated new rows, the one with the latest time."""
    order = [F.col("mtime").desc(), F.col("size").desc()]
    latest = rows.withColumn("__k", F.row_number().over(W.partitionBy("path").orderBy(*order))).where("__k = 1").drop("__k")
    kept = files.join(latest.select(F.col("path").alias("__p")), F.col("path") == F.col("__p"), "left_anti")
    return kept.unionByName(latest.select(*files.columns))


def update_mtime(files: DataFrame, path: str, mtime: int) -> DataFrame:
    return files.withColumn("mtime", F.when(F.col("path") == path, F.lit(mtime).cast("long")).otherwise(F.col("mtime")))


def drop_files(graph: Graph, paths: DataFrame) -> Graph:
    """The graph without the files of ``paths(path)``, their nodes, their references, and the edges that touch those nodes."""
    gone = paths.select(F.col("path").alias("__p")).distinct()
    ids = graph.nodes.join(gone, F.col("file_path") == F.col("__p"), "left_semi").select(F.col("id").alias("__i"))
    return Graph(
        graph.nodes.join(gone, F.col("file_path") == F.col("__p"), "left_anti"),
        graph.edges.join(ids, F.col("source_id") == F.col("__i"), "left_anti").join(ids, F.col("target_id") == F.col("__i"), "left_anti"),
        graph.files.join(gone, F.col("path") == F.col("__p"), "left_anti"),
        graph.refs.join(ids, F.col("source_node_id") == F.col("__i"), "left_anti"),
    )


def delete_refs(refs: DataFrame, ids: DataFrame) -> DataFrame:
    return refs.join(ids.select(F.col("id").alias("__i")), F.col("id") == F.col("__i"), "left_anti")


def changed_files(listing: DataFrame, files: DataFrame) -> DataFrame:
    """Rows of the listing without a record, or with another time or size."""
    old = files.select(F.col("path").alias("__p"), F.col("mtime").alias("__m"), F.col("size").alias("__s"))
    joined = listing.join(old, F.col("path") == F.col("__p"), "left")
    return joined.where(F.col("__p").isNull() | ~F.col("mtime").eqNullSafe(F.col("__m")) | ~F.col("size").eqNullSafe(F.col("__s"))).drop("__p", "__m", "__s")


def deleted_files(listing: DataFrame, files: DataFrame) -> DataFrame:
    return files.join(listing.select(F.col("path").alias("__p")), F.col("path") == F.col("__p"), "left_anti")


def caller_files(nodes: DataFrame, edges: DataFrame, paths: DataFrame) -> DataFrame:
    """Files with a call into a node of ``paths(path)``."""
    targets = nodes.join(paths.select(F.col("path").alias("__p")), F.col("file_path") == F.col("__p"), "left_semi").select(F.col("id").alias("t_"))
    sources = edges.where(F.col("kind") == schema.CALLS).join(targets, F.col("target_id") == F.col("t_"), "left_semi").select(F.col("source_id").alias("s_"))
    return nodes.join(sources, F.col("id") == F.col("s_"), "left_semi").select(F.col("file_path").alias("path")).distinct()


def contains_edges(nodes: DataFrame) -> DataFrame:
    """``(source_id, target_id, kind)`` from each file's node to the other nodes of the file."""
    files = nodes.where(F.col("kind") == schema.FILE).select(F.col("id").alias("source_id"), F.col("file_path").alias("__f"))
    return nodes.where(F.col("kind") != schema.FILE).join(files, F.col("file_path") == F.col("__f")).select("source_id", F.col("id").alias("target_id"), F.lit(schema.CONTAINS).alias("kind"))


def dedup_edges(edges: DataFrame) -> DataFrame:
    """The first edge (least id) of each source, target and kind."""
    return edges.groupBy("source_id", "target_id", "kind").agg(F.min("id").alias("id")).select("id", "source_id", "target_id", "kind")
