"""Watching a source tree: a stream of file changes that keeps a store up to date."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from graphloom.operators.store import Store
from graphloom.plans.index import index_tree

EXTENSIONS = (".cpp", ".cc", ".cxx", ".c", ".h", ".hpp", ".hxx", ".hh", ".py", ".pyi")
CHANGES = "path string, op string, mtime long, size long"


def snapshot(root: str) -> dict[str, tuple[int, int]]:
    """Time in nanoseconds and size of each source file below the root, hidden and build folders left out."""
    found = {}
    for folder, folders, names in os.walk(root):
        folders[:] = [d for d in folders if not d.startswith((".", "build-")) and d not in ("node_modules", "build", "__pycache__")]
        for name in names:
            if name.endswith(EXTENSIONS) and not name.startswith("."):
                path = os.path.join(folder, name)
                try:
                    stat = os.stat(path)
                except OSError:
                    continue
                found["./" + os.path.relpath(path, root)] = (stat.st_mtime_ns, stat.st_size)
    return found


def differences(old: dict, new: dict) -> list[tuple[str, str, int, int]]:
    rows = [(p, "created" if p not in old else "modified", *v) for p, v in sorted(new.items()) if old.get(p) != v]
    return rows + [(p, "deleted", 0, 0) for p in sorted(old.keys() - new.keys())]


class _Reader(SimpleDataSourceStreamReader):
    """Offsets are listings, so each batch holds what changed between two of them: edits and deletions as well as new files."""

    def __init__(self, root: str):
        self.root = root

    def initialOffset(self) -> dict:
        return {"files": {}}

    def read(self, start: dict) -> tuple:
        now = {p: list(v) for p, v in snapshot(self.root).items()}
        return iter(differences(start["files"], now)), {"files": now}

    def readBetweenOffsets(self, start: dict, end: dict):
        return iter(differences(start["files"], end["files"]))


class SourceTreeDataSource(DataSource):
    """``spark.readStream.format("source_tree").load(root)``: rows ``path, op, mtime, size``; new folders are seen as they come."""

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return CHANGES

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _Reader(self.options["path"])


def changes(spark: SparkSession, root: str) -> DataFrame:
    """The stream of changes below ``root``."""
    spark.dataSource.register(SourceTreeDataSource)
    return spark.readStream.format("source_tree").load(root)


def watch(spark: SparkSession, root: str, store: Store, checkpoint: str, every: str = "2 seconds", then: Callable[[dict], None] | None = None):
    """Starts a query that indexes again after each batch with changes. All changes of a batch are indexed at once."""

    def sink(batch: DataFrame, _: int) -> None:
        if batch.limit(1).count():
            done = index_tree(batch.sparkSession, root, store)
            if then:
                then(done)

    return changes(spark, root).writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
