"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.runtime import shared_dir, stage

__all__ = ["SPACE_CLASS", "WORD_REGEX", "arrow", "bounded", "bounded_batches", "bounded_groups", "cut", "import_path", "keyed", "narrow", "read", "shared_dir", "stage", "text_of", "whole_groups", "without"]

#: Bytes that an Arrow batch on its way to Python holds at most, but for its last row.
BATCH_BYTES = 2 << 20
#: Files of a narrow table for each core.
FILES = 4

#: The six ASCII white-space characters that separate words in every operator here.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_REGEX = r"[^\x20\x09-\x0D]+"


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint of a small table, in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def narrow(df: DataFrame, name: str) -> DataFrame:
    """:func:`stage` for a table of a few numbers a row: a few files for each core, however many partitions it came in."""
    return stage(df.coalesce(FILES * df.sparkSession.sparkContext.defaultParallelism), name)


def bounded(df: DataFrame, rows: int) -> DataFrame:
    """``df``, a table in the shared folder, to be broadcast if it has no more than so many rows."""
    return F.broadcast(df) if df.count() <= rows else df


def text_of(col: str | Column = "text") -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without the columns that an operator is about to add (any case of the name)."""
    low = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in low])


def keyed(df: DataFrame, key: str, text: str) -> DataFrame:
    """``df`` with the two parts of a row's key: rows with the same key have the same text."""
    return df.withColumn("__a", F.coalesce(F.xxhash64(F.col(key)), F.lit(0))).withColumn("__b", F.xxhash64(text_of(text)))


def import_path(spark: SparkSession) -> None:
    """Put this package on the import path of the Python workers.

    On a cluster the package is installed or sent with ``--py-files``; in local
    mode and in tests the workers get the folder it was loaded from.
    """
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH", "")]))


def bounded_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by bytes: by rows alone a batch of long texts is as large as its texts make it."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark._jsparkSession.sessionState().conf().getConfString(name).removesuffix("b")) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def arrow(df: DataFrame, run, schema) -> DataFrame:
    """``df.mapInArrow(run, schema)`` in bounded batches, with this package on the workers' import path."""
    import_path(df.sparkSession)
    bounded_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def whole_groups(batches: Iterator[pa.RecordBatch], carried: list[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches of whole groups (first column), from batches in order of the group."""
    for batch in batches:
        if not len(batch):
            continue
        group = np.asarray(batch.column(0))
        cut = int(np.searchsorted(group, group[-1])) if group[0] != group[-1] else 0
        if cut == 0 and carried and carried[-1].column(0)[0].as_py() != int(group[-1]):
            yield pa.Table.from_batches(carried)
            carried.clear()
        if cut:
            yield pa.Table.from_batches([*carried, batch.slice(0, cut)])
            carried.clear()
        carried.append(batch.slice(cut))
    if carried:
        yield pa.Table.from_batches(carried)


def bounded_groups(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[pa.Table, bool]]:
    """Whole groups (first column) from batches in order of the group, as ``(table, True)``; a group of more than ``limit`` rows comes in pieces, as ``(table, False)``."""
    carried: list[pa.RecordBatch] = []
    split = None  # the group that comes in pieces
    for batch in batches:
        if not len(batch):
            continue
        group = np.asarray(batch.column(0))
        if split is not None:
            end = int(np.searchsorted(group, split, "right"))
            if end:
                yield pa.Table.from_batches([batch.slice(0, end)]), False
            if end == len(batch):
                continue
            batch, group, split = batch.slice(end), group[end:], None
        if carried and carried[-1].column(0)[0].as_py() != int(group[0]):
            yield pa.Table.from_batches(carried), True
            carried = []
        last = int(np.searchsorted(group, group[-1]))
        if last:
            yield pa.Table.from_batches([*carried, batch.slice(0, last)]), True
            carried = []
        carried.append(batch.slice(last))
        if sum(map(len, carried)) > limit:
            yield pa.Table.from_batches(carried), False
            carried, split = [], int(group[-1])
    if carried:
        yield pa.Table.from_batches(carried), True
