"""Source trees as DataFrames of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.text import is_excluded, language_of


def list_files(spark: SparkSession, root: str, content: bool = True) -> DataFrame:
    """``path`` (below the root, as ``./x``), ``language``, ``mtime`` (seconds), ``size`` and ``content`` of the indexable files."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    plain = F.regexp_replace("path", r"^file:/*", "/")
    base = F.lit(root.removeprefix("file://").rstrip("/"))
    below = F.concat(F.lit("."), F.substring(plain, F.length(base) + 1, F.length(plain)))
    out = read.select(below.alias("path"), F.unix_timestamp("modificationTime").alias("mtime"), F.col("length").alias("size"), *(["content"] if content else []))
    # the leading "./" is ours, so a hidden folder shows as "/." after it
    return out.withColumn("language", language_of(F.col("path"))).where((F.col("language") != "") & ~is_excluded(F.substring("path", 2, 1 << 20)))
