"""Diffs as DataFrames of hunks."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

HEADER = r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@"


def git_diff(ref: str = "", cwd: str | None = None) -> str:
    """Output of ``git diff --unified=0``; empty if git fails. A ref that looks like an option is refused; no shell is involved."""
    if ref.startswith("-"):
        return ""
    done = subprocess.run(["git", "diff", "--unified=0", *([ref] if ref else []), "--"], cwd=cwd, capture_output=True, text=True, check=False)
    return done.stdout if done.returncode == 0 else ""


def parse_hunks(diffs: DataFrame, text: str = "diff", id_: str = "diff_id") -> DataFrame:
    """Added line ranges of each diff text of ``diffs``, one row for each hunk.

    Lines are taken apart and carried along inside each text, so texts spread over
    the cluster; hunks that only delete have no rows. Headers may be followed by a
    section heading.
    """
    lines = diffs.select(F.col(id_), F.posexplode(F.split(F.col(text), "\n")).alias("pos", "row"))
    named = F.when(F.col("row").startswith("+++ b/"), F.concat(F.lit("./"), F.substring("row", 7, 1 << 20)))
    carried = F.last(named, ignorenulls=True).over(W.partitionBy(id_).orderBy("pos").rowsBetween(W.unboundedPreceding, 0))
    heads = lines.withColumn("file_path", carried).where(F.col("row").rlike(HEADER))
    start = F.regexp_extract("row", HEADER, 1).cast("int")
    n = F.regexp_extract("row", HEADER, 2)
    size = F.when(n == "", 1).otherwise(F.expr("try_cast(regexp_extract(row, '" + HEADER.replace("\\", "\\\\") + "', 2) AS int)"))
    out = heads.select(id_, "file_path", start.alias("line_start"), (start + size - 1).alias("line_end"), F.lit(True).alias("is_added"), size.alias("n"))
    return out.where("n > 0 and file_path is not null").drop("n")


def hunks_of(spark: SparkSession, diff: str) -> DataFrame:
    return parse_hunks(spark.createDataFrame([(0, diff)], "diff_id int, diff string")).drop("diff_id")
