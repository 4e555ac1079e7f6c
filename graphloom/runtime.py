"""Shared folders and tables that cut a plan's lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``; a local one where that is unset, in local mode only."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="graphloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back; a lost executor then costs only running tasks."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, *order: str, name: str = "position") -> DataFrame:
    """``df`` with each row's place from 0 in the order of the columns, without bringing all rows to one task.

    Rows are sorted within ranges, and each range is shifted by the sizes of those before.
    """
    from pyspark.sql import Window as W
    from pyspark.sql import functions as F

    ranged = stage(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id()), "ranged")
    part = F.shiftrightunsigned("__id", 33)
    sizes = ranged.groupBy(part.alias("__part")).count()
    before = F.sum("count").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1))
    shifted = sizes.select("__part", F.coalesce(before, F.lit(0)).alias("__before"))
    place = F.col("__before") + F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    # one row for each range, so no more than there are shuffle partitions
    return ranged.join(F.broadcast(shifted), part == F.col("__part")).withColumn(name, place).drop("__id", "__part", "__before")


def following(df: DataFrame, value: str, *order: str, name: str = "following", run: int = 1 << 16) -> DataFrame:
    """``df`` with ``value`` of the row after each in the order of the columns, null for the last: LEAD without bringing all rows to one task.

    Rows are numbered and cut into runs; each run also gets the first row of the run after it.
    """
    from pyspark.sql import Window as W
    from pyspark.sql import functions as F

    own = F.floor(F.col("__at") / run)
    runs = F.when((F.col("__at") % run == 0) & (F.col("__at") > 0), F.array(own, own - 1)).otherwise(F.array(own))
    dealt = numbered(df, *order, name="__at").withColumn("__run", F.explode(runs))
    led = dealt.withColumn(name, F.lead(value).over(W.partitionBy("__run").orderBy("__at")))
    return led.where(F.col("__run") == own).drop("__at", "__run")
