"""Sharding: a two-pass external shuffle with DataFrame functions only.

Pass one scatters the records by seeded hashes: the shard follows from the key
and the number of shards (highest-random-weight hashing, so one more shard takes
rows only into itself), the bucket within the shard from a second hash. A bucket
is sized to fit in memory; one that equal rows overfill is dealt into parts. Pass two applies a Fisher-Yates permutation to each
bucket and gives the rows their slots; the buckets of a shard follow one
another, so slots have no gaps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.llm._common import cut, read, stage, text_of, without

SHARDS = 24
#: Rows and bytes that a bucket holds on average.
BUCKET_ROWS = 1 << 16
BUCKET_BYTES = 64 << 20
#: A bucket is full, and is dealt into parts, beyond so many times ``BUCKET_ROWS`` rows and a part of all rows.
FULL, FULL_BUCKETS = 4, 100_000
#: Buckets whose permutations one task draws.
DRAWN = 16


def shard_of(key: Column, shards: int, seed: int = 0) -> Column:
    """Highest-random-weight shard of ``key``: the shard whose seeded hash of the key is largest."""
    best = F.greatest(*[F.xxhash64(key, F.lit(seed), F.lit(s)) for s in range(shards)])
    found = F.lit(shards - 1)
    for s in reversed(range(shards - 1)):
        found = F.when(F.xxhash64(key, F.lit(seed), F.lit(s)) == best, F.lit(s)).otherwise(found)
    return found


def grown_shard(key: Column, shard: Column, shards: int, seed: int = 0) -> Column:
    """The shard with one more: the old one, or the new shard if its weight beats the old one's."""
    old = F.xxhash64(key, F.lit(seed), shard.cast("int"))
    return F.when(F.xxhash64(key, F.lit(seed), F.lit(shards)) > old, F.lit(shards)).otherwise(shard)


def shard_records(df: DataFrame, shards: int = SHARDS, key: str = "doc_id", text: str = "text", seed: int = 0, bucket_rows: int = BUCKET_ROWS, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """All rows and columns of ``df`` with ``shard``, ``slot`` (gapless from 0 in a shard) and ``grown_shard``.

    The law is ``key``: rows of equal keys share a shard. A null key is a key
    like any other; a null text is empty. Repeated rows each get a slot of their
    own. Columns of ``df`` named like an added one are replaced. An empty table
    gives an empty one.

    Rows of one key are spread over the buckets of their shard by the hash of the
    text. A bucket that equal rows (key and text) fill far beyond the others is
    dealt at random into parts of the usual size, as a written table, so that a
    task that is run again deals alike. Each bucket or part is ordered by a sort
    that spills. Slots depend on the rows and the seed, not on the number of shuffle
    partitions, but for the order of equal rows and the rows of such parts.
    """
    data = without(df, "shard", "slot", "grown_shard")
    rows, stored = data.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(F.col(text))), F.lit(0))).first()
    per_shard = max(1, -(-rows // (bucket_rows * shards)), -(-stored // (bucket_bytes * shards)))
    body = text_of(text)
    placed = (
        data.withColumn("__shard", shard_of(F.col(key), shards, seed))
        .withColumn("__mix", F.xxhash64(F.col(key), body, F.lit(seed + 1)))
        .withColumn("__bucket", F.col("__shard") * per_shard + F.pmod(F.col("__mix"), F.lit(per_shard)).cast("int"))
    )
    full = cut(placed.groupBy("__bucket").agg(F.count("*").alias("__n"))) if rows > FULL * bucket_rows else None
    # Each full bucket holds more than a 100,000th of the rows, so there are fewer than 100,000: they may be broadcast.
    full = full and full.where(F.col("__n") > max(FULL * bucket_rows, rows // FULL_BUCKETS)).select(F.col("__bucket").alias("__f"), F.ceil(F.col("__n") / bucket_rows).cast("int").alias("__parts"))
    usual = placed.withColumn("__part", F.lit(0)).withColumn("__draw", F.lit(0.0))
    if full is not None and not full.isEmpty():
        here = placed.join(F.broadcast(full), F.col("__bucket") == F.col("__f"))
        dealt = here.withColumn("__draw", F.rand(seed)).withColumn("__part", F.floor(F.col("__draw") * F.col("__parts")).cast("int")).drop("__f", "__parts")
        placed = usual.join(F.broadcast(full), F.col("__bucket") == F.col("__f"), "left_anti").unionByName(stage(dealt, "full-buckets"))
    else:
        placed = usual
    sized = placed.groupBy("__bucket", "__part").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(W.partitionBy(F.floor(F.col("__bucket") / per_shard)).orderBy("__bucket", "__part").rowsBetween(W.unboundedPreceding, -1))
    # Fisher-Yates: F.shuffle draws each bucket's permutation, by the seed and the number of its partition. That number and
    # the order in it follow from the buckets alone, so the draw is the same in a rerun.
    drawn = (
        sized.withColumn("__before", F.coalesce(before, F.lit(0)))
        .repartition(-(-per_shard * shards // DRAWN), "__bucket")
        .sortWithinPartitions("__bucket", "__part")
        .select(F.col("__bucket").alias("__b"), F.col("__part").alias("__p"), "__before", F.shuffle(F.sequence(F.lit(0), (F.col("__n") - 1).cast("int")), F.lit(seed)).alias("__order"))
    )
    within = W.partitionBy("__bucket", "__part").orderBy("__draw", "__mix", F.col(key))
    ranked = placed.withColumn("__rank", F.row_number().over(within))
    # The permutations grow with the rows: they are never broadcast.
    joined = ranked.join(drawn.hint("merge"), (F.col("__bucket") == F.col("__b")) & (F.col("__part") == F.col("__p")))
    slot = (F.col("__before") + F.element_at("__order", F.col("__rank"))).cast("long")
    return joined.select(
        *[F.col(f"`{c}`") for c in data.columns],
        F.col("__shard").alias("shard"),
        slot.alias("slot"),
        grown_shard(F.col(key), F.col("__shard"), shards, seed).alias("grown_shard"),
    )


def write_shards(sharded: DataFrame, path: str, shards: int = SHARDS) -> None:
    """Write the output of :func:`shard_records` as one folder for each shard, rows in slot order within each file."""
    by = sharded.repartitionByRange(shards, "shard", "slot").sortWithinPartitions("shard", "slot")
    by.write.partitionBy("shard").mode("overwrite").parquet(path)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    digest = docs.select(
        "doc_id",
        (F.octet_length(text_of()) + 8).cast("long").alias("size"),
        F.crc32(text_of().cast("binary")).alias("text_crc32"),
        "text",
    )
    out = shard_records(digest)
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


QUERIES = {"op2_sharding": op2_sharding}
ORACLE: dict[str, str] = {}
