"""Code graphs made of the star-schema tables, for checks against SQL. Each view has one SQL text that Spark and other engines share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom.runtime import following

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

PART_NODES = """
SELECT p_partkey AS id, CASE p_partkey % 10 WHEN 8 THEN 3 WHEN 9 THEN 7 ELSE 1 END AS kind, p_name AS name,
       p_brand || '::' || p_name AS qualified_name, './' || p_type || '/' || p_brand || '.cpp' AS file_path, 'cpp' AS language,
       CAST(p_size AS INT) AS line, CAST(p_size + p_partkey % 7 AS INT) AS end_line,
       CASE WHEN p_partkey % 2 = 1 THEN '' ELSE 'void ' || p_name || '()' END AS signature, '' AS docstring
FROM part
UNION ALL
SELECT 10000000 + dense_rank() OVER (ORDER BY file_path) AS id, 0 AS kind, file_path AS name, file_path AS qualified_name, file_path, 'cpp' AS language, 0 AS line, 0 AS end_line, '' AS signature, '' AS docstring
FROM (SELECT DISTINCT './' || p_type || '/' || p_brand || '.cpp' AS file_path FROM part) f
"""

PART_EDGES = """
WITH seq AS (
  SELECT l_partkey AS s, l_quantity AS q,
         LEAD(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) AS t
  FROM lineitem),
pairs AS (
  SELECT DISTINCT s AS source_id, t AS target_id, 1 AS kind FROM seq WHERE t IS NOT NULL AND q >= 49
  UNION ALL
  SELECT DISTINCT s, t, 6 FROM seq WHERE t IS NOT NULL AND q = 48)
SELECT kind * 100000000000000 + source_id * 10000000 + target_id AS id, source_id, target_id, kind FROM pairs
"""

USER_EDGES = """
WITH seq AS (SELECT user_id AS s, event_type, LEAD(user_id) OVER (ORDER BY ts, event_id) AS t FROM events)
SELECT DISTINCT s * 10000000 + t AS id, s AS source_id, t AS target_id, 1 AS kind FROM seq WHERE event_type = 'error' AND t IS NOT NULL AND s <> t AND s % 5 = t % 5
"""

#: The whole graphs that PART_EDGES and USER_EDGES thin: each consecutive pair is a call.
PART_PAIRS = """
WITH seq AS (
  SELECT l_partkey AS s,
         LEAD(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) AS t
  FROM lineitem)
SELECT DISTINCT 100000000000000 + s * 10000000 + t AS id, s AS source_id, t AS target_id, 1 AS kind FROM seq WHERE t IS NOT NULL
"""

USER_PAIRS = """
WITH seq AS (SELECT user_id AS s, LEAD(user_id) OVER (ORDER BY ts, event_id) AS t FROM events)
SELECT DISTINCT s * 10000000 + t AS id, s AS source_id, t AS target_id, 1 AS kind FROM seq WHERE t IS NOT NULL AND s <> t
"""

FILE_VERSIONS = {
    "files_old": "SELECT CAST(o_orderkey AS VARCHAR(20)) AS path, CAST(floor(o_totalprice) AS BIGINT) AS size, CAST(year(o_orderdate) * 10000 + month(o_orderdate) * 100 + day(o_orderdate) AS BIGINT) AS mtime FROM orders",
    "files_new": "SELECT CAST(o_orderkey AS VARCHAR(20)) AS path, CAST(floor(o_totalprice) AS BIGINT) + CASE WHEN o_orderkey % 10 = 0 THEN 1 ELSE 0 END AS size, CAST(year(o_orderdate) * 10000 + month(o_orderdate) * 100 + day(o_orderdate) AS BIGINT) AS mtime FROM orders WHERE o_orderkey % 10 <> 1",
}

EVENT_HUNKS = """
SELECT './' || p_type || '/' || p_brand || '.cpp' AS file_path, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS line_start,
       CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) + CAST(event_id % 5 AS INT) AS line_end, TRUE AS is_added
FROM events JOIN part ON p_partkey = event_id % (SELECT count(*) FROM part)
"""


def views(spark: SparkSession, sf_dir: str) -> None:
    """Temporary views of the tables that exist in ``sf_dir``."""
    for name in TABLES:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def table(spark: SparkSession, sf_dir: str, *names: str) -> None:
    for name in names:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def part_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "part")
    return spark.sql(PART_NODES)


def part_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "lineitem")
    return spark.sql(PART_EDGES)


def _user_steps(spark: SparkSession, sf_dir: str, where: str) -> DataFrame:
    """The steps of USER_EDGES and USER_PAIRS: their window has no partitions, so the next user is found over runs of the order instead."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("ts", "event_id", "user_id", "event_type")
    steps = following(events, "user_id", "ts", "event_id", name="t").withColumnRenamed("user_id", "s").where(where)
    return steps.selectExpr("s * 10000000 + t AS id", "s AS source_id", "t AS target_id", "1 AS kind").distinct()


def user_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _user_steps(spark, sf_dir, "event_type = 'error' AND t IS NOT NULL AND s <> t AND s % 5 = t % 5")


def part_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "lineitem")
    return spark.sql(PART_PAIRS)


def user_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _user_steps(spark, sf_dir, "t IS NOT NULL AND s <> t")


def event_hunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "events", "part")
    return spark.sql(EVENT_HUNKS)


def file_versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    table(spark, sf_dir, "orders")
    return spark.sql(FILE_VERSIONS["files_old"]), spark.sql(FILE_VERSIONS["files_new"])
