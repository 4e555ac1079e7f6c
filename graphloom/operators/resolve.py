"""Resolution of call references to nodes, in bulk: joins over distinct names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.functions.text import dirname, namespace
from graphloom.operators.lookup import named
from graphloom.runtime import stage

CANDIDATES = 10
#: Distinct names, and candidates of them, up to which the table is sent to every task. Nodes never are.
FEW_NAMES, FEW_CANDIDATES = 20_000, 200_000
#: Points of a candidate in the same file, else folder, and in the same namespace (fixed values).
SAME_FILE, SAME_FOLDER, SAME_NAMESPACE = 10, 5, 3


def candidates(names: DataFrame, nodes: DataFrame, limit: int = CANDIDATES) -> DataFrame:
    """``(ref_name, id, rank)``: for each of ``names(ref_name)`` up to ``limit`` nodes in the order of a name lookup.

    Exact names, qualified names and their endings are equi-joins (an ending
    ``::x`` is joined on each suffix of a qualified name). Only names that those
    leave short are looked for inside other names, and there against the distinct
    spellings, found by a three-letter piece that both must hold.
    """
    pool = named(nodes).select("id", "name", F.coalesce("qualified_name", F.lit("")).alias("qualified_name"), F.when(F.coalesce("signature", F.lit("")) != "", 0).otherwise(1).alias("unsigned"), F.when(F.col("file_path").endswith(".cpp") | F.col("file_path").endswith(".cc"), 0).otherwise(1).alias("header"))
    names = stage(names.select("ref_name").where("ref_name <> ''").distinct(), "names")
    few = names.count() <= FEW_NAMES
    sent = F.broadcast if few else lambda df: df
    large = (lambda df: df) if few else lambda df: df.hint("merge")
    exact = sent(names).join(large(pool), F.col("ref_name") == F.col("name")).select("ref_name", "id", F.lit(0).alias("tier"), "unsigned", "header")
    whole = sent(names).join(large(pool), F.col("ref_name") == F.col("qualified_name")).select("ref_name", "id", F.lit(1).alias("tier"), "unsigned", "header")
    parts = F.split(F.lower("qualified_name"), "::")
    ends = pool.withColumn("parts", parts).where(F.size("parts") > 1).withColumn("k", F.explode(F.sequence(F.lit(2), F.size("parts")))).select("id", "unsigned", "header", F.array_join(F.slice("parts", F.col("k"), F.size("parts")), "::").alias("ending"))
    suffix = sent(names).join(large(ends), F.lower("ref_name") == F.col("ending")).select("ref_name", "id", F.lit(2).alias("tier"), "unsigned", "header")
    strict = exact.unionByName(whole).unionByName(suffix)
    filled = strict.groupBy("ref_name").agg(F.countDistinct("id").alias("n")).where(F.col("n") >= limit)
    short = names.join(filled.select("ref_name"), "ref_name", "left_anti")
    spelt = pool.select("id", F.explode(F.array(F.lower("name"), F.lower("qualified_name"))).alias("text")).distinct()
    texts = spelt.select("text").distinct()
    pieces = lambda c: F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 2, F.lit(1))), lambda i: F.substring(c, i, F.lit(3)))
    have = texts.select("text", F.explode(F.array_distinct(pieces(F.col("text")))).alias("piece"))
    long_ = short.where(F.length("ref_name") >= 3).select("ref_name", F.substring(F.lower("ref_name"), 1, 3).alias("piece"))
    inside = sent(long_).join(large(have), "piece").where(F.contains("text", F.lower("ref_name"))).select("ref_name", "text")
    # Names of one or two letters are pieces themselves: every spelling that holds the letters.
    letters = texts.select("text", F.explode(F.array_distinct(F.concat(F.transform(F.sequence(F.lit(1), F.length("text")), lambda i: F.substring(F.col("text"), i, F.lit(1))), F.transform(F.sequence(F.lit(1), F.length("text")), lambda i: F.substring(F.col("text"), i, F.lit(2)))))).alias("piece")).where("text <> ''")
    tiny = short.where(F.length("ref_name") < 3).select("ref_name", F.lower("ref_name").alias("piece"))
    tiny = sent(tiny).join(large(letters), "piece").select("ref_name", "text")
    loose = inside.unionByName(tiny).distinct().join(spelt.hint("merge"), "text").select("ref_name", "id", F.lit(3).alias("tier"), F.lit(0).alias("unsigned"), F.lit(0).alias("header"))
    best = strict.unionByName(loose).groupBy("ref_name", "id").agg(F.min(F.struct("tier", "unsigned", "header")).alias("k"))
    # the first ``limit`` of each name; the sort is within a name's candidates
    order = W.partitionBy("ref_name").orderBy("k.tier", "k.unsigned", "k.header", "id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("ref_name", "id", "rank", "k.tier")


def resolve(refs: DataFrame, nodes: DataFrame, limit: int = CANDIDATES, strict_tier: bool = False) -> DataFrame:
    """Each of ``refs(id, source_node_id, ref_name)`` with ``target_id`` and ``score``; both null where no node has the name.

    The candidate with most points wins, the earlier of equals. ``strict_tier``
    puts the tier of the match above the points.
    """
    refs = stage(refs, "refs")
    place = nodes.select(F.col("id").alias("n_id"), F.col("file_path").alias("path"), namespace(F.coalesce("qualified_name", F.lit(""))).alias("ns"))
    source = place.select(F.col("n_id").alias("s_id"), F.col("path").alias("s_path"), F.col("ns").alias("s_ns"))
    target = place.select(F.col("n_id").alias("t_id"), F.col("path").alias("t_path"), F.col("ns").alias("t_ns"))
    found = candidates(refs, nodes, limit).select(F.col("ref_name").alias("c_name"), F.col("id").alias("target_id"), "rank", "tier")
    # candidates get their places before each reference takes a copy of them
    found = stage(found.join(target.hint("merge"), F.col("target_id") == F.col("t_id"), "left"), "candidates")
    sent = F.broadcast if found.count() <= FEW_CANDIDATES else lambda df: df.hint("merge")
    rows = refs.join(source.hint("merge"), F.col("source_node_id") == F.col("s_id"), "left").join(sent(found), F.col("ref_name") == F.col("c_name"), "left")
    near = F.when(F.col("s_path") == F.col("t_path"), SAME_FILE).when(dirname(F.col("s_path")) == dirname(F.col("t_path")), SAME_FOLDER).otherwise(0)
    score = near + F.when(F.col("s_ns") == F.col("t_ns"), SAME_NAMESPACE).otherwise(0)
    scored = rows.withColumn("score", F.when(F.col("target_id").isNotNull(), score))
    best = F.max_by(F.struct("target_id", "score"), F.struct(F.when(F.lit(strict_tier), -F.col("tier")).otherwise(0), "score", -F.col("rank"))).alias("best")
    keep = [c for c in refs.columns]
    won = scored.groupBy(*keep).agg(F.first(F.lit(1)).alias("one"), best)
    return won.select(*keep, "best.target_id", "best.score")


def call_edges(resolved: DataFrame) -> DataFrame:
    """Distinct (source, target) pairs of resolved references; the first reference gives the place."""
    first = F.min_by(F.struct("line", "col"), "id").alias("at")
    return resolved.where("target_id is not null").groupBy(F.col("source_node_id").alias("source_id"), "target_id").agg(F.min("id").alias("ref_id"), first).select("ref_id", "source_id", "target_id", F.lit(1).alias("kind"), "at.line", "at.col")
