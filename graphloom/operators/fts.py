"""Full-text search over named columns: postings, terms, phrases and operators, BM25."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import search_tokens

FIELDS = ("name", "qualified_name", "signature", "docstring", "file_path")
POSTINGS = "id long, field int, pos int, token string"
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
# Operators of a query, the loosest first.
LOOSEST = ("OR", "AND", "NOT")
# How kinds rank among equal hits.
FIRST_KINDS, SECOND_KINDS = (1, 2, 3, 4, 5, 9), (7, 8, 6, 12)


def postings(rows: DataFrame, fields: tuple[str, ...] = FIELDS, id_: str = "id") -> DataFrame:
    """``(id, field, pos, token)`` of each token.

    Rows are dealt by id before their tokens are made: a file of few bytes may hold very many short rows, and one task would
    make the tokens of them all. Counts by token and id need no further exchange.
    """
    rows = rows.select(F.col(id_).alias("id"), *fields).repartition("id")
    each = F.array(*[F.struct(F.lit(i).alias("field"), search_tokens(F.col(f)).alias("tokens")) for i, f in enumerate(fields)])
    flat = rows.select("id", F.explode(each).alias("f"))
    return flat.select("id", F.col("f.field").alias("field"), F.posexplode("f.tokens").alias("pos", "token"))


def refresh_postings(index: DataFrame, changed: DataFrame, fields: tuple[str, ...] = FIELDS, id_: str = "id") -> DataFrame:
    """The index after rows were inserted, updated or deleted: only the tokens of ``changed`` are made anew.

    ``changed`` holds the new form of inserted and updated rows; a deleted row comes with nulls in all fields.
    """
    gone = changed.select(F.col(id_).alias("__g")).distinct()
    return index.join(gone, F.col("id") == F.col("__g"), "left_anti").unionByName(postings(changed, fields, id_))


class Bad(ValueError):
    """A query whose operators have nothing to join."""


def parse_query(query: str) -> tuple[list[list[str]], tuple | None]:
    """Phrases of a query, and how they are joined: ``("AND" | "OR" | "NOT", left, right)``, ``("IS", phrase)``, or None for what never holds.

    Words and spaces alone are terms; terms beside each other must all occur, which binds most tightly, then come NOT,
    AND and OR in capitals, from left to right. A query with any other character is one phrase. A term without a letter or
    digit is left out beside other terms and holds nowhere else. An operator without a term on each side finds nothing.
    """
    words = lambda t: re.findall(r"[^\W_]+", t.lower())
    phrases: list[list[str]] = []

    def leaf(term: str) -> tuple | None:
        if not (found := words(term)):
            return None
        phrases.append(found)
        return ("IS", len(phrases) - 1)

    if not re.fullmatch(r"[\w\s]*", query, re.ASCII) or not words(query):
        return phrases, leaf(query)
    rest = query.split()

    def terms() -> tuple | None:
        if not rest or rest[0] in LOOSEST:
            raise Bad(query)
        tree = None
        while rest and rest[0] not in LOOSEST:
            one = leaf(rest.pop(0))
            tree = ("AND", tree, one) if tree and one else tree or one
        return tree

    def joined(level: int) -> tuple | None:
        if level == len(LOOSEST):
            return terms()
        tree = joined(level + 1)
        while rest and rest[0] == LOOSEST[level]:
            rest.pop(0)
            tree = (LOOSEST[level], tree, joined(level + 1))
        return tree

    try:
        return phrases, joined(0)
    except Bad:
        return [], None


def score_of(tree: tuple | None, part: Callable[[int], Column]) -> Column:
    """Sum of the parts of the phrases that make ``tree`` hold; null where it does not."""
    if tree is None:
        return F.lit(None).cast("double")
    if tree[0] == "IS":
        return part(tree[1])
    left, right = (score_of(t, part) for t in tree[1:])
    if tree[0] == "AND":
        return left + right
    return F.coalesce(left + right, left, right) if tree[0] == "OR" else F.when(right.isNull(), left)


def bm25(index: DataFrame, query: str, total: int | None = None) -> DataFrame:
    """``(id, score)`` of rows that the query holds for; better is less. Lengths and counts run over all fields."""
    phrases, tree = parse_query(query)
    spark = index.sparkSession
    if tree is None:
        return spark.createDataFrame([], "id long, score double")
    wanted = spark.createDataFrame([(p, k, t) for p, ts in enumerate(phrases) for k, t in enumerate(ts)], "phrase int, k int, q_token string")
    # folded as the index is
    wanted = wanted.withColumn("q_token", F.element_at(search_tokens(F.col("q_token")), 1))
    sizes = spark.createDataFrame([(p, len(ts)) for p, ts in enumerate(phrases)], "p_ int, words int")
    # A phrase begins at pos - k for each of its words; it is there if all agree. The query is a handful of rows.
    starts = index.join(F.broadcast(wanted), F.col("token") == F.col("q_token")).groupBy("id", "field", "phrase", (F.col("pos") - F.col("k")).alias("start")).agg(F.count("*").alias("n"))
    hits = starts.join(F.broadcast(sizes), (F.col("phrase") == F.col("p_")) & (F.col("n") == F.col("words"))).groupBy("id", "phrase").agg(F.count("*").alias("tf"))
    df = hits.groupBy("phrase").agg(F.count("*").alias("df")).withColumnRenamed("phrase", "d_")
    lengths = index.groupBy("id").agg(F.count("*").alias("dl"))
    corpus = lengths.agg(F.count("*").alias("docs"), F.sum("dl").alias("tokens"))
    rows = F.lit(total) if total is not None else F.col("docs")
    scored = hits.join(F.broadcast(df), F.col("phrase") == F.col("d_")).join(lengths.withColumnRenamed("id", "l_"), F.col("id") == F.col("l_")).crossJoin(F.broadcast(corpus))
    idf = F.greatest(F.log((rows - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(LEAST_IDF))
    norm = F.col("tf") + K1 * (1 - B + B * F.col("dl") / (F.col("tokens") / rows))
    part = -idf * F.col("tf") * (K1 + 1) / norm
    parts = scored.groupBy("id").agg(*[F.max(F.when(F.col("phrase") == p, part)).alias(f"part_{p}") for p in range(len(phrases))])
    return parts.select("id", score_of(tree, lambda p: F.col(f"part_{p}")).alias("score")).where("score IS NOT NULL")


def search(nodes: DataFrame, query: str, limit: int = 20, index: DataFrame | None = None, total: int | None = None) -> DataFrame:
    """Best nodes for a query: three times the limit by score, then by rank of their kind, cut to the limit."""
    index = index if index is not None else postings(nodes)
    hits = bm25(index, query, total if total is not None else nodes.count())
    top = hits.orderBy(F.round("score", 9), "id").limit(3 * limit).withColumnRenamed("id", "h_")
    rank = F.when(F.col("kind").isin(*FIRST_KINDS), 0).when(F.col("kind").isin(*SECOND_KINDS), 1).otherwise(2)
    return nodes.join(top, F.col("id") == F.col("h_")).withColumn("kind_rank", rank).drop("h_").orderBy("kind_rank", "id").limit(limit)
