"""A training-data pipeline of five stages over ``documents``.

Each stage is written as Parquet in the shared folder and read back before the
next one, so a lost executor costs only tasks of the running stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import bpe, exact, jaccard, mixing, quality
from graphloom.llm._common import read, stage

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that are more likely of bad quality or toxic than not."""
    return quality.classify(docs, read(spark, sf_dir, "labels")).where("kept").select(*docs.columns)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the smallest doc_id stays."""
    return exact.distinct_texts(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five words, similarity 0.75) the one with the smallest doc_id stays."""
    return jaccard.representatives(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: documents repeated, taken in part or left out; n_chars follows the text."""
    mixed = mixing.repeat_taken(mixing.mix_sources(docs)).select(*docs.columns)
    return mixed.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else mixed


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document in the mix."""
    return bpe.encode_texts(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("exact dedup", exact_dedup),
    ("n-gram jaccard join", near_dedup),
    ("mixing sources", mix),
    ("bpe encoding", encode),
]

#: A trained classifier and hashed sampling have no SQL form; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
