"""Texts of symbols for embedding, and search by cosine."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.functions.text import cosine
from graphloom.schema import node_kind_name


def embed_text() -> Column:
    """Kind (but for files), name, qualified name if it differs, signature and the first 200 characters of the docstring."""
    q, s, d = (F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col(c)) for c in ("qualified_name", "signature", "docstring"))
    return F.concat_ws(" ", F.when(F.col("kind") != 0, node_kind_name(F.col("kind"))), "name", F.when(q != F.col("name"), q), s, F.substring(d, 1, 200))


def hashing_encoder(texts: Sequence[str], size: int = 64) -> list[list[float]]:
    """Deterministic stand-in for a sentence encoder: signed hashed words and letter triples."""
    from zlib import crc32

    out = []
    for text in texts:
        v = [0.0] * size
        words = text.lower().split()
        for piece in [*words, *[w[i : i + 3] for w in words for i in range(max(1, len(w) - 2))]]:
            h = crc32(piece.encode())
            v[h % size] += 1.0 if h & 0x10000 else -1.0
        out.append(v)
    return out


def embed(nodes: DataFrame, encoder: Callable[[Sequence[str]], list[list[float]]] = hashing_encoder, batch: int = 64) -> DataFrame:
    """``(node_id, embedding)`` of every node, encoded in Arrow batches."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                yield pd.DataFrame({"node_id": part["node_id"], "embedding": encoder(part["text"].tolist())})

    return nodes.select(F.col("id").alias("node_id"), embed_text().alias("text")).mapInPandas(run, "node_id long, embedding array<float>")


@F.pandas_udf(T.BinaryType())
def to_blob(vectors: pd.Series) -> pd.Series:
    """Little-endian 32-bit floats of each vector in one binary."""
    return vectors.map(lambda v: None if v is None else struct.pack(f"<{len(v)}f", *v))


@F.pandas_udf(T.ArrayType(T.FloatType()))
def from_blob(blobs: pd.Series) -> pd.Series:
    return blobs.map(lambda b: None if b is None else list(struct.unpack(f"<{len(b) // 4}f", b)))


def nearest(embeddings: DataFrame, query: Sequence[float] | Column | DataFrame, top: int = 10, id_: str = "node_id", vector: str = "embedding") -> DataFrame:
    """``(id, similarity)`` of the nearest vectors by cosine, rounded to 4 digits; ties by id. ``query``: a vector, or a table of one row ``q``."""
    if isinstance(query, DataFrame):
        rows = embeddings.crossJoin(F.broadcast(query.limit(1)))
        q = F.col("q")
    else:
        rows, q = embeddings, query if isinstance(query, Column) else F.array(*[F.lit(float(x)) for x in query])
    return rows.select(F.col(id_), F.round(cosine(F.col(vector), q), 4).alias("similarity")).orderBy(F.desc("similarity"), id_).limit(top)


def missing(nodes: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Nodes without a vector."""
    return nodes.join(embeddings.select(F.col("node_id").alias("__n")), F.col("id") == F.col("__n"), "left_anti")


def current(nodes: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Vectors of nodes that exist."""
    return embeddings.join(nodes.select(F.col("id").alias("__n")), F.col("node_id") == F.col("__n"), "left_semi")


def counts(nodes: DataFrame, embeddings: DataFrame) -> DataFrame:
    """One row: nodes, and vectors of nodes that exist."""
    return nodes.agg(F.count("*").alias("n_nodes")).crossJoin(current(nodes, embeddings).agg(F.count("*").alias("n_embedded")))


def search_semantic(nodes: DataFrame, embeddings: DataFrame, text: str, top: int = 10, encoder: Callable = hashing_encoder) -> DataFrame:
    """Nodes nearest to a text, with ``similarity``."""
    hits = nearest(embeddings, encoder([text])[0], top)
    return nodes.join(F.broadcast(hits), F.col("id") == F.col("node_id")).orderBy(F.desc("similarity"), "id")
