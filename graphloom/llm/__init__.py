"""Operators for training data. Nothing outside this subpackage imports it."""

from __future__ import annotations

from graphloom.llm import bpe, embeddings, exact, jaccard, mixing, quality, sharding, substrings, token_counts, urls

_MODULES = (token_counts, sharding, quality, embeddings, mixing, substrings, exact, jaccard, bpe, urls)


def queries() -> dict:
    return {k: v for m in _MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in _MODULES for k, v in m.ORACLE.items()}
