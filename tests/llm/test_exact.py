"""Exact dedup against brute force; the perfect hash by itself."""

import hashlib
import re
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from graphloom.llm import exact


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


ROWS = [(5, "a  b"), (3, "a b"), (9, "a\t\nb"), (4, " a b"), (1, None), (2, ""), (7, " "), (8, "\n\n"), (6, "é"), (6, "é"), (None, "q"), (None, "q"), (10, "q"), (None, "only null"), (11, "x" * 200_000), (12, "x" * 200_000), (13, "a b")]


def check(rows, got):
    groups = defaultdict(list)
    for key, text in rows:
        groups[normal(text)].append(key)
    assert len(got) == len(rows)
    winners = defaultdict(int)
    for r in got:
        t = normal(r.text)
        keys = [k for k in groups[t] if k is not None]
        assert r.keep_id == min(keys, default=None) and r.group_size == len(groups[t])
        assert r.text_sha256 == hashlib.sha256(t.encode()).hexdigest()
        if r.kept:
            winners[t] += 1
            assert r.doc_id == r.keep_id
    assert dict(winners) == {t: 1 for t in groups}


def test_odd_rows(spark):
    df = spark.createDataFrame([(*r, "clash") for r in ROWS], "doc_id long, text string, kept string")
    check(ROWS, exact.exact_dedup(df).collect())
    check(ROWS, exact.exact_dedup(df, history=F.col("doc_id") < 0).collect())
    check(ROWS, exact.exact_dedup(df, history=F.lit(True)).collect())


def test_distinct_texts(spark):
    df = spark.createDataFrame([(*r, "clash") for r in ROWS], "doc_id long, text string, kept string")
    for history in (None, F.col("doc_id") < 0, F.lit(True)):
        got = exact.distinct_texts(df, history=history)
        assert got.columns == df.columns
        want = [r for r in exact.exact_dedup(df).collect() if r.kept]
        assert sorted((str(r.doc_id), normal(r.text)) for r in got.collect()) == sorted((str(r.doc_id), normal(r.text)) for r in want)


def test_keys_of_other_types(spark):
    rows = [("b", "x  y"), ("a", "x y"), (None, "x y"), ("zz", "only"), ("c", None), ("d", "")]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    for history in (None, F.lit(False), F.col("doc_id") < "b"):
        check(rows, exact.exact_dedup(df, history=history).collect())
    assert [f.dataType.simpleString() for f in exact.exact_dedup(df, carry=False).schema.fields] == ["string", "string", "bigint", "boolean", "string"]


def test_empty(spark):
    assert exact.distinct_texts(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert exact.exact_dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_documents(spark, small):
    df = spark.read.parquet(f"{small}/documents.parquet")
    check([(r.doc_id, r.text) for r in df.collect()], exact.exact_dedup(df).collect())


def test_perfect_hash():
    d = np.random.default_rng(1).integers(0, 1 << 64, (5000, 4), dtype=np.uint64)
    index = exact.PerfectHash.build(d[:4000])
    assert sorted(index.slots(d[:4000])) == list(range(4000))
    again = exact.PerfectHash.unpack(*index.pack())
    assert (again.slots(d) == index.slots(d)).all() and again.slots(d).max() < 4000
    assert len(exact.PerfectHash.build(d[:0]).slots(d[:0])) == 0
