"""Token counts, sharding, mixing, BPE and URL filters against brute force, and on odd tables."""

import hashlib
import json
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from graphloom.llm import bpe, mixing, sharding, token_counts, urls

ODD = [
    (0, None, None), (1, "", "a"), (2, "   \t\n", "a"), (3, "two words", "b"), (3, "two words", "b"), (None, "no id", None),
    (4, "x <|endoftext|> y<|endoftext|>", "b"), (5, "a\u00a0 b  c \n\n d\u3000 \u2003 e", "c"), (6, "Émile e\u0301 \u0301x \x1c y \x85 z", "c"),
    (7, "long " * 60_000, "c"), (8, "日本語 テキスト 😀😀 don't we'll  I'm", "é"), (9, "tab\t\ttab \r\n  end  ", "z"), (10, "x" * 3000, "z"), (11, "!!!\x1d??? 12 345\u2028 6", "z"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, 1, "q") for r in ODD], "doc_id long, text string, source string, shard int, n_tokens string")


@pytest.fixture(scope="module")
def docs(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


def library(name):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.no_truncation()
    t.no_padding()
    return t


def test_token_counts(spark, odd, docs):
    t = library("word_bpe_49k.json")
    for df in (odd, docs):
        want = sorted(((r.doc_id is not None, r.doc_id or 0), len((r.text or "").encode()), len(t.encode(r.text or "", add_special_tokens=False).ids)) for r in df.collect())
        got = sorted(((r.doc_id is not None, r.doc_id or 0), r.n_bytes, r.n_tokens) for r in token_counts.count_tokens(df).collect())
        assert got == want
    assert token_counts.count_tokens(odd.limit(0)).collect() == []


def test_token_counts_when_nothing_more_is_remembered(odd):
    t = library("word_bpe_49k.json")
    counter = token_counts.Counter(token_counts.vocabulary(), remembered=3)
    texts = [(r[1] or "") for r in ODD]
    for _ in range(2):
        assert counter.count([x.encode() for x in texts]) == [len(t.encode(x, add_special_tokens=False).ids) for x in texts]


def test_bpe(spark, odd, docs):
    t = library("byte_bpe_50k.json")
    for df in (odd, docs):
        out = bpe.encode_texts(df)
        want = Counter()
        for r in df.collect():
            ids = t.encode(r.text or "", add_special_tokens=False).ids
            want[(r.doc_id, len(ids), struct.pack(f"<{len(ids)}I", *ids), t.decode(ids, skip_special_tokens=False))] += 1
        back = bpe.decode_ids(out.withColumn("kept", F.col("ids")), "ids")
        assert Counter((r.doc_id, r.n_tokens, bytes(r.kept), r.text) for r in back.collect()) == want
        got = Counter((r.doc_id, r.ids_sha256, r.decoded_sha256) for r in bpe.encode_texts(df, digests=True).collect())
        assert got == Counter((a, hashlib.sha256(i).hexdigest(), hashlib.sha256(d.encode()).hexdigest()) for (a, _, i, d), n in want.items() for _ in range(n))
    assert bpe.encode_texts(odd.limit(0)).collect() == []


def test_forced_pairs_are_in_no_token():
    coder = bpe.coder_of(token_counts.vocabulary(bpe.VOCABULARY))
    assert coder.parts("un à la\n mer  x ".encode()) == [b"un", " à la".encode(), b"\n mer", b"  x", b" "]
    assert coder.forced[ord("a"), ord(" ")] and not coder.forced[ord(" "), ord("a")]
    with open(public_tokenizers.path(bpe.VOCABULARY)) as f:
        assert len(json.load(f)["model"]["vocab"]) <= len(coder.table)
    assert coder.decode(struct.pack("<I", coder.tokenizer.encode("é").ids[0])) in (b"\xc3\xa9", "\ufffd".encode())


def test_forced_boundaries_against_the_library():
    """Any mix of white space, ideographs and marks gives the library's ids; long runs of ideographs are cut too."""
    coder, t = bpe.coder_of(token_counts.vocabulary(bpe.VOCABULARY)), library("byte_bpe_50k.json")
    rng = np.random.default_rng(8)
    bits = ["a", "it's", " ", "  ", "\n", "\t", "\u00a0", "\u3000", "\u2028", "\x1c", "\x85", "é", "語", "漢字仮名", "の", "・", "日本語" * 9, "龍契士", "中文字符" * 20, "한국", "7", "!?", "'", "😀", "\u0301", "<|endoftext|>", "word"]
    texts = ["".join(rng.choice(bits, rng.integers(1, 25))) for _ in range(4000)]
    ids = coder.encode([x.encode() for x in texts])
    for x, got, want in zip(texts, ids, t.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == want.ids, x
    parts = coder.parts(("漢字" * 500 + "\u00a0 b c").encode())
    assert max(map(len, parts)) < 200 and b"".join(parts).decode() == "漢字" * 500 + "\u00a0 b c" and parts[-1] == b" c"


def test_sharding(spark, odd, docs):
    for df in (odd, docs):
        rows = sharding.shard_records(df, bucket_rows=4, bucket_bytes=20_000).collect()
        assert len(rows) == df.count() and all("text" in r for r in rows)
        slots, of = defaultdict(list), defaultdict(set)
        for r in rows:
            slots[r.shard].append(r.slot)
            of[r.doc_id].add((r.shard, r.grown_shard))
            assert r.grown_shard in (r.shard, 24) and 0 <= r.shard < 24
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        assert all(len(s) == 1 for s in of.values())
        again = {(r.doc_id, r.text, r.shard, r.slot) for r in sharding.shard_records(df, bucket_rows=4, bucket_bytes=20_000).collect()}
        assert again == {(r.doc_id, r.text, r.shard, r.slot) for r in rows}
    wide = {r.doc_id: r.shard for r in sharding.shard_records(docs, shards=25).collect()}
    assert {r.doc_id: r.grown_shard for r in sharding.shard_records(docs, shards=24).collect()} == wide
    assert sharding.shard_records(odd.limit(0)).collect() == []


def test_sharding_deals_full_buckets(spark, docs):
    """A row that is repeated very often fills parts of the usual size; slots keep their law and ignore shuffle partitions."""
    hot = spark.range(3000).select(F.lit(5).cast("long").alias("doc_id"), F.lit("the same").alias("text"), F.col("id").alias("n"))
    df = docs.select("doc_id", "text", F.lit(-1).cast("long").alias("n")).unionByName(hot)
    rows = sharding.shard_records(df, shards=3, bucket_rows=50).collect()
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sorted(r.n for r in rows if r.n >= 0) == list(range(3000)) and len({r.shard for r in rows if r.doc_id == 5}) == 1
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        got = set()
        for n in ("3", "11"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            got.add(frozenset((r.doc_id, r.slot) for r in sharding.shard_records(docs, shards=3, bucket_rows=20).collect()))
        assert len(got) == 1
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)


def test_shards_are_mixed(docs):
    rows = sharding.shard_records(docs, shards=2).orderBy("shard", "slot").collect()
    assert [r.doc_id for r in rows if r.shard == 0] != sorted(r.doc_id for r in rows if r.shard == 0)


def test_write_shards(spark, docs, tmp_path):
    sharding.write_shards(sharding.shard_records(docs, shards=3), str(tmp_path / "x"), 3)
    back = spark.read.parquet(str(tmp_path / "x"))
    assert back.count() == docs.count() and back.select("shard").distinct().count() == 3


def test_op2(spark, small):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    for r in sharding.op2_sharding(spark, small).collect():
        data = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law) == (len(data) + 8, zlib.crc32(data), "key")


def fill(sizes, weights=(5, 2, 1)):
    """Water-filling by repeated clamping, in exact fractions."""
    from fractions import Fraction

    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode("utf-32-be")))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    clamped, total = set(), Fraction(3, 2) * sum(sizes.values())
    while True:
        free = [s for s in order if s not in clamped]
        left = total - sum(2 * sizes[s] for s in clamped)
        target = {s: Fraction(2 * sizes[s]) for s in clamped} | {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if target[s] > 2 * sizes[s]}
        if not over:
            return target
        clamped |= over


def test_mixing(spark, odd, docs):
    for df in (odd, docs):
        rows = mixing.mix_sources(df).collect()
        assert len(rows) == df.count()
        sizes, taken = defaultdict(int), defaultdict(int)
        for r in df.collect():
            sizes[r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
        want = fill(sizes)
        for r in rows:
            assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) and 0 <= r.taken <= 2 * r.size
            assert r.source_size == sizes[r.source] and abs(r.target - float(want[r.source])) < 1e-6
            taken[r.source] += r.taken
        assert all(abs(taken[s] - want[s]) <= 1 + sum(1 for r in rows if r.source == s) / 32 for s in want)
        assert {(r.doc_id, r.taken) for r in mixing.mix_sources(df.repartition(3)).collect()} == {(r.doc_id, r.taken) for r in rows}
    assert mixing.mix_sources(odd.limit(0)).collect() == []


def test_mixing_repeats(docs):
    mixed = mixing.mix_sources(docs).cache()
    want = mixed.agg(F.sum("taken")).first()[0]
    out = mixing.repeat_taken(mixed)
    assert out.agg(F.sum(mixing.word_count("text"))).first()[0] == want
    whole = {r.doc_id: r.text for r in docs.collect()}
    assert all(whole[r.doc_id].startswith(r.text) for r in out.collect())


def test_url_parts_and_rules(spark):
    cases = [
        ("http://A.Example.COM/en/7x?y#z", "a.example.com", "/en/7x", "example.com/en/7", "allow"),
        ("https://a.com/en/8", "a.com", "/en/8", "com/en/", "block"),
        ("x://net/de/1", "net", "/de/1", "net/de/", "allow"),
        ("x://q.example.net/de/8", "q.example.net", "/de/8", "example.net/de/8", "block"),
        ("x://notexample.net/de/8", "notexample.net", "/de/8", "net/de/", "allow"),
        ("x://b.org/es", "b.org", "/es", None, None),
        ("x://b.org/es/#", "b.org", "/es/", "org/es/", "block"),
        ("x://h?a/b", "h", "", None, None), ("x://h#a/b", "h", "", None, None), ("no scheme", "", "", None, None), (None, "", "", None, None), ("", "", "", None, None), ("x://", "", "", None, None),
        ("http://É.com/en/a://b", "É.com", "/en/a://b", "com/en/", "block"),
    ]
    pages = spark.createDataFrame([(i, c[0], "clash") for i, c in enumerate(cases)], "page_id long, url string, host string")
    none = spark.createDataFrame([], "url string, bad int")
    got = {r.page_id: r for r in urls.filter_urls(pages, none).collect()}
    for i, (_, host, path, rule, verdict) in enumerate(cases):
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule)
        assert got[i].verdict == verdict or verdict is None
    assert urls.filter_urls(pages.limit(0), none).collect() == []


def test_reputation_shrinks(spark):
    rows = [(f"bad{i}.example.org", int(k < 27)) for i in range(6) for k in range(30)] + [(f"good{i}.other.org", int(k < 2)) for i in range(6) for k in range(30)]
    rows += [("rare.example.org", 1), ("new.example.org", None), ("new.other.org", None), ("sure.other.org", None), *[("sure.other.org", 1)] * 60]
    got = {r.host: r for r in urls.reputation(spark.createDataFrame(rows, "host string, bad int")).collect()}
    assert got["bad0.example.org"].bound > 0.5 > got["good0.other.org"].bound and got["new.example.org"].rate > 0.6 > got["new.other.org"].rate
    assert got["sure.other.org"].bound > 0.5 and got["bad0.example.org"].rate < 1 and got["rare.example.org"].n == 1
    # a host's own outcomes are no part of its prior: alone, it is shrunk to the rest only
    alone = {r.host: r for r in urls.reputation(spark.createDataFrame([("a.org", 1)] * 5 + [("b.com", 0)] * 5, "host string, bad int")).collect()}
    assert 0.5 < alone["a.org"].rate < 1 and 0 < alone["b.com"].rate < 0.5


def test_registered_domains(spark):
    hosts = ["a.b.co.uk", "b.co.uk", "co.uk", "x.y.com", "com", ""]
    rows = spark.createDataFrame([(h,) for h in hosts], "h string").select("h", urls.domain_of(F.col("h")).alias("d"), urls.suffix_of(F.col("h")).alias("s")).collect()
    assert [(r.d, r.s) for r in rows] == [("b.co.uk", "co.uk"), ("b.co.uk", "co.uk"), ("co.uk", "uk"), ("y.com", "com"), ("com", "com"), ("", "")]


def test_low_quantile(spark):
    """Against counts of draws."""
    rng = np.random.default_rng(0)
    cases = [(3.0, 2.0), (30.0, 12.0), (1.0, 1.0), (2.0, 40.0), (500.0, 480.0)]
    df = spark.createDataFrame(cases, "a double, b double").select(urls.low_quantile(F.col("a"), F.col("b")).alias("q"))
    for (a, b), r in zip(cases, df.collect(), strict=True):
        assert abs((rng.beta(a, b, 200_000) < r.q).mean() - (1 - urls.CERTAINTY)) < 0.02


def test_urls_repeated_and_long(spark):
    long = "http://h.example.com/" + "x" * 200_000
    pages = spark.createDataFrame([(1, long), (1, long), (2, "http://h.example.com/a"), (3, "http://b.example.com/a")], "page_id long, url string")
    labelled = spark.createDataFrame([(long, 1)] * 50 + [("http://b.example.com/q", 0)] * 50, "url string, bad int")
    got = sorted((r.page_id, r.verdict, len(r.path)) for r in urls.filter_urls(pages, labelled).collect())
    assert got == [(1, "block", 200_001), (1, "block", 200_001), (2, "block", 2), (3, "allow", 2)]
