"""The pipeline's stages against brute force, each on its own input."""

import re
from collections import Counter, defaultdict

import corpus_pipeline
from graphloom.llm import mixing, token_counts
from graphloom.llm._common import stage
from tests.llm.test_jaccard import brute as classes
from tests.llm.test_simple_operators import fill, library


def test_stages(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    labels = {r.doc_id: r for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    seen = {}
    for name, function in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = stage(function(spark, docs, d), "test")
        seen[name] = (before, docs.collect())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == list(corpus_pipeline.COLUMNS)
    before, after = seen["quality classifier"]
    kept = {r.doc_id for r in after}
    clean = [r for r in before if r.doc_id in labels and labels[r.doc_id].quality and not labels[r.doc_id].toxic]
    bad = [r for r in before if r.doc_id in labels and not labels[r.doc_id].quality]
    assert sum(r.doc_id in kept for r in clean) >= 0.98 * len(clean) and sum(r.doc_id in kept for r in bad) <= 0.2 * len(bad)
    before, after = seen["exact dedup"]
    least = {}
    for r in before:
        t = re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "")
        least[t] = min(r.doc_id, least.get(t, r.doc_id))
    assert sorted(r.doc_id for r in after) == sorted(least.values())
    before, after = seen["n-gram jaccard join"]
    want, n = classes([(r.doc_id, r.text) for r in before])
    assert sorted(r.doc_id for r in after) == sorted({c for _, _, c in want}) and len(after) == n
    before, after = seen["mixing sources"]
    sizes, taken, copies = defaultdict(int), defaultdict(int), Counter(r.doc_id for r in after)
    count = lambda t: len(re.findall(mixing.WORD_REGEX, t or ""))
    for r in before:
        sizes[r.source] += count(r.text)
    for r in after:
        taken[r.source] += count(r.text)
        assert r.n_chars == len(r.text)
    assert max(copies.values()) <= 2 and all(abs(taken[s] - t) < 3 for s, t in fill(sizes).items())
    before, after = seen["bpe encoding"]
    t = library("byte_bpe_50k.json")
    assert Counter(t.decode(memoryview(bytes(r.ids)).cast("I").tolist(), skip_special_tokens=False) for r in after) == Counter(r.text or "" for r in before)
    assert token_counts.vocabulary("byte_bpe_50k.json")


def test_run(spark, small):
    out = corpus_pipeline.run(spark, small)
    assert out.columns == ["doc_id", "lang", "source", "n_chars", "n_tokens", "ids"] and out.count() > 50
