"""Quality classifier: held-out accuracy, shrinkage of sites, odd tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import quality


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    known, held = labels.where("doc_id % 4 != 1"), labels.where("doc_id % 4 = 1")
    got = quality.classify(docs, known, carry=False).join(held, "doc_id").collect()
    assert len(got) > 60
    assert sum((r.quality_score >= 0.5) == (r.quality == 1) for r in got) >= 0.95 * len(got)
    assert sum((r.toxic_score > 0.5) == (r.toxic == 1) for r in got) >= 0.9 * len(got)  # 33 toxic documents to learn from
    clean = [r for r in got if r.quality == 1 and r.toxic == 0]
    assert sum(r.kept for r in clean) >= 0.98 * len(clean)


def test_sites_shrink(spark):
    rows = [(i, "h", "en") for i in range(100)] + [(i, "g", "en") for i in range(100, 200)] + [(200, "h", "rare"), (201, None, None), (202, "new", "en")]
    marks = [(i, int(i % 10 == 0), 0) for i in range(100)] + [(i, int(i % 10 != 0), 0) for i in range(100, 200)] + [(200, 1, 0), (201, None, 0)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string")
    sites = quality.site_posteriors(df, spark.createDataFrame(marks, "doc_id long, quality int, toxic int"))
    at = {(r.host, r.path): r for r in sites.collect()}
    rate = (10 + 90 + 1 + 1) / (201 + 2)
    assert at["h", "en"].path_q < at["h", "rare"].path_q < 0.5 < at["g", "en"].path_q and abs(at["new", "en"].path_q - rate) < 1e-9
    assert (None, None) in at and at["new", "en"].path_t < 0.02


def brute_sites(rows, marks):
    """Counts, prior strengths and posteriors of each site, one by one."""
    known = {k: (q, t) for k, q, t in marks}
    paths, hosts = {}, {}
    for key, host, path in rows:
        paths.setdefault((host, path), [0, 0, 0])
        if key in known:
            q, t = known[key]
            for i, v in enumerate((1, q, t)):
                paths[host, path][i] += v
    for (host, _), c in paths.items():
        hosts[host] = [a + b for a, b in zip(hosts.get(host, [0, 0, 0]), c, strict=True)]
    total = [sum(c[i] for c in paths.values()) for i in range(3)]

    def strength(groups):
        groups = [(n, x, p) for n, x, p in groups if n > 1]
        within = sum(p * (1 - p) for _, _, p in groups) / len(groups)
        size = sum(n for n, _, _ in groups)
        between = sum(n * (x / n - p) ** 2 for n, x, p in groups) / size
        excess = (between - within / (size / len(groups))) / within
        return min(1e4, max(1.0, 1 / excess - 1)) if excess > 1e-4 else 1e4

    out = {k: [c[0]] for k, c in paths.items()}
    for i in (1, 2):
        rate = (total[i] + 1) / (total[0] + 2)
        k = strength([(c[0], c[i], rate) for c in hosts.values()])
        host = {h: (c[i] + k * rate) / (c[0] + k) for h, c in hosts.items()}
        prior = {(h, p): (hosts[h][i] - c[i] + k * rate) / (hosts[h][0] - c[0] + k) for (h, p), c in paths.items()}
        own = strength([(c[0], c[i], host[h]) for (h, _), c in paths.items()])
        for (h, p), c in paths.items():
            both = 1 / (1 / own + 1 / (hosts[h][0] - c[0] + k))
            out[h, p] += [both, prior[h, p], (c[i] + both * prior[h, p]) / (c[0] + both)]
    return out


def test_sites_against_brute_force(spark):
    rng = np.random.default_rng(2)
    rate = {h: rng.beta(2, 3) for h in "abcdef"}
    rows = [(i, str(rng.choice(list("abcdef"))), str(rng.choice(["en", "de", "fr"]))) for i in range(900)]
    marks = [(i, int(rng.random() < rate[h]), int(rng.random() < 0.1)) for i, h, _ in rows if rng.random() < 0.7]
    sites = quality.site_posteriors(spark.createDataFrame(rows, "doc_id long, source string, lang string"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int"))
    got = {(r.host, r.path): [r.n, r.kq, r.prior_q, r.path_q, r.kt, r.prior_t, r.path_t] for r in sites.collect()}
    want = brute_sites(rows, marks)
    assert got.keys() == want.keys()
    for site, values in want.items():
        assert np.allclose(got[site], values, rtol=1e-9), site


def test_evidence_is_beyond_the_site():
    """A word that only marks a bad site tells nothing once the site is known; one that marks bad texts does."""
    rng = np.random.default_rng(5)
    n = 4000
    site, word = rng.random(n) < 0.5, rng.random(n) < 0.5
    odds = np.where(site, -2.0, 2.0) + np.where(word, -1.5, 1.5)
    good = (rng.random(n) < 1 / (1 + np.exp(-odds))).astype(float)
    text = np.concatenate([np.flatnonzero(site), np.flatnonzero(word)])
    bucket = np.concatenate([np.full(site.sum(), 7), np.full(word.sum(), 9)])
    order = np.argsort(text, kind="stable")
    targets = np.column_stack([good, np.zeros(n)])
    offset = np.column_stack([np.where(site, -2.0, 2.0), np.full(n, -5.0)])
    model = quality.fit(n, text[order], bucket[order], np.zeros((n, quality.STYLE)), targets, offset, steps=600)
    assert abs(model.words[7, 0]) < 0.5 and model.words[9, 0] < -2
    assert quality.fit(0, text[:0], bucket[:0], np.zeros((0, quality.STYLE)), targets[:0], offset[:0]).evidence(1, np.array([0]), np.array([7]), np.zeros((1, quality.STYLE))).tolist() == [[0, 0]]


def test_training_rows_are_bounded(spark):
    """A repeated key counts once, and texts are left out beyond the room for their words (a few share a bucket)."""
    rows = [(1, "a b c d", "s", "l")] * 50 + [(k, " ".join(f"w{k}x{i}" for i in range(100)), "s", "l") for k in range(2, 30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(1, 30)], "doc_id long, quality int, toxic int")
    sizes = []
    real = quality.fit

    def fit(n, text, *more):
        sizes.append((n, len(text)))
        return real(n, text, *more)

    quality.fit = fit
    try:
        sites = quality.site_posteriors(df, labels)
        quality.train(df, labels, sites)
        quality.train(df, labels, sites, room=1000)
    finally:
        quality.fit = real
    assert sizes[0][0] == 29 and 2780 < sizes[0][1] <= 2804 and 0 < sizes[1][1] <= 1000


@pytest.mark.parametrize("labelled", [True, False])
def test_odd_tables(spark, labelled):
    rows = [(1, None, None, None, 5), (2, "", "a", "en", None), (3, "word " * 50_000, "a", "en", 1), (3, "word " * 50_000, "a", "en", 1), (None, "x", "a", None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, kept int")
    marks = spark.createDataFrame([(2, 1, 0), (2, 1, 0), (3, 0, 1), (None, 1, 1), (9, None, None)] if labelled else [], "doc_id long, quality int, toxic int")
    got = quality.classify(df, marks).collect()
    assert len(got) == 5 and all(r.kept is not None and 0 <= r.quality_score <= 1 for r in got)
    if not labelled:
        assert all(r.kept and r.quality_score == 0.5 for r in got)
    assert quality.classify(df.where(F.lit(False)), marks).collect() == []
