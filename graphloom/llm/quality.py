"""Quality classifier: document evidence combined with host and path posteriors by hierarchical empirical Bayes.

Labelled outcomes are summed by host (``source``) and path (``source``, ``lang``).
A path's prior is the rate of its host's other paths, shrunk toward the global
rate; its posterior adds its own outcomes. The strengths of the beta priors
follow from the variance between sites. A logistic model over word presence and
style gives each document the evidence of its text beyond its site: it is fitted
with the log odds of the site, the document's own outcome left out, as a fixed
offset. A document's posterior adds its evidence to the log odds of its path.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.llm._common import arrow, bounded_batches, cut, import_path, read, stage, without
from graphloom.llm._words import blocks, mix, utf8

#: Labelled documents that the text model is fitted on at most, and the words that they hold in all (the counts of sites use all labels).
TRAIN_ROWS = 20_000
TRAIN_FEATURES = 8_000_000
BUCKETS = 1 << 16
#: A word counts for a target if its log odds ratio is so many standard errors from 0.
LEAST_Z = 3.0
STYLE = 8
#: Sites whose posteriors may be broadcast; with more they are joined by a shuffle.
BROADCAST_SITES = 50_000
#: A document is rejected if its posterior of good quality is below, or of being toxic is at least, one half.
CUT = 0.5

_BYTES = np.arange(256)
_UPPER = (_BYTES >= 65) & (_BYTES <= 90)
_DIGIT = (_BYTES >= 48) & (_BYTES <= 57)
_LETTER = _UPPER | ((_BYTES >= 97) & (_BYTES <= 122)) | (_BYTES >= 128)
_SPACE = np.isin(_BYTES, [9, 10, 11, 12, 13, 32])
_STOP = np.isin(_BYTES, [44, 46])
_MARK = ~(_LETTER | _DIGIT | _SPACE | _STOP)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Marks:
    """Runs of letters and digits of a run of texts, as feature hashes (words may share one): text i has ``first[i]`` up to ``first[i + 1]``."""

    values = np.random.Generator(np.random.PCG64(1)).integers(0, 1 << 64, 256, dtype=np.uint64)
    values[65:91] = values[97:123]
    base = 0x9E3779B97F4A7C15

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        start = int(offsets[0])
        self.data, offsets = data[start : int(offsets[-1])], offsets - start
        n = len(self.data)
        gap = ~(_LETTER | _DIGIT)[self.data]
        edge, last = np.empty(n, bool), np.empty(n, bool)
        if n:
            edge[0], edge[1:] = True, gap[:-1]
            edge[offsets[1:-1][offsets[1:-1] < n]] = True
            last[-1], last[:-1] = True, gap[1:]
            ends = offsets[1:-1] - 1
            last[ends[ends >= 0]] = True
        starts, ends = np.flatnonzero(edge & ~gap), np.flatnonzero(last & ~gap) + 1
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(np.where(gap, np.uint64(0), self.values[self.data]) * _powers(self.base, n), out=total[1:])
        self.hashes = mix((total[ends] - total[starts]) * _powers(pow(self.base, -1, 1 << 64), n + 1)[starts])
        self.first = np.searchsorted(starts, offsets)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text of each word present, its bucket, style of each text) for a run of texts; a word counts once a text."""
    n = len(offsets) - 1
    words = Marks(data, offsets)
    number = np.diff(words.first)
    text = np.repeat(np.arange(n), number)
    key = np.unique((text << 16) | (words.hashes & np.uint64(BUCKETS - 1)).astype(np.int64))
    sums = lambda table: np.diff(np.concatenate([[0], np.cumsum(table[words.data])])[offsets - offsets[0]])
    size = np.maximum(np.diff(offsets), 1)
    different = np.bincount(key >> 16, minlength=n)
    several = np.maximum(number, 1)
    style = np.column_stack(
        [
            np.log1p(number),
            different / several,
            sums(_UPPER) / size,
            sums(_MARK) / size,
            sums(_DIGIT) / size,
            sums(_SPACE) / size,
            np.minimum(size / several, 40) / 10,
            sums(_STOP) / several,
        ]
    )
    return key >> 16, key & (BUCKETS - 1), style


class Model(NamedTuple):
    """Weights by bucket, style and target."""

    words: np.ndarray
    style: np.ndarray
    centre: np.ndarray
    scale: np.ndarray
    bias: np.ndarray

    def evidence(self, n: int, text: np.ndarray, bucket: np.ndarray, style: np.ndarray) -> np.ndarray:
        """Log odds of each text and target beyond those of its site."""
        z = (style - self.centre) / self.scale
        both = np.concatenate([z, z * z], axis=1)
        return np.column_stack([np.bincount(text, self.words[bucket, t], n) for t in range(self.words.shape[1])]) + both @ self.style + self.bias


def fit(n: int, text: np.ndarray, bucket: np.ndarray, style: np.ndarray, targets: np.ndarray, offset: np.ndarray, steps: int = 150, rate: float = 0.1, decay: float = 1e-4) -> Model:
    """Logistic regression by Adam over all rows at once, with the log odds of the sites as offset and an L2 penalty on the weights."""
    kinds = targets.shape[1]
    centre, scale = (style.mean(0), style.std(0) + 1e-6) if n else (np.zeros(STYLE), np.ones(STYLE))
    z = np.clip((style - centre) / scale, -1e3, 1e3)
    both = np.concatenate([z, z * z], axis=1)
    # counts of training documents by bucket, target and outcome decide which words speak for a target
    with_ = np.column_stack([np.bincount(bucket, targets[text, t], BUCKETS) for t in range(kinds)])
    all_ = np.bincount(bucket, minlength=BUCKETS)[:, None]
    a, b = with_ + 0.5, all_ - with_ + 0.5
    c, d = targets.sum(0) - with_ + 0.5, n - targets.sum(0) - (all_ - with_) + 0.5
    z_score = np.log(a * d / (b * c)) / np.sqrt(1 / a + 1 / b + 1 / c + 1 / d)
    speaks = np.abs(z_score) >= LEAST_Z
    use = speaks.any(1)[bucket]
    text, bucket = text[use], bucket[use]
    params = [np.zeros((BUCKETS, kinds)), np.zeros((2 * STYLE, kinds)), np.zeros(kinds)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, steps * bool(n) + 1):
        score = offset + np.column_stack([np.bincount(text, params[0][bucket, t], n) for t in range(kinds)]) + both @ params[1] + params[2]
        error = (1 / (1 + np.exp(-np.clip(score, -30, 30))) - targets) / n
        grads = [np.column_stack([np.bincount(bucket, error[text, t], BUCKETS) for t in range(kinds)]) * speaks + decay * params[0], both.T @ error + decay * params[1], error.sum(0)]
        for p, g, a, b in zip(params, grads, first, second, strict=True):
            a += 0.1 * (g - a)
            b += 0.001 * (g * g - b)
            p -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    return Model(params[0], params[1], centre, scale, params[2])


def outcomes(labels: DataFrame, key: str) -> DataFrame:
    """One row a key, ``(__key, quality, toxic)`` as 0 or 1: a label with a null is left out, of repeated ones the worse counts."""
    whole = labels.where("quality is not null and toxic is not null").groupBy(F.col(key).alias("__key"))
    return whole.agg((F.min("quality") != 0).cast("long").alias("quality"), (F.max("toxic") != 0).cast("long").alias("toxic"))


def train(df: DataFrame, labels: DataFrame, sites: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", path: str = "lang", rows: int = TRAIN_ROWS, room: int = TRAIN_FEATURES) -> Model:
    """The text model, fitted on at most ``rows`` labelled documents that hold ``room`` distinct words in all: those with the least hashes of their keys, a repeated key once."""
    chosen = outcomes(labels, key).withColumn("__mix", F.xxhash64("__key")).orderBy("__mix", "__key").limit(rows)
    data = df.join(F.broadcast(chosen), F.col(key) == F.col("__key")).select(F.col(text).alias("text"), F.col(host).alias("host"), F.col(path).alias("path"), "quality", "toxic", "__mix", "__key")
    rest = data.columns[1:]
    kinds = ", ".join(f"`{c}` {data.schema[c].dataType.simpleString()}" for c in rest)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            for i, j in blocks(offsets):
                owner, bucket, style = features(data, offsets[i : j + 1])
                at = np.searchsorted(owner, np.arange(j - i + 1)).astype(np.int32)
                words = pa.ListArray.from_arrays(pa.array(at), pa.array(bucket.astype(np.int32)))
                look = pa.ListArray.from_arrays(pa.array(np.arange(j - i + 1, dtype=np.int32) * STYLE), pa.array(style.ravel()))
                yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(i, j - i) for c in range(1, batch.num_columns)], words, look], names=[*rest, "words", "style"])

    found = stage(arrow(data, extract, f"{kinds}, words array<int>, style array<double>"), "train-features")
    # one row a key, at most ``rows`` of them: their numbers of words fit one task
    order = found.groupBy("__mix", "__key").agg(F.max(F.size("words")).alias("n")).withColumn("sum", F.sum("n").over(W.orderBy("__mix", "__key")))
    taken = found.join(F.broadcast(order.where(F.col("sum") <= room).select(F.col("__key").alias("__k"))), F.col("__key") == F.col("__k")).dropDuplicates(["__key"])
    small = sites.select(F.col("host").alias("__h"), F.col("path").alias("__p"), "n", "q", "t", "kq", "kt", "prior_q", "prior_t")
    joined = taken.join(small, F.col("host").eqNullSafe(F.col("__h")) & F.col("path").eqNullSafe(F.col("__p")))
    own = lambda c, y: (F.col(c) - F.col(y) + F.col(f"k{c}") * F.col(f"prior_{c}")) / (F.col("n") - 1 + F.col(f"k{c}"))
    log_odds = lambda p: F.log(p / (1 - p))
    table = joined.select("words", "style", "quality", "toxic", log_odds(own("q", "quality")).alias("oq"), log_odds(own("t", "toxic")).alias("ot"), "__mix").orderBy("__mix").drop("__mix").toArrow()
    n = table.num_rows
    if not n:
        empty = np.zeros(0, np.int64)
        return fit(0, empty, empty, np.zeros((0, STYLE)), np.zeros((0, 2)), np.zeros((0, 2)))
    lists = table["words"].combine_chunks()
    bucket = np.asarray(lists.flatten(), np.int64)
    owner = np.repeat(np.arange(n), np.diff(np.asarray(lists.offsets)))
    style = np.asarray(table["style"].combine_chunks().flatten()).reshape(n, STYLE)
    columns = lambda *names: np.column_stack([np.asarray(table[c], float) for c in names])
    return fit(n, owner, bucket, style, columns("quality", "toxic"), columns("oq", "ot"))


def strength(groups: DataFrame, good: str, n: str, prior: Column) -> float:
    """Pseudo-count of the beta prior by the method of moments, from sums over the groups."""
    rate = F.col(good) / F.col(n)
    within, between, size = groups.where(F.col(n) > 1).agg(
        F.avg(prior * (1 - prior)), F.sum(F.col(n) * (rate - prior) ** 2) / F.sum(n), F.sum(n) / F.count("*")
    ).first()
    if not within:
        return 1.0
    excess = (between - within / size) / within
    return float(min(1e4, max(1.0, 1 / excess - 1))) if excess > 1e-4 else 1e4


def site_posteriors(df: DataFrame, labels: DataFrame, key: str = "doc_id", host: str = "source", path: str = "lang") -> DataFrame:
    """For each (host, path) of ``df``: labelled rows ``n``, outcomes ``q`` (good) and ``t`` (toxic), and for both the prior's strength (``kq``, ``kt``), its rate (``prior_q``, ``prior_t``) and the posterior rate (``path_q``, ``path_t``).

    Outcomes are summed by path before any shuffle. The prior of a path is made
    of its host's other paths, so that no outcome is counted twice; its strength
    follows from how far paths lie from the rate of their whole host, and is no
    more than what the host's other paths know.
    """
    marks = outcomes(labels, key)
    seen = df.select(key, F.col(host).alias("host"), F.col(path).alias("path")).join(marks, F.col(key) == F.col("__key"), "left")
    paths = cut(seen.groupBy("host", "path").agg(F.count("quality").alias("n"), F.coalesce(F.sum("quality"), F.lit(0)).alias("q"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("t")))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("q").alias("hq"), F.sum("t").alias("ht"))
    joined = cut(paths.join(hosts.withColumnRenamed("host", "__host"), F.col("host").eqNullSafe(F.col("__host"))).drop("__host"))
    total = paths.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("n", "q", "t")]).first()
    of_hosts = joined.select("host", "hn", "hq", "ht").distinct()
    for i, c in enumerate("qt", 1):
        rate = (total[i] + 1.0) / (total[0] + 2.0)
        k = strength(of_hosts, f"h{c}", "hn", F.lit(rate))
        others = F.col("hn") - F.col("n") + F.lit(k)
        joined = joined.withColumn(f"prior_{c}", (F.col(f"h{c}") - F.col(c) + F.lit(k * rate)) / others)
        own = strength(joined, c, "n", (F.col(f"h{c}") + F.lit(k * rate)) / (F.col("hn") + F.lit(k)))
        joined = joined.withColumn(f"k{c}", 1 / (1 / F.lit(own) + 1 / others))
        joined = joined.withColumn(f"path_{c}", (F.col(c) + F.col(f"k{c}") * F.col(f"prior_{c}")) / (F.col("n") + F.col(f"k{c}")))
    return cut(joined.drop("hn", "hq", "ht"))


def classify(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", path: str = "lang", rows: int = TRAIN_ROWS, cut_at: float = CUT, carry: bool = True) -> DataFrame:
    """All rows with ``evidence``, ``site_rate``, ``quality_score``, ``toxic_score`` and ``kept``; ``carry=False`` leaves only the key.

    ``labels(key, quality, toxic)`` cover some rows; labels with a null are left
    out, of repeated ones the worse counts. Repeated rows are judged alike, each
    by itself. Null hosts and paths are sites of their own; a null or empty text
    is a text without words, a long one is read whole, in a block of its own.
    Without any label every score is one half: everything is kept of quality,
    nothing is toxic; an empty table gives an empty one. Columns named like an
    added one are replaced.
    """
    added = ("evidence", "site_rate", "quality_score", "toxic_score", "kept")
    data = without(df, *added)
    sites = site_posteriors(data, labels, key, host, path)
    model = train(data, labels, sites, key, text, host, path, rows)
    columns = data.columns if carry else [key]
    small = sites.select(F.col("host").alias("__h"), F.col("path").alias("__p"), "path_q", "path_t")

    def score(texts: pa.Array) -> pa.Array:
        data, offsets = utf8(texts)
        found = [model.evidence(j - i, *features(data, offsets[i : j + 1])) for i, j in blocks(offsets)]
        e = np.concatenate([np.zeros((0, 2)), *found])
        return pa.StructArray.from_arrays([pa.array(e[:, 0].copy()), pa.array(e[:, 1].copy())], names=["q", "t"])

    import_path(df.sparkSession)
    bounded_batches(df.sparkSession)
    # Only the text goes to Python, and only two numbers come back. Called non-deterministic, it is not copied into filters and so runs once a row.
    evidence = F.arrow_udf(score, "q double, t double").asNondeterministic()
    base = data.select(*[F.col(f"`{c}`") for c in columns], F.col(host).alias("__host"), F.col(path).alias("__path"), evidence(F.col(text)).alias("__e"))
    joined = base.join(F.broadcast(small) if sites.count() <= BROADCAST_SITES else small, F.col("__host").eqNullSafe(F.col("__h")) & F.col("__path").eqNullSafe(F.col("__p")))
    odds = lambda e, p: 1 / (1 + F.exp(-(F.col(e) + F.log(F.col(p) / (1 - F.col(p))))))
    return joined.select(
        *[F.col(f"`{c}`") for c in columns],
        F.col("__e.q").alias("evidence"),
        F.col("path_q").alias("site_rate"),
        odds("__e.q", "path_q").alias("quality_score"),
        odds("__e.t", "path_t").alias("toxic_score"),
    ).withColumn("kept", (F.col("quality_score") >= cut_at) & (F.col("toxic_score") <= cut_at))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return classify(docs, read(spark, sf_dir, "labels"), carry=False)


QUERIES = {"op3_quality_classifier": op3_quality_classifier}
ORACLE: dict[str, str] = {}
