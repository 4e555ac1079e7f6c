"""Substring dedup by seed and extend.

Every run of ``window`` words holds a winnowed anchor: the run of ``seed_words``
words with the least hash in it. Equal windows have equal anchors at the same
place, so only windows around an anchor that occurs again can repeat. Documents
meet on such anchors. An occurrence is extended both ways over all windows that
chose the anchor, and a digest of the extension's bytes stands for it: where two
occurrences agree, all of it repeats. One occurrence of each extension that
differs from others of its anchor is shortened from both ends: its windows are
compared with those of the other extensions, again by digests of their bytes.
Spans that touch are merged, which leaves the maximal repeats of at least
``window`` words. Occurrences meet in sums by digest, never in pairs, so a
passage shared by many documents costs a row for each of its occurrences.

Digests are BLAKE2b with 128 bits of the very bytes, so words that merely share
a hash repeat nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm._common import arrow, keyed, read, stage, without
from graphloom.llm._words import Words, blocks, mix, run_hashes, utf8

WINDOW = 35
SEED_WORDS = 8


def _slide(values: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Minimum (or maximum) of each ``width`` successive values, by doubling."""
    pick = np.minimum if least else np.maximum
    out, k, n = values, 1, len(values) - width + 1
    while 2 * k <= width:
        out = pick(out[:-k], out[k:])
        k *= 2
    return pick(out[:n], out[width - k : width - k + n]) if k < width else out


def digests(body: bytes, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two halves of the digest of each ``body[begin:end]``."""
    view = memoryview(body)
    found = bytearray().join([blake2b(view[a:b], digest_size=16).digest() for a, b in zip(begin.tolist(), end.tolist(), strict=True)])
    both = np.frombuffer(found, np.int64).reshape(-1, 2) if found else np.zeros((0, 2), np.int64)
    return both[:, 0].copy(), both[:, 1].copy()


def anchor_runs(words: Words, window: int, seed_words: int) -> dict[str, np.ndarray]:
    """Runs of windows with one anchor: text, anchor, first and last window (word numbers in the text), digest of the words they cover, and how often the anchor occurs in the text."""
    h, width = words.hashes, window - seed_words + 1
    inside = words.inside(window)
    at = np.flatnonzero(inside)
    if not len(at):
        return {k: np.zeros(0, np.int64) for k in ("text", "anchor", "begin", "end", "w1", "w2", "times")}
    seeds = run_hashes(h, seed_words)
    chosen = _slide(seeds, width, True)
    n = len(inside)
    fresh = np.zeros(n, bool)
    fresh[0] = inside[0]
    fresh[1:] = inside[1:] & ((chosen[1:] != chosen[:-1]) | ~inside[:-1])
    begin = np.flatnonzero(fresh)
    stop = np.zeros(n, bool)
    stop[-1] = inside[-1]
    stop[:-1] = inside[:-1] & (fresh[1:] | ~inside[1:])
    end = np.flatnonzero(stop)
    text = np.searchsorted(words.first, begin, "right") - 1
    # where a window's anchor occurs twice, its text may repeat within the run
    reach = np.zeros(len(seeds) + width, np.uint64)
    reach[width - 1 : width - 1 + n] = np.where(inside, chosen, np.uint64(0))
    selected = np.flatnonzero(_slide(reach, width, False)[: len(seeds)] == seeds)
    owner = np.searchsorted(words.first, selected, "right") - 1
    key = np.concatenate([_pair(seeds[selected], owner), _pair(chosen[begin], text)])
    _, back = np.unique(key, return_inverse=True)
    times = np.bincount(back[: len(selected)], minlength=back.max() + 1)[back[len(selected) :]]
    body, starts, ends = words.joined()
    w1, w2 = digests(body, starts[begin], ends[end + window - 1])
    return {"text": text, "anchor": chosen[begin].view(np.int64), "begin": begin - words.first[text], "end": end - words.first[text], "w1": w1, "w2": w2, "times": times}


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a ^ mix(b.astype(np.uint64) + np.uint64(1))


def repeated_windows(df: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, seed_words: int = SEED_WORDS) -> DataFrame:
    """For each row key ``(__a, __b)``: ``spans``, the words [begin, end) of runs of windows that start anywhere else too."""
    docs = keyed(df.select(key, text), key, text).select("__a", "__b", text)

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.asarray(batch.column(i)) for i in (0, 1))
            data, offsets = utf8(batch.column(2))
            for i, j in blocks(offsets):
                r = anchor_runs(Words(data, offsets[i : j + 1], False), window, seed_words)
                t = r["text"] + i
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a[t]), pa.array(b[t]), *[pa.array(r[k]) for k in ("anchor", "w1", "w2")], *[pa.array(r[k].astype(np.int32)) for k in ("begin", "end", "times")]],
                    names=["__a", "__b", "anchor", "w1", "w2", "begin", "end", "times"],
                )

    runs = stage(arrow(docs, seeds, "__a long, __b long, anchor long, w1 long, w2 long, begin int, end int, times int"), "anchor-runs")
    # Most anchors occur once; what follows moves only the others.
    again = runs.groupBy("anchor").agg(F.count("*").alias("n"), F.max("times").alias("most")).where("n > 1 or most > 1").select(F.col("anchor").alias("__anchor"))
    hits = stage(runs.join(again, F.col("anchor") == F.col("__anchor")).drop("__anchor"), "anchor-hits")
    # Extensions of each anchor: how many occurrences (a row that occurs n times has n), one of them. All firsts are of one row.
    one = [F.first(c).alias(c) for c in ("__a", "__b", "begin", "end")]
    extensions = stage(hits.groupBy("anchor", "w1", "w2").agg(F.count("*").alias("n"), F.max("times").alias("times"), *one), "anchor-extensions")
    mixed = extensions.groupBy("anchor").agg(F.count("*").alias("kinds"), F.max("times").alias("most")).where("kinds > 1 or most > 1").select(F.col("anchor").alias("__anchor"))
    # Extensions that occur twice repeat as a whole.
    twice = extensions.where("n > 1").select(*[F.col(c).alias(f"__{c}") for c in ("anchor", "w1", "w2")])
    same = (F.col("anchor") == F.col("__anchor")) & (F.col("w1") == F.col("__w1")) & (F.col("w2") == F.col("__w2"))
    whole = hits.join(twice, same).select("__a", "__b", "begin", (F.col("end") + window).alias("end"))
    # One occurrence of each extension of an anchor that has several is taken apart into windows.
    parts = extensions.join(mixed, F.col("anchor") == F.col("__anchor")).select("__a", "__b", F.struct("begin", "end", F.least("n", F.lit(2)).cast("int").alias("n")).alias("run"))
    lists = parts.groupBy("__a", "__b").agg(F.collect_list("run").alias("runs")).select(F.col("__a").alias("__x"), F.col("__b").alias("__y"), "runs")
    texts = docs.join(lists, (F.col("__a") == F.col("__x")) & (F.col("__b") == F.col("__y"))).drop("__x", "__y")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.asarray(batch.column(i)) for i in (0, 1))
            data, offsets = utf8(batch.column(2))
            lists = batch.column(3)
            at = np.asarray(lists.offsets) - lists.offsets[0].as_py()
            begin, end, n = (np.asarray(x) for x in lists.flatten().flatten())
            for i, j in blocks(offsets):
                words = Words(data, offsets[i : j + 1], False)
                body, starts, ends = words.joined()
                r = slice(at[i], at[j])
                doc = np.repeat(np.arange(i, j), np.diff(at[i : j + 1]))
                size = end[r] - begin[r] + 1
                k = np.repeat(np.arange(len(size)), size)
                place = np.arange(len(k)) - np.repeat(np.cumsum(size) - size, size) + begin[r][k]
                first = place + words.first[doc[k] - i]
                h1, h2 = digests(body, starts[first], ends[first + window - 1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a[doc[k]]), pa.array(b[doc[k]]), pa.array(h1), pa.array(h2), pa.array(place.astype(np.int32)), pa.array(n[r][k].astype(np.int32))],
                    names=["__a", "__b", "h1", "h2", "begin", "n"],
                )

    # A repeated row (same key) meets its run once for each of its copies; its windows then count as repeated, as they are.
    single = stage(arrow(texts, windows, "__a long, __b long, h1 long, h2 long, begin int, n int"), "anchor-windows")
    found = single.groupBy("h1", "h2").agg(F.sum("n").alias("n")).where("n > 1").select(F.col("h1").alias("__h1"), F.col("h2").alias("__h2"))
    more = single.join(found, (F.col("h1") == F.col("__h1")) & (F.col("h2") == F.col("__h2"))).select("__a", "__b", "begin", (F.col("begin") + window).alias("end"))
    # A set, not a list: the copies of a repeated row have the same spans.
    return whole.unionByName(more).groupBy("__a", "__b").agg(F.collect_set(F.struct("begin", "end")).alias("spans"))


def merged(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs [begin, end) that remain when spans that touch or overlap become one, in order."""
    order = np.argsort(begin, kind="stable")
    begin, reach = begin[order], np.maximum.accumulate(end[order])
    fresh = np.concatenate([[True], begin[1:] > reach[:-1]])
    return begin[fresh], reach[np.concatenate([fresh[1:], [True]])]


def remove_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, seed_words: int = SEED_WORDS, digests: bool = False) -> DataFrame:
    """All rows of ``df`` with ``n_words``, ``n_removed``, ``repeats`` (the maximal repeats as words [begin, end)) and the kept words joined by one space in place of the text.

    With ``digests``, ``kept_sha256`` takes the place of the text. A word goes if a
    window that covers it also starts anywhere else, in the same document or
    another; windows are judged on the input. A null or empty text has no words;
    texts of fewer than ``window`` words lose none; a long text is read whole, in
    a block of its own. Rows with a null key count like others. A repeated row
    repeats all its windows. An empty table gives an empty one. Columns named like
    an added one are replaced.
    """
    span = T.ArrayType(T.StructType([T.StructField("begin", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    added: dict[str, T.DataType] = {"n_words": T.LongType(), "n_removed": T.LongType(), "repeats": span, ("kept_sha256" if digests else text): T.StringType()}
    data = without(df, *[c for c in added if c != text])
    rest = [c for c in data.columns if c != text]
    spans = repeated_windows(data, key, text, window, seed_words).select(F.col("__a").alias("__x"), F.col("__b").alias("__y"), "spans")
    joined = keyed(data, key, text).join(spans, (F.col("__a") == F.col("__x")) & (F.col("__b") == F.col("__y")), "left")
    schema = T.StructType([*[data.schema[c] for c in rest], *[T.StructField(k, v) for k, v in added.items()]])

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import sha256

        for batch in batches:
            *others, column, lists = batch.columns
            data, offsets = utf8(column)
            out, n, gone, left, right, ends = [], [], [], [], [], [0]
            at = np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0))])
            begin, end = (np.asarray(x) for x in lists.flatten().flatten())
            for i in range(len(column)):
                words = data[offsets[i] : offsets[i + 1]].tobytes().split()
                n.append(len(words))
                a, b = merged(begin[at[i] : at[i + 1]], end[at[i] : at[i + 1]]) if at[i + 1] > at[i] else ((), ())
                left.extend(a)
                right.extend(b)
                ends.append(len(left))
                if len(a):
                    edges = [0, *np.column_stack([a, b]).ravel().tolist(), len(words)]
                    words = [w for x, y in zip(edges[::2], edges[1::2], strict=True) for w in words[x:y]]
                gone.append(n[-1] - len(words))
                kept = b" ".join(words)
                out.append(sha256(kept).hexdigest() if digests else kept.decode())
            pairs = pa.StructArray.from_arrays([pa.array(left, pa.int32()), pa.array(right, pa.int32())], names=["begin", "end"])
            repeats = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)
            yield pa.RecordBatch.from_arrays([*others, pa.array(n, pa.int64()), pa.array(gone, pa.int64()), repeats, pa.array(out, pa.string())], names=[f.name for f in schema])

    return arrow(joined.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{text}`"), "spans"), keep, schema)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs, digests=True).select("doc_id", "n_words", "n_removed", "kept_sha256")


QUERIES = {"op6_substring_dedup": op6_substring_dedup}
ORACLE = {
    "op6_substring_dedup": r"""
WITH d AS MATERIALIZED (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
v AS MATERIALIZED (SELECT doc_id, i, md5(array_to_string(w[i : i + 34], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35) z),
again AS (SELECT h FROM v GROUP BY h HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS i FROM v WHERE h IN (SELECT h FROM again)),
words AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS t FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id
"""
}
