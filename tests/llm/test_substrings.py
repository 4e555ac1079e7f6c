"""Substring dedup against brute force."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest

from graphloom.llm import substrings
from graphloom.llm._words import Words, run_hashes, utf8


def brute(rows, window):
    words = [re.findall(r"[^\x20\x09-\x0D]+", r[1] or "") for r in rows]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (key, *_), w in zip(rows, words, strict=True):
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((str(key), len(w), len(gone), kept))
    return sorted(out)


def check(spark, rows, window, seed_words):
    df = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, n_words int")
    got = sorted((str(r.doc_id), r.n_words, r.n_removed, r.text) for r in substrings.remove_repeats(df, window=window, seed_words=seed_words).collect())
    assert got == brute(rows, window)


def test_random_texts(spark):
    rng = np.random.default_rng(3)
    base = [" ".join(rng.choice(list("abcdefgh"), 60)) for _ in range(6)]
    rows = []
    for i in range(60):
        a, b = rng.integers(0, 6, 2)
        x, y = rng.integers(0, 50, 2)
        rows.append((i, "\n".join([base[a][x : x + 40], " ".join(rng.choice(list("abcdefghij"), rng.integers(0, 30))), base[b][y : y + 30]])))
    rows += [(100, "p q r " * 30), (101, "z " * 50), (102, "z " * 7), (103, None), (104, ""), (105, "  \t "), (None, "lone words"), (106, "One one ONE " * 3), (107, "p q r p q r p q"), (107, "p q r p q r p q"), (107, "another text of this id " * 2)]
    check(spark, rows, 7, 3)
    check(spark, rows, 5, 5)


def test_empty(spark):
    assert substrings.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_documents(spark, small):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    want = {(k, n, g, hashlib.sha256(t.encode()).hexdigest()) for k, n, g, t in brute(rows, 35)}
    assert {(str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in substrings.op6_substring_dedup(spark, small).collect()} == want


def test_word_hashes():
    import pyarrow as pa

    texts = ["a b  c", "", None, " b\tc ", "Ab é😀\nx", "c"]
    data, offsets = utf8(pa.array(texts))
    w = Words(data, offsets, False)
    found = [t for x in texts for t in re.findall(r"[^\x20\x09-\x0D]+", x or "")]
    assert [x.decode() for x in w.words] == found
    body, starts, ends = w.joined()
    assert [body[a:b].decode() for a, b in zip(starts, ends, strict=True)] == found
    assert list(np.diff(w.first)) == [3, 0, 0, 2, 3, 1]
    assert len(set(w.hashes.tolist())) == len(set(found)) and w.hashes[1] == w.hashes[3] and w.hashes[2] == w.hashes[-1]
    assert list(w.inside(2)) == [True, True, False, True, False, True, True, False]
    assert run_hashes(w.hashes, 2)[1] == run_hashes(w.hashes, 2)[3]
    low, other = Words(data, offsets, True), Words(data, offsets, False, 1)
    assert low.hashes[0] != low.hashes[5] and len(low.hashes) == len(w.hashes)
    assert not set(w.hashes.tolist()) & set(other.hashes.tolist())


@pytest.mark.parametrize("length", [1, 2, 3, 5, 8, 35])
def test_run_hashes(length):
    rng = np.random.default_rng(length)
    w = rng.integers(0, 3, 400).astype(np.uint64)
    runs = [tuple(w[i : i + length].tolist()) for i in range(400 - length + 1)]
    got = run_hashes(w, length).tolist()
    assert len(got) == len(runs) and len(set(zip(runs, got, strict=True))) == len(set(runs)) == len(set(got))
    assert run_hashes(w[: length - 1], length).tolist() == []


def thue_morse(a, b, power):
    """Two different sequences of ``a`` and ``b`` that any polynomial modulo 2 ** 64 hashes alike."""
    signs = [bin(i).count("1") % 2 for i in range(1 << power)]
    return [(a, b)[s] for s in signs], [(b, a)[s] for s in signs]


def test_words_that_polynomials_confuse(spark):
    x, y = ("".join(t) for t in thue_morse("a", "b", 11))
    line = " ".join(f"w{i}" for i in range(34))
    check(spark, [(1, f"{line} {x}"), (2, f"{line} {y}"), (3, f"{y} {line}"), (4, f"{line} {x}")], 35, 8)
    p, q = thue_morse("left", "right", 11)
    check(spark, [(1, " ".join(p)), (2, " ".join(q)), (3, " ".join(p[:1200]))], 35, 8)


def test_long_text_and_many_copies_of_a_row(spark):
    rng = np.random.default_rng(1)
    passage = " ".join(f"p{i}" for i in range(60))
    long = " ".join(f"w{i}" for i in rng.integers(0, 1 << 40, 300_000))
    rows = [(1, f"{long} {passage} {long[:2000]}"), (2, f"x {passage} y"), *[(3, f"{passage} of a row that is there often")] * 300]
    check(spark, rows, 35, 8)


def test_repeats(spark):
    passage = " ".join(f"p{i}" for i in range(50))
    df = spark.createDataFrame([(1, f"a b {passage} c"), (2, f"{passage} {passage}"), (3, "one two")], "doc_id long, text string")
    got = {r.doc_id: [tuple(s) for s in r.repeats] for r in substrings.remove_repeats(df).collect()}
    assert got == {1: [(2, 52)], 2: [(0, 100)], 3: []}


@pytest.mark.parametrize("width", [1, 2, 3, 5, 8, 28])
def test_slide(width):
    v = np.random.default_rng(0).integers(0, 99, 60)
    want = [v[i : i + width].min() for i in range(60 - width + 1)]
    assert list(substrings._slide(v, width, True)) == want
