"""Jaccard join against brute force."""

import re

import numpy as np
import pyarrow as pa

from graphloom.llm import jaccard


def brute(rows):
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if shared and 100 * shared >= 75 * (len(sets[i]) + len(sets[j]) - shared):
                up[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[find(i)] = min(k, least.get(find(i), k))
    return sorted((str(k), len(sets[i]), least.get(find(i))) for i, (k, _) in enumerate(rows)), len({find(i) for i in range(len(rows))})


def check(spark, rows, **more):
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, kept string")
    want, classes = brute(rows)
    got = jaccard.near_duplicates(df, **more).collect()
    assert sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in got) == want
    assert sum(r.kept for r in got) == classes
    assert all(r.doc_id == r.component_id for r in got if r.kept)
    slim = jaccard.near_duplicates(df, carry=False).collect()
    assert sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in slim) == want


    alone = jaccard.representatives(df, **more).collect()
    assert len(alone) == classes and sorted(str(r.doc_id) for r in alone) == sorted(str(r.doc_id) for r in got if r.kept)
    assert all(r.kept == "clash" for r in alone)


def edited(rng, words, n):
    words = list(words)
    for i in rng.integers(0, len(words), n):
        words[i] = f"new{rng.integers(1 << 30)}"
    return " ".join(words)


def test_families(spark):
    rng = np.random.default_rng(4)
    rows, k = [], 0
    for size in (6, 11, 30, 120, 400):
        base = [f"w{x}" for x in rng.integers(0, 1 << 30, size)]
        shared = " ".join(f"p{x}" for x in rng.integers(0, 1 << 30, 60))
        for i in range(14):
            rows.append((1000 - k, edited(rng, base, int(rng.integers(0, 2 + size // 40)))))
            rows.append((2000 + k, " ".join(f"q{x}" for x in rng.integers(0, 1 << 30, 20)) + " " + shared))
            k += 1
        chain = list(base)
        for i in range(10):  # each links to the next, the ends do not
            rows.append((3000 + k, " ".join(chain)))
            at = int(size * i / 10)
            chain[at] = f"c{k}"
            k += 1
    check(spark, rows, chunk=16, stars=1, sample=10, hot=2, held=20)


def test_odd_rows(spark):
    a = "one two three four five six seven"
    rows = [(1, None), (2, ""), (3, " \n"), (4, "One two"), (5, "one\tTWO "), (6, "two one"), (7, a), (8, a.upper()), (8, a.upper()), (9, a + " eight"), (None, a), (None, "lone text of a null key"), (None, "lone text of a null key"), (10, "x " * 100_000), (11, "x x x x x x"), (12, "É one"), (13, "é one"), (14, "one two three four five"), (15, "one two three four")]
    check(spark, rows, chunk=16, stars=1, sample=10, hot=2, held=20)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.near_duplicates(df).collect() == []


def test_documents(spark, small):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    got = jaccard.op8_ngram_jaccard_join(spark, small).collect()
    assert sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in got) == brute(rows)[0]


def test_shared_counts():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 60, 25).astype(np.uint64)) for _ in range(12)]
    got = jaccard.shared_counts(sets)
    assert all(got[i][j] == len({*sets[i].tolist()} & {*sets[j].tolist()}) for i in range(12) for j in range(12) if i != j)


def test_bitmaps_never_leave_out_a_similar_pair():
    rng = np.random.default_rng(1)
    sets = []
    for n in (1, 3, 40, 100, 127, 129, 250, 260, 1000, 1030):
        base = rng.integers(0, 1 << 64, n, dtype=np.uint64)
        for share in (1.0, 0.97, 0.9, 0.86, 0.85, 0.5, 0.0):
            own = rng.integers(0, 1 << 64, n - int(n * share), dtype=np.uint64)
            sets.append(np.unique(np.concatenate([base[: int(n * share)], own])))
    bits = [jaccard.bitmap(s) for s in sets]
    offsets = np.cumsum([0, *map(len, bits)])
    size = np.array([len(s) for s in sets])
    got = jaccard.partners(size, np.arange(len(sets)), np.frombuffer(b"".join(bits), np.uint8), offsets, (3, 4))
    linked = [any(4 * (k := len({*a.tolist()} & {*b.tolist()})) >= 3 * (len(a) + len(b) - k) for j, b in enumerate(sets) if j != i) for i, a in enumerate(sets)]
    assert all(g for g, l in zip(got, linked, strict=True) if l) and not got.all()


def test_words_that_polynomials_confuse(spark):
    signs = [bin(i).count("1") % 2 for i in range(1 << 11)]
    x, y = ("".join("ab"[s ^ k] for s in signs) for k in (0, 1))
    line = " ".join(f"w{i}" for i in range(8))
    check(spark, [(1, f"{x} {line}"), (2, f"{y} {line}"), (3, f"{y} {line}"), (4, x), (5, y), (6, f"{x} {x}")])


def test_families_at_production_settings(spark):
    rng = np.random.default_rng(9)
    base = [f"w{x}" for x in rng.integers(0, 1 << 30, 150)]
    rows = [(i, edited(rng, base, int(rng.integers(0, 9)))) for i in range(150)]
    check(spark, rows)


def test_left_list_of_the_least_shared_element(spark):
    """Near copies leave the list of a common line; the lists of their other elements begin with unlike rows."""
    rng = np.random.default_rng(6)

    def words(n):
        return [f"w{x}" for x in rng.integers(0, 1 << 30, n)]

    phrases = [words(5) for _ in range(20_000)]
    data, offsets = jaccard.utf8(pa.array([" ".join(w) for w in phrases]))
    line = phrases[int(np.argmin([s[0] for s in jaccard.shingle_sets(data, offsets)]))]
    base = line + words(145)
    rows = [(i, " ".join(base[i : i + 5])) for i in range(1, 146)]
    rows += [(200 + i, " ".join(line + words(145))) for i in range(14)]
    rows += [(300, " ".join(base)), (301, " ".join([*base[:-1], "new"])), (302, " ".join([*base[:-2], "new", "end"]))]
    check(spark, rows, stars=2, chunk=4)


def test_links_of_a_list_are_a_forest(spark):
    """A list of near copies that are all components of their own returns links in proportion to them, not a link for each two."""
    words = [f"w{x}" for x in range(60)]
    rows = [(k, " ".join([*words, f"a{k}"])) for k in range(90)] + [(100 + k, " ".join([*words[::-1], f"b{k}"])) for k in range(30)] + [(200, "one two three four five")]
    base = jaccard.keyed(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text")
    sets = base.selectExpr("doc_id AS uid", "__a AS a", "__b AS b")
    lists = sets.selectExpr("7L AS h", "uid", "uid AS c")
    links = [(r.a, r.b) for r in jaccard.link_lists(lists, sets, base.select("__a", "__b", "text"), jaccard.WORDS, jaccard.SIMILARITY).collect()]
    assert len(links) == 89 + 29
    label = {k: k for k, _ in rows}
    for a, b in links:
        old, new = label[a], label[b]
        label = {k: new if v == old else v for k, v in label.items()}
    assert sorted(sum(v == x for v in label.values()) for x in set(label.values())) == [1, 30, 90]


def test_links_of_a_family_that_the_first_pass_leaves_apart(spark, monkeypatch):
    """As the pipeline runs it: components get links in proportion to the rows, and one row of the family stays."""
    words = [f"w{x}" for x in range(60)]
    df = spark.createDataFrame([(k, " ".join([*words, f"a{k}"])) for k in range(90)], "doc_id long, text string")
    real, counts = jaccard.components, []
    monkeypatch.setattr(jaccard, "components", lambda links: (counts.append(links.distinct().count()), real(links))[1])
    assert [r.doc_id for r in jaccard.representatives(df, stars=0).collect()] == [0]
    assert len(counts) == 2 and max(counts) < 2 * 90
