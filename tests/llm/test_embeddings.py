"""Lattice hashing against brute force; components against union-find."""

from itertools import product

import numpy as np
import pytest

from graphloom.llm import _components, _lattice, embeddings


def brute(rows, cosine=0.9):
    def unit(v):
        if not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            return None
        x = np.array(v, np.float64)
        return x / np.sqrt((x * x).sum())

    u = [unit(v) for _, v in rows]
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    n = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            if u[i] is not None and u[j] is not None and len(u[i]) == len(u[j]) and u[i] @ u[j] >= cosine:
                n[i] += 1
                n[j] += 1
                up[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[find(i)] = min(k, least.get(find(i), k))
    return sorted((str(k), n[i], least.get(find(i))) for i, (k, _) in enumerate(rows))


@pytest.mark.parametrize("plan,chunk", [(None, 2048), ((0, 1, 0.25, 6, 2), 8), ((0, 2, 0.3, 12, 4), 2048)])
def test_against_brute_force(spark, plan, chunk):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((12, 64))
    rows = []
    for i in range(240):
        v = centres[i % 12] + rng.standard_normal(64) * rng.choice([0.05, 0.25, 0.33, 2.0])
        rows.append((i, v.astype(np.float32).tolist()))
    rows += [(500, rows[0][1]), (501, rows[0][1]), (3, rows[3][1]), (None, rows[5][1]), (502, None), (503, []), (504, [0.0] * 64), (505, [1.0] * 63), (506, [float("nan")] * 64), (507, [float("inf")] + [1.0] * 63), (508, [None] + [1.0] * 63), (509, [-x for x in rows[0][1]]), (510, [3 * x for x in rows[1][1]])]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "vec_id long, embedding array<float>, n_links string")
    got = embeddings.near_duplicates(df, plan=plan, chunk=chunk).collect()
    want = brute(rows)
    found, all_ = sum(r.n_links for r in got), sum(n for _, n, _ in want)
    assert len(got) == len(rows) and 0.97 * all_ <= found <= all_
    if found == all_:
        assert sorted((str(r.vec_id), r.n_links, r.component_id) for r in got) == want
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


@pytest.mark.parametrize("plan", embeddings.PLANS)
def test_registered_plans(spark, plan):
    """Each plan finds nearly all pairs at the least cosine, and the links of a table."""
    rng = np.random.default_rng(8)
    x, y = (a / np.sqrt((a * a).sum(1))[:, None] for a in rng.standard_normal((2, 1500, 64)))
    y -= (x * y).sum(1)[:, None] * x
    y = 0.9 * x + np.sqrt(1 - 0.9**2) * y / np.sqrt((y * y).sum(1))[:, None]
    i, j = (embeddings.Lattice(64, *plan[1:]).keys(v) for v in (x, y))
    meet = (i[:, :, :1] == j).any(2) | (j[:, :, :1] == i).any(2)
    assert meet.any(1).mean() >= 0.99
    rows = [(k, v.astype(np.float32).tolist()) for k, v in enumerate(np.concatenate([x[:150], 0.92 * x[:150] + 0.39 * y[150:300]]))]
    got = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), plan=plan).collect()
    all_ = sum(n for _, n, _ in brute(rows))
    assert all_ > 200 and 0.98 * all_ <= sum(r.n_links for r in got) <= all_


def test_links_do_not_follow_from_the_size_of_the_table(spark, monkeypatch):
    """Rows that link with none of the others change no link: no plan is taken by the number of vectors."""
    monkeypatch.setattr(embeddings, "PLANS", ((20, 1, 0.25, 6, 2), (1 << 62, 1, 0.02, 1, 0)))
    rng = np.random.default_rng(6)
    base = rng.standard_normal((10, 64))
    rows = [(k, (base[k % 10] + 0.2 * rng.standard_normal(64)).tolist()) for k in range(20)]
    more = [(100 + k, rng.standard_normal(65).tolist()) for k in range(10)]
    got = [embeddings.near_duplicates(spark.createDataFrame(r, "vec_id long, embedding array<double>")).where("vec_id < 100").collect() for r in (rows, rows + more)]
    assert sorted(got[0]) == sorted(got[1])
    assert sorted((str(r.vec_id), r.n_links, r.component_id) for r in got[1]) == brute(rows)


def test_lengths(spark):
    """Vectors of every length link with those of their length."""
    rng = np.random.default_rng(3)
    rows = []
    for size, copies in ((64, 30), (16, 12), (5, 8), (1, 3), (1500, 6)):
        base = rng.standard_normal(size)
        for i in range(copies):
            rows.append((len(rows), (base + rng.standard_normal(size) * 0.05).astype(np.float32).tolist()))
        rows.append((len(rows), rows[-1][1]))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = embeddings.near_duplicates(df).collect()
    assert sorted((str(r.vec_id), r.n_links, r.component_id) for r in got) == brute(rows)


def test_documents_table(spark, small):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()]
    got = embeddings.op4_embedding_near_dedup(spark, small).collect()
    assert sorted((str(r.vec_id), r.n_links, r.component_id) for r in got) == brute(rows)


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert embeddings.near_duplicates(df).collect() == []


def test_lattice():
    rng = np.random.default_rng(0)
    short = _lattice.shortest()
    assert len(short) == 240 and len({tuple(v) for v in short}) == 240
    y = rng.uniform(-1, 1, (200, 8))
    p = _lattice.nearest(y)
    assert (np.isclose(2 * p, np.rint(2 * p)).all()) and (np.rint(p.sum(1)) % 2 == 0).all()
    gap = ((y - p) ** 2).sum(1)
    assert (gap <= 1 + 1e-9).all()
    for v in short:
        assert (((y - p - v) ** 2).sum(1) >= gap - 1e-9).all()


def test_components(spark):
    rng = np.random.default_rng(1)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 80, (50, 2))] + [(i, i + 1) for i in range(100, 160)] + [(5, 5), (None, 3)]
    got = {r.id: r.component for r in _components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    label = {x: x for e in links for x in e if x is not None}
    for _, (a, b) in product(range(len(links)), [e for e in links if None not in e]):
        label[a] = label[b] = min(label[a], label[b])
    touched = {x for a, b in links if None not in (a, b) and a != b for x in (a, b)}
    assert got == {x: label[x] for x in touched}
