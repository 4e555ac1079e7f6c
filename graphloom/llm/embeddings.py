"""Near-duplicate embeddings by lattice hashing.

Each table projects the unit vectors by a random orthonormal map to one or more
blocks of eight dimensions and decodes every block to the nearest point of the
lattice E8; the points are the bucket. A vector lives in its own bucket and is
also sent to the buckets of the neighbouring cells that it lies nearest to.
Vectors that meet are compared by cosine in double precision. A pair is counted
only in the first table, and there in the one bucket, that its keys name, so no
table of pairs is ever made: each bucket returns counts and a spanning forest.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm._common import arrow, narrow, read, stage, whole_groups, without
from graphloom.llm._components import components
from graphloom.llm._lattice import nearest, shortest

COSINE = 0.9
#: Rows of a bucket compared in one go; a larger bucket is dealt into pairs of chunks.
CHUNK = 2048
#: (unused, blocks, width of a cell, tables, neighbouring cells probed). Two unit vectors with a
#: cosine of 0.9 meet in one table with probability 0.64, 0.45, 0.41; at least 0.996 of such pairs meet in some table.
#: Tables of every size take the first: whether a pair is found follows from its two vectors alone. The others are taken where a caller names them.
PLANS = ((0, 1, 0.25, 6, 2), (0, 2, 0.3, 10, 4), (0, 3, 0.4, 12, 4))
#: Dimensions above which only the columns in use are drawn for a random map.
WIDE = 1024


class Lattice:
    """Keys of vectors of ``size`` components: for each table the own bucket, then the probed ones."""

    def __init__(self, size: int, blocks: int, width: float, tables: int, probes: int, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.width, self.blocks, self.tables, self.probes, self.size = width, blocks, tables, probes, size
        room = max(size, 8 * blocks)
        # Widths hold for 64 dimensions; fewer or more dimensions scale the projections alike.
        drawn = room if room <= WIDE else 8 * blocks
        self.maps = [np.linalg.qr(rng.standard_normal((room, drawn)))[0][:size, : 8 * blocks] * np.sqrt(room / 64) for _ in range(tables)]
        self.codes = rng.integers(1, 1 << 62, (tables, 8 * blocks), dtype=np.int64)
        self.short = shortest()

    def keys(self, unit: np.ndarray) -> np.ndarray:
        """(n, tables, 1 + probes) keys of unit vectors."""
        out = np.empty((len(unit), self.tables, 1 + self.probes), np.int64)
        steps = np.rint(2 * self.short).astype(np.int64)
        for t in range(self.tables):
            y = unit @ self.maps[t] / self.width
            own, lean = np.zeros(len(unit), np.int64), []
            for b in range(self.blocks):
                part = y[:, 8 * b : 8 * b + 8]
                p = nearest(part)
                own += np.rint(2 * p).astype(np.int64) @ self.codes[t, 8 * b : 8 * b + 8]
                lean.append((part - p) @ self.short.T)
            lean = np.concatenate(lean, axis=1)
            best = np.argsort(-lean, axis=1, kind="stable")[:, : self.probes]
            moves = np.concatenate([steps @ self.codes[t, 8 * b : 8 * b + 8] for b in range(self.blocks)])
            out[:, t, 0] = own
            out[:, t, 1:] = own[:, None] + moves[best]
        return out


def unit_vectors(flat: np.ndarray, size: int) -> np.ndarray:
    x = flat.reshape(-1, size).astype(np.float64)
    return x / np.sqrt((x * x).sum(1))[:, None]


def compare(bucket: int, table: int, ids: np.ndarray, weight: np.ndarray, side: np.ndarray, unit: np.ndarray, keys: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links that are counted in this bucket: (id, linked vectors) as two arrays, and the root of each id.

    ``side``: the chunk of each row; where there are two, only pairs across are compared.
    """
    a, b = (np.flatnonzero(side == s) for s in (side.min(), side.max()))
    close = unit[a] @ unit[b].T >= cosine
    i, j = np.nonzero(close)
    i, j = a[i], b[j]
    use = ids[i] < ids[j] if len(a) == len(ids) else np.ones(len(i), bool)
    i, j = i[use], j[use]
    low = ids[i] < ids[j]
    i, j = np.where(low, i, j), np.where(low, j, i)
    if len(i):
        hi, hj = keys[i, :, :1], keys[j, :, :1]
        same, left, right = (hi == hj)[..., 0], (hi == keys[j, :, 1:]).any(2), (hj == keys[i, :, 1:]).any(2)
        first = (same | left | right).argmax(1) == table
        t = np.arange(len(i)), table
        where = np.where(same[t] | left[t], keys[i, table, 0], keys[j, table, 0])
        meet = (same | left | right)[t]
        use = first & meet & (where == bucket)
        i, j = i[use], j[use]
    n = np.zeros(len(ids), np.int64)
    np.add.at(n, i, weight[j])
    np.add.at(n, j, weight[i])
    root = np.arange(len(ids))
    order = np.argsort(ids, kind="stable")
    rank = np.empty(len(ids), np.int64)
    rank[order] = np.arange(len(ids))
    label = rank.copy()
    while len(i):
        before = label.copy()
        np.minimum.at(label, i, before[j])
        np.minimum.at(label, j, before[i])
        label = label[order][label]  # the label of the label
        if (label == before).all():
            break
    root = ids[order[label]]
    return ids, n, root


def near_duplicates(df: DataFrame, key: str = "vec_id", vector: str = "embedding", cosine: float = COSINE, plan: tuple | None = None, chunk: int = CHUNK, seed: int = 0) -> DataFrame:
    """All rows with ``n_links``, ``component_id`` and ``kept``.

    Rows whose vector is null, empty, zero, or holds null or non-finite components
    link with nothing, and vectors only with those of their length. Equal vectors are one
    vector with a weight; a repeated row links with its copies. ``component_id``
    is the least key that links reach, the row's own included; a row with a null
    key counts in links and takes the component of the others it reaches. The
    plan does not follow from the table. Columns named like an added one are
    replaced.
    """
    data = without(df, "n_links", "component_id", "kept")
    v = F.col(vector)
    good = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    good = F.coalesce(good, F.lit(False))
    single = data.where(good).groupBy(v.alias("vector")).agg(F.min(key).alias("least"), F.count("*").alias("weight"))
    single = stage(single.withColumn("uid", F.monotonically_increasing_id()), "vectors")
    _, blocks, width, tables, probes = plan or PLANS[0]
    each = 1 + probes
    # Single precision stays single on its way; all sums are in double precision.
    kind = single.schema["vector"].dataType.simpleString()
    kind = kind if kind == "array<float>" else "array<double>"
    row = f"uid long, weight long, vector {kind}, keys array<long>"

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = lru_cache(16)(lambda size: Lattice(size, blocks, width, tables, probes, seed))
        for batch in batches:
            for at in range(0, len(batch), 2048):
                part = batch.slice(at, 2048)
                starts, flat = np.asarray(part.column(2).offsets), np.asarray(part.column(2).values)
                length = np.diff(starts)
                keys = np.empty((len(part), tables, each), np.int64)
                for size in np.unique(length).tolist():
                    of = np.flatnonzero(length == size)
                    keys[of] = lattice(size).keys(unit_vectors(flat[starts[of, None] + np.arange(size)], size))
                    keys[of] += np.int64(size * 0x9E3779B97F4A7C15 % (1 << 63))  # lengths have buckets of their own
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * tables * each), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), lists], names=["uid", "weight", "vector", "keys"])

    keyed = stage(arrow(single.select("uid", "weight", F.col("vector").cast(kind).alias("vector")), spread, row), "lattice-keys")
    # Buckets are counted and dealt by numbers alone; a vector then moves once for each place where it meets another.
    spots = keyed.select("uid", F.posexplode("keys").alias("pos", "bucket")).select("uid", F.floor(F.col("pos") / each).cast("int").alias("tab"), (F.col("pos") % each == 0).alias("own"), "bucket")
    # A bucket without a second row or without a resident makes no pair; one above the chunk is dealt into pairs of chunks.
    filled = spots.groupBy("tab", "bucket").agg(F.count("*").alias("n"), F.count(F.when(F.col("own"), 1)).alias("m")).where("n > 1 and m > 0").select(F.col("tab").alias("__tab"), F.col("bucket").alias("__bucket"), F.ceil(F.col("n") / chunk).cast("int").alias("chunks"))
    met = spots.join(filled, (F.col("tab") == F.col("__tab")) & (F.col("bucket") == F.col("__bucket")))
    chunk_of = F.pmod(F.xxhash64("uid"), F.col("chunks")).cast("int")
    dealt = met.withColumn("side", chunk_of).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = dealt.select("uid", "tab", "bucket", "side", F.xxhash64("tab", "bucket", F.least("side", "other"), F.greatest("side", "other")).alias("group"))
    dealt = dealt.join(keyed, "uid").select("group", "tab", "bucket", "side", "uid", "weight", "vector", "keys").repartition("group").sortWithinPartitions("group")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried: list[pa.RecordBatch] = []
        for table in whole_groups(batches, carried):
            group, tab, bucket, side, uid, weight = (np.asarray(table.column(k)) for k in range(6))
            lists_ = table.column(6).combine_chunks()
            at, flat = np.asarray(lists_.offsets), np.asarray(lists_.values)
            length = np.diff(at)
            keys = np.asarray(table.column(7).combine_chunks().flatten()).reshape(-1, tables, each)
            edges = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]]))
            ids, counts, roots = [], [], []
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                for t, k, size in {(int(x), int(y), int(z)) for x, y, z in zip(tab[a:b], bucket[a:b], length[a:b], strict=True)}:  # more than one only if hashes agree
                    r = np.arange(a, b)[(tab[a:b] == t) & (bucket[a:b] == k) & (length[a:b] == size)]
                    if len(r) > 1:
                        unit = unit_vectors(flat[at[r, None] + np.arange(size)], size)
                        x, n, root = compare(k, t, uid[r], weight[r], side[r], unit, keys[r], cosine)
                        use = n > 0
                        ids.append(x[use])
                        counts.append(n[use])
                        roots.append(root[use])
            join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(join(p).astype(np.int64)) for p in (ids, counts, roots)], names=["uid", "n", "root"])

    links = narrow(arrow(dealt, verify, "uid long, n long, root long"), "vector-links")
    counts = links.groupBy("uid").agg(F.sum("n").alias("n"))
    found = components(links.select(F.col("uid").alias("a"), F.col("root").alias("b")))
    named = single.select("uid", "least", "weight").join(found, F.col("uid") == F.col("id"), "left").select("uid", "least", "weight", F.coalesce("component", "uid").alias("c"))
    least = named.groupBy("c").agg(F.min("least").alias("component_id"))
    told = named.join(least, "c").join(counts, "uid", "left").select("uid", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id")
    told = single.select("uid", F.col("vector").alias("__vector")).join(told, "uid").drop("uid")
    usable = data.withColumn("__good", good)
    joined = usable.join(told, F.col("__good") & (v == F.col("__vector")), "left")
    return joined.select(*[F.col(f"`{c}`") for c in data.columns], F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", F.col(key)).alias("component_id")).withColumn("kept", F.col(key).eqNullSafe(F.col("component_id")))


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "embeddings").select("vec_id", "embedding")).select("vec_id", "n_links", "component_id", "kept")


_GOOD = "embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0"
#: Pairs by brute force; SQL is quick enough for the small tables only, and closes components by reaching.
ORACLE = {
    "op4_embedding_near_dedup": f"""
WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, embedding::DOUBLE[64] AS e FROM embeddings WHERE {_GOOD}),
p AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND array_cosine_similarity(a.e, b.e) >= {COSINE}::DOUBLE),
r AS (SELECT vec_id AS id, vec_id AS reached FROM embeddings UNION SELECT r.id, p.b FROM r JOIN p ON p.a = r.reached),
c AS (SELECT id, min(reached) AS component_id FROM r GROUP BY id),
n AS (SELECT a, count(*) AS n FROM p GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN c ON id = vec_id LEFT JOIN n ON a = vec_id
"""
}
QUERIES = {"op4_embedding_near_dedup": op4_embedding_near_dedup}
