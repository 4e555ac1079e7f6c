"""Exact dedup against a minimal perfect hash over historical distinct digests.

The digests of the historical documents are dealt into parts by hash. Each part
gets a minimal perfect hash (levels of bit arrays: a digest alone at its place
of a level is settled there, the others go to the next level) whose slots hold
the full digest, the locator of the winner and its count. The distinct digests
of the new documents look up their slot; a lookup counts only if all bytes of
the digest agree. Members are repeats of history; nonmembers form groups of
their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from graphloom.llm._common import bounded_batches, import_path, narrow, read, stage, text_of, without
from graphloom.llm._words import mix

#: Digests in a part of the index on average, and places for a digest in each level.
PART_DIGESTS = 50_000
ROOM = 2.0


def normal_text(text: str = "text") -> Column:
    """Each run of white space as one space. The pattern leaves single spaces alone, which are most of them."""
    return F.regexp_replace(text_of(text), r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


def _place(digests: np.ndarray, level: int, size: int) -> np.ndarray:
    """Place in a level of the digests, given as rows of four 64-bit words."""
    h = digests[:, 0] ^ mix(digests[:, 1] + np.uint64(0x9E3779B97F4A7C15 * (level + 1) % (1 << 64)))
    return (mix(h) % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """Minimal perfect hash over distinct 32-byte digests."""

    def __init__(self, levels: list[np.ndarray], digests: int):
        self.levels, self.digests = levels, digests
        counts = [int(x.sum()) for x in levels]
        self.before = np.concatenate([[0], np.cumsum(counts)])
        self.ranks = [np.cumsum(x) - x for x in levels]

    @classmethod
    def build(cls, digests: np.ndarray) -> PerfectHash:
        levels, left = [], digests
        while len(left):
            size = max(64, int(ROOM * len(left)) + 1)
            place = _place(left, len(levels), size)
            alone = np.bincount(place, minlength=size) == 1
            levels.append(alone.astype(np.int64))
            left = left[~alone[place]]
        return cls(levels, len(digests))

    def slots(self, digests: np.ndarray) -> np.ndarray:
        """Slot of each digest; of a nonmember some slot or -1."""
        out = np.full(len(digests), -1, np.int64)
        left = np.arange(len(digests))
        for k, level in enumerate(self.levels):
            place = _place(digests[left], k, len(level))
            here = level[place] == 1
            out[left[here]] = self.before[k] + self.ranks[k][place[here]]
            left = left[~here]
        return out

    def pack(self) -> tuple[list[int], bytes]:
        return [len(x) for x in self.levels], b"".join(np.packbits(x.astype(bool)).tobytes() for x in self.levels)

    @classmethod
    def unpack(cls, sizes: list[int], bits: bytes) -> PerfectHash:
        levels, at = [], 0
        for size in sizes:
            n = -(-size // 8)
            levels.append(np.unpackbits(np.frombuffer(bits, np.uint8, n, at))[:size].astype(np.int64))
            at += n
        return cls(levels, sum(int(x.sum()) for x in levels))


def _digests(column: pa.Array) -> np.ndarray:
    """A binary column of 32-byte digests as rows of four words."""
    fixed = column.cast(pa.binary(32))
    return np.frombuffer(fixed.buffers()[1], np.uint64, 4 * len(fixed), 32 * fixed.offset).reshape(-1, 4) if len(fixed) else np.zeros((0, 4), np.uint64)


def _flat(column: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def _one(values: pa.Array) -> pa.Array:
    """The values as the list of one row."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def build_index(winners: DataFrame) -> DataFrame:
    """Index of ``winners(part, digest, key, tag, n)``, distinct digests: each part is one row."""
    kind = winners.schema["key"].dataType.simpleString()

    def build(table: pa.Table) -> pa.Table:
        digests = _digests(_flat(table["digest"]))
        index = PerfectHash.build(digests)
        order = np.empty(len(digests), np.int64)
        order[index.slots(digests)] = np.arange(len(digests))
        sizes, bits = index.pack()
        held = {name: _one(_flat(table[c]).take(pa.array(order))) for name, c in (("keys", "key"), ("tags", "tag"), ("counts", "n"))}
        return pa.table({"part": _flat(table["part"]).slice(0, 1).cast(pa.int32()), "sizes": pa.array([sizes], pa.list_(pa.int32())), "bits": pa.array([bits]), "digests": pa.array([digests[order].tobytes()]), **held})

    import_path(winners.sparkSession)
    bounded_batches(winners.sparkSession)
    return winners.groupBy("part").applyInArrow(build, f"part int, sizes array<int>, bits binary, digests binary, keys array<{kind}>, tags array<long>, counts array<long>")


def look_up(batch: DataFrame, index: DataFrame) -> DataFrame:
    """One row for each digest of ``batch(part, digest, key, tag, n)`` or of the index: its winner and the count of both."""
    kind = batch.schema["key"].dataType
    held = pa.schema([("digest", pa.binary()), ("key", to_arrow_type(kind)), ("tag", pa.int64()), ("n", pa.int64())])

    def find(new: pa.Table, parts: pa.Table) -> pa.Table:
        new = new.select(held.names).cast(held)
        if not parts.num_rows:
            return new
        part = {name: _flat(parts[name]) for name in parts.column_names}
        raw = part["digests"][0].as_py()
        stored, counts = np.frombuffer(raw, np.uint64).reshape(-1, 4), np.array(part["counts"].flatten())
        if new.num_rows:
            asked = _digests(_flat(new["digest"]))
            slot = PerfectHash.unpack(part["sizes"][0].as_py(), part["bits"][0].as_py()).slots(asked)
            member = (slot >= 0) & (stored[np.maximum(slot, 0)] == asked).all(axis=1)
            np.add.at(counts, slot[member], np.asarray(new["n"])[member])
            new = new.filter(pa.array(~member))
        old = pa.FixedSizeBinaryArray.from_buffers(pa.binary(32), len(stored), [None, pa.py_buffer(raw)])
        known = pa.table([old.cast(pa.binary()), part["keys"].flatten(), part["tags"].flatten(), pa.array(counts)], names=held.names).cast(held)
        return pa.concat_tables([known, new])

    import_path(batch.sparkSession)
    bounded_batches(batch.sparkSession)
    return batch.groupBy("part").cogroup(index.groupBy("part")).applyInArrow(find, f"digest binary, key {kind.simpleString()}, tag long, n long")


def fingerprint(df: DataFrame, key: str = "doc_id", text: str = "text", carry: bool = True) -> DataFrame:
    """``df`` (or, without ``carry``, its key) with ``__digest`` of the text and ``__tag``, a number of the row, as a table in the shared folder."""
    digest = F.unhex(F.sha2(normal_text(text).cast("binary"), 256))
    columns = df.columns if carry else [key]
    return stage(df.select(*[F.col(f"`{c}`") for c in columns], digest.alias("__digest"), F.monotonically_increasing_id().alias("__tag")), "digests")


def winners(rows: DataFrame, key: str, parts: int) -> DataFrame:
    """Distinct digests with the least key (null last; ties: the first row) and the number of rows, summed before the shuffle."""
    first = F.min(F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"), F.col("__tag").alias("tag"))).alias("w")
    grouped = rows.groupBy(F.col("__digest").alias("digest")).agg(first, F.count("*").alias("n"))
    return grouped.select(F.pmod(F.xxhash64("digest"), F.lit(parts)).cast("int").alias("part"), "digest", F.col("w.key").alias("key"), F.col("w.tag").alias("tag"), "n")


def lower_half(rows: DataFrame, key: str) -> Column:
    """The default history: the lower half of the range of a whole-number key; of any other key every row."""
    if not isinstance(rows.schema[key].dataType, T.IntegralType):
        return F.lit(True)
    low, high = rows.agg(F.min(key), F.max(key)).first()
    return F.col(key) <= F.lit(None if low is None else low + (high - low) // 2)


def decide(rows: DataFrame, history: Column, key: str = "doc_id") -> DataFrame:
    """``(digest, key, tag, n)`` of the winner of each digest of :func:`fingerprint`; no other column is read.

    ``history`` tells the rows that came before; their winners must win over the
    other rows, as a smaller key does.
    """
    spark = rows.sparkSession
    parts = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // PART_DIGESTS))
    old = F.coalesce(history, F.lit(False))
    index = stage(build_index(winners(rows.where(old), key, parts)), "digest-index")
    return narrow(look_up(winners(rows.where(~old), key, parts), index), "digest-winners")


def exact_dedup(df: DataFrame, key: str = "doc_id", text: str = "text", history: Column | None = None, carry: bool = True) -> DataFrame:
    """All rows with ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``; ``carry=False`` leaves out all columns but the key.

    Texts are equal if they are the same bytes with each run of white space as
    one space; null is empty; a long text is read whole. Of equal texts the row
    with the least key stays (a null key loses to any other; of repeated rows one
    stays). ``history`` says which rows are the historical ones; by default those
    in the lower half of the range of a whole-number key. An empty table gives an
    empty one. Columns named like an added one are replaced.
    """
    data = without(df, "keep_id", "group_size", "kept", "text_sha256")
    rows = fingerprint(data, key, text, carry)
    found = decide(rows, lower_half(rows, key) if history is None else history, key)
    small = found.select(F.col("digest").alias("__found"), F.col("key").alias("keep_id"), F.col("tag").alias("__winner"), F.col("n").alias("group_size"))
    # A digest of very many rows is a skewed key here, which AQE splits; the side of the winners has one row for each digest.
    asked = rows.select(F.col("__tag").alias("__row"), "__digest") if carry else rows.withColumnRenamed("__tag", "__row")
    decided = asked.join(small.hint("merge"), F.col("__digest") == F.col("__found"))
    told = [F.col("keep_id"), F.col("group_size"), (F.col("__row") == F.col("__winner")).alias("kept"), F.lower(F.hex("__digest")).alias("text_sha256")]
    if not carry:
        return decided.select(F.col(f"`{key}`"), *told)
    # Texts move once, by the number of their row, which no two rows share.
    joined = rows.drop("__digest").join(decided.select("__row", *told), F.col("__tag") == F.col("__row"))
    return joined.select(*[F.col(f"`{c}`") for c in data.columns], "keep_id", "group_size", "kept", "text_sha256")


def distinct_texts(df: DataFrame, key: str = "doc_id", text: str = "text", history: Column | None = None) -> DataFrame:
    """The rows that :func:`exact_dedup` keeps, with their own columns only.

    Winners are joined by the number of their row alone, so texts move once.
    """
    rows = fingerprint(df, key, text)
    found = decide(rows, lower_half(rows, key) if history is None else history, key)
    stay = found.select(F.col("tag").alias("__winner"))
    return rows.join(stay, F.col("__tag") == F.col("__winner"), "left_semi").select(*[F.col(f"`{c}`") for c in df.columns])


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_dedup(docs, carry=False)


QUERIES = {"op7_exact_dedup": op7_exact_dedup}
ORACLE = {
    "op7_exact_dedup": r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
"""
}
