"""N-gram Jaccard join by grouped prefixes.

A document's set holds its distinct shingles, ordered by a random hash. Equal
sets become one; sets with the same size and the same prefix form a group. To
reach a Jaccard of p / q, two sets must share an element of their prefixes, the
n - ceil(p n / q) + 1 least elements of a set of n (and the smaller one an
element of its first n - ceil(2 p n / (p + q)) + 1). Groups meet in the lists of
the elements of their prefixes; group pairs are filtered by size; their members
are expanded, filtered by their bitmaps and verified on their whole sets.

A large family of near copies is not paired out. First each group is verified
against one group of the lists of its least elements, and each member against its
group; the links found give components. Then the lists of whole prefixes are
read, and only those are compared that still hold more than one component, each
distinct list once. That is done in chunks, which return rows and for each
component one link at most, never pairs. So no link between components is lost, and links inside
one, which change nothing, are not enumerated.

Nothing here errs by chance or by a limit. A bitmap holds for each of its bits the
parity of the elements that fall on it: two sets differ in at least as many
elements as their bitmaps in bits, so a pair is left out only if it can't be
similar. Candidates are found by one half of the words' hashes and verified by
the other; equal sets agree in digests of both.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm._common import arrow, bounded, bounded_groups, keyed, narrow, read, stage, text_of, whole_groups, without
from graphloom.llm._components import components
from graphloom.llm._words import Words, blocks, mix, run_hashes, sequence_hash, utf8

WORDS = 5
#: Jaccard as numerator and denominator.
SIMILARITY = (3, 4)
#: Least elements whose lists give each group one other to be verified against first.
STARS = 8
#: Rows of one list that are compared in one go; elements counted in one product.
CHUNK = 1024
COLUMNS = 4096
#: Bits of the smallest bitmap.
BITS = 128
#: Groups in the sample that tells hot elements, and how many of them make an element hot. Hot elements take another way to the same result.
SAMPLE, HOT = 5_000, 20
#: Rows of a list that one task holds; a longer one takes the way of hot elements.
LIST_ROWS = 1 << 18
#: Rows of two or three numbers that may be broadcast; with more they are joined by a shuffle.
BROADCAST_DOCS = 100_000


def shingle_runs(words: Words, hashes: np.ndarray, length: int = WORDS) -> Iterator[np.ndarray]:
    """For each text the sorted hashes of its distinct shingles, from the ``hashes`` of its words; of its whole sequence if that is shorter; none without words."""
    runs = run_hashes(hashes, length)
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if b - a >= length:
            s = np.sort(runs[a : b - length + 1])
            keep = np.empty(len(s), bool)
            keep[0] = True
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            yield s[keep]
        elif b > a:
            yield np.array([sequence_hash(hashes[a:b])], np.uint64)
        else:
            yield np.zeros(0, np.uint64)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, length: int = WORDS, lane: int = 0) -> Iterator[np.ndarray]:
    """The set of each text by one half of the words' hashes."""
    words = Words(data, offsets, True, lane)
    return shingle_runs(words, words.hashes, length)


def bitmap(elements: np.ndarray) -> bytes:
    """For each bit the parity of the elements that fall on it; about one bit for each element."""
    bits = max(BITS, 1 << (len(elements) - 1).bit_length())
    odd = np.bincount((elements & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(bool), bitorder="little").tobytes()


def bit_rows(data: np.ndarray, offsets: np.ndarray, rows: np.ndarray, size: int, to: int) -> np.ndarray:
    """Bitmaps of ``size`` bytes of some rows as 64-bit words, folded to ``to`` bytes."""
    found = data[offsets[rows][:, None] + np.arange(size)].reshape(len(rows), size // to, to)
    return np.bitwise_xor.reduce(found, axis=1).view(np.uint64)


def binaries(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a binary column without nulls."""
    offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, 4 * column.offset).astype(np.int64)
    return np.frombuffer(column.buffers()[2] or b"", np.uint8), offsets


def within(differ: np.ndarray, a: np.ndarray, b: np.ndarray, similarity: tuple[int, int]) -> np.ndarray:
    """Whether sets of sizes a and b that differ in at least so many elements may be similar."""
    p, q = similarity
    return differ * (p + q) <= (q - p) * (a + b)


def signatures(df: DataFrame, key: str, text: str, length: int = WORDS, similarity: tuple[int, int] = SIMILARITY, whole: bool = True) -> DataFrame:
    """For each row: its key, its row key (__a, __b), the size of its set, two digests of the set; with ``whole`` its prefix and bitmap."""
    docs = df.select(F.col(key).alias("id"), "__a", "__b", text)
    kind = df.schema[key].dataType.simpleString()
    names = ["id", "__a", "__b", "n", "s1", "s2"] + ["prefix", "bits"] * whole
    p, q = similarity

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = lambda s: int.from_bytes(blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)
        for batch in batches:
            data, offsets = utf8(batch.column(3))
            for i, j in blocks(offsets):
                words = Words(data, offsets[i : j + 1], True)
                n, s1, size, prefix, bits = [], [], [0], [np.zeros(0, np.int64)], []
                for s in shingle_runs(words, words.hashes, length):
                    n.append(len(s))
                    s1.append(digest(s))
                    if whole:
                        prefix.append(s[: len(s) + (-len(s) * p // q) + 1].view(np.int64))
                        size.append(size[-1] + len(prefix[-1]))
                        bits.append(bitmap(s))
                s2 = [digest(s) for s in shingle_runs(words, words.lanes[:, 1].copy(), length)]
                more = [pa.ListArray.from_arrays(pa.array(size, pa.int32()), pa.array(np.concatenate(prefix))), pa.array(bits, pa.binary())] if whole else []
                yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(i, j - i) for c in range(3)], *[pa.array(x, pa.int64()) for x in (n, s1, s2)], *more], names=names)

    return arrow(docs, sign, f"id {kind}, __a long, __b long, n long, s1 long, s2 long" + ", prefix array<long>, bits binary" * whole)


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many elements each two of the sets share.

    Elements of one set alone are left out; the others are columns of matrices of
    bounded width whose products are summed.
    """
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
    _, column, times = np.unique(values, return_inverse=True, return_counts=True)
    often = np.cumsum(times > 1) - 1
    use = times[column] > 1
    row, column, wide = row[use], often[column[use]], int((times > 1).sum())
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(sets), len(sets)), np.float32)
    for at in range(0, wide, COLUMNS):
        i, j = np.searchsorted(column, [at, at + COLUMNS])
        has = np.zeros((len(sets), min(COLUMNS, wide - at)), np.float32)
        has[row[i:j], column[i:j] - at] = 1
        out += has @ has.T
    return np.rint(out).astype(np.int32)


def partners(size: np.ndarray, part: np.ndarray, data: np.ndarray, offsets: np.ndarray, similarity: tuple[int, int], earlier: list[np.ndarray] | None = None) -> np.ndarray:
    """Which rows may be similar to a row of another part, by sizes and bitmaps; exact for all that it leaves out.

    ``earlier``: for each row the lists that come before this one. A pair that shares one of them met there.
    """
    p, q = similarity
    out, met = np.zeros(len(size), bool), None
    wide, widest = np.diff(offsets), 1 << (-(-q // p) - 1).bit_length()
    for width in np.unique(wide).tolist():
        # a partner that is larger has a bitmap of this width or of the next (or more, for a lower similarity)
        rows = np.flatnonzero((wide >= width) & (wide <= widest * width))
        rows = rows[np.argsort(size[rows], kind="stable")]
        bits = np.empty((len(rows), width // 8), np.uint64)
        for w in np.unique(wide[rows]).tolist():
            bits[wide[rows] == w] = bit_rows(data, offsets, rows[wide[rows] == w], w, width)
        n, own = size[rows], part[rows]
        ends = np.searchsorted(n, n * q // p, "right")
        for i in np.flatnonzero(wide[rows] == width).tolist():
            j = slice(i + 1, int(ends[i]))
            if j.stop > j.start:
                may = (own[j] != own[i]) & within(np.bitwise_count(bits[j] ^ bits[i]).sum(1, dtype=np.int64), n[i], n[j], similarity)
                if may.any() and earlier is not None:
                    met = shared_counts(earlier) > 0 if met is None else met
                    may &= ~met[rows[i], rows[j]]
                if may.any():
                    out[rows[i]] = True
                    out[rows[j][may]] = True
    return out


def dealt_lists(rows: DataFrame, by: str, chunk: int) -> DataFrame:
    """Rows of lists ``h`` with ``group``: a list, or of a list above ``chunk`` a pair of its chunks. No task then holds more than two chunks of a list at a time."""
    sizes = rows.groupBy("h").agg(F.count("*").alias("c")).where("c > 1").select(F.col("h").alias("__h"), F.ceil(F.col("c") / chunk).cast("int").alias("chunks"))
    dealt = rows.join(sizes, F.col("h") == F.col("__h")).withColumn("side", F.pmod(F.xxhash64(by), F.col("chunks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = dealt.withColumn("group", F.xxhash64("h", F.least("side", "other"), F.greatest("side", "other")))
    return dealt.select("group", *rows.columns)


def gathered(dealt: DataFrame, columns: list[str]) -> DataFrame:
    return dealt.select("group", "h", *columns).repartition("group").sortWithinPartitions("group")


def banded(rows: DataFrame, chunk: int, similarity: tuple[int, int]) -> DataFrame:
    """``rows(h, ..., n, ...)`` where each list above ``chunk`` is cut into lists of two neighbouring bands of sizes: similar sets lie in one band or in two that touch."""
    p, q = similarity
    if p == q:
        return rows
    long_ = rows.groupBy("h").agg(F.count("*").alias("c")).where(F.col("c") > chunk).select(F.col("h").alias("__h"))
    band = F.floor(F.log(F.col("n")) / F.log(F.lit(q / p)) + F.lit(1e-9)).cast("int")
    cut = rows.join(long_, F.col("h") == F.col("__h"), "left").withColumn("__band", F.explode(F.when(F.col("__h").isNull(), F.array(F.lit(-2))).otherwise(F.array(band, band - 1))))
    return cut.withColumn("h", F.when(F.col("__h").isNull(), F.col("h")).otherwise(F.xxhash64("h", "__band"))).drop("__h", "__band")


def meet(lists: DataFrame, sets: DataFrame, similarity: tuple[int, int], chunk: int = CHUNK) -> DataFrame:
    """Rows ``(h, uid, c)`` of ``lists(h, uid, n)`` that may link to a set of another component in their list.

    ``sets(uid, c, n, bits, all)``: the component, size, bitmap and all lists of a
    set. A pair counts in the first list that it shares. Lists are dealt before
    their rows get bitmaps, which then move once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, []):
            group, h, uid, c, n, own = (np.asarray(table.column(k)) for k in (0, 1, 2, 3, 4, 6))
            data, offsets = binaries(table.column(5).combine_chunks())
            lists_ = table.column(7).combine_chunks()
            at, flat = np.asarray(lists_.offsets), np.asarray(lists_.values)
            edges = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]]))
            stays = [np.zeros(0, np.int64)]
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if b - a > 1 and (c[a:b] != c[a]).any():
                    earlier = [x[x < own[a]] for x in (flat[at[k] : at[k + 1]] for k in range(a, b))]
                    stays.append(a + np.flatnonzero(partners(n[a:b], c[a:b], data, offsets[a : b + 1], similarity, earlier)))
            rows = np.concatenate(stays)
            yield pa.RecordBatch.from_arrays([pa.array(x[rows]) for x in (h, uid, c)], names=["h", "uid", "c"])

    dealt = dealt_lists(banded(lists.withColumn("list", F.col("h")), chunk, similarity), "uid", chunk).drop("n")
    return arrow(gathered(dealt.join(sets, "uid"), ["uid", "c", "n", "bits", "list", "all"]), run, "h long, uid long, c long").distinct()


def open_lists(posts: DataFrame, hot: DataFrame, held: int = LIST_ROWS) -> DataFrame:
    """``(h, gid)`` of ``posts(h, gid, low, high, first)`` in lists that hold more than one component and a row that comes ``first``; of lists that hold the same groups one.

    Posts move once, to the task of their list. Hot elements, told by a sample,
    and lists too long to be held, are summed first and joined to their sums:
    joins split a hot key.
    """
    names = ["h", "gid", "low", "high", "first", "c", "f1", "f2"]
    open_ = (F.col("__low") != F.col("__high")) & F.col("__first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, whole in bounded_groups(batches, held):
            h, gid, low, high, first = (table.column(k).to_numpy() for k in range(5))
            c, f1, f2 = np.full(len(h), -1, np.int64), np.zeros(len(h), np.int64), np.zeros(len(h), np.int64)
            keep = np.ones(len(h), bool)
            if whole:
                edge = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
                size = np.diff(np.append(edge, len(h)))
                stays = (np.minimum.reduceat(low, edge) != np.maximum.reduceat(high, edge)) & np.logical_or.reduceat(first, edge)
                keep, c = np.repeat(stays, size), np.repeat(size, size)
                for f, seed in ((f1, 0x51), (f2, 0x9E3779B97F4A7C15)):
                    mixed = mix(gid.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(seed))
                    f[:] = np.repeat(np.bitwise_xor.reduceat(mixed, edge).view(np.int64), size)
            yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (h, gid, low, high, first, c, f1, f2)], names=names)

    small = F.broadcast(hot.select(F.col("h").alias("__h")))
    most = posts.join(small, F.col("h") == F.col("__h"), "left_anti").repartition("h").sortWithinPartitions("h")
    rest = posts.join(small, F.col("h") == F.col("__h"), "left_semi").select("*", *[F.lit(v).cast("long").alias(k) for k, v in zip(names[5:], (-1, 0, 0), strict=True)])
    found = stage(arrow(most, run, "h long, gid long, low long, high long, first boolean, c long, f1 long, f2 long").unionByName(rest), "lists")
    long_ = found.where("c < 0")
    sums = long_.groupBy(F.col("h").alias("__h")).agg(F.min("low").alias("__low"), F.max("high").alias("__high"), F.max("first").alias("__first"), F.count("*").alias("c"), F.bit_xor(F.xxhash64("gid", F.lit(1))).alias("f1"), F.bit_xor(F.xxhash64("gid", F.lit(2))).alias("f2"))
    sums = sums.where(open_)
    kept = found.where("c >= 0").select("h", "c", "f1", "f2").distinct().unionByName(sums.select(F.col("__h").alias("h"), "c", "f1", "f2"))
    one = narrow(kept.groupBy("c", "f1", "f2").agg(F.min("h").alias("__h")).select("__h"), "lists-once")
    return found.join(one, F.col("h") == F.col("__h"), "left_semi").select("h", "gid")


def texts_of(wanted: DataFrame, sets: DataFrame, docs: DataFrame) -> tuple[DataFrame, bool]:
    """``(uid, text)`` of the set numbers ``wanted(u)``, and whether it takes no shuffle of the texts. A repeated row comes more than once."""
    found = narrow(sets.select("uid", F.col("a").alias("__x"), F.col("b").alias("__y")).join(wanted, F.col("uid") == F.col("u")).select("uid", "__x", "__y"), "pair-documents")
    few = found.count() <= BROADCAST_DOCS
    side = F.broadcast(found) if few else found
    return docs.join(side, (F.col("__a") == F.col("__x")) & (F.col("__b") == F.col("__y"))).select("uid", "text"), few


def joined(c: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each of the components ``c`` that the pairs of rows ``(i, j)`` connect to a lesser one, and the least that they connect it to."""
    names, at = np.unique(c, return_inverse=True)
    met = np.zeros((len(names), len(names)), bool)
    met[at[i], at[j]] = met[at[j], at[i]] = True
    new, least = np.ones(len(names), bool), np.arange(len(names))
    for start in range(len(names)):
        ahead = [start] if new[start] else []
        new[start] = False
        while ahead:
            found = np.flatnonzero(met[ahead.pop()] & new)
            new[found], least[found] = False, start
            ahead += found.tolist()
    use = least != np.arange(len(names))
    return names[use], names[least[use]]


def link_lists(rows: DataFrame, sets: DataFrame, docs: DataFrame, length: int, similarity: tuple[int, int], chunk: int = CHUNK) -> DataFrame:
    """Links ``(a, b)`` between the components ``c`` that are similar in each list of ``rows(h, uid, c)``: whole sets, one link for each component and chunk at most."""
    p, q = similarity

    def whole_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for i, j in blocks(offsets):
                found = list(shingle_sets(data, offsets[i : j + 1], length, 1))
                ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found).view(np.int64)))], names=["k", "els"])

    wanted = rows.select(F.col("uid").alias("u")).distinct()
    texts, _ = texts_of(wanted, sets, docs)
    whole = stage(arrow(texts, whole_sets, "k long, els array<long>").dropDuplicates(["k"]), "whole-sets")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, []):
            group, _, uid, c = (np.asarray(table.column(k)) for k in range(4))
            lists_ = table.column(4).combine_chunks()
            at, flat = np.asarray(lists_.offsets), np.asarray(lists_.values).view(np.uint64)
            edges = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]]))
            left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if b - a < 2 or (c[a:b] == c[a]).all():
                    continue
                size = at[a + 1 : b + 1] - at[a:b]
                shared = shared_counts([flat[at[k] : at[k + 1]] for k in range(a, b)])
                i, j = np.nonzero((shared * q >= (size[:, None] + size - shared) * p) & (shared > 0) & (c[a:b, None] < c[a:b]))
                for out, found in zip((left, right), joined(c[a:b], i, j), strict=True):
                    out.append(found)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], names=["a", "b"])

    return narrow(arrow(gathered(dealt_lists(rows, "uid", chunk).join(whole, F.col("uid") == F.col("k")), ["uid", "c", "els"]), compare, "a long, b long"), "late-links")


def likely(pairs: DataFrame, sets: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """The ``pairs(x, y)`` of set numbers that sizes and bitmaps leave possible."""
    p, q = similarity
    a, b = (sets.select(*[F.col(c).alias(f"{c}_{s}") for c in ("uid", "n", "bits")]) for s in "xy")
    sizes = F.least("n_x", "n_y") * q >= F.greatest("n_x", "n_y") * p
    joined = pairs.join(a, F.col("x") == F.col("uid_x")).join(b, F.col("y") == F.col("uid_y")).where(sizes).select("x", "y", "n_x", "n_y", "bits_x", "bits_y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            nx, ny = np.asarray(batch.column(2)), np.asarray(batch.column(3))
            (dx, ox), (dy, oy) = binaries(batch.column(4)), binaries(batch.column(5))
            wx, wy = np.diff(ox), np.diff(oy)
            differ = np.zeros(len(batch), np.int64)
            for a, b in {*zip(wx.tolist(), wy.tolist(), strict=True)}:
                rows = np.flatnonzero((wx == a) & (wy == b))
                differ[rows] = np.bitwise_count(bit_rows(dx, ox, rows, a, min(a, b)) ^ bit_rows(dy, oy, rows, b, min(a, b))).sum(1)
            keep = pa.array(within(differ, nx, ny, similarity))
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(keep) for k in (0, 1)], names=["x", "y"])

    return arrow(joined, run, "x long, y long")


def verify(pairs: DataFrame, sets: DataFrame, docs: DataFrame, length: int, similarity: tuple[int, int]) -> DataFrame:
    """The ``pairs(x, y)`` of set numbers whose whole sets are similar."""
    p, q = similarity
    ends = pairs.select(F.col("x").alias("u")).unionByName(pairs.select(F.col("y").alias("u"))).distinct()
    texts, cheap = texts_of(ends, sets, docs)
    texts = texts if cheap else stage(texts, "pair-texts")  # a repeated row: the pair is judged more than once, alike
    left, right = (texts.select(F.col("uid").alias(f"{c}_"), F.col("text").alias(f"text_{c}")) for c in "xy")
    joined = pairs.join(right, F.col("y") == F.col("y_")).join(left, F.col("x") == F.col("x_")).select("x", "y", "text_x", "text_y")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [utf8(batch.column(c)) for c in (2, 3)]
            linked = []
            for i, j in blocks(both[0][1] + both[1][1]):
                for a, b in zip(*[shingle_sets(data, offsets[i : j + 1], length, 1) for data, offsets in both], strict=True):
                    shared = len(np.intersect1d(a, b, assume_unique=True))
                    linked.append(shared * q >= (len(a) + len(b) - shared) * p and shared > 0)
            keep = pa.array(linked, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(keep) for k in (0, 1)], names=["x", "y"])

    return narrow(arrow(joined, compare, "x long, y long").distinct(), "pairs-verified")


def classes(base: DataFrame, key: str, text: str, length: int = WORDS, similarity: tuple[int, int] = SIMILARITY, chunk: int = CHUNK, stars: int = STARS, sample: int = SAMPLE, hot: int = HOT, held: int = LIST_ROWS) -> DataFrame:
    """Each distinct set ``(s1, s2, n)`` of ``base`` (with row keys ``__a``, ``__b``): ``c``, its component, ``component_id``, the least key in it, ``head``, whether it holds that key, and ``none, least``, its own least key."""
    p, q = similarity
    docs = base.select("__a", "__b", text_of(text).alias("text"))
    # Equal sets become one.
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", F.col("__a").alias("a"), F.col("__b").alias("b"))).alias("w")
    sets = signatures(base, key, text, length, similarity).where("n > 0").groupBy("s1", "s2", "n").agg(first, F.first("prefix").alias("prefix"), F.first("bits").alias("bits"))
    sets = stage(sets.select("s1", "s2", "n", F.col("w.none").alias("none"), F.col("w.id").alias("least"), F.col("w.a").alias("a"), F.col("w.b").alias("b"), "prefix", "bits", F.xxhash64("n", "prefix").alias("g"), F.monotonically_increasing_id().alias("uid")), "sets")
    # Equal prefixes and sizes become one group, named by one of its sets.
    several = sets.groupBy("g", "n").agg(F.count("*").alias("c"), F.min("uid").alias("gid")).where("c > 1").select(F.col("g").alias("__g"), F.col("n").alias("__n"), "gid")
    inside = narrow(sets.select("uid", "g", "n").join(several, (F.col("g") == F.col("__g")) & (F.col("n") == F.col("__n"))).select("uid", "gid"), "members")
    others = inside.where("uid <> gid").select(F.col("uid").alias("__u"))
    groups = sets.join(others, F.col("uid") == F.col("__u"), "left_anti").select(F.col("uid").alias("gid"), "n", "prefix")
    # One pair for each group and list of its least elements.
    near = groups.select("gid", F.explode(F.slice("prefix", 1, stars)).alias("h"))
    star = near.groupBy("h").agg(F.count("*").alias("c"), F.min("gid").alias("star")).where("c > 1").select(F.col("h").alias("__h"), "star")
    pairs = near.join(star, F.col("h") == F.col("__h")).where("gid <> star").select(F.col("star").alias("x"), F.col("gid").alias("y"))
    pairs = pairs.unionByName(inside.where("uid <> gid").select(F.col("gid").alias("x"), F.col("uid").alias("y"))).distinct()
    links = verify(narrow(likely(pairs, sets, similarity), "pairs"), sets, docs, length, similarity).select(F.col("x").alias("a"), F.col("y").alias("b"))
    found = components(links)
    placed = sets.select("uid", "n", "bits").join(inside.select(F.col("uid").alias("__u"), F.col("gid").alias("of")), F.col("uid") == F.col("__u"), "left").join(found, F.col("uid") == F.col("id"), "left")
    placed = stage(placed.select("uid", F.coalesce("of", "uid").alias("gid"), F.coalesce("component", "uid").alias("c"), "n", "bits"), "placed")
    # Whole prefixes: the lists that still hold more than one component.
    spread = placed.groupBy("gid").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low <> gid or high <> gid").withColumnRenamed("gid", "__gid")
    index = F.col("n") - F.ceil(F.col("n") * (2 * p) / (p + q)) + 1
    posts = groups.join(bounded(narrow(spread, "linked-groups"), BROADCAST_DOCS), F.col("gid") == F.col("__gid"), "left")
    posts = posts.select("gid", F.coalesce("low", "gid").alias("low"), F.coalesce("high", "gid").alias("high"), index.alias("index"), F.posexplode("prefix").alias("pos", "h"))
    posts = posts.select("h", "gid", "low", "high", (F.col("pos") < F.col("index")).alias("first"))
    each = max(1, placed.count() // sample)
    seen = groups.where(F.pmod(F.xxhash64("gid"), F.lit(each)) == 0).select(F.explode("prefix").alias("h")).groupBy("h").count()
    common = narrow(seen.where(F.col("count") >= hot).orderBy(F.desc("count"), "h").limit(sample).select("h"), "hot-elements")
    lists = narrow(open_lists(posts, common, held), "open-lists")
    every = lists.groupBy(F.col("gid").alias("__gid")).agg(F.collect_list("h").alias("all"))
    payload = placed.join(every, F.col("gid") == F.col("__gid")).select("uid", "c", "n", "bits", "all")
    left = narrow(meet(lists.join(placed.select("uid", "gid", "n"), "gid").select("h", "uid", "n"), payload, similarity, chunk), "lists-left")
    if left.limit(1).count():
        found = components(links.unionByName(link_lists(left, sets, docs, length, similarity, chunk)))
    named = sets.select("uid", "s1", "s2", "n", "none", "least").join(found, F.col("uid") == F.col("id"), "left").withColumn("c", F.coalesce("component", "uid")).drop("id", "component")
    heads = named.groupBy("c").agg(F.min(F.struct("none", "least", "uid")).alias("head")).withColumnRenamed("c", "__c")
    told = named.join(heads, F.col("c") == F.col("__c"))
    return narrow(told.select("c", "s1", "s2", "n", F.col("head.least").alias("component_id"), (F.col("head.uid") == F.col("uid")).alias("head"), "none", "least", "uid"), "classes")


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", length: int = WORDS, similarity: tuple[int, int] = SIMILARITY, carry: bool = True, **more) -> DataFrame:
    """All rows with ``n_shingles``, ``component_id`` and ``kept``; ``carry=False`` leaves only the key.

    Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z. Documents link when
    the Jaccard similarity of their sets is at least ``similarity``;
    ``component_id`` is the least key that links reach, the row's own included,
    and ``kept`` marks one row for each component (with ``carry=False`` all of the
    repeated rows that tie for it). A row without words, its text null or empty,
    links with nothing and is kept. A null key takes the component of what it
    reaches, and stays only if no row there has a key. A long text is read whole.
    An empty table gives an empty one. Columns named like an added one are replaced.
    """
    data = without(df, "n_shingles", "component_id", "kept")
    if carry:
        base = stage(data.withColumn("__a", F.monotonically_increasing_id()).withColumn("__b", F.lit(0).cast("long")), "documents")
    else:
        base = keyed(data.select(key, text), key, text)
    told = classes(base, key, text, length, similarity, **more).select(*[F.col(c).alias(f"__{c}") for c in ("c", "s1", "s2", "n", "head", "least")], "component_id")
    alike = (F.col("s1") == F.col("__s1")) & (F.col("s2") == F.col("__s2")) & (F.col("n") == F.col("__n"))
    judged = signatures(base, key, text, length, similarity, False).join(told.hint("merge"), alike, "left")
    best = (F.col("n") == 0) | (F.col("__head") & F.col("id").eqNullSafe(F.col("__least")))
    judged = judged.select("id", "__a", "__b", "__c", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"), best.alias("kept"))
    if not carry:
        return judged.select(F.col("id").alias(key), "n_shingles", "component_id", "kept")
    judged = stage(judged.select(F.col("__a").alias("__row"), "__c", "n_shingles", "component_id", "kept"), "judged")
    stay = judged.where("kept and n_shingles > 0").groupBy("__c").agg(F.min("__row").alias("__stay")).select("__stay")
    kept = judged.join(stay, F.col("__row") == F.col("__stay"), "left").select("__row", "n_shingles", "component_id", ((F.col("n_shingles") == 0) | F.col("__stay").isNotNull()).alias("kept"))
    out = base.join(kept, F.col("__a") == F.col("__row"))
    return out.select(*[F.col(f"`{c}`") for c in data.columns], "n_shingles", "component_id", "kept")


def representatives(df: DataFrame, key: str = "doc_id", text: str = "text", length: int = WORDS, similarity: tuple[int, int] = SIMILARITY, **more) -> DataFrame:
    """The rows that :func:`near_duplicates` keeps, with their own columns only: one of each component, and each row without words.

    Rows are joined to the heads of components by hashes of key and text, so
    texts move once; of rows with equal keys and texts one stays.
    """
    base = keyed(df, key, text)
    told = classes(base, key, text, length, similarity, **more).where("head")
    # The set of a head may have several rows; those with its least key stay.
    heads = told.select(*[F.col(c).alias(f"__{c}") for c in ("s1", "s2", "n", "uid")], F.coalesce(F.xxhash64("least"), F.lit(0)).alias("__k"))
    narrow_ = signatures(base, key, text, length, similarity, False).where("n > 0").select("s1", "s2", "n", "__a", "__b")
    same = (F.col("s1") == F.col("__s1")) & (F.col("s2") == F.col("__s2")) & (F.col("n") == F.col("__n")) & (F.col("__a") == F.col("__k"))
    rows = narrow_.join(heads, same).groupBy("__uid").agg(F.count("*").alias("times"), F.min(F.struct("__a", "__b")).alias("w"))
    rows = narrow(rows.select(F.col("w.__a").alias("__x"), F.col("w.__b").alias("__y"), "times"), "heads")
    stay = base.join(rows, (F.col("__a") == F.col("__x")) & (F.col("__b") == F.col("__y")), "left_semi")
    if rows.where("times > 1").limit(1).count():
        stay = stay.dropDuplicates(["__a", "__b"])
    columns = [F.col(f"`{c}`") for c in df.columns]
    empty = df.where(~text_of(text).rlike(r"[^\x20\x09-\x0D]"))
    return stay.where(text_of(text).rlike(r"[^\x20\x09-\x0D]")).select(*columns).unionByName(empty.select(*columns))


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs, carry=False).select("doc_id", "n_shingles", "component_id")


QUERIES = {"op8_ngram_jaccard_join": op8_ngram_jaccard_join}
ORACLE = {
    "op8_ngram_jaccard_join": r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 75 * (x.n + y.n - i)),
r AS (SELECT doc_id AS id, doc_id AS reached FROM documents UNION SELECT r.id, l.b FROM r JOIN l ON l.a = r.reached),
c AS (SELECT id, min(reached) AS component_id FROM r GROUP BY id)
SELECT c.id AS doc_id, coalesce(n, 0) AS n_shingles, component_id FROM c LEFT JOIN n ON n.doc_id = c.id
"""
}
