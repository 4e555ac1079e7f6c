"""Mixing sources to target weights by capped water-filling, with DataFrame functions only."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.llm._common import WORD_REGEX, cut, read, text_of, without

#: Weights of the sources in their order (by code point, null last), repeating.
WEIGHTS = (5, 2, 1)
#: What the mix holds, as a share of all words, and how often a source may be repeated.
SHARE = Fraction(3, 2)
EPOCHS = 2
#: Documents that share one sampling stratum on average.
STRATUM = 64
#: Sources whose targets may be broadcast; with more the targets are joined by a shuffle.
BROADCAST_SOURCES = 50_000


def word_count(text: str | Column = "text") -> Column:
    return F.regexp_count(text_of(text), F.lit(WORD_REGEX)).cast("long")


def source_order(sources: DataFrame) -> DataFrame:
    """``sources`` with ``__pos``, its place from 0 in code-point order, null last.

    Ranks are made per range partition and shifted by the partitions before, so
    no task sees all sources.
    """
    parts = sources.select("source").repartitionByRange(F.col("source").asc_nulls_last()).sortWithinPartitions(F.col("source").asc_nulls_last())
    tagged = cut(parts.withColumn("__id", F.monotonically_increasing_id()))  # partition << 33 | place in it
    part = F.shiftrightunsigned("__id", 33)
    sizes = tagged.groupBy(part.alias("__part")).count()
    shifted = sizes.select("__part", F.coalesce(F.sum("count").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    low = F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    return tagged.join(shifted, part == F.col("__part")).select("source", (F.col("__before") + low).alias("__pos"))


def water_fill(sources: DataFrame, weights=WEIGHTS, share: Fraction = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """Targets for the table ``sources(source, source_size)``: adds ``target``.

    ``share`` of all sizes is dealt in proportion to the weights. A source whose
    part is above ``epochs`` times its size is clamped there and the excess goes
    to the others by weight, until none is above. The loop runs on the driver
    over sums only; each round clamps at least one more weight class of sources.
    If all sources are clamped the targets are their caps.
    """
    order = source_order(sources)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("__pos") % len(weights) + 1).cast("int"))
    table = cut(sources.alias("s").join(order.alias("o"), F.col("s.source").eqNullSafe(F.col("o.source"))).select("s.source", "source_size", weight.alias("__w")))
    cap = (F.col("source_size") * epochs).cast("double")
    total, free = table.agg(F.sum("source_size"), F.sum("__w")).first()
    if not free:
        return table.select("source", "source_size", cap.alias("target"))
    budget, held, n = float(share * (total or 0)), 0, 0
    while True:
        part = F.lit(budget - held) * F.col("__w") / F.lit(float(free))
        # What the others get for a weight only rises, so a source once clamped stays so.
        now, held_now, free_now = table.agg(
            F.count(F.when(part >= cap, 1)),
            F.coalesce(F.sum(F.when(part >= cap, F.col("source_size") * epochs)), F.lit(0)),
            F.coalesce(F.sum(F.when(part < cap, F.col("__w"))), F.lit(0)),
        ).first()
        if now == n or not free_now:
            return table.select("source", "source_size", F.when(part >= cap, cap).otherwise(part).alias("target"))
        n, held, free = now, held_now, free_now


def mix_sources(df: DataFrame, source: str = "source", key: str = "doc_id", text: str = "text", weights=WEIGHTS, share: Fraction = SHARE, epochs: int = EPOCHS, seed: int = 0, stratum: int = STRATUM) -> DataFrame:
    """All rows and columns of ``df`` with ``size``, ``source_size``, ``target`` and ``taken`` (words the mix takes).

    With e = target / source_size, each document of a source is taken floor(e)
    whole times. For the fraction of e, the documents of each seeded stratum of
    about ``stratum`` documents are put in seeded order and taken whole until the
    stratum's share of words is filled; the document at the edge is taken in part,
    so a source's words differ from its target by less than one for each stratum.
    ``taken`` never passes ``epochs`` times the size. The same rows give the same
    result in every run. A null text has size 0, a null source is a source of its
    own; columns of ``df`` named like an added one are replaced.
    """
    added = ("size", "source_size", "target", "taken")
    data = without(df, *added)
    sized = data.withColumn("size", word_count(text))
    sums = cut(sized.groupBy(F.col(source).alias("source")).agg(F.sum("size").alias("source_size"), F.count("*").alias("__rows")))
    targets = cut(water_fill(sums.select("source", "source_size"), weights, share, epochs).alias("t").join(sums.alias("n"), F.col("t.source").eqNullSafe(F.col("n.source"))).select("t.source", "t.source_size", "target", "__rows"))
    small = targets.select(F.col("source").alias("__source"), "source_size", "target", "__rows")
    few = targets.count() <= BROADCAST_SOURCES
    joined = sized.join(F.broadcast(small) if few else small, F.col(source).eqNullSafe(F.col("__source")))
    # By key and text, so that null or repeated keys do not share a stratum.
    mixed = F.xxhash64(F.col(key), text_of(text), F.lit(seed))
    strata = joined.withColumn("__mix", F.xxhash64(F.col(key), text_of(text), F.lit(seed + 1))).withColumn("__stratum", F.pmod(mixed, F.ceil(F.col("__rows") / stratum)))
    group = W.partitionBy("__source", "__stratum")
    running = group.orderBy("__mix", F.col(key), "size").rowsBetween(W.unboundedPreceding, W.currentRow)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(ratio)
    quota = F.round((ratio - whole) * F.sum("size").over(group)).cast("long")
    after = F.sum("size").over(running)
    part = F.least(F.col("size"), F.greatest(F.lit(0), quota - (after - F.col("size"))))
    return strata.select(
        *[F.col(f"`{c}`") for c in data.columns],
        "size",
        "source_size",
        "target",
        F.least(whole * F.col("size") + part, F.col("size") * epochs).cast("long").alias("taken"),
    )


def repeat_taken(mixed: DataFrame, text: str = "text") -> DataFrame:
    """The mix itself: each document as many times as it was taken, the last time cut to the words left over."""
    whole = F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(F.lit(0.0))
    rest = F.when(F.col("size") > 0, F.col("taken") % F.col("size")).otherwise(F.lit(0))
    copies = mixed.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.ceil(whole).cast("int")))).where(F.col("taken") > 0)
    cut_at = (F.col("__copy") > F.floor(whole)) & (rest > 0)
    head = F.regexp_extract(F.col(text), r"^\s*", 0)
    words = F.slice(F.expr(rf"regexp_extract_all(`{text}`, '[^\\x20\\x09-\\x0D]+[\\x20\\x09-\\x0D]*', 0)"), 1, rest.cast("int"))
    return copies.withColumn(text, F.when(cut_at, F.concat(head, F.array_join(words, ""))).otherwise(F.col(text))).drop("__copy")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {"op5_mixing": op5_mixing}
ORACLE: dict[str, str] = {}
