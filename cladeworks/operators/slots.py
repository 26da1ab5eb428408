"""Which item may stand in which slot, as packed bitmaps beside the taxonomy.

Compatibility is no membership: it never enters is_a. Items are numbered without gaps; a (slot) or (class)
has a row of eight bytes for each 64 items of which it touches one, so that there are never more rows than
facts, and questions about two of them are bitwise joins of these rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .ranges import enough_parts, running_before

#: Items of one row of a bitmap.
WORD = 64


def numbered(items: DataFrame, item: str) -> DataFrame:
    """(item, place): distinct items, numbered from 0 in their order, by running counts over ranges."""
    one = items.select(item).dropna().distinct().withColumn("one", F.lit(1).cast("bigint"))
    return running_before(one, [F.col(item)], "one").select(item, F.col("before").alias("place"))


def bitmaps(facts: DataFrame, keys: list[str], item: str, places: DataFrame) -> DataFrame:
    """keys, strip and bits: the items of each key, 64 a strip. Repeated facts count once; items without a place are left out."""
    at = facts.select(*keys, item).distinct().join(places, item)
    bit = F.expr(f"shiftleft(1L, cast(place % {WORD} as int))")
    return at.groupBy(*keys, F.floor(F.col("place") / WORD).alias("strip")).agg(F.bit_or(bit).alias("bits"))


def sizes(maps: DataFrame, keys: list[str]) -> DataFrame:
    """keys and n: the items of each."""
    return maps.groupBy(*keys).agg(F.sum(F.bit_count("bits")).alias("n"))


def shared_bits(a: str, b: str) -> Column:
    """Bits that two rows have in common."""
    return F.bit_count(F.col(a).bitwiseAND(F.col(b)))


def overlaps(a: DataFrame, b: DataFrame) -> DataFrame:
    """Columns of both sides besides strip and bits, and n, for every pair that shares an item: each strip of one side meets those of the other."""
    left, right = a.withColumnRenamed("bits", "left_bits"), b.withColumnRenamed("bits", "right_bits")
    names = [c for c in [*a.columns, *b.columns] if c not in ("strip", "bits")]
    met = left.join(right, "strip").select(*names, shared_bits("left_bits", "right_bits").alias("shared"))
    return met.groupBy(*names).agg(F.sum("shared").alias("n")).filter("n > 0")


def slot_pairs(facts: DataFrame, reaction: str, slot: str, item: str) -> DataFrame:
    """reaction, n_first, n_second, n_both and n_pairs for reactions of two slots, 0 and 1: how many ordered pairs of different items may react.

    A reaction has few of all items, so each of its items is a row of two bits, and no bitmap is made. Tasks
    grow in number with the facts, not in size. Facts without a reaction have no item in both slots.
    """
    own = facts.filter(F.col(slot).isin(0, 1) & F.col(item).isNotNull()).select(reaction, item, (F.col(slot) + 1).cast("int").alias("in_slot"))
    items = own.repartition(enough_parts(own), reaction, item).groupBy(reaction, item).agg(F.bit_or("in_slot").alias("slots"))
    has = lambda k: F.col("slots").bitwiseAND(F.lit(k)) == k
    out = items.groupBy(reaction).agg(F.count_if(has(1)).alias("n_first"), F.count_if(has(2)).alias("n_second"), F.count_if(has(3) & F.col(reaction).isNotNull()).alias("n_both"))
    return out.withColumn("n_pairs", F.col("n_first") * F.col("n_second") - F.col("n_both"))
