"""Joins that add attributes without guessing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..storage import stored


def unambiguous(mapping: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, value) where the keys have exactly one distinct value; null values do not count."""
    return mapping.groupBy(*keys).agg(F.min(value).alias(value), F.max(value).alias("most")).filter(F.col(value).isNotNull() & (F.col(value) == F.col("most"))).drop("most")


def resolve(facts: DataFrame, mapping: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Facts with the mapping's value where it is unambiguous, else null; rows with null keys stay."""
    # Written first, as below: between plain exchanges a join can split a key that very many rows have.
    return facts.join(stored(unambiguous(mapping, keys, value)), keys, "left")


def prefer(left: DataFrame, right: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Left join; each named column is the right side's where it has one, else the left's."""
    other = right.select(*keys, *[F.col(c).alias(f"other_{c}") for c in columns])
    return left.join(other, keys, "left").withColumns({c: F.coalesce(f"other_{c}", c) for c in columns}).drop(*[f"other_{c}" for c in columns])


def one_structure(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row a key, that of the least ``order``."""
    rest = [c for c in rows.columns if c != key]
    picked = rows.groupBy(key).agg(F.min(F.struct(order, *[c for c in rest if c != order])).alias("r"))
    return picked.select(key, *[F.col(f"r.{c}").alias(c) for c in rest])


def without(facts: DataFrame, column: str, excluded: list[str] | DataFrame) -> DataFrame:
    """Facts whose class is not one of the excluded, bookkeeping ones (a list, or a table with that column); null classes stay."""
    if isinstance(excluded, DataFrame):
        return facts.join(excluded.select(column).distinct(), column, "left_anti")
    return facts.filter(F.col(column).isNull() | ~F.col(column).isin(*excluded))


def flag_unknown(rows: DataFrame, key: str, ids: str, known: DataFrame, known_id: str) -> DataFrame:
    """Adds unknown_ids (sorted): ids of the array column that ``known`` lacks. The ids themselves are never rewritten."""
    listed = rows.select(key, F.explode(F.array_distinct(ids)).alias(known_id)).filter(F.col(known_id).isNotNull())
    missing = listed.join(known.select(known_id).distinct(), known_id, "left_anti").groupBy(key).agg(F.array_sort(F.collect_set(known_id)).alias("unknown_ids"))
    empty = F.expr(f"cast(array() as {dict(rows.dtypes)[ids]})")
    return rows.join(missing, key, "left").withColumn("unknown_ids", F.coalesce("unknown_ids", empty))


def back_propagate(records: DataFrame, representatives: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Source records with the named columns of their representative; a record without one keeps nulls there. Of a representative's several rows the greatest counts, by the columns in order."""
    one = stored(representatives.groupBy(key).agg(F.max(F.struct(*columns)).alias("r")).select(key, "r.*"))
    return records.drop(*columns).join(one, key, "left")


#: Rows of each side, about, that a block of a key's matches joins with each other.
BLOCK_ROWS = 2048
#: Tasks at most that these blocks are dealt to.
MOST_TASKS = 1 << 16


def all_matches(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join that keeps every match: one structure may be several entities.

    Matches of a key may be as many as its rows of both sides multiplied. Where they are more than a block
    holds, both sides of the key are dealt to a grid of blocks, so that tasks grow in number with the matches,
    not in size.
    """
    left, right = stored(left), stored(right)  # counted and joined; dealt the same way if a task runs again
    count = lambda df, name: df.groupBy(*keys).agg(F.count("*").alias(name))
    matches = F.col("match_left").cast("double") * F.col("match_right")
    both = stored(count(left, "match_left").join(count(right, "match_right"), keys))
    n_blocks = int((both.agg(F.sum(matches)).first()[0] or 0) / BLOCK_ROWS**2)
    if not n_blocks:
        return left.join(right, keys, "left")
    grid = both.filter(matches > BLOCK_ROWS**2).select(*keys, *[F.ceil(F.col(c) / BLOCK_ROWS).alias(f"{c}_blocks") for c in ("match_left", "match_right")])

    def dealt(df: DataFrame, own: str, other: str) -> DataFrame:
        """Each row in one strip of blocks: its own place is by its number, and it meets all places of the other side."""
        found = df.withColumn(own, F.xxhash64(F.monotonically_increasing_id())).join(F.broadcast(grid), keys, "left")  # a row for 2,048 rows at most
        blocks = lambda c: F.coalesce(f"{c}_blocks", F.lit(1))
        placed = found.withColumn(own, F.pmod(own, blocks(own))).withColumn(other, F.explode(F.sequence(F.lit(0).cast("bigint"), blocks(other) - 1)))
        return placed.withColumn("match_many", F.col(f"{own}_blocks").isNotNull()).drop(f"{own}_blocks", f"{other}_blocks")

    on = [*keys, "match_left", "match_right"]
    tasks = max(min(n_blocks, MOST_TASKS), int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    other = dealt(right, "match_right", "match_left").drop("match_many").withColumn("match_met", F.lit(True)).repartition(tasks, *on)
    met = dealt(left, "match_left", "match_right").repartition(tasks, *on).join(other.hint("merge"), on, "left")
    # A key in the grid has matches; a block of it may have none.
    return met.filter("match_met or not match_many").drop("match_left", "match_right", "match_many", "match_met")


def first_tier(tiers: dict[str, Column]) -> tuple[Column, Column]:
    """(value, tier): the first tier, in the order given, that has a value, and its name; 'none' without one."""
    value, name = F.coalesce(*tiers.values()), F.lit("none")
    for label, column in reversed(tiers.items()):
        name = F.when(column.isNotNull(), F.lit(label)).otherwise(name)
    return value, name
