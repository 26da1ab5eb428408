"""First-wins deduplication with a full duplicate mapping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..storage import stored


def representatives(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The earliest row of every key, by ``order``; the window's top-1 is pruned before the shuffle."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("first_rank", F.row_number().over(w)).filter("first_rank = 1").drop("first_rank")


def first_ids(df: DataFrame, key: str, id_column: str, order: list[Column]) -> DataFrame:
    """(key, representative): partial aggregation keeps a hot key to one row a task."""
    return df.groupBy(key).agg(F.min_by(id_column, F.struct(*order)).alias("representative"))


def duplicate_mapping(df: DataFrame, key: str, id_column: str, order: list[str], reason: str = "identical_key") -> DataFrame:
    """(duplicate, representative, key, reason) for every row that is not its key's first."""
    # Written first: between plain exchanges the join can split a key that very many rows have.
    first = stored(first_ids(df, key, id_column, [F.col(c) for c in order]))
    joined = df.join(first, key).filter(F.col(id_column) != F.col("representative"))
    return joined.select(F.col(id_column).alias("duplicate"), "representative", F.col(key).alias("dedup_key"), F.lit(reason).alias("reason"))


def merge_incremental(incoming: DataFrame, stored: DataFrame, key: str, id_column: str, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """New representatives, and mappings of the incoming rows whose key is known or not first."""
    known = stored.select(F.col(key), F.col(id_column).alias("known_id"))
    fresh = incoming.join(known, key, "left_anti")
    new = representatives(fresh, key, order)
    old = incoming.join(known, key).select(F.col(id_column).alias("duplicate"), F.col("known_id").alias("representative"), F.col(key).alias("dedup_key"), F.lit("known_key").alias("reason"))
    return new, old.unionByName(duplicate_mapping(fresh, key, id_column, order))


def best_row(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row a key, by an explicit total order."""
    return df.withColumn("best_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("best_rank = 1").drop("best_rank")
