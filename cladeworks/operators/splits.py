"""Splits that keep a group whole, and what they leak."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .hierarchy import weak_components
from .ranges import running_before


def group_split(df: DataFrame, group: str, test: float = 0.15, validation: float = 0.15, seed: str = "20260722") -> DataFrame:
    """(group, n, split): groups, largest first and then by a seeded hash, fill test, then validation, then train.

    A group that begins below the quota goes in whole. The running sum is over groups, not rows: their
    counts are added per partition first and only partition totals meet, so no task sees all groups.
    """
    groups = df.groupBy(F.coalesce(F.col(group), F.lit("")).alias(group)).agg(F.count("*").alias("n"))
    before = running_before(groups, [-F.col("n"), F.md5(F.concat(F.lit(seed), F.col(group))), F.col(group)], "n")
    total = before.agg(F.sum("n").alias("total"))
    quota = before.crossJoin(F.broadcast(total))
    in_test = F.col("before") < F.floor(F.col("total") * test)
    tested = quota.agg(F.coalesce(F.sum(F.when(in_test, F.col("n"))), F.lit(0)).alias("tested"))
    after = F.col("before") - F.col("tested")
    split = F.when(in_test, "test").when(after < F.floor(F.col("total") * validation), "validation").otherwise("train")
    return quota.crossJoin(F.broadcast(tested)).select(group, "n", split.alias("split"))


def leakage(df: DataFrame, group: str, split: str = "split") -> DataFrame:
    """Groups that are in more than one split."""
    return df.groupBy(group).agg(F.count_distinct(split).alias("n_splits")).filter("n_splits > 1")


def clusters(items: DataFrame, links: DataFrame) -> DataFrame:
    """(id, cluster): components of items over links (a, b) of similar ones; an item without links is its own cluster. For splits that keep what is alike together."""
    near = weak_components(links.select(F.col("a").alias("parent_id"), F.col("b").alias("child_id"))).withColumnRenamed("node", "id")
    return items.select("id").join(near, "id", "left").select("id", F.coalesce("component", "id").alias("cluster"))
