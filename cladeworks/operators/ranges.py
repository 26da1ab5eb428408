"""Running sums over a total order that no single task holds, and shuffles whose tasks stay small."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..storage import pinned

#: Rows of one shuffle task, about.
TASK_ROWS = 1 << 19


def enough_parts(df: DataFrame, rows: int = TASK_ROWS) -> int:
    """Partitions of which each gets about so many rows of ``df``, which is counted for that; no fewer than the session's."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // rows))


def running_before(df: DataFrame, order: list[Column], value: str, *more: str) -> DataFrame:
    """``before``: the sum of ``value`` over all rows that come earlier in ``order``, ascending and total; of each column in ``more`` the same as ``before_`` and its name."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = [f"order_{i}" for i in range(len(order))]
    keyed = df.select("*", *[o.alias(n) for o, n in zip(order, names, strict=True)])
    run = pinned(keyed.repartitionByRange(parts, *names).sortWithinPartitions(*names)).withColumn("part", F.spark_partition_id())
    wanted = {value: "before"} | {c: f"before_{c}" for c in more}
    totals = run.groupBy("part").agg(*[F.sum(c).alias(f"part_{c}") for c in wanted])
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    offsets = totals.select("part", *[F.coalesce(F.sum(f"part_{c}").over(earlier), F.lit(0)).alias(f"offset_{c}") for c in wanted])
    own = Window.partitionBy("part").orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    sums = {out: F.col(f"offset_{c}") + F.coalesce(F.sum(c).over(own), F.lit(0)) for c, out in wanted.items()}
    return run.join(F.broadcast(offsets), "part").withColumns(sums).drop("part", *[f"offset_{c}" for c in wanted], *names)
