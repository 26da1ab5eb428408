"""An aggregate kept by increments: each batch is added up by key and merged into the keys that it touches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..sources.versions import VersionedTable

#: Folders that keys are dealt to: a batch rewrites those of its keys, and no more.
BUCKETS = 64
#: How each kind of aggregate starts from rows, and how two of its values become one.
KINDS = {"count": (F.count, F.sum), "sum": (F.sum, F.sum), "min": (F.min, F.min), "max": (F.max, F.max)}


class Derived:
    """``aggregates``: name to (kind, column); kinds: count, sum, min, max. Nulls are left out as in SQL; a null key is a key.

    Batches have ascending numbers: one that is not above the last one applied is a replay and changes
    nothing, so a stream may hand a batch over twice. Versions of the table stay readable.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], aggregates: dict[str, tuple[str, str]]) -> None:
        self.spark, self.keys, self.aggregates = spark, keys, aggregates
        self.table = VersionedTable(spark, path)

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(BUCKETS)).cast("int")

    def started(self, rows: DataFrame) -> DataFrame:
        """The aggregate of rows alone: the whole table, rebuilt."""
        return rows.groupBy(*self.keys).agg(*[KINDS[k][0](F.col(c)).alias(n) for n, (k, c) in self.aggregates.items()])

    def merge(self, rows: DataFrame, batch: int) -> int:
        """Apply a batch; the table's version after it."""
        base = self.table.latest()
        m = self.table.manifest(base) if base else {"folders": [], "batch": None}
        if m["batch"] is not None and batch <= m["batch"]:
            return base
        delta = self.started(rows).withColumn("bucket", self.bucket()).persist()
        touched = {r[0] for r in delta.select("bucket").distinct().collect()}  # BUCKETS numbers at most
        of = lambda folder: int(folder.rpartition("bucket=")[2])
        old = [f for f in m["folders"] if of(f) in touched]
        parts = [delta.select(*self.keys, *self.aggregates)]
        if old:
            parts.append(self.table.read(base, old).select(*self.keys, *self.aggregates))
        both = reduce(DataFrame.unionByName, parts).groupBy(*self.keys).agg(*[KINDS[k][1](n).alias(n) for n, (k, _) in self.aggregates.items()])
        # Few files a folder, and as many tasks as shuffles have.
        spread = -(-int(self.spark.conf.get("spark.sql.shuffle.partitions")) // BUCKETS)
        merged = both.withColumn("bucket", self.bucket()).repartition(spread * BUCKETS, "bucket", F.pmod(F.xxhash64(*self.keys, F.lit(1)), F.lit(spread)))
        try:
            fresh = self.table.write_files(merged, "bucket")
        finally:
            delta.unpersist()
        return self.table.commit(base, "merge", [f for f in m["folders"] if of(f) not in touched] + fresh, merged.drop("bucket").schema, fresh, batch=batch)

    def read(self, version: int | None = None) -> DataFrame:
        return self.table.read(version).select(*self.keys, *self.aggregates)
