"""Hilbert-curve sharding: order rows along a space-filling curve over several metadata columns."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .runtime import pinned

#: Cells along each dimension are 2**BITS.
BITS = 8
SHARDS = 8


def hilbert_index(coordinates: list[np.ndarray], bits: int) -> np.ndarray:
    """Distance along the d-dimensional Hilbert curve (Skilling's transpose form), for whole arrays."""
    x = [np.asarray(c, np.uint64).copy() for c in coordinates]
    one, d = np.uint64(1), len(x)
    for b in range(bits - 1, 0, -1):
        q = np.uint64(1 << b)
        low = q - one
        for i in range(d):
            on = (x[i] & q) != 0
            swap = np.where(on, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] ^= np.where(on, low, swap)
            x[i] ^= swap
    for i in range(1, d):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        t ^= np.where((x[d - 1] & np.uint64(1 << b)) != 0, np.uint64((1 << b) - 1), np.uint64(0))
    x = [c ^ t for c in x]
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for c in x:
            out = (out << one) | ((c >> np.uint64(b)) & one)
    return out.astype(np.int64)


@dataclass
class Cells:
    """A dimension's cells: the least value of each cell that has any, and that cell's number."""

    least: np.ndarray
    number: np.ndarray

    def of(self, values: pd.Series) -> np.ndarray:
        """Cells of values; a null is in cell 0."""
        code, kinds = pd.factorize(values)
        at = np.searchsorted(self.least, np.asarray(kinds, self.least.dtype), "right") - 1
        cell = np.where(at < 0, 0, self.number[np.maximum(at, 0)]) if len(self.least) else np.zeros(len(kinds), np.int64)
        return np.append(cell, 0)[code]  # a null's code is -1


def number_cells(df: DataFrame, columns: list[str], bits: int) -> list[Cells]:
    """Cells of numeric columns by equal-depth cuts from a mergeable summary.

    A value's cell counts the cuts up to it, so a value that many rows have takes as many cells as it
    has rows for, and few distinct values spread over the whole curve.
    """
    if not columns:
        return []
    cuts = [i / (1 << bits) for i in range(1, 1 << bits)]
    found = df.agg(*[F.percentile_approx(F.col(c).cast("double"), cuts, 10_000).alias(c) for c in columns]).first()
    out = []
    for c in columns:
        least, first, n = np.unique(np.asarray(found[c] or [], float), return_index=True, return_counts=True)
        out.append(Cells(least, first + n))
    return out


def string_cells(df: DataFrame, column: str, bits: int) -> Cells:
    """Cells of a string column by whole values: a value's cell is the share of rows below it.

    Values are counted, ordered by range and summed partition by partition; the least value of each
    cell (2**bits at most) reaches the driver. A value that many rows have takes as many cells.
    """
    spark = df.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    counted = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).filter("value is not null")
    run = pinned(counted.repartitionByRange(parts, "value").sortWithinPartitions("value").withColumn("part", F.spark_partition_id()))
    sums = dict(sorted((r[0], r[1]) for r in run.groupBy("part").agg(F.sum("n")).collect()))
    nulls = df.filter(F.col(column).isNull()).count()
    before = dict(zip(sums, nulls + np.cumsum([0, *sums.values()])[:-1], strict=True))
    total = nulls + sum(sums.values())

    def firsts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        done, held = 0, -1
        for frame in frames:
            below = before[int(frame["part"].iat[0])] + done + np.cumsum(frame["n"].to_numpy()) - frame["n"].to_numpy()
            cell = below * (1 << bits) // total
            new = np.diff(cell, prepend=held) > 0
            done, held = done + int(frame["n"].sum()), int(cell[-1])
            yield pd.DataFrame({"cell": cell[new], "value": frame["value"].to_numpy()[new]})

    rows = sorted((r[0], r[1]) for r in run.mapInPandas(firsts, "cell bigint, value string").groupBy("cell").agg(F.min("value")).collect())
    return Cells(np.array([v for _, v in rows], object), np.array([c for c, _ in rows], np.int64))


def with_curve(df: DataFrame, dimensions: list[str], bits: int = BITS) -> DataFrame:
    """Add ``hilbert``, the curve index of the columns' cells. Nulls count as below all values."""
    kinds = dict(df.dtypes)
    numbers = [c for c in dimensions if kinds[c] != "string"]
    cells = dict(zip(numbers, number_cells(df, numbers, bits), strict=True)) | {c: string_cells(df, c, bits) for c in dimensions if kinds[c] == "string"}

    @F.pandas_udf("bigint")
    def curve(frame: pd.DataFrame) -> pd.Series:
        return pd.Series(hilbert_index([cells[c].of(frame[c]) for c in frame.columns], bits))

    return df.withColumn("hilbert", curve(F.struct(*[F.col(c) if kinds[c] == "string" else F.col(c).cast("double").alias(c) for c in dimensions])))


def cut_runs(df: DataFrame, order: list[str], shards: int = SHARDS) -> DataFrame:
    """Cut the total order of ``order`` into ``shards`` runs whose counts differ by one at most.

    Adds shard and slot (gapless from 0). The order comes from a range partitioning; each partition's
    count, not its rows, reaches the driver. Rows equal in all of ``order`` may take either place.
    """
    spark = df.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    run = pinned(df.repartitionByRange(parts, *order).sortWithinPartitions(*order))
    place = F.monotonically_increasing_id()
    counts = sorted((r[0], r[1]) for r in run.groupBy(F.spark_partition_id()).count().collect())
    before, total = [], 0
    for part, n in counts:
        before.append((part, total))
        total += n
    least, more = divmod(total, shards)
    starts = spark.createDataFrame(before, "curve_part int, curve_before bigint")
    ranked = (
        run.withColumns({"curve_part": F.shiftright(place, 33).cast("int"), "curve_place": place.bitwiseAND(F.lit((1 << 33) - 1))})
        .join(F.broadcast(starts), "curve_part")
        .withColumn("curve_rank", F.col("curve_before") + F.col("curve_place"))
    )
    rank, wide = F.col("curve_rank"), more * (least + 1)
    shard = F.when(rank < wide, F.floor(rank / F.lit(least + 1))).otherwise(F.lit(more) + F.floor((rank - wide) / F.lit(max(least, 1)))).cast("int")
    slot = F.when(rank < wide, rank % F.lit(least + 1)).otherwise((rank - wide) % F.lit(max(least, 1))).cast("bigint")
    return ranked.withColumns({"shard": shard, "slot": slot}).drop("curve_part", "curve_place", "curve_before", "curve_rank")


def shard_documents(docs: DataFrame, shards: int = SHARDS, bits: int = BITS) -> DataFrame:
    """All documents in Hilbert order of (source, lang, size), cut into ``shards`` runs of equal counts.

    size is the text's UTF-8 bytes plus 1; a null text counts none, a null lang or source comes
    first. Returns doc_id, lang, source, size, text_crc32, hilbert, shard and slot; other columns
    are not read. An empty table gives an empty result; repeated rows take a slot each.
    """
    text = F.col("text")
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("bigint").alias("size"), F.crc32(F.encode(F.coalesce(text, F.lit("")), "UTF-8")).alias("text_crc32"),
    )
    rows = pinned(rows)
    curve = with_curve(rows, ["source", "lang", "size"], bits)
    return cut_runs(curve.select(*rows.columns, "hilbert"), ["hilbert", "doc_id", "text_crc32", "size"], shards)


def zone_map(sharded: DataFrame, columns: list[str], rows_per_run: int = 65_536) -> DataFrame:
    """Least and greatest value of each column for every run of a shard's slots: what a reader prunes by."""
    bounds = [f(c).alias(f"{n}_{c}") for c in columns for n, f in (("min", F.min), ("max", F.max))]
    return sharded.groupBy("shard", F.floor(F.col("slot") / rows_per_run).alias("run")).agg(F.count("*").alias("n_rows"), *bounds)


def prune(zones: DataFrame, **ranges: tuple) -> DataFrame:
    """The runs that may hold rows inside every given (least, greatest) range."""
    tests = [(F.col(f"max_{c}") >= F.lit(lo)) & (F.col(f"min_{c}") <= F.lit(hi)) for c, (lo, hi) in ranges.items()]
    return zones.filter(reduce(lambda a, b: a & b, tests, F.lit(True)))


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder a shard, each file sorted along the curve, for readers that skip row groups by min and max."""
    sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
