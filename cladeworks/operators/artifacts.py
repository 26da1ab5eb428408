"""Whether artifacts hold the same rows: digests that add up, in any order and from any parts."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Sums are taken modulo 2**64.
WORD = str(1 << 64)
#: Parts of the keys whose digests are held against each other before any row is.
PARTS = 256


def row_text(columns: list[str]) -> Column:
    """A row as text: formats without nulls write them as empty, so both count as equal."""
    return F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])


def digest(df: DataFrame, columns: list[str], by: list[Column] = ()) -> DataFrame:
    """n_rows and digest, 32 hexadecimal digits, of all rows or of each group ``by``.

    Both halves of each row's MD5 are added modulo 2**64: equal for equal rows in any order, repeated rows
    count, and digests of parts add up to the whole's.
    """
    row = F.md5(row_text(columns))
    half = lambda at: F.sum(F.conv(F.substring(row, at, 16), 16, 10).cast("decimal(20,0)"))
    sums = df.groupBy(*by).agg(F.count("*").alias("n_rows"), half(1).alias("high"), half(17).alias("low"))
    return sums.withColumn("digest", F.concat(*[as_hex(F.col(c)) for c in ("high", "low")])).drop("high", "low")


def as_hex(total: Column) -> Column:
    short = (F.coalesce(total, F.lit(0)) % F.lit(WORD).cast("decimal(20,0)")).cast("decimal(20,0)").cast("string")
    return F.lpad(F.lower(F.conv(short, 10, 16)), 16, "0")


def from_hex(column: str, at: int) -> Column:
    return F.sum(F.conv(F.substring(column, at, 16), 16, 10).cast("decimal(20,0)"))


def added(digests: DataFrame) -> DataFrame:
    """One digest of the digests of parts (n_rows, digest)."""
    return digests.agg(F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_rows"), F.concat(as_hex(from_hex("digest", 1)), as_hex(from_hex("digest", 17))).alias("digest"))


def compared(artifacts: dict[str, DataFrame], columns: list[str]) -> DataFrame:
    """artifact, n_rows, digest and agrees: whether it holds the same rows as the first one."""
    rows = [digest(df, columns).withColumn("artifact", F.lit(n)) for n, df in artifacts.items()]
    every = reduce(DataFrame.unionByName, rows)
    first = rows[0].select(F.col("n_rows").alias("first_rows"), F.col("digest").alias("first_digest"))
    same = (F.col("n_rows") == F.col("first_rows")) & (F.col("digest") == F.col("first_digest"))
    return every.crossJoin(F.broadcast(first)).select("artifact", "n_rows", "digest", same.alias("agrees"))  # one row each


def changed_rows(a: DataFrame, b: DataFrame, columns: list[str], key: list[str]) -> DataFrame:
    """The rows that one of two artifacts has more often than the other: columns, side (left or right), and times.

    Digests of PARTS parts of the keys are compared first, and only rows of parts that differ are.
    """
    part = F.pmod(F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in key]), F.lit(PARTS)).alias("part")
    of = lambda df, n: digest(df, columns, [part]).select("part", F.col("n_rows").alias(f"rows_{n}"), F.col("digest").alias(f"digest_{n}"))
    both = of(a, "a").join(of(b, "b"), "part", "full").filter("not (rows_a <=> rows_b and digest_a <=> digest_b)")
    differ = [r[0] for r in both.select("part").collect()]  # PARTS numbers at most
    own = lambda df, k: df.filter(part.isin(differ)).select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns], F.lit(k).alias("_more"))
    rows = own(a, 1).unionByName(own(b, -1)).groupBy(*columns).agg(F.sum("_more").alias("_more")).filter("_more <> 0")
    return rows.select(*columns, F.when(F.col("_more") > 0, "left").otherwise("right").alias("side"), F.abs("_more").alias("times"))


def reruns(spark: SparkSession, build: Callable[[], DataFrame], columns: list[str], settings: list[dict[str, str]]) -> DataFrame:
    """run, n_rows, digest and agrees of one job run under each of the settings: rows, not files, are compared, so order and partitions may differ."""
    found = []
    for k, own in enumerate(settings):
        before = {n: spark.conf.get(n) for n in own}
        try:
            for n, v in own.items():
                spark.conf.set(n, v)
            found.append((k, *digest(build(), columns).select("n_rows", "digest").first()))
        finally:
            for n, v in before.items():
                spark.conf.set(n, v)
    return spark.createDataFrame([(k, n, d, (n, d) == found[0][1:]) for k, n, d in found], "run int, n_rows bigint, digest string, agrees boolean")
