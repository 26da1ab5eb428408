"""Numbered lines of text files that Spark may split anywhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

#: Splits up to which their table, about 200 bytes a row, is sent to every task; beyond, lines are dealt by split.
BROADCAST_SPLITS = 65_536

PLACE = ("line_file", "line_split", "line_bytes")


def numbered_lines(spark: SparkSession, path: str, catalog: Column | None = None) -> DataFrame:
    """catalog, line_no (from 1 within the catalog), ordinal (from 1 over all) and raw, for every line of the files at ``path``.

    ``catalog`` is an expression over ``line_path``, by default the path itself; several files of one catalog
    count on, in order of their paths, and so do catalogs, by their names. A file is read by as many tasks as it has splits:
    one pass counts the lines of every split, sums over splits give each one's first number, and a second
    pass adds a line's place in its split. Lines end with LF, CR LF or CR; the last one needs no end, and an
    empty file has no line. Bytes that are no UTF-8 become replacement characters. Should the splits differ
    between the passes, as when a file grows meanwhile, the read fails rather than give wrong numbers.
    """
    meta = {"line_path": F.col("_metadata.file_path"), "line_file": F.col("_metadata.file_path"), "line_split": F.col("_metadata.file_block_start"), "line_bytes": F.col("_metadata.file_block_length")}
    scan = spark.read.text(path).select(F.make_valid_utf8("value").alias("raw"), *[c.alias(n) for n, c in meta.items()], F.monotonically_increasing_id().alias("line_at"))
    name = F.col("line_path") if catalog is None else catalog
    splits = scan.groupBy(*PLACE).agg(F.count("*").alias("n"), F.min("line_at").alias("line_first")).withColumn("line_path", F.col("line_file")).withColumn("catalog", name)
    order = ["line_file", "line_split"]
    earlier = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = splits.withColumns({"line_base": earlier(Window.partitionBy("catalog").orderBy(*order)), "line_all": earlier(Window.orderBy("catalog", *order))})
    starts = spark.createDataFrame(rows, starts.schema) if len(rows := starts.limit(BROADCAST_SPLITS + 1).collect()) <= BROADCAST_SPLITS else starts
    starts = starts.select(*PLACE, "catalog", "line_first", "line_base", "line_all")
    joined = scan.drop("line_path").join(F.broadcast(starts) if len(rows) <= BROADCAST_SPLITS else starts, list(PLACE), "left")
    known = F.when(F.col("line_first").isNull() | (F.col("line_at") < F.col("line_first")), F.raise_error(F.lit("the splits of a file changed while its lines were numbered")).cast("bigint")).otherwise(F.col("line_at") - F.col("line_first") + 1)
    return joined.select("catalog", (F.col("line_base") + known).alias("line_no"), (F.col("line_all") + known).alias("ordinal"), "raw")


def file_name(suffix: str = "") -> Column:
    """The last part of ``line_path``, decoded, less ``suffix``."""
    name = F.url_decode(F.replace(F.element_at(F.split("line_path", "/"), -1), F.lit("+"), F.lit("%2B")))
    return F.when(name.endswith(suffix), F.substring(name, F.lit(1), F.length(name) - len(suffix))).otherwise(name) if suffix else name


def folder_value(key: str) -> Column:
    """The value of ``key=`` among the folders of ``line_path``."""
    return F.url_decode(F.replace(F.regexp_extract("line_path", f"/{key}=([^/]*)/", 1), F.lit("+"), F.lit("%2B")))
