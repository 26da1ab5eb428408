"""Readers of catalogs, tables, mappings, ontologies and graph files, all through Spark's own file access."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..operators.ranges import running_before
from .lines import file_name, numbered_lines


def catalogs(spark: SparkSession, path: str, suffix: str = ".src.txt", catalog: Column | None = None) -> DataFrame:
    """White-space separated catalogs: catalog, line_no, ordinal, raw, structure, supplied, supplier_code, well_formed.

    The catalog is the file name less ``suffix``, or an expression over ``line_path``. A line of fewer than two
    fields is not well formed and keeps only its raw text; further fields are ignored; a leading ``>>>`` is
    dropped from structure and kept in supplied. Files are split: see ``numbered_lines``.
    """
    lines = numbered_lines(spark, path, file_name(suffix) if catalog is None else catalog)
    fields = F.split(F.trim(F.regexp_replace("raw", "\\s+", " ")), " ")
    ok = (F.size(fields) >= 2) & (F.get(fields, F.lit(0)) != "")
    supplied = F.when(ok, F.get(fields, F.lit(0)))
    return lines.select("catalog", "line_no", "ordinal", "raw", F.regexp_replace(supplied, "^>>>", "").alias("structure"), supplied.alias("supplied"), F.when(ok, F.get(fields, F.lit(1))).alias("supplier_code"), ok.alias("well_formed"))


def strings_table(spark: SparkSession, path: str, required: list[str] = (), sep: str = "\t") -> DataFrame:
    """A headered table, all strings; missing required columns raise."""
    df = spark.read.csv(path, sep=sep, header=True, inferSchema=False)
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


#: Column names tried in this order where none is given.
ID_CANDIDATES = ("source_compound_id", "compound_id", "source_id", "zinc_id", "id", "ID")
STRUCTURE_CANDIDATES = ("isomeric_smiles", "smiles", "SMILES", "original_smiles")


def inferred_table(spark: SparkSession, path: str, id_column: str | None = None, structure_column: str | None = None, max_rows: int | None = None) -> tuple[DataFrame, str, str]:
    """Commas for .csv, tabs otherwise; a byte order mark is dropped. Returns the table and the columns in use.

    With ``max_rows`` the table has a column scan_was_bounded: whether rows were left out.
    """
    df = strings_table(spark, path, sep="," if path.endswith(".csv") else "\t")
    df = df.toDF(*[c.lstrip("﻿") for c in df.columns])
    chosen = []
    for given, candidates, what in ((id_column, ID_CANDIDATES, "id"), (structure_column, STRUCTURE_CANDIDATES, "structure")):
        name = given or next((c for c in candidates if c in df.columns), None)
        if name not in df.columns:
            raise ValueError(f"no {what} column")
        chosen.append(name)
    if max_rows is not None:
        df = df.limit(max_rows).withColumn("scan_was_bounded", F.lit(not df.offset(max_rows).limit(1).isEmpty()))
    return df, chosen[0], chosen[1]


def mappings(spark: SparkSession, path: str, prefix: str, known: DataFrame | None = None, suffix: str = ".info.txt.gz") -> DataFrame:
    """Tab-separated supplier_code, external_id, structure_key of mapping files, gzipped or not: distinct, non-empty, ids with ``prefix``, of known catalogs."""
    rows = spark.read.text(path).select(F.regexp_replace("_metadata.file_name", suffix.replace(".", "\\.") + "$", "").alias("catalog"), F.split("value", "\t").alias("f")).filter(F.size("f") >= 3)
    out = rows.select("catalog", F.col("f")[0].alias("supplier_code"), F.col("f")[1].alias("external_id"), F.col("f")[2].alias("structure_key"))
    out = out.filter((F.col("supplier_code") != "") & (F.col("structure_key") != "") & F.col("external_id").startswith(prefix))
    return (out.join(known.select("catalog").distinct(), "catalog", "left_semi") if known is not None else out).distinct()


def obo_terms(text: DataFrame, column: str = "value") -> DataFrame:
    """Terms of OBO text, one stanza or whole files a row: id, name, definition, parents in order, obsolete.

    Only [Term] stanzas count; terms without an id are dropped; of one id's stanzas the last wins.
    """
    stanza = F.posexplode(F.split(F.regexp_replace(F.col(column), "\r", ""), "\n(?=\\[)")).alias("at", "body")
    rows = text.select(F.monotonically_increasing_id().alias("file_at"), stanza).filter(F.col("body").startswith("[Term]"))
    tag = lambda name: F.regexp_extract("body", f"(?m)^{name}: *(.*)$", 1)
    parents = F.transform(F.regexp_extract_all("body", F.lit("(?m)^is_a: *([^ !\\n]+)"), F.lit(1)), lambda x: F.trim(x))
    terms = rows.select(
        F.trim(tag("id")).alias("id"), F.trim(tag("name")).alias("name"), F.regexp_extract("body", '(?m)^def: *"(.*)"', 1).alias("definition"), parents.alias("parents"),
        F.col("body").rlike("(?m)^is_obsolete: *true").alias("obsolete"), F.struct("file_at", "at").alias("place"),
    ).filter("id <> ''")
    last = terms.groupBy("id").agg(F.max_by(F.struct("name", "definition", "parents", "obsolete"), "place").alias("t"))
    return last.select("id", "t.*")


def read_obo(spark: SparkSession, path: str) -> DataFrame:
    return obo_terms(spark.read.text(path, wholetext=True))


def term_edges(terms: DataFrame) -> DataFrame:
    return terms.select(F.explode("parents").alias("parent_id"), F.col("id").alias("child_id"))


def tree_edges(spark: SparkSession, path: str) -> DataFrame:
    """Tree edges whose parents were written as floats ('0.0'): both ids as BIGINT."""
    df = strings_table(spark, path, ["parent_class_id", "child_class_id"])
    return df.select(*[F.expr(f"cast(try_cast({c} AS double) AS bigint)").alias(n) for c, n in (("parent_class_id", "parent_id"), ("child_class_id", "child_id"))])


def graphml(spark: SparkSession, path: str, node_data: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Node ids, with their ``node_data`` attributes, and edges of GraphML files; character references of XML are resolved."""
    raw = spark.read.text(path, wholetext=True)

    def plain(c):
        for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#10;", "\n"), ("&#13;", "\r"), ("&#9;", "\t"), ("&amp;", "&")):
            c = F.replace(c, F.lit(name), F.lit(char))
        return c

    quoted = "(?:\"([^\"]*)\"|'([^']*)')"
    value = lambda c, name: plain(F.concat(F.regexp_extract(c, f"\\b{name}={quoted}", 1), F.regexp_extract(c, f"\\b{name}={quoted}", 2)))
    inner = "((?:[^>\"']|\"[^\"]*\"|'[^']*')*)"
    tags = lambda tag, rest="": raw.select(F.explode(F.regexp_extract_all("value", F.lit(f"<{tag} {inner}>{rest}"), F.lit(0))).alias("t"))
    datum = lambda name: F.when(F.contains("t", F.lit(f'<data key="n_{name}">')), plain(F.regexp_extract("t", f'<data key="n_{name}">([^<]*)</data>', 1)))
    nodes = tags("node", "(?:<data [^>]*>[^<]*</data>)*").select(value("t", "id").alias("class_id"), *[datum(n).alias(n) for n in node_data])
    return nodes, tags("edge").select(value("t", "source").alias("parent_id"), value("t", "target").alias("child_id"))


def json_document(spark: SparkSession, path: str, rows: str | None = None) -> DataFrame:
    """Whole JSON documents, a row each; with ``rows``, a row for each member of the array of that name."""
    df = spark.read.json(path, multiLine=True)
    return df if rows is None else df.select(F.explode(rows).alias("r")).select("r.*") if isinstance(df.schema[rows].dataType.elementType, T.StructType) else df.select(F.explode(rows).alias(rows))


def sqlite_table(spark: SparkSession, path: str, query: str, schema: str) -> DataFrame:
    """Rows of a query over SQLite files, read only: each file reaches one task as bytes (2 GB at most) and is opened in memory there."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import sqlite3

        for frame in frames:
            for content in frame["content"]:
                con = sqlite3.connect(":memory:")
                con.deserialize(bytes(content))
                con.execute("PRAGMA query_only = ON")
                found = con.execute(query)
                names = [c[0] for c in found.description]
                while rows := found.fetchmany(10_000):
                    yield pd.DataFrame(rows, columns=names)
                con.close()

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(read, schema)


def largest_file(spark: SparkSession, path: str) -> str | None:
    """The path of the largest file below ``path``, read from listings alone."""
    row = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).agg(F.max_by("path", F.struct("length", "path")).alias("path")).first()
    return row["path"]


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of files."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


CACHE = T.StructType([T.StructField(n, t) for n, t in (("inchikey", T.StringType()), ("source", T.StringType()), ("http_status", T.IntegerType()), ("outcome", T.StringType()), ("n_bytes", T.IntegerType()), ("raw_json", T.StringType()), ("fetched_at", T.StringType()))])


def with_ordinal(df: DataFrame, order: tuple[str, ...] = ("catalog", "line_no")) -> DataFrame:
    """Adds ordinal, 1 on, in ``order``, which must be total: running counts over ranges of the order, so that no task sees a whole catalog."""
    counted = df.withColumn("one", F.lit(1).cast("bigint"))
    return running_before(counted, [F.col(c) for c in order], "one").withColumn("ordinal", F.col("before") + 1).drop("before", "one")
