"""Checks as rows: each names what it looks at and how many violations it found."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .ranges import enough_parts


def orphans(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Rows of ``child`` whose non-null ``column`` is no ``key`` of ``parent``."""
    return child.filter(F.col(column).isNotNull()).join(parent.select(F.col(key).alias(column)).distinct(), column, "left_anti")


def orphan_counts(child: DataFrame, parents: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """One row: for each column of ``child``, how many of its non-null values are no key of its parent. The child is read once for all of them."""
    rows = child.select(*parents)
    for column, (parent, key) in parents.items():
        known = parent.select(F.col(key).alias(column)).distinct().withColumn(f"{column}_known", F.lit(True))
        rows = rows.join(known, column, "left")
    return rows.agg(*[F.count_if(F.col(c).isNotNull() & F.col(f"{c}_known").isNull()).alias(c) for c in parents])


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).count().filter("count > 1")


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one table that the other lacks, with multiplicity; side says whose they are."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def path_gaps(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """(item_id, parent_id, child_id): neighbours of a path (array column node_path) that no edge joins."""
    pairs = paths.select("item_id", F.explode(F.expr("transform(slice(node_path, 1, greatest(size(node_path) - 1, 0)), (x, i) -> struct(x AS parent_id, node_path[i + 1] AS child_id))")).alias("p")).select("item_id", "p.*")
    return pairs.join(edges.select("parent_id", "child_id"), ["parent_id", "child_id"], "left_anti")


def table_digest(df: DataFrame, columns: list[str]) -> DataFrame:
    """n_rows and the sum of row hashes: equal for equal rows in any order, and repeated rows count."""
    row = F.md5(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns]))
    return df.agg(F.count("*").alias("n_rows"), F.coalesce(F.sum(F.conv(F.substring(row, 1, 8), 16, 10).cast("bigint")), F.lit(0)).alias("digest"))


@dataclass
class Checks:
    """A registry: name, severity, and a DataFrame of violations."""

    spark: SparkSession
    found: list[tuple[str, str, DataFrame]] = field(default_factory=list)

    def add(self, name: str, violations: DataFrame, severity: str = "error") -> Checks:
        self.found.append((name, severity, violations))
        return self

    def none_where(self, name: str, df: DataFrame, bad: Column | str, severity: str = "error") -> Checks:
        return self.add(name, df.filter(bad), severity)

    def report(self) -> DataFrame:
        """(check, severity, n_bad), a row for each check."""
        rows = [v.agg(F.count("*").alias("n_bad")).select(F.lit(n).alias("check"), F.lit(s).alias("severity"), "n_bad") for n, s, v in self.found]
        return reduce(DataFrame.unionByName, rows) if rows else self.spark.createDataFrame([], "check string, severity string, n_bad bigint")

    def verdict(self) -> DataFrame:
        """One row: status (FAIL where an error check found any), names of failed errors and warnings."""
        bad = F.col("n_bad") > 0
        names = lambda s: F.array_sort(F.collect_list(F.when(bad & (F.col("severity") == s), F.col("check"))))
        return self.report().agg(names("error").alias("errors"), names("warning").alias("warnings"), F.count("*").alias("n_checks")).withColumn("status", F.when(F.size("errors") > 0, "FAIL").otherwise("PASS"))


def edge_comparison(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row on two copies of a graph: edges of either side alone, of both, nodes of either side alone, and whether they agree."""
    tag = lambda e, side: e.select("parent_id", "child_id").distinct().withColumn("side", F.lit(side))
    both = tag(a, 1).unionByName(tag(b, 2))
    edges = both.groupBy("parent_id", "child_id").agg(F.sum("side").alias("s"))
    ends = lambda c: both.select(F.col(c).alias("node"), "side")
    nodes = ends("parent_id").union(ends("child_id")).distinct().groupBy("node").agg(F.sum("side").alias("s"))
    count = lambda df, names: df.agg(*[F.count_if(F.col("s") == k).alias(n) for k, n in names])
    out = count(edges, ((1, "edges_left"), (2, "edges_right"), (3, "edges_both"))).crossJoin(count(nodes, ((1, "nodes_left"), (2, "nodes_right"))))
    return out.withColumn("agrees", F.expr("edges_left + edges_right + nodes_left + nodes_right = 0"))


def name_crosscheck(a: DataFrame, b: DataFrame, key: str, name: str) -> DataFrame:
    """One row on two tables of (id, name): pairs held against each other, and those whose names differ (a null differs from a name)."""
    other = b.select(F.col(key), F.col(name).alias("other_name"))
    return a.select(key, name).join(other, key).agg(F.count("*").alias("n_pairs"), F.count_if(~F.col(name).eqNullSafe(F.col("other_name"))).alias("n_mismatches"))


def preflight(df: DataFrame, key: str, text: str, outputs: list[str], limit: int | None = None) -> DataFrame:
    """One row before a run: counts, whether the scan was bounded by ``limit`` rows, critical findings by name, planned outputs, and the exit status (1 with any critical finding)."""
    rows = df if limit is None else df.limit(limit)
    blank = F.col(text).isNull() | (F.trim(text) == "")
    counts = rows.agg(F.count("*").alias("n_rows"), (F.count(key) - F.count_distinct(key)).alias("n_duplicate_ids"), F.count_if(F.col(key).isNull()).alias("n_blank_ids"), F.count_if(blank).alias("n_blank_texts"))
    bounded = F.lit(False) if limit is None else F.lit(not df.offset(limit).limit(1).isEmpty())
    found = {"no_rows": F.col("n_rows") == 0, "duplicate_ids": F.col("n_duplicate_ids") > 0, "blank_ids": F.col("n_blank_ids") > 0, "all_texts_blank": (F.col("n_rows") > 0) & (F.col("n_blank_texts") == F.col("n_rows"))}
    critical = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in found.items()]))
    return counts.withColumns({"scan_was_bounded": bounded, "critical": critical, "outputs": F.lit(outputs)}).withColumn("exit_status", (F.size("critical") > 0).cast("int"))


def coverage_snapshot(df: DataFrame, levels: list[str], top: str) -> DataFrame:
    """One row: rows, distinct values of each level, and the distribution over ``top`` as one line, most frequent first."""
    counts = df.groupBy(F.coalesce(F.col(top).cast("string"), F.lit("-")).alias("value")).agg(F.count("*").alias("n"))
    line = counts.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), "value"))), lambda x: F.concat(x["value"], F.lit("="), (-x["less"]).cast("string"))), " ").alias("distribution"))
    return df.agg(F.count("*").alias("n_rows"), *[F.count_distinct(c).alias(f"n_{c}") for c in levels]).crossJoin(line)


def propagation_gaps(facts: DataFrame, pairs: DataFrame, kind: str = "membership_type") -> DataFrame:
    """(item_id, class_id, side): inferred facts that recomputing them from the direct ones and all (ancestor, node) pairs does not give (left), and those it gives that are not there (right)."""
    direct = facts.filter(F.col(kind) == "direct").select("item_id", "class_id")
    stored_ = facts.filter(F.col(kind) != "direct").select("item_id", "class_id")
    again = direct.join(pairs, direct["class_id"] == pairs["node"]).select("item_id", F.col("ancestor").alias("class_id")).distinct().join(direct, ["item_id", "class_id"], "left_anti")
    return difference(stored_, again)


#: Probes of one task, about; an item may have several facts for each.
PROBES = 1 << 16


def probes(facts: DataFrame, expected: DataFrame) -> DataFrame:
    """(item_id, class_id, wanted): probes that fail; expected has those columns, wanted true for a class that an item must have and false for one that it must not.

    Facts are sorted, never gathered: repeated ones need no removal for a semi or an anti join, and tasks
    grow in number with the probes.
    """
    on, n = ["item_id", "class_id"], enough_parts(expected, PROBES)
    have = facts.select(*on).repartition(n, *on).hint("merge")
    asked = expected.select(*on, *[c for c in expected.columns if c not in on]).repartition(n, *on)
    return asked.filter("wanted").join(have, on, "left_anti").unionByName(asked.filter("not wanted").join(have, on, "left_semi"))
