"""Declarative class rules, fused into one expression over one scan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


@dataclass(frozen=True)
class ClassNode:
    class_id: str
    name: str
    priority: int


@dataclass(frozen=True)
class Rule:
    """``predicate`` is a SQL condition; ``family`` groups classes that count once for the multiple flag; ``specific`` classes resolve a row."""

    class_id: str
    predicate: str
    family: str | None = None
    specific: bool = True


@dataclass(frozen=True)
class RuleSet:
    nodes: tuple[ClassNode, ...]
    edges: tuple[tuple[str, str], ...]
    rules: tuple[Rule, ...]
    root: str
    gate: str
    multiple: str
    unresolved: str

    def direct(self) -> Column:
        """Sorted direct classes: the root alone where the gate fails; else all rules that hold, and the two fallbacks.

        One projection evaluates every predicate; rows take no join and no shuffle.
        """
        hits = F.array_compact(F.array(*[F.when(F.expr(r.predicate), F.lit(r.class_id)) for r in self.rules]))
        families = F.array_distinct(F.array_compact(F.array(*[F.when(F.expr(r.predicate), F.lit(r.family)) for r in self.rules if r.family])))
        resolved = F.lit(False)
        for r in self.rules:
            if r.specific:
                resolved = resolved | F.coalesce(F.expr(r.predicate), F.lit(False))
        extra = F.array_compact(F.array(F.when(F.size(families) >= 2, F.lit(self.multiple)), F.when(~resolved, F.lit(self.unresolved))))
        return F.when(F.coalesce(F.expr(self.gate), F.lit(False)), F.array_sort(F.concat(hits, extra))).otherwise(F.array(F.lit(self.root)))

    def node_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(n.class_id, n.name, n.priority) for n in self.nodes], "class_id string, name string, priority int")

    def edge_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.edges), "parent_id string, child_id string")

    def ancestors(self) -> dict[str, list[str]]:
        parents: dict[str, list[str]] = {}
        for p, c in self.edges:
            parents.setdefault(c, []).append(p)

        def up(n: str) -> set[str]:
            return {a for p in parents.get(n, []) for a in {p} | up(p)}

        return {n.class_id: sorted(up(n.class_id)) for n in self.nodes}

    def paths(self) -> dict[str, list[str]]:
        """For each class the longest path from the root; of equally long ones the lexicographically greatest."""
        parents: dict[str, list[str]] = {}
        for p, c in self.edges:
            parents.setdefault(c, []).append(p)

        def best(n: str) -> list[str]:
            options = [best(p) + [n] for p in parents.get(n, [])]
            return max(options, key=lambda x: (len(x), x)) if options else [n]

        return {n.class_id: best(n.class_id) for n in self.nodes}


def membership(df: DataFrame, ids: str, rules: RuleSet, direct: Column | None = None) -> DataFrame:
    """Typed class facts: direct ones, and those that the hierarchy adds; is_primary marks one direct class a row.

    ``direct`` gives a row's direct classes where a kernel, not the rules, finds them.

    The hierarchy is a literal map, so ancestors are added without a join.
    """
    depth = {k: len(v) - 1 for k, v in rules.paths().items()}
    table = lambda d, kind: F.from_json(F.lit(json_of(d)), f"map<string,{kind}>")
    rank = {n.class_id: (depth[n.class_id], n.priority) for n in rules.nodes}
    order = sorted(rank, key=lambda c: (*rank[c], c))
    place = F.create_map(*[F.lit(x) for c in order for x in (c, order.index(c))])
    above = table(rules.ancestors(), "array<string>")
    rows = df.select(F.col(ids).alias("item_id"), (rules.direct() if direct is None else direct).alias("direct"))
    rows = rows.withColumn("inferred", F.array_except(F.array_distinct(F.flatten(F.transform("direct", lambda c: above[c]))), F.col("direct")))
    rows = rows.withColumn("primary_class", F.aggregate("direct", F.lit(""), lambda a, c: F.when((a == "") | (place[c] > place[a]), c).otherwise(a)))
    facts = F.concat(
        F.transform("direct", lambda c: F.struct(c.alias("class_id"), F.lit("direct").alias("membership_type"), F.lit("rule_predicate").alias("source"), (c == F.col("primary_class")).cast("int").alias("is_primary"))),
        F.transform("inferred", lambda c: F.struct(c.alias("class_id"), F.lit("inferred_assignment").alias("membership_type"), F.lit("ancestor_propagation").alias("source"), F.lit(0).alias("is_primary"))),
    )
    return rows.select("item_id", F.explode(facts).alias("f")).select("item_id", "f.*")


def primary_paths(df: DataFrame, ids: str, rules: RuleSet, direct: Column | None = None) -> DataFrame:
    """(item_id, primary_class, path ids, path names)."""
    facts = membership(df, ids, rules, direct).filter("is_primary = 1").select("item_id", F.col("class_id").alias("primary_class"))
    paths = F.from_json(F.lit(json_of(rules.paths())), "map<string,array<string>>")
    names = F.create_map(*[F.lit(x) for n in rules.nodes for x in (n.class_id, n.name)])
    return facts.withColumn("node_path", paths[F.col("primary_class")]).withColumn("taxonomy_path", F.array_join(F.transform("node_path", lambda c: names[c]), " > "))


def json_of(value: dict) -> str:
    import json

    return json.dumps(value, sort_keys=True)
