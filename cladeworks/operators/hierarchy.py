"""Graphs of classes: closure, depth, paths, projections, audits. Edges are (parent_id, child_id).

All walks go in rounds: a round takes every node or pair that the last one settled a step further, as
joins and aggregates over the whole graph. Work grows with edges (for a closure: with its pairs), never
with the number of paths, and no number of levels or rows is too great. Edges with a null end are no edges.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..storage import Rounds, pinned, stored
from .ranges import running_before


class Cycle(ValueError):
    """A walk that needs an acyclic graph met a cycle."""


def clean(edges: DataFrame) -> DataFrame:
    return edges.select("parent_id", "child_id").dropna().distinct()


def flipped(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("child_id").alias("parent_id"), F.col("parent_id").alias("child_id"))


def ends(edges: DataFrame, own: str, other: str) -> DataFrame:
    """Nodes at the ``own`` end of edges that are never at the ``other``."""
    return edges.select(F.col(own).alias("node")).distinct().join(edges.select(F.col(other).alias("node")).distinct(), "node", "left_anti")


def by_level(edges: DataFrame, roots: DataFrame, value: Column, extend: Callable[[Column, Column], Column], fold: Callable[[Column], Column] = F.max) -> DataFrame:
    """(node, value) by rounds from the roots: a node is settled once all its parents are.

    Roots start with ``value``; ``extend`` takes a parent's value over an edge (given that and the
    child), ``fold`` joins what a node's parents give. Each edge is walked once. Nodes that stay
    unsettled lie on or below a cycle: that is an error.
    """
    edges = stored(clean(edges))
    need = stored(edges.groupBy(F.col("child_id").alias("node")).agg(F.count("*").alias("need")))
    rounds = Rounds(edges.sparkSession)
    last = rounds.add(roots.select("node", value.alias("value"), F.lit(0).cast("bigint").alias("got"), F.lit(0).cast("bigint").alias("need")))
    while True:
        ready = last.filter("got = need")
        if ready.isEmpty():
            break
        given = ready.join(edges, ready["node"] == edges["parent_id"]).groupBy(F.col("child_id").alias("node")).agg(fold(extend(F.col("value"), F.col("child_id"))).alias("value"), F.count("*").alias("got"))
        waiting = last.filter("got < need").select("node", "value", "got")
        both = waiting.unionByName(given).groupBy("node").agg(fold(F.col("value")).alias("value"), F.sum("got").alias("got"))
        last = rounds.add(both.join(need, "node").select("node", "value", "got", "need"))
    if not last.isEmpty() or (rounds.n == 1 and not edges.isEmpty()):
        raise Cycle("the graph has a cycle")
    return rounds.all().filter("got = need").select("node", "value")


def reached(edges: DataFrame, start: DataFrame) -> DataFrame:
    """Nodes that walks from ``start`` (node) come to, those included."""
    edges = stored(clean(edges))
    rounds = Rounds(edges.sparkSession)
    fresh = rounds.add(start.select("node").distinct())
    while not fresh.isEmpty():
        step = fresh.join(edges, fresh["node"] == edges["parent_id"]).select(F.col("child_id").alias("node")).distinct()
        fresh = rounds.add(step.join(rounds.all(), "node", "left_anti"))
    return rounds.all()


def closure(edges: DataFrame) -> DataFrame:
    """Distinct (ancestor, node) pairs of a graph, which may have cycles: each round joins only the last one's new pairs."""
    edges = stored(clean(edges).filter("parent_id <> child_id"))
    rounds = Rounds(edges.sparkSession)
    fresh = rounds.add(edges.select(F.col("parent_id").alias("ancestor"), F.col("child_id").alias("node")))
    while not fresh.isEmpty():
        step = fresh.join(edges, fresh["node"] == edges["parent_id"]).select("ancestor", F.col("child_id").alias("node")).filter("ancestor <> node").distinct()
        fresh = rounds.add(step.join(rounds.all(), ["ancestor", "node"], "left_anti"))
    return rounds.all()


def depths(edges: DataFrame) -> DataFrame:
    """(node, depth): edges on the longest path from a root."""
    return by_level(edges, ends(clean(edges), "parent_id", "child_id"), F.lit(0), lambda v, _: v + 1).withColumnRenamed("value", "depth")


def longest(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, path): the longest path from a root, of equally long ones the greatest. A parent's best path is part of its child's."""
    best = by_level(edges, roots, F.struct(F.lit(1).alias("n"), F.array("node").alias("path")), lambda v, child: F.struct((v["n"] + 1).alias("n"), F.array_append(v["path"], child).alias("path")))
    return best.select("node", F.col("value.path").alias("path"))


def primary_path(edges: DataFrame) -> DataFrame:
    """(node, path): the longest path from any root, of equally long ones the greatest."""
    return longest(edges, ends(clean(edges), "parent_id", "child_id"))


def tree_projection(edges: DataFrame) -> DataFrame:
    """(child_id, parent_id): every node keeps its deepest parent, of equally deep ones that of the greatest id."""
    d = depths(edges)
    joined = clean(edges).join(d, F.col("parent_id") == F.col("node"))
    return joined.groupBy("child_id").agg(F.max_by("parent_id", F.struct("depth", "parent_id")).alias("parent_id"))


def core(edges: DataFrame) -> DataFrame:
    """What is left when edges from nodes without parents and to nodes without children are peeled off: cycles and what lies between them."""
    left = stored(clean(edges))
    n = left.count()
    while n:
        kept = left.join(left.select(F.col("child_id").alias("parent_id")).distinct(), "parent_id", "left_semi")
        kept = stored(kept.join(left.select(F.col("parent_id").alias("child_id")).distinct(), "child_id", "left_semi").select("parent_id", "child_id"))
        left, before, n = kept, n, kept.count()
        if n == before:
            break
    return left


def is_acyclic(edges: DataFrame) -> bool:
    return core(edges).isEmpty()


def cycle_nodes(edges: DataFrame) -> DataFrame:
    """Nodes that reach themselves.

    Every node of the core takes the greatest node that reaches it as its colour. Going back from a
    node of its own colour inside that colour gives one strong component; these go, and the rest is
    coloured again.
    """
    spark = edges.sparkSession
    found = Rounds(spark)
    left = core(edges)
    kind = left.schema["parent_id"].dataType
    found.add(spark.createDataFrame([], f"node {kind.simpleString()}"))
    while not left.isEmpty():
        colour = stored(left.select(F.col("parent_id").alias("node")).union(left.select("child_id")).distinct().withColumn("colour", F.col("node")))
        while True:
            near = left.join(colour, left["parent_id"] == colour["node"]).groupBy(F.col("child_id").alias("node")).agg(F.max("colour").alias("near"))
            new = stored(colour.join(near, "node", "left").select("node", F.greatest("colour", F.coalesce("near", "colour")).alias("colour"), (F.col("near") > F.col("colour")).alias("moved")))
            colour = new.select("node", "colour")
            if new.filter("moved").isEmpty():
                break
        side = lambda n: colour.select(F.col("node").alias(n), F.col("colour").alias(f"c_{n}"))
        inside = stored(left.join(side("parent_id"), "parent_id").join(side("child_id"), "child_id").filter("c_parent_id = c_child_id").select("parent_id", "child_id"))
        strong = stored(reached(flipped(inside), colour.filter("node = colour").select("node")).join(colour, "node"))
        many = strong.groupBy("colour").agg(F.count("*").alias("n")).filter("n > 1").select("colour")
        loops = left.filter("parent_id = child_id").select(F.col("parent_id").alias("node"))
        found.add(strong.join(many, "colour", "left_semi").select("node").union(strong.join(loops, "node", "left_semi").select("node")).distinct())
        gone = strong.select("node")
        left = core(left.join(gone, left["parent_id"] == gone["node"], "left_anti").join(gone, left["child_id"] == gone["node"], "left_anti"))
    return found.all()


def degree_stats(edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, roots, leaves, nodes with several parents."""
    nodes = edges.select(F.col("parent_id").alias("node")).union(edges.select("child_id")).distinct()
    parents = edges.groupBy(F.col("child_id").alias("node")).agg(F.count("*").alias("n_in"))
    children = edges.groupBy(F.col("parent_id").alias("node")).agg(F.count("*").alias("n_out"))
    per = nodes.join(parents, "node", "left").join(children, "node", "left").na.fill(0)
    return per.agg(
        F.count("*").alias("n_nodes"), F.sum("n_in").alias("n_edges"), F.count_if(F.col("n_in") == 0).alias("n_roots"),
        F.count_if(F.col("n_out") == 0).alias("n_leaves"), F.count_if(F.col("n_in") > 1).alias("n_multi_parent"),
    )


def weak_components(edges: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """(node, component): least node reachable in either direction; labels jump to their label's label each round.

    Labels that still move after ``max_rounds`` are an error: what they would give is no component.
    """
    both = pinned(edges.select(F.col("parent_id").alias("a"), F.col("child_id").alias("b")).union(edges.select("child_id", "parent_id")).distinct())
    label = pinned(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("component")))
    for _ in range(max_rounds):
        near = both.join(label, F.col("b") == F.col("node")).groupBy("a").agg(F.min("component").alias("near"))
        merged = label.join(near, label["node"] == near["a"]).select("node", F.least("component", "near").alias("component"))
        jump = merged.select(F.col("node").alias("component"), F.col("component").alias("further"))
        new = pinned(merged.join(jump, "component", "left").select("node", F.coalesce("further", "component").alias("component")))
        if new.join(label, ["node", "component"], "left_anti").isEmpty():
            return new
        label = new
    raise RuntimeError(f"components still change after {max_rounds} rounds")


def subtree_sizes(edges: DataFrame) -> DataFrame:
    """(node, n_descendants) of nodes that have any.

    Where no node has two parents, sizes add up from the leaves; else descendants are shared, and
    the pairs of the closure are counted.
    """
    edges = clean(edges)
    if edges.groupBy("child_id").count().filter("count > 1").isEmpty():
        try:
            sizes = by_level(flipped(edges), ends(edges, "child_id", "parent_id"), F.lit(0).cast("bigint"), lambda v, _: v + 1, F.sum)
            return sizes.filter("value > 0").withColumnRenamed("value", "n_descendants")
        except Cycle:
            pass
    return closure(edges).groupBy(F.col("ancestor").alias("node")).agg(F.count("*").alias("n_descendants"))


def below(edges: DataFrame, root) -> DataFrame:
    """(node, path): the longest path from ``root`` to each node of its subtree, itself included if the graph has it."""
    edges = stored(clean(edges))
    start = stored(edges.select(F.col("parent_id").alias("node")).union(edges.select("child_id")).filter(F.col("node") == F.lit(root)).distinct())
    inside = stored(reached(edges, start))
    return longest(edges.join(inside, edges["parent_id"] == inside["node"], "left_semi"), start)


def deepest_path(edges: DataFrame, root) -> DataFrame:
    """One row (path): from ``root`` down to its deepest descendant, of equally deep ones the greatest path; none for an unknown root."""
    return below(edges, root).agg(F.max(F.struct(F.size("path").alias("n"), "path"))["path"].alias("path")).filter("path is not null")


def capped_subtree(edges: DataFrame, root, most: int = 50) -> DataFrame:
    """Rows of a subtree down to the deepest level at which it has ``most`` nodes at most (one level at least): node, depth, path, n_hidden below the cut."""
    rows = stored(below(edges, root).withColumn("depth", F.size("path") - 1))
    levels = rows.groupBy("depth").agg(F.count("*").alias("n")).withColumn("run", F.sum("n").over(Window.orderBy("depth")))  # a row a level
    cap = levels.agg(F.greatest(F.coalesce(F.max(F.when(F.col("run") <= most, F.col("depth"))), F.lit(0)), F.lit(1)).alias("cap"))
    hidden = subtree_sizes(edges)
    return rows.crossJoin(F.broadcast(cap)).filter("depth <= cap").join(hidden, "node", "left").select("node", "depth", F.array_join("path", "/").alias("path"), F.when(F.col("depth") == F.col("cap"), F.coalesce("n_descendants", F.lit(0))).otherwise(0).alias("n_hidden"))


def first_parent_lineage(terms: DataFrame) -> DataFrame:
    """(node, lineage from itself to the root) by each term's first parent; terms: (node, parents array).

    A missing parent ends the walk, as does one that it has passed. Each round doubles the walks: a
    walk that has come to a term goes on with that term's own.
    """
    own = terms.select("node", F.expr("get(parents, 0)").alias("at")).dropDuplicates(["node"])
    known = own.select(F.col("node").alias("at")).distinct()
    at = own.filter("at <> node").join(known, "at", "left_semi").select("node", "at")
    walk = stored(own.select("node").join(at, "node", "left").select("node", "at", F.array("node").alias("lineage")))
    while not walk.filter("at is not null").isEmpty():
        further = walk.select(F.col("node").alias("at"), F.col("at").alias("to"), F.col("lineage").alias("more"))
        going = walk.filter("at is not null").join(further, "at")
        whole = F.concat("lineage", "more")
        # A walk that meets itself ends there: distinct terms stand before the first repeat.
        met = F.arrays_overlap("lineage", "more")
        until = F.when(met, F.array_distinct(whole)).otherwise(whole)
        going = going.select("node", F.when(~met, F.col("to")).alias("at"), until.alias("lineage"))
        walk = stored(walk.filter("at is null").unionByName(going))
    return walk.select("node", "lineage")


def path_levels(column: str, levels: int = 3) -> list:
    """Columns l1.., leaf and a ' > ' path of a description whose levels are set apart by two spaces or more."""
    parts = F.expr(f"filter(transform(split(replace({column}, '\\t', '  '), '  '), x -> trim(x)), x -> x <> '')")
    return [F.get(parts, i).alias(f"l{i + 1}") for i in range(levels)] + [F.try_element_at(parts, F.lit(-1)).alias("leaf"), F.array_join(parts, " > ").alias("path")]


def maximally_specific(facts: DataFrame, pairs: DataFrame) -> DataFrame:
    """Facts (item_id, class_id) without those whose class is an ancestor of another of the item's classes."""
    above = facts.join(pairs, facts["class_id"] == pairs["node"]).select("item_id", F.col("ancestor").alias("class_id")).distinct()
    return facts.join(above, ["item_id", "class_id"], "left_anti")


def lineage_of_names(names: DataFrame, terms: DataFrame) -> DataFrame:
    """Class names (name) with the root-to-leaf lineage of their term: name, node, ids, labels, superclass (place 2) and class (place 3).

    terms: (node, name, parents array); of terms with one name the least id counts. A name without a term has nulls.
    """
    by_name = terms.filter("name <> ''").groupBy("name").agg(F.min("node").alias("node"))
    up = first_parent_lineage(terms.select("node", "parents")).select("node", F.posexplode(F.reverse("lineage")).alias("at", "id"))
    label = terms.groupBy(F.col("node").alias("id")).agg(F.min("name").alias("label"))
    rows = up.join(label, "id", "left").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("at", "id", "label"))).alias("l"))
    found = names.select("name").join(by_name, "name", "left").join(rows, "node", "left")
    return found.select("name", "node", F.transform("l", lambda x: x["id"]).alias("ids"), F.transform("l", lambda x: x["label"]).alias("labels"), F.get(F.col("l.id"), F.lit(2)).alias("superclass"), F.get(F.col("l.id"), F.lit(3)).alias("class"))


def typed_edges(relations: DataFrame, kind: str = "is_a") -> tuple[DataFrame, DataFrame]:
    """The edges of one relation type, for closures, and all others, kept apart with their relation_type."""
    own = F.col("relation_type") == kind
    return relations.filter(own).select("parent_id", "child_id"), relations.filter(~own | F.col("relation_type").isNull())


def topology_audit(terms: DataFrame) -> DataFrame:
    """One row on an ontology's terms (node, parents array, obsolete): n_terms, n_edges, n_roots, roots, n_multi_parent, n_obsolete, n_dangling, n_cycle_nodes, acyclic, max_depth and histogram.

    Edges count as written, also to parents that are no terms; dangling ones are these parents, distinct. A term's depth is
    the length of its first-parent lineage less 1; the histogram is 'depth=n' by depth. Cycles are sought among all edges
    between terms. roots lists the first hundred in order. Without terms counts are 0 and the rest is null.
    """
    terms = terms.select("node", F.coalesce("parents", F.array().cast("array<string>")).alias("parents"), F.coalesce("obsolete", F.lit(False)).alias("obsolete"))
    sizes = F.size("parents")
    counts = terms.agg(
        F.count("*").alias("n_terms"), F.coalesce(F.sum(sizes), F.lit(0)).alias("n_edges"), F.count_if(sizes == 0).alias("n_roots"),
        F.count_if(sizes > 1).alias("n_multi_parent"), F.count_if("obsolete").alias("n_obsolete"),
    )
    edges = terms.select(F.explode("parents").alias("parent_id"), F.col("node").alias("child_id"))
    known = terms.select(F.col("node").alias("parent_id")).distinct()
    dangling = edges.join(known, "parent_id", "left_anti").agg(F.count_distinct("parent_id").alias("n_dangling"))
    looped = cycle_nodes(edges.join(known, "parent_id", "left_semi")).agg(F.count("*").alias("n_cycle_nodes"))
    levels = first_parent_lineage(terms.select("node", "parents")).groupBy((F.size("lineage") - 1).alias("depth")).agg(F.count("*").alias("n"))
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("depth", "n"))), lambda x: F.concat(x["depth"].cast("string"), F.lit("="), x["n"].cast("string"))), " ")
    depth = levels.agg(F.max("depth").alias("max_depth"), line.alias("histogram"))
    roots = terms.filter(sizes == 0).orderBy("node").limit(100).agg(F.array_join(F.array_sort(F.collect_list("node")), ";").alias("roots"))
    return counts.crossJoin(roots).crossJoin(dangling).crossJoin(looped).crossJoin(depth).withColumn("acyclic", F.col("n_cycle_nodes") == 0)  # one row each


def family_rows(groups: DataFrame, families: DataFrame, collapsed: list[str] = (), descending: bool = False) -> DataFrame:
    """A two-level listing: position, depth, label, kind (group, leaf or collapsed) and group, in order of the group's and then the family's name.

    groups: (group_id, name), families: (group_id, name). A group in ``collapsed`` shows one row, the count of its families,
    in place of these; a group without families shows itself alone. Positions are running counts over ranges.
    """
    kinds = groups.select("group_id", F.col("name").alias("group"))
    own = kinds.select("group", F.lit(1).alias("depth"), F.col("group").alias("label"), F.lit("group").alias("kind"))
    inside = families.select("group_id", F.col("name").alias("label")).join(kinds, "group_id")
    shut = F.col("group").isin(*collapsed) if collapsed else F.lit(False)
    leaves = inside.filter(~shut).select("group", F.lit(2).alias("depth"), "label", F.lit("leaf").alias("kind"))
    counted = inside.filter(shut).groupBy("group").agg(F.count("*").alias("n")).select("group", F.lit(2).alias("depth"), F.concat(F.lit("("), F.col("n").cast("string"), F.lit(" families)")).alias("label"), F.lit("collapsed").alias("kind"))
    rows = own.unionByName(leaves).unionByName(counted)
    if descending:  # a running count from the other end of the groups
        place = kinds.select("group").distinct().withColumn("one", F.lit(1).cast("bigint"))
        place = running_before(place, [F.col("group")], "one").select("group", (-F.col("before")).alias("turn"))
        rows = rows.join(place, "group")
    else:
        rows = rows.withColumn("turn", F.lit(0).cast("bigint"))
    ordered = running_before(rows.withColumn("one", F.lit(1).cast("bigint")), [F.col("turn"), F.col("group"), F.col("depth"), F.col("label")], "one")
    return ordered.select(F.col("before").alias("position"), "depth", "label", "kind", "group")
