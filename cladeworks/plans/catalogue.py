"""Registered queries over the star schema: each applies the engine's operators to whole tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions import molecule_classes
from ..operators import dedup, enrich, evaluate, hierarchy, quality, rules, sampling, splits, standardize
from ..sources import readers
from ..storage import stored
from ..streaming import incremental
from . import demo_rules as demo

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def long(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("bigint")


def demo_edges(spark: SparkSession) -> DataFrame:
    return demo.PARTS.edge_frame(spark)


def geography(spark: SparkSession, d: str) -> DataFrame:
    """World, regions, nations and customers as one tree of edges."""
    region = table(spark, d, "region").select(F.lit("W").alias("parent_id"), F.concat(F.lit("R"), F.col("r_regionkey")).alias("child_id"))
    nation = table(spark, d, "nation").select(F.concat(F.lit("R"), F.col("n_regionkey")), F.concat(F.lit("N"), F.col("n_nationkey")))
    customer = table(spark, d, "customer").select(F.concat(F.lit("N"), F.col("c_nationkey")), F.concat(F.lit("C"), F.col("c_custkey")))
    return region.union(nation).union(customer)


GEO_SQL = """geo(parent_id, child_id) AS (SELECT 'W', 'R' || r_regionkey FROM region UNION ALL SELECT 'R' || n_regionkey, 'N' || n_nationkey FROM nation
  UNION ALL SELECT 'N' || c_nationkey, 'C' || c_custkey FROM customer),
walk(node, path) AS (SELECT 'W', ['W'] UNION ALL SELECT g.child_id, list_append(w.path, g.child_id) FROM walk w JOIN geo g ON g.parent_id = w.node)"""


# Scans, projections, predicates


@query("SELECT p_partkey, p_name, p_size FROM part WHERE p_name IS NOT NULL AND p_name <> ''")
def scan_required_cols(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").filter(F.col("p_name").isNotNull() & (F.col("p_name") != "")).select("p_partkey", "p_name", "p_size")


@query("SELECT concat_ws(':', 'SRC', source, doc_id) AS record_id, try_cast(split_part(concat_ws(':', 'SRC', source, doc_id), ':', 3) AS BIGINT) AS line_no FROM documents")
def source_record_ids(spark: SparkSession, d: str) -> DataFrame:
    ids = F.concat_ws(":", F.lit("SRC"), "source", "doc_id")
    return table(spark, d, "documents").select(ids.alias("record_id"), F.expr("try_cast(element_at(split(concat_ws(':', 'SRC', source, doc_id), ':'), -1) AS bigint)").alias("line_no"))


@query("""SELECT doc_id, CASE WHEN text IS NULL OR trim(text) = '' THEN 'input_validation' WHEN n_chars < 100 THEN 'too_short' WHEN text LIKE '%|%' THEN 'markup' ELSE 'ok' END AS status FROM documents""")
def failure_routing(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("text").isNull() | (F.trim("text") == ""), "input_validation").when(F.col("n_chars") < 100, "too_short").when(F.contains("text", F.lit("|")), "markup").otherwise("ok")
    return table(spark, d, "documents").select("doc_id", status.alias("status"))


# Deduplication


FIRST_SQL = "keyed AS (SELECT doc_id, md5(text) AS k FROM documents), firsts AS (SELECT k, min(doc_id) AS rep FROM keyed GROUP BY k)"


def keyed(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5("text").alias("k"))


@query(f"WITH {FIRST_SQL} SELECT rep AS doc_id, k AS dedup_key FROM firsts")
def first_wins_representatives(spark: SparkSession, d: str) -> DataFrame:
    return dedup.first_ids(keyed(spark, d), "k", "doc_id", [F.col("doc_id")]).select(F.col("representative").alias("doc_id"), F.col("k").alias("dedup_key"))


@query(f"WITH {FIRST_SQL} SELECT doc_id AS duplicate, rep AS representative, k AS dedup_key, 'identical_key' AS reason FROM keyed JOIN firsts USING (k) WHERE doc_id <> rep")
def duplicate_mapping(spark: SparkSession, d: str) -> DataFrame:
    return dedup.duplicate_mapping(keyed(spark, d), "k", "doc_id", ["doc_id"])


@query("SELECT o_custkey, min(o_orderkey) AS first_order, arg_min(o_totalprice, o_orderkey) AS first_price FROM orders GROUP BY o_custkey")
def keep_first_by_key(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.min("o_orderkey").alias("first_order"), F.min_by("o_totalprice", "o_orderkey").alias("first_price"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey, l_suppkey) AS r FROM lineitem) WHERE r = 1""")
def best_row_per_key(spark: SparkSession, d: str) -> DataFrame:
    order = [F.desc("l_extendedprice"), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")]
    return dedup.best_row(table(spark, d, "lineitem"), ["l_orderkey"], order).select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")


@query(f"WITH {FIRST_SQL}, x AS (SELECT k.doc_id, text, rep FROM keyed k JOIN firsts USING (k) JOIN documents d ON d.doc_id = k.doc_id) SELECT count(*) AS n_raw, count(*) FILTER (coalesce(trim(text), '') = '') AS n_failed, count(*) FILTER (coalesce(trim(text), '') <> '' AND doc_id = rep) AS n_unique, count(*) FILTER (coalesce(trim(text), '') <> '' AND doc_id <> rep) AS n_duplicate FROM x")
def accounting_ledger(spark: SparkSession, d: str) -> DataFrame:
    """Rows of one text are all blank or all not, so counts of texts give every number and no row is joined."""
    rows = table(spark, d, "documents").filter("text is not null").select(F.md5("text").alias("k"), (F.trim("text") == "").alias("failed"))
    texts = rows.groupBy("k").agg(F.count("*").alias("n"), F.max("failed").alias("failed"))
    count = lambda value, where: F.coalesce(F.sum(F.when(where, value)), F.lit(0))
    good = ~F.col("failed")
    return texts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_raw"), count(F.col("n"), F.col("failed")).alias("n_failed"), F.count_if(good).alias("n_unique"), count(F.col("n") - 1, good).alias("n_duplicate"))


# Rules and hierarchy


@query(f"WITH {demo.DIRECT_SQL} SELECT p_partkey AS item_id, class_id FROM direct")
def rule_direct_classes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("item_id"), F.explode(demo.PARTS.direct()).alias("class_id"))


@query(f"WITH {demo.DIRECT_SQL} SELECT p_partkey AS item_id, coalesce(bool_or(class_id = '0700'), false) AS is_multiple FROM direct GROUP BY p_partkey")
def multifunctional_flag(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("item_id"), F.array_contains(demo.PARTS.direct(), demo.PARTS.multiple).alias("is_multiple"))


FACTS_SQL = f"""WITH RECURSIVE {demo.GRAPH_SQL}, {demo.DIRECT_SQL},
ranked AS (SELECT p_partkey, class_id, row_number() OVER (PARTITION BY p_partkey ORDER BY depth DESC, priority DESC, class_id DESC) AS r FROM direct JOIN best ON node = class_id JOIN nodes USING (class_id)),
facts AS (SELECT p_partkey AS item_id, class_id, 'direct' AS membership_type, 'rule_predicate' AS source, CASE WHEN r = 1 THEN 1 ELSE 0 END AS is_primary FROM ranked
  UNION ALL SELECT DISTINCT p_partkey, ancestor, 'inferred_assignment', 'ancestor_propagation', 0 FROM direct JOIN pairs ON node = class_id
  WHERE NOT EXISTS (SELECT 1 FROM direct x WHERE x.p_partkey = direct.p_partkey AND x.class_id = ancestor))"""


@query(f"{FACTS_SQL} SELECT * FROM facts")
def membership_all(spark: SparkSession, d: str) -> DataFrame:
    return rules.membership(table(spark, d, "part"), "p_partkey", demo.PARTS)


@query(f"{FACTS_SQL} SELECT class_id, membership_type, count(*) AS n FROM facts GROUP BY ALL")
def membership_counts(spark: SparkSession, d: str) -> DataFrame:
    return membership_all(spark, d).groupBy("class_id", "membership_type").agg(F.count("*").alias("n"))


@query(f"{FACTS_SQL} SELECT item_id, class_id FROM facts WHERE is_primary = 1")
def primary_class(spark: SparkSession, d: str) -> DataFrame:
    return membership_all(spark, d).filter("is_primary = 1").select("item_id", "class_id")


@query(f"""{FACTS_SQL}, named AS (SELECT node, string_agg(name, ' > ' ORDER BY i) AS taxonomy_path FROM (SELECT node, unnest(path) AS c, generate_subscripts(path, 1) AS i FROM best) JOIN nodes ON c = class_id GROUP BY node)
SELECT item_id, class_id AS primary_class, array_to_string(path, '/') AS node_path, taxonomy_path FROM facts JOIN best ON node = class_id JOIN named USING (node) WHERE is_primary = 1""")
def primary_path(spark: SparkSession, d: str) -> DataFrame:
    return rules.primary_paths(table(spark, d, "part"), "p_partkey", demo.PARTS).select("item_id", "primary_class", F.array_join("node_path", "/").alias("node_path"), "taxonomy_path")


@query(f"WITH RECURSIVE {demo.GRAPH_SQL} SELECT node, depth::int AS depth FROM best")
def class_depths(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.depths(demo_edges(spark))


@query(f"WITH RECURSIVE {demo.GRAPH_SQL} SELECT ancestor, node FROM pairs")
def ancestor_closure(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.closure(demo_edges(spark))


@query(f"WITH RECURSIVE {demo.GRAPH_SQL} SELECT child_id, arg_max(parent_id, {{d: depth, p: parent_id}}) AS parent_id FROM edges JOIN best ON node = parent_id GROUP BY child_id")
def tree_projection(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.tree_projection(demo_edges(spark))


@query(f"""WITH RECURSIVE {demo.GRAPH_SQL}, {demo.DIRECT_SQL},
specific AS (SELECT * FROM direct x WHERE NOT EXISTS (SELECT 1 FROM direct y JOIN pairs ON node = y.class_id WHERE y.p_partkey = x.p_partkey AND ancestor = x.class_id)),
n AS (SELECT p_partkey, count(*) AS n FROM specific GROUP BY p_partkey)
SELECT (SELECT count(*) FROM edges) - (SELECT count(DISTINCT child_id) FROM edges) AS edges_lost, (SELECT count(*) FROM (SELECT child_id FROM edges GROUP BY 1 HAVING count(*) > 1)) AS multi_parent,
  (SELECT count(*) FROM specific) AS meaningful, (SELECT sum(greatest(n - 1, 0))::bigint FROM n) AS hypothetical_loss""")
def dag_vs_tree_loss(spark: SparkSession, d: str) -> DataFrame:
    edges = demo_edges(spark)
    facts = rule_direct_classes(spark, d)
    per = hierarchy.maximally_specific(facts, hierarchy.closure(edges)).groupBy("item_id").agg(F.count("*").alias("n"))
    shape = edges.groupBy("child_id").agg(F.count("*").alias("k")).agg((F.sum("k") - F.count("*")).alias("edges_lost"), F.count_if(F.col("k") > 1).alias("multi_parent"))
    return shape.crossJoin(per.agg(F.sum("n").alias("meaningful"), F.sum(F.greatest(F.col("n") - 1, F.lit(0))).alias("hypothetical_loss")))


@query(f"""WITH RECURSIVE {demo.GRAPH_SQL} SELECT (SELECT count(*) FROM nodes) AS n_nodes, (SELECT count(*) FROM edges) AS n_edges, (SELECT count(*) FROM nodes WHERE class_id NOT IN (SELECT child_id FROM edges)) AS n_roots,
  (SELECT count(*) FROM nodes WHERE class_id NOT IN (SELECT parent_id FROM edges)) AS n_leaves, (SELECT count(*) FROM (SELECT child_id FROM edges GROUP BY 1 HAVING count(*) > 1)) AS n_multi_parent""")
def degree_stats(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.degree_stats(demo_edges(spark))


@query(f"WITH RECURSIVE {GEO_SQL} SELECT a AS node, count(*) AS n_descendants FROM walk, unnest(path) AS t(a) WHERE a <> node GROUP BY a")
def subtree_sizes(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.subtree_sizes(geography(spark, d))


@query(f"WITH RECURSIVE {GEO_SQL} SELECT len(path)::int - 1 AS depth, count(*) AS n FROM walk GROUP BY 1")
def level_histogram(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.depths(geography(spark, d)).groupBy("depth").agg(F.count("*").alias("n"))


@query(f"WITH RECURSIVE {GEO_SQL} SELECT median(len(path) - 1)::double AS median_depth, max(len(path))::int - 1 AS max_depth FROM walk")
def median_depth(spark: SparkSession, d: str) -> DataFrame:
    found = evaluate.exact_quantiles(hierarchy.depths(geography(spark, d)), "depth", {"median_depth": 0.5, "max_depth": 1.0})
    return found.select("median_depth", F.col("max_depth").cast("int").alias("max_depth"))


@query(f"WITH RECURSIVE {GEO_SQL} SELECT array_to_string(arg_max(path, {{n: len(path), p: path}}), '/') AS path FROM walk")
def deepest_path(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.primary_path(geography(spark, d)).agg(F.array_join(F.max(F.struct(F.size("path").alias("n"), "path"))["path"], "/").alias("path"))


@query(f"""WITH RECURSIVE {GEO_SQL}, levels AS (SELECT len(path) - 1 AS depth, count(*) AS n FROM walk GROUP BY 1), run AS (SELECT depth, sum(n) OVER (ORDER BY depth) AS r FROM levels),
cap AS (SELECT greatest(coalesce(max(depth) FILTER (r <= 50), 0), 1) AS cap FROM run), below AS (SELECT a, count(*) AS n FROM walk, unnest(path) AS t(a) WHERE a <> node GROUP BY a)
SELECT node, (len(path) - 1)::int AS depth, array_to_string(path, '/') AS path, CASE WHEN len(path) - 1 = cap THEN coalesce(n, 0) ELSE 0 END AS n_hidden FROM walk, cap LEFT JOIN below ON a = node WHERE len(path) - 1 <= cap""")
def capped_subtree(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.capped_subtree(geography(spark, d), "W")


@query(f"""WITH RECURSIVE {GEO_SQL} SELECT (SELECT count(DISTINCT parent_id) FROM geo WHERE parent_id NOT IN (SELECT child_id FROM geo)) AS n_roots, (SELECT count(*) FROM geo) AS n_edges,
(SELECT count(*) FROM walk) AS n_nodes, (SELECT count(*) FROM (SELECT child_id FROM geo GROUP BY 1 HAVING count(*) > 1)) AS n_multi_parent, (SELECT count(*) FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation)) AS n_dangling, (SELECT max(len(path))::int - 1 FROM walk) AS max_depth""")
def topology_audit(spark: SparkSession, d: str) -> DataFrame:
    geo = geography(spark, d)
    dangling = quality.orphans(table(spark, d, "customer"), "c_nationkey", table(spark, d, "nation"), "n_nationkey").agg(F.count("*").alias("n_dangling"))
    return hierarchy.degree_stats(geo).select("n_roots", "n_edges", "n_nodes", "n_multi_parent").crossJoin(dangling).crossJoin(hierarchy.depths(geo).agg(F.max("depth").alias("max_depth")))


def supply_graph(spark: SparkSession, d: str) -> DataFrame:
    """A graph with cycles: each customer's nation, and on from a nation to every second customer of the same three nations."""
    customer = table(spark, d, "customer").select(F.concat(F.lit("C"), F.col("c_custkey")).alias("parent_id"), F.concat(F.lit("N"), F.col("c_nationkey")).alias("child_id"))
    onward = table(spark, d, "customer").filter("c_custkey % 2 = 0 and c_nationkey > 3").select(F.concat(F.lit("N"), (F.col("c_nationkey") - F.col("c_nationkey") % 3 + F.col("c_custkey") % 3).cast("string")).alias("parent_id"), F.concat(F.lit("C"), F.col("c_custkey")).alias("child_id"))
    return customer.union(onward)


#: Reach is over nations alone, for every walk alternates between customers and nations.
SUPPLY_SQL = """g AS (SELECT 'C' || c_custkey AS p, 'N' || c_nationkey AS c FROM customer UNION SELECT 'N' || (c_nationkey - c_nationkey % 3 + c_custkey % 3), 'C' || c_custkey FROM customer WHERE c_custkey % 2 = 0 AND c_nationkey > 3),
hop AS (SELECT DISTINCT a.p AS a, b.c AS b FROM g a JOIN g b ON b.p = a.c WHERE a.p LIKE 'N%'),
reach(a, b) AS (SELECT a, b FROM hop UNION SELECT r.a, h.b FROM reach r JOIN hop h ON h.a = r.b)"""


@query(f"""WITH RECURSIVE {SUPPLY_SQL} SELECT a AS node FROM reach WHERE a = b UNION SELECT x.c FROM g x JOIN g y ON y.p = x.c LEFT JOIN reach r ON r.a = y.c AND r.b = x.p WHERE x.p LIKE 'N%' AND (y.c = x.p OR r.a IS NOT NULL)""")
def cycle_flags(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.cycle_nodes(supply_graph(spark, d))


@query(f"""WITH RECURSIVE g(p, c) AS (SELECT 'C' || c_custkey, 'N' || c_nationkey FROM customer UNION SELECT 'N' || (c_nationkey - c_nationkey % 3 + c_custkey % 3), 'C' || c_custkey FROM customer WHERE c_custkey % 2 = 0 AND c_nationkey > 3),
near AS (SELECT p AS a, c AS b FROM g UNION SELECT c, p FROM g), n2 AS (SELECT DISTINCT x.a, y.b FROM near x JOIN near y ON y.a = x.b WHERE x.a LIKE 'N%'),
walk(a, b) AS (SELECT a, b FROM n2 UNION SELECT w.a, n.b FROM walk w JOIN n2 n ON n.a = w.b), root AS (SELECT a, min(b) AS r FROM (SELECT a, b FROM walk UNION SELECT w.a, x.b FROM walk w JOIN near x ON x.a = w.b) GROUP BY a)
SELECT a AS node, r AS component FROM root UNION SELECT x.a, r FROM near x JOIN root ON root.a = x.b WHERE x.a LIKE 'C%'""")
def weak_components(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.weak_components(supply_graph(spark, d))


@query("""WITH x AS (SELECT p_partkey, p_type || '  ' || replace(p_name, ' ', '  ') AS description FROM part), y AS (SELECT p_partkey, list_filter(list_transform(string_split(description, '  '), lambda s: trim(s)), lambda s: s <> '') AS p FROM x)
SELECT p_partkey, p[1] AS l1, p[2] AS l2, p[3] AS l3, p[-1] AS leaf, array_to_string(p, ' > ') AS path FROM y""")
def lineage_levels(spark: SparkSession, d: str) -> DataFrame:
    described = table(spark, d, "part").select("p_partkey", F.concat("p_type", F.lit("\t"), F.replace("p_name", F.lit(" "), F.lit("  "))).alias("description"))
    return described.select("p_partkey", *hierarchy.path_levels("description"))


# Joins


@query("SELECT l_partkey, CASE WHEN count(DISTINCT l_suppkey) = 1 THEN min(l_suppkey) END AS supplier FROM lineitem GROUP BY l_partkey")
def unambiguous_mapping(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select("l_partkey", F.col("l_suppkey").alias("supplier"))
    return enrich.resolve(lines.select("l_partkey").distinct(), lines, ["l_partkey"], "supplier")


@query("SELECT l_partkey, l_shipdate::varchar AS shipped, CASE WHEN count(DISTINCT l_suppkey) = 1 THEN min(l_suppkey) END AS supplier FROM lineitem GROUP BY ALL")
def unambiguous_by_day(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select("l_partkey", F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss").alias("shipped"), F.col("l_suppkey").alias("supplier"))
    return enrich.resolve(lines.select("l_partkey", "shipped").distinct(), lines, ["l_partkey", "shipped"], "supplier")


@query("SELECT o_orderkey, coalesce(CASE WHEN c_acctbal > 0 THEN c_mktsegment END, o_orderpriority) AS segment FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def coalesce_dimension(spark: SparkSession, d: str) -> DataFrame:
    facts = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("k"), F.col("o_orderpriority").alias("segment"))
    dim = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")).alias("segment"))
    return enrich.prefer(facts, dim, ["k"], ["segment"]).select("o_orderkey", "segment")


@query("SELECT l_orderkey, l_linenumber, l_partkey, c_custkey, n_name FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey")
def four_way_path_join(spark: SparkSession, d: str) -> DataFrame:
    t = lambda n: table(spark, d, n)
    path = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"), "left")
    path = path.join(t("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"), "left").join(t("nation").select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return path.select("l_orderkey", "l_linenumber", "l_partkey", "c_custkey", "n_name")


@query("SELECT doc_id FROM documents WHERE NOT EXISTS (SELECT 1 FROM labels WHERE labels.doc_id = documents.doc_id)")
def not_yet_answered(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


@query("SELECT doc_id FROM documents WHERE EXISTS (SELECT 1 FROM labels WHERE labels.doc_id = documents.doc_id)")
def answered_semi(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi")


@query("SELECT c_custkey, o_orderkey FROM customer FULL JOIN (SELECT * FROM orders WHERE o_totalprice > 400000) ON c_custkey = o_custkey")
def full_outer_activity(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").filter("o_totalprice > 400000").select("o_orderkey", "o_custkey")
    return table(spark, d, "customer").select("c_custkey").join(orders, F.col("c_custkey") == F.col("o_custkey"), "full").select("c_custkey", "o_orderkey")


# Aggregates, windows, sets


@query("SELECT event_type, count(*) AS n FROM events GROUP BY ALL")
def value_counts_nulls(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT source, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, source LIMIT 8")
def top_sources(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source").limit(8)


@query("SELECT size, count(*) AS n FROM (SELECT l_orderkey, count(DISTINCT l_partkey) AS size FROM lineitem GROUP BY 1) GROUP BY size")
def set_size_histogram(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count_distinct("l_partkey").alias("size")).groupBy("size").agg(F.count("*").alias("n"))


@query("SELECT count(DISTINCT md5(text)) AS texts, count(DISTINCT source) AS sources, count(DISTINCT lang) AS langs FROM documents")
def distinct_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").agg(F.count_distinct(F.md5("text")).alias("texts"), F.count_distinct("source").alias("sources"), F.count_distinct("lang").alias("langs"))


@query("SELECT n_regionkey, string_agg(n_name, ';' ORDER BY n_name) AS nations FROM nation GROUP BY n_regionkey")
def ordered_list_agg(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list("n_name")), ";").alias("nations"))


@query("SELECT r_name, string_agg(n_name, ';' ORDER BY n_name) AS nations, count(*) AS n FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY r_name")
def family_listing(spark: SparkSession, d: str) -> DataFrame:
    joined = table(spark, d, "region").join(table(spark, d, "nation"), F.col("r_regionkey") == F.col("n_regionkey"))
    return joined.groupBy("r_name").agg(F.array_join(F.array_sort(F.collect_list("n_name")), ";").alias("nations"), F.count("*").alias("n"))


@query("SELECT round(min(p_retailprice), 6) AS least, round(median(p_retailprice), 6) AS mid, round(max(p_retailprice), 6) AS most FROM part")
def numeric_summary(spark: SparkSession, d: str) -> DataFrame:
    found = evaluate.exact_quantiles(table(spark, d, "part"), "p_retailprice", {"least": 0.0, "mid": 0.5, "most": 1.0})
    return found.select(*[F.round(c, 6).alias(c) for c in found.columns])


HIT_SQL = "hits AS (SELECT source, count(*) AS n, count(quality) AS k, avg(CASE WHEN quality IS NULL THEN NULL WHEN quality = 1 THEN 1.0 ELSE 0.0 END) AS p FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source)"


def hits(spark: SparkSession, d: str) -> DataFrame:
    joined = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return joined.groupBy("source").agg(F.count("*").alias("n"), F.count("quality").alias("k"), F.avg((F.col("quality") == 1).cast("double")).alias("p"))


@query(f"WITH {HIT_SQL} SELECT source, n, k, round(n * 1.0 / sum(n) OVER (), 6) AS share, round(p, 6) AS hit_rate FROM hits")
def stratified_hit_rate(spark: SparkSession, d: str) -> DataFrame:
    rows = stored(hits(spark, d))
    return rows.crossJoin(F.broadcast(rows.agg(F.sum("n").alias("total")))).select("source", "n", "k", F.round(F.col("n") / F.col("total"), 6).alias("share"), F.round("p", 6).alias("hit_rate"))


@query("""WITH x AS (SELECT source, count(*)::double AS n, count(*) FILTER (quality = 1)::double AS h FROM documents JOIN labels USING (doc_id) GROUP BY source), y AS (SELECT *, h / n AS p, 1.959964 AS z FROM x)
SELECT source, round((p + z*z/(2*n) - z*sqrt(p*(1-p)/n + z*z/(4*n*n))) / (1 + z*z/n), 6) AS low, round((p + z*z/(2*n) + z*sqrt(p*(1-p)/n + z*z/(4*n*n))) / (1 + z*z/n), 6) AS high FROM y""")
def wilson_interval(spark: SparkSession, d: str) -> DataFrame:
    joined = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels"), "doc_id")
    counts = joined.groupBy("source").agg(F.count("*").cast("double").alias("n"), F.count_if(F.col("quality") == 1).cast("double").alias("h"))
    low, high = evaluate.wilson(F.col("h"), F.col("n"))
    return counts.select("source", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query("SELECT count(*) AS n, count(*) FILTER (quality = 1) AS k, floor(count(*) FILTER (quality = 1) * 1956542 / count(*))::bigint AS extrapolated FROM labels")
def coverage_extrapolation(spark: SparkSession, d: str) -> DataFrame:
    k = F.count_if(F.col("quality") == 1)
    return table(spark, d, "labels").agg(F.count("*").alias("n"), k.alias("k"), F.floor(F.try_divide(k * 1956542, F.count("*"))).cast("bigint").alias("extrapolated"))


@query("SELECT min(n_run)::bigint AS least, max(n_run)::bigint AS most, count(*) AS n_islands FROM (SELECT user_id, island, count(*) FILTER (event_type = 'error') AS n_run FROM (SELECT *, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM events) GROUP BY ALL HAVING count(*) FILTER (event_type = 'error') > 0)")
def failure_runs(spark: SparkSession, d: str) -> DataFrame:
    runs = incremental.run_lengths(table(spark, d, "events"), "user_id", "event_id", F.col("event_type") == "error")
    return runs.agg(F.min("n").alias("least"), F.max("n").alias("most"), F.count("*").alias("n_islands"))


@query("SELECT date_trunc('hour', ts)::varchar AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def event_windows(spark: SparkSession, d: str) -> DataFrame:
    return incremental.windowed_counts(table(spark, d, "events")).select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n")


@query("SELECT count(*) AS n_left FROM (SELECT n_nationkey FROM nation EXCEPT ALL SELECT c_nationkey FROM (SELECT DISTINCT c_nationkey FROM customer))")
def set_equality_check(spark: SparkSession, d: str) -> DataFrame:
    diff = quality.difference(table(spark, d, "nation").select("n_nationkey"), table(spark, d, "customer").select(F.col("c_nationkey").alias("n_nationkey")).distinct())
    return diff.agg(F.count_if(F.col("side") == "left").alias("n_left"))


# Sampling, splits, similarity


@query("SELECT doc_id FROM documents ORDER BY md5('7:' || doc_id), doc_id LIMIT 100")
def seeded_sample(spark: SparkSession, d: str) -> DataFrame:
    return sampling.sample(table(spark, d, "documents"), "doc_id", 100, "7").select("doc_id")


@query("SELECT doc_id, lang, source FROM (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY sha256(concat_ws(':', 's', lang, source, doc_id)), doc_id) AS r FROM documents) WHERE r <= 5")
def stratified_capped_sample(spark: SparkSession, d: str) -> DataFrame:
    return sampling.stratified(table(spark, d, "documents").select("doc_id", "lang", "source"), ["lang", "source"], "doc_id", 5, "s").select("doc_id", "lang", "source")


@query("SELECT doc_id, ('0x' || substring(md5('q:' || doc_id), 1, 8))::bigint % 4 AS host FROM documents")
def queue_partition(spark: SparkSession, d: str) -> DataFrame:
    return sampling.queue(table(spark, d, "documents"), "doc_id", 4, "q")


SPLIT_SQL = """g AS (SELECT coalesce(source, '') AS source, count(*) AS n FROM documents GROUP BY 1), o AS (SELECT *, coalesce(sum(n) OVER (ORDER BY n DESC, md5('20260722' || source), source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, sum(n) OVER () AS t FROM g),
u AS (SELECT *, coalesce(sum(n) FILTER (b < floor(t * 0.15)) OVER (), 0) AS tested FROM o),
split AS (SELECT source, n, CASE WHEN b < floor(t * 0.15) THEN 'test' WHEN b - tested < floor(t * 0.15) THEN 'validation' ELSE 'train' END AS split FROM u)"""


@query(f"WITH {SPLIT_SQL} SELECT * FROM split")
def group_split(spark: SparkSession, d: str) -> DataFrame:
    return splits.group_split(table(spark, d, "documents"), "source")


@query(f"""WITH {SPLIT_SQL}, dealt AS (SELECT coalesce(d.source, '') AS g, s.split FROM documents d LEFT JOIN split s ON coalesce(d.source, '') = s.source)
SELECT split, count(*) AS n_rows, count(DISTINCT g) AS n_groups, (SELECT count(*) FROM (SELECT g FROM dealt GROUP BY g HAVING count(DISTINCT split) > 1)) AS n_leaking FROM dealt GROUP BY split""")
def split_leakage(spark: SparkSession, d: str) -> DataFrame:
    """Audited over the rows of documents; those that no split has show under a null one."""
    rows = table(spark, d, "documents").groupBy(F.coalesce("source", F.lit("")).alias("source")).agg(F.count("*").alias("rows"))
    dealt = rows.join(group_split(spark, d).select("source", "split"), "source", "left")
    leaking = splits.leakage(dealt, "source").agg(F.count("*").alias("n_leaking"))
    return dealt.groupBy("split").agg(F.sum("rows").alias("n_rows"), F.count_distinct("source").alias("n_groups")).crossJoin(leaking)


COSINE_SQL = """q AS (SELECT vec_id, embedding::double[] AS e FROM embeddings WHERE vec_id % 50 = 0), pairs AS (SELECT q.vec_id AS query_id, i.vec_id AS item_id,
  round(list_dot_product(q.e, i.embedding::double[]) / sqrt(list_dot_product(q.e, q.e)) / sqrt(list_dot_product(i.embedding::double[], i.embedding::double[])), 4) AS s FROM q, embeddings i WHERE i.vec_id <> q.vec_id)"""


@query(f"WITH {COSINE_SQL} SELECT query_id, max(s) AS similarity, CASE WHEN max(s) < 0.3 THEN '<0.3' WHEN max(s) < 0.5 THEN '0.3-0.5' WHEN max(s) < 0.7 THEN '0.5-0.7' ELSE '>=0.7' END AS bucket FROM pairs GROUP BY query_id")
def max_similarity_bucket(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    found = sampling.nearest(rows.filter("id % 50 = 0"), rows, but_itself=True).withColumn("similarity", F.round("similarity", 4))
    return found.select("query_id", "similarity", evaluate.bucket(F.col("similarity")).alias("bucket"))


@query()
def farthest_point_pick(spark: SparkSession, d: str) -> DataFrame:
    return sampling.farthest_points(table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), 10)


# Metrics


TRUTH_SQL = """x AS (SELECT doc_id, lang, source, n_chars, quality, CASE WHEN n_chars >= 300 AND text NOT LIKE '%|%' THEN 1 ELSE 0 END AS predicted FROM documents JOIN labels USING (doc_id))"""


def predictions(spark: SparkSession, d: str) -> DataFrame:
    joined = table(spark, d, "documents").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id")
    return joined.select("doc_id", "lang", "source", "quality", F.when((F.col("n_chars") >= 300) & ~F.contains("text", F.lit("|")), 1).otherwise(0).alias("predicted"))


@query(f"WITH {TRUTH_SQL} SELECT count(*) AS n, round(avg(CASE WHEN predicted = quality THEN 1.0 ELSE 0.0 END), 6) AS exact, round(avg(CASE WHEN predicted = 1 THEN CASE WHEN quality = 1 THEN 1.0 ELSE 0.0 END END), 6) AS precise FROM x")
def flat_metrics(spark: SparkSession, d: str) -> DataFrame:
    same = F.col("predicted") == F.col("quality")
    return predictions(spark, d).agg(F.count("*").alias("n"), evaluate.rate(same).alias("exact"), evaluate.rate(F.when(F.col("predicted") == 1, F.col("quality") == 1)).alias("precise"))


@query(f"WITH {TRUTH_SQL} SELECT lang, count(*) AS n, round(avg(CASE WHEN predicted = quality THEN 1.0 ELSE 0.0 END), 6) AS exact FROM x GROUP BY lang")
def per_group_metrics(spark: SparkSession, d: str) -> DataFrame:
    return predictions(spark, d).groupBy("lang").agg(F.count("*").alias("n"), evaluate.rate(F.col("predicted") == F.col("quality")).alias("exact"))


@query(f"WITH {TRUTH_SQL} SELECT predicted, quality AS truth, count(*) AS n FROM x GROUP BY ALL")
def confusion_matrix(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.confusion(predictions(spark, d), "predicted", "quality")


def tree_predictions(spark: SparkSession, d: str) -> DataFrame:
    """Truth: a part's type and name words; prediction: its name's first word, or its type where the price is low."""
    words = F.split("p_name", " ")
    predicted = F.when(F.col("p_retailprice") >= 950, words[0]).when(F.col("p_size") > 25, F.col("p_type"))
    return table(spark, d, "part").select(
        "p_partkey", predicted.alias("predicted"), F.array(F.lit("item"), F.lit("part"), F.col("p_type"), words[0]).alias("lineage"), F.array(words[0], words[1]).alias("candidates"),
        F.array(F.lit("item"), F.col("p_type"), F.when(F.col("p_size") > 10, words[0])).alias("levels"), words[0].alias("terminal"),
        F.when(F.col("p_size") % 3 != 0, F.col("p_type")).alias("truth_super"), F.when(F.col("p_size") % 2 == 0, words[1]).alias("truth_class"),
    )


FLAG_SQL = """y AS (SELECT p_partkey, p_type, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b, p_size, CASE WHEN p_retailprice >= 950 THEN split_part(p_name, ' ', 1) WHEN p_size > 25 THEN p_type END AS predicted FROM part),
f AS (SELECT *, coalesce(predicted IN ('item', p_type) OR (p_size > 10 AND predicted = a), false) AS on_path, coalesce(predicted = a, false) AS exact, p_size > 10 AS any_match, CASE WHEN p_size % 3 <> 0 THEN true END AS super_ok, CASE WHEN p_size % 2 = 0 THEN a = b END AS class_ok FROM y)"""
RATE_SQL = "count(*) AS n, round(avg(CASE WHEN predicted IS NOT NULL AND predicted <> '' THEN 1.0 ELSE 0.0 END), 6) AS coverage, " + ", ".join(f"round(avg({c}::int::double), 6) AS {c}" for c in evaluate.FLAGS)


@query(f"WITH {FLAG_SQL} SELECT {RATE_SQL} FROM f")
def hier_metrics(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.metrics(evaluate.hierarchical_flags(tree_predictions(spark, d)))


@query(f"WITH {FLAG_SQL}, m AS (SELECT {RATE_SQL} FROM f) SELECT metric, value, target, value >= target AS passed FROM m, (VALUES ('super_ok', m.super_ok, 0.9::double), ('class_ok', m.class_ok, 0.75::double), ('exact', m.exact, 0.6::double)) AS t(metric, value, target)")
def target_gate(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.gate(hier_metrics(spark, d), {"super_ok": 0.9, "class_ok": 0.75, "exact": 0.6})


@query("""WITH y AS (SELECT p_size, p_type, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b FROM part), z AS (SELECT list_distinct(['item', a, p_type]) AS p, list_distinct(['item', CASE WHEN p_size > 10 THEN a ELSE b END, p_type]) AS t FROM y),
s AS (SELECT sum(len(list_intersect(p, t)))::double AS both_, sum(len(p))::double AS np, sum(len(t))::double AS nt FROM z) SELECT round(both_ / np, 6) AS h_precision, round(both_ / nt, 6) AS h_recall, round(2 * (both_ / np) * (both_ / nt) / (both_ / np + both_ / nt), 6) AS h_f1 FROM s""")
def hierarchical_f1(spark: SparkSession, d: str) -> DataFrame:
    w = F.split("p_name", " ")
    rows = table(spark, d, "part").select(F.array_distinct(F.array(F.lit("item"), w[0], F.col("p_type"))).alias("p"), F.array_distinct(F.array(F.lit("item"), F.when(F.col("p_size") > 10, w[0]).otherwise(w[1]), F.col("p_type"))).alias("t"))
    return evaluate.hierarchical_f1(rows, "p", "t")


@query("SELECT t AS threshold, round(avg(CASE WHEN p_size / 50.0 >= t THEN 1.0 ELSE 0.0 END), 6) AS coverage, round(avg(CASE WHEN p_size / 50.0 >= t THEN (p_type = 'PROMO')::int::double END), 6) AS accuracy FROM part, (VALUES (0.25::double), (0.5::double), (0.75::double)) AS v(t) GROUP BY t")
def calibration_curve(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select((F.col("p_size") / 50.0).alias("c"), (F.col("p_type") == "PROMO").alias("ok"))
    return evaluate.calibration(rows, "c", "ok", [0.25, 0.5, 0.75])


@query(f"WITH {FLAG_SQL}, m AS (SELECT {RATE_SQL} FROM f) SELECT metric, expected, reproduced, round(reproduced - expected, 6) AS delta FROM m, (VALUES ('exact', 0.5::double, m.exact), ('on_path', 0.7::double, m.on_path)) AS t(metric, expected, reproduced)")
def reproduction_delta(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.deltas(hier_metrics(spark, d), {"exact": 0.5, "on_path": 0.7})


# Stored responses


STATUS = "CASE WHEN event_id % 11 = 0 THEN 404 WHEN event_id % 13 = 0 THEN 500 WHEN event_id % 17 = 0 THEN 429 WHEN event_id % 19 = 0 THEN 418 ELSE 200 END"
BODY = "CASE WHEN event_id % 5 = 0 THEN '{}' WHEN event_id % 7 = 0 THEN '<html>' WHEN event_type = 'purchase' THEN '{\"class\": {\"name\": \"x\"}}' WHEN event_type = 'view' THEN '{\"class\": null}' ELSE props END"


@query(f"""SELECT event_id, CASE WHEN s = 404 THEN 'MISS' WHEN s = 500 THEN 'SERVER5XX' WHEN s = 429 THEN 'THROTTLED' WHEN s <> 200 THEN 'HTTP' || s WHEN b IN ('', '{{}}', '[]', 'null') THEN 'EMPTY' WHEN NOT json_valid(b) THEN 'NONJSON'
  WHEN coalesce(json_extract_string(b, '$.class'), '') NOT IN ('', 'null') THEN 'HIT' ELSE 'NOLABEL' END AS outcome FROM (SELECT event_id, {STATUS} AS s, {BODY} AS b FROM events)""")
def outcome_classification(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("event_id", F.expr(STATUS).alias("s"), F.expr(BODY).alias("b"))
    return rows.select("event_id", incremental.outcome(F.col("s"), F.col("b")).alias("outcome"))


@query("SELECT event_id, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_fields(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k"))


# Integrity


FOREIGN_KEYS = (("nation", "n_regionkey", "region", "r_regionkey"), ("customer", "c_nationkey", "nation", "n_nationkey"), ("supplier", "s_nationkey", "nation", "n_nationkey"), ("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"), ("labels", "doc_id", "documents", "doc_id"))


@query(" UNION ALL ".join(f"SELECT '{c}.{k}' AS \"check\", count(*) AS n_bad FROM {c} WHERE {k} IS NOT NULL AND {k} NOT IN (SELECT {pk} FROM {p})" for c, k, p, pk in FOREIGN_KEYS))
def referential_integrity(spark: SparkSession, d: str) -> DataFrame:
    rows = []
    for child in dict.fromkeys(c for c, *_ in FOREIGN_KEYS):
        own = {k: (table(spark, d, p), pk) for c, k, p, pk in FOREIGN_KEYS if c == child}
        counts = quality.orphan_counts(table(spark, d, child), own)
        rows.append(counts.select(F.explode(F.array(*[F.struct(F.lit(f"{child}.{k}").alias("check"), F.col(k).alias("n_bad")) for k in own])).alias("r")).select("r.*"))
    return reduce(DataFrame.unionByName, rows)


@query("""SELECT * FROM (SELECT 'documents_key' AS "check", 'error' AS severity, count(*) AS n_bad FROM (SELECT doc_id FROM documents GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'labels_domain', 'error', count(*) FROM labels WHERE quality NOT IN (0, 1) UNION ALL SELECT 'labels_orphans', 'error', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)
UNION ALL SELECT 'short_texts', 'warning', count(*) FROM documents WHERE n_chars < 100)""")
def validation_report(spark: SparkSession, d: str) -> DataFrame:
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    checks = quality.Checks(spark).add("documents_key", quality.duplicate_keys(docs, ["doc_id"])).none_where("labels_domain", labels, ~F.col("quality").isin(0, 1))
    return checks.add("labels_orphans", quality.orphans(labels, "doc_id", docs, "doc_id")).none_where("short_texts", docs, "n_chars < 100", "warning").report()


@query(f"""WITH r AS ({ORACLES["validation_report"]}) SELECT CASE WHEN count(*) FILTER (n_bad > 0 AND severity = 'error') > 0 THEN 'FAIL' ELSE 'PASS' END AS status, coalesce(string_agg("check", ',' ORDER BY "check") FILTER (n_bad > 0 AND severity = 'error'), '') AS errors,
  coalesce(string_agg("check", ',' ORDER BY "check") FILTER (n_bad > 0 AND severity = 'warning'), '') AS warnings, count(*) AS n_checks FROM r""")
def validation_verdict(spark: SparkSession, d: str) -> DataFrame:
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    checks = quality.Checks(spark).add("documents_key", quality.duplicate_keys(docs, ["doc_id"])).none_where("labels_domain", labels, ~F.col("quality").isin(0, 1))
    verdict = checks.add("labels_orphans", quality.orphans(labels, "doc_id", docs, "doc_id")).none_where("short_texts", docs, "n_chars < 100", "warning").verdict()
    return verdict.select("status", F.array_join("errors", ",").alias("errors"), F.array_join("warnings", ",").alias("warnings"), "n_checks")


@query(f"""{FACTS_SQL}, steps AS (SELECT path[i] AS p, path[i + 1] AS c FROM facts JOIN best ON node = class_id, unnest(range(1, len(path))) AS t(i) WHERE is_primary = 1)
SELECT count(*) AS n_gaps FROM steps WHERE NOT EXISTS (SELECT 1 FROM edges WHERE parent_id = p AND child_id = c)""")
def path_edge_containment(spark: SparkSession, d: str) -> DataFrame:
    return quality.path_gaps(rules.primary_paths(table(spark, d, "part"), "p_partkey", demo.PARTS), demo_edges(spark)).agg(F.count("*").alias("n_gaps"))


@query(f"""{FACTS_SQL}, per AS (SELECT item_id, sum(is_primary) AS k, sum(is_primary) FILTER (membership_type = 'inferred_assignment') AS wrong FROM facts GROUP BY item_id)
SELECT count(*) AS n_items, count(*) FILTER (k <> 1 OR coalesce(wrong, 0) > 0) AS n_bad FROM per""")
def primary_uniqueness(spark: SparkSession, d: str) -> DataFrame:
    per = membership_all(spark, d).groupBy("item_id").agg(F.sum("is_primary").alias("k"), F.sum(F.when(F.col("membership_type") == "inferred_assignment", F.col("is_primary")).otherwise(0)).alias("wrong"))
    return per.agg(F.count("*").alias("n_items"), F.count_if((F.col("k") != 1) | (F.col("wrong") > 0)).alias("n_bad"))


@query("""SELECT count(*) AS n_rows, coalesce(sum(('0x' || substring(md5(concat_ws(chr(31), coalesce(doc_id::varchar, chr(0)), coalesce(lang, chr(0)), coalesce(source, chr(0)), coalesce(n_chars::varchar, chr(0)))), 1, 8))::bigint), 0)::bigint AS digest FROM documents""")
def table_digest(spark: SparkSession, d: str) -> DataFrame:
    return quality.table_digest(table(spark, d, "documents"), ["doc_id", "lang", "source", "n_chars"])


@query("SELECT count(*) AS n_rows, count(doc_id) - count(DISTINCT doc_id) AS n_duplicate_ids, count(*) FILTER (doc_id IS NULL) AS n_blank_ids, count(*) FILTER (text IS NULL OR trim(text) = '') AS n_blank_texts FROM documents")
def preflight_plan(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").agg(F.count("*").alias("n_rows"), (F.count("doc_id") - F.count_distinct("doc_id")).alias("n_duplicate_ids"), F.count_if(F.col("doc_id").isNull()).alias("n_blank_ids"), F.count_if(F.col("text").isNull() | (F.trim("text") == "")).alias("n_blank_texts"))


# Inline sources and kernels


def term_text(spark: SparkSession, d: str) -> DataFrame:
    """Regions, nations and suppliers as OBO stanzas, a row a table's part; every seventh supplier is obsolete and its second parent is its region's first nation."""
    line = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts], F.lit("\n"))
    stanza = lambda node, name, *rest: F.concat(F.lit("[Term]\n"), line("id: ", node), line("name: ", name), *rest)
    of = lambda mark, c: F.concat(F.lit(mark), F.col(c))
    region = table(spark, d, "region").select(stanza(of("R:", "r_regionkey"), F.col("r_name")).alias("value"))
    nation = table(spark, d, "nation").select(stanza(of("N:", "n_nationkey"), F.col("n_name"), line('def: "nation ', F.col("n_nationkey"), '" []'), line("is_a: ", of("R:", "n_regionkey"), " ! region")).alias("value"))
    extra = F.when(F.col("s_suppkey") % 7 == 0, F.concat(line("is_a: ", of("N:", "other")), F.lit("is_obsolete: true\n"))).otherwise("")
    supplier = table(spark, d, "supplier").withColumn("other", F.col("s_nationkey") % 5).select(stanza(of("S:", "s_suppkey"), F.col("s_name"), line("is_a: ", of("N:", "s_nationkey"), " ! nation"), extra).alias("value"))
    kind = spark.createDataFrame([("format-version: 1.2\n\n[Typedef]\nid: part_of\nname: not a term\n\n[Term]\nid: X:1\nname: dangling\nis_a: X:99 ! missing\n",)], "value string")
    return region.union(nation).union(supplier).union(kind)


TERM_SQL = """t AS (SELECT 'R:' || r_regionkey AS id, r_name AS name, '' AS definition, '' AS parents, false AS obsolete FROM region UNION ALL SELECT 'N:' || n_nationkey, n_name, 'nation ' || n_nationkey, 'R:' || n_regionkey, false FROM nation
UNION ALL SELECT 'S:' || s_suppkey, s_name, '', 'N:' || s_nationkey || CASE WHEN s_suppkey % 7 = 0 THEN ';N:' || s_nationkey % 5 ELSE '' END, s_suppkey % 7 = 0 FROM supplier UNION ALL SELECT 'X:1', 'dangling', '', 'X:99', false)"""


@query(f"WITH {TERM_SQL} SELECT * FROM t")
def obo_parse(spark: SparkSession, d: str) -> DataFrame:
    return readers.obo_terms(term_text(spark, d)).withColumn("parents", F.array_join("parents", ";"))


@query(f"""WITH RECURSIVE {TERM_SQL}, up(node, cur, path) AS (SELECT id, id, id FROM t UNION ALL SELECT up.node, p.id, up.path || '/' || p.id FROM up JOIN t ON t.id = up.cur JOIN t p ON p.id = split_part(t.parents, ';', 1))
SELECT node, arg_max(path, len(path)) AS lineage FROM up GROUP BY node""")
def obo_lineage(spark: SparkSession, d: str) -> DataFrame:
    terms = readers.obo_terms(term_text(spark, d))
    return hierarchy.first_parent_lineage(terms.select(F.col("id").alias("node"), "parents")).withColumn("lineage", F.array_join("lineage", "/"))


#: Structures that parts stand for, two of them unreadable and one empty; a part's number also gives it a chain in front.
MOLECULES = ("OB(O)c1ccccc1", "CC1(C)OB(c2ccccc2)OC1(C)C", "CCO", "OCC", "Nc1ncccc1F", "CC(=O)O", "CC[NH3+].[Cl-]", "CCN", "NN", "not_a_smiles", "", "C1CC")


def molecules(spark: SparkSession, d: str) -> DataFrame:
    """(line_no, supplied) of every part."""
    chain = F.repeat(F.lit("C"), (F.col("p_partkey") / 12).cast("int") % 6)
    return table(spark, d, "part").select(F.col("p_partkey").alias("line_no"), F.concat(chain, F.get(F.lit(list(MOLECULES)), (F.col("p_partkey") % 12).cast("int"))).alias("supplied"))


@query()
def molecule_standardise(spark: SparkSession, d: str) -> DataFrame:
    return standardize.standardised(molecules(spark, d), "supplied").select("line_no", "supplied", "std.canonical", "std.molecular_formula", "std.dedup_key", F.array_join("std.classes", ";").alias("classes"), "err.stage", "err.reason")


@query()
def molecule_membership(spark: SparkSession, d: str) -> DataFrame:
    good = standardize.standardised(molecules(spark, d), "supplied").filter("std is not null")
    return rules.membership(good, "line_no", molecule_classes.MOLECULES, F.col("std.classes"))


@query()
def molecule_paths(spark: SparkSession, d: str) -> DataFrame:
    good = standardize.standardised(molecules(spark, d), "supplied").filter("std is not null")
    return rules.primary_paths(good, "line_no", molecule_classes.MOLECULES, F.col("std.classes"))


@query()
def molecule_nearest(spark: SparkSession, d: str) -> DataFrame:
    """For every part whose number is divisible by 50 the most similar structure, by Tanimoto, of another part."""
    rows = standardize.with_fingerprint(standardize.with_scaffold(molecules(spark, d), "supplied"), "supplied").select(F.col("line_no").alias("id"), "scaffold", F.col("fingerprint").alias("vector"))
    rows = stored(rows)
    found = sampling.nearest(rows.filter("id % 50 = 0"), rows, but_itself=True, bits=2048)
    return rows.select("id", "scaffold").join(found.withColumnRenamed("query_id", "id"), "id").select("id", "scaffold", "similarity").withColumn("bucket", evaluate.bucket(F.col("similarity")))


from . import acquisition, evaluation, tables  # noqa: E402, F401  register their queries
