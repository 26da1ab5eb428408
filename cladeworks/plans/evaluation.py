"""Registered queries: assembling what an evaluation is held against, strata, snapshots, comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import enrich, evaluate, hierarchy, quality, sampling, splits
from ..sources import readers
from ..storage import stored
from ..streaming import incremental
from . import demo_rules as demo
from .catalogue import COSINE_SQL, FACTS_SQL, FLAG_SQL, GEO_SQL, demo_edges, geography, membership_all, query, rule_direct_classes, table, tree_predictions

#: Classes that say nothing about an item.
BOOKKEEPING = ("0700", "0800")


@query(f"WITH {demo.DIRECT_SQL} SELECT p_partkey AS item_id, class_id FROM direct WHERE class_id NOT IN ('0700', '0800')")
def without_generic_classes(spark: SparkSession, d: str) -> DataFrame:
    return enrich.without(rule_direct_classes(spark, d), "class_id", list(BOOKKEEPING))


@query("""WITH x AS (SELECT o_orderkey, list(DISTINCT l_suppkey) AS ids FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1)
SELECT o_orderkey, len(ids) AS n_ids, coalesce((SELECT string_agg(i::varchar, ';' ORDER BY i) FROM unnest(ids) AS t(i) WHERE i NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal >= 0)), '') AS unknown FROM x""")
def unknown_supplier_flags(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_set("l_suppkey").alias("ids"))
    known = table(spark, d, "supplier").filter("s_acctbal >= 0").select(F.col("s_suppkey").alias("id"))
    found = enrich.flag_unknown(rows, "o_orderkey", "ids", known, "id")
    return found.select("o_orderkey", F.size("ids").cast("bigint").alias("n_ids"), F.array_join("unknown_ids", ";").alias("unknown"))


@query("""WITH r AS (SELECT text, min(doc_id) AS rep FROM documents WHERE text IS NOT NULL GROUP BY text), a AS (SELECT rep, quality FROM r JOIN labels ON doc_id = rep)
SELECT doc_id, rep, quality FROM documents LEFT JOIN r USING (text) LEFT JOIN a USING (rep)""")
def labels_of_representatives(spark: SparkSession, d: str) -> DataFrame:
    """Every document with the label of the first document of its text."""
    docs = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("k"))
    first = stored(docs.filter("k is not null").groupBy("k").agg(F.min("doc_id").alias("rep")))
    records = docs.join(first, "k", "left").select("doc_id", "rep")
    labels = table(spark, d, "labels").select(F.col("doc_id").alias("rep"), "quality")
    return enrich.back_propagate(records, labels, "rep", ["quality"]).select("doc_id", "rep", "quality")


@query("""WITH s AS (SELECT l_orderkey, arg_min(l_partkey, {d: l_shipdate, n: l_linenumber, p: l_partkey}) AS part FROM lineitem WHERE l_quantity > 10 GROUP BY 1)
SELECT o_orderkey, coalesce(part, -1) AS part FROM orders LEFT JOIN s ON l_orderkey = o_orderkey""")
def one_structure_or_fallback(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").filter("l_quantity > 10").select(F.col("l_orderkey").alias("o_orderkey"), F.struct("l_shipdate", "l_linenumber", "l_partkey").alias("at"), F.col("l_partkey").alias("part"))
    picked = enrich.one_structure(lines, "o_orderkey", "at").select("o_orderkey", "part")
    return table(spark, d, "orders").select("o_orderkey").join(picked, "o_orderkey", "left").select("o_orderkey", F.coalesce("part", F.lit(-1)).alias("part"))


@query("SELECT c_custkey, s_suppkey FROM customer LEFT JOIN supplier ON c_nationkey = s_nationkey AND s_acctbal > 5000")
def identity_enrichment(spark: SparkSession, d: str) -> DataFrame:
    """Every customer with all rich suppliers of its nation: a join of many to many, whose rows grow with both sides."""
    right = table(spark, d, "supplier").filter("s_acctbal > 5000").select(F.col("s_nationkey").alias("k"), "s_suppkey")
    return enrich.all_matches(table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("k")), right, ["k"]).select("c_custkey", "s_suppkey")


@query("SELECT doc_id, coalesce(CASE WHEN quality IS NOT NULL THEN quality END, CASE WHEN n_chars < 100 THEN 0 END, CASE WHEN source IS NOT NULL AND n_chars > 1000 THEN 1 END) AS verdict, CASE WHEN quality IS NOT NULL THEN 'label' WHEN n_chars < 100 THEN 'length' WHEN source IS NOT NULL AND n_chars > 1000 THEN 'source' ELSE 'none' END AS tier FROM documents LEFT JOIN labels USING (doc_id)")
def evidence_tiers(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", "n_chars", "source").join(table(spark, d, "labels").select("doc_id", F.col("quality").cast("int").alias("quality")), "doc_id", "left")
    value, tier = enrich.first_tier({"label": F.col("quality"), "length": F.when(F.col("n_chars") < 100, 0), "source": F.when(F.col("source").isNotNull() & (F.col("n_chars") > 1000), 1)})
    return rows.select("doc_id", value.alias("verdict"), tier.alias("tier"))


NOVEL_SQL = f"""{COSINE_SQL}, near AS (SELECT query_id, max(s) AS m FROM pairs GROUP BY query_id),
strata AS (SELECT query_id, CASE WHEN m < 0.3 THEN '<0.3' WHEN m < 0.5 THEN '0.3-0.5' WHEN m < 0.7 THEN '0.5-0.7' ELSE '>=0.7' END AS bucket FROM near),
{FLAG_SQL}"""
RATES_SQL = "count(*) AS n, round(avg(CASE WHEN predicted IS NOT NULL AND predicted <> '' THEN 1.0 ELSE 0.0 END), 6) AS coverage, " + ", ".join(f"round(avg({c}::int::double), 6) AS {c}" for c in evaluate.FLAGS)


@query(f"WITH {NOVEL_SQL} SELECT bucket, {RATES_SQL} FROM strata JOIN f ON p_partkey = query_id GROUP BY bucket")
def metrics_by_novelty(spark: SparkSession, d: str) -> DataFrame:
    """Hierarchical metrics of parts, by how near the embedding of the same number is to any other."""
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    near = sampling.nearest(rows.filter("id % 50 = 0"), rows, but_itself=True)
    strata = near.select(F.col("query_id").alias("p_partkey"), evaluate.bucket(F.round("similarity", 4)).alias("bucket"))
    return evaluate.metrics(evaluate.hierarchical_flags(tree_predictions(spark, d)).join(strata, "p_partkey"), ["bucket"])


@query(f"WITH {FLAG_SQL}, n AS (SELECT predicted, count(*) AS k FROM f GROUP BY predicted), b AS (SELECT f.*, CASE WHEN k < 10 THEN '<10' WHEN k < 100 THEN '10-99' WHEN k < 1000 THEN '100-999' ELSE '>=1000' END AS band FROM f JOIN n ON f.predicted IS NOT DISTINCT FROM n.predicted) SELECT band, {RATES_SQL} FROM b GROUP BY band")
def metrics_by_frequency(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.metrics(evaluate.frequency_bands(evaluate.hierarchical_flags(tree_predictions(spark, d)), "predicted"), ["band"])


@query("""WITH x AS (SELECT split_part(p_name, ' ', 1) AS a, p_type AS b, split_part(p_name, ' ', 2) AS c, CASE WHEN p_size % 3 = 0 THEN p_type WHEN p_size % 3 = 1 THEN split_part(p_name, ' ', 2) ELSE 'red' END AS t FROM part)
SELECT round(avg((t = a)::int::double), 6) AS top_1, round(avg((t IN (a, b))::int::double), 6) AS top_2, round(avg((t IN (a, b, c))::int::double), 6) AS top_3 FROM x""")
def top_k_accuracy(spark: SparkSession, d: str) -> DataFrame:
    words = F.split("p_name", " ")
    truth = F.when(F.col("p_size") % 3 == 0, F.col("p_type")).when(F.col("p_size") % 3 == 1, words[1]).otherwise("red")
    rows = table(spark, d, "part").select(F.array(words[0], F.col("p_type"), words[1]).alias("candidates"), truth.alias("truth"))
    return evaluate.top_k(rows, "candidates", "truth", (1, 2, 3))


@query("""WITH x AS (SELECT source, count(*)::double AS n, count(*) FILTER (quality = 1)::double AS h FROM documents JOIN labels USING (doc_id) GROUP BY source)
SELECT source, round(h / n * 18000, 6) AS expected, CASE WHEN h > 0 THEN ceil(round(1500 / (h / n), 6))::bigint END AS lookups, round(1500 / 18000, 6) AS threshold FROM x""")
def lookups_needed(spark: SparkSession, d: str) -> DataFrame:
    joined = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels"), "doc_id")
    counts = joined.groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("quality") == 1).alias("h"))
    return counts.select("source", *[c.alias(n) for n, c in evaluate.required_lookups(F.col("h"), F.col("n"), 18000, 1500).items()])


@query("""WITH x AS (SELECT coalesce(l.doc_id IS NOT NULL, false) AS f, n_chars::double AS v FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) WHERE n_chars IS NOT NULL),
c AS (SELECT v, count(*) FILTER (f) AS k, count(*) FILTER (NOT f) AS o FROM x GROUP BY v), r AS (SELECT sum(k) OVER (ORDER BY v) / sum(k) OVER () AS p, sum(o) OVER (ORDER BY v) / sum(o) OVER () AS q FROM c)
SELECT count(*) FILTER (f) AS n_in, round(avg(v) FILTER (f), 4) AS mean_in, round(stddev_samp(v) FILTER (f), 4) AS deviation_in, count(*) FILTER (NOT f) AS n_out, round(avg(v) FILTER (NOT f), 4) AS mean_out, round(stddev_samp(v) FILTER (NOT f), 4) AS deviation_out,
  (SELECT round(max(abs(p - q)), 6) FROM r) AS ks FROM x""")
def labelled_against_unlabelled(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "n_chars").join(table(spark, d, "labels").select("doc_id", F.lit(True).alias("f")).distinct(), "doc_id", "left")
    return evaluate.compare_groups(docs, "f", "n_chars")


@query("""SELECT count(*) AS n_rows, count(DISTINCT lang) AS n_lang, count(DISTINCT source) AS n_source,
  (SELECT string_agg(v || '=' || n, ' ' ORDER BY n DESC, v) FROM (SELECT coalesce(lang, '-') AS v, count(*) AS n FROM documents GROUP BY 1)) AS distribution FROM documents""")
def coverage_snapshot(spark: SparkSession, d: str) -> DataFrame:
    return quality.coverage_snapshot(table(spark, d, "documents"), ["lang", "source"], "lang")


@query("""SELECT n_rows, n_duplicate_ids, n_blank_texts, false AS scan_was_bounded, CASE WHEN n_duplicate_ids > 0 THEN 'duplicate_ids' ELSE '' END AS critical, 'facts;edges' AS outputs, (n_duplicate_ids > 0)::int AS exit_status
FROM (SELECT count(*) AS n_rows, count(l_orderkey) - count(DISTINCT l_orderkey) AS n_duplicate_ids, count(*) FILTER (trim(l_returnflag) = '') AS n_blank_texts FROM lineitem)""")
def preflight_exit(spark: SparkSession, d: str) -> DataFrame:
    """Lines keyed by order alone: the critical list names the repeated ids."""
    found = quality.preflight(table(spark, d, "lineitem"), "l_orderkey", "l_returnflag", ["facts", "edges"])
    return found.select("n_rows", "n_duplicate_ids", "n_blank_texts", "scan_was_bounded", F.array_join("critical", ";").alias("critical"), F.array_join("outputs", ";").alias("outputs"), "exit_status")


@query("SELECT l_suppkey, count(*) AS n FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) GROUP BY l_suppkey")
def distinct_pairs_counted(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_partkey", "l_suppkey").dropDuplicates(["l_partkey", "l_suppkey"]).groupBy("l_suppkey").agg(F.count("*").alias("n"))


@query(f"WITH {demo.DIRECT_SQL} SELECT p_partkey AS item_id, string_agg(DISTINCT class_id, ';' ORDER BY class_id) AS classes FROM direct GROUP BY p_partkey")
def class_sets(spark: SparkSession, d: str) -> DataFrame:
    return rule_direct_classes(spark, d).groupBy("item_id").agg(F.array_join(F.array_sort(F.collect_set("class_id")), ";").alias("classes"))


@query("SELECT doc_id, coalesce(regexp_full_match(source, '[a-z0-9_-]+'), false) AS valid FROM documents")
def valid_prefixes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.coalesce(F.col("source").rlike(r"\A[a-z0-9_-]+\z"), F.lit(False)).alias("valid"))


@query("SELECT doc_id, n_chars FROM documents WHERE n_chars < 100 OR text IS NULL ORDER BY doc_id LIMIT 10")
def first_invalid_examples(spark: SparkSession, d: str) -> DataFrame:
    return sampling.first_examples(table(spark, d, "documents").select("doc_id", "n_chars", F.col("text").isNull().alias("none")), (F.col("n_chars") < 100) | F.col("none"), ["doc_id"]).select("doc_id", "n_chars")


@query("SELECT doc_id, ord FROM (SELECT doc_id, row_number() OVER (ORDER BY md5('q:' || doc_id), doc_id) - 1 AS ord FROM documents) WHERE ord % 4 = 1 ORDER BY ord LIMIT 300")
def ordered_queue(spark: SparkSession, d: str) -> DataFrame:
    return sampling.ordered_queue(table(spark, d, "documents"), "doc_id", 4, 1, "q", 300)


@query(f"WITH RECURSIVE {GEO_SQL} SELECT array_to_string(arg_max(p, {{n: len(p), p: p}}), '/') AS path FROM (SELECT path[2:] AS p FROM walk WHERE len(path) > 1 AND path[2] = 'R1')")
def deepest_path_from(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.deepest_path(geography(spark, d), "R1").select(F.array_join("path", "/").alias("path"))


@query("""WITH e AS (SELECT 'R' || n_regionkey AS p, 'N' || n_nationkey AS c FROM nation), o AS (SELECT 'R' || (n_regionkey + n_nationkey % 2) AS p, 'N' || n_nationkey AS c FROM nation)
SELECT (SELECT count(*) FROM (FROM e EXCEPT FROM o)) AS edges_left, (SELECT count(*) FROM (FROM o EXCEPT FROM e)) AS edges_right, (SELECT count(*) FROM (FROM e INTERSECT FROM o)) AS edges_both,
  (SELECT count(*) FROM (SELECT p FROM e UNION SELECT c FROM e EXCEPT (SELECT p FROM o UNION SELECT c FROM o))) AS nodes_left, (SELECT count(*) FROM (SELECT p FROM o UNION SELECT c FROM o EXCEPT (SELECT p FROM e UNION SELECT c FROM e))) AS nodes_right,
  NOT EXISTS ((FROM e EXCEPT FROM o) UNION ALL (FROM o EXCEPT FROM e)) AS agrees""")
def topology_comparison(spark: SparkSession, d: str) -> DataFrame:
    """Nations under their regions against a second source that puts odd ones elsewhere."""
    nation = table(spark, d, "nation")
    edges = lambda region: nation.select(F.concat(F.lit("R"), region).alias("parent_id"), F.concat(F.lit("N"), F.col("n_nationkey")).alias("child_id"))
    return quality.edge_comparison(edges(F.col("n_regionkey")), edges(F.col("n_regionkey") + F.col("n_nationkey") % 2))


@query("SELECT count(*) AS n_pairs, count(*) FILTER (c_name <> 'Customer#' || lpad(c_custkey::varchar, 9, '0')) AS n_mismatches FROM customer")
def name_crosscheck(spark: SparkSession, d: str) -> DataFrame:
    customer = table(spark, d, "customer")
    built = customer.select("c_custkey", F.concat(F.lit("Customer#"), F.lpad(F.col("c_custkey").cast("string"), 9, "0")).alias("c_name"))
    return quality.name_crosscheck(customer, built, "c_custkey", "c_name")


@query("""WITH t AS (SELECT 'R' || r_regionkey AS node, r_name AS name, NULL::varchar AS up FROM region UNION ALL SELECT 'N' || n_nationkey, n_name, 'R' || n_regionkey FROM nation UNION ALL SELECT 'S' || s_suppkey, s_name, 'N' || s_nationkey FROM supplier),
names AS (SELECT s_name AS name FROM supplier UNION SELECT 'nobody'), firsts AS (SELECT name, min(node) AS node FROM t GROUP BY name)
SELECT n.name, f.node, CASE WHEN f.node IS NOT NULL THEN concat_ws('/', c.node, b.node, a.node) END AS ids, CASE WHEN f.node IS NOT NULL THEN concat_ws('/', c.name, b.name, a.name) END AS labels, CASE WHEN c.node IS NOT NULL THEN a.node END AS superclass
FROM names n LEFT JOIN firsts f USING (name) LEFT JOIN t a ON a.node = f.node LEFT JOIN t b ON b.node = a.up LEFT JOIN t c ON c.node = b.up""")
def lineage_by_name(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers' names, and one that nobody has, with the way from their region."""
    none = F.expr("cast(array() as array<string>)")
    part = lambda t, k, mark, name, up: table(spark, d, t).select(F.concat(F.lit(mark), F.col(k)).alias("node"), F.col(name).alias("name"), up.alias("parents"))
    terms = part("region", "r_regionkey", "R", "r_name", none).union(part("nation", "n_nationkey", "N", "n_name", F.array(F.concat(F.lit("R"), F.col("n_regionkey"))))).union(part("supplier", "s_suppkey", "S", "s_name", F.array(F.concat(F.lit("N"), F.col("s_nationkey")))))
    names = table(spark, d, "supplier").select(F.col("s_name").alias("name")).union(spark.createDataFrame([("nobody",)], "name string")).distinct()
    found = hierarchy.lineage_of_names(names, terms)
    return found.select("name", "node", F.array_join("ids", "/").alias("ids"), F.array_join("labels", "/").alias("labels"), "superclass")


@query(f"WITH RECURSIVE {demo.GRAPH_SQL} SELECT 'is_a' AS relation, count(*) AS n, (SELECT count(*) FROM pairs) AS n_closure FROM edges UNION ALL SELECT 'same_size', count(*), NULL FROM (SELECT DISTINCT p_size FROM part)")
def typed_relations(spark: SparkSession, d: str) -> DataFrame:
    """Only is_a edges are closed; the other relation is counted beside them."""
    is_a = demo_edges(spark).select("parent_id", "child_id", F.lit("is_a").alias("relation_type"))
    other = table(spark, d, "part").select(F.col("p_size").cast("string").alias("parent_id")).distinct().select("parent_id", F.col("parent_id").alias("child_id"), F.lit("same_size").alias("relation_type"))
    own, rest = hierarchy.typed_edges(is_a.unionByName(other))
    closed = hierarchy.closure(own).agg(F.count("*").alias("n_closure"))
    counts = own.agg(F.count("*").alias("n")).select(F.lit("is_a").alias("relation"), "n").crossJoin(closed)
    return counts.unionByName(rest.groupBy(F.col("relation_type").alias("relation")).agg(F.count("*").alias("n")).withColumn("n_closure", F.lit(None).cast("bigint")))


ANSWERS_SQL = "cache AS (SELECT user_id AS k, max(CASE event_type WHEN 'purchase' THEN 'HIT' WHEN 'error' THEN 'MISS' ELSE 'THROTTLED' END) AS outcome FROM events WHERE event_id % 3 = 0 GROUP BY user_id, event_type)"


@query(f"WITH {ANSWERS_SQL}, n AS (SELECT (SELECT count(DISTINCT k) FROM cache WHERE outcome = 'HIT') AS n_hits, (SELECT count(*) FROM (SELECT DISTINCT user_id FROM events) u WHERE user_id NOT IN (SELECT k FROM cache WHERE outcome IN ('HIT', 'MISS'))) AS n_pending) SELECT *, CASE WHEN n_hits >= 1000000 THEN 'target_reached' WHEN n_pending = 0 THEN 'pool_exhausted' END AS reason FROM n")
def stop_conditions(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")
    answered = F.when(F.col("event_type") == "purchase", "HIT").when(F.col("event_type") == "error", "MISS").otherwise("THROTTLED")
    cache = events.filter("event_id % 3 = 0").select("user_id", answered.alias("outcome"))
    return incremental.stop_state(events.select("user_id").distinct(), cache, "user_id", 1_000_000)


@query("""WITH x AS (SELECT event_id, user_id, event_id % 4 AS r, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS k FROM events)
SELECT event_id, round(k * 0.5 + CASE WHEN r > 0 THEN least(6.0, pow(2.0, r)) ELSE 0.0 END * (1 + ('0x' || substring(md5('0:' || event_id), 1, 6))::bigint / 16777216.0 * 0.1), 3) AS slot FROM x""")
def paced_requests(spark: SparkSession, d: str) -> DataFrame:
    return incremental.paced(table(spark, d, "events").select("event_id", "user_id"), "user_id", ["event_id"], F.col("event_id") % 4, 0.5, 6.0).select("event_id", "slot")


@query("SELECT event_type, count(*) AS done, round(count(*)::double / 3600, 6) AS rate, round((1000000 - count(*)) / (count(*)::double / 3600), 3) AS seconds_left FROM events GROUP BY event_type")
def progress_rate(spark: SparkSession, d: str) -> DataFrame:
    counts = table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("done"))
    return counts.select("event_type", "done", *[c.alias(n) for n, c in incremental.progress(F.col("done"), F.lit(3600.0), F.lit(1_000_000)).items()])


@query(f"""{FACTS_SQL}, d AS (SELECT DISTINCT item_id, class_id FROM facts WHERE membership_type = 'direct'), i AS (SELECT item_id, class_id FROM facts WHERE membership_type <> 'direct'),
r AS (SELECT DISTINCT item_id, ancestor AS class_id FROM d JOIN pairs ON node = class_id EXCEPT SELECT item_id, class_id FROM d)
SELECT (SELECT count(*) FROM i) AS n_inferred, (SELECT count(*) FROM (FROM i EXCEPT FROM r)) AS n_unfounded, (SELECT count(*) FROM (FROM r EXCEPT FROM i)) AS n_missing""")
def propagation_audit(spark: SparkSession, d: str) -> DataFrame:
    """Inferred classes, which come from a literal map, against a closure of the edges."""
    facts = membership_all(spark, d).select("item_id", "class_id", "membership_type")
    gaps = quality.propagation_gaps(facts, hierarchy.closure(demo_edges(spark))).agg(F.count_if(F.col("side") == "left").alias("n_unfounded"), F.count_if(F.col("side") == "right").alias("n_missing"))
    return facts.agg(F.count_if(F.col("membership_type") != "direct").alias("n_inferred")).crossJoin(gaps)


@query(f"""{FACTS_SQL}, e AS (SELECT p_partkey AS item_id, CASE WHEN p_size <= 5 THEN '0210' WHEN p_size >= 40 THEN '0220' ELSE '0500' END AS class_id, p_size <= 5 OR p_size >= 45 AS wanted FROM part)
SELECT class_id, wanted, count(*) AS n FROM e WHERE wanted <> EXISTS (SELECT 1 FROM facts f WHERE f.item_id = e.item_id AND f.class_id = e.class_id) GROUP BY ALL""")
def failed_probes(spark: SparkSession, d: str) -> DataFrame:
    """Classes that parts should or should not have, by size alone; those behind the gate and the dear ones of middle size fail."""
    size = F.col("p_size")
    expected = table(spark, d, "part").select(F.col("p_partkey").alias("item_id"), F.when(size <= 5, "0210").when(size >= 40, "0220").otherwise("0500").alias("class_id"), ((size <= 5) | (size >= 45)).alias("wanted"))
    return quality.probes(membership_all(spark, d), expected).groupBy("class_id", "wanted").agg(F.count("*").alias("n"))


@query("SELECT doc_id, row_number() OVER (ORDER BY coalesce(source, ''), doc_id) AS ordinal FROM documents")
def global_ordinal(spark: SparkSession, d: str) -> DataFrame:
    return readers.with_ordinal(table(spark, d, "documents").select("doc_id", F.coalesce("source", F.lit("")).alias("catalog"), F.col("doc_id").alias("line_no"))).select("doc_id", "ordinal")


@query(f"""WITH RECURSIVE {COSINE_SQL}, best AS (SELECT query_id, arg_max(item_id, {{s: s, i: -item_id}}) AS item_id, max(s) AS s FROM pairs GROUP BY query_id), link AS (SELECT query_id AS a, item_id AS b FROM best WHERE s >= 0.35),
near AS (SELECT a, b FROM link UNION SELECT b, a FROM link), walk(a, b) AS (SELECT a, a FROM near UNION SELECT w.a, n.b FROM walk w JOIN near n ON n.a = w.b), root AS (SELECT a, min(b) AS r FROM walk GROUP BY a),
c AS (SELECT coalesce(r, vec_id)::varchar AS cluster FROM embeddings LEFT JOIN root ON a = vec_id),
g AS (SELECT cluster, count(*) AS n FROM c GROUP BY 1), o AS (SELECT *, coalesce(sum(n) OVER (ORDER BY n DESC, md5('20260722' || cluster), cluster ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, sum(n) OVER () AS t FROM g),
u AS (SELECT *, coalesce(sum(n) FILTER (b < floor(t * 0.15)) OVER (), 0) AS tested FROM o)
SELECT cluster, n, CASE WHEN b < floor(t * 0.15) THEN 'test' WHEN b - tested < floor(t * 0.15) THEN 'validation' ELSE 'train' END AS split FROM u""")
def cluster_split(spark: SparkSession, d: str) -> DataFrame:
    """A split that keeps a query vector and the one most like it on one side."""
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    near = sampling.nearest(rows.filter("id % 50 = 0"), rows, but_itself=True, places=4)
    links = near.filter(F.col("similarity") >= 0.35).select(F.col("query_id").alias("a"), F.col("item_id").alias("b"))
    return splits.group_split(splits.clusters(rows, links).select(F.col("cluster").cast("string").alias("cluster")), "cluster")
