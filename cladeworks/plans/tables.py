"""Registered queries: versions, increments, artifacts, slots, audits of topology, quantiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import artifacts, evaluate, hierarchy, predict, slots
from ..sources import readers, sinks
from ..sources.versions import VersionedTable
from ..streaming.derived import Derived
from .acquisition import fresh_path
from .catalogue import TERM_SQL, query, table, term_text

SIZE_SQL = "count(*) AS n_rows, coalesce(sum(n_chars), 0)::bigint AS chars FROM documents"


@query(f"""SELECT 1 AS version, {SIZE_SQL} WHERE lang = 'en' UNION ALL SELECT 2, {SIZE_SQL} WHERE lang IN ('en', 'fr') UNION ALL SELECT 3, {SIZE_SQL} WHERE doc_id % 2 = 0
UNION ALL SELECT 4, {SIZE_SQL.replace('sum(n_chars)', 'sum(n_chars * 2)')} WHERE doc_id % 2 = 0 UNION ALL SELECT 5, {SIZE_SQL} WHERE lang IN ('en', 'fr')""")
def table_versions(spark: SparkSession, d: str) -> DataFrame:
    """Documents as five versions of one table: those of one language, another's appended, all replaced by even ids, lengths doubled, and the second version restored."""
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")
    held = VersionedTable(spark, fresh_path(spark, "versions"))
    held.replace(docs.filter("lang = 'en'"))
    held.append(docs.filter("lang = 'fr'"))
    held.freeze("before_split")
    held.replace(docs.filter("doc_id % 2 = 0"))
    held.rewrite({"n_chars": F.col("n_chars") * 2})
    held.roll_back(2)
    rows = [held.read(v).agg(F.count("*").alias("n_rows"), F.coalesce(F.sum("n_chars"), F.lit(0)).alias("chars")).select(F.lit(v).alias("version"), "n_rows", "chars") for v in held.versions()]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


@query("SELECT text_md5, count(*) AS n, sum(n_chars)::bigint AS chars, min(doc_id) AS first_id, max(source) AS last_source FROM (SELECT *, md5(text) AS text_md5 FROM documents) GROUP BY text_md5")
def derived_by_increments(spark: SparkSession, d: str) -> DataFrame:
    """Documents of every text, added up in four batches; one batch is handed over twice."""
    rows = table(spark, d, "documents").select("doc_id", F.md5("text").alias("text_md5"), "n_chars", "source")
    held = Derived(spark, fresh_path(spark, "derived"), ["text_md5"], {"n": ("count", "doc_id"), "chars": ("sum", "n_chars"), "first_id": ("min", "doc_id"), "last_source": ("max", "source")})
    for batch in (0, 1, 2, 2, 3):
        held.merge(rows.filter(F.pmod("doc_id", F.lit(4)) == batch), batch)
    return held.read()


DIGEST_SQL = """x AS (SELECT 'node' AS what, md5(concat_ws(chr(31), id, name)) AS h FROM nodes UNION ALL SELECT 'edge', md5(concat_ws(chr(31), p, c)) FROM edges),
s AS (SELECT what, count(*) AS n_rows, (sum(('0x' || substr(h, 1, 16))::ubigint::hugeint) % 18446744073709551616::hugeint) AS a, (sum(('0x' || substr(h, 17, 16))::ubigint::hugeint) % 18446744073709551616::hugeint) AS b FROM x GROUP BY what),
g AS (SELECT what, n_rows, printf('%016x%016x', a::ubigint, b::ubigint) AS digest FROM s)"""
GRAPH_ROWS_SQL = """nodes AS (SELECT DISTINCT 'S' || source AS id, 'a "source" & <more>' AS name FROM documents UNION ALL SELECT 'D' || doc_id, lang FROM documents),
edges AS (SELECT 'S' || source AS p, 'D' || doc_id AS c FROM documents)"""


@query(f"""WITH {GRAPH_ROWS_SQL}, {DIGEST_SQL} SELECT artifact, what, n_rows, digest, true AS agrees FROM g, (VALUES ('memory'), ('parquet'), ('tsv'), ('graphml'), ('json')) AS t(artifact)""")
def artifact_equality(spark: SparkSession, d: str) -> DataFrame:
    """Sources and their documents as a graph, written in four formats and read back: digests of nodes and of edges."""
    docs = table(spark, d, "documents").select(F.concat(F.lit("S"), F.col("source")).alias("parent_id"), F.concat(F.lit("D"), F.col("doc_id")).alias("child_id"), "lang")
    nodes = docs.select(F.col("parent_id").alias("class_id"), F.lit('a "source" & <more>').alias("name")).distinct().union(docs.select("child_id", "lang"))
    edges = docs.select("parent_id", "child_id")
    path = fresh_path(spark, "artifacts")
    found = {"node": {"memory": nodes}, "edge": {"memory": edges}}
    for what, df in (("node", nodes), ("edge", edges)):
        sinks.write_table(df, f"{path}/{what}.parquet")
        sinks.write_tsv(df, f"{path}/{what}.tsv")
        df.write.json(f"{path}/{what}.json")
        found[what] |= {"parquet": spark.read.parquet(f"{path}/{what}.parquet"), "tsv": readers.strings_table(spark, f"{path}/{what}.tsv"), "json": spark.read.json(f"{path}/{what}.json")}
    sinks.write_graphml(nodes, edges, f"{path}/graphml")
    found["node"]["graphml"], found["edge"]["graphml"] = readers.graphml(spark, f"{path}/graphml", ["name"])
    rows = [artifacts.compared(found[w], c).withColumn("what", F.lit(w)) for w, c in (("node", ["class_id", "name"]), ("edge", ["parent_id", "child_id"]))]
    return rows[0].unionByName(rows[1])


@query("SELECT doc_id::varchar AS key, source || '!' AS value, 'right' AS side, 1 AS times FROM documents WHERE doc_id = (SELECT max(doc_id) FROM documents) UNION ALL SELECT doc_id::varchar, source, 'left', 1 FROM documents WHERE doc_id = (SELECT max(doc_id) FROM documents)")
def changed_row(spark: SparkSession, d: str) -> DataFrame:
    """Documents against a copy in which one source was changed: the row is named."""
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("key"), F.col("source").alias("value"))
    last = rows.agg(F.max("key").alias("last"))
    other = rows.crossJoin(F.broadcast(last)).select("key", F.when(F.col("key") == F.col("last"), F.concat("value", F.lit("!"))).otherwise(F.col("value")).alias("value"))  # one row
    return artifacts.changed_rows(rows, other, ["key", "value"], ["key"])


@query("SELECT run, (SELECT count(*) FROM documents) AS n_rows, true AS agrees FROM (VALUES (0), (1), (2)) AS t(run)")
def rerun_audit(spark: SparkSession, d: str) -> DataFrame:
    """One job on documents under three numbers of shuffle partitions, with and without adaptive plans."""

    def build() -> DataFrame:
        docs = table(spark, d, "documents").select("doc_id", "source", F.xxhash64("text").alias("k"))
        first = docs.groupBy("k").agg(F.min("doc_id").alias("rep"))
        return docs.join(first, "k").select("doc_id", "rep", "source")

    name, plan = "spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled"
    return artifacts.reruns(spark, build, ["doc_id", "rep", "source"], [{name: "3"}, {name: "8"}, {name: "11", plan: "false"}]).drop("digest")


SLOT_SQL = "f AS (SELECT DISTINCT l_suppkey AS s, l_linenumber % 2 AS k, l_partkey AS p FROM lineitem)"


@query(f"""WITH {SLOT_SQL}, a AS (SELECT s, count(*) FILTER (k = 0) AS n_first, count(*) FILTER (k = 1) AS n_second FROM f GROUP BY s), b AS (SELECT s, count(*) AS n_both FROM (SELECT s, p FROM f GROUP BY s, p HAVING count(*) = 2) GROUP BY s)
SELECT s AS l_suppkey, n_first, n_second, coalesce(n_both, 0) AS n_both, n_first * n_second - coalesce(n_both, 0) AS n_pairs FROM a LEFT JOIN b USING (s)""")
def slot_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Parts that a supplier ships on even and odd lines, as the two slots of a reaction."""
    facts = table(spark, d, "lineitem").select("l_suppkey", (F.col("l_linenumber") % 2).alias("slot"), "l_partkey")
    return slots.slot_pairs(facts, "l_suppkey", "slot", "l_partkey")


@query(f"WITH {SLOT_SQL} SELECT p_type, k AS slot, count(DISTINCT p) AS n FROM f JOIN part ON p = p_partkey GROUP BY p_type, k")
def class_slots(spark: SparkSession, d: str) -> DataFrame:
    """How many parts of each type any supplier ships in each slot: a table beside the types, not among them."""
    facts = table(spark, d, "lineitem").select((F.col("l_linenumber") % 2).alias("slot"), F.col("l_partkey").alias("p_partkey"))
    part = table(spark, d, "part")
    places = slots.numbered(part.select("p_partkey"), "p_partkey")
    return slots.overlaps(slots.bitmaps(part, ["p_type"], "p_partkey", places), slots.bitmaps(facts, ["slot"], "p_partkey", places))


@query(f"""WITH RECURSIVE {TERM_SQL}, up(node, cur, n) AS (SELECT id, id, 0 FROM t UNION ALL SELECT up.node, p.id, up.n + 1 FROM up JOIN t ON t.id = up.cur JOIN t p ON p.id = split_part(t.parents, ';', 1)), depth AS (SELECT node, max(n) AS depth FROM up GROUP BY node),
e AS (SELECT id AS c, unnest(string_split(parents, ';')) AS p FROM t WHERE parents <> '')
SELECT (SELECT count(*) FROM t) AS n_terms, (SELECT count(*) FROM e) AS n_edges, (SELECT count(*) FROM t WHERE parents = '') AS n_roots, (SELECT string_agg(id, ';' ORDER BY id) FROM t WHERE parents = '') AS roots,
  (SELECT count(*) FROM t WHERE contains(parents, ';')) AS n_multi_parent, (SELECT count(*) FROM t WHERE obsolete) AS n_obsolete, (SELECT count(DISTINCT p) FROM e WHERE p NOT IN (SELECT id FROM t)) AS n_dangling,
  0 AS n_cycle_nodes, true AS acyclic, (SELECT max(depth) FROM depth) AS max_depth, (SELECT string_agg(depth || '=' || n, ' ' ORDER BY depth) FROM (SELECT depth, count(*) AS n FROM depth GROUP BY depth)) AS histogram""")
def ontology_audit(spark: SparkSession, d: str) -> DataFrame:
    terms = readers.obo_terms(term_text(spark, d))
    return hierarchy.topology_audit(terms.select(F.col("id").alias("node"), "parents", "obsolete"))


@query("""WITH r AS (SELECT r_name AS grp, 1 AS depth, r_name AS label, 'group' AS kind FROM region UNION ALL SELECT r_name, 2, n_name, 'leaf' FROM region JOIN nation ON r_regionkey = n_regionkey WHERE r_name <> 'ASIA'
UNION ALL SELECT r_name, 2, '(' || count(*) || ' families)', 'collapsed' FROM region JOIN nation ON r_regionkey = n_regionkey WHERE r_name = 'ASIA' GROUP BY r_name)
SELECT row_number() OVER (ORDER BY grp DESC, depth, label) - 1 AS position, depth, label, kind, grp AS "group" FROM r""")
def collapsed_family_rows(spark: SparkSession, d: str) -> DataFrame:
    """Regions, last name first, with their nations; one region's are only counted."""
    groups = table(spark, d, "region").select(F.col("r_regionkey").alias("group_id"), F.col("r_name").alias("name"))
    families = table(spark, d, "nation").select(F.col("n_regionkey").alias("group_id"), F.col("n_name").alias("name"))
    return hierarchy.family_rows(groups, families, ["ASIA"], descending=True)


@query("SELECT round(quantile_cont(n_chars, 0.25), 6) AS lower, round(median(n_chars), 6) AS mid, round(quantile_cont(n_chars, 0.9), 6) AS upper FROM documents")
def exact_quantiles(spark: SparkSession, d: str) -> DataFrame:
    found = evaluate.exact_quantiles(table(spark, d, "documents"), "n_chars", {"lower": 0.25, "mid": 0.5, "upper": 0.9})
    return found.select(*[F.round(c, 6).alias(c) for c in found.columns])


@query("""WITH w AS (SELECT p_partkey, string_split(p_name, ' ') AS ws FROM part), c AS (SELECT *, CASE WHEN len(ws[1]) % 2 = 0 THEN ws[1] END AS first FROM w)
SELECT p_partkey, first AS "primary", array_to_string(list_prepend(first, list_filter(ws, lambda x: x <> coalesce(first, ''))), ';') AS candidates, CASE WHEN first IS NULL THEN 'none' ELSE first || '>' || ws[2] END AS lineage FROM c""")
def plugged_predictions(spark: SparkSession, d: str) -> DataFrame:
    """Part names through a predictor: the first word is the class if it has an even number of letters; every word is a candidate."""
    part = table(spark, d, "part").select("p_partkey", "p_name")

    def by_words(text: str) -> tuple[str | None, list[str]]:
        words = text.split(" ")
        return (words[0] if len(words[0]) % 2 == 0 else None), words

    found = predict.predicted(part, "p_name", by_words)
    second = F.try_element_at(F.split("p_name", " "), F.lit(2))
    line = F.when(F.col("primary").isNull(), "none").otherwise(F.concat_ws(">", "primary", second))
    return found.select("p_partkey", "primary", F.array_join("candidates", ";").alias("candidates"), line.alias("lineage"))
