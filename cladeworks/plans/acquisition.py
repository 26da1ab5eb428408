"""Registered queries: split scans, stored responses, failure runs on streams."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..sources import lines, readers, responses
from ..storage import checkpoint_dir
from ..streaming import failures, incremental
from .catalogue import query, table


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid4().hex}"


OFFERS_SQL = """offers AS (SELECT source AS catalog, (CASE WHEN doc_id % 3 = 0 THEN '>>>' ELSE '' END || lang || CASE WHEN doc_id % 5 = 0 THEN '' ELSE ' ' || n_chars END || CASE WHEN doc_id % 2 = 0 THEN ' x  y' ELSE '' END) AS raw, doc_id AS o FROM documents WHERE source IS NOT NULL)"""


@query(f"""WITH {OFFERS_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY catalog ORDER BY o, raw) AS line_no, row_number() OVER (ORDER BY catalog, o, raw) AS ordinal, string_split_regex(raw, ' +') AS f FROM offers)
SELECT catalog, line_no, ordinal, CASE WHEN len(f) > 1 THEN regexp_replace(f[1], '^>>>', '') END AS structure, CASE WHEN len(f) > 1 THEN f[1] END AS supplied, CASE WHEN len(f) > 1 THEN f[2] END AS supplier_code, len(f) > 1 AS well_formed FROM n""")
def numbered_scan(spark: SparkSession, d: str) -> DataFrame:
    """A line for each document, as text files of its source, written with CR LF in several parts and read back with their numbers."""
    n = F.col("doc_id")
    code = F.when(n % 5 == 0, "").otherwise(F.concat(F.lit(" "), F.col("n_chars")))
    raw = F.concat(F.when(n % 3 == 0, ">>>").otherwise(""), F.col("lang"), code, F.when(n % 2 == 0, " x  y").otherwise(""))
    rows = table(spark, d, "documents").filter("source is not null").select(F.col("source").alias("catalog"), "doc_id", raw.alias("value"))
    path = fresh_path(spark, "offers")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(parts, "doc_id", "value").sortWithinPartitions("catalog", "doc_id", "value")
    ranged.select("catalog", "value").write.partitionBy("catalog").option("lineSep", "\r\n").text(path)
    return readers.catalogs(spark, f"{path}/*", catalog=lines.folder_value("catalog")).drop("raw")


@query("""WITH r AS (SELECT doc_id, (CASE WHEN doc_id % 3 = 0 THEN doc_id + 1 ELSE doc_id END) % 5 AS kind FROM documents WHERE doc_id % 7 > 0)
SELECT 'D' || d.doc_id AS inchikey, o.outcome, o.outcome IN ('HIT', 'MISS', 'EMPTY', 'NOLABEL', 'SERVER5XX') AS acquired, o.outcome IN ('HIT', 'MISS', 'EMPTY', 'NOLABEL') AS probed
FROM documents d LEFT JOIN r USING (doc_id), LATERAL (SELECT CASE kind WHEN 0 THEN 'SERVER5XX' WHEN 1 THEN 'MISS' WHEN 2 THEN 'HIT' WHEN 3 THEN 'EMPTY' WHEN 4 THEN 'NOLABEL' ELSE 'NO_ANSWER' END AS outcome) o""")
def stored_lookups(spark: SparkSession, d: str) -> DataFrame:
    """Every document's latest stored response, of two segments of which the second is later, and whether acquisition and probe take it as definitive. One document in seven has none."""
    docs = table(spark, d, "documents").select("doc_id", "lang", F.concat(F.lit("D"), F.col("doc_id")).alias("inchikey"))
    path = fresh_path(spark, "responses")

    def answered(rows: DataFrame, kind: Column, time: str) -> DataFrame:
        status = F.when(kind == 0, 503).when(kind == 1, 404).otherwise(200)
        body = F.when(kind == 2, F.concat(F.lit('{"class":{"name":"'), F.col("lang"), F.lit('"}}'))).when(kind == 3, "").when(kind == 4, F.concat(F.lit('{"n":'), F.col("doc_id"), F.lit("}")))
        return rows.select("inchikey", F.lit("entities").alias("source"), status.alias("http_status"), body.alias("raw_json"), F.lit(time).alias("fetched_at"))

    asked = docs.filter("doc_id % 7 > 0")
    responses.append_segment(answered(asked, F.col("doc_id") % 5, "2026-01-01"), path)
    responses.append_segment(answered(asked.filter("doc_id % 3 = 0"), (F.col("doc_id") + 1) % 5, "2026-01-02"), path)
    found = responses.lookup(docs.select("inchikey"), responses.read_responses(spark, path)).withColumn("outcome", incremental.outcome(F.col("http_status"), F.col("raw_json")))
    return found.select("inchikey", "outcome", F.col("outcome").isin(*incremental.DEFINITIVE).alias("acquired"), F.col("outcome").isin(*incremental.PROBE_DEFINITIVE).alias("probed"))


@query("""WITH n AS (SELECT conv_id, count(*) AS total FROM conversations GROUP BY conv_id) SELECT 'V' || conv_id AS inchikey, total, least(total, 4) AS listed, total > 4 AS truncated FROM n""")
def activity_pages(spark: SparkSession, d: str) -> DataFrame:
    """Turns of each conversation as a page of at most 4 entries that tells how many there are in all."""
    counts = table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("total"))
    body = F.concat(F.lit('{"page_meta":{"total_count":'), F.col("total"), F.lit('},"activities":['), F.array_join(F.array_repeat(F.lit("{}"), F.least(F.col("total"), F.lit(4)).cast("int")), ","), F.lit("]}"))
    path = fresh_path(spark, "pages")
    responses.append_segment(counts.select(F.concat(F.lit("V"), F.col("conv_id")).alias("inchikey"), F.lit("activity").alias("source"), F.lit(200).alias("http_status"), body.alias("raw_json"), F.lit("0").alias("fetched_at")), path)
    return responses.activity_counts(responses.read_responses(spark, path))


#: Runs in a row since the last success; each tenth failure trips and begins anew. A pause is that of the latest trip.
RUNS_SQL = f"""e AS (SELECT user_id, event_id, epoch_ms(ts) AS ms, event_type IN ('error', 'view', 'click', 'signup') AS failed FROM events),
s AS (SELECT *, sum(CASE WHEN failed THEN 0 ELSE 1 END) OVER w AS streak FROM e WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
p AS (SELECT *, CASE WHEN failed THEN (row_number() OVER (PARTITION BY user_id, streak, failed ORDER BY event_id) - 1) % {failures.TRIP} + 1 ELSE 0 END AS run FROM s),
t AS (SELECT *, run = {failures.TRIP} AS tripped, sum((run = {failures.TRIP})::int) OVER (PARTITION BY user_id ORDER BY event_id) AS trips FROM p),
u AS (SELECT *, last_value(CASE WHEN tripped THEN ms + 1000 * least({failures.LONGEST_PAUSE}, {failures.PAUSE_STEP} * trips) END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS until FROM t)
SELECT user_id::varchar AS host, event_id AS at, run::bigint AS run, trips::bigint AS trips, tripped, coalesce(ms < until, false) AS paused FROM u"""

@query(f"WITH {RUNS_SQL}")
def failure_stream(spark: SparkSession, d: str) -> DataFrame:
    """Failure runs of all users from a stream over events, drained into a table."""
    events = table(spark, d, "events")
    source, out, at = (fresh_path(spark, n) for n in ("events", "runs", "stream"))
    events.repartitionByRange(4, "event_id").sortWithinPartitions("event_id").write.parquet(source)
    stream = spark.readStream.schema(events.schema).parquet(source)
    runs = failures.failure_stream(stream, "user_id", "event_id", "ts", F.col("event_type").isin("error", "view", "click", "signup"))
    runs.writeStream.format("parquet").option("path", out).option("checkpointLocation", at).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(failures.RUNS).parquet(out).filter("kind = 'event'").select("host", "at", "run", "trips", "tripped", "paused")


@query(f"WITH {RUNS_SQL}")
def failure_table(spark: SparkSession, d: str) -> DataFrame:
    """The same rows from the whole table at once."""
    return failures.failure_table(table(spark, d, "events"), "user_id", "event_id", "ts", F.col("event_type").isin("error", "view", "click", "signup"))
