"""Resumable acquisition and stateful streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..operators.ranges import running_before
from ..storage import stored

#: Outcomes after which a key is not asked again.
DEFINITIVE = ("HIT", "MISS", "EMPTY", "NOLABEL", "SERVER5XX")
#: The same for a probe, which asks a failing server again.
PROBE_DEFINITIVE = ("HIT", "MISS", "EMPTY", "NOLABEL")
#: Members of a label of which one must say something.
LABEL_FIELDS = ("class", "superclass", "kingdom", "direct_parent")


def body_outcome(body: Column) -> Column:
    """EMPTY, NONJSON, HIT or NOLABEL for a response's text."""
    text = F.trim(F.coalesce(body, F.lit("")))
    parsed = F.try_parse_json(text)
    present = F.lit(False)
    for name in LABEL_FIELDS:
        value = F.try_variant_get(parsed, f"$.{name}", "string")
        present = present | F.coalesce(~value.isin("", "{}", "[]", "null", "false", "0"), F.lit(False))
    return F.when(text.isin("", "{}", "[]", "null"), "EMPTY").when(parsed.isNull(), "NONJSON").when(present, "HIT").otherwise("NOLABEL")


def outcome(status: Column, body: Column) -> Column:
    """The outcome of a stored response from its status and text."""
    return (
        F.when(status == 200, body_outcome(body)).when(status == 404, "MISS").when(status == 429, "THROTTLED")
        .when((status >= 500) & (status < 600), "SERVER5XX").when(status.isNotNull(), F.concat(F.lit("HTTP"), status.cast("string"))).otherwise("NO_ANSWER")
    )


def pending(keys: DataFrame, cache: DataFrame, key: str, definitive: tuple[str, ...] = DEFINITIVE) -> DataFrame:
    """Keys without a definitive answer."""
    return keys.join(cache.filter(F.col("outcome").isin(*definitive)).select(key).distinct(), key, "left_anti")


def islands(df: DataFrame, host: str, order: str, failed: Column) -> DataFrame:
    """Adds is_failed, island (rows of a host from one success up to the next) and before_is_failed, all failures that come earlier.

    ``order`` is total within a host. Counts run over ranges of (host, order), so that no task sees a whole host.
    """
    rows = df.withColumn("is_failed", F.coalesce(failed, F.lit(False)).cast("bigint")).withColumn("is_good", 1 - F.col("is_failed"))
    run = running_before(rows, [F.col(host), F.col(order)], "is_good", "is_failed")
    return run.withColumn("island", F.col("before") + F.col("is_good")).drop("before", "is_good")


def breaker(df: DataFrame, host: str, order: str, failed: Column, trip: int = 10) -> DataFrame:
    """Adds run (failures in a row up to here, by host) and tripped."""
    rows = islands(df, host, order, failed)
    # Written first: between plain exchanges the join can split an island of very many rows.
    starts = stored(rows.groupBy(host, "island").agg(F.min("before_is_failed").alias("island_start")))
    both = rows.join(starts.withColumnsRenamed({host: "start_host", "island": "start_island"}), F.col(host).eqNullSafe(F.col("start_host")) & (F.col("island") == F.col("start_island")))
    run = (F.col("before_is_failed") + F.col("is_failed") - F.col("island_start")).cast("bigint")
    return both.withColumn("run", run).select(*df.columns, "run", (F.col("run") >= trip).alias("tripped"))


def run_lengths(df: DataFrame, host: str, order: str, failed: Column) -> DataFrame:
    """(host, island, n): the failures of every island that has any."""
    return islands(df, host, order, failed).groupBy(host, "island").agg(F.sum("is_failed").alias("n")).filter("n > 0")


def cool_down(trips: Column) -> Column:
    """Seconds to wait after so many trips: two minutes each, half an hour at most."""
    return F.least(F.lit(1800), F.lit(120) * trips)


#: Folders that a cache is dealt to by key, so that a batch reads those of its own keys alone.
BUCKETS = 64


def cached(spark: SparkSession, cache_path: str) -> DataFrame | None:
    """The cache, with the bucket that each row is in, or None before the first batch."""
    try:
        return spark.read.parquet(cache_path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        return None


def acquire(spark: SparkSession, source: DataFrame, cache_path: str, checkpoint: str, key: str = "inchikey"):
    """Drain a stream of responses into the cache, once each: definitive outcomes of keys not yet in it.

    The checkpoint makes a rerun continue; the anti join makes a replayed batch add nothing. The cache is
    partitioned by a hash of the key: a batch reads the partitions of its keys.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        rows = batch.withColumn("outcome", outcome(F.col("http_status"), F.col("raw_json"))).filter(F.col("outcome").isin(*DEFINITIVE))
        rows = rows.groupBy(key).agg(F.max_by(F.struct("http_status", "outcome", "raw_json"), "fetched_at").alias("r")).select(key, "r.*")
        rows = rows.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int"))
        known = cached(session, cache_path)
        if known is not None:
            touched = [r[0] for r in rows.select("bucket").distinct().collect()]  # BUCKETS numbers at most
            rows = rows.join(known.filter(F.col("bucket").isin(*touched)).select(key), key, "left_anti")
        rows.write.mode("append").partitionBy("bucket").parquet(cache_path)

    return source.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stop_state(keys: DataFrame, cache: DataFrame, key: str, target: int) -> DataFrame:
    """One row: n_hits, n_pending and why acquisition may stop: 'target_reached', 'pool_exhausted', or null to go on."""
    hits = cache.filter("outcome = 'HIT'").agg(F.count_distinct(key).alias("n_hits"))
    left = pending(keys, cache, key).agg(F.count("*").alias("n_pending"))
    return hits.crossJoin(left).withColumn("reason", F.when(F.col("n_hits") >= target, "target_reached").when(F.col("n_pending") == 0, "pool_exhausted"))


def paced(requests: DataFrame, host: str, order: list[str], retries: Column, interval: float, most: float = 60.0, seed: str = "0") -> DataFrame:
    """Adds slot, the second at which each request may go: places of one host are ``interval`` apart, and a retry waits twice as long each time, ``most`` at most, plus a jitter of up to a tenth by hash."""
    place = F.row_number().over(Window.partitionBy(host).orderBy(*order)) - 1
    wait = F.when(retries > 0, F.least(F.lit(float(most)), F.pow(F.lit(2.0), retries))).otherwise(0.0)
    jitter = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), *[F.col(c).cast("string") for c in order])), 1, 6), 16, 10).cast("double") / (1 << 24) * 0.1
    return requests.withColumn("slot", F.round(place * interval + wait * (1 + jitter), 3))


def progress(done: Column, seconds: Column, total: Column) -> dict[str, Column]:
    """Rate a second and the seconds left at that rate; null before any time has passed."""
    rate = F.try_divide(done.cast("double"), seconds)
    return {"rate": F.round(rate, 6), "seconds_left": F.round(F.try_divide(total - done, rate), 3)}


def windowed_counts(events: DataFrame, time: str = "ts", width: str = "1 hour", late: str = "2 hours", by: str = "event_type") -> DataFrame:
    """Counts a window; works on streams (with a watermark) and tables alike. An extension: the engine's model needs no event time."""
    rows = events.withColumn(time, F.col(time).cast("timestamp"))
    if rows.isStreaming:
        rows = rows.withWatermark(time, late)
    return rows.groupBy(F.window(time, width), by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), by, "n")


def first_arrivals(events: DataFrame, key: str, time: str, within: str = "1 day") -> DataFrame:
    """A stream without repeats of a key inside the watermark: state is bounded by it."""
    rows = events.withColumn(time, F.col(time).cast("timestamp"))
    return rows.withWatermark(time, within).dropDuplicatesWithinWatermark([key]) if rows.isStreaming else rows.dropDuplicates([key])


def passes(step: Callable[[], int], most: int = 8) -> int:
    """Repeat a draining step until nothing is left or it stops making progress; returns what is left."""
    left = step()
    for _ in range(most - 1):
        if not left:
            break
        before, left = left, step()
        if left >= before:
            break
    return left
