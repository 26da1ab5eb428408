"""Failures in a row, by host, as the running state of a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Failures in a row that trip, seconds of a pause for each trip, and of the longest pause.
TRIP, PAUSE_STEP, LONGEST_PAUSE = 10, 120, 1800
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
RUNS = "host string, at bigint, kind string, run bigint, trips bigint, tripped boolean, paused boolean, until timestamp"


class FailureRuns(StatefulProcessor):
    """State of a host: failures in a row, trips so far, the end of its pause, the last row's place.

    A row gives one row 'event'. The failure that makes a run reach TRIP ends it: the host pauses PAUSE_STEP
    seconds for each trip so far, LONGEST_PAUSE at most, and a timer ends the pause with a row 'resumed'. Rows of a host
    that are not after its last one are repeats of a replay and give nothing.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "run bigint, trips bigint, until bigint, last bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        run, trips, until, last = self.state.get() if self.state.exists() else (0, 0, -1, None)
        frames = [f for f in rows if len(f)]
        if not frames:
            return
        f = pd.concat(frames).sort_values("at")
        out = []
        for at, failed, seconds in zip(f["at"].tolist(), f["failed"].tolist(), f["time"].astype("int64").tolist(), strict=True):
            if last is not None and at <= last:
                continue
            last = at
            run = run + 1 if failed else 0
            tripped = run == TRIP
            paused = seconds < until
            if tripped:
                trips += 1
                until = seconds + 1000 * min(LONGEST_PAUSE, PAUSE_STEP * trips)
                self.handle.registerTimer(until)
            out.append((key[0], at, "event", run, trips, tripped, paused, pd.Timestamp(until, unit="ms") if until >= 0 else None))
            if tripped:
                run = 0
        self.state.update((run, trips, until, last))
        if out:
            yield frame(out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        run, trips, until, last = self.state.get()
        ended = expiredTimerInfo.getExpiryTimeInMs()
        if ended == until:  # a later trip has put the end off
            yield frame([(key[0], last, "resumed", run, trips, False, False, pd.Timestamp(ended, unit="ms"))])

    def close(self) -> None:
        pass


def frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in RUNS.split(", ")]).astype({"until": "datetime64[us]"})


def failure_stream(events: DataFrame, host: str, at: str, time: str, failed: Column, late: str = "10 minutes") -> DataFrame:
    """RUNS of a stream of events, whatever its batches are. ``at`` orders a host's rows and ascends from batch to batch.

    One batch's rows of one host are in one task, so a source that may hold many is to bound its batches
    (maxFilesPerTrigger, maxBytesPerTrigger). A null ``failed`` is no failure; rows without host, place or time give nothing.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    rows = events.select(F.col(host).cast("string").alias("host"), F.col(at).cast("bigint").alias("at"), F.col(time).cast("timestamp").alias("event_time"), F.coalesce(failed, F.lit(False)).alias("failed")).dropna()
    rows = rows.withColumn("time", F.unix_millis("event_time"))
    return rows.withWatermark("event_time", late).groupBy("host").transformWithStateInPandas(FailureRuns(), outputStructType=RUNS, outputMode="Append", timeMode="EventTime")


def failure_table(events: DataFrame, host: str, at: str, time: str, failed: Column) -> DataFrame:
    """The rows 'event' of ``failure_stream`` of a whole table: host, at, run, trips, tripped, paused, by windows.

    A run counts failures since the last success or trip, so it is the place within its streak modulo TRIP; of pauses, the latest trip's ends last.
    """
    from pyspark.sql import Window

    rows = events.select(F.col(host).cast("string").alias("host"), F.col(at).cast("bigint").alias("at"), F.unix_millis(F.col(time).cast("timestamp")).alias("ms"), F.coalesce(failed, F.lit(False)).alias("failed")).dropna()
    w = Window.partitionBy("host").orderBy("at")
    streak = F.sum((~F.col("failed")).cast("bigint")).over(w)
    place = F.row_number().over(Window.partitionBy("host", "streak", "failed").orderBy("at"))
    rows = rows.withColumn("streak", streak).withColumn("place", F.when(F.col("failed"), place).otherwise(0))
    rows = rows.withColumn("run", F.when(F.col("failed"), F.pmod(F.col("place") - 1, F.lit(TRIP)) + 1).otherwise(0).cast("bigint"))
    rows = rows.withColumn("tripped", F.col("run") == TRIP).withColumn("trips", F.sum(F.col("tripped").cast("bigint")).over(w))
    until = F.when(F.col("tripped"), F.col("ms") + 1000 * F.least(F.lit(LONGEST_PAUSE), PAUSE_STEP * F.col("trips")))
    before = F.last(until, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("paused", F.coalesce(F.col("ms") < before, F.lit(False))).select("host", "at", "run", "trips", "tripped", "paused")
