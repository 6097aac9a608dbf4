"""Continuous counters, windows, sessions and matching under watermarks.

Aggregating monitors fold rows per task before their shuffle, so hot topics and
keys reach the state store as one row per task and batch.
"""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from ..operators.routing import value_size
from .tails import Drained, state_of


def event_time(msgs: DataFrame, late: str) -> DataFrame:
    """Set the watermark; zone-less times are read as UTC first."""
    return msgs.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def stream_topic_stats(msgs: DataFrame) -> DataFrame:
    """Running totals per topic, for update or complete mode."""
    return msgs.groupBy("topic").agg(
        F.count(F.lit(1)).alias("messages"), F.sum(value_size(F.col("value"))).alias("bytes")
    )


def stream_throughput(msgs: DataFrame, width: str, late: str) -> DataFrame:
    """Messages and bytes per topic and tumbling window; in append mode rows later than ``late`` are dropped."""
    return _throughput(
        event_time(msgs, late)
        .groupBy("topic", F.window("ts", width))
        .agg(F.count(F.lit(1)).alias("messages"), F.sum(value_size(F.col("value"))).alias("bytes"))
    )


def _throughput(windows: DataFrame) -> DataFrame:
    return windows.select("topic", F.col("window.start").alias("start"), F.col("window.end").alias("end"), "messages", "bytes")


def open_throughput(spark: SparkSession, checkpoint: str) -> DataFrame:
    """Rows of ``stream_throughput`` whose windows are still open."""
    return _throughput(state_of(spark, checkpoint, "messages: bigint, bytes: bigint"))


def stream_failure_rate(processed: DataFrame, width: str, slide: str, late: str) -> DataFrame:
    """Share of failed messages per group and sliding window."""
    return _failure_rate(event_time(processed, late).groupBy(
        "topic", "group_id", F.window("ts", width, slide)
    ).agg(
        F.count(F.lit(1)).alias("messages"),
        F.count_if(F.col("failures") > 0).alias("failed"),
    ))


def _failure_rate(windows: DataFrame) -> DataFrame:
    return windows.select(
        "topic", "group_id", F.col("window.start").alias("start"), F.col("window.end").alias("end"),
        "messages", "failed", F.round(F.col("failed") / F.col("messages"), 6).alias("failure_rate"),
    )


def open_failure_rate(spark: SparkSession, checkpoint: str) -> DataFrame:
    """Rows of ``stream_failure_rate`` whose windows are still open."""
    return _failure_rate(state_of(spark, checkpoint, "messages: bigint, failed: bigint"))


def stream_sessions(msgs: DataFrame, gap: str, late: str) -> DataFrame:
    """Activity per key, split where nothing arrives for ``gap``. Tables take ``operators.sessions`` instead."""
    return _sessions(event_time(msgs, late).groupBy("key", F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("messages")))


def _sessions(folded: DataFrame) -> DataFrame:
    return folded.select(
        "key", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "messages")


def open_sessions(spark: SparkSession, checkpoint: str) -> DataFrame:
    """Rows of ``stream_sessions`` whose sessions may still grow."""
    window = "struct<start: timestamp, end: timestamp>"
    return _sessions(state_of(spark, checkpoint, f"_key: string, session_window: {window}, messages: bigint"))


def stream_dedup(msgs: DataFrame, late: str, salts: int = 8, idx: str = "row_index") -> DataFrame:
    """Drop repeats of (topic, key, value) arriving within ``late`` of the first.

    Copies are dropped per salt first, so a group of copies that holds a large
    share of the rows is spread over ``salts`` tasks and reaches the final task
    as at most ``salts`` rows.
    """
    timed = event_time(msgs, late)
    same = ["topic", "key", "value"]
    if salts > 1:
        salted = timed.withColumn("_salt", F.pmod(F.col(idx), F.lit(salts)))
        timed = salted.dropDuplicatesWithinWatermark([*same, "_salt"]).drop("_salt")
    return timed.dropDuplicatesWithinWatermark(same)


def stream_lag(produced: DataFrame, consumed: DataFrame, within: str, late: str) -> DataFrame:
    """Each produced message with its consumption time, null if none within ``within``.

    ``consumed`` has topic, partition, offset and ts. Addresses are unique, so
    no join key is hot.
    """
    p = event_time(produced, late).alias("p")
    c = (
        consumed.select("topic", "partition", "offset", F.col("ts").cast("timestamp").alias("consumed_at"))
        .withWatermark("consumed_at", late)
        .alias("c")
    )
    same = (
        (F.col("p.topic") == F.col("c.topic"))
        & (F.col("p.partition") == F.col("c.partition"))
        & (F.col("p.offset") == F.col("c.offset"))
        & (F.col("consumed_at") >= F.col("p.ts"))
        & (F.col("consumed_at") <= F.col("p.ts") + F.expr(f"INTERVAL {within}"))
    )
    return p.join(c, same, "leftOuter").select(
        "p.topic", "p.partition", "p.offset", F.col("p.ts").alias("ts"), "consumed_at",
        F.col("consumed_at").isNull().alias("lagging"),
    )


def open_lag(done: Drained) -> DataFrame:
    """Rows of ``stream_lag`` for messages that still wait: no consumption came, and one in time still could.

    The join keeps a message until the watermark has passed its bound, matched
    or not; those matched are in the output already.
    """
    waiting = state_of(done.closed.sparkSession, done.checkpoint, "topic: string, partition: int, offset: bigint, ts: timestamp", joinSide="left")
    address = ["topic", "partition", "offset"]
    return waiting.join(done.closed.select(*address), address, "left_anti").select(
        *address, "ts", F.lit(None).cast("timestamp").alias("consumed_at"), F.lit(True).alias("lagging"))


ARRIVALS = "arrivals"


def observed(msgs: DataFrame) -> DataFrame:
    """``msgs``, with the rows of each batch counted as they pass by, for ``ProgressTotals``; put it right in front of a window."""
    return msgs.observe(ARRIVALS, F.count(F.lit(1)).alias("rows"))


def dropped_rows(windows: DataFrame, totals: dict[str, int]) -> DataFrame:
    """One row (arrived, counted, late_rows): how many rows a windowed stream left out as late.

    ``windows`` has all its closed and open rows (tumbling windows, ``messages`` each), ``totals`` those of its
    runs. Spark's own figure counts dropped rows after folding them per task.
    """
    arrived = F.lit(totals["observed_rows"]).cast("bigint")
    return windows.agg(F.coalesce(F.sum("messages"), F.lit(0)).alias("counted")).select(
        arrived.alias("arrived"), "counted", (arrived - F.col("counted")).alias("late_rows"))


class ProgressTotals(StreamingQueryListener):
    """Adds up the progress of every batch of the queries that run while it is attached.

    Attach it (``spark.streams.addListener``) before a query starts: a query itself remembers its last batches only.
    """

    def __init__(self):
        self.totals: dict[str, dict[str, int]] = {}
        self.ended: dict[str, threading.Event] = {}

    def _of(self, run) -> dict[str, int]:
        self.ended.setdefault(str(run), threading.Event())
        return self.totals.setdefault(str(run), {"batches": 0, "input_rows": 0, "late_rows": 0, "observed_rows": 0})

    def onQueryStarted(self, event) -> None:
        self._of(event.runId)

    def onQueryProgress(self, event) -> None:
        total, p = self._of(event.progress.runId), event.progress
        total["batches"] += 1
        total["input_rows"] += p.numInputRows
        total["late_rows"] += sum(s.numRowsDroppedByWatermark for s in p.stateOperators)
        if ARRIVALS in p.observedMetrics:
            total["observed_rows"] += p.observedMetrics[ARRIVALS].rows or 0

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._of(event.runId)
        self.ended[str(event.runId)].set()


def late_report(query, totals: ProgressTotals | None = None) -> dict[str, int]:
    """Batches, rows read, and rows dropped as later than the watermark, over all batches of a query.

    With ``totals`` the figures of the attached listener, once it has heard of the query's
    end. Without, those the query remembers; raises where its first batches are forgotten. Of
    windowed aggregates Spark counts dropped rows after folding them per task.
    """
    if totals is not None:
        run = str(query.runId)
        totals._of(run)
        if not query.isActive:
            totals.ended[run].wait(60)
        return dict(totals.totals[run])
    progress = query.recentProgress
    kept = int(SparkSession.active().conf.get("spark.sql.streaming.numRecentProgressUpdates", "100"))
    # Spark drops the oldest when it holds as many as that.
    if progress and progress[0]["batchId"] > 0 and len(progress) >= kept - 1:
        raise ValueError("the query no longer remembers its first batches; attach ProgressTotals before it starts")
    return {
        "batches": len(progress),
        "input_rows": sum(p["numInputRows"] for p in progress),
        "late_rows": sum(s["numRowsDroppedByWatermark"] for p in progress for s in p["stateOperators"]),
    }
