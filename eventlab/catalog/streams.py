"""Streaming queries: each reads a test table as a stream until nothing is left."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.draw import u
from ..operators.flows import flow_messages
from ..operators.routing import FailurePolicy
from ..operators.sessions import sessions
from ..operators.synth import inject_duplicates
from ..session import scratch_path
from ..sources.tables import read_messages, write_messages
from ..streaming import monitors as mon
from ..streaming.flow_state import open_flow_status, open_prompt_flow_status, prompt_flow_status, stream_flow_status
from ..streaming.sinks import drain, stream_route
from ..streaming.sources import stream_messages
from ..streaming.tails import drained
from .base import ADDRESSED, MSGS, SEED, addressed, as_messages, messages, processed, processed_sql, query, table, u_sql
from .flows import CHECKOUT, FLOW_SQL
from .stats import COPIES
from .synth import P5_SIZED_SQL, SIZED


def table_stream(spark, sf, name):
    """A test table as a file stream with the table's own schema."""
    schema = table(spark, sf, name).schema
    return read_messages(spark, sf, streaming=True, schema=schema, glob=f"{name}.parquet")


def message_stream(spark, sf):
    return as_messages(table_stream(spark, sf, "events"))


def micros(name):
    return F.unix_micros(F.col(name).cast("timestamp")).alias(name)


@query("r1_topic_stats", f"""
    WITH {MSGS}
    SELECT topic, count(*)::BIGINT AS messages, sum(strlen(value))::BIGINT AS bytes FROM msgs GROUP BY topic""")
def r1(spark, sf):
    return drain(mon.stream_topic_stats(message_stream(spark, sf)), "topic-stats", "complete")


# Closed windows come from the stream, those that are open when the input ends from its state.
@query("r2_throughput", f"""
    WITH {MSGS}, w AS (
      SELECT topic, epoch_us(ts) // 3600000000 AS slot, count(*) AS messages, sum(strlen(value))::BIGINT AS bytes
      FROM msgs GROUP BY ALL)
    SELECT topic, slot * 3600000000 AS "start", (slot + 1) * 3600000000 AS "end", messages, bytes
    FROM w""")
def r2(spark, sf):
    return throughput(spark, sf).select("topic", micros("start"), micros("end"), "messages", "bytes")


def throughput(spark, sf):
    done = drained(mon.stream_throughput(message_stream(spark, sf), "1 hour", "10 minutes"), "throughput")
    return done.whole(mon.open_throughput(spark, done.checkpoint))


@query("r2_open_windows", f"""
    WITH {MSGS}, w AS (
      SELECT topic, epoch_us(ts) // 3600000000 AS slot, count(*) AS messages, sum(strlen(value))::BIGINT AS bytes
      FROM msgs GROUP BY ALL)
    SELECT topic, slot * 3600000000 AS "start", (slot + 1) * 3600000000 AS "end", messages, bytes,
           (slot + 1) * 3600000 <= (SELECT max(epoch_us(ts)) // 1000 - 600000 FROM msgs) AS closed
    FROM w""")
def r2_open(spark, sf):
    return throughput(spark, sf).select("topic", micros("start"), micros("end"), "messages", "bytes", "closed")


RETRY = FailurePolicy(failure_rate=0.3, on_failure="retry", max_retries=2)


@query("r3_failure_rate", f"""
    WITH {MSGS}, {processed_sql(RETRY, 1)}, s AS (
      SELECT *, epoch_us(ts) // 21600000000 - k AS slot FROM processed, range(4) AS t(k)),
    w AS (
      SELECT topic, group_id, slot, count(*) AS messages, count(*) FILTER (failures > 0) AS failed FROM s GROUP BY ALL)
    SELECT topic, group_id, slot * 21600000000 AS "start", (slot + 4) * 21600000000 AS "end", messages, failed,
           round(failed / messages::DOUBLE, 6) AS failure_rate
    FROM w""")
def r3(spark, sf):
    routed = processed(message_stream(spark, sf), RETRY, 1)
    done = drained(mon.stream_failure_rate(routed, "24 hours", "6 hours", "10 minutes"), "failure-rate")
    out = done.whole(mon.open_failure_rate(spark, done.checkpoint))
    return out.select("topic", "group_id", micros("start"), micros("end"), "messages", "failed", "failure_rate")


SESSIONS = f"""{MSGS}, g AS (
    SELECT key, ts, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY key ORDER BY ts) < 14400000000
                         THEN 0 ELSE 1 END AS fresh FROM msgs),
  n AS (SELECT key, ts, sum(fresh) OVER (PARTITION BY key ORDER BY ts) AS session FROM g),
  sessions AS (
    SELECT key, epoch_us(min(ts)) AS "start", epoch_us(max(ts)) + 14400000000 AS "end", count(*)::BIGINT AS messages
    FROM n GROUP BY key, session)"""


@query("r4_sessions", f"""
    WITH {SESSIONS} SELECT * FROM sessions""")
def r4(spark, sf):
    done = drained(mon.stream_sessions(message_stream(spark, sf), "4 hours", "10 minutes"), "sessions")
    out = done.whole(mon.open_sessions(spark, done.checkpoint))
    return out.select("key", micros("start"), micros("end"), "messages")


@query("r4_sessions_batch", f"WITH {SESSIONS} SELECT * FROM sessions")
def r4_batch(spark, sf):
    out = sessions(messages(spark, sf), ["key"], 4 * 3600)
    return out.select("key", F.col("start_micros").alias("start"), F.col("end_micros").alias("end"), "messages")


@query("r5_dedup", f"""
    WITH {COPIES}
    SELECT topic, key, value, count(*)::BIGINT AS n FROM (SELECT DISTINCT topic, key, value FROM copies) GROUP BY ALL""")
def r5(spark, sf):
    copies = inject_duplicates(message_stream(spark, sf), 0.2, SEED)
    kept = drain(mon.stream_dedup(copies, "60 days"), "dedup")
    return kept.groupBy("topic", "key", "value").agg(F.count(F.lit(1)).alias("n"))


# A seventh of the messages is never consumed, a seventh out of bounds, the others within seconds.
@query("r6_lag", f"""
    WITH {ADDRESSED}, p AS (
      SELECT *, epoch_us(ts) AS us, {u_sql("'consumed'", 'row_index')} * 7 AS wait FROM addressed)
    SELECT topic, "partition", "offset", us AS ts,
           CASE WHEN wait >= 2 THEN us + 2000000 * floor(wait)::BIGINT END AS consumed_at, wait < 2 AS lagging
    FROM p""")
def r6(spark, sf):
    # Offsets need the whole table, so the addressed messages are written first and streamed from there.
    path = scratch_path(spark, "addressed")
    write_messages(addressed(spark, sf).withColumn("ts", F.col("ts").cast("timestamp")), path, partition_by=None)
    produced = read_messages(spark, path, streaming=True)
    wait = u(SEED, "consumed", F.col("row_index")) * 7
    seconds = F.when(wait < 2, F.lit(60)).otherwise(F.floor(wait) * 2)
    consumed = read_messages(spark, path, streaming=True).where(wait >= 1).withColumn(
        "ts", F.col("ts") + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))
    )
    done = drained(mon.stream_lag(produced, consumed, "30 seconds", "60 seconds"), "lag")
    out = done.whole(mon.open_lag(done))
    return out.select("topic", "partition", "offset", micros("ts"), micros("consumed_at"), "lagging")


def lossy_flows(spark, sf):
    msgs = flow_messages(table_stream(spark, sf, "orders"), CHECKOUT, SEED, "o_orderkey", "o_orderdate")
    return msgs.where(u(SEED, "gone", F.col("row_index") * 10 + F.col("step")) >= 0.1)


LOSSY = f"""{FLOW_SQL}, kept AS (
      SELECT *, epoch_us(ts) // 1000 AS ms FROM flow_msgs WHERE {u_sql("'gone'", '(row_index * 10 + step)')} >= 0.1),
    seen AS (
      SELECT correlation_id, list(DISTINCT step) AS steps, min(ms) AS first, max(ms) AS last
      FROM kept GROUP BY correlation_id),
    status AS (
      SELECT *, CASE WHEN len(steps) = 6 THEN 'complete' ELSE 'expired' END AS status, len(steps)::BIGINT AS seen,
             array_to_string(list_filter(range(6), lambda x: NOT list_contains(steps, x)), ',') AS missing
      FROM seen)"""


@query("r7_flow_status", f"""
    WITH {LOSSY}
    SELECT correlation_id, status, seen, missing FROM status""")
def r7(spark, sf):
    done = drained(stream_flow_status(lossy_flows(spark, sf), CHECKOUT, "60 seconds", "1 minute"), "flow-status")
    return done.whole(open_flow_status(spark, done.checkpoint, CHECKOUT)).drop("closed")


@query("r7_flow_status_prompt", f"""
    WITH {LOSSY}
    SELECT correlation_id, status, seen, missing FROM status""")
def r7_prompt(spark, sf):
    done = drained(prompt_flow_status(lossy_flows(spark, sf), CHECKOUT, 60, "1 minute"), "flow-prompt")
    return done.whole(open_prompt_flow_status(spark, done.checkpoint, CHECKOUT)).drop("closed")


DLQ = FailurePolicy(failure_rate=0.15, on_failure="dlq")


@query("r8_route", f"""
    WITH {ADDRESSED}, {processed_sql(DLQ, 1, "addressed")}
    SELECT CASE status WHEN 'ok' THEN topic ELSE topic || '-dlq' END AS topic, count(*)::BIGINT AS n
    FROM processed GROUP BY ALL""")
def r8(spark, sf):
    ok, dlq = routed(spark, sf)
    done = spark.read.parquet(ok).select("topic").unionByName(spark.read.parquet(dlq).select("topic"))
    return done.groupBy("topic").agg(F.count(F.lit(1)).alias("n"))


def routed(spark, sf):
    """The events as a stream, routed; folders of consumed messages and dead letters."""
    ok, dlq, checkpoint = (scratch_path(spark, f"route-{part}") for part in ("ok", "dlq", "checkpoint"))
    msgs = message_stream(spark, sf).withColumn("offset", F.col("row_index")).withColumn(
        "group_id", F.concat("topic", F.lit("-group-1"))
    )
    stream_route(msgs, DLQ, ok, dlq, checkpoint, SEED, {"availableNow": True}).awaitTermination()
    return ok, dlq


# Whole rows: consumed ones as they are, dead letters as their envelopes.
@query("r8_route_rows", f"""
    WITH {MSGS}, {processed_sql(DLQ, 1)}
    SELECT topic, key, row_index AS "offset", value FROM processed WHERE status = 'ok'
    UNION ALL
    SELECT topic || '-dlq', NULL, NULL,
           '{{"original_topic":"' || topic || '","original_partition":' || "partition" || ',"original_offset":' || row_index
           || ',"error":"simulated_processing_failure","timestamp":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00","payload":'
           || to_json(value)::VARCHAR || '}}'
    FROM processed WHERE status = 'dlq'""")
def r8_rows(spark, sf):
    ok, dlq = routed(spark, sf)
    none = F.lit(None).cast("bigint").alias("offset")
    return spark.read.parquet(ok).select("topic", "key", "offset", "value").unionByName(spark.read.parquet(dlq).select("topic", "key", none, "value"))


# A tenth of the events arrives after all others, behind a watermark of one day.
@query("r9_late_rows", f"""
    WITH e AS (SELECT *, {u_sql("'arrival'", 'event_id')} >= 0.1 AS on_time FROM events),
    w AS (SELECT (max(epoch_us(ts)) // 1000 - 86400000) * 1000 AS mark FROM e WHERE on_time)
    SELECT count(*)::BIGINT AS input_rows,
           count(*) FILTER (NOT on_time AND epoch_us(ts) <= (SELECT mark FROM w)) AS late_rows
    FROM e""")
def r9(spark, sf):
    totals, _, _ = in_two_parts(spark, sf, lambda msgs: mon.stream_dedup(msgs, "1 day", salts=1))
    return spark.createDataFrame([(totals["input_rows"], totals["late_rows"])], "input_rows BIGINT, late_rows BIGINT")


def in_two_parts(spark, sf, make):
    """Run a stream over the events on time, then go on with those that arrive late; its totals, output and checkpoint."""
    arrivals, out, checkpoint = (scratch_path(spark, f"late-{part}") for part in ("in", "out", "checkpoint"))
    events = as_messages(table(spark, sf, "events"))
    numbered = events.withColumn("value", F.col("row_index").cast("string"))
    on_time = u(SEED, "arrival", F.col("row_index")) >= 0.1
    totals, reports = mon.ProgressTotals(), []
    spark.streams.addListener(totals)
    for part in (on_time, ~on_time):
        numbered.where(part).write.mode("append").parquet(arrivals)
        stream = make(read_messages(spark, arrivals, streaming=True, schema=numbered.schema))
        query = stream.writeStream.format("parquet").option("path", out).option(
            "checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        reports.append(mon.late_report(query, totals))
    spark.streams.removeListener(totals)
    return {name: sum(r[name] for r in reports) for name in reports[0]}, spark.read.schema(stream.schema).parquet(out), checkpoint


# Rows that a windowed stream dropped: what was observed in front of it less what its windows hold.
@query("r9_late_windows", f"""
    WITH e AS (SELECT *, {u_sql("'arrival'", 'event_id')} >= 0.1 AS on_time FROM events),
    w AS (SELECT max(epoch_us(ts)) // 1000 - 86400000 AS mark FROM e WHERE on_time),
    l AS (SELECT count(*) FILTER (NOT on_time AND (epoch_us(ts) // 3600000000 + 1) * 3600000 <= (SELECT mark FROM w)) AS late_rows, count(*) AS n FROM e)
    SELECT n AS arrived, n - late_rows AS counted, late_rows FROM l""")
def r9_windows(spark, sf):
    totals, closed, checkpoint = in_two_parts(spark, sf, lambda msgs: mon.stream_throughput(mon.observed(msgs), "1 hour", "1 day"))
    return mon.dropped_rows(closed.unionByName(mon.open_throughput(spark, checkpoint)), totals)


@query("r10_generated_stream", P5_SIZED_SQL)
def r10(spark, sf):
    rows = table_stream(spark, sf, "events").select(F.col("event_id").alias("row_index"), "ts")
    return drain(stream_messages(rows, SIZED, SEED), "generated").drop("ts")
