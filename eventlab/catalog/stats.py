"""Queries on counters, lag, skew, duplicates, throughput and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sets, stats
from ..operators.routing import FailurePolicy, process, with_groups
from ..operators.synth import inject_duplicates, zipf_key
from ..functions.draw import u
from ..functions.fields import string_col
from ..functions.keys import partition_col
from ..plans.sizing import settle
from ..session import scratch_path
from ..sources.kafka import kafka_columns
from ..sources.tables import read_messages, spread, topic_table, write_messages
from .base import (
    ADDRESSED, MSGS, PARTITIONS, SEED, addressed, messages, partition_sql, processed, processed_sql, query, table,
    u_sql,
)
from .flows import FLOW_NAME, FLOW_SQL, LAST_STEP, flow_table
from .routing import DLQ, RETRY

COPIES = f"""{MSGS}, copies AS (
  SELECT msgs.*, copy_no FROM msgs, (SELECT unnest([0, 1]) AS copy_no)
  WHERE copy_no = 0 OR {u_sql("'duplicate'", 'row_index')} < 0.2)"""


def copies(spark, sf):
    return inject_duplicates(messages(spark, sf), 0.2, SEED)


@query("s1_producer_stats", f"""
    WITH {COPIES}
    SELECT topic, count(*) FILTER (NOT bad) AS messages,
           coalesce(sum(strlen(value)) FILTER (NOT bad), 0)::BIGINT AS bytes,
           count(*) FILTER (copy_no = 1) AS duplicates, count(*) FILTER (bad) AS errors
    FROM (SELECT *, row_index % 97 = 0 AS bad FROM copies) GROUP BY topic""")
def s1(spark, sf):
    sent = copies(spark, sf).withColumn("error", F.pmod("row_index", F.lit(97)) == 0)
    return stats.producer_stats(sent)


@query("s1_text_bytes", """
    SELECT lang AS topic, count(*)::BIGINT AS messages, sum(strlen(text))::BIGINT AS bytes,
           0::BIGINT AS duplicates, 0::BIGINT AS errors
    FROM documents GROUP BY lang""")
def s1_text(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("lang").alias("topic"), F.col("text").alias("value"))
    return stats.producer_stats(docs)


STATS_SQL = """group_stats AS (
  SELECT topic, group_id, count(*) FILTER (status = 'ok') AS consumed,
         coalesce(sum(strlen(value)) FILTER (status = 'ok'), 0)::BIGINT AS bytes,
         sum(failures)::BIGINT AS failures, count(*) FILTER (status = 'dlq') AS dlq,
         sum(retries)::BIGINT AS retries, count(*) FILTER (commit_failed) AS commit_failures
  FROM processed GROUP BY topic, group_id)"""


@query("s2_consumer_stats", f"""
    WITH {MSGS}, {processed_sql(RETRY)}
    SELECT topic, group_id,
           CASE WHEN grouping(topic) = 1 THEN 'total' WHEN grouping(group_id) = 1 THEN 'topic' ELSE 'group' END AS level,
           count(*) FILTER (status = 'ok') AS consumed,
           coalesce(sum(strlen(value)) FILTER (status = 'ok'), 0)::BIGINT AS bytes,
           sum(failures)::BIGINT AS failures, count(*) FILTER (status = 'dlq') AS dlq,
           sum(retries)::BIGINT AS retries, count(*) FILTER (commit_failed) AS commit_failures
    FROM processed GROUP BY ROLLUP (topic, group_id)""")
def s2(spark, sf):
    return stats.consumer_stats(processed(messages(spark, sf), RETRY))


LAG_SQL = f"""{MSGS}, {processed_sql(RETRY)}, {STATS_SQL},
  sent AS (SELECT topic, count(*) AS produced FROM msgs GROUP BY topic),
  lag_report AS (
    SELECT topic, group_id, produced, consumed, failures, retries, dlq, commit_failures,
           produced - consumed AS lag,
           (produced - sum(consumed) OVER (PARTITION BY topic))::BIGINT AS lag_total
    FROM sent JOIN group_stats USING (topic))"""


@query("s3_lag", f"""
    WITH {LAG_SQL}
    SELECT *, CASE WHEN lag_total > 100 THEN 'red' ELSE 'green' END AS severity FROM lag_report""")
def s3(spark, sf):
    msgs = messages(spark, sf)
    return stats.lag_report(msgs, processed(msgs, RETRY))


@query("s3_lag_single_group", f"""
    WITH {MSGS}, {processed_sql(DLQ, 1)}, {STATS_SQL}
    SELECT topic, group_id, produced, consumed, failures, retries, dlq, commit_failures,
           produced - consumed AS lag, produced - consumed AS lag_total,
           CASE WHEN produced - consumed > 100 THEN 'red' ELSE 'green' END AS severity
    FROM (SELECT topic, count(*) AS produced FROM msgs GROUP BY topic) JOIN group_stats USING (topic)""")
def s3_single(spark, sf):
    msgs = messages(spark, sf)
    return stats.lag_report(msgs, processed(msgs, DLQ, 1))


# The flow's own groups read two of its topics; "orders" also has a group of another name.
FLOW_PROCESSED = f"""flow_in AS (
    SELECT *, CASE WHEN topic = 'payments' THEN '{FLOW_NAME}-payments'
                   WHEN topic = 'shipping' THEN '{FLOW_NAME}-shipping' ELSE 'audit-' || topic END AS prefix
    FROM flow_msgs WHERE topic IN ('orders', 'payments', 'shipping')),
  processed AS (
    SELECT topic, prefix || '-group-1' AS group_id, value, row_index, step,
           {u_sql("'fail/' || prefix || '-group-1'", 'row_index')} AS draw
    FROM flow_in)"""

FLOW_POLICY = FailurePolicy(failure_rate=0.1)


def flow_processed(flow_msgs):
    own = F.concat(F.lit(f"{FLOW_NAME}-"), "topic")
    prefix = F.when(F.col("topic").isin("payments", "shipping"), own).otherwise(F.concat(F.lit("audit-"), "topic"))
    took = flow_msgs.where(F.col("topic").isin("orders", "payments", "shipping"))
    return process(with_groups(took, 1, prefix), FLOW_POLICY, SEED)


@query("s4_flow_report", f"""
    WITH {FLOW_SQL}, {FLOW_PROCESSED},
    made AS (SELECT topic, count(*) AS produced FROM flow_msgs GROUP BY topic),
    took AS (SELECT topic, count(*) FILTER (draw >= 0.1) AS consumed FROM processed
             WHERE group_id LIKE '{FLOW_NAME}-' || topic || '-%' GROUP BY topic)
    SELECT '{FLOW_NAME}' AS flow, topic, produced, consumed, produced - coalesce(consumed, 0) AS lag,
           consumed IS NULL AS no_consumer,
           CASE WHEN produced - coalesce(consumed, 0) > 100 THEN 'red'
                WHEN produced - coalesce(consumed, 0) > 0 THEN 'yellow' ELSE 'green' END AS severity
    FROM made LEFT JOIN took USING (topic)""")
def s4(spark, sf):
    flow_msgs = flow_table(spark, sf)
    return stats.flow_report(flow_msgs, flow_processed(flow_msgs))


@query("s5_totals", f"""
    WITH {MSGS}, {processed_sql(DLQ)}, {FLOW_SQL}
    SELECT made + flow AS produced, consumed, made - consumed AS lag, failures, dlq,
           CASE WHEN made - consumed > 100 THEN 'red' ELSE 'green' END AS severity
    FROM (SELECT count(*) AS made FROM msgs), (SELECT count(*) AS flow FROM flow_msgs),
         (SELECT count(*) FILTER (status = 'ok') AS consumed, sum(failures)::BIGINT AS failures,
                 count(*) FILTER (status = 'dlq') AS dlq FROM processed)""")
def s5(spark, sf):
    msgs = messages(spark, sf)
    return stats.totals(msgs, flow_table(spark, sf), processed(msgs, DLQ))


@query("s6_severity", f"""
    WITH {MSGS}, {processed_sql(DLQ, 1)}, l AS (
      SELECT topic, "partition", count(*) FILTER (status <> 'ok') AS lag FROM processed GROUP BY topic, "partition")
    SELECT topic, "partition", lag, CASE WHEN lag > 100 THEN 'red' ELSE 'green' END AS topic_colour,
           CASE WHEN lag > 100 THEN 'red' WHEN lag > 0 THEN 'yellow' ELSE 'green' END AS flow_colour
    FROM l""")
def s6(spark, sf):
    lag = processed(messages(spark, sf), DLQ, 1).groupBy("topic", "partition").agg(
        F.count_if(F.col("status") != "ok").alias("lag")
    )
    return lag.withColumn("topic_colour", stats.lag_severity(F.col("lag"))).withColumn(
        "flow_colour", stats.lag_severity(F.col("lag"), "flow")
    )


@query("s7_run_summary", f"""
    WITH {MSGS}, {processed_sql(RETRY)}, {FLOW_SQL}
    SELECT (SELECT count(*) FROM msgs) AS messages_produced,
           (SELECT count(*) FROM processed WHERE status = 'ok') AS messages_consumed,
           (SELECT count(*) FROM flow_msgs WHERE step = {LAST_STEP}) AS flows_completed,
           (SELECT count(*) FROM flow_msgs) AS flow_messages,
           (SELECT epoch_us(max(ts)) - epoch_us(min(ts)) FROM msgs) AS duration_micros""")
def s7(spark, sf):
    msgs = messages(spark, sf)
    return stats.run_summary(msgs, flow_table(spark, sf), processed(msgs, RETRY), LAST_STEP)


@query("s8_key_skew", f"""
    WITH {MSGS}, c AS (SELECT key, count(*) AS n FROM msgs GROUP BY key)
    SELECT row_number() OVER (ORDER BY n DESC, key)::INTEGER AS rank, key, n,
           round(n / (SELECT sum(n) FROM c)::DOUBLE, 6) AS share,
           round((SELECT max(n) / min(n)::DOUBLE FROM c), 6) AS head_tail
    FROM c ORDER BY n DESC, key LIMIT 10""")
def s8(spark, sf):
    return stats.key_skew(messages(spark, sf), 10)


HEAVY = 0.0068


@query("s8_heavy_keys", f"""
    WITH {MSGS}, c AS (SELECT key, count(*) AS n FROM msgs GROUP BY key)
    SELECT key, n, round(n / (SELECT sum(n) FROM c)::DOUBLE, 6) AS share FROM c WHERE n >= {HEAVY} * (SELECT sum(n) FROM c)""")
def s8_heavy(spark, sf):
    return stats.heavy_keys(messages(spark, sf), HEAVY)


def hot_messages(spark, sf):
    """Line items spread over partitions by Zipf keys."""
    lines = spread(table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("topic"), F.col("l_orderkey").alias("row_index")
    ))
    keyed = zipf_key(lines, 50, 1.5, SEED)
    return keyed.withColumn("partition", partition_col(F.col("key"), PARTITIONS))


HOT = f"""w AS (SELECT i, greatest(1, floor({1 << 51}::DOUBLE / pow(i + 1.0::DOUBLE, 1.5::DOUBLE))::BIGINT) AS w
        FROM range(50) AS t(i)),
  b AS (SELECT i, (sum(w) OVER (ORDER BY i) - w)::DOUBLE AS lo, (sum(w) OVER (ORDER BY i))::DOUBLE AS hi,
               (sum(w) OVER ())::DOUBLE AS total FROM w),
  c AS (SELECT i, lo / total AS lo, hi / total AS hi FROM b),
  d AS (SELECT l_returnflag AS topic, {u_sql("'key'", 'l_orderkey')} AS x FROM lineitem),
  hot AS (SELECT topic, {partition_sql("'key-' || i")} AS "partition" FROM d JOIN c ON x >= lo AND x < hi),
  counts AS (SELECT topic, "partition", count(*) AS n FROM hot GROUP BY topic, "partition")"""


@query("s9_partition_skew", f"""
    WITH {HOT}
    SELECT topic, "partition", n, round(n / (sum(n) OVER t)::DOUBLE, 6) AS share,
           round((max(n) OVER t) / (avg(n) OVER t), 6) AS max_mean
    FROM counts WINDOW t AS (PARTITION BY topic)""")
def s9(spark, sf):
    return stats.partition_skew(hot_messages(spark, sf))


@query("s10_assignment_load", f"""
    WITH {HOT}, a AS (
      SELECT *, ntile(5) OVER (PARTITION BY topic ORDER BY "partition")::INTEGER AS consumer FROM counts),
    l AS (SELECT topic, consumer, count(*) AS partitions, sum(n)::BIGINT AS messages FROM a GROUP BY topic, consumer)
    SELECT *, round(messages / (sum(messages) OVER (PARTITION BY topic))::DOUBLE, 6) AS share FROM l""")
def s10(spark, sf):
    return stats.assignment_load(hot_messages(spark, sf), 5)


@query("s11_duplicate_report", f"""
    WITH {COPIES}, g AS (SELECT topic, key, value, count(*) AS n FROM copies GROUP BY ALL)
    SELECT topic, sum(n)::BIGINT AS messages, count(*) AS distinct_messages, max(n) AS most_copies,
           (sum(n) - count(*))::BIGINT AS copies, round((sum(n) - count(*)) / sum(n)::DOUBLE, 6) AS duplicate_rate,
           (sum(n) - count(*)) / sum(n)::DOUBLE > 0.5 AS high
    FROM g GROUP BY topic""")
def s11(spark, sf):
    return stats.duplicate_report(copies(spark, sf))


@query("s12_dedup", f"""
    WITH {COPIES}
    SELECT topic, "partition", key, value, row_index FROM copies
    QUALIFY row_number() OVER (PARTITION BY topic, key, value ORDER BY row_index) = 1""")
def s12(spark, sf):
    return stats.dedup(copies(spark, sf).select("topic", "partition", "key", "value", "row_index"))


@query("s13_throughput", f"""
    WITH {MSGS}, c AS (
      SELECT topic, epoch_us(ts) // 3600000000 AS slot, count(*) AS messages, sum(strlen(value)) AS bytes
      FROM msgs GROUP BY ALL),
    g AS (SELECT topic, unnest(range(min(slot), max(slot) + 1)) AS slot FROM c GROUP BY topic)
    SELECT topic, slot * 3600 AS start_second, coalesce(messages, 0) AS messages,
           round(coalesce(messages, 0) / 3600.0::DOUBLE, 6) AS messages_per_second,
           round(coalesce(bytes, 0) / 3600.0::DOUBLE, 6) AS bytes_per_second
    FROM g LEFT JOIN c USING (topic, slot)""")
def s13(spark, sf):
    return stats.throughput(messages(spark, sf), 3600)


@query("s14_lag_timeline", f"""
    WITH {MSGS}, {processed_sql(DLQ)}, c AS (
      SELECT topic, group_id, epoch_us(ts) // 3600000000 AS slot, 1 AS change FROM processed
      UNION ALL
      SELECT topic, group_id, (epoch_us(ts) + 50000000 * (row_index % 200)) // 3600000000, -1
      FROM processed WHERE status = 'ok'),
    s AS (SELECT topic, group_id, slot, sum(change)::BIGINT AS change FROM c GROUP BY ALL)
    SELECT topic, group_id, slot * 3600 AS start_second, change,
           (sum(change) OVER (PARTITION BY topic, group_id ORDER BY slot))::BIGINT AS lag
    FROM s""")
def s14(spark, sf):
    msgs = messages(spark, sf)
    delay = F.pmod("row_index", F.lit(200)) * 50_000_000
    return stats.lag_timeline(msgs, processed(msgs, DLQ), 3600, delay)


HIGH = FailurePolicy(failure_rate=0.6, commit_failure_rate=0.7, on_failure="retry", max_retries=2)


@query("s15_failure_report", f"""
    WITH {MSGS}, {processed_sql(HIGH)}, r AS (
      SELECT topic, group_id, count(*) AS messages, avg((failures > 0)::INTEGER) AS f,
             avg((status <> 'ok')::INTEGER) AS l, avg(commit_failed::INTEGER) AS c
      FROM processed GROUP BY topic, group_id)
    SELECT topic, group_id, messages, round(f, 6) AS failed_share, round(l, 6) AS lost_share,
           round(c, 6) AS commit_failed_share,
           CASE WHEN f > 0.5 THEN 'high failure rate' WHEN c > 0.5 THEN 'high commit failure rate' END AS warning
    FROM r""")
def s15(spark, sf):
    return stats.failure_report(processed(messages(spark, sf), HIGH))


@query("s16_worst_lag", f"""
    WITH {LAG_SQL}
    SELECT topic, max(produced) AS produced, max(lag_total) AS lag_total
    FROM lag_report GROUP BY topic ORDER BY lag_total DESC, topic LIMIT 3""")
def s16(spark, sf):
    msgs = messages(spark, sf)
    return stats.worst_lag(stats.lag_report(msgs, processed(msgs, RETRY)), 3)


@query("s17_cardinality", """
    WITH e AS (SELECT count(DISTINCT user_id) AS users, count(DISTINCT event_type) AS types,
                      count(DISTINCT props) AS props FROM events)
    SELECT unnest(['user_id', 'event_type', 'props', 'customer_id']) AS field,
           unnest([1000, 4, 100, 500])::BIGINT AS declared,
           unnest([users, types, props, 500]) AS exact,
           unnest([users <= 1000, types <= 4, props <= 100, true]) AS within, true AS close
    FROM e""")
def s17(spark, sf):
    events = table(spark, sf, "events").withColumn(
        "customer_id", string_col(SEED, "customer_id", F.col("event_id"), 5, 8, 500)
    )
    report = stats.cardinality_report(
        events, {"user_id": 1000, "event_type": 4, "props": 100, "customer_id": 500}
    )
    off = F.abs(F.col("approx") - F.col("exact")) / F.col("exact")
    return report.withColumn("close", off <= 0.1).drop("approx")


SKETCHED = ("user_id", "props")


def sketch_table(spark, sf):
    """Distinct sketches by topic and day, as they would be kept."""
    events = table(spark, sf, "events").select("event_type", F.to_date("ts").alias("day"), *SKETCHED)
    return settle(stats.distinct_sketches(events, list(SKETCHED), ["event_type", "day"]), "sketches")


# What the merged sketches of two weeks say, against exact counts: off by five deviations at most.
@query("s17_sketches", """
    WITH e AS (SELECT * FROM events WHERE ts::DATE BETWEEN DATE '2024-01-08' AND DATE '2024-01-21')
    SELECT event_type, unnest(['user_id', 'props']) AS field, count(*) AS rows,
           unnest([count(DISTINCT user_id), count(DISTINCT props)]) AS exact, true AS close
    FROM e GROUP BY event_type""")
def s17_sketches(spark, sf):
    weeks = F.col("day").between(F.lit("2024-01-08").cast("date"), F.lit("2024-01-21").cast("date"))
    found = stats.distinct_estimates(sketch_table(spark, sf).where(weeks), ["event_type"])
    exact = table(spark, sf, "events").withColumn("day", F.to_date("ts")).where(weeks).groupBy("event_type").agg(
        *[F.count_distinct(c).alias(c) for c in SKETCHED]).select("event_type", F.inline(F.array(*[
            F.struct(F.lit(c).alias("field"), F.col(c).alias("exact")) for c in SKETCHED])))
    off = F.abs(F.col("estimate") - F.col("exact")) / F.col("exact")
    return found.join(exact, ["event_type", "field"]).select(
        "event_type", "field", "rows", "exact", (off <= 5 * stats.SKETCH_ERROR).alias("close"))


_NEAR = 5 * stats.SKETCH_ERROR


@query("s17_declared", f"""
    WITH c AS (SELECT unnest(['user_id', 'props']) AS field, unnest([100000, 100])::BIGINT AS declared,
                      unnest([count(DISTINCT user_id), count(DISTINCT props)]) AS n FROM events)
    SELECT field, declared, CASE WHEN abs(n - declared) <= {_NEAR!r} * declared THEN n END AS exact, n <= declared AS within FROM c""")
def s17_declared(spark, sf):
    return stats.declared_check(table(spark, sf, "events"), sketch_table(spark, sf), {"user_id": 100_000, "props": 100}).drop("estimate")


# --- set operations ----------------------------------------------------------


@query("u1_merge", f"""
    WITH {MSGS}
    SELECT 'events' AS scenario, topic, count(*)::BIGINT AS n, count(key)::BIGINT AS keys FROM msgs GROUP BY topic
    UNION ALL
    SELECT 'orders', o_orderstatus, count(*), 0 FROM orders GROUP BY o_orderstatus""")
def u1(spark, sf):
    orders = table(spark, sf, "orders").select(
        F.col("o_orderstatus").alias("topic"), F.col("o_orderkey").alias("row_index")
    )
    merged = sets.merge(events=messages(spark, sf), orders=orders)
    return merged.groupBy("scenario", "topic").agg(
        F.count(F.lit(1)).alias("n"), F.count("key").alias("keys")
    )


@query("u2_delivery_diff", f"""
    WITH {ADDRESSED},
    sent AS (SELECT topic, "partition", "offset" FROM addressed WHERE {u_sql("'unsent'", 'row_index')} >= 0.05),
    got AS (SELECT topic, "partition", "offset" FROM addressed, range(3) AS k(n)
            WHERE {u_sql("'undelivered'", 'row_index')} >= 0.1 AND (n = 0 OR row_index % 10 = n))
    SELECT *, 'lost' AS verdict FROM (SELECT * FROM sent EXCEPT ALL SELECT * FROM got)
    UNION ALL
    SELECT *, 'unexpected' FROM (SELECT * FROM got EXCEPT ALL SELECT * FROM sent)""")
def u2(spark, sf):
    all_rows = addressed(spark, sf)
    sent = all_rows.where(u(SEED, "unsent", F.col("row_index")) >= 0.05)
    received = all_rows.where(u(SEED, "undelivered", F.col("row_index")) >= 0.1)
    # Some are delivered again.
    received = received.unionByName(received.where(F.pmod("row_index", F.lit(10)).isin(1, 2)))
    return sets.delivery_diff(sent, received)


@query("u3_shared_topics", f"""
    WITH {MSGS}
    SELECT DISTINCT topic FROM msgs WHERE topic IN (SELECT CASE WHEN event_type < 'q' THEN event_type ELSE 'other-' || event_type END FROM events)""")
def u3(spark, sf):
    other = messages_over(spark, sf)
    return sets.shared_topics(messages(spark, sf), other)


def messages_over(spark, sf):
    """The events again, some of them under other topics."""
    kind = F.col("event_type")
    return table(spark, sf, "events").select(F.when(kind < "q", kind).otherwise(F.concat(F.lit("other-"), kind)).alias("topic"))


# --- tables in files ---------------------------------------------------------


@query("c3_kafka_columns", f"""
    WITH {MSGS}
    SELECT topic, lower(hex(encode(key))) AS key, lower(hex(encode(value))) AS value, count(*)::BIGINT AS n
    FROM msgs GROUP BY ALL""")
def c3(spark, sf):
    out = kafka_columns(messages(spark, sf))
    return out.groupBy("topic", F.lower(F.hex("key")).alias("key"), F.lower(F.hex("value")).alias("value")).agg(
        F.count(F.lit(1)).alias("n")
    )


@query("c4_message_table", f"""
    WITH {ADDRESSED}
    SELECT topic, "partition", count(*)::BIGINT AS n, max("offset") AS last_offset, sum(strlen(value))::BIGINT AS bytes
    FROM addressed GROUP BY topic, "partition" """)
def c4(spark, sf):
    path = scratch_path(spark, "messages")
    write_messages(addressed(spark, sf).withColumn("ts", F.col("ts").cast("timestamp")), path)
    return read_messages(spark, path).groupBy("topic", "partition").agg(
        F.count(F.lit(1)).alias("n"), F.max("offset").alias("last_offset"),
        F.sum(F.octet_length("value").cast("bigint")).alias("bytes"),
    )


@query("c4_message_table_json", """
    SELECT event_type AS topic, count(*)::BIGINT AS n, sum(event_id)::BIGINT AS index_sum,
           sum(epoch_us(ts) // 1000)::BIGINT AS millis FROM events GROUP BY event_type""")
def c4_json(spark, sf):
    path = scratch_path(spark, "messages-json")
    rows = messages(spark, sf).withColumn("ts", F.date_trunc("millisecond", F.col("ts").cast("timestamp")))
    write_messages(rows, path, "json", files_per_value=2)
    return read_messages(spark, path, "json").groupBy("topic").agg(
        F.count(F.lit(1)).alias("n"), F.sum("row_index").alias("index_sum"),
        F.sum(F.unix_millis("ts")).alias("millis"),
    )


@query("c5_topic_table", """
    SELECT DISTINCT event_type AS topic, 6 AS partitions, 2 AS replication FROM events
    UNION ALL
    SELECT DISTINCT topic, 12, 3 FROM (SELECT event_type AS topic FROM events
      UNION ALL SELECT c_mktsegment FROM customer)
    WHERE topic NOT IN (SELECT event_type FROM events)""")
def c5(spark, sf):
    events = table(spark, sf, "events").select(F.col("event_type").alias("topic"))
    declared = events.distinct().select(
        "topic", F.lit(6).alias("partitions"), F.lit(2).alias("replication")
    )
    segments = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("topic"))
    return topic_table(declared, events.union(segments))
