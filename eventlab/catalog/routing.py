"""Queries on failures, retries, dead letters and visibility."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.draw import u
from ..operators.routing import (
    FailurePolicy, dlq_envelope, dlq_replay, filter_incidents, visible_to, with_groups,
)
from ..session import scratch_path
from ..sources.tables import ADDRESS, join_buckets, write_bucketed
from .base import ADDRESSED, MSGS, SEED, addressed, messages, processed, processed_sql, query, table, u_sql

SKIP = FailurePolicy(failure_rate=0.1)
RETRY = FailurePolicy(failure_rate=0.2, on_failure="retry", max_retries=3, commit_failure_rate=0.05)
DLQ = FailurePolicy(failure_rate=0.15, on_failure="dlq", commit_failure_rate=0.02)

COLUMNS = ["topic", "group_id", "row_index", "status", "attempts", "failures", "retries", "commit_failed"]


def _routed(policy: FailurePolicy, columns: list[str]):
    names = ", ".join(columns)
    return f"WITH {MSGS}, {processed_sql(policy)} SELECT {names} FROM processed"


@query("f1_skip", _routed(SKIP, COLUMNS))
def f1(spark, sf):
    return processed(messages(spark, sf), SKIP).select(*COLUMNS)


@query("f2_retry", _routed(RETRY, COLUMNS))
def f2(spark, sf):
    return processed(messages(spark, sf), RETRY).select(*COLUMNS)


@query("f3_dlq", _routed(DLQ, COLUMNS))
def f3(spark, sf):
    return processed(messages(spark, sf), DLQ).select(*COLUMNS)


@query("f4_commit_failures", f"""
    WITH {MSGS}, {processed_sql(RETRY)}
    SELECT topic, group_id, status, commit_failed, count(*)::BIGINT AS n
    FROM processed GROUP BY ALL""")
def f4(spark, sf):
    return processed(messages(spark, sf), RETRY).groupBy("topic", "group_id", "status", "commit_failed").agg(
        F.count(F.lit(1)).alias("n")
    )


# Every third value is bytes that are not UTF-8, every third is missing.
def mixed_payloads(msgs):
    kind = F.pmod("row_index", F.lit(3))
    raw = F.unhex(F.concat(F.lit("ff"), F.md5(F.col("row_index").cast("string"))))
    return msgs.withColumn(
        "value", F.when(kind == 0, raw).when(kind == 1, F.col("value").cast("binary"))
    )


FAILED = f"""{ADDRESSED}, {processed_sql(DLQ, 1, "addressed")},
  failed AS (
    SELECT *, CASE row_index % 3 WHEN 0 THEN unhex('ff' || md5(row_index::VARCHAR))
                                 WHEN 1 THEN encode(value) END AS raw
    FROM processed WHERE status = 'dlq')"""


@query("f5_dlq_envelope", f"""
    WITH {FAILED}
    SELECT topic || '-dlq' AS topic, NULL::VARCHAR AS key,
           '{{"original_topic":"' || topic || '","original_partition":' || "partition"
           || ',"original_offset":' || "offset" || ',"error":"simulated_processing_failure","timestamp":"'
           || strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00","payload":'
           || CASE row_index % 3 WHEN 0 THEN '"' || to_base64(raw) || '","payload_encoding":"base64"'
                                 WHEN 1 THEN to_json(value)::VARCHAR ELSE 'null' END || '}}' AS value
    FROM failed""")
def f5(spark, sf):
    routed = processed(addressed(spark, sf), DLQ, 1).where(F.col("status") == "dlq")
    return dlq_envelope(mixed_payloads(routed))


@query("f6_dlq_replay", f"""
    WITH {FAILED}
    SELECT topic AS original_topic, "partition" AS original_partition, "offset" AS original_offset, key,
           lower(hex(raw)) AS payload_hex, kept AS found, kept AS same
    FROM (SELECT * REPLACE (CASE WHEN kept THEN key END AS key)
          FROM (SELECT *, {u_sql("'retained'", 'row_index')} >= 0.2 AS kept FROM failed))""")
def f6(spark, sf):
    source = mixed_payloads(addressed(spark, sf))
    routed = processed(source, DLQ, 1).where(F.col("status") == "dlq")
    # A fifth of the source messages is past its retention by the time of the replay.
    kept = source.where(u(SEED, "retained", F.col("row_index")) >= 0.2)
    return dlq_replay(dlq_envelope(routed), kept).select(
        "original_topic", "original_partition", "original_offset", "key",
        F.lower(F.hex("payload")).alias("payload_hex"), "found", "same",
    )


# Messages and what became of them, both kept in buckets of their addresses.
@query("c4_bucketed_replay", f"""
    WITH {ADDRESSED}, {processed_sql(DLQ, 1, "addressed")}
    SELECT topic, "partition", "offset", key, value, group_id, failures FROM processed WHERE status = 'dlq'""")
def c4_bucketed(spark, sf):
    source = addressed(spark, sf)
    lost = processed(source, DLQ, 1).where(F.col("status") == "dlq").select(*ADDRESS, "group_id", "failures")
    kept = []
    for part, rows in (("messages", source), ("lost", lost)):
        path = scratch_path(spark, f"bucketed-{part}")
        kept.append(write_bucketed(rows, path.rsplit("/", 1)[1].replace("-", "_"), path, 8))
    return join_buckets(*kept).select(*ADDRESS, "key", "value", "group_id", "failures")


KINDS = ("stop_broker", "pause_consumer", "start_broker", "change_producer_rate")


@query("f7_filter_incidents", """
    WITH s AS (
      SELECT p_partkey, list_transform(range(p_partkey % 5), lambda i: (p_partkey + i) % 4) AS plain,
             list_transform(range(p_size % 4), lambda g: list_transform(range(g + 1), lambda i: (p_size + g * i) % 4)) AS groups
      FROM part),
    f AS (
      SELECT p_partkey, plain, groups, list_filter(plain, lambda k: k NOT IN (0, 2)) AS kept,
             list_transform(groups, lambda g: list_filter(g, lambda k: k NOT IN (0, 2))) AS slim
      FROM s)
    SELECT p_partkey, array_to_string(list_transform(kept,
             lambda k: ['stop_broker', 'pause_consumer', 'start_broker', 'change_producer_rate'][k + 1]), ',') AS kept_types,
           len(list_filter(slim, lambda g: len(g) > 0))::BIGINT AS kept_groups,
           (len(plain) - len(kept) + coalesce(list_sum(list_transform(groups, lambda g: len(g))), 0)
             - coalesce(list_sum(list_transform(slim, lambda g: len(g))), 0))::BIGINT AS skipped
    FROM f""")
def f7(spark, sf):
    kinds = F.array(*[F.lit(k) for k in KINDS])

    def incident(n):
        return F.struct(F.element_at(kinds, (F.pmod(n, F.lit(4)) + 1).cast("int")).alias("type"))

    def upto(n):
        full = F.sequence(F.lit(0).cast("bigint"), F.greatest(n - 1, F.lit(0)).cast("bigint"))
        return F.slice(full, F.lit(1), n.cast("int"))

    size = F.col("p_size").cast("bigint")
    scenarios = table(spark, sf, "part").select(
        "p_partkey",
        F.transform(upto(F.pmod("p_partkey", F.lit(5))), lambda i: incident(F.col("p_partkey") + i)).alias("incidents"),
        F.transform(
            upto(F.pmod(size, F.lit(4))),
            lambda g: F.struct(
                F.lit(2).alias("repeat"), F.transform(upto(g + 1), lambda i: incident(size + g * i)).alias("incidents")
            ),
        ).alias("groups"),
    )
    return filter_incidents(scenarios).select(
        "p_partkey", F.array_join("incidents.type", ",").alias("kept_types"),
        F.size("groups").cast("bigint").alias("kept_groups"), "skipped",
    )


@query("f8_visible_to", f"""
    WITH {MSGS}, g AS (
      SELECT topic, topic || '-group-' || n AS group_id,
             min(ts) + INTERVAL 1 DAY * (5 * n) AS joined_at
      FROM msgs, range(1, 4) AS t(n) GROUP BY topic, n)
    SELECT topic, group_id, count(*)::BIGINT AS n, min(row_index) AS first_index
    FROM msgs JOIN g USING (topic) WHERE ts >= joined_at GROUP BY topic, group_id""")
def f8(spark, sf):
    msgs = messages(spark, sf)
    first = msgs.groupBy("topic").agg(F.min("ts").alias("first"))
    groups = with_groups(first, 3).select(
        "topic", "group_id",
        (F.col("first") + F.expr("make_dt_interval(5 * cast(substring_index(group_id, '-', -1) AS INT))")).alias("joined_at"),
    )
    return visible_to(msgs, groups, "latest").groupBy("topic", "group_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("row_index").alias("first_index")
    )
