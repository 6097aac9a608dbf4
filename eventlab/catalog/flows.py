"""Queries on correlated flows, over orders and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.draw import u
from ..operators.flows import (
    RANK_ERROR, Flow, Step, correlate, delay_counts, flow_messages, flow_status, flow_violations, latency_quantiles, latency_sketches,
    step_latency,
)
from ..plans.sizing import settle
from ..plans.spec import fields_of
from ..sources.tables import spread
from .base import SEED, hash_sql, pick_sql, query, table, u_sql, uuid_sql

FLOW_NAME = "checkout"

CHECKOUT = Flow(
    FLOW_NAME,
    steps=(
        Step("orders", "order_created", 70, tuple(fields_of([
            {"name": "order_id", "type": "uuid"},
            {"name": "amount", "type": "int", "min": 10, "max": 500},
        ]))),
        Step("payments", "payment_started", 200, tuple(fields_of([{"name": "payment_id", "type": "uuid"}]))),
        Step("payments", "payment_done", 500, tuple(fields_of([
            {"name": "status", "type": "enum", "values": ["success", "success", "success", "failed"]},
        ]))),
        Step("inventory", "stock_reserved", 100),
        Step("shipping", "shipment_created", 1000, tuple(fields_of([{"name": "express", "type": "boolean"}]))),
        Step("notifications", "customer_notified", 200),
    ),
    rate=50.0,
)
LAST_STEP = len(CHECKOUT.steps) - 1
BY_ORDER = Flow("by-order", CHECKOUT.steps, correlation=("field_ref", "order_id"))


def flow_table(spark, sf, flow=CHECKOUT):
    return flow_messages(spread(table(spark, sf, "orders")), flow, SEED, "o_orderkey", "o_orderdate")


def _flow_sql(name: str, correlation: str) -> str:
    def path(step, field):
        return f"'{name}/{step}/{field}'"

    order_id = uuid_sql(hash_sql(path(0, "order_id"), "row_index"))
    payment_id = uuid_sql(hash_sql(path(1, "payment_id"), "row_index"))
    status = pick_sql(u_sql(path(2, "status"), "row_index"), 1, 4)
    return f"""flow_steps(step, topic, event_type, delay_ms) AS (VALUES
    (0, 'orders', 'order_created', 0), (1, 'payments', 'payment_started', 200),
    (2, 'payments', 'payment_done', 700), (3, 'inventory', 'stock_reserved', 800),
    (4, 'shipping', 'shipment_created', 1800), (5, 'notifications', 'customer_notified', 2000)),
  flow_base AS (
    SELECT o_orderkey AS row_index, o_orderdate, {order_id.replace('row_index', 'o_orderkey')} AS order_id,
           {uuid_sql(hash_sql(f"'{name}/correlation'", 'o_orderkey'))} AS drawn_id
    FROM orders),
  flow_msgs AS (
    SELECT '{name}' AS flow, topic, {correlation} AS correlation_id, step, event_type, row_index,
           o_orderdate + INTERVAL 1 MILLISECOND * delay_ms AS ts,
           '{{"correlation_id":"' || {correlation} || '","event_type":"' || event_type || '"' ||
           CASE step
             WHEN 0 THEN ',"order_id":"' || order_id || '","amount":' || {pick_sql(u_sql(path(0, "amount"), 'row_index'), 10, 500)}
             WHEN 1 THEN ',"payment_id":"' || {payment_id} || '"'
             WHEN 2 THEN ',"status":"' || CASE WHEN {status} = 4 THEN 'failed' ELSE 'success' END || '"'
             WHEN 4 THEN ',"express":' || ({u_sql(path(4, "express"), 'row_index')} < 0.5)
             ELSE '' END || '}}' AS value
    FROM flow_base, flow_steps)"""


FLOW_SQL = _flow_sql(FLOW_NAME, "drawn_id")


@query("l1_flow_messages", f"""
    WITH {FLOW_SQL}
    SELECT flow, topic, correlation_id, step, event_type, epoch_us(ts) AS micros, row_index FROM flow_msgs""")
def l1(spark, sf):
    return flow_table(spark, sf).select(
        "flow", "topic", "correlation_id", "step", "event_type",
        F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"), "row_index",
    )


@query("l2_correlation_field_ref", f"""
    WITH {_flow_sql('by-order', 'order_id')}
    SELECT row_index, correlation_id, count(*)::BIGINT AS messages, min(value) AS first_value
    FROM flow_msgs GROUP BY row_index, correlation_id""")
def l2(spark, sf):
    return flow_table(spark, sf, BY_ORDER).groupBy("row_index", "correlation_id").agg(
        F.count(F.lit(1)).alias("messages"), F.min("value").alias("first_value")
    )


@query("l3_step_payloads", f"""
    WITH {FLOW_SQL} SELECT row_index, step, value FROM flow_msgs""")
def l3(spark, sf):
    return flow_table(spark, sf).select("row_index", "step", "value")


# Messages that got lost, arrived late, or were sent twice.
def disturbed(msgs):
    number = F.col("row_index") * 10 + F.col("step")
    kept = msgs.where(u(SEED, "lost", number) >= 0.05)
    shift = (F.floor(u(SEED, "late", number) * 400) * 1000).cast("bigint")
    return kept.withColumn("ts", F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + shift))


DISTURBED = f"""{FLOW_SQL}, disturbed AS (
  SELECT correlation_id, step, row_index,
         epoch_us(ts) + floor({u_sql("'late'", '(row_index * 10 + step)')} * 400)::BIGINT * 1000 AS seen_at
  FROM flow_msgs WHERE {u_sql("'lost'", '(row_index * 10 + step)')} >= 0.05)"""


@query("l4_flow_status", f"""
    WITH {DISTURBED}, s AS (
      SELECT correlation_id, count(*) AS messages, list_sort(list(DISTINCT step)) AS seen
      FROM disturbed GROUP BY correlation_id)
    SELECT correlation_id, messages, array_to_string(seen, ',') AS seen,
           array_to_string(list_filter(range(6), lambda x: NOT list_contains(seen, x)), ',') AS missing,
           len(seen) = 6 AS complete
    FROM s""")
def l4(spark, sf):
    status = flow_status(disturbed(flow_table(spark, sf)), CHECKOUT)
    return status.withColumn("seen", F.array_join(F.col("seen").cast("array<string>"), ",")).withColumn(
        "missing", F.array_join(F.col("missing").cast("array<string>"), ",")
    )


@query("l5_step_latency", f"""
    WITH {DISTURBED}, f AS (
      SELECT correlation_id, step, min(seen_at) AS seen_at FROM disturbed GROUP BY correlation_id, step),
    g AS (SELECT b.step, b.seen_at - a.seen_at AS gap FROM f b JOIN f a ON a.correlation_id = b.correlation_id AND a.step = b.step - 1),
    r AS (SELECT *, row_number() OVER (PARTITION BY step ORDER BY gap) AS k, count(*) OVER (PARTITION BY step) AS n FROM g)
    SELECT step, list_extract([200, 500, 100, 1000, 200], step)::BIGINT AS configured_ms, any_value(n) AS n,
           min(gap) AS min_micros, max(gap) AS max_micros, round(sum(gap) / any_value(n)::DOUBLE, 3) AS avg_micros,
           min(gap) FILTER (k = ceil(n * 0.5::DOUBLE)) AS p50_micros,
           min(gap) FILTER (k = ceil(n * 0.95::DOUBLE)) AS p95_micros
    FROM r GROUP BY step""")
def l5(spark, sf):
    return step_latency(disturbed(flow_table(spark, sf)), CHECKOUT)


SHARES = {"p50": 0.5, "p95": 0.95}


# Quantiles of merged sketches: the share of delays up to each is off by a hundredth at most.
@query("l5_latency_sketches", f"""
    WITH {DISTURBED}, f AS (
      SELECT correlation_id, step, min(seen_at) AS seen_at FROM disturbed GROUP BY correlation_id, step)
    SELECT b.step, count(*) AS n, true AS p50_close, true AS p95_close
    FROM f b JOIN f a ON a.correlation_id = b.correlation_id AND a.step = b.step - 1 GROUP BY b.step""")
def l5_sketches(spark, sf):
    msgs = disturbed(flow_table(spark, sf))
    stored = settle(latency_sketches(msgs, CHECKOUT, 30 * 86_400), "latencies")
    found = latency_quantiles(stored, ["step"], SHARES)
    exact = delay_counts(msgs, CHECKOUT).join(F.broadcast(found), "step")  # one row a step
    sums = exact.groupBy("step", found["n"].alias("n")).agg(*[
        F.sum(F.when(cond, F.col("rows")).otherwise(0)).alias(f"{name}_{side}")
        for name in SHARES for side, cond in (("upto", F.col("gap") <= F.col(name)), ("below", F.col("gap") < F.col(name)))])
    close = lambda name, q: ((F.col(f"{name}_upto") >= (q - RANK_ERROR) * F.col("n")) & (F.col(f"{name}_below") <= (q + RANK_ERROR) * F.col("n"))).alias(f"{name}_close")
    return sums.select("step", "n", *[close(name, q) for name, q in SHARES.items()])


@query("l6_correlate", """
    WITH a AS (SELECT user_id, ts, count(*) AS a_rows FROM events WHERE event_type = 'view' GROUP BY ALL),
    m AS (
      SELECT a.user_id, a.ts, any_value(a_rows) AS a_rows, min(b.ts) AS b_ts
      FROM a LEFT JOIN events b ON b.event_type = 'purchase' AND b.user_id = a.user_id
        AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 12 HOUR
      GROUP BY a.user_id, a.ts)
    SELECT user_id, epoch_us(ts) AS a_micros, a_rows, epoch_us(b_ts) AS b_micros,
           epoch_us(b_ts) - epoch_us(ts) AS gap_micros
    FROM m""")
def l6(spark, sf):
    events = table(spark, sf, "events")
    views, buys = (events.where(F.col("event_type") == t) for t in ("view", "purchase"))
    return correlate(views, buys, 12 * 3600, key="user_id")


@query("v8_flow_violations", f"""
    WITH {DISTURBED}, p AS (
      SELECT correlation_id, {', '.join(f'min(seen_at) FILTER (step = {s}) AS t{s}' for s in range(6))}
      FROM disturbed GROUP BY correlation_id)
    SELECT correlation_id, 'first step missing' AS rule FROM p WHERE t0 IS NULL
    {' '.join(f"UNION ALL SELECT correlation_id, 'step {s} out of order' FROM p "
              f"WHERE t{s} < list_max([{', '.join(f't{q}' for q in range(s))}])" for s in range(1, 6))}
    {' '.join(f"UNION ALL SELECT correlation_id, 'step {s - 1} skipped' FROM p "
              f"WHERE t{s} IS NOT NULL AND t{s - 1} IS NULL" for s in range(1, 6))}""")
def v8(spark, sf):
    return flow_violations(disturbed(flow_table(spark, sf)), CHECKOUT)
