"""Queries on incident schedules and their effect, with incidents read from suppliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import timeline as tl
from ..operators.routing import FailurePolicy
from .base import MSGS, SEED, START_MICROS, TOPICS, hash_sql, messages, processed, processed_sql, query, table
from .synth import CHANGES, rate_changes

HORIZON = 2_600_000  # seconds; the event table spans 30 days

# Fixed values of the incident model, in the order suppliers are assigned to them.
KINDS = (
    "stop_broker", "start_broker", "pause_consumer", "rebalance_consumer", "increase_consumer_delay",
    "change_producer_rate",
)


def incidents(spark, sf):
    """Every supplier is an incident on one topic: every third periodic, the others once."""
    k = F.col("s_suppkey")
    kinds = F.array(*[F.lit(x) for x in KINDS])
    topics = F.array(*[F.lit(x) for x in TOPICS])
    periodic = F.pmod(k, F.lit(3)) == 0
    return table(spark, sf, "supplier").select(
        k.alias("incident_id"),
        F.element_at(kinds, (F.pmod(F.floor(k / F.lit(3)), F.lit(6)) + 1).cast("int")).alias("type"),
        F.element_at(topics, (F.pmod(k, F.lit(5)) + 1).cast("int")).alias("topic"),
        F.when(~periodic, F.pmod(k * 7919, F.lit(HORIZON + 1000))).alias("at_seconds"),
        F.when(periodic, 86_400 * (1 + F.pmod(k, F.lit(7)))).alias("every_seconds"),
        (F.pmod(k, F.lit(50)) * 600).alias("initial_delay_seconds"),
        (1800 + F.pmod(k, F.lit(30)) * 60).alias("duration_seconds"),
    )


INCIDENTS = f"""incidents AS (
  SELECT s_suppkey AS incident_id,
         list_extract({list(KINDS)}, (s_suppkey // 3) % 6 + 1) AS type,
         list_extract({list(TOPICS)}, s_suppkey % 5 + 1) AS topic,
         CASE WHEN s_suppkey % 3 <> 0 THEN (s_suppkey * 7919) % {HORIZON + 1000} END AS at_seconds,
         CASE WHEN s_suppkey % 3 = 0 THEN 86400 * (1 + s_suppkey % 7) END AS every_seconds,
         (s_suppkey % 50) * 600 AS initial_delay_seconds, 1800 + (s_suppkey % 30) * 60 AS duration_seconds
  FROM supplier),
  firings AS (
    SELECT i.*, n AS firing,
           CASE WHEN every_seconds > 0 THEN initial_delay_seconds + n * (every_seconds
                + CASE type WHEN 'pause_consumer' THEN duration_seconds WHEN 'rebalance_consumer' THEN 5 ELSE 0 END)
                ELSE at_seconds END AS fire
    FROM incidents i, range({HORIZON // 86400 + 2}) AS t(n)
    WHERE every_seconds > 0 OR n = 0)"""


@query("i1_schedule", f"""
    WITH {INCIDENTS}
    SELECT incident_id, type, topic, firing, fire FROM firings WHERE fire <= {HORIZON}""")
def i1(spark, sf):
    return tl.expand_schedule(incidents(spark, sf), HORIZON).select(
        "incident_id", "type", "topic", "firing", "fire"
    )


def group_items(spark, sf):
    """Every conversation is a repeating group, its turns are the items."""
    size = F.length("text").cast("bigint")
    kinds = F.array(*[F.lit(x) for x in KINDS])
    return table(spark, sf, "conversations").select(
        F.col("conv_id").alias("group_id"), F.col("turn").alias("pos"),
        F.element_at(kinds, (F.pmod(size, F.lit(6)) + 1).cast("int")).alias("type"),
        F.when(F.pmod(size, F.lit(4)) != 0, F.pmod(size * 3, F.lit(50))).alias("at_seconds"),
        F.pmod(size, F.lit(40)).alias("duration_seconds"),
        F.when(F.pmod("conv_id", F.lit(7)) != 0, 1 + F.pmod("conv_id", F.lit(5))).alias("repeat"),
        F.when(F.pmod("conv_id", F.lit(11)) != 0, 5 + F.pmod("conv_id", F.lit(60))).alias("interval_seconds"),
    )


@query("i2_groups", f"""
    WITH RECURSIVE items AS (
      SELECT conv_id AS group_id, turn AS pos,
             list_extract({list(KINDS)}, length(text) % 6 + 1) AS type,
             CASE WHEN length(text) % 4 <> 0 THEN (length(text) * 3) % 50 END AS at_seconds,
             length(text) % 40 AS duration, CASE WHEN conv_id % 7 = 0 THEN 1 ELSE 1 + conv_id % 5 END AS repeat,
             CASE WHEN conv_id % 11 = 0 THEN 60 ELSE 5 + conv_id % 60 END AS gap
      FROM conversations),
    ranked AS (
      SELECT *, CASE type WHEN 'pause_consumer' THEN duration WHEN 'rebalance_consumer' THEN 5 ELSE 0 END AS busy,
             row_number() OVER (PARTITION BY group_id ORDER BY pos) - 1 AS k, count(*) OVER (PARTITION BY group_id) AS size
      FROM items),
    run AS (
      SELECT group_id, 0 AS n, 0::BIGINT AS ended, NULL::BIGINT AS cycle, NULL::BIGINT AS pos, NULL::BIGINT AS fire
      FROM ranked WHERE k = 0
      UNION ALL
      SELECT r.group_id, n + 1, f + busy, n // size, r.pos, f
      FROM (
        SELECT run.group_id, n, r.pos, busy, size,
               greatest(ended, CASE WHEN k = 0 THEN (n // size) * gap ELSE 0 END,
                        coalesce((n // size) * gap + at_seconds, 0)) AS f
        FROM run JOIN ranked r ON r.group_id = run.group_id AND r.k = n % r.size
        WHERE n < r.size * r.repeat) r)
    SELECT group_id, cycle, pos, fire FROM run WHERE fire <= 400""")
def i2(spark, sf):
    return tl.expand_groups(group_items(spark, sf), 400).select("group_id", "cycle", "pos", "fire")


def intervals(spark, sf):
    firings = tl.expand_schedule(incidents(spark, sf), HORIZON).withColumnRenamed("topic", "target")
    return tl.effect_intervals(
        firings.select("incident_id", "type", "target", "fire", "duration_seconds"), HORIZON
    )


INTERVALS = f"""{INCIDENTS}, timed AS (
    SELECT incident_id, type, topic AS target, fire, duration_seconds FROM firings WHERE fire <= {HORIZON}),
  lines AS (
    SELECT *, CASE WHEN type LIKE '%_broker' THEN 'broker' ELSE type END AS line FROM timed
    WHERE type NOT IN ('pause_consumer', 'rebalance_consumer')),
  nexts AS (
    SELECT *, lead(fire) OVER (PARTITION BY line, target ORDER BY fire, incident_id) AS next FROM lines),
  intervals AS (
    SELECT incident_id, type, target, fire AS seg_from, least({HORIZON}, seg_to) AS seg_to FROM (
      SELECT *, fire + CASE type WHEN 'rebalance_consumer' THEN 5 ELSE duration_seconds END AS seg_to
      FROM timed WHERE type IN ('pause_consumer', 'rebalance_consumer')
      UNION ALL
      SELECT incident_id, type, target, fire, duration_seconds, coalesce(next, {HORIZON})
      FROM nexts WHERE type <> 'start_broker')
    WHERE least({HORIZON}, seg_to) > fire)"""


@query("i3_effect_intervals", f"""
    WITH {INTERVALS} SELECT incident_id, type, target, seg_from, seg_to FROM intervals""")
def i3(spark, sf):
    return intervals(spark, sf).select("incident_id", "type", "target", "seg_from", "seg_to")


def members(spark, sf):
    topics = F.array(*[F.lit(x) for x in TOPICS])
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("member_id"),
        F.element_at(topics, (F.pmod("c_nationkey", F.lit(5)) + 1).cast("int")).alias("topic"),
        F.col("c_mktsegment").alias("group_id"),
    )


MEMBERS = f"""members AS (
  SELECT c_custkey AS member_id, list_extract({list(TOPICS)}, c_nationkey % 5 + 1) AS topic,
         c_mktsegment AS group_id, {hash_sql("'target'", 'c_custkey')} AS h
  FROM customer)"""


@query("i4_target_percentage", f"""
    WITH {MEMBERS}, hit AS (
      SELECT *, row_number() OVER (ORDER BY h, member_id) AS r, count(*) OVER () AS n FROM members
      WHERE topic = 'click')
    SELECT member_id, topic, group_id FROM hit WHERE r <= greatest(1, n * 30 // 100)""")
def i4(spark, sf):
    return tl.select_target(members(spark, sf), {"topic": "click", "percentage": 30}, SEED)


@query("i4_target_count", f"""
    WITH {MEMBERS}
    SELECT member_id, topic, group_id FROM members WHERE topic = 'view' AND group_id = 'BUILDING'
    ORDER BY h, member_id LIMIT 25""")
def i4_count(spark, sf):
    target = {"topic": "view", "group": "BUILDING", "count": 25, "percentage": 90}
    return tl.select_target(members(spark, sf), target, SEED)


@query("i4_rebalance_pick", f"""
    WITH {MEMBERS}
    SELECT member_id, topic, group_id FROM members WHERE group_id = 'BUILDING'
    ORDER BY {hash_sql("'rebalance'", 'member_id')}, member_id LIMIT 1""")
def i4_pick(spark, sf):
    return tl.pick_one(tl.select_target(members(spark, sf), {"group": "BUILDING"}, SEED), SEED)


def on_topics(spark, sf):
    """Effect intervals on the clock of the event table, by topic."""
    return tl.on_clock(intervals(spark, sf), F.lit(START_MICROS)).withColumnRenamed("target", "topic")


CLOCK = f"""{MSGS}, {INTERVALS}, onclock AS (
  SELECT incident_id, type, target AS topic, {START_MICROS} + seg_from * 1000000 AS a,
         {START_MICROS} + seg_to * 1000000 AS b
  FROM intervals)"""


@query("i5_annotate", f"""
    WITH {CLOCK}
    SELECT m.topic, row_index, string_agg(DISTINCT incident_id, ',' ORDER BY incident_id) AS incidents
    FROM msgs m LEFT JOIN onclock i ON i.topic = m.topic AND epoch_us(m.ts) >= a AND epoch_us(m.ts) < b
    GROUP BY m.topic, row_index""")
def i5(spark, sf):
    marked = tl.annotate(messages(spark, sf), on_topics(spark, sf), ["topic"])
    return marked.select(
        "topic", "row_index", F.array_join(F.col("incidents").cast("array<string>"), ",").alias("incidents")
    )


@query("i6_asof_rate", f"""
    WITH {MSGS}, {CHANGES}
    SELECT m.topic, row_index, coalesce(rate, 1000.0::DOUBLE) AS rate
    FROM (SELECT *, epoch_us(ts) AS us FROM msgs) m
    ASOF LEFT JOIN (SELECT * FROM changes WHERE topic <> 'view') c ON m.topic = c.topic AND m.us >= c.at_micros""")
def i6(spark, sf):
    # One topic never changes and keeps the default.
    changes = rate_changes(spark, sf).where(F.col("topic") != "view")
    placed = tl.asof_setting(
        messages(spark, sf), changes.withColumnRenamed("rate", "setting"), ["topic"], 1000.0, "rate"
    )
    return placed.select("topic", "row_index", "rate")


PAUSED = f"""{CLOCK}, paused AS (
  SELECT row_index FROM msgs m WHERE EXISTS (
    SELECT 1 FROM onclock i WHERE i.topic = m.topic AND i.type = 'pause_consumer'
      AND epoch_us(m.ts) >= a AND epoch_us(m.ts) < b))"""


def pauses(spark, sf):
    return on_topics(spark, sf).where(F.col("type") == "pause_consumer")


@query("i7_outside_pauses", f"""
    WITH {PAUSED} SELECT topic, row_index FROM msgs WHERE row_index NOT IN (SELECT row_index FROM paused)""")
def i7(spark, sf):
    return tl.outside(messages(spark, sf).select("topic", "row_index", "ts"), pauses(spark, sf), ["topic"]).drop("ts")


@query("i7_inside_pauses", f"""
    WITH {PAUSED} SELECT topic, row_index FROM msgs WHERE row_index IN (SELECT row_index FROM paused)""")
def i7_inside(spark, sf):
    msgs = messages(spark, sf).select("topic", "row_index", "ts")
    return tl.outside(msgs, pauses(spark, sf), ["topic"], inside=True).drop("ts")


POLICY = FailurePolicy(failure_rate=0.15, on_failure="dlq")


@query("i8_impact", f"""
    WITH {CLOCK}, {processed_sql(POLICY, 1)},
    p AS (
      SELECT incident_id, topic, 'before' AS phase, a - 7200000000 AS x, a AS y FROM onclock
      UNION ALL SELECT incident_id, topic, 'during', a, b FROM onclock
      UNION ALL SELECT incident_id, topic, 'after', b, b + 7200000000 FROM onclock),
    spans AS (SELECT incident_id, phase, sum(y - x) AS micros FROM p GROUP BY ALL),
    hits AS (
      SELECT incident_id, phase, row_index, failures
      FROM p JOIN processed m ON m.topic = p.topic AND epoch_us(ts) >= x AND epoch_us(ts) < y),
    sums AS (SELECT incident_id, phase, count(*) AS n, count(*) FILTER (failures > 0) AS failed FROM hits GROUP BY ALL)
    SELECT phase, incident_id::VARCHAR AS incident_id, coalesce(n, 0) AS messages, coalesce(failed, 0) AS failed,
           round(coalesce(n, 0) * 1000000.0::DOUBLE / micros, 6) AS messages_per_second
    FROM spans LEFT JOIN sums USING (incident_id, phase)""")
def i8(spark, sf):
    return tl.impact(processed(messages(spark, sf), POLICY, 1), on_topics(spark, sf), ["topic"], 7200)
