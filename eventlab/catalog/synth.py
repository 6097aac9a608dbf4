"""Queries on generated columns, keys, payloads, event times and duplicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fields as fx
from ..functions.keys import key_col, partition_col
from ..functions.payloads import fixed_payload, json_payload, json_value, random_payload
from ..operators.synth import (
    TopicSpec, inject_duplicates, lookup_col, lookup_values, rows, send_position, synth_messages,
    synth_table, zipf_key,
)
from ..operators.timing import event_micros, with_rate_schedule
from ..plans.spec import Field, fields_of, spark_schema
from ..sources.tables import spread
from .base import (
    MSGS, PARTITIONS, SEED, START_MICROS, TOPICS, hash_sql, letters_sql, messages, partition_sql, pick_sql, query,
    table, u_sql, uuid_sql,
)

def event_index():
    return F.col("event_id")


@query("c1_row_index", """
    SELECT event_type, count(*)::BIGINT AS n, sum(event_id)::BIGINT AS index_sum
    FROM events GROUP BY event_type""")
def c1(spark, sf):
    events = table(spark, sf, "events")
    made = rows(spark, events.count())
    return made.join(
        events.select(F.col("event_id").alias("row_index"), "event_type"), "row_index", "left"
    ).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("row_index").alias("index_sum"))


def _string_sql(path: str, idx: str, low: int, high: int) -> str:
    parts = [letters_sql(hash_sql(path, idx), 14)]
    for chunk in range(1, 1 + max(0, -(-(high - 10) // 20))):
        h = hash_sql(path, idx, f"'{chunk}'")
        parts += [letters_sql(h, 1), letters_sql(h, 16)]
    length = pick_sql(u_sql(path, idx), low, high)
    return f"substr({' || '.join(parts)}, 1, {length})"


@query("g1_string", f"""
    SELECT event_id, {_string_sql("'name'", 'event_id', 5, 20)} AS short_text,
           {_string_sql("'long'", 'event_id', 0, 64)} AS long_text
    FROM events""")
def g1(spark, sf):
    return table(spark, sf, "events").select(
        "event_id",
        fx.string_col(SEED, "name", event_index()).alias("short_text"),
        fx.string_col(SEED, "long", event_index(), 0, 64).alias("long_text"),
    )


@query("g2_string_cardinality", f"""
    WITH p AS (SELECT event_id, event_id % 500 AS pos FROM events),
    t AS (
      SELECT event_id, pos, {pick_sql(u_sql("'customer_id'", 'pos'), 5, 8)} AS len,
             {letters_sql(hash_sql("'customer_id'", 'pos'), 14)} AS letters FROM p)
    SELECT event_id, substr(letters, 1, len - 2) || chr((97 + pos // 26)::INTEGER)
           || chr((97 + pos % 26)::INTEGER) AS customer_id
    FROM t""")
def g2(spark, sf):
    return table(spark, sf, "events").select(
        "event_id", fx.string_col(SEED, "customer_id", event_index(), 5, 8, 500).alias("customer_id")
    )


@query("g3_int", f"""
    SELECT l_orderkey, l_linenumber, {pick_sql(u_sql("'quantity'", 'l_orderkey'), 1, 10)} AS quantity
    FROM lineitem""")
def g3(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", fx.int_col(SEED, "quantity", F.col("l_orderkey"), 1, 10).alias("quantity")
    )


_STEP, _SHIFT = fx.spread_params(SEED, "user_number", 1000, 9999, 300)


@query("g4_int_cardinality", f"""
    SELECT event_id, (1000 + ((event_id % 300) * {_STEP} + {_SHIFT}) % 9000)::BIGINT AS user_number
    FROM events""")
def g4(spark, sf):
    return table(spark, sf, "events").select(
        "event_id", fx.int_col(SEED, "user_number", event_index(), 1000, 9999, 300).alias("user_number")
    )


@query("g5_float", f"""
    SELECT o_orderkey, round(10.0::DOUBLE + {u_sql("'amount'", 'o_orderkey')} * 990.0::DOUBLE, 2) AS amount
    FROM orders""")
def g5(spark, sf):
    return table(spark, sf, "orders").select(
        "o_orderkey", fx.float_col(SEED, "amount", F.col("o_orderkey"), 10, 1000).alias("amount")
    )


@query("g6_boolean", f"""
    SELECT event_id, {u_sql("'active'", 'event_id')} < 0.5 AS active FROM events""")
def g6(spark, sf):
    return table(spark, sf, "events").select("event_id", fx.boolean_col(SEED, "active", event_index()).alias("active"))


@query("g7_uuid", f"""
    SELECT o_orderkey, {uuid_sql(hash_sql("'order_id'", 'o_orderkey'))} AS order_id FROM orders""")
def g7(spark, sf):
    return table(spark, sf, "orders").select(
        "o_orderkey", fx.uuid_col(SEED, "order_id", F.col("o_orderkey")).alias("order_id")
    )


@query("g8_timestamp", "SELECT event_id, epoch_us(ts) // 1000 AS created_at FROM events")
def g8(spark, sf):
    return table(spark, sf, "events").select("event_id", fx.timestamp_col(F.col("ts")).alias("created_at"))


@query("g9_enum_weighted", f"""
    SELECT event_id,
           list_extract(['success', 'success', 'success', 'failed'],
                        {pick_sql(u_sql("'status'", 'event_id'), 1, 4)}) AS status
    FROM events""")
def g9(spark, sf):
    values = ["success", "success", "success", "failed"]
    return table(spark, sf, "events").select("event_id", fx.enum_col(SEED, "status", event_index(), values).alias("status"))


ADDRESS_FIELDS = fields_of([
    {"name": "zip", "type": "int", "min": 10000, "max": 99999},
    {"name": "country", "type": "enum", "values": ["DE", "FR", "US"]},
    {"name": "geo", "type": "object", "fields": [
        {"name": "lat", "type": "float", "min": -90, "max": 90},
        {"name": "fixed", "type": "boolean"},
    ]},
])


@query("g10_object", f"""
    SELECT event_id, {pick_sql(u_sql("'address.zip'", 'event_id'), 10000, 99999)} AS zip,
           list_extract(['DE', 'FR', 'US'], {pick_sql(u_sql("'address.country'", 'event_id'), 1, 3)}) AS country,
           round(-90.0::DOUBLE + {u_sql("'address.geo.lat'", 'event_id')} * 180.0::DOUBLE, 2) AS lat,
           {u_sql("'address.geo.fixed'", 'event_id')} < 0.5 AS fixed
    FROM events""")
def g10(spark, sf):
    made = table(spark, sf, "events").select(
        "event_id", fx.object_col(SEED, "address", event_index(), ADDRESS_FIELDS).alias("address")
    )
    return made.select("event_id", "address.zip", "address.country", "address.geo.lat", "address.geo.fixed")


ITEM = Field.of({"name": "item", "type": "object", "fields": [
    {"name": "product_id", "type": "uuid"},
    {"name": "quantity", "type": "int", "min": 1, "max": 10},
]})


@query("g11_array", f"""
    WITH n AS (SELECT event_id, {pick_sql(u_sql("'items'", 'event_id'), 0, 5)} AS size FROM events),
    e AS (SELECT event_id, size, unnest(range(greatest(size, 1))) AS j FROM n)
    SELECT event_id, size, j,
           CASE WHEN size > 0 THEN {uuid_sql(hash_sql("'items[' || j || '].product_id'", 'event_id'))} END AS product_id,
           CASE WHEN size > 0 THEN {pick_sql(u_sql("'items[' || j || '].quantity'", 'event_id'), 1, 10)} END AS quantity
    FROM e""")
def g11(spark, sf):
    made = table(spark, sf, "events").select(
        "event_id", fx.array_col(SEED, "items", event_index(), ITEM, 0, 5).alias("items")
    )
    size = F.size("items").cast("bigint").alias("size")
    out = made.select("event_id", size, F.posexplode_outer("items").alias("j", "x"))
    return out.select(
        "event_id", "size", F.coalesce("j", F.lit(0)).cast("bigint").alias("j"), "x.product_id", "x.quantity"
    )


@query("g12_lookup", f"""
    WITH n AS (SELECT count(*)::DOUBLE AS n FROM customer)
    SELECT event_id, c_name AS name
    FROM events, n JOIN customer ON c_custkey = floor({u_sql("'name'", 'event_id')} * n)::BIGINT""")
def g12(spark, sf):
    values = lookup_values(table(spark, sf, "customer"), F.col("c_name"), "c_custkey", "name", "en")
    events = table(spark, sf, "events").select("event_id")
    return lookup_col(events, "name", values, "name", "en", SEED, idx="event_id")


ORDER_FIELDS = fields_of([
    {"name": "order_id", "type": "uuid"},
    {"name": "customer_id", "type": "int", "min": 1, "max": 9999, "cardinality": 500},
    {"name": "amount", "type": "float", "min": 10, "max": 1000},
    {"name": "status", "type": "enum", "values": ["pending", "confirmed", "shipped"]},
    {"name": "created_at", "type": "timestamp"},
    {"name": "clerk", "type": "faker", "provider": "name"},
])
_ORDER_STEP, _ORDER_SHIFT = fx.spread_params(SEED, "customer_id", 1, 9999, 500)
ORDER_SQL = f"""
    {uuid_sql(hash_sql("'order_id'", 'o_orderkey'))} AS order_id,
    (1 + ((o_orderkey % 500) * {_ORDER_STEP} + {_ORDER_SHIFT}) % 9999)::BIGINT AS customer_id,
    round(10.0::DOUBLE + {u_sql("'amount'", 'o_orderkey')} * 990.0::DOUBLE, 2) AS amount,
    list_extract(['pending', 'confirmed', 'shipped'], {pick_sql(u_sql("'status'", 'o_orderkey'), 1, 3)}) AS status,
    epoch_us(o_orderdate) // 1000 AS created_at"""


@query("g13_synth_table", f"""
    WITH n AS (SELECT count(*)::DOUBLE AS n FROM supplier)
    SELECT o_orderkey, {ORDER_SQL}, s_name AS clerk
    FROM orders, n JOIN supplier ON s_suppkey = floor({u_sql("'clerk'", 'o_orderkey')} * n)::BIGINT""")
def g13(spark, sf):
    values = lookup_values(table(spark, sf, "supplier"), F.col("s_name"), "s_suppkey", "name")
    return synth_table(
        spread(table(spark, sf, "orders")), ORDER_FIELDS, SEED, "o_orderkey", "o_orderdate", values,
        keep=["o_orderkey"],
    )


CART_FIELDS = fields_of([
    {"name": "lines", "type": "array", "min_items": 0, "max_items": 4, "items": {"type": "object", "fields": [
        {"name": "part", "type": "faker", "provider": "part"}, {"name": "quantity", "type": "int", "min": 1, "max": 9}]}},
])


@query("g13_array_lookup", f"""
    WITH v AS (SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS pos, p_name FROM part),
    n AS (SELECT o_orderkey, {pick_sql(u_sql("'lines'", 'o_orderkey'), 0, 4)} AS size, (SELECT count(*) FROM part)::DOUBLE AS parts FROM orders),
    e AS (SELECT *, unnest(range(size)) AS j FROM n)
    SELECT o_orderkey, j, p_name AS part, {pick_sql(u_sql("'lines[' || j || '].quantity'", 'o_orderkey'), 1, 9)} AS quantity
    FROM e JOIN v ON pos = floor({u_sql("'lines[' || j || '].part'", 'o_orderkey')} * parts)::BIGINT""")
def g13_array(spark, sf):
    values = lookup_values(table(spark, sf, "part"), F.col("p_name"), "p_partkey", "part")
    made = synth_table(
        spread(table(spark, sf, "orders").select("o_orderkey")), CART_FIELDS, SEED, "o_orderkey", lookups=values, keep=["o_orderkey"],
    )
    out = made.select("o_orderkey", F.posexplode("lines").alias("j", "x"))
    return out.select("o_orderkey", F.col("j").cast("bigint").alias("j"), "x.part", "x.quantity")


@query("g14_spark_schema", f"""
    SELECT o_orderkey, order_id, customer_id, amount, status, created_at FROM (SELECT o_orderkey, {ORDER_SQL} FROM orders)""")
def g14(spark, sf):
    fields = [f for f in ORDER_FIELDS if f.type != "faker"]
    made = synth_table(
        spread(table(spark, sf, "orders")), fields, SEED, "o_orderkey", "o_orderdate", keep=["o_orderkey"]
    )
    text = made.select("o_orderkey", json_value(*[f.name for f in fields]).alias("value"))
    return text.select("o_orderkey", F.from_json("value", spark_schema(fields)).alias("v")).select("o_orderkey", "v.*")


# --- keys --------------------------------------------------------------------


@query("k1_uniform_key", f"""
    SELECT event_id, 'key-' || {pick_sql(u_sql("'key'", 'event_id'), 0, 49)} AS key FROM events""")
def k1(spark, sf):
    return table(spark, sf, "events").select("event_id", key_col("uniform", SEED, event_index(), 50).alias("key"))


def _zipf_sql(table_name: str, idx: str, cardinality: int) -> str:
    scale = 1 << 51
    return f"""
    WITH w AS (
      SELECT i, greatest(1, floor({scale}::DOUBLE / pow(i + 1.0::DOUBLE, 1.5::DOUBLE))::BIGINT) AS w
      FROM range({cardinality}) AS t(i)),
    s AS (SELECT i, (sum(w) OVER (ORDER BY i) - w)::DOUBLE AS lo, (sum(w) OVER (ORDER BY i))::DOUBLE AS hi,
                 (sum(w) OVER ())::DOUBLE AS total FROM w),
    c AS (SELECT i, lo / total AS lo, hi / total AS hi FROM s),
    d AS (SELECT {idx}, {u_sql("'key'", idx)} AS x FROM {table_name})
    SELECT {idx}, 'key-' || i AS key FROM d JOIN c ON x >= lo AND x < hi"""


@query("k2_zipf_key", _zipf_sql("events", "event_id", 50))
def k2(spark, sf):
    return zipf_key(table(spark, sf, "events").select("event_id"), 50, 1.5, SEED, "event_id")


@query("k2_zipf_key_large", _zipf_sql("orders", "o_orderkey", 5000))
def k2_large(spark, sf):
    return zipf_key(spread(table(spark, sf, "orders").select("o_orderkey")), 5000, 1.5, SEED, "o_orderkey")


@query("k3_single_key", "SELECT 'hot-key' AS key, count(*)::BIGINT AS n FROM events")
def k3(spark, sf):
    return table(spark, sf, "events").select(key_col("single_key", SEED, event_index()).alias("key")).groupBy("key").agg(
        F.count(F.lit(1)).alias("n")
    )


@query("k4_round_robin_key", "SELECT event_id, 'key-' || (event_id % 50) AS key FROM events")
def k4(spark, sf):
    return table(spark, sf, "events").select("event_id", key_col("round_robin", SEED, event_index(), 50).alias("key"))


@query("k5_partition", f"""
    SELECT c_custkey, {partition_sql('c_name')} AS "partition" FROM customer""")
def k5(spark, sf):
    return table(spark, sf, "customer").select(
        "c_custkey", partition_col(F.col("c_name"), PARTITIONS).alias("partition")
    )


# --- payloads ----------------------------------------------------------------


def _padded_sql(idx: str, millis: str, low: int, high: int) -> str:
    text = (
        f"'{{\"id\": \"msg-' || ({idx} + 1) || '\", \"timestamp\": ' || {millis} || "
        f"', \"sequence\": ' || ({idx} + 1)"
    )
    room = f"({pick_sql(u_sql(chr(39) + 'size' + chr(39), idx), low, high)} - length({text}) - 21)"
    return (
        f"{text} || CASE WHEN {room} > 0 THEN ', \"data\": \"' || repeat('x', {room}) || '\"' ELSE '' END || '}}'"
    )


@query("p1_json_payload", f"""
    SELECT event_id, {_padded_sql('event_id', '(epoch_us(ts) // 1000)', 60, 300)} AS value FROM events""")
def p1(spark, sf):
    return table(spark, sf, "events").select(
        "event_id", json_payload(SEED, event_index(), F.col("ts"), 60, 300).alias("value")
    )


@query("p2_random_payload", f"""
    SELECT event_id, substr(array_to_string(list_transform(range(7),
             lambda c: {hash_sql("'bytes'", 'event_id', 'c')}), ''), 1,
             2 * {pick_sql(u_sql("'bytes-size'", 'event_id'), 10, 100)}) AS hex_value
    FROM events""")
def p2(spark, sf):
    made = random_payload(SEED, event_index(), 10, 100)
    return table(spark, sf, "events").select("event_id", F.lower(F.hex(made)).alias("hex_value"))


@query("p3_fixed_payload", """
    SELECT event_id, 'msg-' || (event_id + 1) || '-'
           || repeat('x', greatest(0, 32 - length('msg-' || (event_id + 1) || '-'))) AS value
    FROM events""")
def p3(spark, sf):
    return table(spark, sf, "events").select("event_id", fixed_payload(event_index(), 32).alias("value"))


@query("p4_json_value", """
    SELECT o_orderkey, '{"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus
           || '","customer":{"id":' || o_custkey || '},"note":null}' AS value
    FROM orders""")
def p4(spark, sf):
    note = F.lit(None).cast("string").alias("note")
    customer = F.struct(F.col("o_custkey").alias("id")).alias("customer")
    return table(spark, sf, "orders").select(
        "o_orderkey", json_value("o_orderkey", "o_orderstatus", customer, note).alias("value")
    )


SIZED = TopicSpec("metrics", partitions=6, key_distribution="round_robin", key_cardinality=40)
STRUCTURED = TopicSpec("orders", fields=tuple(f for f in ORDER_FIELDS if f.type not in ("float", "faker")))


P5_SIZED_SQL = f"""
    SELECT 'metrics' AS topic, {partition_sql("'key-' || (event_id % 40)", 6)} AS "partition",
           'key-' || (event_id % 40) AS key, {_padded_sql('event_id', '(epoch_us(ts) // 1000)', 200, 500)} AS value,
           event_id AS row_index
    FROM events"""


@query("p5_messages_sized", P5_SIZED_SQL)
def p5_sized(spark, sf):
    return synth_messages(spread(table(spark, sf, "events")), SIZED, SEED, "event_id", "ts").drop("ts")


@query("p5_messages_structured", f"""
    WITH o AS (SELECT o_orderkey, {ORDER_SQL},
                      'key-' || {pick_sql(u_sql("'key'", 'o_orderkey'), 0, 49)} AS key FROM orders)
    SELECT 'orders' AS topic, {partition_sql('key')} AS "partition", key, o_orderkey AS row_index,
           '{{"order_id":"' || order_id || '","customer_id":' || customer_id || ',"status":"' || status
           || '","created_at":' || created_at || '}}' AS value
    FROM o""")
def p5_structured(spark, sf):
    return synth_messages(spread(table(spark, sf, "orders")), STRUCTURED, SEED, "o_orderkey", "o_orderdate").drop("ts")


# --- event times and duplicates ----------------------------------------------


@query("e1_event_time", f"""
    SELECT event_id, {START_MICROS} + floor(event_id * 1000000.0::DOUBLE / 300.0::DOUBLE)::BIGINT AS sent_micros
    FROM events""")
def e1(spark, sf):
    return table(spark, sf, "events").select(
        "event_id", event_micros(START_MICROS, event_index(), 300.0).alias("sent_micros")
    )


def rate_changes(spark, sf):
    """Every supplier changes the rate of one topic; each topic has a change at the start."""
    k = F.col("s_suppkey")
    topics = F.array(*[F.lit(t) for t in TOPICS])
    return table(spark, sf, "supplier").select(
        F.element_at(topics, (F.pmod(k, F.lit(5)) + 1).cast("int")).alias("topic"),
        (F.lit(START_MICROS) + F.floor(k / F.lit(5)) * 3_600_000_000).alias("at_micros"),
        (F.pmod(k, F.lit(4)) / F.lit(1024.0)).alias("rate"),
    )


CHANGES = f"""changes AS (
  SELECT list_extract(['click', 'error', 'purchase', 'signup', 'view'], s_suppkey % 5 + 1) AS topic,
         {START_MICROS} + (s_suppkey // 5) * 3600000000 AS at_micros, (s_suppkey % 4) / 1024.0::DOUBLE AS rate
  FROM supplier)"""


@query("e2_rate_schedule", f"""
    WITH {MSGS}, {CHANGES},
    s AS (SELECT *, lead(at_micros) OVER w AS until FROM changes WINDOW w AS (PARTITION BY topic ORDER BY at_micros)),
    d AS (SELECT *, rate * (until - at_micros) / 1000000.0::DOUBLE AS due FROM s),
    b AS (SELECT *, coalesce(sum(due) OVER (PARTITION BY topic ORDER BY at_micros
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d),
    p AS (SELECT topic, row_index, row_number() OVER (PARTITION BY topic ORDER BY row_index) - 1 AS position FROM msgs)
    SELECT p.topic, row_index, position,
           at_micros + floor((position - before) * 1000000.0::DOUBLE / rate)::BIGINT AS sent_micros
    FROM p LEFT JOIN b ON p.topic = b.topic AND rate > 0 AND position >= before
      AND (until IS NULL OR position < before + due)""")
def e2(spark, sf):
    placed = send_position(messages(spark, sf).select("topic", "row_index"), ["topic"])
    return with_rate_schedule(placed, rate_changes(spark, sf), ["topic"])


@query("d1_duplicates", f"""
    WITH {MSGS}
    SELECT topic, row_index, copy_no, key, value
    FROM msgs, (SELECT unnest([0, 1]) AS copy_no)
    WHERE copy_no = 0 OR {u_sql("'duplicate'", 'row_index')} < 0.15""")
def d1(spark, sf):
    return inject_duplicates(messages(spark, sf), 0.15, SEED).select("topic", "row_index", "copy_no", "key", "value")


@query("d1_send_position", f"""
    WITH {MSGS}, c AS (
      SELECT topic, row_index, copy_no FROM msgs, (SELECT unnest([0, 1]) AS copy_no)
      WHERE copy_no = 0 OR {u_sql("'duplicate'", 'row_index')} < 0.15),
    n AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY row_index, copy_no) - 1 AS position FROM c)
    SELECT topic, row_index, copy_no, position,
           {START_MICROS} + floor(position * 1000000.0::DOUBLE / 1000.0::DOUBLE)::BIGINT AS sent_micros
    FROM n""")
def d1_position(spark, sf):
    copies = inject_duplicates(messages(spark, sf).select("topic", "row_index"), 0.15, SEED)
    placed = send_position(copies, ["topic"])
    return placed.withColumn("sent_micros", event_micros(START_MICROS, F.col("position"), 1000.0))
