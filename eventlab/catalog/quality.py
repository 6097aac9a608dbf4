"""Queries on parsing and checking records."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.codec import fields_from_avro, fields_from_proto, parse_json, schema_from_avro, schema_from_proto
from ..functions.fields import uuid_col
from ..operators.quality import violation_summary, violations
from ..operators.synth import synth_table
from ..plans.spec import fields_of
from ..sources.tables import spread
from .base import SEED, hash_sql, messages, pick_sql, query, table, u_sql, uuid_sql

PROPS = fields_of([{"name": "k", "type": "int"}])


@query("v1_parse_json", """
    SELECT event_id AS row_index, CASE WHEN event_id % 10 <> 0 THEN (props::JSON->>'k')::BIGINT END AS k,
           CASE WHEN event_id % 10 = 0 THEN substr(props, 1, 4) END AS corrupt
    FROM events""")
def v1(spark, sf):
    cut = F.when(F.pmod("row_index", F.lit(10)) == 0, F.substring("value", 1, 4)).otherwise(F.col("value"))
    parsed = parse_json(messages(spark, sf).withColumn("value", cut), PROPS)
    return parsed.select("row_index", "parsed.k", F.col("_corrupt_record").alias("corrupt"))


AVRO_RECORD = """{"type": "record", "name": "Props", "fields": [
    {"name": "k", "type": ["null", "long"]}, {"name": "gone", "type": ["null", "string"]}]}"""
PROTO_MESSAGE = """message Props {
    int64 k = 1;  // position
    repeated string tags = 2;
}"""


@query("v4_avro_schema", """
    SELECT event_id, (props::JSON->>'k')::BIGINT AS k, true AS gone_missing FROM events""")
def v4(spark, sf):
    schema = schema_from_avro(AVRO_RECORD)
    read = table(spark, sf, "events").select("event_id", F.from_json("props", schema).alias("p"))
    return read.select("event_id", "p.k", F.col("p.gone").isNull().alias("gone_missing"))


@query("v5_proto_schema", """
    SELECT event_id, (props::JSON->>'k')::BIGINT AS k, event_type AS tag FROM events""")
def v5(spark, sf):
    schema = schema_from_proto(PROTO_MESSAGE)
    tagged = F.concat(F.lit('{"tags": ["'), "event_type", F.lit('"], '), F.substring("props", F.lit(2), F.length("props")))
    read = table(spark, sf, "events").select("event_id", F.from_json(tagged, schema).alias("p"))
    return read.select("event_id", "p.k", F.element_at("p.tags", 1).alias("tag"))


EVENT_RULES = fields_of([
    {"name": "user", "type": "int", "min": 5, "max": 140},
    {"name": "kind", "type": "enum", "values": ["click", "view", "purchase"]},
    {"name": "amount", "type": "float", "min": 0.5, "max": 90},
    {"name": "token", "type": "uuid"},
    {"name": "note", "type": "string", "min_length": 3, "max_length": 8},
    {"name": "parsed", "type": "object", "fields": [{"name": "k", "type": "int", "min": 0, "max": 90}]},
])


def checked_events(spark, sf):
    i = F.col("event_id")
    token = uuid_col(SEED, "token", i)
    parsed = F.from_json("props", "k BIGINT")
    records = table(spark, sf, "events").select(
        "event_id", F.col("user_id").alias("user"), F.col("event_type").alias("kind"),
        F.col("value").alias("amount"),
        F.when(F.pmod(i, F.lit(9)) == 0, F.upper(token)).otherwise(token).alias("token"),
        F.when(F.pmod(i, F.lit(11)) > 0, F.repeat(F.lit("x"), F.pmod(i, F.lit(11)).cast("int"))).alias("note"),
        F.when(F.pmod(i, F.lit(13)) > 0, parsed).alias("parsed"),
    )
    return violations(records, EVENT_RULES, ["event_id"])


FOUND = f"""r AS (
    SELECT event_id, user_id, event_type, value, (props::JSON->>'k')::BIGINT AS k,
           {uuid_sql(hash_sql("'token'", 'event_id'))} AS token FROM events),
  found AS (
    SELECT event_id, 'user' AS path, 'below min' AS message FROM r WHERE user_id < 5
    UNION ALL SELECT event_id, 'user', 'above max' FROM r WHERE user_id > 140
    UNION ALL SELECT event_id, 'kind', 'not an enum value' FROM r WHERE event_type NOT IN ('click', 'view', 'purchase')
    UNION ALL SELECT event_id, 'amount', 'below min' FROM r WHERE value < 0.5
    UNION ALL SELECT event_id, 'amount', 'above max' FROM r WHERE value > 90
    UNION ALL SELECT event_id, 'token', 'not a uuid' FROM r WHERE event_id % 9 = 0 AND upper(token) <> token
    UNION ALL SELECT event_id, 'note', 'missing' FROM r WHERE event_id % 11 = 0
    UNION ALL SELECT event_id, 'note', 'shorter than min_length' FROM r WHERE event_id % 11 IN (1, 2)
    UNION ALL SELECT event_id, 'note', 'longer than max_length' FROM r WHERE event_id % 11 > 8
    UNION ALL SELECT event_id, 'parsed', 'missing' FROM r WHERE event_id % 13 = 0
    UNION ALL SELECT event_id, 'parsed.k', 'above max' FROM r WHERE event_id % 13 <> 0 AND k > 90)"""


@query("v6_violations", f"WITH {FOUND} SELECT event_id, path, message, 'error' AS severity FROM found")
def v6(spark, sf):
    return checked_events(spark, sf)


VECTOR_RULES = fields_of([
    {"name": "embedding", "type": "array", "min_items": 1, "max_items": 60,
     "items": {"type": "float", "min": -0.2, "max": 0.2}},
])


@query("v6_array_items", """
    WITH e AS (SELECT vec_id, len(embedding) AS n, unnest(range(len(embedding))) AS i, unnest(embedding) AS x FROM embeddings)
    SELECT vec_id, 'embedding' AS path, 'more than max_items' AS message, 'error' AS severity
    FROM embeddings WHERE len(embedding) > 60
    UNION ALL SELECT vec_id, 'embedding[' || i || ']', 'below min', 'error' FROM e WHERE x < -0.2::FLOAT
    UNION ALL SELECT vec_id, 'embedding[' || i || ']', 'above max', 'error' FROM e WHERE x > 0.2::FLOAT""")
def v6_array(spark, sf):
    return violations(table(spark, sf, "embeddings"), VECTOR_RULES, ["vec_id"])


@query("v7_violation_summary", f"""
    WITH {FOUND}
    SELECT path, 'error' AS severity, count(*)::BIGINT AS n, false AS valid FROM found GROUP BY path""")
def v7(spark, sf):
    return violation_summary(checked_events(spark, sf))


NESTED_RULES = fields_of([
    {"name": "lines", "type": "array", "min_items": 1, "max_items": 5, "items": {"type": "object", "fields": [
        {"name": "part", "type": "int", "min": 1, "max": 150},
        {"name": "price", "type": "object", "fields": [
            {"name": "discount", "type": "float", "min": 0, "max": 0.08},
            {"name": "steps", "type": "array", "min_items": 1, "max_items": 3, "items": {"type": "int", "min": 0, "max": 40}}]}]}},
])


@query("v6_nested_items", """
    WITH l AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 AS i,
                      count(*) OVER (PARTITION BY l_orderkey) AS n, l_partkey, l_discount, l_quantity FROM lineitem)
    SELECT DISTINCT l_orderkey, 'lines' AS path, 'more than max_items' AS message, 'error' AS severity FROM l WHERE n > 5
    UNION ALL SELECT l_orderkey, 'lines[' || i || '].part', 'above max', 'error' FROM l WHERE l_partkey > 150
    UNION ALL SELECT l_orderkey, 'lines[' || i || '].part', 'below min', 'error' FROM l WHERE l_partkey < 1
    UNION ALL SELECT l_orderkey, 'lines[' || i || '].price.discount', 'above max', 'error' FROM l WHERE l_discount > 0.08
    UNION ALL SELECT l_orderkey, 'lines[' || i || '].price.steps[1]', 'above max', 'error' FROM l WHERE l_quantity > 40""")
def v6_nested(spark, sf):
    step = F.col("l_quantity").cast("bigint")
    line = F.struct(
        "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
        F.col("l_partkey").alias("part"), F.struct(F.col("l_discount").alias("discount"), F.array(F.lit(0).cast("bigint"), step).alias("steps")).alias("price"))
    orders = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    return violations(orders, NESTED_RULES, ["l_orderkey"])


STORED_AVRO = """{"type": "record", "name": "Order", "namespace": "shop", "fields": [
    {"name": "order_id", "type": {"type": "string", "logicalType": "uuid"}},
    {"name": "units", "type": ["null", "int"]},
    {"name": "state", "type": {"type": "enum", "name": "State", "symbols": ["NEW", "PAID", "SENT"]}},
    {"name": "ship_to", "type": {"type": "record", "name": "Place", "fields": [
        {"name": "weight", "type": "double"}, {"name": "express", "type": "boolean"}, {"name": "state", "type": "State"}]}},
    {"name": "created_at", "type": {"type": "long", "logicalType": "timestamp-millis"}}]}"""


def _stored_sql(number: str) -> str:
    return f"""
    SELECT o_orderkey, {uuid_sql(hash_sql("'order_id'", 'o_orderkey'))} AS order_id, {pick_sql(u_sql("'units'", 'o_orderkey'), 0, 1000)} AS units,
           list_extract(['NEW', 'PAID', 'SENT'], {pick_sql(u_sql("'state'", 'o_orderkey'), 1, 3)}) AS state,
           round({u_sql("'ship_to.weight'", 'o_orderkey')} * 1000, 2) AS weight, {u_sql("'ship_to.express'", 'o_orderkey')} < 0.5 AS express,
           list_extract(['NEW', 'PAID', 'SENT'], {pick_sql(u_sql("'ship_to.state'", 'o_orderkey'), 1, 3)}) AS place_state{number}
    FROM orders"""


def generated(spark, sf, fields):
    return synth_table(spread(table(spark, sf, "orders")), fields, SEED, "o_orderkey", "o_orderdate", keep=["o_orderkey"])


@query("v4_generated_from_avro", _stored_sql(", epoch_us(o_orderdate) // 1000 AS created_at"))
def v4_generated(spark, sf):
    made = generated(spark, sf, fields_from_avro(STORED_AVRO))
    return made.select("o_orderkey", "order_id", "units", "state", "ship_to.weight", "ship_to.express", F.col("ship_to.state").alias("place_state"), "created_at")


STORED_PROTO = """
syntax = "proto3";
package shop;
message Order {
  /* states of an order */
  enum State { NEW = 0; PAID = 1; SENT = 2; }
  message Place { double weight = 1; bool express = 2; State state = 3; }
  string order_id = 1;  // text here
  int32 units = 2;
  State state = 3;
  Place ship_to = 4;
  repeated int64 marks = 5;
  map<string, string> notes = 6;
}"""


@query("v5_generated_from_proto", f"""
    WITH m AS (SELECT o_orderkey, {pick_sql(u_sql("'marks'", 'o_orderkey'), 1, 5)} AS n FROM orders),
    e AS (SELECT o_orderkey, unnest(range(n)) AS j FROM m),
    s AS (SELECT o_orderkey, count(*) AS marks, sum({pick_sql(u_sql("'marks[' || j || ']'", 'o_orderkey'), 0, 1000)})::BIGINT AS mark_sum FROM e GROUP BY ALL)
    SELECT g.* EXCLUDE (order_id), marks, mark_sum, 0::BIGINT AS notes FROM ({_stored_sql("")}) g JOIN s USING (o_orderkey)""")
def v5_generated(spark, sf):
    made = generated(spark, sf, fields_from_proto(STORED_PROTO))
    return made.select(
        "o_orderkey", "units", "state", "ship_to.weight", "ship_to.express", F.col("ship_to.state").alias("place_state"),
        F.size("marks").cast("bigint").alias("marks"), F.aggregate("marks", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("mark_sum"),
        F.size("notes").cast("bigint").alias("notes"))
