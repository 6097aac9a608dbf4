import json
import re

import pytest
from pyspark.sql import functions as F

from eventlab.functions import fields as fx
from eventlab.functions.draw import u
from eventlab.functions.keys import key_col, partition_col
from eventlab.functions.payloads import fixed_payload, json_payload, random_payload
from eventlab.operators.synth import (
    TopicSpec, inject_duplicates, lookup_col, lookup_values, rows, send_position, synth_messages, synth_table, zipf_weights,
    with_key, with_offsets, zipf_key,
)
from eventlab.operators.timing import event_micros, with_event_time, with_rate_schedule
from eventlab.plans.spec import Field, fields_of

N = 10_000


@pytest.fixture(scope="module")
def base(spark):
    return rows(spark, N, 4).cache()


def values(df, col):
    return [r[0] for r in df.select("row_index", col.alias("v")).orderBy("row_index").select("v").collect()]


I = "row_index"


def test_draws_are_uniform_and_independent(base):
    got = base.select(u(1, "a", F.col(I)).alias("a"), u(1, "a", F.col(I), 1).alias("b"), u(2, "a", F.col(I)).alias("c"))
    s = got.agg(F.avg("a"), F.min("a"), F.max("a"), F.corr("a", "b"), F.corr("a", "c")).first()
    assert abs(s[0] - 0.5) < 0.02 and s[1] >= 0 and s[2] < 1
    assert abs(s[3]) < 0.05 and abs(s[4]) < 0.05


def test_rows_do_not_depend_on_layout(spark):
    fields = fields_of([
        {"name": "id", "type": "uuid"}, {"name": "s", "type": "string"}, {"name": "n", "type": "int"},
        {"name": "xs", "type": "array", "min_items": 0, "items": {"type": "float"}},
    ])
    one, many = (
        synth_table(rows(spark, 500, p), fields, 9, keep=[I]).orderBy(I).collect() for p in (1, 8)
    )
    assert one == many


def test_string_lengths_and_letters(base):
    for low, high in ((5, 20), (0, 3), (1, 10), (7, 7), (50, 300)):
        got = values(base.limit(2000), fx.string_col(1, f"s{high}", F.col(I), low, high))
        assert all(re.fullmatch("[a-z]*", v) and low <= len(v) <= high for v in got)
        assert {len(v) for v in got} == set(range(low, high + 1)) or high > 20
    many = values(base, fx.string_col(1, "s", F.col(I)))
    counts = {c: 0 for c in "abcdefghijklmnopqrstuvwxyz"}
    for v in many:
        for c in v:
            counts[c] += 1
    mean = sum(counts.values()) / 26
    assert all(abs(n - mean) < 0.1 * mean for n in counts.values())


@pytest.mark.parametrize("col", [
    lambda: fx.string_col(1, "c", F.col(I), 3, 9, 700),
    lambda: fx.int_col(1, "c", F.col(I), -50, 5000, 700),
])
def test_cardinality_cycles_through_distinct_values(base, col):
    got = values(base, col())
    assert len(set(got[:700])) == 700
    assert got[700:1400] == got[:700]
    assert len(set(got)) == 700


def test_cardinality_above_range_is_rejected(spark):
    with pytest.raises(ValueError):
        fx.int_col(1, "c", F.col(I), 1, 10, 11)
    with pytest.raises(ValueError):
        fx.string_col(1, "c", F.col(I), 1, 2, 677)
    assert fx.spread_params(1, "c", 5, 5, 1)[1] == 0


def test_numbers_reach_both_ends(base):
    got = values(base, fx.int_col(1, "n", F.col(I), 1, 10))
    assert set(got) == set(range(1, 11))
    floats = values(base, fx.float_col(1, "f", F.col(I), -1, 1))
    assert all(-1 <= v <= 1 and round(v, 2) == v for v in floats)


def test_enum_repeats_are_weights(base):
    got = values(base, fx.enum_col(1, "e", F.col(I), ["ok", "ok", "ok", "bad"]))
    assert 0.72 < got.count("ok") / N < 0.78
    half = values(base, fx.boolean_col(1, "b", F.col(I)))
    assert 0.47 < sum(half) / N < 0.53


def test_uuid_shape_and_distinct(base):
    got = values(base, fx.uuid_col(1, "u", F.col(I)))
    shape = re.compile("[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}")
    assert all(shape.fullmatch(v) for v in got) and len(set(got)) == N


def test_arrays_of_arrays(base):
    item = Field.of({"name": "a", "type": "array", "min_items": 0, "max_items": 3, "items": {"type": "int"}})
    got = values(base.limit(500), fx.array_col(1, "m", F.col(I), item, 0, 4))
    assert {len(v) for v in got} == {0, 1, 2, 3, 4}
    inner = [x for v in got for x in v]
    assert {len(x) for x in inner} == {0, 1, 2, 3}
    flat = [n for x in inner for n in x]
    assert len(set(flat)) > 400  # elements are drawn independently


def test_uniform_keys_are_even(base):
    got = base.select(key_col("uniform", 1, F.col(I), 10).alias("k")).groupBy("k").count().collect()
    assert len(got) == 10 and all(abs(r["count"] - N / 10) < 0.2 * N / 10 for r in got)


@pytest.mark.parametrize("limit", [0, 100_000])
def test_zipf_keys_are_skewed(base, limit):
    got = {r.key: r["count"] for r in zipf_key(base, 10, 1.5, 3, broadcast_rows=limit).groupBy("key").count().collect()}
    assert sum(got.values()) == N and got["key-0"] > 5 * got["key-9"]
    total = sum(1 / (i + 1) ** 1.5 for i in range(10))
    assert abs(got["key-0"] / N - 1 / total) < 0.03


def test_zipf_with_many_keys_keeps_every_row(base):
    out = zipf_key(base, 20_000, 0.5, 3)
    assert out.count() == N and out.select(I).distinct().count() == N


def test_round_robin_is_exact(base):
    got = base.select(key_col("round_robin", 1, F.col(I), 8).alias("k")).groupBy("k").count().collect()
    assert {r["count"] for r in got} == {N // 8}


def test_key_settings(base):
    assert values(base.limit(3), key_col("single_key", 1, F.col(I))) == ["hot-key"] * 3
    with pytest.raises(ValueError):
        key_col("gaussian", 1, F.col(I))
    with pytest.raises(ValueError):
        key_col("uniform", 1, F.col(I), 0)
    assert with_key(base, "zipfian", 5).columns == [I, "key"]
    spread = base.select(partition_col(key_col("uniform", 1, F.col(I), 500), 6).alias("p")).distinct().count()
    assert spread == 6
    assert values(base.limit(1), partition_col(F.lit(None).cast("string"), 6)) == [0]


def padded(seq, millis, target, timestamp=True, sequence=True):
    """The documented padding rule, written out with the json module."""
    message = {"id": f"msg-{seq}"}
    if timestamp:
        message["timestamp"] = millis
    if sequence:
        message["sequence"] = seq
    room = target - len(json.dumps(message)) - 20
    if room > 0:
        message["data"] = "x" * room
    return json.dumps(message)


@pytest.mark.parametrize("timestamp,sequence", [(True, True), (True, False), (False, True), (False, False)])
def test_json_payload_is_padded_exactly(base, timestamp, sequence):
    at = F.timestamp_millis(F.col(I) + 1_700_000_000_000)
    col = json_payload(4, F.col(I), at, 60, 200, timestamp, sequence)
    size = fx.int_col(4, "size", F.col(I), 60, 200)
    for r in base.limit(500).select(I, col.alias("v"), size.alias("t")).collect():
        assert r.v == padded(r[I] + 1, r[I] + 1_700_000_000_000, r.t, timestamp, sequence)


def test_payload_sizes(base):
    some = base.limit(300)
    sizes = {len(v) for v in values(some, random_payload(1, F.col(I), 10, 40))}
    assert min(sizes) >= 10 and max(sizes) <= 40 and len(sizes) > 20
    assert all(len(v) == 64 for v in values(some, fixed_payload(F.col(I), 64)))
    assert values(some.limit(1), fixed_payload(F.col(I), 2)) == ["msg-1-"]
    with pytest.raises(ValueError):
        random_payload(1, F.col(I), 5, 4)
    with pytest.raises(ValueError):
        json_payload(1, F.col(I), None)


@pytest.mark.parametrize("limit", [0, 100_000])
def test_lookup_values_cover_one_provider(spark, base, limit):
    names = lookup_values(spark.range(40), F.concat(F.lit("n"), F.col("id")), "id", "name", "en")
    dates = lookup_values(spark.range(9), F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")).cast("string"),
                          "id", "date")
    both = names.unionByName(dates)
    got = lookup_col(base, "v", both, "name", "en", 2, broadcast_rows=limit)
    assert got.count() == N and got.select("v").distinct().count() == 40
    day = lookup_col(base, "v", both, "date", seed=2).select("v").distinct().collect()
    assert {r.v for r in day} == {f"2024-01-0{d}" for d in range(1, 10)}


def test_structured_messages(spark, base):
    fields = tuple(fields_of([
        {"name": "id", "type": "uuid"}, {"name": "who", "type": "faker", "provider": "name"},
        {"name": "n", "type": "int", "max": 5},
    ]))
    names = lookup_values(spark.range(3), F.concat(F.lit("n"), F.col("id")), "id", "name")
    timed = with_event_time(base.limit(200), 0, 100.0)
    out = synth_messages(timed, TopicSpec("t", 4, fields=fields, key_distribution="single_key"), 1, lookups=names)
    got = out.collect()
    assert len(got) == 200 and {r.partition for r in got} == {got[0].partition}
    for r in got:
        value = json.loads(r.value)
        assert list(value) == ["id", "who", "n"] and value["who"] in ("n0", "n1", "n2")
    with pytest.raises(ValueError):
        synth_messages(timed, TopicSpec("t", fields=fields), 1)


def test_duplicates_are_single_copies(base):
    out = inject_duplicates(base, 0.2, 5)
    per_row = out.groupBy(I).agg(F.count("*").alias("n"), F.max("copy_no").alias("c"))
    assert per_row.where((F.col("n") > 2) | (F.col("n") != F.col("c") + 1)).count() == 0
    assert 0.17 < out.count() / N - 1 < 0.23
    assert inject_duplicates(base, 0, 5).count() == N and inject_duplicates(base, 1, 5).count() == 2 * N
    placed = send_position(out, [])
    assert placed.agg(F.count_distinct("position"), F.max("position")).first() == (out.count(), out.count() - 1)


def test_offsets_are_dense_under_a_hot_key(spark):
    msgs = rows(spark, 5000).select(
        F.lit("t").alias("topic"), F.when(F.col(I) % 10 < 9, 0).otherwise(1).alias("partition"), I
    )
    got = with_offsets(msgs).groupBy("partition").agg(F.count("*").alias("n"), F.max("offset").alias("m"), F.min("offset").alias("l"))
    assert {(r.n, r.m, r.l) for r in got.collect()} == {(4500, 4499, 0), (500, 499, 0)}


def test_event_time_at_constant_rate(base):
    got = base.select(event_micros(10, F.col(I), 4.0).alias("m")).orderBy("m").limit(3).collect()
    assert [r.m for r in got] == [10, 250_010, 500_010]
    with pytest.raises(ValueError):
        event_micros(0, F.col(I), 0)


@pytest.mark.parametrize("limit", [0, 100_000])
def test_rate_schedule_matches_simulation(spark, limit):
    changes = [("a", 0, 2.0), ("a", 10, 0.5), ("a", 20, 0.0), ("a", 30, 4.0), ("b", 0, 1.0), ("b", 4, 0.0)]
    cdf = spark.createDataFrame([(t, s * 1_000_000, r) for t, s, r in changes], "topic STRING, at_micros BIGINT, rate DOUBLE")
    df = rows(spark, 60).withColumnRenamed(I, "position").crossJoin(
        spark.createDataFrame([("a",), ("b",)], "topic STRING")
    )
    out = with_rate_schedule(df, cdf, ["topic"], width=8, broadcast_rows=limit)
    got = {(r.topic, r.position): r.sent_micros for r in out.collect()}
    for topic in "ab":
        mine = [(s, r) for t, s, r in changes if t == topic]
        due, i = 0.0, 0
        for (s, r), (e, _) in zip(mine, [*mine[1:], (10**6, 0)]):
            while r > 0 and i < due + r * (e - s) and i < 60:
                assert got[topic, i] == int((s + (i - due) / r) * 1_000_000)
                i += 1
            due += r * (e - s)
        for rest in range(i, 60):
            assert got[topic, rest] is None
    assert len(got) == 120


def test_topic_settings_are_checked():
    for bad in ({"partitions": 0}, {"rate": 0}, {"duplicate_rate": 1.5}, {"min_size": 9, "max_size": 3}):
        with pytest.raises(ValueError):
            TopicSpec("t", **bad)


def test_lookups_and_pools_inside_nested_values(spark, base):
    fields = fields_of([
        {"name": "to", "type": "object", "fields": [
            {"name": "who", "type": "faker", "provider": "name"},
            {"name": "deep", "type": "object", "fields": [{"name": "who", "type": "faker", "provider": "name"}]}]},
        {"name": "lines", "type": "array", "min_items": 2, "max_items": 4, "items": {"type": "object", "fields": [
            {"name": "who", "type": "faker", "provider": "name"},
            {"name": "sku", "type": "string", "cardinality": 7},
            {"name": "n", "type": "int", "min": 1, "max": 90, "cardinality": 5}]}},
    ])
    names = lookup_values(spark.range(6), F.concat(F.lit("n"), F.col("id")), "id", "name")
    got = synth_table(base.limit(400), fields, 3, lookups=names, keep=[I]).collect()
    pool = {f"n{i}" for i in range(6)}
    assert {r.to.who for r in got} == pool == {r.to.deep.who for r in got}
    assert any(r.to.who != r.to.deep.who for r in got)
    lines = [x for r in got for x in r.lines]
    assert {x.who for x in lines} == pool
    assert len({x.sku for x in lines}) == 7 and len({x.n for x in lines}) == 5
    with pytest.raises(ValueError):
        synth_table(base, fields, 3)
    many = lookup_values(spark.range(1001), F.col("id").cast("string"), "id", "name")
    assert {x.who for r in synth_table(base.limit(400), fields, 3, lookups=many).collect() for x in r.lines} <= {str(i) for i in range(1001)}


def test_lookup_positions_must_be_dense(spark):
    df = rows(spark, 5)
    for positions in ([0, 3], [0, 1, 1], [1, 2]):
        values = spark.createDataFrame([("p", "", k, f"v{k}") for k in positions], "provider string, locale string, pos long, value string")
        with pytest.raises(ValueError, match="gaps or repeats"):
            lookup_col(df, "x", values, "p")


def test_lookups_in_nested_arrays_of_any_size(spark):
    values = spark.createDataFrame([("p", "", k, f"v{k}") for k in range(3000)], "provider string, locale string, pos long, value string")
    fields = fields_of([
        {"name": "a", "type": "array", "min_items": 0, "max_items": 3, "items": {"type": "array", "min_items": 1, "max_items": 2, "items": {
            "type": "object", "fields": [{"name": "who", "type": "faker", "provider": "p"}]}}},
        {"name": "b", "type": "array", "items": {"type": "faker", "provider": "p"}},
    ])
    got = synth_table(rows(spark, 300), fields, 3, lookups=values, keep=["row_index"]).collect()
    assert len(got) == 300
    seen = set()
    for r in got:
        inner = [x.who for row in r.a for x in row] + list(r.b)
        assert all(x is not None for x in inner)
        seen.update(inner)
    assert len(seen) > 700


def test_zipf_keeps_its_law_in_the_tail(spark):
    w = zipf_weights(spark, 200_000, 1.5)
    share = w.where("rank >= 100000").agg(F.sum((F.col("hi") - F.col("lo")) / F.col("total"))).first()[0]
    law = sum((i + 1) ** -1.5 for i in range(100_000, 200_000)) / sum((i + 1) ** -1.5 for i in range(200_000))
    assert abs(share / law - 1) < 1e-3
