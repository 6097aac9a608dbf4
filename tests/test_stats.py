from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from eventlab.operators import sets, stats
from eventlab.operators.flows import Flow, Step
from eventlab.operators.routing import FailurePolicy, process, with_groups
from eventlab.operators.synth import TopicSpec, inject_duplicates, rows, zipf_key
from eventlab.plans.spec import fields_of
from eventlab.operators.quality import violation_summary, violations
from eventlab.sources.tables import flow_topics, read_messages, topic_rows, topic_table, write_messages
from eventlab.session import scratch_path

T0 = datetime(2024, 1, 1)


def msgs_of(spark, data):
    """(topic, partition, offset, key, value, seconds)"""
    return spark.createDataFrame(
        [(t, p, o, k, v, T0 + timedelta(seconds=s), i) for i, (t, p, o, k, v, s) in enumerate(data)],
        "topic STRING, partition INT, offset BIGINT, key STRING, value STRING, ts TIMESTAMP_NTZ, row_index BIGINT",
    )


@pytest.fixture(scope="module")
def msgs(spark):
    return rows(spark, 4000).select(
        F.when(F.col("row_index") % 4 < 3, "big").otherwise("small").alias("topic"),
        F.lit(0).alias("partition"), F.col("row_index").alias("offset"), F.lit("k").alias("key"),
        F.lit("véé").alias("value"), F.timestamp_seconds("row_index").cast("timestamp_ntz").alias("ts"), "row_index",
    ).cache()


def test_counters_add_up(msgs):
    policy = FailurePolicy(0.2, 0.1, "retry", 2)
    done = process(with_groups(msgs, 3), policy, 1)
    report = {(r.topic, r.group_id): r for r in stats.lag_report(msgs, done).collect()}
    assert len(report) == 6
    for (topic, group), r in report.items():
        assert r.produced == {"big": 3000, "small": 1000}[topic] and group.startswith(f"{topic}-group-")
        exhausted = r.produced - r.consumed
        assert r.failures == r.retries + exhausted and r.lag == exhausted
    for topic in ("big", "small"):
        rows_ = [r for (t, _), r in report.items() if t == topic]
        total = rows_[0].produced - sum(r.consumed for r in rows_)
        assert {r.lag_total for r in rows_} == {total} and total < 0
        assert {r.severity for r in rows_} == {"green"}
    levels = {r.level: r["count"] for r in stats.consumer_stats(done).groupBy("level").count().collect()}
    assert levels == {"group": 6, "topic": 2, "total": 1}
    total = stats.consumer_stats(done).where("level = 'total'").first()
    assert total.bytes == 5 * total.consumed == 5 * sum(r.consumed for r in report.values())


def test_topic_without_groups_lags_fully(msgs):
    done = process(with_groups(msgs.where("topic = 'big'"), 1), FailurePolicy(), 1)
    small = stats.lag_report(msgs, done).where("topic = 'small'").first()
    assert (small.group_id, small.produced, small.consumed, small.lag_total, small.severity) == (None, 1000, 0, 1000, "red")


def test_producer_counts(spark, msgs):
    copies = inject_duplicates(msgs, 0.5, 2).withColumn("error", F.col("row_index") % 10 == 0)
    got = {r.topic: r for r in stats.producer_stats(copies).collect()}
    assert sum(r.messages + r.errors for r in got.values()) == copies.count()
    assert sum(r.duplicates for r in got.values()) == copies.count() - 4000
    assert all(r.bytes == 5 * r.messages for r in got.values())


@pytest.mark.parametrize("lag,topic,flow", [(101, "red", "red"), (100, "green", "yellow"), (0, "green", "green"), (-5, "green", "green")])
def test_severity_limits(spark, lag, topic, flow):
    row = spark.range(1).select(stats.lag_severity(F.lit(lag)), stats.lag_severity(F.lit(lag), "flow")).first()
    assert tuple(row) == (topic, flow)


def test_flow_report_and_totals(spark):
    flow = spark.createDataFrame([("f", "a", 0), ("f", "a", 1), ("f", "b", 2), ("g", "a", 0)], "flow STRING, topic STRING, step INT")
    done = spark.createDataFrame(
        [("a", "f-a-group-1", "ok"), ("a", "f-a-group-1", "skip"), ("a", "f-a-group-2", "ok"), ("a", "a-group-1", "ok")],
        "topic STRING, group_id STRING, status STRING",
    ).select("*", F.lit("v").alias("value"), F.lit(0).alias("failures"), F.lit(0).alias("retries"), F.lit(False).alias("commit_failed"))
    got = {(r.flow, r.topic): (r.produced, r.consumed, r.lag, r.no_consumer, r.severity) for r in stats.flow_report(flow, done).collect()}
    assert got == {("f", "a"): (2, 2, 0, False, "green"), ("f", "b"): (1, None, 1, True, "yellow"), ("g", "a"): (1, None, 1, True, "yellow")}
    made = msgs_of(spark, [("a", 0, i, "k", "v", i) for i in range(7)])
    total = stats.totals(made, flow, done).first()
    # Flow messages are produced but do not lag.
    assert (total.produced, total.consumed, total.lag) == (11, 3, 4)
    summary = stats.run_summary(made, flow, done, 2).first()
    assert tuple(summary) == (7, 3, 1, 4, 6_000_000)


def test_key_skew_ranks_all_keys(spark):
    base = zipf_key(rows(spark, 5000), 20, 1.5, 2)
    top = stats.key_skew(base, 5).collect()
    counts = sorted(((r["count"], r.key) for r in base.groupBy("key").count().collect()), key=lambda x: (-x[0], x[1]))
    assert [(r.n, r.key) for r in top] == counts[:5] and [r.rank for r in top] == [1, 2, 3, 4, 5]
    assert top[0].share == round(counts[0][0] / 5000, 6) and top[0].head_tail == round(counts[0][0] / counts[-1][0], 6)


def test_assignment_deals_partitions_in_runs(spark):
    msgs = spark.range(1200).select(F.lit("t").alias("topic"), (F.col("id") % 12).cast("int").alias("partition"))
    got = {r.consumer: (r.partitions, r.messages) for r in stats.assignment_load(msgs, 5).collect()}
    assert got == {1: (3, 300), 2: (3, 300), 3: (2, 200), 4: (2, 200), 5: (2, 200)}
    skew = stats.partition_skew(msgs.where("partition < 2 or id < 600")).collect()
    assert {r.n for r in skew} == {100, 50} and {r.max_mean for r in skew} == {round(100 / (700 / 12), 6)}


def test_duplicates_and_dedup(spark):
    msgs = msgs_of(spark, [
        ("t", 0, 0, "k", "v", 0), ("t", 1, 0, "k", "v", 1), ("t", 0, 1, "k", "w", 2), ("u", 0, 0, "k", "v", 3),
        ("t", 0, 2, None, "v", 4), ("t", 0, 3, None, "v", 5), ("t", 0, 4, "k", None, 6), ("t", 0, 5, "k", None, 7),
    ])
    report = {r.topic: r for r in stats.duplicate_report(msgs).collect()}
    assert (report["t"].messages, report["t"].distinct_messages, report["t"].copies, report["t"].high) == (7, 4, 3, False)
    kept = stats.dedup(msgs)
    assert kept.columns == msgs.columns
    assert sorted(r.row_index for r in kept.collect()) == [0, 2, 3, 4, 6]
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "partial_min" in plan and "Window" not in plan


def test_throughput_fills_gaps(spark):
    msgs = msgs_of(spark, [("t", 0, 0, "k", "abcd", 5), ("t", 0, 1, "k", "ab", 9), ("t", 0, 2, "k", "ab", 41)])
    base = int((T0 - datetime(1970, 1, 1)).total_seconds())
    got = sorted((r.start_second - base, r.messages, r.messages_per_second, r.bytes_per_second) for r in stats.throughput(msgs, 10).collect())
    assert got == [(0, 2, 0.2, 0.6), (10, 0, 0, 0), (20, 0, 0, 0), (30, 0, 0, 0), (40, 1, 0.1, 0.2)]


def test_lag_timeline_runs_per_group(spark):
    msgs = msgs_of(spark, [("t", 0, i, "k", "v", i * 10) for i in range(6)])
    done = process(with_groups(msgs, 2), FailurePolicy(), 1)
    got = stats.lag_timeline(msgs, done, 10, F.lit(25_000_000)).orderBy("start_second").collect()
    assert [r.lag for r in got if r.group_id == "t-group-2"] == [1, 2, 2, 2, 2, 2, 1, 0]


def test_failure_warnings(msgs):
    def warning(**policy):
        done = process(with_groups(msgs, 1), FailurePolicy(**policy), 1)
        return {r.warning for r in stats.failure_report(done).collect()}

    assert warning(failure_rate=0.7) == {"high failure rate"}
    assert warning(commit_failure_rate=0.7) == {"high commit failure rate"}
    assert warning(failure_rate=0.3) == {None}


def test_cardinality(spark):
    df = spark.range(3000).select((F.col("id") % 200).alias("a"), (F.col("id") % 7).alias("b"))
    got = {r.field: r for r in stats.cardinality_report(df, {"a": 200, "b": 6}).collect()}
    assert (got["a"].exact, got["a"].within, got["b"].exact, got["b"].within) == (200, True, 7, False)
    assert abs(got["a"].approx - 200) < 20


def test_sets(spark):
    a = msgs_of(spark, [("t", 0, i, "k", "v", i) for i in range(5)])
    b = msgs_of(spark, [("t", 0, i, "k", "v", i) for i in range(2, 7)])
    got = {(r.offset, r.verdict) for r in sets.delivery_diff(a, b).collect()}
    assert got == {(0, "lost"), (1, "lost"), (5, "unexpected"), (6, "unexpected")}
    merged = sets.merge(one=a, two=b.drop("key"))
    assert merged.count() == 10 and merged.where("scenario = 'two' and key is null").count() == 5
    assert [r.topic for r in sets.shared_topics(a, b).collect()] == ["t"]


def test_topic_table_lists_each_topic_once(spark):
    flow = Flow("f", (Step("orders", "x"), Step("audit", "y"), Step("audit", "z")))
    declared = topic_rows(spark, [TopicSpec("orders", 6, 1), TopicSpec("clicks")])
    got = {tuple(r) for r in topic_table(declared, flow_topics(spark, [flow])).collect()}
    assert got == {("orders", 6, 1), ("clicks", 12, 3), ("audit", 12, 3)}


@pytest.mark.parametrize("fmt", ["parquet", "json", "orc"])
def test_message_tables_round_trip(spark, msgs, fmt):
    path = scratch_path(spark, "test")
    out = msgs.withColumn("ts", F.col("ts").cast("timestamp"))
    write_messages(out, path, fmt, files_per_value=2)
    back = read_messages(spark, path, fmt)
    assert back.select(*sorted(out.columns)).exceptAll(out.select(*sorted(out.columns))).count() == 0 and back.count() == 4000
    pruned = back.where("topic = 'big'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(topic" in pruned
    with pytest.raises(ValueError):
        read_messages(spark, path, "csv")


def test_violations_of_nested_values(spark):
    fields = fields_of([
        {"name": "id", "type": "uuid"},
        {"name": "at", "type": "timestamp"},
        {"name": "lines", "type": "array", "min_items": 1, "max_items": 2, "items": {"type": "object", "fields": [
            {"name": "q", "type": "int", "min": 1, "max": 5}]}},
        {"name": "to", "type": "object", "fields": [{"name": "zip", "type": "string", "min_length": 2, "max_length": 3}]},
    ])
    good = "00000000-0000-4000-8000-000000000000"
    df = spark.createDataFrame(
        [(1, good, 5, [(3,)], ("abc",)), (2, "nope", -1, [(0,), (9,), (None,)], ("a",)), (3, None, 0, [], None), (4, good, 0, None, (None,))],
        "k INT, id STRING, at BIGINT, lines array<struct<q:int>>, `to` struct<zip:string>",
    )
    found = violations(df, fields, ["k"])
    assert sorted((r.k, r.path, r.message, r.severity) for r in found.collect()) == [
        (2, "at", "before 1970", "warning"), (2, "id", "not a uuid", "error"),
        (2, "lines", "more than max_items", "error"), (2, "lines[0].q", "below min", "error"),
        (2, "lines[1].q", "above max", "error"), (2, "lines[2].q", "missing", "error"),
        (2, "to.zip", "shorter than min_length", "error"), (3, "id", "missing", "error"),
        (3, "lines", "fewer than min_items", "error"), (3, "to", "missing", "error"), (4, "lines", "missing", "error"),
        (4, "to.zip", "missing", "error"),
    ]
    summary = {(r.path, r.severity): (r.n, r.valid) for r in violation_summary(found).collect()}
    assert summary["at", "warning"] == (1, True) and summary["id", "error"] == (2, False)


def test_violations_at_any_depth(spark):
    fields = fields_of([
        {"name": "lines", "type": "array", "items": {"type": "object", "fields": [
            {"name": "geo", "type": "object", "fields": [{"name": "lat", "type": "int", "max": 9}]},
            {"name": "tags", "type": "array", "max_items": 1, "items": {"type": "string", "min_length": 2}}]}},
        {"name": "m", "type": "array", "items": {"type": "array", "items": {"type": "int", "max": 3}}},
    ])
    df = spark.createDataFrame(
        [(1, [((99,), ["ab"]), ((1,), ["a", "bc"]), (None, None)], [[99], None, [1, 4]])],
        "k int, lines array<struct<geo:struct<lat:bigint>,tags:array<string>>>, m array<array<bigint>>")
    found = sorted((r.path, r.message) for r in violations(df, fields, ["k"]).collect())
    assert found == sorted([
        ("lines[0].geo.lat", "above max"), ("lines[1].tags", "more than max_items"), ("lines[1].tags[0]", "shorter than min_length"),
        ("lines[2].geo", "missing"), ("lines[2].tags", "missing"), ("m[0][0]", "above max"), ("m[1]", "missing"), ("m[2][1]", "above max")])
