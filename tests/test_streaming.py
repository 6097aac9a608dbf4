import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from eventlab.operators.flows import Flow, Step
from eventlab.operators.routing import FailurePolicy
from eventlab.operators.synth import TopicSpec, rows, synth_messages
from eventlab.session import scratch_path
from eventlab.sources.tables import MESSAGE, read_messages, write_messages
from eventlab.streaming import monitors as mon
from eventlab.streaming.flow_state import prompt_flow_status, stream_flow_status
from eventlab.streaming.sinks import drain, stream_route
from eventlab.streaming.sources import row_batches, row_stream, stream_messages

T0 = datetime(2024, 1, 1)


def write_batches(spark, batches, schema):
    """One file per batch, in the order they are to arrive."""
    path = scratch_path(spark, "in")
    for n, batch in enumerate(batches):
        df = spark.createDataFrame([(*r[:-1], T0 + timedelta(seconds=r[-1])) for r in batch], schema)
        df.coalesce(1).write.mode("append").parquet(path)
        if n < len(batches) - 1:
            time.sleep(1.1)  # files are read in order of their time, in whole seconds
    return path


def stream_of(spark, path):
    schema = spark.read.parquet(path).schema
    return read_messages(spark, path, streaming=True, schema=schema, files_per_trigger=1)


MSG = "topic STRING, key STRING, value STRING, row_index BIGINT, ts TIMESTAMP"


@pytest.fixture(scope="module")
def late_path(spark):
    return write_batches(spark, [
        [("t", "k", "a", 0, 0), ("t", "k", "b", 1, 30)],
        [("t", "k", "c", 2, 500)],
        # Lateness is judged by the watermark of the batch before the last one.
        [("t", "k", "c", 6, 505)],
        [("t", "k", "d", 3, 10), ("t", "k", "e", 4, 510)],
        [("t", "k", "f", 5, 2000)],
    ], MSG)


def test_late_rows_are_dropped_and_counted(spark, late_path):
    windows = mon.stream_throughput(stream_of(spark, late_path), "1 minute", "1 minute")
    out = scratch_path(spark, "out")
    query = (
        windows.writeStream.format("parquet").option("path", out)
        .option("checkpointLocation", scratch_path(spark, "cp")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    got = {(r.start - T0).total_seconds(): r.messages for r in spark.read.parquet(out).collect()}
    assert got == {0: 2, 480: 3}
    report = mon.late_report(query)
    assert report["late_rows"] == 1 and report["input_rows"] == 7


def test_long_runs_are_counted_whole(spark):
    base = spark.range(106).select(
        F.lit("t").alias("topic"), F.lit("k").alias("key"), F.col("id").cast("string").alias("value"), F.col("id").alias("row_index"),
        F.timestamp_seconds(F.lit(10_000) + F.col("id")).alias("ts"))
    path = scratch_path(spark, "many")
    base.repartitionByRange(106, "row_index").write.parquet(path)
    totals = mon.ProgressTotals()
    spark.streams.addListener(totals)
    query = (
        mon.stream_topic_stats(stream_of(spark, path)).writeStream.outputMode("complete").format("noop")
        .option("checkpointLocation", scratch_path(spark, "cp")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    report = mon.late_report(query, totals)
    spark.streams.removeListener(totals)
    assert report["input_rows"] == 106 and report["batches"] > 100
    with pytest.raises(ValueError):
        mon.late_report(query)


def test_update_mode_counts_grow(spark, late_path):
    seen = []
    query = (
        mon.stream_topic_stats(stream_of(spark, late_path)).writeStream.outputMode("update")
        .foreachBatch(lambda df, _: seen.extend(r.messages for r in df.collect()))
        .option("checkpointLocation", scratch_path(spark, "cp")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    assert seen == [2, 3, 4, 6, 7]


@pytest.mark.parametrize("salts", [1, 4])
def test_repeats_across_batches_are_dropped(spark, salts):
    path = write_batches(spark, [
        [("t", "k", "same", i, i) for i in range(20)],
        [("t", "k", "same", 20, 21), ("t", "k", "other", 21, 22)],
    ], MSG)
    got = drain(mon.stream_dedup(stream_of(spark, path), "10 minutes", salts), "dedup")
    assert sorted(r.value for r in got.collect()) == ["other", "same"]


FLOW = Flow("f", (Step("a", "x"), Step("b", "y"), Step("c", "z")))


@pytest.fixture(scope="module")
def flow_path(spark):
    return write_batches(spark, [
        [("whole", 0, 0), ("whole", 1, 1), ("split", 0, 0), ("lost", 0, 2), ("lost", 2, 3)],
        [("whole", 2, 2), ("split", 2, 20), ("whole", 2, 21)],
        [("split", 1, 30), ("end", 0, 1000)],
        [("end", 0, 2000)],
    ], "correlation_id STRING, step INT, ts TIMESTAMP")


def test_prompt_flow_status(spark, flow_path):
    out = drain(prompt_flow_status(stream_of(spark, flow_path), FLOW, 60, "10 seconds"), "prompt")
    got = sorted(tuple(r) for r in out.collect())
    assert got == [
        ("end", "expired", 1, "1,2"), ("lost", "expired", 2, "1"),
        ("split", "complete", 3, ""), ("whole", "complete", 3, ""),
    ]


def test_session_flow_status(spark, flow_path):
    out = drain(stream_flow_status(stream_of(spark, flow_path), FLOW, "60 seconds", "10 seconds"), "session")
    got = sorted(tuple(r) for r in out.collect())
    # Only the last session of "end" is still open.
    assert got == [
        ("end", "expired", 1, "1,2"), ("lost", "expired", 2, "1"),
        ("split", "complete", 3, ""), ("whole", "complete", 3, ""),
    ]


@pytest.mark.parametrize("make", [
    lambda s, f: drain(stream_flow_status(s, f, "60 seconds", "10 seconds"), "long", "complete"),
    lambda s, f: drain(prompt_flow_status(s, f, 60, "10 seconds"), "long-prompt"),
])
def test_flows_of_many_steps(spark, make):
    long = Flow("g", tuple(Step("a", f"e{k}") for k in range(70)))
    path = write_batches(spark, [
        [("whole", k, k % 5) for k in range(70)] + [("part", k, 0) for k in range(70) if k not in (3, 61, 62, 69)], [("late", 1, 900)], [("late", 1, 1000)],
    ], "correlation_id STRING, step INT, ts TIMESTAMP")
    got = {r.correlation_id: (r.status, r.seen, r.missing) for r in make(stream_of(spark, path), long).collect()}
    assert got["whole"] == ("complete", 70, "") and got["part"] == ("expired", 66, "3,61,62,69")


def test_route_writes_each_batch_once(spark):
    path = scratch_path(spark, "msgs")
    base = rows(spark, 400).withColumn("ts", F.timestamp_seconds("row_index"))
    made = synth_messages(base, TopicSpec("t"), 1).withColumn("offset", F.col("row_index"))
    write_messages(made, path, partition_by=None)
    msgs = read_messages(spark, path, streaming=True, schema=MESSAGE).withColumn("group_id", F.lit("g"))
    ok, dlq, cp = (scratch_path(spark, n) for n in ("ok", "dlq", "cp"))
    policy = FailurePolicy(0.3, on_failure="dlq")
    for _ in range(2):  # the second run finds nothing new
        stream_route(msgs, policy, ok, dlq, cp, 1, {"availableNow": True}).awaitTermination()
    good, bad = spark.read.parquet(ok), spark.read.parquet(dlq)
    assert good.count() + bad.count() == 400 and 80 < bad.count() < 160
    assert {r.topic for r in bad.select("topic").distinct().collect()} == {"t-dlq"}


def test_generated_stream_equals_batch(spark):
    topic = TopicSpec("t", key_distribution="zipfian", key_cardinality=10, duplicate_rate=0.1)
    out, cp = scratch_path(spark, "gen"), scratch_path(spark, "cp")
    stream = stream_messages(row_batches(spark, 200, 0, 1000), topic, 3)
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", cp).start()
    try:
        deadline = time.time() + 90
        while len(query.recentProgress) < 3 and time.time() < deadline:
            time.sleep(0.5)
    finally:
        query.stop()
    got = spark.read.parquet(out)
    n = got.agg(F.max("row_index")).first()[0] + 1
    assert n >= 200
    from eventlab.operators.synth import inject_duplicates

    times = got.select("row_index", "ts").distinct()
    want = inject_duplicates(synth_messages(times, topic, 3), 0.1, 3)
    assert want.exceptAll(got.select(want.columns)).count() == 0 and got.count() == want.count()


def test_rate_stream_columns(spark):
    stream = row_stream(spark, 50, 2)
    assert stream.isStreaming and stream.dtypes == [("row_index", "bigint"), ("ts", "timestamp")]
