"""Closed rows of a stream and what its state holds open, together against plain folds."""

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from eventlab.operators.flows import Flow, Step
from eventlab.operators.sessions import sessions
from eventlab.session import scratch_path
from eventlab.sources.tables import read_messages
from eventlab.streaming import monitors as mon
from eventlab.streaming import flow_state as fs
from eventlab.streaming.tails import drained
from tests.test_streaming import MSG, T0, stream_of, write_batches


@pytest.fixture(scope="module")
def path(spark):
    return write_batches(spark, [
        [("t", "k", "a", 0, 0), ("t", "k", "bb", 1, 30), ("u", "k", "c", 2, 40)],
        [("t", "l", "c", 3, 500)],
        [("t", "l", "c", 4, 505)],
        # Nine days late, and a row in time.
        [("t", "k", "d", 5, -777_600), ("t", "k", "e", 6, 510)],
        [("t", "k", "f", 7, 520)],
    ], MSG)


def seconds(r, name="start"):
    return (r[name] - T0).total_seconds()


def test_late_rows_are_dropped_and_open_windows_read(spark, path):
    done = drained(mon.stream_throughput(stream_of(spark, path), "1 minute", "1 minute"), "throughput")
    rows = done.whole(mon.open_throughput(spark, done.checkpoint)).collect()
    assert {(r.topic, seconds(r), r.messages, r.bytes, r.closed) for r in rows} == {
        ("t", 0, 2, 3, True), ("u", 0, 1, 1, True), ("t", 480, 4, 4, False)}


def test_open_sliding_windows(spark, path):
    processed = lambda df: df.withColumn("group_id", F.lit("g")).withColumn("failures", (F.col("row_index") % 2).cast("int"))
    done = drained(mon.stream_failure_rate(processed(stream_of(spark, path)), "2 minutes", "1 minute", "1 minute"), "rate")
    rows = done.whole(mon.open_failure_rate(spark, done.checkpoint)).collect()
    assert {(r.topic, seconds(r), r.messages, r.failed, r.failure_rate, r.closed) for r in rows} == {
        ("t", -60, 2, 1, 0.5, True), ("t", 0, 2, 1, 0.5, True), ("u", -60, 1, 0, 0.0, True), ("u", 0, 1, 0, 0.0, True),
        ("t", 420, 4, 2, 0.5, False), ("t", 480, 4, 2, 0.5, False)}


def test_open_sessions(spark, path):
    done = drained(mon.stream_sessions(stream_of(spark, path), "100 seconds", "1 minute"), "sessions")
    rows = done.whole(mon.open_sessions(spark, done.checkpoint)).collect()
    assert {(r.key, seconds(r), seconds(r, "end"), r.messages, r.closed) for r in rows} == {
        ("k", 0, 140, 3, True), ("l", 500, 605, 2, False), ("k", 510, 620, 2, False)}


def test_state_does_not_grow_with_batches(spark):
    base = spark.range(2_000).select(
        F.lit("t").alias("topic"), F.concat(F.lit("k"), (F.col("id") % 3).cast("string")).alias("key"), F.lit("v").alias("value"), F.col("id").alias("row_index"),
        F.timestamp_seconds(F.lit(1_000_000) + F.col("id") * 30).alias("ts"))
    path = scratch_path(spark, "many")
    base.repartitionByRange(25, "row_index").sortWithinPartitions("row_index").write.parquet(path)
    windows = mon.stream_throughput(stream_of(spark, path), "10 minutes", "5 minutes")
    query = windows.writeStream.format("parquet").option("path", scratch_path(spark, "out")).option(
        "checkpointLocation", scratch_path(spark, "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress]
    # 80 rows a batch, 40 minutes: five windows, and those of the batch before.
    assert len(held) >= 25 and max(held) <= 11, held


def test_messages_that_still_wait(spark):
    produced = write_batches(spark, [[("t", 0, o, o * 10) for o in range(8)]], "topic STRING, partition INT, offset BIGINT, ts TIMESTAMP")
    consumed = write_batches(spark, [[("t", 0, 0, 5), ("t", 0, 3, 30), ("t", 0, 5, 99), ("t", 0, 6, 61)]], "topic STRING, partition INT, offset BIGINT, ts TIMESTAMP")
    done = drained(mon.stream_lag(stream_of(spark, produced), stream_of(spark, consumed), "20 seconds", "10 seconds"), "lag")
    rows = {r.offset: (r.lagging, r.closed) for r in done.whole(mon.open_lag(done)).collect()}
    # The watermark is that of the slower side, second 60: messages up to second 39 are closed.
    assert rows == {0: (False, True), 1: (True, True), 2: (True, True), 3: (False, True), 4: (True, False), 5: (True, False), 6: (False, True), 7: (True, False)}


FLOW = Flow("f", tuple(Step(f"s{n}", "x") for n in range(70)))
SHORT = Flow("f", (Step("a", "x"), Step("b", "y"), Step("c", "z")))


@pytest.fixture(scope="module")
def flow_path(spark):
    rows = [("all", s, s) for s in range(70)] + [("most", s, s) for s in range(69) if s != 64]
    return write_batches(spark, [rows, [("late", 1, 300)]], "correlation_id STRING, step INT, ts TIMESTAMP")


def test_open_flows_of_many_steps(spark, flow_path):
    done = drained(fs.stream_flow_status(stream_of(spark, flow_path), FLOW, "10 minutes", "1 minute"), "flows")
    rows = done.whole(fs.open_flow_status(spark, done.checkpoint, FLOW)).collect()
    missing = ",".join(str(s) for s in range(70) if s != 1)
    want = {("all", "complete", 70, ""), ("most", "expired", 68, "64,69"), ("late", "expired", 1, missing)}
    assert {(r.correlation_id, r.status, r.seen, r.missing) for r in rows} == want and not any(r.closed for r in rows)
    prompt = drained(fs.prompt_flow_status(stream_of(spark, flow_path), FLOW, 600, "1 minute"), "prompt")
    rows = prompt.whole(fs.open_prompt_flow_status(spark, prompt.checkpoint, FLOW)).collect()
    assert {(r.correlation_id, r.status, r.seen, r.missing) for r in rows} == want
    assert {r.correlation_id for r in rows if r.closed} == {"all"}


def test_prompt_flows_go_on_from_their_checkpoint(spark):
    schema = "correlation_id STRING, step INT, ts TIMESTAMP"
    path, out, checkpoint = (scratch_path(spark, n) for n in ("in", "out", "cp"))

    def run(batch):
        spark.createDataFrame([(*r[:-1], T0 + timedelta(seconds=r[-1])) for r in batch], schema).coalesce(1).write.mode("append").parquet(path)
        flows = fs.prompt_flow_status(stream_of(spark, path), SHORT, 60, "10 seconds")
        flows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
        closed = {(r.correlation_id, r.status, r.seen) for r in spark.read.parquet(out).collect()}
        return closed, {(r.correlation_id, r.seen, r.missing) for r in fs.open_prompt_flow_status(spark, checkpoint, SHORT).collect()}

    assert run([("x", 0, 0), ("x", 1, 1), ("y", 2, 0)]) == (set(), {("x", 2, "2"), ("y", 1, "0,1")})
    assert run([("x", 2, 5)]) == ({("x", "complete", 3)}, {("y", 1, "0,1")})
    # The repeat is known, y's time is up, z is new.
    closed, waiting = run([("x", 2, 6), ("z", 0, 500)])
    assert closed == {("x", "complete", 3), ("y", "expired", 1)} and waiting == {("z", 1, "1,2")}


def plain_flows(batches, steps, timeout, late):
    """Closed and open flows of batches of (id, step, second or None), one flow and message at a time."""
    before, mark, top, flows, closed = 0, 0, 0, {}, Counter()
    base = int((T0 - datetime(1970, 1, 1)).total_seconds())
    for batch in [*batches, []]:
        rows = [(i, s, None if t is None else (base + t) * 1000) for i, s, t in batch]
        # Rows are late by the watermark of the batch before.
        top = max([top, *(r[2] for r in rows if r[2] is not None)])
        rows = [r for r in rows if r[2] is None or r[2] > before]
        for i in {r[0] for r in rows}:
            mine, held = [r for r in rows if r[0] == i], flows.get(i)
            first = min((r[2] for r in mine if r[2] is not None), default=0)
            seen = {r[1] for r in mine} | (held[0] if held else set())
            if len(seen) == steps and (held is None or len(held[0]) < steps):
                closed[i, "complete", steps, ""] += 1
            flows[i] = seen, held[1] if held else max(first + timeout * 1000, mark + 1)
        for i in [i for i, f in flows.items() if f[1] < mark]:
            seen = flows.pop(i)[0]
            if len(seen) < steps:
                closed[i, "expired", len(seen), ",".join(str(s) for s in range(steps) if s not in seen)] += 1
        before, mark = mark, max(mark, top - late * 1000)
    return closed, {(i, len(seen)) for i, (seen, _) in flows.items() if len(seen) < steps}


@pytest.mark.parametrize("buckets", [1, 5])
def test_prompt_flows_share_calls_and_state(spark, buckets):
    rng = random.Random(buckets)
    ids = [f"f{n}" for n in range(150)] + [None]
    batches = [[(rng.choice(ids), rng.randrange(3), rng.choice([None, *range(at, at + 90)])) for _ in range(120)] for at in (0, 40, 100, 130)]
    path = write_batches(spark, [[(i, s, t is not None, t or 0) for i, s, t in batch] for batch in batches], "correlation_id STRING, step INT, known BOOLEAN, ts TIMESTAMP")
    msgs = stream_of(spark, path).withColumn("ts", F.expr("CASE WHEN known THEN ts END")).drop("known")
    out, checkpoint = scratch_path(spark, "out"), scratch_path(spark, "cp")
    query = fs.prompt_flow_status(msgs, SHORT, 60, "10 seconds", buckets).writeStream.format("parquet").option("path", out).option(
        "checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    closed, waiting = plain_flows(batches, 3, 60, 10)
    assert Counter(tuple(r) for r in spark.read.parquet(out).collect()) == closed and len({r[1] for r in closed}) == 2
    assert {(r.correlation_id, r.seen) for r in fs.open_prompt_flow_status(spark, checkpoint, SHORT).collect()} == waiting and waiting
    # As many rows of state as buckets, not as flows.
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress) == buckets


def brute(rows, gap):
    times, out = {}, Counter()
    for k, t in rows:
        times.setdefault(k, []).append(t)
    for k, ts in times.items():
        ts.sort()
        start = ts[0]
        for a, b in zip(ts, ts[1:] + [None]):
            out[k, start] += 1
            if b is None or b - a >= gap:
                out[k, start, "end"] = a + gap
                start = b
    return {(k[0], k[1], out[k[0], k[1], "end"], n) for k, n in out.items() if len(k) == 2}


@pytest.mark.parametrize("seed,gap", [(1, 10), (2, 1), (3, 500)])
def test_sessions_of_a_table(spark, monkeypatch, seed, gap):
    monkeypatch.setattr("eventlab.operators.sessions.BLOCK", 3)
    rng = random.Random(seed)
    rows = [(rng.choice(["a", "b", None]), rng.randint(-500, 500)) for _ in range(300)] + [("a", 7)] * 50 + [("one", 3)]
    df = spark.createDataFrame([(k, datetime(2024, 1, 1) + timedelta(seconds=t)) for k, t in rows], "key STRING, ts TIMESTAMP").repartition(4)
    base = 1_704_067_200_000_000
    got = {(r.key, (r.start_micros - base) / 1e6, (r.end_micros - base) / 1e6, r.messages) for r in sessions(df, ["key"], gap).collect()}
    assert got == brute(rows, gap)
    assert sessions(df.limit(0), ["key"], gap).count() == 0


def test_no_row_is_dealt_out_by_its_key_alone(spark):
    df = spark.range(100).select(F.lit("hot").alias("key"), F.timestamp_seconds("id").alias("ts"))
    plan = sessions(df, ["key"], 5)._jdf.queryExecution().sparkPlan().toString()
    # The aggregates nearest to the rows: by key and slot, folded in each task before they are dealt out.
    folds = [line for line in plan.splitlines() if "partial_min(_at" in line]
    assert folds and all("_groupingexpression" in line.split("functions")[0] for line in folds), plan
