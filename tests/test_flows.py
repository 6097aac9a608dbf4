import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from eventlab.operators.flows import (
    Flow, Step, correlate, flow_messages, flow_status, flow_violations, step_latency,
)
from eventlab.plans.spec import fields_of
from eventlab.session import scratch_path
from eventlab.sources.tables import spread

T0 = datetime(2024, 1, 1)
FLOW = Flow("f", (
    Step("a", "started", 500, tuple(fields_of([{"name": "id", "type": "int", "max": 9}]))),
    Step("b", "moved", 250),
    Step("a", "ended", 1000, tuple(fields_of([{"name": "why", "type": "enum", "values": ["x", "y"]}]))),
))


@pytest.fixture(scope="module")
def instances(spark):
    return spark.range(300).select(
        F.col("id").alias("row_index"), (F.lit(T0).cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("id"))).alias("ts")
    )


def test_steps_delays_and_payloads(instances):
    out = flow_messages(instances, FLOW, 1).orderBy("row_index", "step").collect()
    assert len(out) == 900
    for n in range(300):
        start, mid, end = out[3 * n: 3 * n + 3]
        base = T0 + timedelta(seconds=n)
        # The delay of the first step does not count.
        assert [m.ts - base for m in (start, mid, end)] == [timedelta(), timedelta(milliseconds=250), timedelta(milliseconds=1250)]
        assert [m.topic for m in (start, mid, end)] == ["a", "b", "a"]
        assert len({m.key for m in (start, mid, end)}) == 1
        assert list(json.loads(start.value)) == ["correlation_id", "event_type", "id"]
        assert json.loads(mid.value) == {"correlation_id": mid.key, "event_type": "moved"}
        assert json.loads(end.value)["why"] in ("x", "y")
    assert len({m.key for m in out}) == 300


def test_correlation_by_field(instances):
    ref = Flow("f", FLOW.steps, correlation=("field_ref", "id"))
    out = flow_messages(instances, ref, 1).collect()
    assert {m.key for m in out} == {str(n) for n in range(10)}
    for m in out:
        if m.step == 0:
            assert str(json.loads(m.value)["id"]) == m.key
    unknown = Flow("f", FLOW.steps, correlation=("field_ref", "nope"))
    assert len({m.key for m in flow_messages(instances, unknown, 1).collect()}) == 300


def test_lookup_fields_in_steps(spark, instances):
    from eventlab.operators.synth import lookup_values

    who = tuple(fields_of([{"name": "who", "type": "faker", "provider": "name"}]))
    flow = Flow("f", (Step("a", "x", 0, who), Step("b", "y", 10, who)), correlation=("field_ref", "who"))
    names = lookup_values(spark.range(3), F.concat(F.lit("n"), F.col("id")), "id", "name")
    out = flow_messages(instances, flow, 1, lookups=names).collect()
    assert len(out) == 600 and {m.key for m in out} == {"n0", "n1", "n2"}
    assert all(json.loads(m.value)["who"] == m.key for m in out if m.step == 0)
    assert any(json.loads(m.value)["who"] != m.key for m in out if m.step == 1)


def test_bad_flows_are_rejected():
    with pytest.raises(ValueError):
        Step("a", "e", -1)
    with pytest.raises(ValueError):
        Step("a", "e", 0, tuple(fields_of([{"name": "event_type", "type": "int"}])))
    with pytest.raises(ValueError):
        Flow("f", ())
    with pytest.raises(ValueError):
        Flow("f", FLOW.steps, correlation="random")
    with pytest.raises(ValueError):
        Flow("f", FLOW.steps, rate=0)


def messages(spark, rows):
    return spark.createDataFrame(
        [(c, s, T0 + timedelta(microseconds=t)) for c, s, t in rows], "correlation_id STRING, step INT, ts TIMESTAMP_NTZ"
    )


def test_status_and_rules(spark):
    msgs = messages(spark, [
        ("good", 0, 0), ("good", 1, 5), ("good", 2, 9), ("good", 2, 11),
        ("late", 0, 7), ("late", 1, 5), ("late", 2, 9),
        ("gap", 0, 0), ("gap", 2, 4),
        ("headless", 1, 3),
    ])
    status = {r.correlation_id: (r.seen, r.missing, r.complete, r.messages) for r in flow_status(msgs, FLOW).collect()}
    assert status == {
        "good": ([0, 1, 2], [], True, 4), "late": ([0, 1, 2], [], True, 3),
        "gap": ([0, 2], [1], False, 2), "headless": ([1], [0, 2], False, 1),
    }
    rules = sorted((r.correlation_id, r.rule) for r in flow_violations(msgs, FLOW).collect())
    assert rules == [
        ("gap", "step 1 skipped"), ("headless", "first step missing"), ("headless", "step 0 skipped"),
        ("late", "step 1 out of order"),
    ]


def test_step_latency_quantiles(spark):
    rng = random.Random(2)
    gaps = [rng.randint(1, 50) for _ in range(201)]
    msgs = messages(spark, [x for i, g in enumerate(gaps) for x in ((str(i), 0, i), (str(i), 1, i + g))])
    (r,) = step_latency(msgs, FLOW).collect()
    ordered = sorted(gaps)
    assert (r.step, r.n, r.min_micros, r.max_micros) == (1, 201, ordered[0], ordered[-1])
    assert (r.p50_micros, r.p95_micros, r.configured_ms) == (ordered[100], ordered[190], 250)


def test_correlate_matches_brute_force(spark):
    rng = random.Random(4)

    def side(n):
        # One id holds most rows, and times repeat.
        return [(rng.choice(["hot"] * 8 + ["x", "y"]), rng.randint(0, 400)) for _ in range(n)]

    a, b = side(300), side(120)

    def frame(rows):
        return spark.createDataFrame(
            [(k, T0 + timedelta(milliseconds=t)) for k, t in rows], "correlation_id STRING, ts TIMESTAMP_NTZ"
        )

    zero = int((T0 - datetime(1970, 1, 1)).total_seconds()) * 1000
    got = {
        (r.correlation_id, r.a_micros // 1000 - zero): (r.a_rows, r.b_micros and r.b_micros // 1000 - zero)
        for r in correlate(frame(a), frame(b), 0.02).collect()
    }
    want = {}
    for k, t in a:
        later = [x for kk, x in b if kk == k and t <= x <= t + 20]
        want[k, t] = (a.count((k, t)), min(later, default=None))
    assert got == want
    inner = correlate(frame(a), frame(b), 0.02, "inner").count()
    assert inner == sum(v[1] is not None for v in want.values())
    with pytest.raises(ValueError):
        correlate(frame(a), frame(b), 0.02, "outer")


def test_tasks_hold_as_many_rows_whatever_the_table(spark, monkeypatch):
    monkeypatch.setattr("eventlab.sources.tables.ROWS_PER_TASK", 100, raising=False)
    sizes = {}
    for rows in (400, 4_000):
        path = scratch_path(spark, "instances")
        spark.range(rows).select(F.col("id").alias("row_index"), F.timestamp_seconds("id").alias("ts")).coalesce(1).write.parquet(path)
        msgs = flow_messages(spread(spark.read.parquet(path)), FLOW, 3)
        per_task = [r["count"] for r in msgs.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(per_task) == rows * len(FLOW.steps) and msgs.select("row_index").distinct().count() == rows
        sizes[rows] = max(per_task)
    assert sizes[4_000] <= 1.5 * sizes[400], sizes
    # Enough splits are left alone, and so are streams.
    many = scratch_path(spark, "many")
    spark.range(400).repartition(16).write.parquet(many)
    with monkeypatch.context() as m:
        m.setattr(type(spark.range(0)), "repartition", lambda *_: pytest.fail("dealt out"))
        spark.conf.set("spark.sql.files.openCostInBytes", "1g")
        try:
            spread(spark.read.parquet(many))
            spread(spark.readStream.schema("id BIGINT").parquet(many))
        finally:
            spark.conf.unset("spark.sql.files.openCostInBytes")
