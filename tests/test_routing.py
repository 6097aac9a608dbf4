import base64
import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from eventlab.operators.routing import (
    FailurePolicy, dlq_envelope, dlq_parse, dlq_replay, filter_incidents, process, visible_to, with_groups,
)

N = 20_000


@pytest.fixture(scope="module")
def msgs(spark):
    return spark.range(N).select(
        F.lit("t").alias("topic"), F.lit(0).alias("partition"), F.col("id").alias("offset"),
        F.lit("v").alias("value"), F.timestamp_seconds("id").alias("ts"), F.col("id").alias("row_index"),
    )


def run(msgs, **policy):
    return process(with_groups(msgs, 1), FailurePolicy(**policy), 3)


def test_no_failures_by_default(msgs):
    out = run(msgs)
    assert out.where((F.col("status") != "ok") | (F.col("failures") > 0) | F.col("commit_failed")).count() == 0


@pytest.mark.parametrize("policy,status", [("skip", "skip"), ("dlq", "dlq"), ("retry", "exhausted")])
def test_everything_fails_at_rate_one(msgs, policy, status):
    out = run(msgs, failure_rate=1.0, on_failure=policy, max_retries=2, commit_failure_rate=1.0)
    tries = 3 if policy == "retry" else 1
    assert out.where(
        (F.col("status") != status) | (F.col("failures") != tries) | (F.col("attempts") != tries)
        | (F.col("retries") != tries - 1) | F.col("commit_failed")
    ).count() == 0


def test_retries_follow_independent_attempts(msgs):
    p, m = 0.3, 3
    out = run(msgs, failure_rate=p, on_failure="retry", max_retries=m)
    counts = {r.failures: r["count"] for r in out.groupBy("failures").count().collect()}
    for k in range(m + 2):
        want = p**k * (1 - p) if k <= m else p ** (m + 1)
        assert abs(counts.get(k, 0) / N - want) < 0.015
    s = out.agg(F.sum("failures"), F.sum("retries"), F.count_if(F.col("status") == "exhausted")).first()
    assert s[0] == s[1] + s[2]
    assert out.where((F.col("status") == "ok") != (F.col("failures") <= m)).count() == 0


def test_zero_retries_still_exhaust(msgs):
    out = run(msgs, failure_rate=0.5, on_failure="retry", max_retries=0)
    assert {r.status for r in out.select("status").distinct().collect()} == {"ok", "exhausted"}
    assert out.agg(F.sum("retries")).first()[0] == 0


def test_groups_draw_independently(msgs):
    out = process(with_groups(msgs, 2), FailurePolicy(failure_rate=0.2), 3)
    wide = out.groupBy("row_index").agg(F.sum("failures").alias("f"))
    share = {r.f: r["count"] / N for r in wide.groupBy("f").count().collect()}
    assert abs(share[2] - 0.04) < 0.01 and abs(share[1] - 0.32) < 0.02


def test_commit_failures_only_after_success(msgs):
    out = run(msgs, failure_rate=0.4, commit_failure_rate=0.5, on_failure="skip")
    assert out.where(F.col("commit_failed") & (F.col("status") != "ok")).count() == 0
    ok = out.where("status = 'ok'").agg(F.avg(F.col("commit_failed").cast("int"))).first()[0]
    assert abs(ok - 0.5) < 0.02


@pytest.mark.parametrize("bad", [
    {"failure_rate": 1.1}, {"commit_failure_rate": -0.1}, {"on_failure": "drop"}, {"max_retries": -1},
])
def test_bad_policies_are_rejected(bad):
    with pytest.raises(ValueError):
        FailurePolicy(**bad)


PAYLOADS = [b"plain text", '{"a": "é\n"}'.encode(), bytes([0x80, 0x81, 0x82, 0xFF]), None, b""]


def failed_rows(spark):
    rows = [("orders", 2, i, bytearray(p) if p is not None else None, datetime(2024, 1, 2, 3, 4, 5, 600))
            for i, p in enumerate(PAYLOADS)]
    return spark.createDataFrame(rows, "topic STRING, partition INT, offset BIGINT, value BINARY, ts TIMESTAMP_NTZ")


def test_envelope_format(spark):
    out = dlq_envelope(failed_rows(spark), "broken").orderBy(F.get_json_object("value", "$.original_offset")).collect()
    for i, (r, p) in enumerate(zip(out, PAYLOADS)):
        assert r.topic == "orders-dlq" and r.key is None
        e = json.loads(r.value)
        assert list(e)[:6] == ["original_topic", "original_partition", "original_offset", "error", "timestamp", "payload"]
        assert (e["original_topic"], e["original_partition"], e["original_offset"], e["error"]) == ("orders", 2, i, "broken")
        assert datetime.fromisoformat(e["timestamp"]).microsecond == 600
        if p is None:
            assert e["payload"] is None and "payload_encoding" not in e
        elif i == 2:
            assert base64.b64decode(e["payload"]) == p and e["payload_encoding"] == "base64"
        else:
            assert e["payload"] == p.decode() and "payload_encoding" not in e


def test_replay_finds_source_rows(spark):
    failed = failed_rows(spark)
    source = failed.where("offset <> 0").withColumn("key", F.lit("k"))
    envelopes = dlq_envelope(failed)
    assert {bytes(r.payload) if r.payload is not None else None for r in dlq_parse(envelopes).collect()} == set(PAYLOADS)
    got = {r.original_offset: (r.found, r.same, r.key) for r in dlq_replay(envelopes, source).collect()}
    assert got == {0: (False, False, None), **{i: (True, True, "k") for i in range(1, 5)}}


def test_filter_incidents_drops_empty_groups(spark):
    kind = "array<struct<type:string>>"
    df = spark.createDataFrame(
        [("s", [("stop_broker",), ("pause_consumer",)],
          [(3, 20, [("start_broker",)]), (2, 10, [("stop_broker",), ("change_producer_rate",)])]),
         ("t", [], [])],
        f"name STRING, incidents {kind}, groups array<struct<repeat:int,interval_seconds:int,incidents:{kind}>>",
    )
    got = {r.name: r for r in filter_incidents(df).collect()}
    assert [i.type for i in got["s"].incidents] == ["pause_consumer"] and got["s"].skipped == 3
    (group,) = got["s"].groups
    assert (group.repeat, group.interval_seconds, [i.type for i in group.incidents]) == (2, 10, ["change_producer_rate"])
    assert (got["t"].incidents, got["t"].groups, got["t"].skipped) == ([], [], 0)


@pytest.mark.parametrize("limit", [0, 100_000])
def test_visibility_depends_on_reset(spark, msgs, limit):
    groups = spark.createDataFrame(
        [("t", "early", datetime(1970, 1, 1)), ("t", "later", datetime(1970, 1, 1, 1))],
        "topic STRING, group_id STRING, joined_at TIMESTAMP",
    )
    seen = {r.group_id: r["count"] for r in visible_to(msgs, groups, "latest", limit).groupBy("group_id").count().collect()}
    assert seen == {"early": N, "later": N - 3600}
    assert visible_to(msgs, groups, "earliest", limit).count() == 2 * N
    with pytest.raises(ValueError):
        visible_to(msgs, groups, "newest")
