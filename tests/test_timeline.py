import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from eventlab.functions.draw import digest
from eventlab.operators import timeline as tl

INCIDENT = (
    "incident_id INT, type STRING, at_seconds INT, every_seconds INT, initial_delay_seconds INT, duration_seconds INT"
)


def busy(kind, duration):
    return {"pause_consumer": duration or 0, "rebalance_consumer": 5}.get(kind, 0)


def test_schedule_matches_simulation(spark):
    rng = random.Random(1)
    kinds = ["pause_consumer", "rebalance_consumer", "stop_broker"]
    rows = [
        (i, rng.choice(kinds), rng.choice([None, rng.randint(-5, 150)]), rng.choice([None, 0, rng.randint(1, 30)]),
         rng.choice([None, 0, rng.randint(1, 120)]), rng.choice([None, rng.randint(0, 20)]))
        for i in range(200)
    ]
    want = set()
    for i, kind, at, every, delay, duration in rows:
        if every:
            t = delay or 0
            while t <= 100:
                want.add((i, t))
                t += every + busy(kind, duration)
        elif at is not None and at <= 100:
            want.add((i, max(at, 0)))
    got = tl.expand_schedule(spark.createDataFrame(rows, INCIDENT), 100).select("incident_id", "fire").collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_groups_match_simulation(spark):
    rng = random.Random(7)
    rows, want = [], set()
    for g in range(150):
        repeat, gap = rng.randint(1, 6), rng.randint(0, 40)
        items = [
            (g, pos, rng.choice(["pause_consumer", "rebalance_consumer", "stop_broker"]),
             rng.choice([None, rng.randint(-3, 60)]), rng.randint(0, 25), repeat, gap)
            for pos in range(rng.randint(1, 6))
        ]
        rows += items
        now = 0
        for cycle in range(repeat):
            now = max(now, cycle * gap)
            for _, pos, kind, at, duration, _, _ in items:
                if at is not None:
                    now = max(now, cycle * gap + at)
                if now <= 200:
                    want.add((g, cycle, pos, now))
                now += busy(kind, duration)
    df = spark.createDataFrame(
        rows, "group_id INT, pos INT, type STRING, at_seconds INT, duration_seconds INT, repeat INT, interval_seconds INT"
    )
    got = {tuple(r) for r in tl.expand_groups(df, 200).select("group_id", "cycle", "pos", "fire").collect()}
    assert got == want


def test_effects_end_with_the_next_change(spark):
    rows = [
        (1, "pause_consumer", "a", 10, 30), (2, "rebalance_consumer", "a", 12, None),
        (3, "increase_consumer_delay", "a", 0, None), (4, "increase_consumer_delay", "a", 50, None),
        (5, "increase_consumer_delay", "b", 20, None), (6, "change_producer_rate", "a", 60, None),
        (7, "stop_broker", "k1", 5, None), (8, "start_broker", "k1", 25, None), (9, "stop_broker", "k2", 90, None),
        (10, "pause_consumer", "a", 95, 30), (11, "change_producer_rate", "a", 60, None),
    ]
    df = spark.createDataFrame(rows, "incident_id INT, type STRING, target STRING, fire BIGINT, duration_seconds INT")
    got = {(r.incident_id, r.seg_from, r.seg_to) for r in tl.effect_intervals(df, 100).collect()}
    assert got == {
        (1, 10, 40), (2, 12, 17), (3, 0, 50), (4, 50, 100), (5, 20, 100), (11, 60, 100),
        (7, 5, 25), (9, 90, 100), (10, 95, 100),
    }


@pytest.fixture(scope="module")
def members(spark):
    rows = [(i, "ab"[i % 2], f"g{i % 3}") for i in range(100)]
    return spark.createDataFrame(rows, "member_id BIGINT, topic STRING, group_id STRING").cache()


@pytest.mark.parametrize("target,size", [
    ({}, 100), ({"topic": "a"}, 50), ({"topic": "a", "group": "g0"}, 17), ({"count": 7}, 7),
    ({"topic": "a", "count": 70}, 50), ({"percentage": 10}, 10), ({"topic": "a", "percentage": 25}, 12),
    ({"percentage": 0}, 1), ({"topic": "a", "percentage": 1}, 1), ({"percentage": 250}, 100),
    ({"count": 3, "percentage": 90}, 3), ({"count": 0}, 0), ({"topic": "none", "percentage": 50}, 0),
])
def test_target_sizes(members, target, size):
    got = tl.select_target(members, target, 4)
    assert got.count() == size and got.distinct().count() == size
    if target.get("topic"):
        assert got.where(F.col("topic") != target["topic"]).count() == 0


def test_the_first_members_by_hash_are_taken(members):
    for k in (0, 1, 20, 10_000):
        by_hash = members.where("topic = 'a'").orderBy(digest(4, "target", F.col("member_id")), "member_id").limit(k).collect()
        assert sorted(tl.select_target(members, {"topic": "a", "count": k}, 4).collect()) == sorted(by_hash)


def test_group_defaults_and_endless_repeats(spark):
    items = spark.createDataFrame(
        [(1, 0, "stop_broker", 5, None, None, None), (2, 0, "stop_broker", 5, None, 3, None), (3, 0, "stop_broker", None, None, 10**9, 20)],
        "group_id long, pos long, type string, at_seconds long, duration_seconds long, repeat long, interval_seconds long")
    got = tl.expand_groups(items, 400).collect()
    assert sorted(r.fire for r in got if r.group_id == 1) == [5]
    assert sorted(r.fire for r in got if r.group_id == 2) == [5, 65, 125]
    assert sorted(r.fire for r in got if r.group_id == 3) == list(range(0, 401, 20))


def test_targets_are_drawn_and_checked(members):
    ids = {r.member_id for r in tl.select_target(members, {"percentage": 30}, 4).collect()}
    assert ids == {r.member_id for r in tl.select_target(members, {"count": 30}, 4).collect()}
    assert ids != {r.member_id for r in tl.select_target(members, {"count": 30}, 5).collect()}
    assert tl.pick_one(members, 4).count() == 1
    with pytest.raises(ValueError):
        tl.select_target(members, {"indices": [1]})


T0 = datetime(2024, 1, 1)
ZERO = int((T0 - datetime(1970, 1, 1)).total_seconds()) * 1_000_000


@pytest.fixture(scope="module")
def timed(spark):
    rng = random.Random(3)
    # One topic holds most messages.
    rows = [(rng.choice("aaaaab"), rng.randint(0, 5000), i) for i in range(600)]
    df = spark.createDataFrame(
        [(t, T0 + timedelta(seconds=s), i, int(i % 4 == 0)) for t, s, i in rows],
        "topic STRING, ts TIMESTAMP_NTZ, row_index BIGINT, failures INT",
    )
    spans = [(rng.choice("abc"), a, a + rng.randint(0, 700), i) for i in range(40) for a in [rng.randint(0, 5000)]]
    ivs = spark.createDataFrame(
        [(t, ZERO + a * 1_000_000, ZERO + b * 1_000_000, i) for t, a, b, i in spans],
        "topic STRING, seg_from BIGINT, seg_to BIGINT, incident_id BIGINT",
    )
    return rows, df, spans, ivs


@pytest.mark.parametrize("limit", [0, 100_000])
def test_annotation_and_pauses(timed, limit):
    rows, df, spans, ivs = timed
    want = {i: sorted(k for tt, a, b, k in spans if tt == t and a <= s < b) for t, s, i in rows}
    got = tl.annotate(df, ivs, ["topic"], broadcast_rows=limit).collect()
    assert {r.row_index: r.incidents or [] for r in got} == want and len(got) == len(rows)
    free = tl.outside(df, ivs, ["topic"], broadcast_rows=limit)
    assert {r.row_index for r in free.collect()} == {i for i, w in want.items() if not w}
    held = tl.outside(df, ivs, ["topic"], inside=True, broadcast_rows=limit)
    assert {r.row_index for r in held.collect()} == {i for i, w in want.items() if w}


@pytest.mark.parametrize("limit", [0, 100_000])
def test_latest_setting(spark, timed, limit):
    rows, df, _, _ = timed
    rng = random.Random(9)
    changes = [(rng.choice("ab"), rng.randint(200, 5000), float(n)) for n in range(30)]
    cdf = spark.createDataFrame(
        [(t, ZERO + s * 1_000_000, v) for t, s, v in changes], "topic STRING, at_micros BIGINT, setting DOUBLE"
    )
    got = tl.asof_setting(df, cdf, ["topic"], -1.0, broadcast_rows=limit).collect()
    for r, (t, s, i) in zip(sorted(got, key=lambda r: r.row_index), rows):
        past = [(at, v) for tt, at, v in changes if tt == t and at <= s]
        assert r.setting == (max(past)[1] if past else -1.0)


def test_impact_counts_phases(timed):
    rows, df, spans, ivs = timed
    got = {(r.phase, r.incident_id): (r.messages, r.failed) for r in tl.impact(df, ivs, ["topic"], 300).collect()}
    for t, a, b, k in spans:
        for phase, x, y in (("before", a - 300, a), ("during", a, b), ("after", b, b + 300)):
            hit = [i for tt, s, i in rows if tt == t and x <= s < y]
            if b > a:
                assert got[phase, str(k)] == (len(hit), sum(i % 4 == 0 for i in hit))
            else:
                assert (phase, str(k)) not in got
