import random

import pytest
from pyspark.sql import functions as F

from eventlab.plans.ordering import explode_count, number_rows, running_max, running_total, successor
from eventlab.plans.segments import elementary, locate
from eventlab.plans.sizing import join_side, settle, small, within
from eventlab.plans.spec import Field, fields_of, spark_schema


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def keyed_rows(n=300, seed=3):
    rng = random.Random(seed)
    at = rng.sample(range(-2000, 2000), n)
    return [(rng.choice(["a", "b", None]), x, rng.randint(0, 9)) for x in at]


def test_running_total_crosses_blocks(spark):
    rows = keyed_rows()
    df = spark.createDataFrame(rows, "k STRING, at BIGINT, v BIGINT")
    got = {(r.k, r.at): r.s for r in running_total(df, ["k"], "at", "v", "s", block=50).collect()}
    assert len(got) == len(rows)
    for k, at, _ in rows:
        assert got[k, at] == sum(v for kk, a, v in rows if kk == k and a <= at)


def test_running_max_ignores_nulls(spark):
    rows = [(k, at, v if v % 3 else None) for k, at, v in keyed_rows()]
    df = spark.createDataFrame(rows, "k STRING, at BIGINT, v BIGINT")
    for r in running_max(df, ["k"], "at", "v", "m", block=50).collect():
        past = [v for k, a, v in rows if k == r.k and a <= r.at and v is not None]
        assert r.m == max(past, default=None)


def test_running_total_without_broadcast(spark, no_broadcast):
    test_running_total_crosses_blocks(spark)


def test_number_rows_without_keys(spark):
    df = spark.range(1000).withColumn("x", F.col("id") * 7)
    got = number_rows(df, [], "x", "n", block=64)
    assert got.where(F.col("n") != F.col("id")).count() == 0 and got.count() == 1000


def test_successor_skips_empty_ranges(spark):
    rows = keyed_rows()
    df = spark.createDataFrame(rows, "k STRING, at BIGINT, v BIGINT")
    for r in successor(df, ["k"], "at", "nxt", 100).collect():
        later = [a for k, a, _ in rows if k == r.k and a > r.at]
        assert r.nxt == min(later, default=None)


def test_explode_count_chunks(spark):
    df = spark.createDataFrame([(0,), (1,), (10,), (-3,)], "n INT")
    got = explode_count(df, F.col("n"), "i", chunk=4).groupBy("n").agg(F.sort_array(F.collect_list("i")).alias("i"))
    assert {r.n: r.i for r in got.collect()} == {1: [0], 10: list(range(10))}


def intervals(n=60, seed=5):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        a = rng.randint(0, 3000)
        out.append((rng.choice("xyz"), a, a + rng.randint(0, 400), i))
    return out


def test_elementary_segments_hold_open_intervals(spark):
    rows = intervals()
    df = spark.createDataFrame(rows, "k STRING, seg_from BIGINT, seg_to BIGINT, id BIGINT")
    got = elementary(df, ["k"], "id", width=100).collect()
    for k in "xyz":
        for x in range(0, 3500, 7):
            want = sorted(i for kk, a, b, i in rows if kk == k and a <= x < b)
            have = [r.labels for r in got if r.k == k and r.seg_from <= x < r.seg_to]
            assert have == ([want] if want else [])


@pytest.mark.parametrize("limit", [0, 100_000])
def test_locate_broadcast_and_merge_agree(spark, limit):
    segs = [("a", 0, 10, "p"), ("a", 10, 5000, "q"), ("b", 100, None, "r")]
    seg = spark.createDataFrame(segs, "k STRING, seg_from BIGINT, seg_to BIGINT, name STRING")
    rng = random.Random(1)
    rows = [(rng.choice("abc"), rng.randint(-50, 6000), i) for i in range(400)]
    df = spark.createDataFrame(rows, "k STRING, at BIGINT, i BIGINT")

    def name(k, x):
        return next((n for kk, a, b, n in segs if kk == k and a <= x and (b is None or x < b)), None)

    out = locate(df, F.col("at"), seg, ["k"], width=64, broadcast_rows=limit, open_ended=True)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert ("SortMergeJoin" in plan) == (limit == 0)
    got = out.collect()
    assert {r.i: r.name for r in got} == {i: name(k, x) for k, x, i in rows}
    assert len(got) == len(rows)
    semi = locate(df, F.col("at"), seg, ["k"], 64, "left_semi", limit, True)
    anti = locate(df, F.col("at"), seg, ["k"], 64, "left_anti", limit, True)
    inside = sum(name(k, x) is not None for k, x, _ in rows)
    assert (semi.count(), anti.count()) == (inside, len(rows) - inside)


def test_size_checks(spark):
    assert within(spark.range(10), 10) and not within(spark.range(11), 10)
    big = join_side(spark.range(11).toDF("id"), limit=10)
    plan = spark.range(5).join(big, "id")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan


def test_wide_sides_are_not_broadcast(spark):
    texts = spark.range(100).select("id", F.repeat(F.lit("x"), 20_000).alias("t"))
    lists = spark.range(10).select(F.array(F.struct("id", F.lit("abc").alias("s"))).alias("a"), F.create_map(F.lit("k"), "id").alias("m"))
    assert small(texts, 1_000) and not small(texts, 1_000, 1_000_000) and not small(texts, 50)
    assert small(lists, 10, 10_000) and not small(lists, 10, 300)
    assert small(spark.range(5), 10, known_rows=5) and not small(spark.range(5), 10, known_rows=11)
    plan = spark.range(5).join(join_side(texts.withColumn("t", F.repeat("t", 40))), "id")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan


def test_settle_keeps_rows_and_schema(spark):
    df = spark.range(10).withColumn("t", F.lit("x"))
    back = settle(df, "t")
    assert back.count() == 10 and back.dtypes == df.dtypes


@pytest.mark.parametrize("bad", [
    {"name": "x", "type": "decimal"},
    {"name": "x", "type": "enum"},
    {"name": "x", "type": "object"},
    {"name": "x", "type": "array"},
    {"name": "x", "type": "faker"},
    {"name": "x", "type": "int", "min": 5, "max": 1},
    {"name": "x", "type": "string", "min_length": -1},
    {"name": "x", "type": "string", "min_length": 30},
    {"name": "x", "type": "string", "cardinality": 0},
    {"name": "x", "type": "string", "length": 3},
])
def test_bad_fields_are_rejected(bad):
    with pytest.raises(ValueError):
        Field.of(bad)


def test_field_names_are_unique():
    with pytest.raises(ValueError):
        fields_of([{"name": "x", "type": "int"}, {"name": "x", "type": "uuid"}])


def test_spark_schema_of_nested_fields():
    fields = fields_of([
        {"name": "id", "type": "uuid"},
        {"name": "at", "type": "timestamp"},
        {"name": "items", "type": "array", "items": {"type": "object", "fields": [{"name": "q", "type": "float"}]}},
    ])
    assert spark_schema(fields).simpleString() == "struct<id:string,at:bigint,items:array<struct<q:double>>>"
