"""Semi-join reduction, blocked prefixes, sketches, heavy keys, buckets, lookups on streams, and the plans behind them."""

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from eventlab.operators import flows, stats
from eventlab.operators import synth as sy
from eventlab.operators.routing import dlq_envelope, dlq_replay
from eventlab.plans import ordering, sizing
from eventlab.plans.segments import count_between, locate
from eventlab.plans.spec import fields_of
from eventlab.session import scratch_path
from eventlab.sources.tables import join_buckets, read_messages, write_bucketed
from eventlab.streaming import monitors as mon
from eventlab.streaming.sinks import drain


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


# --- semi-join reduction -----------------------------------------------------


@pytest.mark.parametrize("limit,bits", [(100_000, 1 << 26), (0, 1 << 26), (0, 1 << 15), (0, 1 << 6)])
def test_rows_without_a_key_go_before_a_join(spark, limit, bits):
    big = spark.range(4_000).select((F.col("id") % 7).cast("string").alias("t"), (F.col("id") * 3).alias("o"), F.lit("v").alias("value"))
    big = big.unionByName(spark.createDataFrame([(None, 5, "v"), ("1", None, "v")], "t STRING, o BIGINT, value STRING"))
    few = spark.createDataFrame([("1", 3), ("1", 3), ("0", 0), (None, 5), ("6", 9_000), ("x", 1)], "t STRING, o BIGINT")
    got = sizing.only_keys_of(big, few, ["t", "o"], limit, bits)
    assert got.columns == big.columns
    want = {("1", 3), ("0", 0)}
    kept = {(r.t, r.o) for r in got.collect()}
    assert want <= kept and got.join(few.distinct(), ["t", "o"]).count() == 2
    if bits > 1 << 20:
        assert kept == want
    assert sizing.only_keys_of(big, few.limit(0), ["t", "o"], limit, bits).count() == 0


def test_payloads_without_a_letter_cross_no_exchange(spark):
    source = spark.range(2_000).select(
        F.lit("t").alias("topic"), (F.col("id") % 3).cast("int").alias("partition"), F.col("id").alias("offset"), F.lit("k").alias("key"),
        F.repeat(F.lit("x"), 50).alias("value"), F.timestamp_seconds("id").alias("ts"))
    letters = dlq_envelope(source.where("offset % 100 = 0"))
    for limit in (0, 100_000):
        out = dlq_replay(letters, source, limit)
        lines = out._jdf.queryExecution().optimizedPlan().toString().splitlines()
        reduced = next(i for i, line in enumerate(lines) if "LeftSemi" in line or "getbit" in line)
        assert any("Join LeftOuter" in line for line in lines[:reduced])
        got = out.collect()
        assert len(got) == 20 and all(r.found and r.same for r in got)


# --- numbering ---------------------------------------------------------------


@pytest.mark.parametrize("levels,fanout", [(1, 65_536), (1, 2), (3, 2), (0, 2)])
def test_prefixes_of_blocks_of_blocks(spark, monkeypatch, levels, fanout):
    monkeypatch.setattr(ordering, "LEVELS", levels)
    monkeypatch.setattr(ordering, "FANOUT", fanout)
    rng = random.Random(levels)
    rows = [(k, o, rng.randint(-5, 9) if rng.random() < 0.9 else None) for k in ("a", None) for o in rng.sample(range(-300, 700), 120)] + [("one", 3, 4)]
    df = spark.createDataFrame(rows, "k STRING, o BIGINT, v BIGINT").withColumn("w", F.lit(2).cast("bigint"))
    got = ordering.running_totals(df.fillna(0, ["v"]), ["k"], "o", {"v": "total", "w": "twice"}, 7).collect()
    most = {(r.k, r.o): r.most for r in ordering.running_max(df, ["k"], "o", "v", "most", 7).collect()}
    numbered = {(r.k, r.o): r.i for r in ordering.number_rows(df, ["k"], "o", "i", 7).collect()}
    for k in ("a", None, "one"):
        total, top = 0, None
        have = {r.o: r for r in got if r.k == k}
        for i, (_, o, v) in enumerate(sorted((r for r in rows if r[0] == k), key=lambda r: r[1])):
            total += v or 0
            top = v if top is None else max(top, v if v is not None else top)
            assert (have[o].total, have[o].twice, most[k, o], numbered[k, o]) == (total, 2 * i + 2, top, i)
    assert len(got) == len(rows)


def test_totals_of_one_key_meet_in_blocks(spark):
    out = ordering.running_total(spark.range(100), [], "id", "id", "t", 10)
    plan = plan_of(out)
    assert "_block__" in plan or "_block_" in plan
    assert out.agg(F.max("t")).first()[0] == 4950


# --- segments ----------------------------------------------------------------


def test_counts_between_are_lazy_and_keep_equal_spans(spark):
    rows = spark.range(1_000).select(F.lit("k").alias("k"), "id", (F.col("id") % 5 == 0).cast("bigint").alias("five"))
    marker = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            marker.add(b.num_rows)
            yield b

    spans = spark.createDataFrame([("k", 0, 100, "a"), ("k", 0, 100, "a"), ("k", 50, 70, "b"), ("k", 990, 2_000, "c"), ("l", 0, 9, "d")], "k STRING, seg_from BIGINT, seg_to BIGINT, name STRING")
    out = count_between(rows.mapInArrow(seen, rows.schema), F.col("id"), spans, ["k"], {"n": F.lit(1).cast("bigint"), "fives": F.col("five")})
    assert marker.value == 0  # nothing has read the rows yet
    got = Counter((r.k, r.name, r.n, r.fives) for r in out.collect())
    assert got == {("k", "a", 100, 20): 2, ("k", "b", 20, 4): 1, ("k", "c", 10, 2): 1, ("l", "d", 0, 0): 1}


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
@pytest.mark.parametrize("keys", [["k"], []])
def test_segments_without_an_end(spark, how, keys):
    rows = spark.createDataFrame([("a", x, x) for x in range(-5, 40, 3)], "k STRING, at BIGINT, i BIGINT")
    segs = spark.createDataFrame([("a", 0, 10, "p"), ("a", 20, None, "q")], "k STRING, seg_from BIGINT, seg_to BIGINT, name STRING")
    name = lambda x: "p" if 0 <= x < 10 else "q" if x >= 20 else None
    out = locate(rows, F.col("at"), segs if keys else segs.drop("k"), keys, 4, how, open_ended=True)
    got = {r.i: r.name if how in ("left", "inner") else True for r in out.collect()}
    want = {x: name(x) for x in range(-5, 40, 3)}
    if how == "left":
        assert got == want
    elif how == "inner":
        assert got == {x: n for x, n in want.items() if n}
    else:
        assert set(got) == {x for x, n in want.items() if (n is not None) == (how == "left_semi")}


def test_pieces_of_intervals(spark, monkeypatch):
    from eventlab.plans import segments

    monkeypatch.setattr(segments, "FAN", 4)
    rows = [(i, a, b) for i, (a, b) in enumerate((a, b) for a in range(0, 70, 3) for b in range(a + 1, 71, 5))]
    got = segments._pieces(spark.createDataFrame(rows, "i INT, _a BIGINT, _b BIGINT"), ["i"]).collect()
    for i, a, b in rows:
        covered = [x for r in got if r.i == i for x in range(r._piece * 4 ** r._level, (r._piece + 1) * 4 ** r._level)]
        assert sorted(covered) == list(range(a, b))
        assert sum(r.i == i and r._level < 2 for r in got) <= 2 * 3 * 2


def test_nested_intervals_make_few_rows(spark):
    from eventlab.plans import segments

    n = 10_000
    nested = spark.range(n).select(F.lit("k").alias("k"), F.col("id").alias("_a"), (F.lit(2 * n - 1) - F.col("id")).alias("_b"), "id")
    assert segments._pieces(nested, ["k", "id"]).count() <= 260 * n
    few = spark.range(300).select(F.lit("k").alias("k"), (F.col("id") * 10).alias("seg_from"), (F.lit(10_000) - F.col("id") * 10).alias("seg_to"), "id")
    got = {r.seg_from: r.labels for r in segments.elementary(few, ["k"], "id").collect()}
    assert len(got) == 599
    for i in (0, 1, 150, 299):
        assert got[i * 10] == list(range(i + 1)) and (i == 0 or got[10_000 - i * 10] == list(range(i)))


def test_rows_of_an_open_segment_are_read_once(spark):
    rows = spark.range(100).select(F.lit("a").alias("k"), "id")
    segs = spark.createDataFrame([("a", 0, 10, "p"), ("a", 20, None, "q")], "k STRING, seg_from BIGINT, seg_to BIGINT, name STRING")
    out = locate(rows, F.col("id"), segs, ["k"], open_ended=True)
    assert plan_of(out).count("Range (0, 100") == 1


# --- skew and cardinality ----------------------------------------------------


@pytest.mark.parametrize("share", [0.01, 0.05, 0.4])
def test_heavy_keys_near_the_bound(spark, share):
    n = 20_000
    bound = int(n * share)
    counts = {"at": bound, "over": bound + 1, "under": bound - 1}
    rest = n - sum(counts.values())
    parts = [spark.range(c).select(F.lit(k).alias("key")) for k, c in counts.items()] if rest > 0 else []
    if rest > 0:
        parts.append(spark.range(rest).select(F.concat(F.lit("rare"), F.col("id").cast("string")).alias("key")))
    else:
        parts = [spark.range(int(n * 0.5)).select(F.lit("at").alias("key")), spark.range(n - int(n * 0.5)).select(F.lit(None).cast("string").alias("key"))]
    df = parts[0]
    for p in parts[1:]:
        df = df.unionByName(p)
    df = df.repartition(7)
    got = [(r.key, r.n) for r in stats.heavy_keys(df, share).collect()]
    real = Counter(r.key for r in df.collect())
    assert got == sorted(((k, c) for k, c in real.items() if k is not None and c >= share * n), key=lambda x: (-x[1], x[0]))
    assert got


def test_heavy_keys_of_nothing_and_bad_shares(spark):
    assert stats.heavy_keys(spark.createDataFrame([], "key STRING"), 0.1).count() == 0
    for bad in (0, 0.0001, 1.5):
        with pytest.raises(ValueError):
            stats.candidates(bad)


def test_sketches_merge_over_any_range(spark):
    df = spark.range(60_000).select(
        (F.col("id") % 6).alias("day"), (F.col("id") % 20_011).alias("many"), (F.col("id") % 9).cast("string").alias("few"), F.lit(None).cast("string").alias("none"))
    table = stats.distinct_sketches(df, ["many", "few", "none"], ["day"])
    assert table.count() == 18
    for days in ([0], [1, 2, 3], list(range(6))):
        got = {r.field: (r.rows, r.estimate) for r in stats.distinct_estimates(table.where(F.col("day").isin(days)), []).collect()}
        real = df.where(F.col("day").isin(days)).agg(F.count_distinct("many"), F.count_distinct("few")).first()
        assert got["few"] == (10_000 * len(days), real[1]) and got["none"][1] == 0
        assert abs(got["many"][1] - real[0]) <= 5 * stats.SKETCH_ERROR * real[0]


def test_only_doubtful_columns_are_counted(spark):
    df = spark.range(3_000).select((F.col("id") % 200).alias("a"), (F.col("id") % 7).alias("b"), (F.col("id") % 1_000).alias("c"))
    table = stats.distinct_sketches(df.withColumn("day", F.lit(1)), ["a", "b", "c"], ["day"])
    got = {r.field: r for r in stats.declared_check(df, table, {"a": 201, "b": 6, "c": 50_000}).collect()}
    assert (got["a"].exact, got["a"].within) == (200, True)
    assert (got["b"].exact, got["b"].within, got["c"].exact, got["c"].within) == (None, False, None, True)


def test_columns_are_sketched_in_one_scan(spark):
    df = spark.range(10).select("id", (F.col("id") % 3).alias("a"), (F.col("id") % 5).alias("b"))
    assert plan_of(stats.distinct_sketches(df, ["a", "b"], ["id"])).count("Range (0, 10") == 1


FLOW = flows.Flow("f", (flows.Step("a", "x"), flows.Step("b", "y", delay_ms=10), flows.Step("c", "z", delay_ms=10)))


def test_latency_quantiles_of_merged_sketches(spark):
    n = 20_000
    gap = F.pmod(F.xxhash64("id"), F.lit(100_000))
    ids = spark.range(n).select(F.col("id").cast("string").alias("correlation_id"), F.col("id").alias("i"), gap.alias("gap"))
    at = F.timestamp_micros(F.col("i") * 3_600_000 + F.col("step") * F.col("gap"))
    msgs = ids.withColumn("step", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).withColumn("ts", at)
    table = flows.latency_sketches(msgs, FLOW, 3600)
    assert table.count() > 30
    got = flows.latency_quantiles(table, ["step"], {"p10": 0.1, "p50": 0.5, "p99": 0.99}).collect()
    gaps = sorted(r.gap for r in ids.collect())
    assert {r.step for r in got} == {1, 2}
    for r in got:
        assert r.n == n
        for q, v in ((0.1, r.p10), (0.5, r.p50), (0.99, r.p99)):
            rank = sum(g <= v for g in gaps) / n
            assert abs(rank - q) <= flows.RANK_ERROR, (q, rank)


# --- buckets -----------------------------------------------------------------


def test_bucketed_tables_join_without_a_shuffle(spark):
    msgs = spark.range(500).select(F.lit("t").alias("topic"), (F.col("id") % 3).cast("int").alias("partition"), F.col("id").alias("offset"), F.lit("v").alias("value"))
    kept = []
    for name, rows in (("a", msgs), ("b", msgs.where("offset % 5 = 0").select("topic", "partition", "offset", F.lit("lost").alias("status")))):
        path = scratch_path(spark, f"bucket-{name}")
        kept.append(write_bucketed(rows, path.rsplit("/", 1)[1].replace("-", "_"), path, 4))
    out = join_buckets(*kept)
    plan = plan_of(out)
    assert "Exchange" not in plan and "SortMergeJoin" in plan and plan.count("Bucketed: true") == 2
    assert out.count() == 100
    assert join_buckets(*kept, how="left_anti").count() == 400


# --- streams -----------------------------------------------------------------


def test_observed_rows_tell_dropped_ones(spark):
    path, out, checkpoint = (scratch_path(spark, n) for n in ("in", "out", "cp"))
    totals = mon.ProgressTotals()
    spark.streams.addListener(totals)
    seen = 0
    for batch in ([0, 10, 4_000], [5, 20, 30, 3_990, 5_000]):
        rows = [("t", "v", datetime(2024, 1, 1) + timedelta(seconds=s)) for s in batch]
        spark.createDataFrame(rows, "topic STRING, value STRING, ts TIMESTAMP").coalesce(1).write.mode("append").parquet(path)
        msgs = read_messages(spark, path, streaming=True, schema=spark.read.parquet(path).schema)
        query = mon.stream_throughput(mon.observed(msgs), "1 minute", "5 minutes").writeStream.format("parquet").option("path", out).option(
            "checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        seen += mon.late_report(query, totals)["observed_rows"]
    spark.streams.removeListener(totals)
    windows = spark.read.parquet(out).unionByName(mon.open_throughput(spark, checkpoint))
    row = mon.dropped_rows(windows, {"observed_rows": seen}).first()
    # Three rows of one window, which Spark counts as one.
    assert (row.arrived, row.counted, row.late_rows) == (8, 5, 3)


ITEMS = [{"name": "n", "type": "int"}, {"name": "items", "type": "array", "min_items": 0, "max_items": 3, "items": {
    "type": "object", "fields": [{"name": "who", "type": "faker", "provider": "name"}, {"name": "tags", "type": "array", "max_items": 2, "items": {"type": "faker", "provider": "tag"}}]}}]


@pytest.fixture(scope="module")
def lookups(spark):
    many = spark.range(3_000)
    return sy.lookup_values(many, F.concat(F.lit("name"), "id"), "id", "name").unionByName(sy.lookup_values(many.limit(1_500), F.concat(F.lit("tag"), "id"), "id", "tag"))


def test_lookups_in_arrays_on_streams_draw_the_same(spark, lookups):
    fields = fields_of(ITEMS)
    path = scratch_path(spark, "rows")
    sy.rows(spark, 200).withColumn("ts", F.timestamp_seconds("row_index")).write.parquet(path)
    batch = sy.synth_table(spark.read.parquet(path), fields, 3, lookups=lookups)
    stream = sy.synth_table(read_messages(spark, path, streaming=True, schema=spark.read.parquet(path).schema), fields, 3, lookups=lookups)
    got, want = drain(stream, "lookups"), batch
    assert got.count() == 200 and want.select(got.columns).exceptAll(got).count() == 0
    used = got.select(F.explode("items.who").alias("w")).distinct().count()
    assert used > 150


def test_too_many_items_on_a_stream(spark, lookups):
    wide = [{"name": "items", "type": "array", "max_items": 200, "items": {"type": "faker", "provider": "name"}}]
    rows = spark.readStream.format("rate").load().select(F.col("value").alias("row_index"), F.col("timestamp").alias("ts"))
    with pytest.raises(ValueError, match="items of a row"):
        sy.synth_table(rows, fields_of(wide), 3, lookups=lookups)
    plain = [{"name": "items", "type": "array", "max_items": 200, "items": {"type": "int"}}]
    assert sy.synth_table(rows, fields_of(plain), 3).isStreaming


def test_laws_with_too_many_keys(spark):
    with pytest.raises(ValueError, match="too many"):
        sy.zipf_weights(spark, 10**12, 1.5)
    assert sy.zipf_weights(spark, 10**5, 1.5).agg(F.min(F.col("hi") - F.col("lo"))).first()[0] >= 1_000
