"""Counters, lag, skew and throughput.

Rows are folded to (topic, group) or finer counts first, with map-side partial
aggregation, so a hot topic or key costs no more than any other. Windows and
joins only ever see those small counts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fields import epoch_micros
from ..plans.ordering import explode_count
from ..plans.sizing import settle
from .routing import value_size

# Lag above this is red.
RED_LAG = 100

COUNTERS = ("consumed", "bytes", "failures", "dlq", "retries", "commit_failures")


def _count_if(cond: Column) -> Column:
    return F.count_if(cond)


def producer_stats(msgs: DataFrame) -> DataFrame:
    """Messages, bytes, duplicates and errors per topic.

    Optional columns: ``copy_no`` (1 marks a copy) and ``error`` (true where
    delivery failed; such rows count as errors only).
    """
    delivered = ~F.coalesce(F.col("error"), F.lit(False)) if "error" in msgs.columns else F.lit(True)
    copy = F.col("copy_no") > 0 if "copy_no" in msgs.columns else F.lit(False)
    return msgs.groupBy("topic").agg(
        _count_if(delivered).alias("messages"),
        F.coalesce(F.sum(F.when(delivered, value_size(F.col("value")))), F.lit(0)).alias("bytes"),
        _count_if(copy).alias("duplicates"),
        _count_if(~delivered).alias("errors"),
    )


def group_stats(processed: DataFrame) -> DataFrame:
    """Counters per topic and consumer group."""
    ok = F.col("status") == "ok"
    return processed.groupBy("topic", "group_id").agg(
        F.count(F.lit(1)).alias("delivered"),
        _count_if(ok).alias("consumed"),
        F.coalesce(F.sum(F.when(ok, value_size(F.col("value")))), F.lit(0)).alias("bytes"),
        F.sum(F.col("failures").cast("bigint")).alias("failures"),
        _count_if(F.col("status") == "dlq").alias("dlq"),
        F.sum(F.col("retries").cast("bigint")).alias("retries"),
        _count_if(F.col("commit_failed")).alias("commit_failures"),
    )


def consumer_stats(processed: DataFrame) -> DataFrame:
    """Counters per group with subtotals per topic and a grand total.

    ``level`` is group, topic or total. The rollup runs over the per-group
    counts, not over the messages, which it would multiply by three.
    """
    level = F.grouping_id()
    return (
        group_stats(processed)
        .rollup("topic", "group_id")
        .agg(level.alias("_level"), *[F.sum(c).alias(c) for c in COUNTERS])
        .withColumn(
            "level",
            F.when(F.col("_level") == 0, "group").when(F.col("_level") == 1, "topic").otherwise("total"),
        )
        .drop("_level")
    )


def lag_severity(lag: Column, kind: str = "topic") -> Column:
    """Colour of a lag; flow topics also have a middle step."""
    if kind not in ("topic", "flow"):
        raise ValueError("kind must be 'topic' or 'flow'")
    red = F.when(lag > RED_LAG, F.lit("red"))
    if kind == "flow":
        red = red.when(lag > 0, F.lit("yellow"))
    return red.otherwise(F.lit("green"))


def lag_report(produced: DataFrame, processed: DataFrame) -> DataFrame:
    """One row per topic and group: produced, consumed, group lag, topic lag.

    ``lag_total`` subtracts what all groups of the topic consumed together, so it
    goes negative with several groups; ``lag`` is the group's own.
    """
    sent = produced.groupBy("topic").agg(F.count(F.lit(1)).alias("produced"))
    groups = group_stats(processed)
    per_topic = Window.partitionBy("topic")
    joined = sent.join(groups, "topic", "left").withColumn(
        "consumed", F.coalesce("consumed", F.lit(0))
    )
    lagged = joined.withColumn("lag", F.col("produced") - F.col("consumed")).withColumn(
        "lag_total", F.col("produced") - F.sum("consumed").over(per_topic)
    )
    return lagged.select(
        "topic", "group_id", "produced", "consumed",
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("failures", "retries", "dlq", "commit_failures")],
        "lag", "lag_total", lag_severity(F.col("lag_total")).alias("severity"),
    )


def flow_report(flow_msgs: DataFrame, processed: DataFrame) -> DataFrame:
    """Per flow and topic: produced, consumed by the flow's own groups, lag.

    A flow's groups are those named ``{flow}-{topic}-...``; without one, consumed
    is null and the whole production is lag.
    """
    made = flow_msgs.groupBy("flow", "topic").agg(F.count(F.lit(1)).alias("produced"))
    took = group_stats(processed).select("topic", "group_id", "consumed")
    m, t = made.alias("m"), took.alias("t")
    prefix = F.concat(F.col("m.flow"), F.lit("-"), F.col("m.topic"), F.lit("-"))
    own = (F.col("m.topic") == F.col("t.topic")) & F.startswith(F.col("t.group_id"), prefix)
    joined = m.join(t, own, "left").groupBy("flow", "m.topic", "produced").agg(
        F.sum("consumed").alias("consumed")
    )
    lag = F.col("produced") - F.coalesce("consumed", F.lit(0))
    return joined.select(
        "flow", "topic", "produced", "consumed", lag.alias("lag"),
        F.col("consumed").isNull().alias("no_consumer"),
        lag_severity(lag, "flow").alias("severity"),
    )


def totals(produced: DataFrame, flow_msgs: DataFrame, processed: DataFrame) -> DataFrame:
    """Grand total: flow messages count as produced but not as lag."""
    made = produced.agg(F.count(F.lit(1)))
    flow = flow_msgs.agg(F.count(F.lit(1)))
    took = group_stats(processed).agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("consumed", "failures", "dlq")]
    )
    lag = made.scalar() - F.col("consumed")
    return took.select(
        (made.scalar() + flow.scalar()).alias("produced"), "consumed", lag.alias("lag"),
        "failures", "dlq", lag_severity(lag).alias("severity"),
    )


def run_summary(
    produced: DataFrame, flow_msgs: DataFrame, processed: DataFrame, last_step: int
) -> DataFrame:
    """One row: produced, consumed, completed flows, flow messages, duration."""
    flow = flow_msgs.agg(
        F.count(F.lit(1)).alias("n"), _count_if(F.col("step") == last_step).alias("done")
    )
    took = processed.agg(_count_if(F.col("status") == "ok"))
    at = epoch_micros(F.col("ts"))
    return produced.agg(
        F.count(F.lit(1)).alias("messages_produced"),
        (F.max(at) - F.min(at)).alias("duration_micros"),
    ).select(
        "messages_produced", took.scalar().alias("messages_consumed"),
        flow.select("done").scalar().alias("flows_completed"),
        flow.select("n").scalar().alias("flow_messages"),
        "duration_micros",
    )


# --- skew --------------------------------------------------------------------


def key_skew(msgs: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` most used keys with share and rank, and the head/tail ratio.

    The top-k is taken before ranking, so no window sees all keys. Ties go to
    the smaller key.
    """
    counts = msgs.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    facts = counts.agg(F.sum("n").alias("total"), F.max("n").alias("most"), F.min("n").alias("least"))
    top = counts.orderBy(F.desc("n"), "key").limit(k)
    rank = F.row_number().over(Window.orderBy(F.desc("n"), "key"))
    ratio = facts.select(F.col("most") / F.col("least").cast("double"))
    return top.select(
        rank.alias("rank"), "key", "n",
        F.round(F.col("n") / facts.select("total").scalar(), 6).alias("share"),
        F.round(ratio.scalar(), 6).alias("head_tail"),
    )


def heavy_keys(msgs: DataFrame, share: float, key: str = "key") -> DataFrame:
    """(key, n, share) of every key with at least ``share`` of the rows, with exact counts; the most used first.

    Two passes in bounded memory, however many keys there are. A sketch of
    frequent items, folded in each task, names the candidates: it tracks so many that its error stays below a
    quarter of the bound, so no key at the bound is missed. Their rows alone are then
    counted: at most ``candidates(share)`` keys, which are broadcast. Null keys count as rows only.
    """
    tracked = candidates(share)
    named = msgs.agg(F.expr(f"approx_top_k(`{key}`, {tracked}, {tracked})").alias("top")).select(F.inline("top")).select(F.col("item").alias(key))
    counts = msgs.select(key).join(F.broadcast(named.where(F.col(key).isNotNull()).distinct()), key, "left_semi").groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    total = msgs.agg(F.count(F.lit(1)))
    with_total = counts.withColumn("_of", total.scalar())
    return with_total.where(F.col("n") >= F.lit(share) * F.col("_of")).select(
        key, "n", F.round(F.col("n") / F.col("_of"), 6).alias("share")).orderBy(F.desc("n"), key)


def candidates(share: float) -> int:
    """Items a sketch tracks to find all keys of a share: a power of two, 16 for each key that can have it."""
    if not 0.0003 <= share <= 1:
        raise ValueError("share must lie between 0.0003 and 1")
    return max(64, 1 << (int(16 / share) - 1).bit_length())


def partition_skew(msgs: DataFrame) -> DataFrame:
    """Rows and share per partition, against the mean of the topic's partitions."""
    counts = msgs.groupBy("topic", "partition").agg(F.count(F.lit(1)).alias("n"))
    topic = Window.partitionBy("topic")
    return counts.select(
        "topic", "partition", "n",
        F.round(F.col("n") / F.sum("n").over(topic), 6).alias("share"),
        F.round(F.max("n").over(topic) / F.avg("n").over(topic), 6).alias("max_mean"),
    )


def assignment_load(msgs: DataFrame, consumers: int) -> DataFrame:
    """Partitions of each topic dealt to ``consumers``; load and share per consumer."""
    counts = msgs.groupBy("topic", "partition").agg(F.count(F.lit(1)).alias("n"))
    dealt = counts.withColumn(
        "consumer", F.ntile(consumers).over(Window.partitionBy("topic").orderBy("partition"))
    )
    loads = dealt.groupBy("topic", "consumer").agg(
        F.count(F.lit(1)).alias("partitions"), F.sum("n").alias("messages")
    )
    return loads.withColumn(
        "share", F.round(F.col("messages") / F.sum("messages").over(Window.partitionBy("topic")), 6)
    )


# --- duplicates --------------------------------------------------------------

# A rate above this is warned about.
HIGH_RATE = 0.5


def duplicate_report(msgs: DataFrame) -> DataFrame:
    """Rows, distinct (key, value) pairs, copies and duplicate rate per topic."""
    pairs = msgs.groupBy("topic", "key", "value").agg(F.count(F.lit(1)).alias("n"))
    per_topic = pairs.groupBy("topic").agg(
        F.sum("n").alias("messages"), F.count(F.lit(1)).alias("distinct_messages"),
        F.max("n").alias("most_copies"),
    )
    copies = F.col("messages") - F.col("distinct_messages")
    rate = copies / F.col("messages")
    return per_topic.withColumn("copies", copies).withColumn(
        "duplicate_rate", F.round(rate, 6)
    ).withColumn("high", rate > HIGH_RATE)


def dedup(msgs: DataFrame, order: str = "row_index") -> DataFrame:
    """Keep the first of equal (topic, key, value) rows, by ``order``.

    An aggregate, not a ranking window: copies fold on the map side (by sorting, as whole
    rows have no fixed width), so a group holding a large share of all rows never meets in
    one task. Of copies with one ``order`` the least row stays.
    """
    keys = ["topic", "key", "value"]
    rest = [c for c in msgs.columns if c not in keys and c != order]
    first = F.min(F.struct(order, *rest)).alias("_first")
    out = msgs.groupBy(*keys).agg(first)
    return out.select(*[c if c in keys else F.col(f"_first.{c}").alias(c) for c in msgs.columns])


# --- over time ---------------------------------------------------------------


def throughput(msgs: DataFrame, width_seconds: int) -> DataFrame:
    """Messages/s and bytes/s per topic and interval; empty intervals count zero."""
    width = width_seconds * 1_000_000
    slot = F.floor(epoch_micros(F.col("ts")) / F.lit(width)).cast("bigint")
    counts = msgs.groupBy("topic", slot.alias("slot")).agg(
        F.count(F.lit(1)).alias("messages"), F.sum(value_size(F.col("value"))).alias("bytes")
    )
    # Each interval fills the empty ones up to the next, so the rows are read once.
    ahead = F.lead("slot").over(Window.partitionBy("topic").orderBy("slot"))
    reach = F.coalesce(ahead - F.col("slot"), F.lit(1))
    filled = explode_count(counts.withColumn("_reach", reach), F.col("_reach"), "_i")
    seconds = F.lit(float(width_seconds))

    def here(count: str) -> Column:
        return F.when(F.col("_i") == 0, F.col(count)).otherwise(F.lit(0))

    return filled.select(
        "topic", ((F.col("slot") + F.col("_i")) * width_seconds).alias("start_second"),
        here("messages").alias("messages"),
        F.round(here("messages") / seconds, 6).alias("messages_per_second"),
        F.round(here("bytes") / seconds, 6).alias("bytes_per_second"),
    )


def lag_timeline(
    produced: DataFrame, processed: DataFrame, width_seconds: int, delay_micros: Column | None = None
) -> DataFrame:
    """Lag of each group at the end of every interval in which it changed.

    Production adds one at its time, consumption takes one away at its time
    (``ts`` plus ``delay_micros``). Changes are summed per interval before the
    running sum, whose input has one row per group and interval.
    """
    width = width_seconds * 1_000_000

    def slot(micros: Column) -> Column:
        return F.floor(micros / F.lit(width)).cast("bigint").alias("slot")

    at = epoch_micros(F.col("ts"))
    done = at if delay_micros is None else at + delay_micros
    took = processed.where(F.col("status") == "ok").groupBy("topic", "group_id", slot(done)).agg(
        (-F.count(F.lit(1))).alias("change")
    )
    groups = processed.select("topic", "group_id").distinct()
    made = produced.groupBy("topic", slot(at)).agg(F.count(F.lit(1)).alias("change"))
    given = groups.join(made, "topic").select("topic", "group_id", "slot", "change")
    changes = given.unionByName(took).groupBy("topic", "group_id", "slot").agg(
        F.sum("change").alias("change")
    )
    so_far = Window.partitionBy("topic", "group_id").orderBy("slot").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    return changes.select(
        "topic", "group_id", (F.col("slot") * width_seconds).alias("start_second"),
        "change", F.sum("change").over(so_far).alias("lag"),
    )


# --- reports -----------------------------------------------------------------


def failure_report(processed: DataFrame) -> DataFrame:
    """Share of failed messages, failed attempts and failed commits per group."""
    groups = processed.groupBy("topic", "group_id").agg(
        F.count(F.lit(1)).alias("messages"),
        F.avg((F.col("failures") > 0).cast("double")).alias("failed_share"),
        F.avg((F.col("status") != "ok").cast("double")).alias("lost_share"),
        F.avg(F.col("commit_failed").cast("double")).alias("commit_failed_share"),
    )
    warning = (
        F.when(F.col("failed_share") > HIGH_RATE, F.lit("high failure rate"))
        .when(F.col("commit_failed_share") > HIGH_RATE, F.lit("high commit failure rate"))
    )
    return groups.select(
        "topic", "group_id", "messages",
        *[F.round(c, 6).alias(c) for c in ("failed_share", "lost_share", "commit_failed_share")],
        warning.alias("warning"),
    )


def worst_lag(report: DataFrame, k: int = 3) -> DataFrame:
    """The ``k`` topics with the largest total lag."""
    topics = report.groupBy("topic").agg(
        F.max("produced").alias("produced"), F.max("lag_total").alias("lag_total")
    )
    return topics.orderBy(F.desc("lag_total"), "topic").limit(k)


# Precision of distinct sketches: 2^12 registers, a relative error of about 1.6 in 100.
SKETCH_BITS = 12
SKETCH_ERROR = 1.04 / 2 ** (SKETCH_BITS / 2)


def distinct_sketches(df: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """(``by``, field, rows, sketch): a mergeable sketch of the distinct values of each column in each group, in one pass.

    Some kilobytes a row whatever the group holds, so the table can be kept
    by day and merged over any range later. Nulls are no values.
    """
    sketched = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_rows"), *[F.hll_sketch_agg(F.col(c).cast("string"), F.lit(SKETCH_BITS)).alias(f"_s{i}") for i, c in enumerate(columns)])
    return sketched.select(*by, "_rows", F.inline(F.array(*[
        F.struct(F.lit(c).alias("field"), F.col(f"_s{i}").alias("sketch")) for i, c in enumerate(columns)
    ]))).select(*by, "field", F.col("_rows").alias("rows"), "sketch")


def distinct_estimates(sketches: DataFrame, by: list[str]) -> DataFrame:
    """(``by``, field, rows, estimate) of stored sketches, merged over whatever ``by`` leaves out."""
    return sketches.groupBy(*by, "field").agg(
        F.sum("rows").alias("rows"), F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("estimate"))


def declared_check(df: DataFrame, sketches: DataFrame, declared: dict[str, int], deviations: float = 5.0) -> DataFrame:
    """(field, declared, estimate, exact, within): whether columns keep to their declared count, by stored sketches.

    ``exact`` is counted, in one more pass over that column, only where the
    estimate is so near the bound that it cannot tell (``deviations`` of its error); it is null elsewhere.
    """
    found = distinct_estimates(sketches.where(F.col("field").isin(list(declared))), [])
    bound = F.element_at(F.create_map(*[x for c, n in declared.items() for x in (F.lit(c), F.lit(n).cast("bigint"))]), F.col("field"))
    judged = settle(found.withColumn("declared", bound), "estimates")
    unsure = F.abs(F.col("estimate") - F.col("declared")) <= deviations * SKETCH_ERROR * F.col("declared")
    fields = sorted(r.field for r in judged.where(unsure).select("field").collect())  # at most as many as were declared
    if fields:
        counts = reduce(DataFrame.unionByName, [
            df.select(F.col(c)).distinct().agg(F.lit(c).alias("field"), F.count(c).alias("exact")) for c in fields])
        judged = judged.join(F.broadcast(counts), "field", "left")
    else:
        judged = judged.withColumn("exact", F.lit(None).cast("bigint"))
    return judged.select("field", "declared", "estimate", "exact", (F.coalesce("exact", "estimate") <= F.col("declared")).alias("within"))


def cardinality_report(df: DataFrame, declared: dict[str, int], rsd: float = 0.02) -> DataFrame:
    """Exact and approximate distinct values per column against the declared count.

    Approximate counts take one pass for all columns; exact ones an aggregate
    of each column alone, so no row is multiplied.
    """
    names = list(declared)
    sketch = df.agg(*[F.approx_count_distinct(c, rsd).alias(c) for c in names])
    approx = sketch.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("field"), F.lit(declared[c]).cast("bigint").alias("declared"), F.col(c).alias("approx")) for c in names
    ])))
    exact = reduce(DataFrame.unionByName, [
        df.select(F.col(c)).distinct().agg(F.lit(c).alias("field"), F.count(c).alias("exact")) for c in names
    ])
    return approx.join(exact, "field").select(
        "field", "declared", "exact", "approx", (F.col("exact") <= F.col("declared")).alias("within"))
