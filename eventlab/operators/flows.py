"""Correlated event flows: expansion, completeness, latency, correlation."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fields import Context, epoch_micros, field_col, uuid_col
from ..functions.payloads import json_value
from ..plans.ordering import running_total
from ..plans.spec import Field
from .synth import with_lookups

RESERVED = ("correlation_id", "event_type")


@dataclass(frozen=True)
class Step:
    topic: str
    event_type: str
    delay_ms: int = 0
    fields: tuple[Field, ...] = ()

    def __post_init__(self) -> None:
        if self.delay_ms < 0:
            raise ValueError("delay_ms cannot be negative")
        for f in self.fields:
            if f.name in RESERVED:
                raise ValueError(f"field name '{f.name}' is reserved in flow messages")


@dataclass(frozen=True)
class Flow:
    """Ordered steps sharing a correlation id.

    ``correlation`` is "uuid" or ("field_ref", name of a field of the first step).
    """

    name: str
    steps: tuple[Step, ...]
    rate: float = 10.0
    correlation: str | tuple[str, str] = field(default="uuid")

    def __post_init__(self) -> None:
        if not self.steps:
            raise ValueError("a flow needs steps")
        if self.rate <= 0:
            raise ValueError("rate must be positive")
        kind = self.correlation if isinstance(self.correlation, str) else self.correlation[0]
        if kind not in ("uuid", "field_ref"):
            raise ValueError(f"unknown correlation type '{kind}'")

    @property
    def delays_ms(self) -> list[int]:
        """Delay of each step from the start of the flow; the first step has none."""
        out, total = [], 0
        for i, step in enumerate(self.steps):
            total += step.delay_ms if i > 0 else 0
            out.append(total)
        return out


def correlation_id(flow: Flow, seed: int, idx: Column, context: Context = Context()) -> Column:
    """Id of a flow instance: a uuid, or a field of the first step where it has a value."""
    fallback = uuid_col(seed, f"{flow.name}/correlation", idx)
    if flow.correlation == "uuid":
        return fallback
    for f in flow.steps[0].fields:
        if f.name == flow.correlation[1]:
            return F.coalesce(_step_field(flow, 0, f, seed, idx, context).cast("string"), fallback)
    return fallback


def _step_field(flow: Flow, step: int, f: Field, seed: int, idx: Column, context: Context) -> Column:
    return field_col(f, seed, f"{flow.name}/{step}/{f.name}", idx, context)


def flow_messages(
    instances: DataFrame, flow: Flow, seed: int = 0, idx: str = "row_index", ts: str = "ts",
    lookups: DataFrame | None = None,
) -> DataFrame:
    """One message per instance and step, keyed by the correlation id.

    ``instances`` has the row index and the start time. Only those two columns,
    the id and looked-up values go through the explode; each step's payload is
    built after it, and only for its own step.
    """
    steps = F.array(*[
        F.struct(
            F.lit(i).alias("step"), F.lit(s.topic).alias("topic"),
            F.lit(s.event_type).alias("event_type"), F.lit(delay).cast("bigint").alias("delay_ms"),
        ) for i, (s, delay) in enumerate(zip(flow.steps, flow.delays_ms))
    ])
    i = F.col("row_index")
    base = instances.select(F.col(idx).cast("bigint").alias("row_index"), F.col(ts).alias("_start"))
    found = []
    for n, s in enumerate(flow.steps):
        base, lookup = with_lookups(base, s.fields, lookups, seed, f"{flow.name}/{n}/", "row_index")
        found.append(lookup)
    spread = (
        base.withColumn("correlation_id", correlation_id(flow, seed, i, Context(F.col("_start"), found[0])))
        .withColumn("_s", F.explode(steps))
        .select("*", "_s.*")
        .drop("_s")
    )
    shift = F.expr("make_dt_interval(0, 0, 0, delay_ms / 1000.0)")
    timed = spread.withColumn("ts", F.col("_start") + shift)
    value = None
    for n, s in enumerate(flow.steps):
        # The first step's fields also decide its id, so they see the same time.
        made = json_value(
            F.col("correlation_id"), F.lit(s.event_type).alias("event_type"),
            *[_step_field(flow, n, f, seed, i, Context(F.col("ts"), found[n])).alias(f.name)
              for f in s.fields],
        )
        value = F.when(F.col("step") == n, made) if value is None else value.when(F.col("step") == n, made)
    return timed.select(
        F.lit(flow.name).alias("flow"), "topic", F.col("correlation_id").alias("key"),
        "correlation_id", "step", "event_type", value.alias("value"), "ts", "row_index",
    )


def _first_times(msgs: DataFrame, steps: list[int]) -> DataFrame:
    """Per correlation id the first time of each step, in one aggregate.

    The number of steps is fixed by the flow, so every id folds to one row on
    the map side, however many messages share it.
    """
    at = epoch_micros(F.col("ts"))
    return msgs.groupBy("correlation_id").agg(
        F.count(F.lit(1)).alias("messages"),
        *[F.min(F.when(F.col("step") == s, at)).alias(f"t{s}") for s in steps],
    )


def flow_status(msgs: DataFrame, flow: Flow) -> DataFrame:
    """Per correlation id: steps seen, steps missing, complete or not."""
    steps = list(range(len(flow.steps)))
    times = _first_times(msgs, steps)
    seen = F.array_compact(F.array(*[F.when(F.col(f"t{s}").isNotNull(), F.lit(s)) for s in steps]))
    missing = F.array_except(F.array(*[F.lit(s) for s in steps]), seen)
    return times.select(
        "correlation_id", "messages", seen.alias("seen"), missing.alias("missing"),
        (F.size(missing) == 0).alias("complete"),
    )


def step_latency(msgs: DataFrame, flow: Flow) -> DataFrame:
    """Delay of each step after the one before it, against the configured delay.

    Times are those of the first message of a step. Percentiles are exact: the
    smallest gap that at least that share of the gaps does not exceed, found from
    running counts of distinct gaps rather than by gathering them.
    """
    steps = list(range(len(flow.steps)))
    gaps = F.array(*[
        F.struct(
            F.lit(s).alias("step"), F.lit(flow.steps[s].delay_ms).cast("bigint").alias("configured_ms"),
            (F.col(f"t{s}") - F.col(f"t{s - 1}")).alias("gap"),
        ) for s in steps[1:]
    ])
    rows = _first_times(msgs, steps).select(F.inline(gaps)).where(F.col("gap").isNotNull())
    counts = rows.groupBy("step", "configured_ms", "gap").agg(F.count(F.lit(1)).alias("n"))
    sums = counts.groupBy("step", "configured_ms").agg(
        F.sum("n").alias("n"), F.min("gap").alias("min_micros"), F.max("gap").alias("max_micros"),
        F.round(F.sum(F.col("gap") * F.col("n")) / F.sum("n"), 3).alias("avg_micros"),
    )
    # One row per step, so this side is bounded by the flow.
    ranks = running_total(counts, ["step"], "gap", "n", "upto", block=1_000_000).join(
        F.broadcast(sums.select("step", F.col("n").alias("of"))), "step"
    )
    cuts = ranks.groupBy("step").agg(*[
        F.min(F.when(F.col("upto") >= F.ceil(F.col("of") * F.lit(q)), F.col("gap"))).alias(name)
        for name, q in (("p50_micros", 0.5), ("p95_micros", 0.95))
    ])
    return sums.join(F.broadcast(cuts), "step")


# Size of latency sketches: a rank is off by 0.5 in 100 or less, nearly always.
SKETCH_K = 400
RANK_ERROR = 0.01


def _gaps(msgs: DataFrame, flow: Flow) -> DataFrame:
    """(step, at, gap) of every instance and step that was seen with the one before it."""
    steps = list(range(len(flow.steps)))
    gaps = F.array(*[
        F.struct(F.lit(s).alias("step"), F.col(f"t{s}").alias("at"), (F.col(f"t{s}") - F.col(f"t{s - 1}")).alias("gap")) for s in steps[1:]
    ])
    return _first_times(msgs, steps).select(F.inline(gaps)).where(F.col("gap").isNotNull())


def delay_counts(msgs: DataFrame, flow: Flow) -> DataFrame:
    """(step, gap, rows): how often each delay of a step was seen."""
    return _gaps(msgs, flow).groupBy("step", "gap").agg(F.count(F.lit(1)).alias("rows"))


def latency_sketches(msgs: DataFrame, flow: Flow, slot_seconds: int = 3600) -> DataFrame:
    """(flow, step, slot_second, n, sketch): mergeable sketches of the delay of each step after the one before it.

    ``slot_second`` is where the interval of ``slot_seconds`` begins in which the step was first seen.
    A few kilobytes a row, so the table can be kept and merged over steps and times later.
    """
    rows = _gaps(msgs, flow)
    slot = F.floor(F.col("at") / F.lit(slot_seconds * 1_000_000)).cast("bigint") * slot_seconds
    return rows.groupBy(F.lit(flow.name).alias("flow"), "step", slot.alias("slot_second")).agg(
        F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_bigint("gap", F.lit(SKETCH_K)).alias("sketch"))


def latency_quantiles(sketches: DataFrame, by: list[str], shares: dict[str, float]) -> DataFrame:
    """(``by``, n, one column a share) of stored sketches, merged over whatever ``by`` leaves out."""
    merged = sketches.groupBy(*by).agg(F.sum("n").alias("n"), F.kll_merge_agg_bigint("sketch", F.lit(SKETCH_K)).alias("_sketch"))
    return merged.select(*by, "n", *[F.kll_sketch_get_quantile_bigint("_sketch", F.lit(q)).alias(name) for name, q in shares.items()])


def flow_violations(msgs: DataFrame, flow: Flow) -> DataFrame:
    """Ids whose messages break the flow's rules, one row per rule broken."""
    steps = list(range(len(flow.steps)))
    times = _first_times(msgs, steps)
    checks = [F.when(F.col("t0").isNull(), F.lit("first step missing"))]
    for s in steps[1:]:
        # The latest step seen before this one, whichever it is.
        earlier = F.greatest(F.col("t0"), *[F.col(f"t{p}") for p in steps[1:s]]) if s > 1 else F.col("t0")
        checks.append(F.when(F.col(f"t{s}") < earlier, F.lit(f"step {s} out of order")))
        checks.append(
            F.when(F.col(f"t{s}").isNotNull() & F.col(f"t{s - 1}").isNull(), F.lit(f"step {s - 1} skipped"))
        )
    broken = F.array_distinct(F.array_compact(F.array(*checks)))
    return times.select("correlation_id", F.explode(broken).alias("rule"))


def correlate(
    a: DataFrame, b: DataFrame, within_seconds: float, how: str = "left",
    key: str = "correlation_id",
) -> DataFrame:
    """For each distinct (id, time) of ``a``, the first ``b`` at or after it, in bounds.

    Returns key, a_micros, a_rows, b_micros, gap_micros. Both sides are folded to
    distinct times first, and time is cut into buckets as long as the bound, so
    an id holding a large share of the rows is split by time. Inside a bucket the
    next ``b`` is found by one sorted pass instead of pairing rows; past its end
    it is the first ``b`` of the next bucket.
    """
    if how not in ("left", "inner"):
        raise ValueError("how must be 'left' or 'inner'")
    within = int(within_seconds * 1_000_000)
    if within < 1:
        raise ValueError("within_seconds must be positive")
    at = epoch_micros(F.col("ts")).alias("at")
    bucket = F.floor(F.col("at") / F.lit(within)).cast("bigint").alias("bucket")
    left = a.select(key, at).groupBy(key, "at").agg(F.count(F.lit(1)).alias("a_rows")).select(
        key, bucket, "at", "a_rows", F.lit(None).cast("bigint").alias("b_at")
    )
    times = b.select(key, at).distinct().select(key, bucket, "at")
    right = times.select(
        key, "bucket", "at", F.lit(None).cast("bigint").alias("a_rows"), F.col("at").alias("b_at")
    )
    # Latest first, so that the running minimum is the nearest time ahead.
    ahead = Window.partitionBy(key, "bucket").orderBy(F.desc("at")).rangeBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    inside = left.unionByName(right).withColumn("_here", F.min("b_at").over(ahead)).where(
        F.col("a_rows").isNotNull()
    )
    later = times.groupBy(key, (F.col("bucket") - 1).alias("bucket")).agg(F.min("at").alias("_next"))
    joined = inside.join(later, [key, "bucket"], "left")
    found = F.coalesce("_here", "_next")
    hit = F.when(found - F.col("at") <= within, found)
    out = joined.select(
        key, F.col("at").alias("a_micros"), "a_rows", hit.alias("b_micros"),
        (hit - F.col("at")).alias("gap_micros"),
    )
    return out if how == "left" else out.where(F.col("b_micros").isNotNull())
