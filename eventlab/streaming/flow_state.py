"""Completion of flow instances on a stream, with a timeout."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.fields import epoch_micros
from ..operators.flows import Flow
from .monitors import event_time
from .tails import state_of

OUTPUT = "correlation_id STRING, status STRING, seen BIGINT, missing STRING"

# State of a bucket of flows: of each its id, the steps seen, as the bits of a hexadecimal number, and the time it gives up (milliseconds).
STATE = "ids ARRAY<STRING>, bits ARRAY<STRING>, deadlines ARRAY<BIGINT>"
BUCKETS = 4096

# Stands for the time of a message that has none; a flow of such messages alone gives up at the next watermark.
NO_TIME = 1 << 62

# Steps of one BIGINT in the folded session state; a flow takes as many as it needs.
WORD = 62


def stream_flow_status(msgs: DataFrame, flow: Flow, timeout: str, late: str) -> DataFrame:
    """One row per flow instance, once nothing arrived for ``timeout``.

    ``status`` is complete where every step was seen, else expired. Built-in
    session windows keep one small row of state per instance; ``configure`` makes
    them merge per task before the shuffle, so an id shared by many messages stays cheap. A complete
    flow, too, is reported only when its session closes; where that is too late
    use ``prompt_flow_status``.
    """
    bit = F.expr(f"shiftleft(1L, CAST(step % {WORD} AS INT))")
    return _flow_rows(event_time(msgs, late).groupBy("correlation_id", F.session_window("ts", timeout)).agg(*[
        F.bit_or(F.when(F.floor(F.col("step") / WORD) == w, bit).otherwise(F.lit(0).cast("bigint"))).alias(f"_w{w}") for w in range(_words(flow))
    ]), flow)


def _words(flow: Flow) -> int:
    return -(-len(flow.steps) // WORD)


def _flow_rows(sessions: DataFrame, flow: Flow) -> DataFrame:
    numbers = F.array(*[F.lit(s) for s in range(len(flow.steps))])
    held = F.array(*[F.col(f"_w{w}") for w in range(_words(flow))])
    missing = F.filter(numbers, lambda s: F.getbit(F.get(held, F.floor(s / WORD).cast("int")), s % WORD) == 0)
    return sessions.select(
        "correlation_id",
        F.when(F.size(missing) == 0, "complete").otherwise("expired").alias("status"),
        sum((F.bit_count(f"_w{w}") for w in range(_words(flow))), F.lit(0)).cast("bigint").alias("seen"),
        F.array_join(missing.cast("array<string>"), ",").alias("missing"),
    )


def open_flow_status(spark: SparkSession, checkpoint: str, flow: Flow) -> DataFrame:
    """Rows of ``stream_flow_status`` for instances that may still get messages, as if they got none."""
    words = ", ".join(f"_w{w}: bigint" for w in range(_words(flow)))
    rows = state_of(spark, checkpoint, f"_id: string, session_window: struct<start: timestamp, end: timestamp>, {words}")
    return _flow_rows(rows, flow)


def prompt_flow_status(msgs: DataFrame, flow: Flow, timeout_seconds: int, late: str, buckets: int = BUCKETS) -> DataFrame:
    """One row per flow instance: complete in the batch that completes it, else expired.

    An instance expires ``timeout_seconds`` after its first message. Instances are tracked in ``buckets`` of the
    hashes of their ids: a bucket takes one call of Python, one row of state and one timer a batch, where an
    instance of its own would take each for itself. A batch rewrites the buckets it has messages for, so ask for more
    of them where many more than a thousand times as many instances are open at a time; a checkpoint keeps its number.
    """
    at = F.floor(epoch_micros(F.col("ts")) / F.lit(1000))
    slim = event_time(msgs, late).select(
        F.pmod(F.xxhash64("correlation_id"), F.lit(buckets)).alias("_bucket"), "correlation_id", "ts", "step",
        # A missing time would make the whole column floating.
        F.coalesce(at, F.lit(NO_TIME)).alias("at"),
    )
    return slim.groupBy("_bucket").applyInPandasWithState(
        FlowTracker(len(flow.steps), timeout_seconds * 1000).track, OUTPUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def open_prompt_flow_status(spark: SparkSession, checkpoint: str, flow: Flow) -> DataFrame:
    """Rows of ``prompt_flow_status`` for instances that have neither completed nor run out of time, as expired ones."""
    held = state_of(spark, checkpoint, "state: struct<ids: array<string>, bits: array<string>, deadlines: array<bigint>>, timeout: bigint")
    state = held.select(F.explode(F.arrays_zip("state.ids", "state.bits")).alias("_flow")).select(F.col("_flow.ids").alias("correlation_id"), "_flow.bits")
    # Four steps a digit, the lowest at the end.
    steps = F.array(*[F.lit(s) for s in range(len(flow.steps))])
    digit = lambda s: F.conv(F.substring(F.reverse("bits"), F.floor(s / 4).cast("int") + 1, F.lit(1)), 16, 10).cast("int")
    missing = F.filter(steps, lambda s: F.coalesce(F.getbit(digit(s), s % 4), F.lit(0)) == 0)
    rows = state.withColumn("_missing", missing)
    return rows.where(F.size("_missing") > 0).select(
        "correlation_id", F.lit("expired").alias("status"), (len(flow.steps) - F.size("_missing")).cast("bigint").alias("seen"),
        F.array_join(F.col("_missing").cast("array<string>"), ",").alias("missing"))


class FlowTracker:
    """Steps seen of each flow instance of a bucket, until its time is up."""

    def __init__(self, steps: int, timeout_millis: int):
        self.steps, self.timeout, self.all = steps, timeout_millis, (1 << steps) - 1

    def _rows(self, found: list[tuple[str | None, str, int]]) -> pd.DataFrame:
        missing = {bits: ",".join(str(s) for s in range(self.steps) if not bits >> s & 1) for bits in {f[2] for f in found}}
        return pd.DataFrame({
            "correlation_id": [f[0] for f in found], "status": [f[1] for f in found],
            "seen": [f[2].bit_count() for f in found], "missing": [missing[f[2]] for f in found]})

    def track(self, key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ids, hexes, deadlines = state.get if state.exists else ((), (), ())
        flows = {i: (int(b, 16), d) for i, b, d in zip(ids, hexes, deadlines)}
        mark = state.getCurrentWatermarkMs()
        if not state.hasTimedOut:
            yield self._rows(self._add(flows, chunks, mark))
        # Messages come first: one that arrives with the watermark that ends its flow still counts.
        over = [(i, "expired", bits) for i, (bits, deadline) in flows.items() if deadline < mark and bits != self.all]
        flows = {i: held for i, held in flows.items() if held[1] >= mark}
        if flows:
            deadlines = [deadline for _, deadline in flows.values()]
            state.update((list(flows), [f"{bits:x}" for bits, _ in flows.values()], deadlines))
            state.setTimeoutTimestamp(max(min(deadlines), 1))
        else:
            state.remove()
        yield self._rows(over)

    def _add(self, flows: dict, chunks: Iterator[pd.DataFrame], mark: int) -> list[tuple[str | None, str, int]]:
        """Add messages to ``flows``; those that are complete by them."""
        new, touched = {}, {}
        for chunk in chunks:
            for i, step, at in zip(chunk["correlation_id"].tolist(), chunk["step"].tolist(), chunk["at"].tolist()):
                held = flows.get(i)
                if held is None:
                    new[i] = min(at, new.get(i, at))
                    touched[i] = touched.get(i, 0) | 1 << step
                elif not held[0] >> step & 1:
                    touched[i] = touched.get(i, held[0]) | 1 << step
        for i, bits in touched.items():
            # A complete flow stays known until its deadline, so repeats are ignored.
            flows[i] = bits, flows[i][1] if i in flows else max(new[i] + self.timeout if new[i] < NO_TIME else 0, mark + 1)
        return [(i, "complete", bits) for i, bits in touched.items() if bits == self.all]
