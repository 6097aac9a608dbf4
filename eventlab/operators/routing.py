"""What a consumer group does with each message: fail, retry, skip, dead-letter.

All of it is one projection per (message, group): no join, no shuffle, no state.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.draw import digest, draw_from
from ..plans.sizing import BROADCAST_ROWS, join_side, only_keys_of, settle

POLICIES = ("skip", "retry", "dlq")

# The reason and the topic suffix of dead-letter messages.
DLQ_ERROR = "simulated_processing_failure"
DLQ_SUFFIX = "-dlq"


@dataclass(frozen=True)
class FailurePolicy:
    failure_rate: float = 0.0
    commit_failure_rate: float = 0.0
    on_failure: str = "skip"
    max_retries: int = 3

    def __post_init__(self) -> None:
        for name in ("failure_rate", "commit_failure_rate"):
            if not 0.0 <= getattr(self, name) <= 1.0:
                raise ValueError(f"{name} must be between 0 and 1")
        if self.on_failure not in POLICIES:
            raise ValueError(f"on_failure must be one of {POLICIES}")
        if self.max_retries < 0:
            raise ValueError("max_retries cannot be negative")


def with_groups(msgs: DataFrame, groups: int = 1, prefix: Column | None = None) -> DataFrame:
    """One row per message and consumer group, named ``{topic}-group-{n}``."""
    if groups < 1:
        raise ValueError("groups must be at least 1")
    head = F.col("topic") if prefix is None else prefix
    number = F.explode(F.sequence(F.lit(1), F.lit(groups)))
    return msgs.withColumn("_g", number).withColumn(
        "group_id", F.concat(head, F.lit("-group-"), F.col("_g").cast("string"))
    ).drop("_g")


def failed_attempts(draw: Column, rate: float, attempts: int) -> Column:
    """Failures before the first success, at most ``attempts``.

    With independent attempts, at least k of them fail first with probability
    rate^k. One draw compared with those powers has the same distribution as one
    draw per attempt, so the cost does not grow with the number of retries.
    """
    if rate <= 0:
        return F.lit(0).cast("int")
    if rate >= 1:
        return F.lit(attempts).cast("int")
    if attempts == 1:
        return (draw < F.lit(rate)).cast("int")
    # ln(0) is null in SQL: a draw of exactly 0 fails every attempt.
    run = F.floor(F.log(draw) / F.lit(math.log(rate)))
    return F.when(draw > 0, F.least(run, F.lit(attempts).cast("bigint"))).otherwise(F.lit(attempts)).cast("int")


def process(
    msgs: DataFrame, policy: FailurePolicy, seed: int = 0, idx: str = "row_index",
) -> DataFrame:
    """Add status, attempts, failures, retries and commit_failed.

    ``status`` is ok, skip, dlq or exhausted (all retries failed); only ok rows
    count as consumed. ``msgs`` has ``group_id``; each group draws on its own.
    """
    i, group = F.col(idx), F.col("group_id")
    tries = 1 + policy.max_retries if policy.on_failure == "retry" else 1
    lost = {"skip": "skip", "dlq": "dlq", "retry": "exhausted"}[policy.on_failure]
    # One hash holds both draws of a row.
    hashed = msgs.withColumn("_h", digest(seed, F.concat(F.lit("fail/"), group), i))
    out = hashed.withColumn(
        "failures", failed_attempts(draw_from(F.col("_h")), policy.failure_rate, tries)
    )
    ok = F.col("failures") < F.lit(tries)
    out = out.withColumn("status", F.when(ok, F.lit("ok")).otherwise(F.lit(lost)))
    out = out.withColumn("attempts", F.least(F.col("failures") + 1, F.lit(tries)))
    out = out.withColumn("retries", F.col("attempts") - 1)
    commit = draw_from(F.col("_h"), 1)
    return out.withColumn(
        "commit_failed", ok & (commit < F.lit(float(policy.commit_failure_rate)))
    ).drop("_h")


def value_size(value: Column) -> Column:
    return F.coalesce(F.octet_length(value), F.lit(0)).cast("bigint")


# --- dead letters ------------------------------------------------------------


def dlq_value(
    topic: Column, partition: Column, offset: Column, error: Column, timestamp: Column, payload: Column
) -> Column:
    """Envelope text. Bytes that are not UTF-8 are base64, named in payload_encoding."""
    raw = payload.cast("binary")
    readable = F.is_valid_utf8(raw.cast("string"))
    head = [
        topic.alias("original_topic"), partition.alias("original_partition"),
        offset.alias("original_offset"), error.alias("error"), timestamp.alias("timestamp"),
    ]
    keep_nulls = {"ignoreNullFields": "false"}
    text = F.to_json(F.struct(*head, raw.cast("string").alias("payload")), keep_nulls)
    coded = F.to_json(
        F.struct(*head, F.base64(raw).alias("payload"), F.lit("base64").alias("payload_encoding")),
        keep_nulls,
    )
    return F.when(raw.isNull() | readable, text).otherwise(coded)


def dlq_envelope(failed: DataFrame, error: str = DLQ_ERROR, at: Column | None = None) -> DataFrame:
    """Dead-letter messages of failed rows: topic ``{t}-dlq``, no key, JSON value.

    ``at`` is the time written into the envelope (default: the message time).
    """
    stamp = F.col("ts") if at is None else at
    iso = F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")
    return failed.select(
        F.concat("topic", F.lit(DLQ_SUFFIX)).alias("topic"),
        F.lit(None).cast("string").alias("key"),
        dlq_value(
            F.col("topic"), F.col("partition"), F.col("offset"), F.lit(error), iso, F.col("value")
        ).alias("value"),
    )


ENVELOPE = (
    "original_topic STRING, original_partition INT, original_offset BIGINT, error STRING,"
    " timestamp STRING, payload STRING, payload_encoding STRING"
)


def dlq_parse(dlq: DataFrame) -> DataFrame:
    """Envelope columns, with ``payload`` back as bytes."""
    read = dlq.select(F.from_json("value", ENVELOPE).alias("e")).select("e.*")
    raw = F.when(F.col("payload_encoding") == "base64", F.unbase64("payload")).otherwise(
        F.col("payload").cast("binary")
    )
    return read.withColumn("payload", raw)


ADDRESS = ["original_topic", "original_partition", "original_offset"]


def dlq_replay(dlq: DataFrame, source: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Dead letters joined to the messages they came from.

    (topic, partition, offset) is unique in ``source``, so the join cannot skew.
    ``found`` tells whether the source row exists, ``same`` whether its bytes match.
    Letters are few beside the source, so the source is cut down to their addresses where it is
    read, and only messages with a letter are shuffled.
    """
    letters = settle(dlq_parse(dlq), "letters")
    src = source.select(
        F.col("topic").alias("original_topic"),
        F.col("partition").alias("original_partition"),
        F.col("offset").alias("original_offset"),
        F.col("key"), F.col("value").cast("binary").alias("_value"), F.lit(True).alias("_here"),
    )
    joined = letters.join(only_keys_of(src, letters, ADDRESS, broadcast_rows), ADDRESS, "left")
    return (
        joined.withColumn("found", F.coalesce("_here", F.lit(False)))
        .withColumn("same", F.col("found") & F.col("payload").eqNullSafe(F.col("_value")))
        .drop("_value", "_here")
    )


# --- which rows and incidents apply ------------------------------------------

# Incident types that act on brokers.
INFRASTRUCTURE = ("stop_broker", "start_broker")


def filter_incidents(scenarios: DataFrame, types=INFRASTRUCTURE) -> DataFrame:
    """Drop incidents of ``types`` from ``incidents`` and from every group in ``groups``.

    Groups left empty go too; ``skipped`` counts the dropped incidents. Group
    fields other than ``incidents`` are kept as they are.
    """
    dropped = F.array(*[F.lit(t) for t in types])

    def stays(incident: Column) -> Column:
        return ~F.array_contains(dropped, incident["type"])

    def trimmed(group: Column) -> Column:
        return group.withField("incidents", F.filter(group["incidents"], stays))

    def members(groups: Column) -> Column:
        return F.aggregate(groups, F.lit(0), lambda n, g: n + F.size(g["incidents"]))

    plain = F.filter("incidents", stays)
    slim = F.transform("groups", trimmed)
    skipped = F.size("incidents") - F.size(plain) + members(F.col("groups")) - members(slim)
    return scenarios.select(
        *[c for c in scenarios.columns if c not in ("incidents", "groups")],
        plain.alias("incidents"),
        F.filter(slim, lambda g: F.size(g["incidents"]) > 0).alias("groups"),
        skipped.cast("bigint").alias("skipped"),
    )


def visible_to(
    msgs: DataFrame, group_start: DataFrame, reset: str = "latest", broadcast_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """Messages each group reads: all (earliest), or those since it joined (latest).

    ``group_start`` has topic, group_id and joined_at; it is written once, as its size is checked before it is joined.
    """
    if reset not in ("earliest", "latest"):
        raise ValueError("auto_offset_reset must be 'earliest' or 'latest'")
    side = join_side(settle(group_start, "groups"), limit=broadcast_rows)
    joined = msgs.join(side, "topic")
    if reset == "latest":
        joined = joined.where(F.col("ts") >= F.col("joined_at"))
    return joined.drop("joined_at")
