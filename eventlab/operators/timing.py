"""Event times of generated rows: constant rates and rate changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.ordering import running_total, successor
from ..plans.segments import locate
from ..plans.sizing import BROADCAST_ROWS

MICROS = 1_000_000
DAY = 86_400 * MICROS


def event_micros(start_micros: int | Column, position: Column, rate: float) -> Column:
    """Microseconds at which row ``position`` is sent at a constant rate."""
    if rate <= 0:
        raise ValueError("rate must be positive")
    start = F.lit(start_micros) if isinstance(start_micros, int) else start_micros
    return start.cast("bigint") + F.floor(position * F.lit(float(MICROS)) / F.lit(float(rate))).cast("bigint")


def with_event_time(
    df: DataFrame, start_micros: int, rate: float, position: str = "row_index", name: str = "ts"
) -> DataFrame:
    return df.withColumn(name, F.timestamp_micros(event_micros(start_micros, F.col(position), rate)))


def rate_segments(changes: DataFrame, keys: list[str]) -> DataFrame:
    """Turn rate changes into the send positions each rate covers.

    ``changes`` has ``keys``, at_micros (first change at the start) and rate; of
    changes at one time the largest rate holds. Messages due are counted in whole
    millionths, whose sums come out the same in any order. The first position
    sent at or after a change is the messages due until then, rounded up. Rates
    of zero cover no positions.
    """
    one = changes.groupBy(*keys, "at_micros").agg(F.max("rate").cast("double").alias("rate"))
    timed = successor(one, keys, "at_micros", "_until", DAY)
    due = F.round(F.col("rate") * (F.col("_until") - F.col("at_micros"))).cast("bigint")
    timed = timed.withColumn("_due", F.coalesce(due, F.lit(0)))
    summed = running_total(timed, keys, "at_micros", "_due", "_upto", DAY)

    def whole(millionths: Column) -> Column:
        return F.ceil(millionths / F.lit(MICROS)).cast("bigint")

    segments = summed.select(
        *keys, whole(F.col("_upto") - F.col("_due")).alias("seg_from"),
        F.when(F.col("_until").isNotNull(), whole(F.col("_upto"))).alias("seg_to"),
        "at_micros", "rate", (F.col("_upto") - F.col("_due")).alias("due_before"),
    )
    return segments.where(
        (F.col("rate") > 0) & (F.col("seg_to").isNull() | (F.col("seg_to") > F.col("seg_from")))
    )


def with_rate_schedule(
    df: DataFrame, changes: DataFrame, keys: list[str], position: str = "position",
    name: str = "sent_micros", width: int | None = None, broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Add the send time of each position under changing rates.

    Rows past the capacity of the schedule (last rate zero) have no send time.
    """
    placed = locate(
        df, F.col(position), rate_segments(changes, keys), keys, width, "left", broadcast_rows,
        open_ended=True,
    )
    inside = (F.col(position) * F.lit(MICROS) - F.col("due_before")) / F.col("rate")
    return placed.withColumn(name, F.col("at_micros") + F.floor(inside).cast("bigint")).drop(
        "seg_from", "seg_to", "at_micros", "rate", "due_before"
    )
