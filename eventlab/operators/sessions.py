"""Sessions of a table: stretches of a key's activity without a long pause."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fields import epoch_micros
from ..plans.ordering import BLOCK, running_total, successor


def sessions(msgs: DataFrame, keys: list[str], gap_seconds: float) -> DataFrame:
    """(keys, start_micros, end_micros, messages): rows of ``keys`` that lie less than the gap apart, one after another.

    A session ends one gap behind its last row, as session windows have it. Rows without a time belong to none.

    Rows within one slot as long as the gap are one session in any case, so
    they fold to a count with first and last time, in each task first: the rows of a hot key
    are spread over its slots. Only these folded rows meet their neighbours and are numbered, in blocks of slots,
    so a key that is active for ever is not one task's work either.
    """
    gap = int(gap_seconds * 1_000_000)
    if gap < 1:
        raise ValueError("gap_seconds must be positive")
    at = epoch_micros(F.col("ts"))
    folded = (
        msgs.where(F.col("ts").isNotNull()).select(*keys, at.alias("_at"))
        .groupBy(*keys, F.floor(F.col("_at") / F.lit(gap)).cast("bigint").alias("_slot"))
        .agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"), F.max("_at").alias("_last"))
        .drop("_slot")
    )
    ahead = successor(folded, keys, "_first", "_ahead", gap * BLOCK)
    pause = F.col("_ahead").isNull() | (F.col("_ahead") - F.col("_last") >= gap)
    marked = ahead.withColumn("_ends", pause.cast("bigint"))
    # The number of sessions that end in front of a row tells which one it is in.
    numbered = running_total(marked, keys, "_first", "_ends", "_upto", gap * BLOCK)
    return numbered.groupBy(*keys, (F.col("_upto") - F.col("_ends")).alias("_session")).agg(
        F.min("_first").alias("start_micros"), (F.max("_last") + gap).alias("end_micros"), F.sum("_n").alias("messages")
    ).drop("_session")
