"""Streams of rows and of generated messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.synth import TopicSpec, inject_duplicates, synth_messages


def row_stream(spark: SparkSession, rate: int, partitions: int | None = None) -> DataFrame:
    """Row index and event time at ``rate`` rows per second."""
    reader = spark.readStream.format("rate").option("rowsPerSecond", rate)
    if partitions:
        reader = reader.option("numPartitions", partitions)
    return reader.load().select(F.col("value").alias("row_index"), F.col("timestamp").alias("ts"))


def row_batches(spark: SparkSession, rows_per_batch: int, start_millis: int = 0,
                advance_millis: int = 1000) -> DataFrame:
    """Row index and event time in batches of fixed size and fixed times (repeatable)."""
    raw = (
        spark.readStream.format("rate-micro-batch")
        .option("rowsPerBatch", rows_per_batch)
        .option("startTimestamp", start_millis)
        .option("advanceMillisPerBatch", advance_millis)
        .load()
    )
    return raw.select(F.col("value").alias("row_index"), F.col("timestamp").alias("ts"))


def stream_messages(
    rows: DataFrame, topic: TopicSpec, seed: int = 0, lookups: DataFrame | None = None
) -> DataFrame:
    """The batch generator on a stream of rows: same projections, same values."""
    made = synth_messages(rows, topic, seed, lookups=lookups)
    return inject_duplicates(made, topic.duplicate_rate, seed) if topic.duplicate_rate else made
