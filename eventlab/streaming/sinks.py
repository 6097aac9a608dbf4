"""Sinks: routing to two tables, and draining a stream into a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.routing import FailurePolicy, dlq_envelope, process
from ..session import scratch_path
from .tails import drained


def stream_route(
    msgs: DataFrame, policy: FailurePolicy, ok_path: str, dlq_path: str, checkpoint: str,
    seed: int = 0, trigger: dict | None = None,
):
    """Write consumed messages and dead letters to two tables; returns the query.

    Every batch overwrites its own folder, so a batch run again after a failure
    leaves one copy.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        routed = process(batch, policy, seed).persist()
        try:
            ok = routed.where(F.col("status") == "ok")
            failed = dlq_envelope(routed.where(F.col("status") == "dlq"))
            ok.write.mode("overwrite").parquet(f"{ok_path}/batch={batch_id}")
            failed.write.mode("overwrite").parquet(f"{dlq_path}/batch={batch_id}")
        finally:
            routed.unpersist()

    return (
        msgs.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "10 seconds"}))
        .start()
    )


def drain(stream: DataFrame, label: str, mode: str = "append") -> DataFrame:
    """Run a stream over everything available now and return its result as a table.

    Results go to files in the shared folder, never through the driver. In
    append mode windows, sessions and matches that are still open at the end of the input
    stay out, as they do on a stream that goes on; ``tails`` reads them. Complete mode is for running totals,
    whose groups are few and never end: each batch writes its own folder and the last one counts, so a batch
    that is lost leaves the one before it.
    """
    if mode == "append":
        return drained(stream, label).closed
    if mode != "complete":
        raise ValueError("mode must be 'append' or 'complete'")
    spark, done = stream.sparkSession, []
    path, checkpoint = scratch_path(spark, label), scratch_path(spark, f"{label}-checkpoint")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        done[:] = [batch_id]

    stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(
        availableNow=True).foreachBatch(write).start().awaitTermination()
    if not done:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(f"{path}/batch={done[0]}")
