"""What a stream has not closed yet, read from the state in its checkpoint.

In append mode a stream keeps windows, sessions, matches and flows until its
watermark has passed them, drops what comes later, and forgets them then: state
stays bounded. What is still open after the last batch is not part of its output; the functions
here read it from the state tables as ordinary rows, so that closed and open rows
together are the whole result. They read the last committed batch, of a query that runs on, too.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path


@dataclass(frozen=True)
class Drained:
    """What a stream has put out, and the checkpoint with the state it left."""

    closed: DataFrame
    checkpoint: str

    def whole(self, still_open: DataFrame) -> DataFrame:
        """Closed and open rows, told apart by ``closed``."""
        return self.closed.withColumn("closed", F.lit(True)).unionByName(still_open.withColumn("closed", F.lit(False)))


def drained(stream: DataFrame, label: str) -> Drained:
    """Run a stream in append mode over everything available now; results go to files in the shared folder, never through the driver."""
    spark = stream.sparkSession
    path, checkpoint = scratch_path(spark, label), scratch_path(spark, f"{label}-checkpoint")
    stream.writeStream.outputMode("append").format("parquet").option("path", path).option(
        "checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return Drained(spark.read.schema(stream.schema).parquet(path), checkpoint)


def state_of(spark: SparkSession, checkpoint: str, value: str, **options: str) -> DataFrame:
    """Rows of a state table: the key's columns, then those of the value, named by ``value`` (a schema) in their order.

    Aggregates keep their running values in the order they were asked for, under names of
    Spark's own. ``options`` pick one of several tables (joinSide, stateVarName).
    """
    table = spark.read.format("statestore").options(**options).load(checkpoint)
    return table.select("key", F.col("value").cast(f"struct<{value}>").alias("value")).select("key.*", "value.*")
