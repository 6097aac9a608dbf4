"""Combining and comparing message tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ADDRESS = ["topic", "partition", "offset"]


def merge(**scenarios: DataFrame) -> DataFrame:
    """Union of message tables, tagged with the name each was given under."""
    tagged = [df.withColumn("scenario", F.lit(name)) for name, df in scenarios.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def delivery_diff(sent: DataFrame, received: DataFrame) -> DataFrame:
    """Addresses received less often than sent (lost), or more often (unexpected): a row for each time.

    One aggregate over both tables, folded on the map side, so an address with
    very many deliveries is no hot key.
    """
    sides = sent.select(*ADDRESS, F.lit(1).alias("_n")).unionByName(received.select(*ADDRESS, F.lit(-1).alias("_n")))
    more = sides.groupBy(*ADDRESS).agg(F.sum("_n").alias("_n")).where("_n <> 0")
    verdict = F.when(F.col("_n") > 0, "lost").otherwise("unexpected")
    return more.select(*ADDRESS, verdict.alias("verdict"), F.explode(F.sequence(F.lit(1), F.abs("_n"))).alias("_k")).drop("_k")


def shared_topics(a: DataFrame, b: DataFrame) -> DataFrame:
    """Topics both tables carry. Rows of both fold to their distinct topics before they meet."""
    sides = a.select("topic", F.lit(1).alias("_side")).unionByName(b.select("topic", F.lit(2).alias("_side")))
    found = sides.groupBy("topic").agg(F.min("_side").alias("_low"), F.max("_side").alias("_high"))
    return found.where("_low < _high").select("topic")
