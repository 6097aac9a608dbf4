"""Message keys and partitions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .draw import bits, pick, u

DISTRIBUTIONS = ("uniform", "zipfian", "single_key", "round_robin")


def key_col(distribution: str, seed: int, idx: Column, cardinality: int = 50) -> Column:
    """Key of a row. Zipf keys need the weight table: see ``operators.synth.zipf_key``."""
    if distribution not in DISTRIBUTIONS:
        raise ValueError(f"unknown key distribution '{distribution}'")
    if cardinality < 1:
        raise ValueError("key cardinality must be at least 1")
    if distribution == "uniform":
        return F.concat(F.lit("key-"), pick(u(seed, "key", idx), 0, cardinality - 1).cast("string"))
    if distribution == "single_key":
        return F.lit("hot-key")
    if distribution == "round_robin":
        return F.concat(
            F.lit("key-"), F.pmod(idx, F.lit(cardinality).cast("bigint")).cast("string")
        )
    raise ValueError("zipfian keys are drawn by zipf_key, which joins the weight table")


def partition_col(key: Column, partitions: int | Column) -> Column:
    """Partition of a key; rows without a key go to partition 0."""
    n = F.lit(partitions) if isinstance(partitions, int) else partitions
    bucket = F.pmod(bits(F.md5(key.cast("string")), 1, 8), n.cast("bigint"))
    return F.coalesce(bucket, F.lit(0).cast("bigint")).cast("int")
