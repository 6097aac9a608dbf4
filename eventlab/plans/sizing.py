"""Decide how a small side takes part in a join, by a check of its size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path

# A broadcast side stays below this many rows and bytes.
BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 32_000_000


def within(df: DataFrame, rows: int) -> bool:
    """True when ``df`` has at most ``rows`` rows; partitions are read a few at a time until one more has turned up."""
    return not df.select(F.lit(1)).offset(rows).head(1)


def _width(kind: T.DataType, value: Column) -> Column:
    """Bytes of a value, about: what texts, arrays and maps hold, and 8 for anything else."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(value), F.lit(0)) + 8
    if isinstance(kind, T.ArrayType):
        each = F.aggregate(F.transform(value, lambda x: _width(kind.elementType, x).cast("bigint")), F.lit(0).cast("bigint"), lambda n, x: n + x)
        return F.coalesce(each, F.lit(0)) + 8
    if isinstance(kind, T.MapType):
        return _width(T.ArrayType(kind.keyType), F.map_keys(value)) + _width(T.ArrayType(kind.valueType), F.map_values(value))
    if isinstance(kind, T.StructType):
        return sum((_width(f.dataType, value[f.name]) for f in kind.fields), F.lit(8))
    return F.lit(8)


def _fixed(kind: T.DataType) -> bool:
    return not isinstance(kind, (T.StringType, T.BinaryType, T.ArrayType, T.MapType, T.StructType))


def small(df: DataFrame, rows: int, bytes_: int = BROADCAST_BYTES, known_rows: int | None = None) -> bool:
    """True when ``df`` has at most ``rows`` rows and some ``bytes_`` bytes.

    At most one row more than ``rows`` is looked at, and only sums reach the
    driver; nothing is run where the row count and the width of a row are known.
    """
    if known_rows is not None and (known_rows > rows or all(_fixed(f.dataType) for f in df.schema)):
        return known_rows <= rows and 8 * len(df.columns) * known_rows <= bytes_
    width = sum((_width(f.dataType, F.col(f"`{f.name}`")) for f in df.schema), F.lit(0)).cast("bigint")
    n, total = df.select(width.alias("w")).limit(rows + 1).agg(F.count("w"), F.coalesce(F.sum("w"), F.lit(0))).first()
    return n <= rows and total <= bytes_


def join_side(df: DataFrame, known_rows: int | None = None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Mark ``df`` as a broadcast side only where its rows and bytes are proven small.

    ``known_rows`` is a bound known from arguments; without one the rows are
    counted up to the limit, and wherever texts or arrays are held their bytes
    are added up. Larger sides are sort-merge joined, which the
    adaptive planner can split where one key is hot.
    """
    return F.broadcast(df) if small(df, limit, known_rows=known_rows) else df.hint("merge")


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to a table in the shared folder and read it back.

    For the small side of a join whose plan is long: it is computed once, its
    size is known from the files, and a lost executor does not run it again.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# Bits of the map of keys that rows are held against where the keys are too many to broadcast: 2,048 rows of 4 kB.
MAP_BITS = 1 << 26


def only_keys_of(df: DataFrame, few: DataFrame, keys: list[str], broadcast_rows: int = BROADCAST_ROWS, bits: int = MAP_BITS) -> DataFrame:
    """``df`` without rows whose keys are not in ``few``, or without most of them; nothing is shuffled but keys.

    Where the distinct keys are proven small they are broadcast, and what
    stays is exact. Beyond, they are folded to a bitmap of their hashes, of a fixed size whatever
    their number, and some rows without a partner stay, which the join behind
    this one drops. Rows with a null key go. ``few`` is read twice, so it should be a stored table.
    """
    wanted = few.select(*keys).dropna().distinct()
    if small(wanted, broadcast_rows):
        return df.join(F.broadcast(wanted), keys, "left_semi")
    place = F.pmod(F.xxhash64(*keys), F.lit(bits)).alias("_place")
    maps = wanted.select(place).groupBy((F.bitmap_bucket_number("_place")).alias("_bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("_place")).alias("_map"))
    at = F.bitmap_bit_position("_place")
    byte = F.conv(F.hex(F.substring(F.col("_map"), (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    # At most bits / 32,768 rows of 4 kB each.
    held = df.withColumn("_place", place).withColumn("_bucket", F.bitmap_bucket_number("_place")).join(F.broadcast(maps), "_bucket")
    return held.where(F.getbit(byte, (at % 8).cast("int")) == 1).select(*df.columns)
