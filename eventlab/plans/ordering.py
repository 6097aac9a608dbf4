"""Numbering and running totals that never put one whole group in one task.

A plain window over (topic, partition) sends a hot partition to a single task.
Here the order column is a unique integer, so cutting it into ranges of
``block`` values bounds every window group by ``block`` rows; the counts of the
preceding blocks come from an aggregate with one row per block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 65_536


def number_rows(
    df: DataFrame, keys: list[str], order: str, name: str, block: int = BLOCK
) -> DataFrame:
    """Add ``name`` = 0-based position within ``keys`` by unique integer ``order``."""
    ones = df.withColumn("_one", F.lit(1).cast("bigint"))
    out = running_total(ones, keys, order, "_one", name, block)
    return out.withColumn(name, F.col(name) - 1).drop("_one")


def running_total(
    df: DataFrame, keys: list[str], order: str, value: str, name: str, block: int = BLOCK
) -> DataFrame:
    """Add ``name`` = sum of integer ``value`` up to and including each row."""
    return running_totals(df, keys, order, {value: name}, block)


def running_totals(
    df: DataFrame, keys: list[str], order: str, names: dict[str, str], block: int = BLOCK
) -> DataFrame:
    """``running_total`` of several columns (``names``: value to new column) in one pass."""
    def add(here: Column, before: Column) -> Column:
        return here + F.coalesce(before, F.lit(0))

    return _running(df, keys, order, names, block, F.sum, add)


def running_max(
    df: DataFrame, keys: list[str], order: str, value: str, name: str, block: int = BLOCK
) -> DataFrame:
    """Add ``name`` = largest ``value`` up to and including each row, nulls aside."""
    return _running(df, keys, order, {value: name}, block, F.max, F.greatest)


def _running(df, keys, order, names, block, fold, combine) -> DataFrame:
    """Fold values in order, inside blocks and over the blocks before.

    Rows are shuffled once, by (keys, block): the join with the folds of earlier
    blocks and the window inside a block share that partitioning. Which side of
    the join is broadcast, if any, is left to the adaptive planner. Blocks are
    numbered in the same way, in blocks of ``FANOUT`` blocks and so on, so not even the
    folds of one hot key's blocks meet in one task, until few enough are left to.
    """
    blocked = _grouped(df, keys).withColumn(
        "_block", F.floor(F.col(order) / F.lit(block)).cast("bigint")
    )
    folds = blocked.groupBy("_key", "_block").agg(*[fold(v).alias(f"_f{i}") for i, v in enumerate(names)])
    carried = _carried(folds, "_block", len(names), fold, combine, LEVELS)
    inside = Window.partitionBy("_key", "_block").orderBy(order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    joined = blocked.join(carried, ["_key", "_block"])
    found = [combine(fold(v).over(inside), F.col(f"_b{i}")).alias(n) for i, (v, n) in enumerate(names.items())]
    kept = [F.col(c) for c in df.columns if c not in names.values()]
    return joined.select(*kept, *found)


# Blocks of a block of blocks, and how often blocks are taken together again before the rest meets by key.
FANOUT = 65_536
LEVELS = 1


def _carried(folds: DataFrame, order: str, n: int, fold, combine, levels: int) -> DataFrame:
    """(_key, ``order``, _b0, ...): the fold of all that stands before each row of ``folds``, null where nothing does."""
    values, before = [f"_f{i}" for i in range(n)], [f"_b{i}" for i in range(n)]
    if not levels:
        ahead = Window.partitionBy("_key").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return folds.select("_key", order, *[fold(v).over(ahead).alias(b) for v, b in zip(values, before)])
    outer = f"{order}_"
    grouped = folds.withColumn(outer, F.floor(F.col(order) / F.lit(FANOUT)).cast("bigint"))
    carried = _carried(grouped.groupBy("_key", outer).agg(*[fold(v).alias(v) for v in values]), outer, n, fold, combine, levels - 1)
    carried = carried.select("_key", outer, *[F.col(b).alias(f"_o{b}") for b in before])
    ahead = Window.partitionBy("_key", outer).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    here = grouped.select("_key", outer, order, *[fold(v).over(ahead).alias(b) for v, b in zip(values, before)])
    # Either may be missing: nothing in front inside the outer block, or nothing in front of that.
    both = lambda b: F.when(F.col(b).isNull(), F.col(f"_o{b}")).otherwise(combine(F.col(b), F.col(f"_o{b}")))
    return here.join(carried, ["_key", outer]).select("_key", order, *[both(b).alias(b) for b in before])


def _grouped(df: DataFrame, keys: list[str]) -> DataFrame:
    """Add ``_key``: the keys as one struct, which joins null keys to null keys too."""
    return df.withColumn("_key", F.struct(*keys) if keys else F.struct(F.lit(0)))


def explode_count(df: DataFrame, count: Column, name: str, chunk: int = 4_096) -> DataFrame:
    """Repeat each row ``count`` times with ``name`` = 0..count-1.

    Two nested explodes keep every array at ``chunk`` elements or fewer per
    level, so a long schedule does not build one huge array in a row.
    """
    out = df.withColumn("_n", count.cast("bigint")).where(F.col("_n") > 0)
    out = out.withColumn(
        "_c", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_n") - 1) / F.lit(chunk))))
    )
    first = F.col("_c") * chunk
    last = F.least(first + F.lit(chunk - 1), F.col("_n") - 1)
    return out.withColumn(name, F.explode(F.sequence(first, last))).drop("_n", "_c")


def successor(df: DataFrame, keys: list[str], order: str, name: str, width: int) -> DataFrame:
    """Add ``name`` = the next larger value of ``order`` within ``keys``.

    ``order`` is a whole number, unique within ``keys``. The next value is
    looked up inside ranges of ``width`` values; the last row of a range takes
    the first value of the next range that has any.
    """
    ranged = _grouped(df, keys).withColumn(
        "_range", F.floor(F.col(order) / F.lit(width)).cast("bigint")
    )
    firsts = ranged.groupBy("_key", "_range").agg(F.min(order).alias("_first"))
    ahead = firsts.select(
        "_key", "_range",
        F.lead("_first").over(Window.partitionBy("_key").orderBy("_range")).alias("_next"),
    )
    inside = Window.partitionBy("_key", "_range").orderBy(order)
    return (
        ranged.join(ahead, ["_key", "_range"])
        .withColumn(name, F.coalesce(F.lead(order).over(inside), F.col("_next")))
        .drop("_key", "_range", "_next")
    )
