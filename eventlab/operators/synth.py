"""Synthetic tables: row index in, messages out.

Everything except the lookup and Zipf joins is one projection over the row
index, so generation needs no shuffle and runs in whole-stage codegen.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.draw import pick, u
from ..functions.fields import Context, field_col
from ..functions.keys import key_col, partition_col
from ..functions.payloads import json_payload, json_value
from ..plans.ordering import explode_count, number_rows
from ..plans.sizing import BROADCAST_ROWS, join_side, settle
from ..plans.spec import Field

# On a stream, where rows cannot be put together again by their index, each array item that a
# row may have takes a join of its own, and so many may be needed.
ITEM_JOINS = 128


def rows(spark: SparkSession, n: int, partitions: int | None = None) -> DataFrame:
    """Row-index table 0..n-1."""
    return spark.range(0, n, 1, partitions).withColumnRenamed("id", "row_index")


# --- lookup values -----------------------------------------------------------


def lookup_values(df: DataFrame, value: Column, order: str, provider: str, locale: str = "") -> DataFrame:
    """A value table for ``lookup_col``: positions follow the unique integer ``order``.

    The numbered table is written once, as every field drawn from it reads it.
    """
    base = df.select(
        F.lit(provider).alias("provider"), F.lit(locale).alias("locale"),
        value.cast("string").alias("value"), F.col(order).cast("bigint").alias("_order"),
    )
    return settle(number_rows(base, ["provider", "locale"], "_order", "pos").drop("_order"), "lookup")


def lookup_col(
    df: DataFrame, name: str, values: DataFrame, provider: str, locale: str = "",
    seed: int = 0, path: str | None = None, idx: str = "row_index",
    broadcast_rows: int = BROADCAST_ROWS, last: int | None = None,
) -> DataFrame:
    """Add ``name``: a value drawn from the rows of one provider and locale.

    ``values`` has provider, locale, pos (0..n-1) and value. Drawn positions are
    uniform, so the join has no hot key however large either side is. ``last`` is the
    largest position, where it is known and was checked.
    """
    mine = values.where((F.col("provider") == provider) & (F.col("locale") == locale))
    last = _last_position(mine, provider, locale) if last is None else last
    text = F.col("value").cast("string").alias(name)
    side = join_side(
        mine.select(F.col("pos").alias("_pos"), text), known_rows=last + 1, limit=broadcast_rows
    )
    drawn = df.withColumn("_pos", pick(u(seed, path or name, F.col(idx)), 0, last))
    return drawn.join(side, "_pos", "left").drop("_pos")


def _last_position(mine: DataFrame, provider: str, locale: str) -> int:
    """The largest position of a provider's values, which must be 0 to n - 1 without gaps or repeats."""
    low, last, n, distinct = mine.agg(F.min("pos"), F.max("pos"), F.count("pos"), F.count_distinct("pos")).first()
    if last is None:
        raise ValueError(f"no lookup values for '{provider}' in locale '{locale}'")
    if not (low == 0 and n == distinct == last + 1):
        raise ValueError(f"positions of '{provider}' in locale '{locale}' have gaps or repeats")
    return last


# --- keys --------------------------------------------------------------------


# The smallest whole-number weight of a key: shares keep to the law to one in so many.
LEAST_WEIGHT = 1_000


def zipf_weights(spark: SparkSession, cardinality: int, exponent: float = 1.5) -> DataFrame:
    """(rank, lo, hi, total): whole-number weight ranges, rank i weighing 1/(i+1)^s.

    Whole numbers add up the same in any order, so a retried task rebuilds the
    same table. The largest weight is 2^51, or less where the sum would pass
    2^62; a weight is off by less than one, so its share of the law is kept to
    1 in 1,000 up to some 10^8 keys at exponent 1.5. More are an error.
    """
    # Bounds the sum of 1/i^s by its integral.
    s, c = float(exponent), float(cardinality)
    sum_bound = 1 + (math.log(c) if s == 1 else (c ** (1 - s) - 1) / (1 - s))
    scale = min(1 << 51, int((1 << 61) / sum_bound))
    if scale / c ** s < LEAST_WEIGHT:
        raise ValueError(f"{cardinality} keys at exponent {exponent} are too many: the rarest would no longer follow the law")
    share = F.lit(float(scale)) / F.pow(F.col("id") + F.lit(1.0), F.lit(float(exponent)))
    ranks = spark.range(cardinality).select(
        F.col("id").alias("rank"),
        F.floor(share).cast("bigint").alias("w"),
    )
    block = 4_096
    blocked = ranks.withColumn("b", F.floor(F.col("rank") / F.lit(block)))
    carried = blocked.groupBy("b").agg(F.sum("w").alias("s")).select(
        "b",
        (F.sum("s").over(Window.orderBy("b")) - F.col("s")).alias("before"),
        F.sum("s").over(Window.orderBy("b").rowsBetween(
            Window.unboundedPreceding, Window.unboundedFollowing)).alias("total"),
    )
    inside = Window.partitionBy("b").orderBy("rank")
    side = join_side(carried, known_rows=-(-cardinality // block))
    return (
        blocked.join(side, "b")
        .withColumn("hi", F.sum("w").over(inside) + F.col("before"))
        .select("rank", (F.col("hi") - F.col("w")).alias("lo"), "hi", "total")
    )


def zipf_key(
    df: DataFrame, cardinality: int = 50, exponent: float = 1.5, seed: int = 0,
    idx: str = "row_index", name: str = "key", broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Add a Zipf-distributed key.

    The draw is looked up through guide buckets: an equality join on
    ``floor(draw * B)`` leaves one or a few weight ranges to compare, and the
    buckets are equally likely, so the join has no hot key even though the keys do.
    """
    if cardinality < 1:
        raise ValueError("key cardinality must be at least 1")
    buckets = max(64, cardinality)
    cell = F.lit(float(buckets))
    # Neighbouring ranks divide the same number, so their bounds meet exactly.
    shares = zipf_weights(df.sparkSession, cardinality, exponent).select(
        "rank", (F.col("lo") / F.col("total")).alias("lo"), (F.col("hi") / F.col("total")).alias("hi")
    )
    first = F.floor(F.col("lo") * cell).cast("bigint")
    last = F.least(F.floor(F.col("hi") * cell).cast("bigint"), F.lit(buckets - 1))
    guide = explode_count(shares, last - first + 1, "_step").select(
        (first + F.col("_step")).alias("_bucket"), "rank", "lo", "hi"
    )
    side = join_side(guide, known_rows=buckets + 2 * cardinality, limit=broadcast_rows)
    left = df.withColumn("_at", u(seed, "key", F.col(idx))).withColumn(
        "_bucket", F.floor(F.col("_at") * cell).cast("bigint")
    )
    hit = (F.col("_at") >= F.col("lo")) & (F.col("_at") < F.col("hi"))
    joined = left.join(side, "_bucket").where(hit)
    return joined.withColumn(name, F.concat(F.lit("key-"), F.col("rank").cast("string"))).drop(
        "_at", "_bucket", "rank", "lo", "hi"
    )


def with_key(
    df: DataFrame, distribution: str = "uniform", cardinality: int = 50, seed: int = 0,
    idx: str = "row_index",
) -> DataFrame:
    """Add the ``key`` column for any distribution."""
    if distribution == "zipfian":
        return zipf_key(df, cardinality, seed=seed, idx=idx)
    return df.withColumn("key", key_col(distribution, seed, F.col(idx), cardinality))


# --- whole tables ------------------------------------------------------------


def with_lookups(
    df: DataFrame, fields, lookups: DataFrame | None, seed: int, prefix: str, idx: str
):
    """Prepare lookup fields: (df with their values joined on, lookup for ``field_col``).

    Fields outside arrays are joined, one column each. For those inside arrays
    the items of a row are listed by their paths, each draws its position and joins its value, and
    a map from path to value comes back to the row by its index, whatever the
    number of values. On a stream the values of each item that the declared sizes allow are joined on as a
    column, which keeps no state; they draw the same.
    """
    joined, listed, items, lasts = {}, {}, {}, {}
    row = F.col(idx)

    def items_of(field: Field, path: Column) -> Column:
        size = pick(u(seed, path, row), field.min_items, field.max_items)
        filled = F.transform(F.sequence(F.lit(0).cast("bigint"), size - 1), lambda j: F.concat(path, F.lit("["), j.cast("string"), F.lit("]")))
        return F.when(size > 0, filled).otherwise(F.array().cast("array<string>"))

    def visit(field: Field, path: str, paths: Column | None, each: list[str]) -> None:
        """``paths`` are those of the field in all items of a row, inside arrays, ``each`` those it could have."""
        nonlocal df
        if len(each) > ITEM_JOINS and df.isStreaming and field.type == "faker":
            raise ValueError(f"on a stream, '{field.name}' may stand in {ITEM_JOINS} items of a row at most, not {len(each)}")
        if field.type == "faker":
            if lookups is None:
                raise ValueError(f"field '{field.name}' needs a table of lookup values")
            key = (field.provider, field.locale or "")
            if key not in lasts:
                lasts[key] = _last_position(lookups.where((F.col("provider") == key[0]) & (F.col("locale") == key[1])), *key)
            if paths is not None and df.isStreaming:
                for p in each:
                    items[p] = f"_lookup_{prefix}item{len(items)}"
                    df = lookup_col(df, items[p], lookups, *key, seed, p, idx, last=lasts[key])
            elif paths is not None:
                listed.setdefault(key, []).append(paths)
            else:
                joined[path] = f"_lookup_{prefix}{len(joined)}"
                df = lookup_col(df, joined[path], lookups, *key, seed, path, idx, last=lasts[key])
        for f in field.fields or ():
            end = F.lit(f".{f.name}")
            below = None if paths is None else F.transform(paths, lambda p: F.concat(p, end))  # noqa: B023 - built at once
            visit(f, f"{path}.{f.name}", below, [f"{p}.{f.name}" for p in each])
        if field.items is not None:
            below = items_of(field, F.lit(path)) if paths is None else F.flatten(F.transform(paths, lambda p: items_of(field, p)))
            if not df.isStreaming:
                each = [path]
            elif len(each) * field.max_items > ITEM_JOINS:
                each = [""] * (ITEM_JOINS + 1)  # too many, if a lookup is in them
            else:
                each = [f"{p}[{j}]" for p in each for j in range(field.max_items)]
            visit(field.items, path, below, each)

    for f in fields:
        visit(f, prefix + f.name, None, [prefix + f.name])
    maps = {}
    for key, paths in listed.items():
        maps[key] = f"_lookup_{prefix}{len(joined) + len(maps)}"
        df = _item_values(df, maps[key], F.concat(*paths), lookups, *key, lasts[key], seed, idx)

    def lookup(field: Field, path) -> Column:
        key = (field.provider, field.locale or "")
        if isinstance(path, str):
            return F.col(f"`{joined[path]}`")
        if key in maps:
            return F.col(f"`{maps[key]}`")[path]
        return F.create_map(*[x for p, c in items.items() for x in (F.lit(p), F.col(f"`{c}`"))])[path]

    return df, lookup


def _item_values(df: DataFrame, name: str, paths: Column, lookups: DataFrame, provider: str, locale: str, last: int, seed: int, idx: str) -> DataFrame:
    """Add a map from each path of a row's items to the value that it draws."""
    mine = lookups.where((F.col("provider") == provider) & (F.col("locale") == locale))
    items = df.select(F.col(idx).alias("_row"), F.explode(paths).alias("_path"))
    drawn = items.withColumn("_pos", pick(u(seed, F.col("_path"), F.col("_row")), 0, last))
    side = join_side(mine.select(F.col("pos").alias("_pos"), F.col("value").cast("string").alias("_value")), known_rows=last + 1)
    entries = F.map_from_entries(F.collect_list(F.struct("_path", "_value"))).alias(name)
    found = drawn.join(side, "_pos").groupBy("_row").agg(entries)
    return df.join(found, df[idx] == found["_row"], "left").drop("_row")


def synth_table(
    df: DataFrame, fields: list[Field], seed: int = 0, idx: str = "row_index",
    ts: str | None = None, lookups: DataFrame | None = None, prefix: str = "", keep=(),
) -> DataFrame:
    """One column per declared field; ``keep`` names input columns carried along."""
    base = df.select(*dict.fromkeys([*keep, idx, *([ts] if ts else [])]))
    base, lookup = with_lookups(base, fields, lookups, seed, prefix, idx)
    context = Context(F.col(ts) if ts else None, lookup)
    made = [field_col(f, seed, prefix + f.name, F.col(idx), context).alias(f.name) for f in fields]
    return base.select(*keep, *made)


@dataclass(frozen=True)
class TopicSpec:
    """A topic and the messages it carries."""

    name: str
    partitions: int = 12
    replication_factor: int = 3
    rate: float = 1000.0
    key_distribution: str = "uniform"
    key_cardinality: int = 50
    min_size: int = 200
    max_size: int = 500
    include_timestamp: bool = True
    include_sequence: bool = True
    duplicate_rate: float = 0.0
    fields: tuple[Field, ...] | None = None

    def __post_init__(self) -> None:
        if self.partitions < 1 or self.key_cardinality < 1 or self.rate <= 0:
            raise ValueError("partitions, key_cardinality and rate must be positive")
        if self.min_size < 1 or self.max_size < self.min_size:
            raise ValueError("sizes must satisfy 1 <= min <= max")
        if not 0.0 <= self.duplicate_rate <= 1.0:
            raise ValueError("duplicate_rate must be between 0 and 1")


def synth_messages(
    df: DataFrame, topic: TopicSpec, seed: int = 0, idx: str = "row_index", ts: str = "ts",
    lookups: DataFrame | None = None,
) -> DataFrame:
    """Messages of one topic: topic, partition, key, value, ts, row_index.

    The value is structured JSON where fields are declared, else padded JSON.
    """
    base = df.select(F.col(idx).cast("bigint").alias("row_index"), F.col(ts).alias("ts"))
    keyed = with_key(base, topic.key_distribution, topic.key_cardinality, seed)
    i, t = F.col("row_index"), F.col("ts")
    if topic.fields:
        keyed, lookup = with_lookups(keyed, topic.fields, lookups, seed, "", "row_index")
        context = Context(t, lookup)
        value = json_value(*[field_col(f, seed, f.name, i, context).alias(f.name) for f in topic.fields])
    else:
        value = json_payload(
            seed, i, t, topic.min_size, topic.max_size, topic.include_timestamp, topic.include_sequence
        )
    return keyed.select(
        F.lit(topic.name).alias("topic"),
        partition_col(F.col("key"), topic.partitions).alias("partition"),
        "key", value.alias("value"), "ts", "row_index",
    )


def inject_duplicates(df: DataFrame, rate: float, seed: int = 0, idx: str = "row_index") -> DataFrame:
    """Follow a share of rows by one exact copy; ``copy_no`` is 0 or 1."""
    if not 0.0 <= rate <= 1.0:
        raise ValueError("duplicate_rate must be between 0 and 1")
    twice = u(seed, "duplicate", F.col(idx)) < F.lit(float(rate))
    copies = F.when(twice, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return df.withColumn("copy_no", F.explode(copies))


def send_position(
    df: DataFrame, keys: list[str], idx: str = "row_index", name: str = "position"
) -> DataFrame:
    """Add the send position per ``keys``: copies take a position of their own."""
    copy = F.col("copy_no") if "copy_no" in df.columns else F.lit(0)
    ordered = df.withColumn("_send", F.col(idx).cast("bigint") * 2 + copy)
    return number_rows(ordered, keys, "_send", name).drop("_send")


def with_offsets(df: DataFrame, idx: str = "row_index") -> DataFrame:
    """Add ``offset``: position within (topic, partition)."""
    return send_position(df, ["topic", "partition"], idx, "offset")
