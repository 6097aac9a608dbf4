"""Incident schedules and their effect on messages.

Times of schedules are whole seconds from the start of a run; times joined with
messages are microseconds since 1970. Schedules expand to firings, firings to
intervals, and overlapping intervals to segments that do not overlap; a message
is then placed in at most one segment (``plans.segments.locate``), so the large
side is read once and never multiplies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fields import epoch_micros
from ..functions.draw import digest
from ..plans.ordering import explode_count, running_max, running_total, successor
from ..plans.segments import count_between, covered, elementary, locate
from ..plans.sizing import BROADCAST_ROWS

DAY = 86_400_000_000

# Seconds a rebalance keeps its consumer away (close + rejoin).
REBALANCE_SECONDS = 5

# Incident types by how long their effect lasts.
TIMED = ("pause_consumer",)
UNTIL_CHANGED = ("increase_consumer_delay", "change_producer_rate")
BROKER_DOWN, BROKER_UP = "stop_broker", "start_broker"

# Settings a target may have.
TARGET_KEYS = ("topic", "group", "percentage", "count")


def command_seconds(kind: Column, duration: Column) -> Column:
    """How long an incident's own commands keep its schedule busy."""
    return (
        F.when(kind == "pause_consumer", F.coalesce(duration, F.lit(0)))
        .when(kind == "rebalance_consumer", F.lit(REBALANCE_SECONDS))
        .otherwise(F.lit(0))
        .cast("bigint")
    )


def expand_schedule(incidents: DataFrame, horizon: int) -> DataFrame:
    """Firings up to ``horizon`` seconds: ``firing`` (0-based) and ``fire``.

    ``incidents`` has incident_id, type, at_seconds, every_seconds,
    initial_delay_seconds and duration_seconds. A period wins over a fixed time;
    the next firing waits for the commands of the previous one.
    """
    busy = command_seconds(F.col("type"), F.col("duration_seconds"))
    step = F.col("every_seconds") + busy
    first = F.coalesce("initial_delay_seconds", F.lit(0))
    periodic = F.col("every_seconds") > 0
    count = (
        F.when(periodic & (first <= horizon), F.floor((F.lit(horizon) - first) / step) + 1)
        .when(~F.coalesce(periodic, F.lit(False)) & (F.col("at_seconds") <= horizon), F.lit(1))
        .otherwise(F.lit(0))
    )
    fire = F.when(periodic, first + F.col("firing") * step).otherwise(
        F.greatest(F.col("at_seconds"), F.lit(0))
    )
    return explode_count(incidents, count, "firing").withColumn("fire", fire.cast("bigint"))


def expand_groups(items: DataFrame, horizon: int) -> DataFrame:
    """Firings of repeating groups, whose items run one after another.

    ``items`` has group_id, pos (unique per group), type, at_seconds (may be
    null), duration_seconds, repeat (once if null) and interval_seconds (60 if null). An item fires when the
    one before it has ended and its own time has come. With P the summed length
    of earlier items of the cycle and D that of a whole cycle, the slack an item
    imposes is at - P, shifted by interval - D per cycle; the largest slack so far
    is reached in the same cycle or at either end of the earlier ones. So cycles
    need no ordering among themselves and are exploded on the map side.
    """
    group = ["group_id"]
    known = items.withColumn("busy", command_seconds(F.col("type"), F.col("duration_seconds")))
    ended = running_total(known, group, "pos", "busy", "_ended")
    timed = ended.withColumn("_p", F.col("_ended") - F.col("busy")).withColumn(
        "_own", F.col("at_seconds").cast("bigint") - F.col("_p")
    )
    # Every cycle also waits for its own start, a slack of 0 from its first item on.
    sums = timed.groupBy(*group).agg(
        F.sum("busy").alias("_d"), F.greatest(F.max("_own"), F.lit(0)).alias("_most")
    )
    timed = running_max(timed.join(sums, group), group, "pos", "_own", "_slack").withColumn(
        "_slack", F.greatest("_slack", F.lit(0))
    )
    interval = F.coalesce("interval_seconds", F.lit(60))
    drift = interval - F.col("_d")
    # A cycle starts after as many intervals, and as many whole cycles, as went before it: later ones are past the horizon.
    step = F.greatest(interval, F.col("_d"))
    cycles = F.coalesce("repeat", F.lit(1)).cast("bigint")
    cycles = F.when(step > 0, F.least(cycles, F.floor(F.lit(horizon) / step).cast("bigint") + 1)).otherwise(cycles)
    cycle = F.col("cycle")
    earlier = F.when(cycle > 0, F.col("_most") + F.greatest(F.lit(0), (cycle - 1) * drift))
    fire = cycle * F.col("_d") + F.col("_p") + F.greatest(F.col("_slack") + cycle * drift, earlier)
    return (
        explode_count(timed, cycles, "cycle")
        .withColumn("fire", fire.cast("bigint"))
        .where(F.col("fire") <= horizon)
        .drop("_d", "_ended", "_p", "_own", "_most", "_slack")
    )


def effect_intervals(firings: DataFrame, horizon: int, width: int = 3_600) -> DataFrame:
    """Interval ``[seg_from, seg_to)`` in seconds over which each firing has effect.

    ``firings`` has incident_id, type, target, fire, duration_seconds and any
    settings. A pause lasts its duration, a rebalance 5 s; delays and rates last
    until the next change of the same type and target, a broker stop until the
    next start of that broker; all end at ``horizon`` at the latest. Of changes
    at the same time the one with the largest incident_id holds.
    """
    kind = F.col("type")
    fixed = firings.where(kind.isin(*TIMED, "rebalance_consumer")).withColumn(
        "seg_to", F.col("fire") + command_seconds(kind, F.col("duration_seconds"))
    )
    lasting = firings.where(kind.isin(*UNTIL_CHANGED, BROKER_DOWN, BROKER_UP)).withColumn(
        "_line", F.when(kind.isin(BROKER_DOWN, BROKER_UP), F.lit("broker")).otherwise(kind)
    )
    rest = [c for c in firings.columns if c not in ("target", "fire", "incident_id")]
    latest = lasting.groupBy("_line", "target", "fire").agg(
        F.max(F.struct("incident_id", *rest)).alias("_r")
    ).select("_line", "target", "fire", "_r.*")
    open_until = successor(latest, ["_line", "target"], "fire", "seg_to", width)
    changed = open_until.where(kind != BROKER_UP).select(*firings.columns, "seg_to")
    return (
        fixed.unionByName(changed)
        .withColumn("seg_to", F.least(F.coalesce("seg_to", F.lit(horizon)), F.lit(horizon)).cast("bigint"))
        .withColumnRenamed("fire", "seg_from")
        .where(F.col("seg_to") > F.col("seg_from"))
    )


def on_clock(intervals: DataFrame, start_micros: Column) -> DataFrame:
    """Move interval bounds from run seconds to microseconds since 1970."""
    return intervals.withColumn("seg_from", start_micros + F.col("seg_from") * 1_000_000).withColumn(
        "seg_to", start_micros + F.col("seg_to") * 1_000_000
    )


def check_target(target: dict) -> dict:
    unknown = set(target) - set(TARGET_KEYS)
    if unknown:
        raise ValueError(f"unknown target settings: {sorted(unknown)}")
    return target


def select_target(members: DataFrame, target: dict, seed: int = 0, path: str = "target") -> DataFrame:
    """Members hit by an incident: by topic and group, then a drawn count or share.

    ``members`` has member_id (whole number), topic and group_id. Members are
    ordered by a hash and the first k taken; a percentage means at least one member, and a count wins over a percentage.
    """
    check_target(target)
    hit = members
    if target.get("topic"):
        hit = hit.where(F.col("topic") == target["topic"])
    if target.get("group"):
        hit = hit.where(F.col("group_id") == target["group"])
    count, share = target.get("count"), target.get("percentage")
    if count is None and share is None:
        return hit
    draw = digest(seed, path, F.col("member_id"))
    if count is not None:
        return _first_by_hash(hit, draw, F.lit(count))
    size = hit.agg(F.count(F.lit(1)).alias("n"))
    k = F.greatest(F.lit(1), F.floor(size.scalar() * share / F.lit(100)))
    return _first_by_hash(hit, draw, k)


def _first_by_hash(members: DataFrame, draw: Column, k: Column) -> DataFrame:
    """The k rows with the smallest hash, k being known only when the query runs.

    Rows are counted per leading hash digits; only the one digit group in which
    the k-th row falls is ranked.
    """
    hashed = members.withColumn("_h", draw).withColumn("_d", F.substring("_h", 1, 4))
    digits = hashed.groupBy("_d").agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.orderBy("_d").rowsBetween(Window.unboundedPreceding, -1)
    # At most 65,536 digit groups exist, so this window and broadcast stay small.
    before = digits.withColumn("_before", F.coalesce(F.sum("_n").over(upto), F.lit(0)))
    placed = hashed.join(F.broadcast(before.select("_d", "_n", "_before")), "_d").where(F.col("_before") < k)
    whole = placed.where(F.col("_before") + F.col("_n") <= k)
    rank = F.row_number().over(Window.partitionBy("_d").orderBy("_h", "member_id"))
    border = placed.where(F.col("_before") + F.col("_n") > k).withColumn("_rank", rank + F.col("_before"))
    border = border.where(F.col("_rank") <= k).drop("_rank")
    return whole.unionByName(border).drop("_h", "_d", "_n", "_before")


def pick_one(selected: DataFrame, seed: int = 0, path: str = "rebalance") -> DataFrame:
    """The single member a rebalance closes."""
    return selected.orderBy(digest(seed, path, F.col("member_id")), "member_id").limit(1)


def annotate(
    msgs: DataFrame, intervals: DataFrame, keys: list[str], label: str = "incident_id",
    width: int | None = None, broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Add ``incidents``: sorted ids of the intervals in force at each message.

    ``intervals`` has keys, seg_from, seg_to (microseconds) and the label.
    """
    cut = elementary(intervals, keys, label, width)
    placed = locate(msgs, epoch_micros(F.col("ts")), cut, keys, width, "left", broadcast_rows)
    return placed.withColumnRenamed("labels", "incidents").drop("seg_from", "seg_to")


def setting_segments(changes: DataFrame, keys: list[str], width: int = DAY) -> DataFrame:
    """Changes (keys, at_micros, setting) as segments up to the next change.

    Of changes at one time the largest setting holds.
    """
    one = changes.groupBy(*keys, F.col("at_micros").alias("seg_from")).agg(
        F.max("setting").alias("setting")
    )
    return successor(one, keys, "seg_from", "seg_to", width)


def asof_setting(
    msgs: DataFrame, changes: DataFrame, keys: list[str], default, name: str = "setting",
    width: int | None = None, broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Add the latest setting changed at or before each message, else ``default``."""
    segments = setting_segments(changes, keys).withColumnRenamed(
        "setting", "_setting"
    )
    placed = locate(
        msgs, epoch_micros(F.col("ts")), segments, keys, width, "left", broadcast_rows, open_ended=True
    )
    return placed.withColumn(name, F.coalesce("_setting", F.lit(default))).drop(
        "seg_from", "seg_to", "_setting"
    )


def outside(
    msgs: DataFrame, pauses: DataFrame, keys: list[str], inside: bool = False,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Messages outside (or inside) every paused interval."""
    how = "left_semi" if inside else "left_anti"
    return locate(
        msgs, epoch_micros(F.col("ts")), covered(pauses, keys), keys, None, how, broadcast_rows
    )


def impact(
    processed: DataFrame, intervals: DataFrame, keys: list[str], margin_seconds: int,
    label: str = "incident_id", broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Messages and failures before, during and after each incident's intervals."""
    margin = margin_seconds * 1_000_000
    a, b = F.col("seg_from"), F.col("seg_to")
    phases = intervals.where(b > a).select(
        *keys, F.col(label).cast("string").alias(label),
        F.inline(F.array(
            F.struct(F.lit("before").alias("phase"), (a - margin).alias("seg_from"), a.alias("seg_to")),
            F.struct(F.lit("during").alias("phase"), a.alias("seg_from"), b.alias("seg_to")),
            F.struct(F.lit("after").alias("phase"), b.alias("seg_from"), (b + margin).alias("seg_to")),
        )),
    )
    counts = {
        "messages": F.lit(1).cast("bigint"), "failed": (F.col("failures") > 0).cast("bigint"),
    }
    found = count_between(
        processed, epoch_micros(F.col("ts")), phases, keys, counts, broadcast_rows
    )
    return found.groupBy("phase", label).agg(
        F.sum("messages").alias("messages"), F.sum("failed").alias("failed"),
        F.round(F.sum("messages") * F.lit(1e6) / F.sum(b - a), 6).alias("messages_per_second"),
    )
