"""Place every row in the one segment of a timeline that holds its position.

A segment is ``[seg_from, seg_to)`` in whole numbers (microseconds or row
positions); segments of one key do not overlap. Range joins without an equality
become nested loops in Spark, so both sides are cut into buckets and joined on
(keys, bucket). Buckets are as wide as the average segment: a segment then falls
into three of them on average, and a row meets about as many. Each row keeps at
most one segment, so the large side never multiplies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import explode_count, number_rows, running_total, running_totals, successor
from .sizing import BROADCAST_ROWS, join_side, settle


def locate(
    rows: DataFrame,
    position: Column,
    segments: DataFrame,
    keys: list[str],
    width: int | None = None,
    how: str = "left",
    broadcast_rows: int = BROADCAST_ROWS,
    open_ended: bool = False,
    settled: bool = False,
) -> DataFrame:
    """Join each row with its segment.

    ``segments`` has ``keys``, ``seg_from``, ``seg_to`` and payload columns.
    ``how`` is left, inner, left_semi or left_anti. With ``open_ended``, the
    last segment of a key may have a null ``seg_to`` and goes on for ever: one row of a
    key, looked up by the key alone. ``settled`` says that the segments are read from a stored table already.

    The segments are broadcast where they are proven few. Otherwise both sides
    are shuffled by (keys, bucket), and the adaptive planner splits the rows of
    a bucket that holds too many of them.
    """
    if open_ended:
        return _open_ended(rows, position, segments, keys, width, how, broadcast_rows, settled)
    placed = rows.withColumn("_pos", position.cast("bigint"))
    known, width, bound = _measured(segments, None if settled else "segments", width)
    first = F.floor(F.col("seg_from") / F.lit(width)).cast("bigint")
    last = F.floor((F.col("seg_to") - 1) / F.lit(width)).cast("bigint")
    cut = explode_count(known, last - first + 1, "_step")
    cut = cut.withColumn("_bucket", first + F.col("_step")).drop("_step")

    left = placed.withColumn("_bucket", F.floor(F.col("_pos") / F.lit(width)).cast("bigint")).alias("l")
    right = join_side(cut, known_rows=bound, limit=broadcast_rows).alias("r")
    cond = F.col("l._bucket") == F.col("r._bucket")
    for k in keys:
        cond = cond & (F.col(f"l.{k}") == F.col(f"r.{k}"))
    cond = cond & (F.col("l._pos") >= F.col("r.seg_from")) & (F.col("l._pos") < F.col("r.seg_to"))
    joined = left.join(right, cond, how)
    if how in ("left_semi", "left_anti"):
        return joined.drop("_pos", "_bucket")
    payload = [c for c in segments.columns if c not in keys]
    return joined.select(
        *[f"l.{c}" for c in rows.columns], *[f"r.{c}" for c in payload]
    )


def _open_ended(rows, position, segments, keys, width, how, broadcast_rows, settled) -> DataFrame:
    """``locate`` where the last segment of a key has no end."""
    known = segments if settled else settle(segments, "segments")
    closed = known.where(F.col("seg_to").isNotNull())
    if known.where(F.col("seg_to").isNull()).isEmpty():
        return locate(rows, position, closed, keys, width, how, broadcast_rows, settled=True)
    payload = [c for c in segments.columns if c not in keys]
    last = known.where(F.col("seg_to").isNull()).select(*keys, F.struct(*payload).alias("_last"))
    inside = closed.select(*keys, "seg_from", "seg_to", F.struct(*payload).alias("_inside"))
    placed = locate(rows.withColumn("_at", position.cast("bigint")), F.col("_at"), inside, keys, width, "left", broadcast_rows, settled=True)
    placed = placed.drop("seg_from", "seg_to").withColumn("_all", F.lit(0))
    joined = placed.join(join_side(last.withColumn("_all", F.lit(0)), limit=broadcast_rows), ["_all", *keys], "left")
    found = joined.withColumn("_found", F.coalesce("_inside", F.when(F.col("_at") >= F.col("_last.seg_from"), F.col("_last"))))
    if how in ("left_semi", "left_anti"):
        return found.where(F.col("_found").isNotNull() if how == "left_semi" else F.col("_found").isNull()).select(*rows.columns)
    found = found.where(F.col("_found").isNotNull()) if how == "inner" else found
    return found.select(*rows.columns, *[F.col(f"_found.{c}").alias(c) for c in payload])


def _measured(spans: DataFrame, label: str | None, width: int | None) -> tuple[DataFrame, int, int]:
    """Settle spans (given a label); choose a bucket width and bound the rows after cutting by it."""
    known = spans.where(F.col("seg_to") > F.col("seg_from"))
    known = settle(known, label) if label else known
    size = (F.col("seg_to") - F.col("seg_from")).cast("double")
    n, mean = known.agg(F.count(F.lit(1)), F.coalesce(F.avg(size), F.lit(1.0))).first()
    width = width or max(1, int(mean))
    return known, width, int(n * mean / width) + 2 * n


# Stretches of a piece, and pieces of a larger one, that intervals are cut into.
FAN = 64


def elementary(
    intervals: DataFrame, keys: list[str], label: str, width: int | None = None
) -> DataFrame:
    """Cut overlapping intervals into segments with the labels in force.

    Returns ``keys, seg_from, seg_to, labels`` (sorted array) for every stretch
    between two neighbouring ends in which at least one interval is open.
    ``intervals`` has ``keys, seg_from, seg_to`` and the ``label`` column, with
    ``seg_to`` set.

    Stretches are numbered, and every interval is laid out of single stretches,
    pieces of ``FAN`` of them and pieces of ``FAN`` pieces, so it makes some 250 rows at
    most besides its largest pieces, however many others are open. A stretch then
    holds the labels of itself and of the pieces it lies in.
    """
    real, width, _ = _measured(
        intervals.select(*keys, "seg_from", "seg_to", label), "intervals", width
    )
    block = width * 1_000
    marks = (
        real.select(*keys, F.explode(F.array("seg_from", "seg_to")).alias("seg_from"))
        .distinct()
    )
    cuts = settle(number_rows(successor(marks, keys, "seg_from", "seg_to", block), keys, "seg_from", "_no", block), "cuts")
    at = lambda end, name: cuts.select(*keys, F.col("seg_from").alias(end), F.col("_no").alias(name))
    laid = real.join(at("seg_from", "_a"), [*keys, "seg_from"]).join(at("seg_to", "_b"), [*keys, "seg_to"])
    held = _pieces(laid.select(*keys, label, "_a", "_b"), [*keys, label]).groupBy(*keys, "_level", "_piece").agg(
        F.collect_set(label).alias("_labels"))
    held = settle(held, "pieces")
    out, found = cuts.where(F.col("seg_to").isNotNull()), []
    for level in range(3):
        here = held.where(F.col("_level") == level).select(*keys, F.col("_piece").alias(f"_p{level}"), F.col("_labels").alias(f"_l{level}"))
        out = out.withColumn(f"_p{level}", F.floor(F.col("_no") / F.lit(FAN ** level)).cast("bigint")).join(here, [*keys, f"_p{level}"], "left")
        found.append(F.coalesce(F.col(f"_l{level}"), F.array().cast(held.schema["_labels"].dataType)))
    labels = F.array_sort(F.array_distinct(F.concat(*found))).alias("labels")
    return out.select(*keys, "seg_from", "seg_to", labels).where(F.size("labels") > 0)


def _pieces(laid: DataFrame, kept: list[str]) -> DataFrame:
    """(``kept``, _level, _piece): the fewest pieces that make up the stretches _a to _b - 1 of each row."""
    def run(low: Column, high: Column) -> Column:
        return F.when(low < high, F.sequence(low, high - 1)).otherwise(F.array().cast("array<bigint>"))

    parts, a, b = [], F.col("_a"), F.col("_b")
    for level in range(2):
        up, down = F.ceil(a / F.lit(FAN)).cast("bigint"), F.floor(b / F.lit(FAN)).cast("bigint")
        # Up to the first border and from the last one; all of it where no border lies between.
        ends = F.when(up > down, run(a, b)).otherwise(F.concat(run(a, up * FAN), run(down * FAN, b)))
        parts.append(F.transform(ends, lambda p: F.struct(F.lit(level).alias("_level"), p.alias("_piece"))))  # noqa: B023 - built at once
        a, b = up, down
    small = laid.select(*kept, F.inline(F.concat(*parts)))
    large = explode_count(laid.withColumn("_first", a).withColumn("_many", b - a), F.col("_many"), "_step")
    return small.unionByName(large.select(*kept, F.lit(2).alias("_level"), (F.col("_first") + F.col("_step")).alias("_piece")))


def covered(intervals: DataFrame, keys: list[str]) -> DataFrame:
    """Segments in which at least one interval is open, whatever their overlap.

    Openings count one up, closings one down; a running count over the distinct
    ends tells where any interval is open. The work grows with the number of
    ends, not with how many intervals overlap.
    """
    real, width, _ = _measured(intervals.select(*keys, "seg_from", "seg_to"), "intervals", None)
    ends = F.array(
        F.struct(F.col("seg_from").alias("at"), F.lit(1).cast("bigint").alias("step")),
        F.struct(F.col("seg_to").alias("at"), F.lit(-1).cast("bigint").alias("step")),
    )
    steps = real.select(*keys, F.inline(ends)).groupBy(*keys, F.col("at").alias("seg_from")).agg(
        F.sum("step").alias("_step")
    )
    block = width * 1_000
    counted = running_total(steps, keys, "seg_from", "_step", "_open", block)
    return (
        successor(counted, keys, "seg_from", "seg_to", block)
        .where(F.col("_open") > 0)
        .select(*keys, "seg_from", "seg_to")
    )


def count_between(
    rows: DataFrame, position: Column, spans: DataFrame, keys: list[str], counts: dict[str, Column],
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Add to every span (``keys``, ``seg_from``, ``seg_to``) sums over its rows.

    ``counts`` names whole-number columns to add up. Rows are counted once, per
    stretch between neighbouring ends of any spans; running sums at the two
    ends of a span then differ by what lies between them. Overlapping spans
    therefore cost nothing extra.
    """
    real, width, _ = _measured(spans, "spans", None)  # all span columns, as stored
    block = width * 1_000
    marks = real.select(*keys, F.explode(F.array("seg_from", "seg_to")).alias("seg_from")).distinct()
    cuts = settle(successor(marks, keys, "seg_from", "seg_to", block), "cuts")
    slim = rows.select(*keys, position.alias("_at"), *[c.alias(n) for n, c in counts.items()])
    inner = cuts.where(F.col("seg_to").isNotNull())
    placed = locate(slim, F.col("_at"), inner, keys, None, "inner", broadcast_rows, settled=True)
    sums = placed.groupBy(*keys, "seg_from").agg(*[F.sum(n).alias(n) for n in counts])
    at_marks = cuts.drop("seg_to").join(sums, [*keys, "seg_from"], "left").select(
        *keys, "seg_from", *[F.coalesce(n, F.lit(0)).alias(n) for n in counts]
    )
    # Totals of everything before a mark. Both ends of a span look theirs up in one join, so rows are read once, when the result is.
    upto = running_totals(at_marks, keys, "seg_from", {n: f"_{n}" for n in counts}, block)
    before = upto.select(*keys, F.col("seg_from").alias("_at"), *[(F.col(f"_{n}") - F.col(n)).alias(f"_{n}") for n in counts])
    alike = real.select(*spans.columns).groupBy(*spans.columns).agg(F.count(F.lit(1)).alias("_alike"))
    ends = alike.select("*", F.inline(F.array(
        F.struct(F.col("seg_from").alias("_at"), F.lit(-1).alias("_sign")), F.struct(F.col("seg_to").alias("_at"), F.lit(1).alias("_sign")))))
    both = ends.join(before, [*keys, "_at"]).groupBy(*spans.columns, "_alike").agg(
        *[F.sum(F.col("_sign") * F.col(f"_{n}")).alias(n) for n in counts])
    return explode_count(both, F.col("_alike"), "_copy").select(*spans.columns, *counts)
