"""Synthetic field values as column expressions (no Python runs per row).

Every builder takes ``seed``, a ``path`` that names the field, and ``idx``, the
row index. Inside arrays the element number is part of the path, so elements
are drawn independently.
"""

from __future__ import annotations

from collections.abc import Callable
from math import gcd
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.spec import Field
from .draw import constant, digest, pick, u

# Digits of base 26 as conv() prints them, and the letters they stand for.
BASE26 = "0123456789ABCDEFGHIJKLMNOP"
LETTERS = "abcdefghijklmnopqrstuvwxyz"
HEX_DIGITS = "0123456789abcdef"
VARIANT_DIGITS = "89ab89ab89ab89ab"

UNROLLED_CHUNKS = 8


def _letters(number: Column, base: int, width: int) -> Column:
    """The last ``width`` base-26 digits of a number, as letters."""
    digits = F.lpad(F.conv(number, base, 26), 13, "0")
    return F.translate(F.substring(digits, 14 - width, width), BASE26, LETTERS)


def _ten_letters(hexes: Column, start: int) -> Column:
    """Ten letters from the 60 bits at ``start``."""
    return _letters(F.substring(hexes, start, 15), 16, 10)


def _letter_run(seed: int, path, idx: Column, max_length: int) -> Column:
    """At least ``max_length`` letters: 10 from chunk 0, 20 from each later chunk."""
    head = _ten_letters(digest(seed, path, idx, 0), 14)
    more = max(0, -(-(max_length - 10) // 20))

    def block(chunk) -> Column:
        hexes = digest(seed, path, idx, chunk)
        return F.concat(_ten_letters(hexes, 1), _ten_letters(hexes, 16))

    if more == 0:
        return head
    if more <= UNROLLED_CHUNKS:
        return F.concat(head, *[block(c) for c in range(1, more + 1)])
    chunks = F.sequence(F.lit(1), F.lit(more))
    return F.concat(head, F.array_join(F.transform(chunks, lambda c: block(c.cast("string"))), ""))


def string_col(
    seed: int, path, idx: Column, min_length: int = 5, max_length: int = 20,
    cardinality: int | None = None, position: Column | None = None,
) -> Column:
    """Lowercase letters; with a cardinality, one value of a fixed pool of C.

    ``position`` picks the value of the pool; it is ``row_index mod C`` by
    default, so the pool repeats in order.
    """
    if cardinality is None:
        length = pick(u(seed, path, idx), min_length, max_length).cast("int")
        return F.substring(_letter_run(seed, path, idx, max_length), F.lit(1), length)
    width = suffix_width(cardinality)
    if width > max_length:
        raise ValueError(f"{cardinality} distinct strings do not fit in {max_length} letters")
    at = _cycle(idx, cardinality) if position is None else position
    # The pool position, written in base 26, ends each value and makes it distinct.
    low = max(min_length, width)
    length = pick(u(seed, path, at), low, max_length).cast("int")
    head = F.substring(_letter_run(seed, path, at, max_length), F.lit(1), length - width)
    return F.concat(head, _letters(at.cast("string"), 10, width))


def _cycle(idx: Column, cardinality: int) -> Column:
    return F.pmod(idx, F.lit(cardinality).cast("bigint"))


def suffix_width(cardinality: int) -> int:
    width = 1
    while 26**width < cardinality:
        width += 1
    return width


def int_col(
    seed: int, path, idx: Column, low: int = 0, high: int = 1000, cardinality: int | None = None,
    position: Column | None = None,
) -> Column:
    """Whole number, both ends included; with a cardinality, one of a pool as in string_col."""
    if cardinality is None:
        return pick(u(seed, path, idx), low, high)
    step, shift = spread_params(seed, path, low, high, cardinality)
    at = _cycle(idx, cardinality) if position is None else position
    return F.lit(low).cast("bigint") + F.pmod(
        at * F.lit(step).cast("bigint") + F.lit(shift).cast("bigint"),
        F.lit(high - low + 1).cast("bigint"),
    )


def spread_params(seed: int, path: str, low: int, high: int, cardinality: int) -> tuple[int, int]:
    """Step and shift of the map position -> (step * position + shift) mod range.

    The step has no common factor with the range, so distinct positions below
    the range give distinct values.
    """
    size = high - low + 1
    if cardinality > size:
        raise ValueError(f"{cardinality} distinct values do not fit in [{low}, {high}]")
    room = (1 << 62) // cardinality
    step = 1 + constant(seed, path, "step") % min(size, room)
    while gcd(step, size) != 1:
        step = step + 1 if step < min(size, room) else 1
    return step, constant(seed, path, "shift") % size


def float_col(seed: int, path, idx: Column, low: float = 0.0, high: float = 1000.0) -> Column:
    """Number with two decimals."""
    return F.round(F.lit(float(low)) + u(seed, path, idx) * F.lit(float(high - low)), 2)


def boolean_col(seed: int, path, idx: Column) -> Column:
    return u(seed, path, idx) < F.lit(0.5)


def uuid_col(seed: int, path, idx: Column) -> Column:
    """Version-4 uuid text."""
    h = digest(seed, path, idx)
    variant = F.translate(F.substring(h, 17, 1), HEX_DIGITS, VARIANT_DIGITS)
    return F.concat(
        F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-4"),
        F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"),
        F.substring(h, 21, 12),
    )


def timestamp_col(ts: Column) -> Column:
    """Event time as whole milliseconds since 1970."""
    return F.floor(epoch_micros(ts) / F.lit(1000)).cast("bigint")


def epoch_micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp with or without zone (session zone UTC)."""
    return F.unix_micros(ts.cast("timestamp"))


def enum_col(seed: int, path, idx: Column, values) -> Column:
    """One of ``values``; a value listed twice is drawn twice as often."""
    pool = F.array(*[F.lit(v) for v in values])
    return F.element_at(pool, pick(u(seed, path, idx), 1, len(values)).cast("int"))


class Context(NamedTuple):
    """What a field needs besides its draws.

    ``ts`` is the event time, ``lookup`` gives the column of a lookup field, and
    ``pool`` is the path of the enclosing array items without element numbers.
    """

    ts: Column | None = None
    lookup: Callable[[Field, Column | str], Column] | None = None
    pool: str | None = None


def object_col(seed: int, path, idx: Column, fields, context: Context = Context()) -> Column:
    if not fields:
        return F.create_map().cast("map<string,string>")
    return F.struct(*[
        field_col(f, seed, _below(path, "." + f.name), idx, _inside(context, "." + f.name)).alias(f.name)
        for f in fields
    ])


def array_col(
    seed: int, path, idx: Column, items: Field, min_items: int = 1, max_items: int = 5,
    context: Context = Context(),
) -> Column:
    """Array of drawn size; ``sequence(0, -1)`` runs backwards, so size 0 is its own case."""
    size = pick(u(seed, path, idx), min_items, max_items)
    if context.pool is None:
        context = context._replace(pool=path)
    below = _inside(context, "[]")
    # ``path`` may itself hold an element number when arrays are nested.
    filled = F.transform(
        F.sequence(F.lit(0).cast("bigint"), size - 1),
        lambda j: field_col(items, seed, _below(path, "[", j.cast("string"), "]"), idx, below),
    )
    if min_items > 0:
        return filled
    return F.when(size > 0, filled).otherwise(F.slice(filled, 1, 0))


def _inside(context: Context, part: str) -> Context:
    return context if context.pool is None else context._replace(pool=context.pool + part)


def _below(path, *parts) -> Column | str:
    if isinstance(path, str) and all(isinstance(p, str) for p in parts):
        return path + "".join(parts)
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in (path, *parts)])


def field_col(field: Field, seed: int, path, idx: Column, context: Context = Context()) -> Column:
    """The column of one declared field."""
    if field.type in ("string", "int"):
        return _pooled(field, seed, path, idx, context)
    if field.type == "float":
        return float_col(seed, path, idx, *field.range)
    if field.type == "boolean":
        return boolean_col(seed, path, idx)
    if field.type == "uuid":
        return uuid_col(seed, path, idx)
    if field.type == "timestamp":
        if context.ts is None:
            raise ValueError(f"field '{field.name}' needs an event time column")
        return timestamp_col(context.ts)
    if field.type == "enum":
        return enum_col(seed, path, idx, field.values)
    if field.type == "object":
        return object_col(seed, path, idx, field.fields, context)
    if field.type == "array":
        return array_col(seed, path, idx, field.items, field.min_items, field.max_items, context)
    if context.lookup is None:
        raise ValueError(f"field '{field.name}' needs a table of lookup values")
    return context.lookup(field, path)


def _pooled(field: Field, seed: int, path, idx: Column, context: Context) -> Column:
    make = string_col if field.type == "string" else int_col
    low, high = field.lengths if field.type == "string" else (int(x) for x in field.range)
    size, position = field.cardinality, None
    if size is not None and context.pool is not None:
        # All elements share one pool and draw their place in it.
        position = pick(u(seed, path, idx), 0, size - 1)
        path = context.pool
    return make(seed, path, idx, low, high, size, position)
