"""Message values without a declared schema."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .draw import digest, pick, u
from .fields import timestamp_col

# Size arithmetic of padded messages.
PAD_RESERVE = 20


def _sizes(low: int, high: int) -> None:
    if low < 1 or high < low:
        raise ValueError("sizes must satisfy 1 <= min <= max")


def json_payload(
    seed: int, idx: Column, ts: Column | None, min_size: int = 200, max_size: int = 500,
    include_timestamp: bool = True, include_sequence: bool = True,
) -> Column:
    """JSON text padded towards a drawn size.

    Text uses ``", "`` and ``": "`` between parts. The padding leaves 20 bytes
    and its own wrapping takes 12, so a padded message ends 8 bytes below the
    drawn size; a message without room for padding stays as it is.
    """
    _sizes(min_size, max_size)
    number = (idx + 1).cast("string")
    parts = [F.lit('{"id": "msg-'), number, F.lit('"')]
    if include_timestamp:
        if ts is None:
            raise ValueError("include_timestamp needs an event time column")
        parts += [F.lit(', "timestamp": '), timestamp_col(ts).cast("string")]
    if include_sequence:
        parts += [F.lit(', "sequence": '), number]
    open_text = F.concat(*parts)
    room = pick(u(seed, "size", idx), min_size, max_size) - (F.length(open_text) + 1) - PAD_RESERVE
    padding = F.concat(F.lit(', "data": "'), F.repeat(F.lit("x"), room.cast("int")), F.lit('"'))
    return F.concat(open_text, F.when(room > 0, padding).otherwise(F.lit("")), F.lit("}"))


def random_payload(seed: int, idx: Column, min_size: int = 200, max_size: int = 500) -> Column:
    """Random bytes of a drawn size, 16 per md5."""
    _sizes(min_size, max_size)
    size = pick(u(seed, "bytes-size", idx), min_size, max_size)
    chunks = F.sequence(F.lit(0).cast("bigint"), F.floor((size - 1) / F.lit(16)))
    text = F.array_join(
        F.transform(chunks, lambda c: digest(seed, "bytes", idx, c.cast("string"))), ""
    )
    return F.unhex(F.substring(text, F.lit(1), (size * 2).cast("int")))


def fixed_payload(idx: Column, size: int) -> Column:
    """``msg-{n}-xxx`` of exactly ``size`` bytes, or the bare prefix if that is longer."""
    prefix = F.concat(F.lit("msg-"), (idx + 1).cast("string"), F.lit("-"))
    return F.concat(prefix, F.repeat(F.lit("x"), F.greatest(F.lit(0), F.lit(size) - F.length(prefix))))


def json_value(*columns) -> Column:
    """A row as compact JSON text; null fields are written as null."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
