"""Repeatable random draws as plain column expressions.

A draw depends only on (seed, path, chunk, row_index): a retried or re-planned
task gives the same rows, and the layout of partitions does not matter. One md5
has room for two 52-bit draws, so draw ``k`` uses half ``k % 2`` of chunk
``k // 2``.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

UNIT_52 = 2.0**-52


def _text(part: Column | str | int) -> Column:
    return part if isinstance(part, Column) else F.lit(str(part))


def digest(seed: int, path: Column | str, idx: Column, chunk: Column | int = 0) -> Column:
    """md5 text of one chunk."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), _text(path), _text(chunk), idx.cast("string")))


def bits(hexes: Column, start: int, digits: int) -> Column:
    """``digits`` hex characters from ``start`` (1-based) as a BIGINT.

    Text from md5 always converts; saying so with coalesce keeps the planner
    from adding null checks that would hash every row a second time.
    """
    number = F.conv(F.substring(hexes, start, digits), 16, 10).cast("bigint")
    return F.coalesce(number, F.lit(0).cast("bigint"))


def draw_from(hexes: Column, half: int = 0) -> Column:
    """One of the two uniform draws in [0, 1) an md5 text holds."""
    # Multiplying is exact here and, unlike dividing, never null for the planner.
    return bits(hexes, 1 + 13 * half, 13) * F.lit(UNIT_52)


def u(seed: int, path: Column | str, idx: Column, k: int = 0) -> Column:
    """Uniform draw in [0, 1)."""
    return draw_from(digest(seed, path, idx, k // 2), k % 2)


def pick(draw: Column, low: int, high: int) -> Column:
    """Whole number in [low, high] from a uniform draw."""
    return (F.lit(low).cast("bigint") + F.floor(draw * F.lit(float(high - low + 1)))).cast("bigint")


def constant(seed: int, path: str, name: str) -> int:
    """A 60-bit number fixed by (seed, path, name), for plan-time parameters."""
    return int(hashlib.md5(f"{seed}|{path}|{name}".encode()).hexdigest()[:15], 16)
