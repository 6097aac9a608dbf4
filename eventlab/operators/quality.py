"""Record checks against declared fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.spec import Field

# Shape of a version-4 uuid.
UUID_SHAPE = "^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"


def _violation(bad: Column, path: Column | str, message: str, severity: str = "error") -> Column:
    where = path if isinstance(path, Column) else F.lit(path)
    return F.when(
        bad,
        F.struct(where.alias("path"), F.lit(message).alias("message"), F.lit(severity).alias("severity")),
    )


def _rules(field: Field, value: Column, path) -> list[Column]:
    """Violations of one scalar value; each is null where the rule holds."""
    if field.type == "string":
        low, high = field.lengths
        return [
            _violation(F.length(value) < low, path, "shorter than min_length"),
            _violation(F.length(value) > high, path, "longer than max_length"),
        ]
    if field.type in ("int", "float"):
        low, high = field.range
        return [
            _violation(value < low, path, "below min"),
            _violation(value > high, path, "above max"),
        ]
    if field.type == "enum":
        return [_violation(~value.isin(*field.values), path, "not an enum value")]
    if field.type == "uuid":
        return [_violation(~value.rlike(UUID_SHAPE), path, "not a uuid")]
    if field.type == "timestamp":
        return [_violation(value < 0, path, "before 1970", "warning")]
    return []


def _joined(path: Column | str, *parts: Column | str) -> Column | str:
    if all(isinstance(p, str) for p in (path, *parts)):
        return "".join((path, *parts))
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in (path, *parts)])


def _checks(field: Field, value: Column, path: Column | str) -> Column:
    """Array of violations of a field and everything below it, at any depth; ``path`` is a column inside array items."""
    missing = _violation(value.isNull(), path, "missing")
    if field.type == "object":
        parts = [F.array(missing)]
        for f in field.fields:
            below = _checks(f, value[f.name], _joined(path, f".{f.name}"))
            parts.append(F.when(value.isNotNull(), below).otherwise(F.slice(below, 1, 0)))
        return F.concat(*parts)
    if field.type == "array":
        size = F.size(value)
        own = F.array(
            missing,
            _violation(size.between(0, field.min_items - 1), path, "fewer than min_items"),
            _violation(size > field.max_items, path, "more than max_items"),
        )

        def each(x: Column, i: Column) -> Column:
            return _checks(field.items, x, _joined(path, "[", i.cast("string"), "]"))

        return F.concat(own, F.coalesce(F.flatten(F.transform(value, each)), F.slice(own, 1, 0)))
    return F.array(missing, *_rules(field, value, path))


def violations(df: DataFrame, fields: list[Field], keys: list[str]) -> DataFrame:
    """One row per broken rule: keys, path, message, severity.

    Map-only: the checks are one array expression per row, exploded.
    """
    found = F.array_compact(F.concat(*[_checks(f, F.col(f.name), f.name) for f in fields]))
    return df.select(*keys, F.inline(found))


def violation_summary(found: DataFrame) -> DataFrame:
    """Violations per path and severity; a path with errors is not valid."""
    return found.groupBy("path", "severity").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "valid", F.col("severity") != "error"
    )
