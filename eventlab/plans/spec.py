"""Declared field schemas: the argument form of every generator and validator."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import types as T

# The declared types and the Spark type each one is held in.
SCALARS = {
    "string": T.StringType(),
    "int": T.LongType(),
    "float": T.DoubleType(),
    "boolean": T.BooleanType(),
    "uuid": T.StringType(),
    "timestamp": T.LongType(),
    "enum": T.StringType(),
    "faker": T.StringType(),
}
NESTED = ("object", "array")


@dataclass(frozen=True)
class Field:
    """One declared field. Defaults apply when a bound is left out (None).

    An object with an empty list of fields is a free map of text, which generators leave empty.
    """

    name: str
    type: str
    min: float | None = None
    max: float | None = None
    min_length: int | None = None
    max_length: int | None = None
    cardinality: int | None = None
    values: tuple[str, ...] | None = None
    fields: tuple[Field, ...] | None = None
    items: Field | None = None
    min_items: int = 1
    max_items: int = 5
    provider: str | None = None
    locale: str | None = None

    def __post_init__(self) -> None:
        where = f"field '{self.name}'"
        if self.type not in SCALARS and self.type not in NESTED:
            raise ValueError(f"{where}: unknown type '{self.type}'")
        if self.type == "enum" and not self.values:
            raise ValueError(f"{where}: enum needs values")
        if self.type == "object" and self.fields is None:
            raise ValueError(f"{where}: object needs fields")
        if self.type == "array" and self.items is None:
            raise ValueError(f"{where}: array needs items")
        if self.type == "faker" and not self.provider:
            raise ValueError(f"{where}: faker needs a provider")
        if self.cardinality is not None and self.cardinality < 1:
            raise ValueError(f"{where}: cardinality must be positive")
        for low, high, what in (
            (*self.lengths, "length"),
            (*self.range, "value"),
            (self.min_items, self.max_items, "items"),
        ):
            if low > high:
                raise ValueError(f"{where}: smallest {what} is above the largest")
        if self.lengths[0] < 0 or self.min_items < 0:
            raise ValueError(f"{where}: sizes cannot be negative")

    @property
    def lengths(self) -> tuple[int, int]:
        low = 5 if self.min_length is None else self.min_length
        high = 20 if self.max_length is None else self.max_length
        return low, high

    @property
    def range(self) -> tuple[float, float]:
        low = 0 if self.min is None else self.min
        high = 1000 if self.max is None else self.max
        return low, high

    @classmethod
    def of(cls, data: dict[str, Any]) -> Field:
        """Build from plain dicts and lists; unknown settings are rejected."""
        known = dict(data)
        if known.get("fields") is not None:
            known["fields"] = tuple(cls.of(f) for f in known["fields"])
        if known.get("items"):
            known["items"] = cls.of({"name": "item", **known["items"]})
        if known.get("values"):
            known["values"] = tuple(known["values"])
        try:
            return cls(**known)
        except TypeError as err:
            raise ValueError(f"field '{data.get('name')}': {err}") from None


def fields_of(data: list[dict[str, Any]]) -> list[Field]:
    names = [d.get("name") for d in data]
    if len(set(names)) != len(names):
        raise ValueError("field names must be unique")
    return [Field.of(d) for d in data]


def spark_type(field: Field) -> T.DataType:
    if field.type == "object":
        return spark_schema(field.fields) if field.fields else T.MapType(T.StringType(), T.StringType())
    if field.type == "array":
        return T.ArrayType(spark_type(field.items))
    return SCALARS[field.type]


def spark_schema(fields) -> T.StructType:
    """The StructType a list of declared fields describes."""
    return T.StructType([T.StructField(f.name, spark_type(f)) for f in fields])
