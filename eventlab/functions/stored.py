"""Schemas kept as text: Avro records and Protobuf messages read into one tree, and out as Spark types or declared fields."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from typing import Any

from pyspark.sql import types as T

from ..plans.spec import Field

# What each scalar of the two languages holds, as a Spark type and as a declared type.
AVRO_SCALARS = {
    "string": ("string", "string"), "int": ("int", "int"), "long": ("bigint", "int"), "float": ("float", "float"),
    "double": ("double", "float"), "boolean": ("boolean", "boolean"), "bytes": ("binary", "string"), "null": ("void", "string"),
}
AVRO_LOGICAL = {
    "uuid": ("string", "uuid"), "date": ("date", "int"), "time-millis": ("int", "int"), "time-micros": ("bigint", "int"),
    "timestamp-millis": ("timestamp", "timestamp"), "timestamp-micros": ("timestamp", "timestamp"),
}
PROTO_SCALARS = {
    "string": ("string", "string"), "bytes": ("binary", "string"), "bool": ("boolean", "boolean"),
    "double": ("double", "float"), "float": ("float", "float"),
    "int32": ("int", "int"), "sint32": ("int", "int"), "sfixed32": ("int", "int"), "uint32": ("bigint", "int"), "fixed32": ("bigint", "int"),
    "int64": ("bigint", "int"), "sint64": ("bigint", "int"), "sfixed64": ("bigint", "int"),
    "uint64": ("decimal(20,0)", "int"), "fixed64": ("decimal(20,0)", "int"),
}
PROTO_KNOWN = {"google.protobuf.Timestamp": ("timestamp", "timestamp"), "google.protobuf.Duration": ("interval day to second", "int")}


@dataclass(frozen=True)
class Shape:
    """A type of either language. ``kind``: scalar, enum, record, list or map."""

    kind: str
    spark: str = "string"
    declared: str = "string"
    symbols: tuple[str, ...] = ()
    members: tuple[tuple[str, Shape, bool], ...] = ()  # name, shape, may be null
    item: Shape | None = None
    item_null: bool = False


def spark_of(shape: Shape) -> T.DataType:
    if shape.kind == "record":
        return T.StructType([T.StructField(n, spark_of(s), null) for n, s, null in shape.members])
    if shape.kind == "list":
        return T.ArrayType(spark_of(shape.item), shape.item_null)
    if shape.kind == "map":
        return T.MapType(T.StringType(), spark_of(shape.item), shape.item_null)
    return T.StringType() if shape.kind == "enum" else T.NullType() if shape.spark == "void" else T.DataType.fromDDL(shape.spark)


def field_of(name: str, shape: Shape) -> Field:
    """A declared field that generates values of the shape; maps become free objects, which stay empty."""
    if shape.kind == "record":
        return Field(name, "object", fields=tuple(fields_of_record(shape)))
    if shape.kind == "list":
        return Field(name, "array", items=field_of("item", shape.item))
    if shape.kind == "map":
        return Field(name, "object", fields=())
    if shape.kind == "enum":
        return Field(name, "enum", values=shape.symbols) if shape.symbols else Field(name, "string")
    return Field(name, shape.declared)


def fields_of_record(shape: Shape) -> list[Field]:
    """Fields of a record; those that can only be null are left out."""
    return [field_of(n, s) for n, s, _ in shape.members if s.spark != "void"]


# --- Avro --------------------------------------------------------------------


class _Avro:
    """Reads Avro JSON; named types are known by full name from where they are defined on."""

    def __init__(self):
        self.named: dict[str, Shape] = {}

    def read(self, kind: Any, space: str = "") -> tuple[Shape, bool]:
        """(shape, may be null); of a union the first branch that is not null counts."""
        if isinstance(kind, list):
            some = [k for k in kind if k != "null"]
            return (self.read(some[0], space)[0], len(some) < len(kind)) if some else (Shape("scalar", *AVRO_SCALARS["null"]), True)
        if isinstance(kind, str):
            for full in (kind, f"{space}.{kind}"):
                if full in self.named:
                    return self.named[full], False
            if kind not in AVRO_SCALARS:
                raise ValueError(f"unknown Avro type '{kind}'")
            return Shape("scalar", *AVRO_SCALARS[kind]), kind == "null"
        base, logical = kind["type"], kind.get("logicalType")
        if logical == "decimal":
            return Shape("scalar", f"decimal({kind['precision']},{kind.get('scale', 0)})", "float"), False
        if logical in AVRO_LOGICAL:
            return Shape("scalar", *AVRO_LOGICAL[logical]), False
        if base in ("array", "map"):
            item, null = self.read(kind["items" if base == "array" else "values"], space)
            return Shape("list" if base == "array" else "map", item=item, item_null=null), False
        if base not in ("record", "enum", "fixed"):
            return self.read(base, space)
        full = kind["name"]
        if "." not in full and kind.get("namespace", space):
            full = f"{kind.get('namespace', space)}.{full}"
        inner = full.rpartition(".")[0]
        if base == "record":
            members = tuple((f["name"], *self.read(f["type"], inner)) for f in kind.get("fields", ()))
            made = Shape("record", members=members)
        elif base == "enum":
            made = Shape("enum", symbols=tuple(kind.get("symbols", ())))
        else:
            made = Shape("scalar", *AVRO_SCALARS["bytes"])
        self.named[full] = made
        return made, False


def avro_record(text: str | dict) -> Shape:
    """The record of an Avro schema; anything else raises."""
    top = json.loads(text) if isinstance(text, str) else text
    if not isinstance(top, dict) or top.get("type") != "record":
        raise ValueError(f"expected an Avro record, got {top.get('type') if isinstance(top, dict) else type(top).__name__}")
    return _Avro().read(top)[0]


# --- Protobuf ----------------------------------------------------------------

_WORDS = re.compile(r"""//[^\n]*|/\*.*?\*/|"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*'|[.\w-]+|[^\s\w]""", re.S)


class _Proto:
    """Reads .proto text: messages at any depth, enums, oneofs, maps; names are looked up from the inside out."""

    def __init__(self, text: str):
        self.words = [w for w in _WORDS.findall(text) if not w.startswith(("//", "/*"))]
        self.at = 0
        self.package = ""
        self.bodies: dict[str, list] = {}  # message -> (name, type, label, of a map: value type)
        self.enums: dict[str, tuple[str, ...]] = {}
        self.first = ""
        while self.at < len(self.words):
            self.statement("")

    def next(self) -> str:
        if self.at >= len(self.words):
            raise ValueError("the Protobuf text ends too soon")
        self.at += 1
        return self.words[self.at - 1]

    def skip(self) -> None:
        """To the end of a statement: a semicolon, or a body in braces."""
        depth = 0
        while self.at < len(self.words):
            word = self.next()
            depth += (word in "{[(") - (word in "}])") if len(word) == 1 else 0
            if depth <= 0 and word in (";", "}"):
                return

    def statement(self, scope: str) -> None:
        word = self.next()
        if word == ";":
            return
        if word == "message":
            name = f"{scope}.{self.next()}".lstrip(".")
            self.first = self.first or name
            self.bodies[name] = []
            self.body(name, name)
        elif word == "enum":
            self.enum(f"{scope}.{self.next()}".lstrip("."))
        elif word == "oneof" and scope:
            self.next()
            self.body(scope, scope)
        elif word == "package" and not scope:
            self.package = self.next()
            self.skip()
        elif word in ("syntax", "edition", "import", "option", "extend", "service", "reserved", "extensions") or not scope:
            self.skip()
        else:
            self.field(scope, word)

    def body(self, scope: str, of: str) -> None:
        if self.next() != "{":
            raise ValueError(f"expected a body of '{of}'")
        while self.words[self.at:self.at + 1] != ["}"]:
            if self.at >= len(self.words):
                raise ValueError(f"the body of '{of}' has no end")
            self.statement(scope)
        self.at += 1

    def enum(self, name: str) -> None:
        self.next()
        symbols = []
        while (word := self.next()) != "}":
            if word not in ("option", "reserved", ";") and self.words[self.at:self.at + 1] == ["="]:
                symbols.append(word)
            if word != ";":
                self.skip()
        self.enums[name] = tuple(symbols)

    def field(self, scope: str, word: str) -> None:
        label = ""
        if word in ("repeated", "optional", "required"):
            label, word = word, self.next()
        value = None
        if word == "map" and self.words[self.at] == "<":
            self.at += 1
            self.next(), self.next()  # the key's type and a comma
            value = self.next()
            self.next()
        name = self.next()
        self.bodies[scope].append((name, word, label, value))
        self.skip()

    def shape(self, kind: str, scope: str, open_: tuple[str, ...]) -> Shape:
        if kind in PROTO_SCALARS:
            return Shape("scalar", *PROTO_SCALARS[kind])
        name = kind.lstrip(".")
        if name in PROTO_KNOWN:
            return Shape("scalar", *PROTO_KNOWN[name])
        if self.package and name.startswith(self.package + "."):
            name = name[len(self.package) + 1:]
        place = scope.split(".") if scope else []
        for depth in range(len(place), -1, -1):
            full = ".".join([*place[:depth], name])
            if full in self.enums:
                return Shape("enum", symbols=self.enums[full])
            if full in self.bodies:
                return self.message(full, open_)
        raise ValueError(f"unknown Protobuf type '{kind}' in '{scope}'")

    def message(self, name: str, open_: tuple[str, ...] = ()) -> Shape:
        if name in open_:
            raise ValueError(f"message '{name}' holds itself")
        members = []
        for field, kind, label, value in self.bodies[name]:
            if value is not None:
                made = Shape("map", item=self.shape(value, name, (*open_, name)), item_null=True)
            else:
                made = self.shape(kind, name, (*open_, name))
                if label == "repeated":
                    made = Shape("list", item=made, item_null=True)
            members.append((field, made, True))
        return Shape("record", members=tuple(members))


def proto_message(text: str, name: str | None = None) -> Shape:
    """The named message of a .proto text, or its first one; without a message, an empty record."""
    read = _Proto(text)
    if name is not None and name not in read.bodies:
        raise ValueError(f"no message '{name}'")
    return read.message(name or read.first) if read.first else Shape("record")
