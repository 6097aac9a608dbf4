"""Encoding and decoding of message values: JSON, Avro and Protobuf columns."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.spec import Field, spark_schema
from .stored import avro_record, fields_of_record, proto_message, spark_of

NAMESPACE = "eventlab.generated"

# --- JSON --------------------------------------------------------------------


def parse_json(
    msgs: DataFrame, fields: list[Field], value: str = "value", corrupt: str = "_corrupt_record"
) -> DataFrame:
    """Add ``parsed`` (declared struct) and the text of values that do not parse."""
    schema = spark_schema(fields).add(corrupt, T.StringType())
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": corrupt}
    read = F.from_json(F.col(value).cast("string"), schema, options)
    return (
        msgs.withColumn("parsed", read)
        .withColumn(corrupt, F.col(f"parsed.{corrupt}"))
        .withColumn("parsed", F.col("parsed").dropFields(corrupt))
    )


# --- names of the types that a schema needs ------------------------------------


class _Names:
    """Names for the types of a schema: from the whole path of the field, and none twice."""

    def __init__(self):
        self.taken: set[str] = set()

    def of(self, path: tuple[str, ...], what: str) -> str:
        words = re.findall(r"[A-Za-z0-9]+", " ".join(path))
        stem = "".join(w[0].upper() + w[1:] for w in words)
        stem = stem if stem[:1].isalpha() else f"T{stem}"
        name, n = stem + what, 1
        while name in self.taken:
            n += 1
            name = f"{stem}{what}{n}"
        self.taken.add(name)
        return name


# A name as Avro and Protobuf both allow it.
_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


def _checked(name: str) -> str:
    if not _NAME.fullmatch(name):
        raise ValueError(f"'{name}' is no name that a schema can hold")
    return name


def _symbols(field: Field) -> list[str]:
    """The values of an enum field if a schema can hold them as symbols, else none (it is text then)."""
    values = list(dict.fromkeys(field.values or ()))
    return values if all(_NAME.fullmatch(v) for v in values) else []


# --- Avro --------------------------------------------------------------------

# Avro type of each declared scalar type.
AVRO_TYPES = {
    "string": {"type": "string"},
    "int": {"type": "long"},
    "float": {"type": "double"},
    "boolean": {"type": "boolean"},
    "faker": {"type": "string"},
    "uuid": {"type": "string", "logicalType": "uuid"},
    "timestamp": {"type": "long", "logicalType": "timestamp-millis"},
}


def avro_schema(fields: list[Field], name: str) -> str:
    """Avro record schema (JSON text) of declared fields.

    Types are named by the whole path of their field. Enums with values that are no
    symbols are text; objects without declared fields are maps of text.
    """
    names = _Names()
    names.taken.add(_checked(name))

    def record(of: str, members, path: tuple[str, ...]) -> dict:
        return {"type": "record", "name": of, "fields": [{"name": _checked(f.name), "type": kind(f, (*path, f.name))} for f in members]}

    def kind(field: Field, path: tuple[str, ...]) -> dict:
        if field.type == "array":
            return {"type": "array", "items": kind(field.items, path)}
        if field.type == "object" and not field.fields:
            return {"type": "map", "values": "string"}
        if field.type == "object":
            return record(names.of(path, "Record"), field.fields, path)
        if field.type == "enum" and _symbols(field):
            return {"type": "enum", "name": names.of(path, "Enum"), "symbols": _symbols(field)}
        return dict(AVRO_TYPES[field.type if field.type != "enum" else "string"])

    return json.dumps({"namespace": NAMESPACE, **record(name, fields, ())})


def _avro_ready(field: Field, value: Column) -> Column:
    """timestamp-millis columns are written from TIMESTAMP, not from BIGINT."""
    if field.type == "timestamp":
        return F.timestamp_millis(value)
    if field.type == "object" and field.fields:
        return F.struct(*[_avro_ready(f, value[f.name]).alias(f.name) for f in field.fields])
    if field.type == "array":
        return F.transform(value, lambda x: _avro_ready(field.items, x))
    return value


def to_avro_value(fields: list[Field], name: str, columns: dict[str, Column] | None = None) -> Column:
    """Avro bytes of the declared columns (needs Spark's Avro module)."""
    from pyspark.sql.avro.functions import to_avro

    source = columns or {f.name: F.col(f.name) for f in fields}
    row = F.struct(*[_avro_ready(f, source[f.name]).alias(f.name) for f in fields])
    return to_avro(row, avro_schema(fields, name))


def from_avro_value(value: Column | str, fields: list[Field], name: str) -> Column:
    """Struct decoded from Avro bytes (needs Spark's Avro module)."""
    from pyspark.sql.avro.functions import from_avro

    return from_avro(value, avro_schema(fields, name))


def schema_from_avro(text: str | dict) -> T.StructType:
    """StructType of a stored Avro record schema."""
    return spark_of(avro_record(text))


def fields_from_avro(text: str | dict) -> list[Field]:
    """Declared fields that generate records of a stored Avro schema; fields that can only be null are left out."""
    return fields_of_record(avro_record(text))


# --- Protobuf ----------------------------------------------------------------

# Protobuf type (by its descriptor name) of each declared scalar type.
PROTO_TYPES = {
    "string": "TYPE_STRING",
    "int": "TYPE_INT64",
    "float": "TYPE_DOUBLE",
    "boolean": "TYPE_BOOL",
    "uuid": "TYPE_STRING",
    "timestamp": "TYPE_INT64",
    "faker": "TYPE_STRING",
}


def schema_from_proto(text: str, message: str | None = None) -> T.StructType:
    """StructType of a message in a .proto text (the first, unless named); text without one gives an empty struct."""
    return spark_of(proto_message(text, message))


def fields_from_proto(text: str, message: str | None = None) -> list[Field]:
    """Declared fields that generate a message of a .proto text."""
    return fields_of_record(proto_message(text, message))


def proto_layout(fields: list[Field], name: str) -> dict:
    """What a descriptor of declared fields holds, as plain dicts: name, fields, messages and enums inside.

    Protobuf's enum values share the names around them, so an enum with a value that is taken
    stands in a message of its own. Enums whose values are no names are text; objects without declared
    fields are maps of text. An array of arrays has no Protobuf type and raises.
    """
    names = _Names()

    def message(of: str, members, path: tuple[str, ...]) -> dict:
        out: dict = {"name": of, "fields": [], "messages": [], "enums": []}
        taken = {f.name for f in members}
        for number, f in enumerate(members, 1):
            below = (*path, f.name)
            many, shape = f.type == "array", f.items if f.type == "array" else f
            if shape.type == "array":
                raise ValueError(f"field '{'.'.join(below)}': Protobuf has no arrays of arrays")
            slot = {"name": _checked(f.name), "number": number, "many": many}
            if shape.type == "enum" and _symbols(shape):
                enum = {"name": names.of(below, "Enum"), "values": _symbols(shape)}
                slot |= {"type": "TYPE_ENUM", "of": enum["name"]}
                if taken.isdisjoint(enum["values"]):
                    taken |= set(enum["values"])
                    out["enums"].append(enum)
                else:
                    scope = names.of(below, "Scope")
                    out["messages"].append({"name": scope, "fields": [], "messages": [], "enums": [enum]})
                    slot["of"] = f"{scope}.{enum['name']}"
            elif shape.type == "object":
                entry = not shape.fields
                if entry and many:
                    raise ValueError(f"field '{'.'.join(below)}': Protobuf has no arrays of maps")
                # A map is a repeated message of this very name with a key and a value.
                if entry:
                    inner = "".join(w[:1].upper() + w[1:] for w in f.name.split("_")) + "Entry"
                    text = [{"name": n, "number": k, "many": False, "type": "TYPE_STRING"} for k, n in enumerate(("key", "value"), 1)]
                    out["messages"].append({"name": inner, "fields": text, "messages": [], "enums": [], "map_entry": True})
                else:
                    inner = names.of(below, "Message")
                    out["messages"].append(message(inner, shape.fields, below))
                slot |= {"type": "TYPE_MESSAGE", "of": inner, "many": many or entry}
            else:
                slot["type"] = PROTO_TYPES[shape.type if shape.type != "enum" else "string"]
            out["fields"].append(slot)
        return out

    return message(_checked(name), fields, ())


def proto_descriptor(fields: list[Field], name: str) -> bytes:
    """Serialized FileDescriptorSet of declared fields (needs the protobuf package)."""
    from google.protobuf import descriptor_pb2 as pb

    def write(plan: dict, into, scope: str) -> None:
        into.name = plan["name"]
        here = f"{scope}.{plan['name']}"
        into.options.map_entry = plan.get("map_entry", False)
        for slot in plan["fields"]:
            kinds = pb.FieldDescriptorProto
            made = into.field.add(name=slot["name"], number=slot["number"], type=getattr(kinds, slot["type"]))
            made.label = kinds.LABEL_REPEATED if slot["many"] else kinds.LABEL_OPTIONAL
            if "of" in slot:
                made.type_name = f"{here}.{slot['of']}"
        for inner in plan["messages"]:
            write(inner, into.nested_type.add(), here)
        for enum in plan["enums"]:
            values = into.enum_type.add(name=enum["name"])
            for number, symbol in enumerate(enum["values"]):
                values.value.add(name=symbol, number=number)

    file = pb.FileDescriptorProto(name=f"{name.lower()}.proto", package=NAMESPACE, syntax="proto3")
    write(proto_layout(fields, name), file.message_type.add(), f".{NAMESPACE}")
    return pb.FileDescriptorSet(file=[file]).SerializeToString()


def _proto_ready(field: Field, value: Column) -> Column:
    """Enum text outside the declared values becomes the first value (number 0)."""
    if field.type == "enum":
        return F.when(value.isin(*field.values), value).otherwise(F.lit(field.values[0]))
    if field.type == "object" and field.fields:
        return F.struct(*[_proto_ready(f, value[f.name]).alias(f.name) for f in field.fields])
    if field.type == "array":
        return F.transform(value, lambda x: _proto_ready(field.items, x))
    return value


def to_proto_value(fields: list[Field], name: str) -> Column:
    """Protobuf bytes of the declared columns (needs Spark's Protobuf module)."""
    from pyspark.sql.protobuf.functions import to_protobuf

    row = F.struct(*[_proto_ready(f, F.col(f.name)).alias(f.name) for f in fields])
    return to_protobuf(
        row, f"{NAMESPACE}.{name}", binaryDescriptorSet=proto_descriptor(fields, name)
    )


def from_proto_value(value: Column | str, fields: list[Field], name: str) -> Column:
    """Struct decoded from Protobuf bytes (needs Spark's Protobuf module)."""
    from pyspark.sql.protobuf.functions import from_protobuf

    return from_protobuf(
        value, f"{NAMESPACE}.{name}", binaryDescriptorSet=proto_descriptor(fields, name)
    )
