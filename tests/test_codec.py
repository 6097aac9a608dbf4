import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventlab.functions import codec
from eventlab.plans.spec import fields_of
from eventlab.sources import kafka

FIELDS = fields_of([
    {"name": "order_id", "type": "uuid"},
    {"name": "total", "type": "float"},
    {"name": "count", "type": "int"},
    {"name": "paid", "type": "boolean"},
    {"name": "created_at", "type": "timestamp"},
    {"name": "order_status", "type": "enum", "values": ["NEW", "NEW", "DONE"]},
    {"name": "ship_to", "type": "object", "fields": [{"name": "city", "type": "string"}]},
    {"name": "tags", "type": "array", "items": {"type": "string"}},
    {"name": "lines", "type": "array", "items": {"type": "object", "fields": [{"name": "qty", "type": "int"}]}},
])


def test_parse_keeps_bad_rows(spark):
    df = spark.createDataFrame([('{"count": 3, "extra": 1}',), ("{oops",), ('{"count": "x"}',), (None,)], "value STRING")
    got = codec.parse_json(df, fields_of([{"name": "count", "type": "int"}])).collect()
    assert [(r.parsed and r.parsed["count"], r._corrupt_record) for r in got] == [
        (3, None), (None, "{oops"), (None, '{"count": "x"}'), (None, None),
    ]


def test_avro_schema_of_fields():
    schema = json.loads(codec.avro_schema(FIELDS, "Order"))
    assert (schema["type"], schema["name"]) == ("record", "Order")
    types = {f["name"]: f["type"] for f in schema["fields"]}
    assert types["order_id"] == {"type": "string", "logicalType": "uuid"}
    assert types["created_at"] == {"type": "long", "logicalType": "timestamp-millis"}
    assert types["order_status"] == {"type": "enum", "name": "OrderStatusEnum", "symbols": ["NEW", "DONE"]}
    assert types["ship_to"]["name"] == "ShipToRecord" and types["tags"]["items"] == {"type": "string"}
    assert types["lines"]["items"]["type"] == "record"
    # The schema reads back as the Spark type, timestamps as real timestamps.
    back = codec.schema_from_avro(schema)
    assert back["created_at"].dataType == T.TimestampType() and back["total"].dataType == T.DoubleType()
    assert back["lines"].dataType.elementType["qty"].dataType == T.LongType()


def test_stored_avro_schema():
    schema = codec.schema_from_avro(json.dumps({
        "type": "record", "name": "R", "fields": [
            {"name": "a", "type": ["null", "string"]},
            {"name": "b", "type": {"type": "int", "logicalType": "date"}},
            {"name": "c", "type": {"type": "map", "values": "long"}},
            {"name": "d", "type": {"type": "bytes", "logicalType": "decimal", "precision": 9, "scale": 2}},
            {"name": "e", "type": {"type": "record", "name": "E", "fields": [{"name": "x", "type": "float"}]}},
            {"name": "f", "type": {"type": "array", "items": "E"}},
            {"name": "g", "type": {"type": "long", "logicalType": "timestamp-micros"}},
            {"name": "h", "type": ["null", {"type": "enum", "name": "H", "symbols": ["A"]}]},
        ]}))
    assert schema.simpleString() == (
        "struct<a:string,b:date,c:map<string,bigint>,d:decimal(9,2),e:struct<x:float>,f:array<struct<x:float>>,"
        "g:timestamp,h:string>"
    )
    assert [f.nullable for f in schema] == [True, False, False, False, False, False, False, True]
    for bad in ({"type": "enum", "name": "x", "symbols": []}, {"type": "record", "name": "x", "fields": [{"name": "a", "type": "Nope"}]}):
        with pytest.raises(ValueError):
            codec.schema_from_avro(bad)


def test_stored_proto_schema():
    schema = codec.schema_from_proto("""
        syntax = "proto3";
        // message Old { string gone = 1; }
        message Order {
          string id = 1;  // the id
          optional int64 total = 2;
          repeated string tags = 3;
          uint32 n = 4;
          Address to = 5;
          bool paid = 6 [deprecated = true];
        }
        message Address {}""")
    assert schema.simpleString() == "struct<id:string,total:bigint,tags:array<string>,n:bigint,to:struct<>,paid:boolean>"
    with pytest.raises(ValueError, match="unknown Protobuf type 'Nope'"):
        codec.schema_from_proto("message A { Nope x = 1; }")
    assert len(codec.schema_from_proto("nothing here")) == 0


def test_proto_descriptor_round_trip():
    pb = pytest.importorskip("google.protobuf.descriptor_pb2")
    from google.protobuf import descriptor_pool, message_factory

    files = pb.FileDescriptorSet.FromString(codec.proto_descriptor(FIELDS, "Order"))
    pool = descriptor_pool.DescriptorPool()
    pool.Add(files.file[0])
    cls = message_factory.GetMessageClass(pool.FindMessageTypeByName("eventlab.generated.Order"))
    sent = cls(order_id="x", total=1.5, count=2**40, paid=True, order_status=1, tags=["a", "b"])
    sent.ship_to.city = "Y"
    sent.lines.add(qty=3)
    back = cls.FromString(sent.SerializeToString())
    assert back == sent and back.lines[0].qty == 3 and back.ship_to.city == "Y"
    assert [v.name for v in files.file[0].message_type[0].enum_type[0].value] == ["NEW", "DONE"]


AWKWARD = fields_of([
    {"name": "status", "type": "enum", "values": ["NEW", "DONE"]},
    {"name": "kind", "type": "enum", "values": ["NEW", "OLD"]},
    {"name": "state", "type": "enum", "values": ["in-progress", "done"]},
    {"name": "free", "type": "object", "fields": []},
    {"name": "ship_to", "type": "object", "fields": [
        {"name": "status", "type": "enum", "values": ["NEW"]},
        {"name": "city", "type": "object", "fields": [{"name": "x", "type": "int"}]}]},
    {"name": "ship", "type": "object", "fields": [{"name": "to_city", "type": "object", "fields": [{"name": "x", "type": "int"}]}]},
    {"name": "moods", "type": "array", "items": {"type": "enum", "values": ["NEW", "SAD"]}},
    {"name": "lines", "type": "array", "items": {"type": "object", "fields": [{"name": "status", "type": "enum", "values": ["NEW"]}]}},
])


@pytest.mark.parametrize("fields", [FIELDS, AWKWARD])
def test_the_avro_parser_takes_every_schema(spark, fields):
    parser = spark.sparkContext._jvm.org.apache.avro.Schema.Parser()
    text = codec.avro_schema(fields, "Order")
    assert parser.parse(text).getFullName() == "eventlab.generated.Order"
    # What is read back makes the same schema again, as far as symbols allow.
    again = codec.fields_from_avro(text)
    assert codec.avro_schema(again, "Order") == text


def test_arrays_of_arrays():
    deep = fields_of([{"name": "m", "type": "array", "items": {"type": "array", "items": {"type": "int"}}}])
    assert codec.schema_from_avro(codec.avro_schema(deep, "M")).simpleString() == "struct<m:array<array<bigint>>>"
    with pytest.raises(ValueError, match="arrays of arrays"):
        codec.proto_layout(deep, "M")


def test_awkward_descriptor_loads():
    pb = pytest.importorskip("google.protobuf.descriptor_pb2")
    from google.protobuf import descriptor_pool, message_factory

    files = pb.FileDescriptorSet.FromString(codec.proto_descriptor(AWKWARD, "Order"))
    pool = descriptor_pool.DescriptorPool()
    pool.Add(files.file[0])
    cls = message_factory.GetMessageClass(pool.FindMessageTypeByName("eventlab.generated.Order"))
    sent = cls(status=1, kind=1, state="in-progress", free={"a": "b"}, moods=[1, 0])
    sent.ship_to.city.x = 4
    sent.lines.add(status=0)
    back = cls.FromString(sent.SerializeToString())
    assert back == sent and back.free["a"] == "b" and list(back.moods) == [1, 0]


def test_whole_proto_text():
    text = """
        syntax = "proto3"; package shop.v1; import "google/protobuf/timestamp.proto";
        /* message Old { string gone = 1; } */
        option java_package = "x;y{";
        message Order {
          enum Status { option allow_alias = true; NEW = 0; DONE = 1 [deprecated = true]; reserved 3; }
          message Line { int32 qty = 1; Size size = 2; enum Size { S = 0; } }
          string id = 1; Status status = 2; repeated Line lines = 3;
          map<string, Line> by_name = 4;
          oneof paid { bool cash = 5; .shop.v1.Card card = 6; }
          reserved 7, 9 to 11; google.protobuf.Timestamp at = 8; uint64 big = 12; Order.Line first = 13;
          repeated Status past = 14;
        }
        message Card { bytes no = 1; }
        service Shop { rpc Buy (Order) returns (Card) { option x = {a: 1}; } }
    """
    line = "struct<qty:int,size:string>"
    assert codec.schema_from_proto(text).simpleString() == (
        f"struct<id:string,status:string,lines:array<{line}>,by_name:map<string,{line}>,cash:boolean,card:struct<no:binary>,"
        f"at:timestamp,big:decimal(20,0),first:{line},past:array<string>>")
    assert codec.schema_from_proto(text, "Card").simpleString() == "struct<no:binary>"
    fields = {f.name: f for f in codec.fields_from_proto(text)}
    assert fields["status"].values == ("NEW", "DONE") and fields["lines"].items.fields[1].values == ("S",)
    assert fields["by_name"].fields == () and fields["at"].type == "timestamp" and fields["past"].items.type == "enum"
    for bad in ("message A { A a = 1; }", "message A { string x = 1;", "message A { oneof {"):
        with pytest.raises(ValueError):
            codec.schema_from_proto(bad)


def test_fields_from_avro():
    fields = codec.fields_from_avro({"type": "record", "name": "R", "namespace": "n", "fields": [
        {"name": "a", "type": ["null", "int"]}, {"name": "b", "type": "null"}, {"name": "c", "type": {"type": "string", "logicalType": "uuid"}},
        {"name": "d", "type": {"type": "long", "logicalType": "timestamp-micros"}}, {"name": "e", "type": {"type": "enum", "name": "E", "symbols": ["X"]}},
        {"name": "f", "type": {"type": "array", "items": "n.E"}}, {"name": "g", "type": {"type": "map", "values": "int"}},
        {"name": "h", "type": {"type": "record", "name": "H", "fields": [{"name": "x", "type": "E"}]}},
        {"name": "i", "type": {"type": "int", "logicalType": "date"}}, {"name": "j", "type": "bytes"}]})
    assert [(f.name, f.type) for f in fields] == [
        ("a", "int"), ("c", "uuid"), ("d", "timestamp"), ("e", "enum"), ("f", "array"), ("g", "object"), ("h", "object"), ("i", "int"), ("j", "string")]
    assert fields[4].items.values == ("X",) and fields[6].fields[0].type == "enum"


def test_modules_are_missing_by_name(spark):
    """Spark's modules are not here: building the expression must get as far as looking for them."""
    df = spark.range(1).select(F.lit("x").alias("id"))
    fields = fields_of([{"name": "id", "type": "string"}])
    for encode, words in ((codec.to_avro_value, ("Avro", "avro")), (codec.to_proto_value, ("Protobuf", "protobuf"))):
        try:
            out = df.select(encode(fields, "R").alias("v")).collect()
        except Exception as err:
            if not any(w in str(err) for w in words):
                raise
        else:
            assert out[0].v


# --- Kafka options -------------------------------------------------------------


def test_plain_cluster_options():
    assert kafka.kafka_options(kafka.Cluster("h:9092")) == {
        "kafka.bootstrap.servers": "h:9092", "kafka.security.protocol": "PLAINTEXT",
    }
    read = kafka.source_options(kafka.Cluster("h:1"), ["a", "b"], "earliest")
    assert (read["subscribe"], read["startingOffsets"], read["kafka.session.timeout.ms"]) == ("a,b", "earliest", "45000")
    write = kafka.sink_options(kafka.Cluster("h:1"), acks="all")
    assert (write["kafka.acks"], write["kafka.batch.size"], write["kafka.compression.type"]) == ("all", "16384", "lz4")


@pytest.mark.parametrize("mechanism,module", [("PLAIN", "PlainLoginModule"), ("SCRAM-SHA-256", "ScramLoginModule"), ("SCRAM-SHA-512", "ScramLoginModule")])
def test_sasl_options(mechanism, module):
    cluster = kafka.Cluster("h:1", "SASL_SSL", mechanism, "me", 'se"c\\ret')
    out = kafka.kafka_options(cluster)
    assert out["kafka.sasl.mechanism"] == mechanism
    assert module in out["kafka.sasl.jaas.config"] and 'password="se\\"c\\\\ret"' in out["kafka.sasl.jaas.config"]


def test_tls_options(tmp_path):
    (tmp_path / "c.pem").write_text("CERT")
    (tmp_path / "k.pem").write_text("KEY")
    cluster = kafka.Cluster(
        "h:1", "SSL", ssl_ca_location="/ca.pem", ssl_cert_location=str(tmp_path / "c.pem"),
        ssl_key_location=str(tmp_path / "k.pem"), ssl_key_password="p",
    )
    out = kafka.kafka_options(cluster)
    assert (out["kafka.ssl.truststore.location"], out["kafka.ssl.truststore.type"]) == ("/ca.pem", "PEM")
    assert (out["kafka.ssl.keystore.key"], out["kafka.ssl.keystore.certificate.chain"]) == ("KEY", "CERT")
    assert out["kafka.ssl.key.password"] == "p"


@pytest.mark.parametrize("bad", [
    {"security_protocol": "TLS"}, {"security_protocol": "SASL_SSL"}, {"sasl_mechanism": "GSSAPI"},
    {"security_protocol": "SASL_PLAINTEXT", "sasl_mechanism": "PLAIN", "sasl_username": "x"},
    {"ssl_cert_location": "/c"}, {"ssl_key_location": "/k"},
])
def test_bad_clusters_are_rejected(bad):
    with pytest.raises(ValueError):
        kafka.Cluster("h:1", **bad)


def test_bad_kafka_settings_are_rejected(spark):
    cluster = kafka.Cluster("h:1")
    with pytest.raises(ValueError):
        kafka.source_options(cluster, ["a"], "middle")
    with pytest.raises(ValueError):
        kafka.sink_options(cluster, acks="2")
    with pytest.raises(ValueError):
        kafka.sink_options(cluster, compression_type="brotli")
    df = spark.range(1).select(F.lit("t").alias("topic"), F.lit("k").alias("key"), F.lit("v").alias("value"), F.lit(1).alias("x"))
    assert kafka.kafka_columns(df).dtypes == [("topic", "string"), ("key", "binary"), ("value", "binary")]
