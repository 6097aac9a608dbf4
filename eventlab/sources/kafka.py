"""Kafka topics as message tables (needs Spark's Kafka connector on the classpath)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Accepted security settings.
PROTOCOLS = ("PLAINTEXT", "SSL", "SASL_PLAINTEXT", "SASL_SSL")
MECHANISMS = ("PLAIN", "SCRAM-SHA-256", "SCRAM-SHA-512")
RESETS = ("earliest", "latest")

# Login modules of the Java client.
LOGIN_MODULES = {
    "PLAIN": "org.apache.kafka.common.security.plain.PlainLoginModule",
    "SCRAM-SHA-256": "org.apache.kafka.common.security.scram.ScramLoginModule",
    "SCRAM-SHA-512": "org.apache.kafka.common.security.scram.ScramLoginModule",
}


@dataclass(frozen=True)
class Cluster:
    """Where a cluster is and how to log in. Certificates are PEM files."""

    bootstrap_servers: str
    security_protocol: str = "PLAINTEXT"
    sasl_mechanism: str | None = None
    sasl_username: str | None = None
    sasl_password: str | None = None
    ssl_ca_location: str | None = None
    ssl_cert_location: str | None = None
    ssl_key_location: str | None = None
    ssl_key_password: str | None = None

    def __post_init__(self) -> None:
        if self.security_protocol not in PROTOCOLS:
            raise ValueError(f"security_protocol must be one of {PROTOCOLS}")
        if self.sasl_mechanism is not None and self.sasl_mechanism not in MECHANISMS:
            raise ValueError(f"sasl_mechanism must be one of {MECHANISMS}")
        if self.security_protocol.startswith("SASL"):
            if not (self.sasl_mechanism and self.sasl_username and self.sasl_password):
                raise ValueError("SASL needs sasl_mechanism, sasl_username and sasl_password")
        if bool(self.ssl_cert_location) != bool(self.ssl_key_location):
            raise ValueError("ssl_cert_location and ssl_key_location go together")


def _pem(path: str) -> str:
    with open(path, encoding="ascii") as f:
        return f.read()


def kafka_options(cluster: Cluster, **client: str) -> dict[str, str]:
    """Options for ``format("kafka")``; ``client`` adds settings of the Java client.

    The client's dots are written as underscores: ``session_timeout_ms="45000"``.
    """
    out = {
        "kafka.bootstrap.servers": cluster.bootstrap_servers,
        "kafka.security.protocol": cluster.security_protocol,
    }
    if cluster.sasl_mechanism:
        user, password = (
            (v or "").replace("\\", "\\\\").replace('"', '\\"')
            for v in (cluster.sasl_username, cluster.sasl_password)
        )
        out["kafka.sasl.mechanism"] = cluster.sasl_mechanism
        out["kafka.sasl.jaas.config"] = (
            f"{LOGIN_MODULES[cluster.sasl_mechanism]} required "
            f'username="{user}" password="{password}";'
        )
    if cluster.ssl_ca_location:
        out["kafka.ssl.truststore.type"] = "PEM"
        out["kafka.ssl.truststore.location"] = cluster.ssl_ca_location
    if cluster.ssl_cert_location:
        out["kafka.ssl.keystore.type"] = "PEM"
        # The Java client takes separate PEM files only as text.
        out["kafka.ssl.keystore.key"] = _pem(cluster.ssl_key_location)
        out["kafka.ssl.keystore.certificate.chain"] = _pem(cluster.ssl_cert_location)
    if cluster.ssl_key_password:
        out["kafka.ssl.key.password"] = cluster.ssl_key_password
    out.update({f"kafka.{k.replace('_', '.')}": str(v) for k, v in client.items()})
    return out


def source_options(
    cluster: Cluster, topics: list[str], auto_offset_reset: str = "latest",
    session_timeout_ms: int = 45_000, streaming: bool = True,
) -> dict[str, str]:
    """Read options. A batch read always ends at the latest offsets, so starts at earliest."""
    if auto_offset_reset not in RESETS:
        raise ValueError(f"auto_offset_reset must be one of {RESETS}")
    out = kafka_options(cluster, session_timeout_ms=session_timeout_ms)
    out["subscribe"] = ",".join(topics)
    out["startingOffsets"] = auto_offset_reset if streaming else "earliest"
    return out


def sink_options(
    cluster: Cluster, batch_size: int = 16_384, linger_ms: int = 5, acks: str = "1",
    compression_type: str = "lz4",
) -> dict[str, str]:
    if acks not in ("0", "1", "all"):
        raise ValueError("acks must be '0', '1' or 'all'")
    if compression_type not in ("none", "gzip", "snappy", "lz4", "zstd"):
        raise ValueError("unknown compression_type")
    return kafka_options(
        cluster, batch_size=batch_size, linger_ms=linger_ms, acks=acks, compression_type=compression_type
    )


def read_kafka(spark: SparkSession, cluster: Cluster, topics: list[str], streaming: bool = True,
               auto_offset_reset: str = "latest") -> DataFrame:
    """Message rows of topics: topic, partition, offset, key, value, ts."""
    reader = spark.readStream if streaming else spark.read
    options = source_options(cluster, topics, auto_offset_reset, streaming=streaming)
    raw = reader.format("kafka").options(**options).load()
    return raw.select(
        "topic", "partition", "offset", F.col("key").cast("string").alias("key"), "value",
        F.col("timestamp").alias("ts"),
    )


def kafka_columns(msgs: DataFrame) -> DataFrame:
    """The columns a Kafka sink takes; rows keep their topic."""
    def raw(name: str) -> Column:
        return F.col(name).cast("binary").alias(name)

    return msgs.select("topic", raw("key"), raw("value"))


def write_kafka(msgs: DataFrame, cluster: Cluster, checkpoint: str | None = None, **sink):
    """Write messages; a stream needs a checkpoint folder and returns its query."""
    out, options = kafka_columns(msgs), sink_options(cluster, **sink)
    if not msgs.isStreaming:
        return out.write.format("kafka").options(**options).save()
    if checkpoint is None:
        raise ValueError("a streaming write needs a checkpoint folder")
    return out.writeStream.format("kafka").options(**options).option("checkpointLocation", checkpoint).start()
