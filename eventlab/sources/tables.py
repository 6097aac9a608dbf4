"""Message tables in files, and the table of topics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.flows import Flow
from ..operators.synth import TopicSpec

MESSAGE = T.StructType([
    T.StructField("topic", T.StringType()),
    T.StructField("partition", T.IntegerType()),
    T.StructField("offset", T.LongType()),
    T.StructField("key", T.StringType()),
    T.StructField("value", T.StringType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("row_index", T.LongType()),
])

FORMATS = ("parquet", "json", "orc")

# Shape of a topic that only a flow names.
FLOW_PARTITIONS = 12
FLOW_REPLICATION = 3


def read_messages(
    spark: SparkSession, path: str, fmt: str = "parquet", streaming: bool = False,
    schema: T.StructType = MESSAGE, files_per_trigger: int | None = None, glob: str | None = None,
) -> DataFrame:
    """Messages from files. The schema is declared, never inferred.

    A filter on ``topic`` prunes folders where the table was written by topic.
    """
    if fmt not in FORMATS:
        raise ValueError(f"format must be one of {FORMATS}")
    reader = (spark.readStream if streaming else spark.read).schema(schema).format(fmt)
    if streaming and files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path)


def write_messages(
    msgs: DataFrame, path: str, fmt: str = "parquet", partition_by: str | None = "topic",
    mode: str = "errorifexists", files_per_value: int | None = None,
) -> None:
    """Write messages, one folder per topic.

    By default tasks write what they hold, without a shuffle. With
    ``files_per_value`` rows are first spread over that many tasks per topic, so
    a hot topic is written by several and a small one leaves few files.
    """
    if fmt not in FORMATS:
        raise ValueError(f"format must be one of {FORMATS}")
    out = msgs
    if partition_by and files_per_value:
        salt = F.pmod(F.hash(*[c for c in msgs.columns if c != partition_by]), F.lit(files_per_value))
        out = msgs.repartition(F.col(partition_by), salt)
    writer = out.write.format(fmt).mode(mode)
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.save(path)


ADDRESS = ("topic", "partition", "offset")


def write_bucketed(msgs: DataFrame, name: str, path: str, buckets: int, by: tuple[str, ...] = ADDRESS) -> DataFrame:
    """Write messages as table ``name`` at ``path`` in buckets of ``by``, sorted in each, and read it back.

    Rows are shuffled once, when they are written, to one file a bucket.
    Tables with as many buckets of the same columns are then joined on them without a shuffle or a sort: messages
    with what became of them, replays with their source. Buckets of whole addresses stay even where one
    partition is hot.
    """
    msgs.repartition(buckets, *by).write.format("parquet").bucketBy(buckets, *by).sortBy(*by).option("path", path).saveAsTable(name)
    return msgs.sparkSession.table(name)


def join_buckets(a: DataFrame, b: DataFrame, by: tuple[str, ...] = ADDRESS, how: str = "inner") -> DataFrame:
    """Join two bucketed tables on their bucket columns, each bucket in one task."""
    return a.hint("merge").join(b.hint("merge"), list(by), how)


# Rows of a table that one task expands or draws values for.
ROWS_PER_TASK = 1 << 16


def spread(df: DataFrame) -> DataFrame:
    """Give a freshly read batch table at least as many tasks as there are cores, and one for every ``ROWS_PER_TASK`` rows.

    Drawing values costs far more than reading the few columns they depend on, so
    a table stored in a handful of files is dealt out before it is expanded. What a task sorts or folds
    behind it thus stays as large whatever the table's size; narrow rows are so many in a split
    that splits alone do not bound it. The rows are counted where they are read, which takes the files' footers only.
    A table with enough splits is left alone, as is a stream.
    """
    if df.isStreaming:
        return df
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // ROWS_PER_TASK))
    return df if 2 * df.rdd.getNumPartitions() > tasks else df.repartition(tasks)


def topic_rows(spark: SparkSession, topics: list[TopicSpec]) -> DataFrame:
    rows = [(t.name, t.partitions, t.replication_factor) for t in topics]
    return spark.createDataFrame(rows, "topic STRING, partitions INT, replication INT")


def topic_table(topics: DataFrame, flows: DataFrame) -> DataFrame:
    """Declared topics, then those only flows name, each once.

    ``topics`` has topic, partitions, replication; ``flows`` has topic. Flow
    topics are folded to distinct names before they are compared.
    """
    declared = topics.select("topic", "partitions", "replication").dropDuplicates(["topic"])
    only_flows = flows.select("topic").distinct().join(declared, "topic", "left_anti").select(
        "topic", F.lit(FLOW_PARTITIONS).alias("partitions"), F.lit(FLOW_REPLICATION).alias("replication")
    )
    return declared.unionByName(only_flows)


def flow_topics(spark: SparkSession, flows: list[Flow]) -> DataFrame:
    """(flow, topic) pairs of declared flows."""
    pairs = sorted({(f.name, s.topic) for f in flows for s in f.steps})
    return spark.createDataFrame(pairs, "flow STRING, topic STRING")
