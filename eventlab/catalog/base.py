"""Registry of example queries over the test tables, and inputs they share."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import partition_col
from ..operators.routing import FailurePolicy, process, with_groups
from ..operators.synth import with_offsets
from ..session import configure
from ..sources.tables import spread

SEED = 7
PARTITIONS = 12
START_MICROS = 1_704_067_200_000_000  # 2024-01-01, where the event table starts
TOPICS = ("click", "error", "purchase", "signup", "view")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under ``name`` with the SQL it must agree with."""
    def add(fn):
        @wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(configure(spark), sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_messages(events: DataFrame) -> DataFrame:
    """The event table as messages without offsets."""
    return events.select(
        F.col("event_type").alias("topic"),
        partition_col(F.concat(F.lit("key-"), F.col("user_id").cast("string")), PARTITIONS).alias("partition"),
        F.concat(F.lit("key-"), F.col("user_id").cast("string")).alias("key"),
        F.col("props").alias("value"),
        "ts",
        F.col("event_id").alias("row_index"),
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_messages(spread(table(spark, sf_dir, "events")))


def addressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_offsets(messages(spark, sf_dir))


def processed(msgs: DataFrame, policy: FailurePolicy, groups: int = 2) -> DataFrame:
    return process(with_groups(msgs, groups), policy, SEED)


# --- the same inputs in SQL --------------------------------------------------


def u_sql(path: str, idx: str, k: int = 0, seed: int = SEED) -> str:
    """Draw ``k`` of a path (an SQL expression) for a row."""
    start = 1 + 13 * (k % 2)
    text = f"md5(concat_ws('|', '{seed}', {path}, '{k // 2}', {idx}))"
    return f"(('0x' || substr({text}, {start}, 13))::BIGINT / 4503599627370496.0)"


def hash_sql(path: str, idx: str, chunk: str = "'0'", seed: int = SEED) -> str:
    return f"md5(concat_ws('|', '{seed}', {path}, {chunk}, {idx}))"


def pick_sql(draw: str, low: int, high: int) -> str:
    return f"({low} + floor({draw} * {high - low + 1})::BIGINT)"


def letters_sql(hexes: str, start: int) -> str:
    powers = ", ".join(str(26**p) for p in range(9, -1, -1))
    number = f"('0x' || substr({hexes}, {start}, 15))::BIGINT"
    return (
        f"array_to_string(list_transform([{powers}], "
        f"lambda p: chr((97 + ({number} // p) % 26)::INTEGER)), '')"
    )


def uuid_sql(hexes: str) -> str:
    return (
        f"substr({hexes}, 1, 8) || '-' || substr({hexes}, 9, 4) || '-4' || substr({hexes}, 14, 3) || '-' || "
        f"substr('89ab', 1 + ('0x' || substr({hexes}, 17, 1))::INTEGER % 4, 1) || substr({hexes}, 18, 3) "
        f"|| '-' || substr({hexes}, 21, 12)"
    )


def partition_sql(key: str, n: int = PARTITIONS) -> str:
    return f"((('0x' || substr(md5({key}), 1, 8))::BIGINT % {n})::INTEGER)"


MSGS = f"""msgs AS (
  SELECT event_type AS topic, {partition_sql("'key-' || user_id")} AS "partition",
         'key-' || user_id AS key, props AS value, ts, event_id AS row_index
  FROM events)"""

ADDRESSED = MSGS + """, addressed AS (
  SELECT *, row_number() OVER (PARTITION BY topic, "partition" ORDER BY row_index) - 1 AS "offset"
  FROM msgs)"""


def processed_sql(
    policy: FailurePolicy, groups: int = 2, source: str = "msgs", name: str = "processed"
) -> str:
    """Routing attempt by attempt: attempt j fails while the draw is below rate^j."""
    tries = 1 + policy.max_retries if policy.on_failure == "retry" else 1
    lost = {"skip": "skip", "dlq": "dlq", "retry": "exhausted"}[policy.on_failure]
    draw = u_sql("'fail/' || group_id", "row_index")
    commit = u_sql("'fail/' || group_id", "row_index", 1)
    failures = " + ".join(
        f"(CASE WHEN draw < {policy.failure_rate**j!r} THEN 1 ELSE 0 END)" for j in range(1, tries + 1)
    )
    return f"""{name}_groups AS (
  SELECT m.*, m.topic || '-group-' || g AS group_id
  FROM {source} m, range(1, {groups + 1}) AS t(g)),
{name}_draws AS (
  SELECT *, {draw} AS draw, {commit} AS commit_draw FROM {name}_groups),
{name}_failed AS (SELECT *, {failures} AS failures FROM {name}_draws),
{name} AS (
  SELECT *, CASE WHEN failures < {tries} THEN 'ok' ELSE '{lost}' END AS status,
         least(failures + 1, {tries}) AS attempts, least(failures + 1, {tries}) - 1 AS retries,
         failures < {tries} AND commit_draw < {policy.commit_failure_rate!r} AS commit_failed
  FROM {name}_failed)"""
