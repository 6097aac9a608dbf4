"""The corpus pipeline: documents go through five stages, each written and read again before the next.

toxicity, near_copies, contamination, personal_data, pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlab.llm import containment, crf, pieces, sketch, toxicity
from eventlab.llm.catalog import piece_file, table
from eventlab.llm.common import numbered, prepared, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5; the model learns from all labels. Null and empty texts stay."""
    spark = prepared(spark)
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = toxicity.fit(table(spark, sf_dir, "documents").select("doc_id", "text"), labels)
    return toxicity.scored(docs.select(*COLUMNS), model).where("score < 0.5").select(*COLUMNS)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of documents that agree to 80 in 100 of their five-word shingles, the row with the smallest id.

    Every row is a document of its own, whatever its id: rows that share an id or have none are compared
    like any others, an id comes before none, and of rows with one id one stays. Documents without words have no class and stay.
    """
    prepared(spark)
    rows = numbered(docs.select(*COLUMNS))
    found = sketch.classes(rows.select(F.col("_row").alias("doc_id"), "text"), percent=80)
    members = found.select(F.col("doc_id").alias("_row"), "component_id").join(rows.select("_row", "doc_id"), "_row")
    first = members.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row")).alias("first"))
    return rows.join(first.select("first._row"), "_row", "left_semi").select(*COLUMNS)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item to 80 in 100 of its five-word shingles."""
    spark = prepared(spark)
    return containment.clean(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark").select("item_id", "text"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data in ``text`` replaced by its kind; ``n_chars`` follows the text."""
    spark = prepared(spark)
    masked = crf.masked(docs.select(*COLUMNS), crf.default_model(spark))
    return masked.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast("long"))).select(*COLUMNS)


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as piece ids, with digests of the ids and of what they decode to."""
    prepared(spark)
    done = pieces.encoded(docs.select("doc_id", "lang", "source", "text"), piece_file())
    return done.select("doc_id", "lang", "source", "n_tokens", "ids", "ids_sha256", F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", one_of_near_copies),
    ("contamination", without_benchmark),
    ("personal_data", mask_personal_data),
    ("pieces", to_pieces),
]

# SQL cannot train or encode; the stages are tested one by one instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; stages in between go through Parquet in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
