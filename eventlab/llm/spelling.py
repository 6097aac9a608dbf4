"""Spelling variants: sorted rotations of marked words, in which words one edit apart share a prefix."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

# Stands behind the last letter of a word and sorts before every letter.
END = "\x00"
LETTERS = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def runs_of(df: DataFrame, text: str = "text", doc_id: str = "doc_id", pattern: str = LETTERS) -> DataFrame:
    """(doc_id, run): every match of ``pattern`` in every whole text, with A-Z lower-cased. Null and empty texts have none."""
    found = F.regexp_extract_all(F.translate(F.col(text), UPPER, LOWER), F.lit(pattern), F.lit(0))
    return df.select(F.col(doc_id).alias("doc_id"), F.explode(found).alias("run"))


def counted(runs: DataFrame, word: str = "run", least_chars: int = 6, least_n: int = 5) -> DataFrame:
    """(word, n) of the words with at least so many code points and occurrences; folded in each task first, so frequent words stay cheap."""
    long_enough = runs.select(F.col(word).alias("word")).where(F.char_length("word") >= least_chars)
    return long_enough.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_n)


def rotations(words: DataFrame) -> DataFrame:
    """(prefix, skipped, first, word, n): the rotations of each word with its end marked, each whole and without its last letter.

    A rotation ``y END x`` of ``xy`` is all there is of its prefix. A word
    ``x c y`` has the same prefix in the rotation that ends in c, the letter
    ``skipped``. So words that share a prefix are one edit apart: a
    replacement where both skip a letter, an insertion where one is whole.
    ``first`` marks a letter that does not follow an equal one, as inserting any letter of
    a run of equal ones gives the same word. 2 L + 1 rows for a word of L letters.
    """
    at = words.where(F.instr("word", END) == 0).select(
        "word", "n", F.explode(F.sequence(F.lit(0), F.char_length("word"))).alias("i"))
    turned = lambda drop: F.concat(F.expr("substring(word, i + 1)"), F.lit(END), F.expr(f"substring(word, 1, i - {drop})"))
    whole = F.struct(turned(0).alias("prefix"), F.lit(None).cast("string").alias("skipped"), F.lit(False).alias("first"))
    letter, before = F.expr("substring(word, i, 1)"), F.expr("substring(word, i - 1, 1)")
    skip = F.struct(turned(1).alias("prefix"), letter.alias("skipped"), ((F.col("i") == 1) | (letter != before)).alias("first"))
    both = F.when(F.col("i") > 0, F.array(whole, skip)).otherwise(F.array(whole))
    return at.select("word", "n", F.explode(both).alias("r")).select("r.prefix", "r.skipped", "r.first", "word", "n")


def near(index: DataFrame) -> DataFrame:
    """(word, n_near, best): how many words are one edit away, and of them (-n, word) of the most frequent, the smallest of equal ones.

    The rotations are sorted by range of prefix, and each group of a
    prefix is scanned in that order. It holds one word for each letter of the
    alphabet and one whole one at most, and each of them emits one row: the
    group's count and its best other member, not pairs.
    """
    index = index.repartitionByRange("prefix").withColumn("whole", F.col("skipped").isNull()).withColumn("rank", F.struct((-F.col("n")).alias("n"), "word"))
    order = Window.partitionBy("prefix").orderBy("whole", "rank")
    group = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    seen = index.select(
        "word", "whole", "first",
        F.count("skipped").over(group).alias("skips"),
        F.min(F.when(F.col("whole"), F.col("rank"))).over(group).alias("whole_rank"),
        F.count(F.when(F.col("first"), True)).over(group).alias("inserted"),
        F.min(F.when(F.col("first"), F.col("rank"))).over(group).alias("inserted_rank"),
        F.when(F.row_number().over(order) > 1, F.first("rank").over(group)).otherwise(F.lead("rank").over(order)).alias("other"),
    )
    met = seen.select(
        "word",
        F.when(F.col("whole"), F.col("inserted")).otherwise(
            F.col("skips") - 1 + F.when(F.col("first") & F.col("whole_rank").isNotNull(), 1).otherwise(0)).alias("near"),
        F.when(F.col("whole"), F.col("inserted_rank")).otherwise(F.least(
            F.when(F.col("skips") > 1, F.col("other")), F.when(F.col("first"), F.col("whole_rank")))).alias("best"),
    )
    return met.where("near > 0").groupBy("word").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))


def roots(links: DataFrame) -> DataFrame:
    """(word, root) of (word, form): forms followed to the last, two steps becoming one in each round.

    Each round is written, and there are as many as the longest chain has
    binary digits. Forms must not lead back to their word.
    """
    now = written(links.select("word", F.col("form").alias("root")), "forms")
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        joined = written(now.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "forms")
        now = joined.select("word", "root")
        if not joined.where("moved").head(1):
            return now


def variants(words: DataFrame, ratio: int = 5) -> DataFrame:
    """(word, n, form, root, n_near, form_n) of every word of (word, n).

    Two words are near if one inserted, deleted or replaced code point makes
    one the other. A word's ``form`` is its most frequent near word (of equal ones the
    smallest in code-point order) if that has at least ``ratio`` times its
    occurrences, else null; ``form_n`` is the form's n; ``root`` is the last word that forms lead to.
    ``ratio`` is above 1, so they end. Rows of one word add up; null words
    are left out; words that hold the end mark are near none. An empty table
    gives an empty one; other columns are not looked at.
    """
    if ratio <= 1:
        raise ValueError("ratio must be above 1, or forms could go in a circle")
    words = written(words.where("word IS NOT NULL").groupBy("word").agg(F.sum("n").cast("bigint").alias("n")), "words")
    found = words.join(near(rotations(words)), "word", "left").withColumn(
        "form", F.when(-F.col("best.n") >= ratio * F.col("n"), F.col("best.word")))
    found = written(found.select(
        "word", "n", "form", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), F.when(F.col("form").isNotNull(), -F.col("best.n")).alias("form_n")), "variants")
    ends = roots(found.where("form IS NOT NULL"))
    return found.join(ends, "word", "left").select("word", "n", "form", F.coalesce("root", "word").alias("root"), "n_near", "form_n")
