"""Words, shingles and their hashes: equal where words are equal, and nowhere else."""

import random

import numpy as np
import pyarrow as pa
import pytest

from eventlab.llm import catalog, containment, fmindex, sketch
from eventlab.llm.common import Words, bytes_hash, numbered, prepared, runs_hash, words_of
from eventlab.session import scratch_path


def words(texts):
    return next(iter(words_of(pa.array(texts))))[2]


def thue_morse(a, b, n=1024):
    """Two arrangements of two values that sums over powers cannot tell apart."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return [(a, b)[x] for x in bits], [(b, a)[x] for x in bits]


X, Y = ("".join(t) for t in thue_morse("a", "b"))
P, Q = (" ".join(t) for t in thue_morse("ant", "bee"))


def test_hashes_of_words_and_runs():
    rng = random.Random(1)
    texts = [" ".join("".join(rng.choice("ab") for _ in range(rng.choice([1, 2, 7, 8, 9, 16, 17, 255, 256, 257, 600]))) for _ in range(30)) for _ in range(40)]
    w = words(texts)
    plain = [x for t in texts for x in t.split()]
    assert len(set(plain)) == len(set(w.hash.tolist())) and len(dict(zip(plain, w.hash.tolist()))) == len(set(zip(plain, w.hash.tolist())))
    few = np.array(rng.choices(range(3), k=400), np.uint64)
    starts = np.array([rng.randrange(380) for _ in range(3_000)])
    ends = starts + np.array([rng.randint(1, 20) for _ in range(3_000)])
    for seed in (0, 1):
        seen = {}
        for s, e, h in zip(starts, ends, runs_hash(few, starts, ends, seed)):
            assert seen.setdefault(tuple(few[s:e]), h) == h
        assert len(set(seen.values())) == len(seen)
    assert (runs_hash(few, starts, ends, 0) != runs_hash(few, starts, ends, 1)).all()
    assert len(runs_hash(few, starts[:0], ends[:0])) == 0


def test_arrangements_that_cancel_out():
    data = np.frombuffer((X + Y).encode(), np.uint8)
    h = bytes_hash(data, np.array([0, 1024]), np.array([1024, 2048]))
    assert h[0] != h[1]
    for n in (8, 64, 128, 256):
        a, b = ("".join(t) for t in thue_morse("a", "b", n))
        assert len(set(words([a + " " + b]).hash.tolist())) == 2
    w = words([P, Q])
    ends = np.array([1024, 2048])
    assert len(set(runs_hash(w.hash, ends - 1024, ends).tolist())) == 2


def test_digests_are_of_words_alone():
    w = words(["a b  c", " a\tb\nc ", "ab c", "", None, " ", "a", "a b c d"])
    d = w.digests()
    assert len(d) == 8 and d[0] == d[1] and d[3] == d[4] == d[5] and len(set(d)) == 5


@pytest.mark.parametrize("one,two", [(X, Y), (P, Q)])
def test_such_texts_are_no_copies(spark, one, two):
    """Words of 1,024 letters and texts of 1,024 words that differ in their arrangement only."""
    spark = prepared(spark)
    head = "one two three four "
    df = spark.createDataFrame([(1, head + one), (2, head + two), (3, head + one)], "doc_id bigint, text string")
    brute = lambda a, b: 100 * len(sketch._shingles(a, 5) & sketch._shingles(b, 5)) >= 85 * len(sketch._shingles(a, 5) | sketch._shingles(b, 5))
    linked = brute(head + one, head + two)
    assert {r.doc_id: r.component_id for r in sketch.classes(df).collect()} == {1: 1, 2: 1 if linked else 2, 3: 1}
    # Windows of 20 words, of which the last is such a word.
    lead = " ".join(f"w{i}" for i in range(19)) + " "
    df = spark.createDataFrame([(1, lead + X), (2, lead + Y), (3, lead + X)], "doc_id bigint, text string")
    got = {r.doc_id: r.n_removed for r in fmindex.without(df, fmindex.repeated(df)).collect()}
    assert got == {1: 0, 2: 0, 3: 20}
    items = spark.createDataFrame([(7, head + Y), (8, head + X + " six")], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, head + X + " six"), (2, "and " + head + Y)], "doc_id bigint, text string")
    assert sorted((r.doc_id, r.item_id) for r in containment.leaks(docs, items).collect()) == [(1, 8), (2, 7)]


def test_queries_are_registered():
    assert {n.split("_")[0] for n in catalog.QUERIES} == {f"op{n}" for n in range(1, 14)}
    assert isinstance(words(["a"]), Words)


def test_numbers_of_rows_stay(spark):
    path = scratch_path(prepared(spark), "rows")
    spark.range(300).selectExpr("id % 50 AS doc_id", "'t' AS text", "1 AS _number").repartition(7).write.parquet(path)
    for df in (spark.read.parquet(path), spark.read.parquet(path).select("text", "doc_id", "_number"), spark.range(40).selectExpr("id AS doc_id").repartition(3)):
        rows = numbered(df)
        assert rows.columns == [*df.columns, "_row"]
        first = {r["_row"]: r.doc_id for r in rows.collect()}
        assert len(first) == df.count() and first == {r["_row"]: r.doc_id for r in rows.select("doc_id", "_row").collect()}
    assert numbered(spark.read.parquet(path).limit(0)).count() == 0
