"""Spelling variants against edits of every word."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from eventlab.llm import catalog, spelling
from eventlab.llm.common import prepared

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1:] == short for i in range(len(long)))


def brute(counts, ratio=5):
    """(word, n, form, root, n_near, form_n) by comparing all words, cut down by shared deletions."""
    meet = {}
    for w in counts:
        for v in {w, *(w[:i] + w[i + 1:] for i in range(len(w)))}:
            meet.setdefault(v, set()).add(w)
    near = {w: {x for v in {w, *(w[:i] + w[i + 1:] for i in range(len(w)))} for x in meet[v] if one_edit(w, x)} for w in counts}
    form = {}
    for w, some in near.items():
        best = min(some, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * counts[w] else None
    out = []
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, counts[w], form[w], root, len(near[w]), counts[form[w]] if form[w] else None))
    return sorted(out)


def words(seed, alphabet, n, longest):
    rng = random.Random(seed)
    return {"".join(rng.choice(alphabet) for _ in range(rng.randint(1, longest))): 3 ** rng.randint(0, 9) + rng.randint(0, 1) for _ in range(n)}


@pytest.mark.parametrize("seed,alphabet,n,longest", [(1, "ab", 400, 8), (2, "aé😀", 300, 6), (3, "abcdefgh", 500, 4), (4, "a", 30, 30)])
def test_matches_brute_force(spark, seed, alphabet, n, longest):
    counts = words(seed, alphabet, n, longest)
    df = prepared(spark).createDataFrame(list(counts.items()), "word string, n bigint").repartition(3)
    assert sorted(map(tuple, spelling.variants(df).collect())) == brute(counts)


def test_long_chains_and_ties(spark):
    chain = {"a" * (k + 1): 5 ** (13 - k) for k in range(14)}
    ties = {"banana": 4, "bandana": 20, "banena": 20, "manana": 20, "ananas": 3}
    counts = chain | ties
    df = prepared(spark).createDataFrame(list(counts.items()), "word string, n bigint")
    got = {r.word: r for r in spelling.variants(df).collect()}
    assert sorted(map(tuple, got.values())) == brute(counts)
    assert got["a" * 14].root == "a" and got["banana"].form == "bandana"


def test_repeated_null_odd_and_empty_words(spark):
    spark = prepared(spark)
    df = spark.createDataFrame([("house", 2), ("house", 3), (None, 9), ("hause", 25), ("", 1), ("x\x00y", 7), ("x\x00z", 70), ("h", 5)], "word string, n bigint")
    got = sorted(map(tuple, spelling.variants(df.withColumn("form", F.lit("clash")).withColumn("prefix", F.lit(1))).collect()))
    plain = brute({"house": 5, "hause": 25, "": 1, "h": 5})
    assert got == sorted(plain + [("x\x00y", 7, None, "x\x00y", 0, None), ("x\x00z", 70, None, "x\x00z", 0, None)])
    assert spelling.variants(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        spelling.variants(df, ratio=1)


def test_rows_stay_linear_in_letters(spark):
    counts = [(a + "bcdefg", 1) for a in "abcdefghijklmnopqrstuvwxyz"]
    df = prepared(spark).createDataFrame(counts, "word string, n bigint")
    assert spelling.rotations(df).count() == 26 * (2 * 7 + 1)
    assert {r.n_near for r in spelling.near(spelling.rotations(df)).collect()} == {25}


def runs(rows):
    return [(d, r.translate(LOWER)) for d, t in rows for r in re.findall("[A-Za-zÀ-ÿ]+", t or "")]


def missing(rows):
    counts = Counter()
    for d, r in runs(rows):
        h = zlib.crc32(f"{'' if d is None else d}:{r}".encode())
        counts[r[:h % len(r)] + r[h % len(r) + 1:] if h % 199 == 0 else r] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def test_words_of_odd_texts(spark):
    rows = [(d, "Überraschung ÀÉÎ×÷ÿstraße naïve1naïve _Strasse strasse") for d in range(400)] + [(1, None), (2, ""), (None, "strasse " * 9), (3, "Straße" * 3)] * 2
    df = prepared(spark).createDataFrame(rows, "doc_id bigint, text string")
    got = {(r.word, r.n) for r in spelling.counted(catalog.slipped(spelling.runs_of(df)), "word").collect()}
    assert got == set(missing(rows).items())


def test_query(spark, data):
    rows = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    assert sorted(map(tuple, catalog.QUERIES["op11_spelling_variants"](spark, data).collect())) == brute(missing(rows))
