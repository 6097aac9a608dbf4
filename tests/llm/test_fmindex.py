"""Repeated passages against a dictionary of windows."""

import random

import numpy as np
import pytest

from eventlab.llm import fmindex
from eventlab.llm.common import prepared


def brute(rows, size):
    """(doc_id, n_words, n_removed, kept) by remembering the first place of every window."""
    first, cut = {}, {}
    texts = {d: (t or "").encode().split() for d, t in rows}
    for d in sorted(texts):
        for i in range(len(texts[d]) - size + 1):
            w = tuple(texts[d][i:i + size])
            if w in first:
                cut.setdefault(d, set()).update(range(i, i + size))
            else:
                first[w] = (d, i)
    return sorted((d, len(w), len(cut.get(d, ())), b" ".join(x for k, x in enumerate(w) if k not in cut.get(d, ())).decode())
                  for d, w in texts.items())


def passages(seed, n=60):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(40)]
    text = lambda k: [rng.choice(words) for _ in range(k)]
    shared = [text(rng.randint(15, 70)) for _ in range(4)]
    rows = []
    for d in range(n):
        w = text(rng.randint(0, 60))
        for _ in range(rng.randint(0, 2)):
            p = rng.choice(shared)
            a = rng.randint(0, len(p) // 2)
            w += p[a:] + text(rng.randint(0, 8))
        rows.append((d * 3 + 1, rng.choice([" ", "\n", " \t "]).join(w)))
    rows += [(1000, None), (1001, ""), (1002, "a " * 70), (1003, "a b " * 40), (1004, rows[5][1]), (1005, rows[5][1]),
             (1006, "é ß ü " * 30), (1007, " \n "), (1008, "one two")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,hot", [(1, 2_000), (2, 2_000), (3, 1)])
def test_matches_brute_force(spark, monkeypatch, seed, hot):
    monkeypatch.setattr(fmindex, "HOT_PIECES", hot)
    monkeypatch.setattr(fmindex, "SHARD_WORDS", 300)
    rows = passages(seed)
    df = prepared(spark).createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    got = fmindex.without(df, fmindex.repeated(df))
    assert sorted(map(tuple, got.collect())) == brute(rows, 20)


def test_long_stretches_stay_out_of_shards(spark, monkeypatch):
    real, rng = fmindex._search, random.Random(6)

    def bounded(table, size):
        words = sum(len(w) // 8 for w in table["words"].to_pylist())
        assert words <= 2_000, words
        return real(table, size)

    monkeypatch.setattr(fmindex, "_search", bounded)
    monkeypatch.setattr(fmindex, "SHARD_WORDS", 300)
    monkeypatch.setattr(fmindex, "HOT_WORDS", 400, raising=False)
    monkeypatch.setattr(fmindex, "PART_WINDOWS", 64, raising=False)
    words = [f"w{k}" for k in range(30)]
    line = " ".join(words[:7]) + " "
    rows = [(d, " ".join(rng.choice(words) for _ in range(15)) + " " + line * rng.randint(20, 60) + " ".join(rng.choice(words) for _ in range(15))) for d in range(20)]
    rows.append((50, "x y z " * 2_000))
    df = prepared(spark).createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = fmindex.without(df, fmindex.repeated(df))
    assert sorted(map(tuple, got.collect())) == brute(rows, 20)


def test_repeated_rows_and_ids(spark):
    rows = passages(4)
    spark = prepared(spark)
    twice = spark.createDataFrame(rows + [rows[0], rows[9], (None, rows[3][1])], "doc_id bigint, text string")
    got = fmindex.without(twice, fmindex.repeated(twice)).where("doc_id IS NOT NULL").distinct()
    assert sorted(map(tuple, got.collect())) == brute(rows, 20)
    clash = spark.createDataFrame([(1, "a b c " * 30), (1, "short"), (2, "a b c " * 12)], "doc_id bigint, text string")
    assert fmindex.without(clash, fmindex.repeated(clash)).count() == 3


def test_empty_table_and_other_columns(spark):
    df = prepared(spark).createDataFrame([], "doc_id bigint, text string, start string, anchor int, pieces int")
    assert fmindex.without(df, fmindex.repeated(df)).count() == 0


def test_backward_search_counts(spark):
    rng = np.random.default_rng(3)
    text = np.append(rng.integers(1, 5, 400), 0)
    index = fmindex.FMIndex(text, 8)
    ends = np.arange(6, 400)
    first = index.first_of_window(text, ends, 6)
    seen: dict = {}
    for e in ends:
        w = tuple(text[e - 6:e])
        assert first[e - 6] == seen.setdefault(w, e - 6)


def test_rank_of_wavelet_matrix():
    values = np.random.default_rng(4).integers(0, 300, 1000)
    m = fmindex.WaveletMatrix(values, 299)
    at = np.arange(0, 1001, 7)
    for s in (0, 5, 299):
        assert (m.rank(np.full(len(at), s), at) == [int((values[:a] == s).sum()) for a in at]).all()
