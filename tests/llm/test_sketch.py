"""Classes of near copies against all pairs."""

import random

import numpy as np
import pytest

from eventlab.llm import sketch
from eventlab.llm.common import least_ids, prepared


def brute(rows, percent, k=5):
    sets = {d: sketch._shingles(t, k) for d, t in rows}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return sorted((d, len(sets[d]), find(d), find(d) == d) for d in ids)


def corpus(seed):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    rows, d = [], 0
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.choice([3, 8, 60, 200]))]
        for _ in range(rng.randint(1, 9)):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 60))):
                w[rng.randrange(len(w))] = rng.choice(words)
            d += rng.randint(1, 5)
            rows.append((d, " ".join(w).title() if rng.random() < 0.3 else "\n".join(w)))
    rows += [(5000, None), (5001, ""), (5002, " \t"), (5003, "one"), (5004, "ONE"), (5005, rows[0][1]), (5006, rows[0][1])]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,percent", [(1, 85), (2, 80)])
def test_matches_all_pairs(spark, seed, percent):
    rows = corpus(seed)
    df = prepared(spark).createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = sketch.classes(df, percent)
    assert sorted(map(tuple, got.collect())) == brute(rows, percent)


def test_empty_table_and_other_columns(spark):
    df = prepared(spark).createDataFrame([], "doc_id bigint, text string, bucket string, component int, n int")
    assert sketch.classes(df).collect() == []


def test_sketches_fill_and_agree_like_the_sets():
    rng = np.random.default_rng(5)
    for n, shared in ((1, 1), (3, 2), (50, 45), (2000, 1500)):
        a = rng.integers(0, 2**63, n).astype(np.uint64)
        b = np.concatenate([a[:shared], rng.integers(0, 2**63, n - shared).astype(np.uint64)])
        x, y = sketch._rounds(a, 384), sketch._rounds(b, 384)
        assert (x != np.iinfo(np.uint64).max).all()
        alike = shared / (2 * n - shared)
        assert abs((x == y).mean() - alike) < 5 * (alike * (1 - alike) / 384) ** 0.5 + 1e-9


def test_least_ids_on_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, k) for k in range(101, 150)] + [(7, 7)]
    got = dict(least_ids(spark.createDataFrame(links, "a bigint, b bigint")).collect())
    assert got == {i: 1 for i in range(1, 41)} | {k: 100 for k in range(100, 150)}
