"""Repeated lines against dictionaries; cuckoo filters against counters; insertions and deletions in any order."""

import random
from collections import Counter

import numpy as np
import pytest

from eventlab.llm import lines
from eventlab.llm.common import prepared

BLANK = " \t\n\x0b\f\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, docs=None, least_docs=3, least_chars=20):
    """(doc_id, n_lines, n_dropped, kept) of ``docs`` (or the rows) where the index holds ``rows``."""
    key = lambda line: line.strip(BLANK).translate(LOWER)
    seen, last = Counter(), {}
    for d, t in rows:
        if d is not None:
            for k in {key(x) for x in (t or "").split("\n")}:
                seen[k] += 1
                last[k] = max(d, last.get(k, d))
    out = []
    for d, t in rows if docs is None else docs:
        all_ = (t or "").split("\n")
        stay = [x for x in all_ if not (len(key(x)) >= least_chars and seen[key(x)] >= least_docs and d is not None and d < last[key(x)])]
        out.append((d, len(all_), len(all_) - len(stay), "\n".join(stay)))
    return sorted(out, key=str)


def corpus(seed, n=120):
    rng = random.Random(seed)
    pool = [f"A Shared Line With Number {k} " + "é" * (k % 3) for k in range(25)]
    pool += ["x" * 20, "X" * 19 + "y", "short", "", "é" * 19, "É" * 20, "ß" * 10, "\x0bTab Led Line Of Twenty\r", "line of twenty tab led"]
    rows = []
    for d in range(n):
        ls = [rng.choice(pool) for _ in range(rng.randint(0, 9))]
        ls = [rng.choice(["", " ", "\t"]) + (x.upper() if rng.random() < 0.2 and x.isascii() else x) + rng.choice(["", " \r", "\f"]) for x in ls]
        ls.append("THE Most Common Line Of All Of Them")
        rows.append((d * 7 % 1_000, "\n".join(ls)))
    rows += [(2_000, None), (2_001, ""), (2_002, "\n\n"), (2_003, "z " * 200_000 + "\n" + rows[3][1]), (None, rows[4][1]), rows[6], (rows[7][0], "only here is this text\n" + pool[2])]
    rng.shuffle(rows)
    return rows


def frame(spark, rows):
    return prepared(spark).createDataFrame(rows, "doc_id bigint, text string").repartition(4)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("shards,part", [(None, 25_000), (5, 20)])
def test_matches_brute_force(spark, monkeypatch, shards, part):
    monkeypatch.setattr(lines, "PART_ROWS", part)
    rows = corpus(1)
    df = frame(spark, rows)
    assert rows_of(lines.LineIndex(spark, shards=shards).insert(df).without(df)) == brute(rows)


def test_insertions_and_deletions(spark):
    rows = corpus(2)
    parts = [rows[:40], rows[40:41], rows[41:]]
    index = lines.LineIndex(spark, shards=3)
    for some in parts:
        index.insert(frame(spark, some))
    everything = frame(spark, rows)
    assert rows_of(index.without(everything)) == brute(rows)
    before = rows_of(index.drops())
    gone = [d for d, _ in parts[2] if d is not None][::2]
    index.delete(spark.createDataFrame([(d,) for d in gone + [gone[0], None, 77_777]], "doc_id bigint"))
    left = [r for r in rows if r[0] not in gone]
    assert rows_of(index.without(frame(spark, left))) == brute(left)
    # A document that comes back finds the index as it was.
    index.insert(frame(spark, [r for r in rows if r[0] in gone]))
    assert rows_of(index.drops()) == before
    # All but two documents go: no line is repeated, and filters hold what is left alone.
    index.delete(everything.where("doc_id > 7").select("doc_id"))
    assert index.drops().count() == 0
    totals = {(r.key_a, r.key_b): r.n for r in index._latest().collect()}
    held = sum(int((lines.CuckooFilter(r.data).layers[0] > 0).sum()) for r in index._filters().collect() if r.data)
    assert held == sum(min(n, 3) for n in totals.values())


def test_reopened_and_a_generation_that_was_not_committed(spark):
    rows = corpus(3, 40)
    index = lines.LineIndex(spark, least_docs=2, least_chars=5).insert(frame(spark, rows[:25]))
    broken = lines.LineIndex.at(spark, index.folder)
    broken._write("refs", lines._REFS, spark.createDataFrame([(1, 2, 3)], lines._REFS))  # lost before its commit
    again = lines.LineIndex.at(spark, index.folder)
    assert (again.generation, again.shards, again.least_docs) == (1, index.shards, 2)
    again.insert(frame(spark, rows[25:]))
    assert rows_of(again.without(frame(spark, rows))) == brute(rows, least_docs=2, least_chars=5)
    assert rows_of(lines.LineIndex.at(spark, index.folder).drops()) == rows_of(again.drops())


def test_other_documents_lose_nothing(spark):
    rows = corpus(4, 30)
    index = lines.LineIndex(spark).insert(frame(spark, rows))
    other = [(-5, rows[0][1])]
    assert rows_of(index.without(frame(spark, other)))[0][2] == 0


def test_empty_table_and_other_columns(spark):
    spark = prepared(spark)
    empty = spark.createDataFrame([], "doc_id bigint, text string, key_a string, cut int, shard string, n int, last int")
    index = lines.LineIndex(spark)
    assert index.without(empty).count() == 0 and index.delete(spark.createDataFrame([], "doc_id bigint")).generation == 0
    assert index.insert(empty).without(empty).count() == 0
    rows = corpus(5, 30)
    wide = frame(spark, rows).selectExpr("*", "'x' AS key_a", "1 AS cut", "2 AS n", "3 AS last")
    assert rows_of(index.insert(wide).without(wide)) == brute(rows)


def test_filter_counts_what_was_added():
    rng = np.random.default_rng(6)
    held, want = lines.CuckooFilter(), Counter()
    for _ in range(12):
        keys = rng.integers(0, 2**63, 4_000).astype(np.uint64)
        copies = rng.integers(1, 4, len(keys))
        held.add(keys, copies)
        want.update(dict(zip(keys.tolist(), copies.tolist())))
        some = rng.choice(np.array(list(want), np.uint64), 1_500, replace=False)
        less = np.array([rng.integers(0, want[int(k)] + 1) for k in some])
        held.remove(some, less)
        for k, n in zip(some.tolist(), less.tolist()):
            want[k] -= n
        held = lines.CuckooFilter(held.tobytes())
    keys = np.array(list(want), np.uint64)
    exact = np.array([want[int(k)] for k in keys])
    assert len(held.layers) > 3 and (held.count(keys) >= exact).all()
    assert sum(int((x > 0).sum()) for x in held.layers) == exact.sum()
    assert (held.count(keys) > exact).mean() < 0.02
    held.remove(keys, exact)
    assert not any(x.any() for x in held.layers)
    with pytest.raises(ValueError):
        held.remove(keys[:1], np.array([1]))
