"""Counts against plain Python, binomial tails against exact sums, cutoffs on made labels, the query against SQL."""

import math
import random
from collections import Counter
from fractions import Fraction

import duckdb
import pytest

from eventlab.llm import catalog, rules
from eventlab.llm.common import prepared
from tools.check_oracle import TABLES, rows_of


def plain(text):
    words = (text or "").encode().split()
    windows = list(zip(words, words[1:], words[2:]))
    seen = Counter(windows)
    covered = {k + d for k, g in enumerate(windows) if seen[g] > 1 for d in range(3)}
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    return (len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered))


def texts(seed):
    rng = random.Random(seed)
    out = [None, "", " \n\t", "a", "a b", "a b c", "a a a a", "x y z x y z", "é ß\x0bü # | <b>!\n\n \nq\nq", "A\x85B\xa0C"]
    for _ in range(60):
        out.append("".join(rng.choice(["a", "b", "cc", "É"]) + rng.choice([" ", "  ", "\n", "\t"]) for _ in range(rng.randint(1, 60))))
    return out


@pytest.mark.parametrize("packed", [1 << 20, 1 << 4])
def test_counts(spark, monkeypatch, packed):
    monkeypatch.setattr(rules, "PACKED", packed)  # the smaller one sends longer texts the other way
    rows = list(enumerate(texts(1))) + [(999, "w " * 30_000)]
    df = prepared(spark).createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: tuple(r[1:6]) for r in rules.measured(df).collect()}
    assert got == {d: plain(t) for d, t in rows}


def test_windows_that_share_upper_bits(spark, monkeypatch):
    monkeypatch.setattr(rules, "PACKED", 1 << 62)  # two bits of hash are left, so nearly all windows clash
    rows = list(enumerate(texts(2)))
    df = prepared(spark).createDataFrame(rows, "doc_id bigint, text string")
    assert {r["doc_id"]: r["n_repeat_words"] for r in rules.measured(df).collect()} == {d: plain(t)[4] for d, t in rows}


def test_binomial_tail(spark):
    cases = [(0, 10), (1, 10), (0, 500), (3, 900), (7, 2000), (49, 10_000), (5000, 10_000)]
    df = spark.createDataFrame(cases, "k bigint, n bigint")
    got = {(r.k, r.n): r.p for r in df.select("k", "n", rules.binomial_tail("k", "n", 0.005).alias("p")).collect()}
    p = Fraction(5, 1000)
    for k, n in cases:
        want = 1.0 if k >= n * p else float(sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)))
        assert math.isclose(got[k, n], want, rel_tol=1e-9), (k, n)


def test_long_tails_are_never_too_low(spark, monkeypatch):
    full = spark.createDataFrame([(40, 10_000)], "k bigint, n bigint")
    whole = full.select(rules.binomial_tail("k", "n", 0.005)).first()[0]
    monkeypatch.setattr(rules, "TERMS", 12)
    cut = full.select(rules.binomial_tail("k", "n", 0.005)).first()[0]
    assert whole <= cut <= whole * 1.1


def test_cutoffs_need_enough_labels(spark):
    body = " ".join(f"w{k}" for k in range(60))
    rows = [(i, body, "aa") for i in range(2000)] + [(i, body + " ###" * 20, "aa") for i in range(2000, 2100)]
    rows += [(i, body, "bb") for i in range(3000, 3040)] + [(i, body + " ###" * 20, "bb") for i in range(3040, 3050)] + [(4000, body + " ###" * 20, None)]
    labels = [(i, int(t == body)) for i, t, lang in rows if lang] + [(5, 1), (None, 1), (6, 0), (7, None)]
    spark = prepared(spark)
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    done = rules.judged(df, spark.createDataFrame(labels, "doc_id bigint, quality int")).collect()
    dropped = {r["doc_id"] for r in done if not r["kept"]}
    assert dropped == set(range(2000, 2100))
    none = rules.judged(df, spark.createDataFrame([], "doc_id bigint, quality int"))
    assert none.where("NOT kept").count() == 0
    assert rules.judged(df.limit(0), spark.createDataFrame(labels, "doc_id bigint, quality int")).count() == 0


def test_odd_rows(spark):
    rows = [(1, None, None, 5), (1, "", "x", 5), (None, "a " * 60_000, "x", 5), (3, "a b", "x", 5), (3, "a b", "x", 5)]
    spark = prepared(spark)
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, n_words int")
    got = rules.judged(df, spark.createDataFrame([(3, 1)], "doc_id bigint, quality int")).collect()
    assert len(got) == 5 and all(r["base_failed"] and not r["kept"] for r in got)


def test_no_python_on_executors(spark, data):
    plan = catalog.QUERIES["op6_quality_rules"](spark, data)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_against_sql(spark, data):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    df = catalog.QUERIES["op6_quality_rules"](spark, data)
    rel = con.sql(catalog.RULES_SQL)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(rel.columns, rel.fetchall())
