"""Items in documents against all pairs of exact sets, and against SQL on the test tables."""

import random

import duckdb
import pytest

from eventlab.llm import catalog, containment
from eventlab.llm.common import prepared
from tools.check_oracle import TABLES, rows_of


def shingles(text, k=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)}


def brute(docs, items, percent=80):
    out = []
    for d, t in docs:
        for i, x in items:
            own = shingles(x)
            shared = len(own & shingles(t))
            if own and 100 * shared >= percent * len(own):
                out.append((d, i, shared, len(own)))
    return sorted(out, key=str)


def tables(seed):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(900)]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    items = [(i, text(rng.choice([2, 5, 6, 9, 14, 30, 59, 200]))) for i in range(40)]
    docs = []
    for d in range(120):
        w = text(rng.choice([0, 20, 100, 3000]))
        for _ in range(rng.randint(0, 2)):
            x = list(rng.choice(items)[1])
            if rng.random() < 0.5:
                x[rng.randrange(len(x))] = "zz"
            if rng.random() < 0.2:  # in two places
                half = len(x) // 2
                w = x[:half + 4] + w + x[half:]
            else:
                at = rng.randint(0, len(w))
                w = w[:at] + x + w[at:]
        docs.append((d, (" " if rng.random() < 0.5 else "\n").join(w).upper() if rng.random() < 0.3 else " ".join(w)))
    docs += [(None, " ".join(items[3][1])), (500, None), (501, ""), (502, "one two"), (7, docs[7][1]), (7, docs[7][1])]
    items = [(i, " ".join(x)) for i, x in items] + [(100, None), (101, ""), (102, "one two"), (None, docs[0][1] + " a b c d e f"), (3, " ".join(items[3][1]))]
    return docs, items


@pytest.mark.parametrize("seed,most", [(1, 20_000), (2, 9)])
def test_matches_all_pairs(spark, monkeypatch, seed, most):
    monkeypatch.setattr(containment, "BLOCK_ITEMS", most)
    docs, items = tables(seed)
    spark = prepared(spark)
    d = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    b = spark.createDataFrame(items, "item_id bigint, text string")
    want = brute(docs, items)
    assert sorted(map(tuple, containment.leaks(d, b).collect()), key=str) == want
    left = containment.clean(d, b).collect()
    bad = {w[0] for w in want}
    assert sorted(map(tuple, left), key=str) == sorted([x for x in docs if x[0] not in bad], key=str)


def test_empty_tables_and_other_columns(spark):
    spark = prepared(spark)
    docs = spark.createDataFrame([(1, "a b c d e f", "x")], "doc_id bigint, text string, item_id string")
    items = spark.createDataFrame([(1, "a b c d e f", "x")], "item_id bigint, text string, doc_id string")
    assert containment.leaks(docs.limit(0), items).collect() == [] and containment.leaks(docs, items.limit(0)).collect() == []
    assert containment.clean(docs, items.limit(0)).count() == 1 and containment.clean(docs, items).columns == docs.columns


def test_against_sql(spark, data):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    df = catalog.QUERIES["op9_contamination"](spark, data)
    rel = con.sql(catalog.LEAKS_SQL)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(rel.columns, rel.fetchall())
