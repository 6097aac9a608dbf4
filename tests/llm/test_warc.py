"""Revisits against a plain walk through each address's records, addresses, headers, and the query against SQL."""

import datetime as dt
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from eventlab.llm import catalog, warc
from eventlab.llm.common import prepared
from tools.check_oracle import TABLES, rows_of

SCHEMA = "record_id bigint, url string, captured_at timestamp, kind string, headers array<struct<name:string,value:string>>, part int, at string"


def day(n):
    return dt.datetime(2024, 1, 1) + dt.timedelta(hours=n)


def test_addresses(spark):
    cases = {
        "http://www.Example.com:80/a/b/?b=2&a=1&utm_source=x#top": "example.com/a/b?a=1&b=2", "https://example.com": "example.com/",
        "HTTPS://me:pw@EXAMPLE.com:443//": "example.com/", "http://example.com:8080/A": "example.com:8080/A", " no address#x ": "no address ".strip(),
        "http://example.com?ref=me&Fbclid=1": "example.com/", "": None, "#x": None, None: None, "http://e.com/?q=a?b": "e.com/?q=a?b",
    }
    df = spark.createDataFrame([(k,) for k in cases], "url string")
    assert {r.url: r.c for r in df.select("url", warc.canonical(F.col("url")).alias("c")).collect()} == cases


@pytest.mark.parametrize("seed", [1, 2])
def test_against_a_plain_walk(spark, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(400):
        url = rng.choice(["http://hot.com/x?ref=%d" % i] * 3 + ["https://www.hot.com/x/", "http://a.com/%d" % rng.randrange(40), None, ""])
        tag = rng.choice(['"a"', '"b"', 'W/"a"', None])
        headers = [("ETag", tag)] if tag else []
        headers += [("last-Modified", rng.choice("xy"))] if rng.random() < 0.5 else []
        headers += [("Date", str(i)), ("Content-Length", "1"), ("X-Own", str(i)), (None, "q"), ("Vary", None)]
        rows.append((i, url, day(rng.randrange(60)) if rng.random() < 0.97 else None, rng.choice(["response", "revisit", "revisit", "request"]),
                     headers if rng.random() < 0.95 else None, 1, "x"))
    rng.shuffle(rows)
    df = prepared(spark).createDataFrame(rows, SCHEMA).repartition(5)
    key = {r.record_id: r.k for r in df.select("record_id", warc.canonical(F.col("url")).alias("k")).collect()}
    first = lambda h, n: next((v.strip() for k, v in h or [] if k and k.lower() == n and v), None)
    want, last = [], {}
    for i, _, at, kind, headers, *_ in sorted(rows, key=lambda r: (r[2] or day(0), r[0])):
        usable = key[i] is not None and at is not None
        if kind == "response" and usable:
            last[key[i]] = (i, headers)
        elif kind == "revisit":
            old, stored = last.get(key[i], (None, None)) if usable else (None, None)
            tag, old_tag, date, old_date = first(headers, "etag"), first(stored, "etag"), first(headers, "last-modified"), first(stored, "last-modified")
            bare = lambda t: (t or "").removeprefix("W/")
            if tag:
                good = old_tag is not None and bare(tag) == bare(old_tag) and (tag.startswith("W/") or not old_tag.startswith("W/"))
            else:
                good = date == old_date if date else not old_tag and not old_date
            outcome = "none" if old is None else "resolved" if good else "mismatch"
            if outcome == "resolved":
                new = [h for h in headers or [] if h[0] and h[0].lower() in warc.PERMITTED]
                names = {h[0].lower() for h in new}
                headers = [h for h in stored or [] if h[0] is None or h[0].lower() not in names] + new
            want.append((i, key[i], outcome, old, headers))
    got = [(r.record_id, r.url_key, r.outcome, r.response_id, None if r.headers is None else [tuple(h) for h in r.headers]) for r in warc.resolved(df).collect()]
    assert sorted(got) == sorted(want)


def test_empty_table(spark):
    df = prepared(spark).createDataFrame([], SCHEMA)
    assert warc.resolved(df).collect() == []


def test_payload_of_resolved_revisits(spark):
    spark = prepared(spark)
    found = spark.createDataFrame([(1, "resolved", 7), (2, "mismatch", 7), (3, "none", None)], "record_id bigint, outcome string, response_id bigint")
    bodies = spark.createDataFrame([(7, "b")], "response_id bigint, body string")
    assert {r.record_id: r.body for r in warc.with_payload(found, bodies).collect()} == {1: "b", 2: None, 3: None}


def test_against_sql(spark, data):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    df = catalog.QUERIES["op3_revisits"](spark, data)
    rel = con.sql(catalog.REVISITS_SQL)
    got = [tuple(r) for r in df.collect()]
    assert rows_of(df.columns, got) == rows_of(rel.columns, rel.fetchall())
    assert {"resolved", "mismatch", "none"} == {r[df.columns.index("outcome")] for r in got}
