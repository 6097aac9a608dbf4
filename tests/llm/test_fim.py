"""Fill-in-the-middle against plain slicing of lists of units."""

import hashlib
import random
import re

import numpy as np
import pytest

from eventlab.llm import catalog, fim
from eventlab.llm.common import prepared

UNITS = {"lines": re.compile(r"[^\n]*\n|[^\n]+"), "words": re.compile(r"[^ \t\n\x0b\f\r]+[ \t\n\x0b\f\r]*"), "chars": re.compile(r"(?s).")}


def units_of(text, kind):
    found = UNITS[kind].findall(text)
    if kind == "words" and text:
        lead = len(text) - sum(map(len, found))
        found = [text[:lead] + found[0], *found[1:]] if found else [text]
    return found


def brute(doc_id, text, kind="lines", seed=7, rate=100, spm=50):
    """(n, form, prefix_chars, middle_chars, output) by slicing."""
    text = text or ""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]
    u = units_of(text, kind)
    a, b = sorted((h[0] % (len(u) + 1), h[1] % (len(u) + 1)))
    p, m, s = ("".join(x) for x in (u[:a], u[a:b], u[b:]))
    if not text or any(x in text for x in fim.MARKS) or h[2] % 100 >= rate:
        return len(u), "plain", None, None, text
    if h[3] % 100 < spm:
        return len(u), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(u), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def texts(seed):
    rng = random.Random(seed)
    alphabet = ["a", "é", "漢", "😀", " ", "\t", "\n", "\n", "\r", "<", "P", ">", "x"]
    rows = [(d, "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60)))) for d in range(150)]
    return rows + [(900, None), (901, ""), (902, "\n"), (903, "\n\n\n"), (904, "no end"), (905, " \t "), (906, "a <P> b\nc"), (907, "<M>"),
                   (908, "ends <\nP> <S"), (909, "ü" * 50_000 + "\n" + "wort " * 40_000), (None, "no\nid\nhere\n"), (5, rows[5][1]), (5, "other\ntext")]


@pytest.mark.parametrize("kind", ["lines", "words", "chars"])
@pytest.mark.parametrize("rate,spm", [(100, 50), (60, 0)])
def test_matches_slicing(spark, kind, rate, spm):
    rows = texts(1)
    df = prepared(spark).createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = fim.restored(fim.transformed(df, units=kind, rate=rate, spm=spm)).collect()
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(((r.doc_id, r.text, r.n_units, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got), key=key) == sorted(
        ((d, t, *brute(d, t, kind, rate=rate, spm=spm)) for d, t in rows), key=key)
    assert all(r.restored == (r.text or "") for r in got)
    assert {r.form for r in got} == ({"plain", "psm", "spm"} if spm else {"plain", "psm"})


def test_cuts_by_rank_and_bisection():
    rng = np.random.default_rng(5)
    parts = [bytes(rng.choice(np.frombuffer(b"ab \n", np.uint8), n)) for n in (0, 1, 300, 7, 0, 5_000)]
    data = np.frombuffer(b"".join(parts), np.uint8)
    offsets = np.cumsum([0] + [len(p) for p in parts])
    places = fim.Boundaries(data, offsets, "lines")
    n = places.units()
    assert n.tolist() == [len(units_of(p.decode(), "lines")) for p in parts]
    for k in (0, 1, 2, 40, 5_000):
        units = np.minimum(k, n)
        want = [int(o) + sum(map(len, units_of(p.decode(), "lines")[:u])) for o, p, u in zip(offsets, parts, units)]
        assert places.cut(units, n).tolist() == want


def test_marks_that_texts_and_other_marks_make_up(spark):
    df = prepared(spark).createDataFrame([(d, "x aa\nb a\n" * 3) for d in range(30)], "doc_id bigint, text string")
    got = fim.restored(fim.transformed(df, marks=("aba", "cc", "dd")), marks=("aba", "cc", "dd")).collect()
    assert all(r.restored == r.text for r in got)


def test_empty_table_clashing_columns_and_settings(spark):
    spark = prepared(spark)
    assert fim.restored(fim.transformed(spark.createDataFrame([], "doc_id bigint, text string"))).count() == 0
    df = spark.createDataFrame([(1, "a\nb\n", "old", 3, "kept")], "doc_id bigint, text string, form string, n_units int, `odd name` string")
    row = fim.transformed(df).first()
    assert (row.form, row.n_units, row["odd name"]) == (brute(1, "a\nb\n")[1], 2, "kept")
    for bad in ({"units": "pages"}, {"marks": ("a", "a", "b")}, {"text": "output"}):
        with pytest.raises(ValueError):
            fim.transformed(df, **bad)


def test_query(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = {(d, n, f, p, m, sha(o), sha(t or "")) for d, t in docs for n, f, p, m, o in [brute(d, t)]}
    assert {tuple(r) for r in catalog.QUERIES["op13_fill_middle"](spark, data).collect()} == want
