"""Fixed patterns against the plain expressions, the random field against all paths and on new sentences."""

import itertools
import random
import re

import numpy as np
import pytest

from eventlab.llm import catalog, crf
from eventlab.llm.common import prepared


@pytest.fixture(scope="module")
def model():
    return crf.train(crf.labelled_rows())


def plain(text):
    """The fixed patterns as they are written down, by the standard library."""
    out = []
    tests = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 14 <= len(re.sub("[^0-9]", "", s)) <= 19 and crf.luhn(re.sub("[^0-9]", "", s))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 10 <= len(re.sub("[^0-9]", "", s)) <= 15),
    }
    for kind, (pattern, good) in tests.items():
        out += [(kind, m.start(), m.end()) for m in re.finditer(pattern, text) if good(m[0])]
    return sorted(out, key=lambda s: (s[1], crf.KINDS.index(s[0])))


@pytest.mark.parametrize("seed", range(4))
def test_fixed_patterns(seed):
    rng = random.Random(seed)
    parts = ["a", "b.c", "@", "@@", ".", "1", "12", "255", "256", "0001", "1.2.3.4", " ", "-", "+", "+4", "(5) ", "é", "%", "4111111111111111", "4111 1111-1111 1111", "x@y.z", "\n", "_"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 14)))
        assert crf.base_spans(text) == plain(text), text


def test_long_runs_take_linear_time():
    for text in ("1" * 200_000, "a" * 200_000 + "@", "a@" * 100_000, "1." * 100_000, "+1" * 100_000, "+1" + "(" * 200_000):
        crf.base_spans(text)


def test_viterbi_is_the_best_path(model):
    text = "re (at) lo 12"
    seq = crf.features(text, crf.tokens(text))[:4]

    def score(path):
        total = model.first[path[0]]
        for t, label in enumerate(path):
            total += sum(model.emit[f, label] for f in seq[t]) + (model.move[path[t - 1], label] if t else 0)
        return total

    best = max(itertools.product(range(len(crf.LABELS)), repeat=len(seq)), key=score)
    assert tuple(crf.viterbi(model, [seq, seq[:2]])[0]) == best


def test_new_sentences(model):
    rows = crf.labelled_rows(seed=77, each=8)
    got = [set(x) for x in crf.added_spans([t for t, _ in rows], [[] for _ in rows], model)]
    hit = sum(len(g & set(s)) for g, (_, s) in zip(got, rows))
    wrong = sum(len(g - set(s)) for g, (_, s) in zip(got, rows))
    assert hit >= 0.95 * sum(len(s) for _, s in rows) and wrong <= 2


def test_odd_rows(spark, model):
    rows = [(1, None, "x"), (2, "", "x"), (3, " \n", None), (4, "mail re.lo@mu.com or ke (at) sa (dot) com", "x"), (4, "mail re.lo@mu.com or ke (at) sa (dot) com", "x"),
            (None, "the " * 60_000 + "call (555) 123-4567 now", "x")]
    df = prepared(spark).createDataFrame(rows, "doc_id bigint, text string, spans string")
    got = crf.spans_of(df, model).collect()
    assert [len(r["base"]) for r in got] == [0, 0, 0, 1, 1, 0]
    assert [[s["kind"] for s in r["spans"]] for r in got] == [[], [], [], ["email", "email"], ["email", "email"], ["phone"]]
    for r in got:
        assert all(b in r["spans"] for b in r["base"])
    assert [s.end - s.start for s in got[5]["spans"]] == [14]
    mask = [r["text"] for r in crf.masked(df, model).collect()]
    assert mask[0] is None and mask[1] == "" and mask[3] == "mail [EMAIL] or [EMAIL]" and mask[5].endswith("call [PHONE] now")
    assert crf.spans_of(df.limit(0), model).collect() == [] and crf.masked(df.limit(0), model).collect() == []


def test_documents(spark, data):
    got = {r["doc_id"]: r for r in catalog.QUERIES["op5_personal_data"](spark, data).collect()}
    docs = catalog.table(spark, data, "documents").collect()
    assert len(got) == len(docs)
    for d in docs:
        want = plain(d["text"] or "")
        r = got[d["doc_id"]]
        assert [r[f"n_{k}"] for k in crf.KINDS] == [sum(s[0] == k for s in want) for k in crf.KINDS]
        assert set(crf.joined(want).split(",")) <= set(r["spans"].split(",")) or not want


def test_weights_follow_the_data():
    rows = [("a 1", [("ip", 2, 3)]), ("b 1", [("ip", 2, 3)]), ("a b", [])] * 5
    m = crf.train(rows, steps=60)
    text = "b 1"
    assert np.array_equal(crf.viterbi(m, [crf.features(text, crf.tokens(text))])[0], [0, crf.LABELS.index("B-ip")])


def test_digits_that_are_no_decimals(spark, model):
    texts = ["in 2019¹ and 10² of", "12 ① 13 ⑳ x", "5 ²³ m", "٣ 12 १२३ and ３", "call (555) 123-4567 ¹ now ②"]
    df = prepared(spark).createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = crf.spans_of(df, model).orderBy("doc_id").collect()
    assert [[s["kind"] for s in r["spans"]] for r in got] == [[], [], [], [], ["phone"]]
    assert [r["text"] for r in crf.masked(df, model).orderBy("doc_id").collect()] == [*texts[:4], "call [PHONE] ¹ now ②"]
