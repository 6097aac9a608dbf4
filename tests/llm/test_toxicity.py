"""Toxicity on labelled texts made here, and on held-out rows of the test table."""

import math
import random

import pyarrow as pa
import pytest

from eventlab.llm import catalog, toxicity
from eventlab.llm.common import _BYTES, prepared

BAD = ["grobzak", "venomish", "snarltwit", "dreckling"]


def corpus(n, seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abdeilmnorst") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    rows = []
    for i in range(n):
        w = [rng.choice(words) for _ in range(rng.randint(1, 200))]
        if i % 3 == 0:
            w[rng.randrange(len(w))] = rng.choice(BAD)
        rows.append((i, " ".join(w), int(i % 3 == 0)))
    return rows


@pytest.fixture(scope="module")
def model():
    rows = corpus(600, 1)
    return toxicity.train([r[1] for r in rows], [r[2] for r in rows])


def test_new_texts_and_misspellings(model):
    rows = corpus(300, 2)
    got = toxicity.scores(pa.array([r[1] for r in rows]), model)
    right = sum((s >= 0.5) == r[2] for s, r in zip(got, rows))
    assert right >= 285
    clean = " ".join(w for w in rows[1][1].split())
    wrong = toxicity.scores(pa.array([f"{clean} grobbzak {clean}", f"{clean} venomiish"]), model)
    assert (wrong >= 0.5).all()


MASK = (1 << 64) - 1
ODD = 0x9E3779B97F4A7C15


def mixed(h):
    for by in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        h = (h ^ h >> 33) * by & MASK
    return h ^ h >> 33


def run_hash(values):
    """Of a run of whole numbers: halves, quarters and so on, by whole numbers of any size."""
    seed = mixed(1)

    def level(run):
        return mixed(run[0] ^ seed) if len(run) == 1 else mixed((level(run[:len(run) // 2]) * ODD + level(run[len(run) // 2:])) & MASK)

    w = 1 << len(values).bit_length() - 1
    return mixed((mixed((level(values[:w]) * ODD + len(values)) & MASK) * ODD + level(values[-w:])) & MASK)


def word_hash(word):
    h = mixed(len(word) + 1)
    for i in range(0, len(word), 8):
        h = mixed((h * ODD & MASK) ^ int.from_bytes(word[i:i + 8], "little"))
    return h


def brute_score(text, model):
    """Score of a text, word by word: subwords of each word, means of five words in a row, the worst of them."""
    logits = []
    for word in text.lower().encode().split():
        marked = [int(_BYTES[b]) for b in b"\x02" + word + b"\x03"]
        numbers = [mixed((word_hash(word) + 1) & MASK)] + [run_hash(marked[i:i + k]) for k in (3, 4, 5) for i in range(len(marked) - k + 1)]
        logits.append(sum(float(model.weights[n % toxicity.BUCKETS]) for n in numbers) / len(numbers))
    spans = [logits[i:i + toxicity.SPAN] for i in range(max(1, len(logits) - toxicity.SPAN + 1))] if logits else []
    worst = max((sum(s) / len(s) for s in spans), default=0.0)
    return 1 / (1 + math.exp(-worst - model.bias))


def test_scores_against_plain_python(model):
    texts = [r[1] for r in corpus(60, 3)] + ["", " ", "grobzak", "Grobzak grobzak!", "é ü ß", "x " * 30, "a\tb\nc d  e f", "verylongwordwithoutend" * 11]
    got = toxicity.scores(pa.array(texts), model)
    assert max(abs(a - brute_score(t, model)) for a, t in zip(got, texts)) < 1e-6


def test_odd_rows(spark, model):
    rows = [(1, None, "x"), (2, "", "y"), (3, " \n", None), (4, "a " * 60_000, "z"), (4, "grobzak", "z"), (None, "Grobzak", "z")]
    df = prepared(spark).createDataFrame(rows, "doc_id bigint, text string, score string")
    got = toxicity.scored(df, model).collect()
    assert len(got) == 6 and all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got[:3]}) == 1
    assert got[4]["score"] == got[5]["score"] > 0.5
    assert toxicity.scored(df.limit(0), model).count() == 0


def test_no_labels_to_learn_from(spark):
    spark = prepared(spark)
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "c"), (4, "c")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, 0), (1, 0), (2, None), (3, 1), (4, 0), (4, 1), (9, 1), (None, 1)], "doc_id bigint, toxic int")
    model = toxicity.fit(docs, labels)
    assert model.bias < 0 and (model.texts, model.toxic) == (1, 0)
    assert toxicity.fit(docs.limit(0), labels).bias < 0 and toxicity.fit(docs, labels.limit(0)).bias < 0


def test_held_out_rows(spark):
    data = "/root/testdata/sf0.01"  # the smaller table has some forty rows to learn from
    got = catalog.QUERIES["op2_toxicity"](spark, data)
    labels = catalog.table(spark, data, "labels")
    rows = got.where("held_out").join(labels, "doc_id").select("predicted", "toxic").collect()
    assert sum(r.predicted == r.toxic for r in rows) >= 0.95 * len(rows)
    assert got.count() == catalog.table(spark, data, "documents").count()
