"""Language models: probabilities against a plain computation, and held-out accuracy."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from eventlab.llm import catalog, langid
from eventlab.llm.common import prepared, words_of

TEXTS = {"aa": "tara rata tat ara taratara rat tar at ta" * 3, "bb": "bolo lobo obol bol lob olob bobo lolo" * 3}


def model():
    counts = {}
    for lang, text in TEXTS.items():
        total = Counter()
        for _, _, words in words_of(pa.array([text])):
            gram, _ = langid.grams_of(words, np.arange(len(words)))
            total.update(gram.tolist())
        counts[lang] = (np.array(list(total), np.uint64), np.array(list(total.values())))
    return langid.build(counts)


def plain(counts, gram, order, alphabet):
    """Interpolated Kneser-Ney by the book, from Counters of each order."""
    if order == 0:
        return 1 / alphabet
    table = counts[order]
    lower = plain(counts, gram[1:], order - 1, alphabet)
    total = sum(n for g, n in table.items() if g[:-1] == gram[:-1])
    if not total:
        return lower
    once, twice = sum(n == 1 for n in table.values()), sum(n == 2 for n in table.values())
    d = min(0.95, max(0.1, once / max(1, once + 2 * twice)))
    kinds = sum(g[:-1] == gram[:-1] for g in table)
    return max(table.get(gram, 0) - d, 0) / total + d * kinds / total * lower


def symbols(packed):
    return tuple((int(packed) >> (12 * k)) & 4095 for k in range(4, -1, -1))


def test_probabilities_by_the_book():
    m = model()
    by_lang, alphabet = {}, round(float(np.exp(-m.floor)))
    for lang, text in TEXTS.items():
        counts = {5: Counter()}
        for _, _, words in words_of(pa.array([text])):
            counts[5].update(map(symbols, langid.grams_of(words, np.arange(len(words)))[0]))
        for order in range(4, 0, -1):
            counts[order] = Counter(g[1:] for g in counts[order + 1])
        by_lang[lang] = counts
    for _, _, words in words_of(pa.array(["tara lobo tabo zzz rb"])):
        gram, _ = langid.grams_of(words, np.arange(len(words)))
    got = m.log_prob(gram)
    for k, lang in enumerate(m.langs):
        want = [np.log(plain(by_lang[lang], symbols(g), 5, alphabet)) for g in gram]
        assert np.allclose(got[:, k], want, atol=1e-4)


def test_probabilities_sum_to_one():
    m = model()
    for head in (0, 1 << 12 | 0, int(langid.grams_of(next(words_of(pa.array(["tar"])))[2], np.array([0]))[0][2]) >> 12):
        last = np.arange(4096, dtype=np.uint64) | np.uint64(head << 12)
        known = m.log_prob(last)
        alphabet = np.exp(-m.floor)
        seen = np.unique(np.concatenate([langid.grams_of(w, np.arange(len(w)))[0] & np.uint64(4095) for t in TEXTS.values() for _, _, w in words_of(pa.array([t]))]))
        mass = np.exp(known[seen.astype(int)].astype(float)).sum(axis=0) + (alphabet - len(seen)) * np.exp(known[4000].astype(float))
        assert np.allclose(mass, 1, atol=1e-3)


def test_odd_rows(spark):
    m = model()
    m.limits = (3.0, 3.0)
    rows = [(1, None, "x"), (2, "", "x"), (3, "12 34 !!", "x"), (4, "Tara", "x"), (4, "Tara", "x"), (None, "LOBO bolo", "x"), (7, "olob " * 50_000, "x"), (8, "qqqq xxxx", "x")]
    df = prepared(spark).createDataFrame(rows, "doc_id bigint, text string, score string")
    got = langid.identified(df, m).collect()
    assert [r["lang_pred"] for r in got[:7]] == ["und"] * 3 + ["aa", "aa", "bb", "bb"]
    assert [r["score"] for r in got[:3]] == [0, 0, 0] and all(0.5 < r["score"] <= 1 for r in got[3:7])
    assert got[7]["rejected"] and not got[3]["rejected"]
    assert langid.identified(df.limit(0), m).count() == 0


def random_texts(seed, langs=3, n=40):
    rng = np.random.default_rng(seed)
    letters = [list("abcdefghijklmnop"), list("efghijklmnopqrst"), list("ijklmnopqrstuvwé")]
    rows = [(d, " ".join("".join(rng.choice(letters[d % langs], rng.integers(1, 8))) for _ in range(60)), f"l{d % langs}") for d in range(n)]
    return rows + [(None, "tara 12 !! tara", "l1"), (90, None, "l0"), (91, "", "l0"), (92, "12 !", "l0"), (93, "tara tara", None), (94, rows[0][1], "l0")]


def test_all_runs_are_kept_at_any_size(spark, monkeypatch):
    spark = prepared(spark)
    df = spark.createDataFrame(random_texts(1), "doc_id bigint, text string, lang string").repartition(3)
    whole = langid.fit(df, df)
    want = langid.identified(df, whole).collect()
    for name, value in (("CELLS", 50), ("GRAMS", 30), ("RUNS", 30), ("COMMON", 7)):
        monkeypatch.setattr(langid, name, value, raising=False)
    model = langid.fit(df, df)
    assert model.sharpness == whole.sharpness and np.allclose(model.limits, whole.limits, atol=1e-4)
    got = langid.identified(df, model).collect()
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "")
    assert len(got) == len(want)
    for a, b in zip(sorted(got, key=key), sorted(want, key=key)):
        assert a[:4] == b[:4] and a["rejected"] == b["rejected"] and abs(a["score"] - b["score"]) < 1e-3
        assert a["entropy"] == b["entropy"] or abs(a["entropy"] - b["entropy"]) < 1e-4


def test_no_cap_on_the_runs_of_a_language(spark):
    rng = np.random.default_rng(2)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    rows = [(" ".join("".join(w) for w in letters[rng.integers(0, 26, (3_000, 8))]), "l") for _ in range(12)]
    df = prepared(spark).createDataFrame(rows, "text string, lang string")
    want = langid.gram_counts(df).count()
    assert want > 200_000
    assert len(langid.fit(df, df.limit(1)).grams[-1][0]) == want + 1


def test_nothing_to_learn_from(spark):
    df = prepared(spark).createDataFrame([(None, "aa"), ("x", None)], "text string, lang string")
    m = langid.fit(df, df)
    assert [r["lang_pred"] for r in langid.identified(df, m).collect()] == ["und", "und"]


@pytest.mark.parametrize("name", ["op1_language"])
def test_held_out_rows(spark, data, name):
    got = catalog.QUERIES[name](spark, data)
    docs = catalog.table(spark, data, "documents")
    rows = got.join(docs.select("doc_id", "lang"), "doc_id").where("held_out AND lang IS NOT NULL").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in rows) >= 0.97 * len(rows)
    assert got.count() == docs.count()
