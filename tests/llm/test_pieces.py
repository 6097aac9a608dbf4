"""Piece ids against the library, on documents and odd texts, by both ways of encoding."""

import hashlib
import random

import numpy as np
import pytest

from eventlab.llm import catalog, pieces
from eventlab.llm.common import prepared

ODD = ["", " ", "   ", "a", " a  b\n\nc\t d é😀 ", "x" * 3000, "the" * 400, "▁▁a ▁", "\u0000a", "ﬁ Å", "a b", "   lead", "trail   ", "日本語テキスト", "🙂" * 200,
       "ab" * 40 + " " * 100, "\r\n\r\n", "<s> </s> <unk> <0x0A>", "a​b", " " * 500 + "a" + " " * 333]


@pytest.fixture(scope="module")
def vocab():
    return pieces.Vocabulary(catalog.piece_file())


def test_same_ids_as_the_library(vocab):
    rng = random.Random(3)
    made = ["".join(rng.choice("aehinorst  .,\n▁éß1") for _ in range(rng.randint(1, 300))) for _ in range(400)]
    for check in (True, False):
        vocab.known, vocab.older = {}, {}
        assert vocab.encode(ODD + made, check) == vocab.library.encode(ODD + made)


def test_both_ways_agree(vocab):
    rng = random.Random(4)
    words = [pieces.MARK + "".join(rng.choice("aehinorstl漢") for _ in range(rng.randint(1, 60))) for _ in range(500)] + [pieces.MARK]
    assert vocab._agendas(words) == [vocab._final(vocab._agenda(w)) for w in words]
    words.sort(key=len)
    assert vocab._agendas(words) == [vocab._final(vocab._agenda(w)) for w in words]


def test_every_merge_is_found(vocab):
    keys = np.array(list(vocab.merge), np.int64)
    entry, made = vocab._pairs(keys // vocab.size, keys % vocab.size, np.arange(len(keys)))
    assert [(int(e) >> 32, int(m)) for e, m in zip(entry, made)] == list(vocab.merge.values())
    left, right = np.random.default_rng(1).integers(0, vocab.size + 9, (2, 50_000))
    entry, _ = vocab._pairs(left, right, left)
    known = [int(a) * vocab.size + int(b) in vocab.merge and a < vocab.size and b < vocab.size for a, b in zip(left, right)]
    assert ((entry != pieces._NONE) == known).all()


def test_memory_is_bounded(vocab, monkeypatch):
    monkeypatch.setattr(pieces, "REMEMBERED", 50)
    texts = [f"word{k} and{k % 7}" for k in range(200)]
    assert [i for t in texts for i in vocab.encode([t])[0]] == [i for x in vocab.library.encode(texts) for i in x]
    assert len(vocab.known) <= 52 and len(vocab.older) <= 52


def test_a_difference_is_not_passed_over(vocab, monkeypatch):
    monkeypatch.setattr(pieces.Vocabulary, "_agendas", lambda self, stretches: [bytes([5, 0, 0, 0])] * len(stretches))
    fresh = pieces.Vocabulary(catalog.piece_file())
    with pytest.raises(ValueError, match="differ"):
        fresh.encode(["some words"])


def test_odd_rows(spark, vocab):
    rows = [(k, t, "x") for k, t in enumerate([*ODD, None, "same", "same"])] + [(None, "w " * 50_000, "x")]
    df = prepared(spark).createDataFrame(rows, "doc_id bigint, text string, ids string")
    got = pieces.encoded(df, catalog.piece_file()).collect()
    assert len(got) == len(rows)
    for r, (_, t, _) in zip(got, rows):
        ids = vocab.library.encode(t or "")
        assert (r.ids, r.n_tokens, r.decoded) == (ids, len(ids), vocab.library.decode(ids) if ids else "")
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert pieces.encoded(df.limit(0), catalog.piece_file()).collect() == []


def test_every_document(spark, data, vocab):
    text = {r.doc_id: r.text or "" for r in catalog.table(spark, data, "documents").collect()}
    got = catalog.QUERIES["op8_pieces"](spark, data).collect()
    assert len(got) == len(text)
    for r in got:
        ids = vocab.library.encode(text[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(vocab.library.decode(ids).encode()).hexdigest()
