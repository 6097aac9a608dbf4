"""Toxicity: averaged subword embeddings into a linear softmax, trained together in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _BYTES, Words, in_arrow, mixed, runs_hash, words_of

BUCKETS = 1 << 18  # subword vectors
WIDTH = 8  # numbers of a vector
SPAN = 5  # words that are averaged; a text scores as its worst span
# The training sample: at most so many labelled texts of each label, and so many bytes of text in all.
SAMPLE_TEXTS = 2_000
SAMPLE_BYTES = 10_000_000


def subwords(words: Words, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vector numbers of some words' character runs of 3 to 5 (with marked ends) and of the words themselves.

    Returns the numbers one after another and where each word's begin. Runs
    are of bytes, so an accented letter counts as two.
    """
    start, end = words.start[which], words.end[which]
    size = end - start + 2
    at = np.cumsum(size) - size
    text = np.empty(int(size.sum()), np.uint8)
    text[at], text[at + size - 1] = 2, 3  # marks of the ends
    inner = np.ones(len(text), bool)
    inner[at] = inner[at + size - 1] = False
    source = np.arange(len(text)) - np.repeat(at + 1, size) + np.repeat(start, size)
    text[inner] = words.data[source[inner]]
    values = _BYTES[text]
    owner, found = [np.arange(len(which))], [mixed(words.hash[which] + np.uint64(1))]
    for k in (3, 4, 5):
        count = np.maximum(size - k + 1, 0)
        begins = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(at, count)
        owner.append(np.repeat(np.arange(len(which)), count))
        found.append(runs_hash(values, begins, begins + k))
    owner, found = np.concatenate(owner), np.concatenate(found)
    order = np.argsort(owner, kind="stable")
    return (found[order] % np.uint64(BUCKETS)).astype(np.int64), np.searchsorted(owner[order], np.arange(len(which)))


@dataclass
class Model:
    """What is left of embeddings and softmax for two labels: a number for each vector, and one for every text."""

    weights: np.ndarray
    bias: float
    texts: int
    toxic: int


def _spans(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """First word and length of every span: runs of SPAN words of one text, or all words of a shorter one."""
    n = len(words) - SPAN + 1
    at = np.flatnonzero(words.row[:n] == words.row[SPAN - 1:]) if n > 0 else np.zeros(0, np.int64)
    count = np.diff(words.first)
    short = words.first[:-1][(count > 0) & (count < SPAN)]
    first = np.concatenate([at, short])
    length = np.concatenate([np.full(len(at), SPAN), count[(count > 0) & (count < SPAN)]])
    order = np.argsort(first, kind="stable")
    return first[order], length[order]


def _logits(word_logit: np.ndarray, words: Words, first: np.ndarray, length: np.ndarray, bias: float):
    """Logit of each text (its worst span; the bias where there is none), and that span."""
    n = len(words.offsets) - 1
    out, worst = np.full(n, bias), np.full(n, -1)
    if len(first):
        total = np.concatenate([[0], np.cumsum(word_logit)])
        mean = (total[first + length] - total[first]) / length
        row = words.row[first]
        begins = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        most = np.maximum.reduceat(mean, begins)
        out[row[begins]] = most + bias
        hit = np.flatnonzero(mean == np.repeat(most, np.diff(np.append(begins, len(row)))))
        worst[row[hit][::-1]] = hit[::-1]
    return out, worst


def train(texts: list[str], toxic: list[int], epochs: int = 14, seed: int = 11) -> Model:
    """Fit vectors and softmax together on whole texts.

    A text's output is that of its worst span, so a few words in a long text
    are not averaged away. In the first epochs all spans of a text share its label, to find a
    start; then gradients go to the worst spans alone.
    """
    rng = np.random.default_rng(seed)
    label = np.asarray(toxic, np.int64)
    column = pa.array([t or "" for t in texts], pa.string())
    parts = []  # (texts from, words, distinct, back, numbers, begins)
    for i, j, words in words_of(column, lower=True):
        _, one, back = np.unique(words.hash, return_index=True, return_inverse=True)
        number, begin = subwords(words, one)
        first, length = _spans(words)
        words.data = words.hash = words.start = words.end = words.start[:0]  # no longer needed
        parts.append((i, words, back.astype(np.int32), number.astype(np.int32), np.append(begin, len(number)), first, length.astype(np.int32)))
    vectors = rng.uniform(-1 / WIDTH, 1 / WIDTH, (BUCKETS, WIDTH)).astype(np.float32)
    out = rng.normal(0, 0.1, (WIDTH, 2)).astype(np.float32)
    bias = np.log(np.bincount(label, minlength=2) + 1.0)
    seen_v, seen_o = np.full(BUCKETS, 1e-6, np.float32), 1e-6
    for epoch in range(epochs):
        for p in rng.permutation(len(parts)):
            i, words, back, number, begin, first, length = parts[p]
            n = len(words.offsets) - 1
            if not len(first):
                continue
            lean = (vectors[number] @ (out[:, 1] - out[:, 0])).astype(np.float64)
            mean = np.add.reduceat(lean, begin[:-1]) / np.diff(begin)
            _, worst = _logits(mean[back], words, first, length, 0.0)
            if epoch < 3:  # any span, each time another
                row = words.row[first]
                cuts = np.searchsorted(row, np.arange(n + 1))
                picks = [np.where(cuts[1:] > cuts[:-1], cuts[:-1] + (rng.random(n) * np.diff(cuts)).astype(np.int64), -1) for _ in range(6)]
                pairs = [(np.arange(n), x) for x in picks]
            else:
                pairs = [(np.arange(n), worst)]
            for rows, spans in pairs:
                rows, spans = rows[spans >= 0], spans[spans >= 0]
                for batch in np.array_split(rng.permutation(len(rows)), max(1, len(rows) // 128)):
                    if not len(batch):
                        continue
                    r, s = rows[batch], spans[batch]
                    count = length[s]
                    word = back[np.repeat(first[s], count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)]
                    owner = np.repeat(np.arange(len(s)), count)
                    many = np.diff(begin)[word]
                    feature = number[np.repeat(begin[word], many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)]
                    share = np.repeat(1.0 / (many * count[owner]), many).astype(np.float32)
                    owner = np.repeat(owner, many)
                    rows_v = vectors[feature]
                    cut = np.searchsorted(owner, np.arange(len(s)))
                    hidden = np.add.reduceat(rows_v * share[:, None], cut, axis=0)
                    z = hidden @ out + bias
                    z -= z.max(axis=1, keepdims=True)
                    prob = np.exp(z)
                    prob /= prob.sum(axis=1, keepdims=True)
                    prob[np.arange(len(s)), label[i + r]] -= 1
                    grad_out = hidden.T @ prob / len(s)
                    grad_h = (prob @ out.T).astype(np.float32)
                    grad_v = grad_h[owner] * share[:, None]
                    np.add.at(seen_v, feature, (grad_v**2).mean(axis=1))
                    np.add.at(vectors, feature, -0.35 * grad_v / np.sqrt(seen_v[feature])[:, None])
                    seen_o += float((grad_out**2).mean())
                    out -= (0.15 * grad_out / np.sqrt(seen_o)).astype(np.float32)
                    bias -= 0.05 * prob.mean(axis=0)
    return Model((vectors @ (out[:, 1] - out[:, 0])).astype(np.float32), float(bias[1] - bias[0]), len(label), int(label.sum()))


def scores(column: pa.Array, model: Model) -> np.ndarray:
    """The probability of label 1 of each text of an Arrow column."""
    out = []
    for _, _, words in words_of(column, lower=True):
        _, one, back = np.unique(words.hash, return_index=True, return_inverse=True)
        if len(one):
            number, begin = subwords(words, one)
            mean = np.add.reduceat(model.weights[number].astype(np.float64), begin) / np.diff(np.append(begin, len(number)))
            word_logit = mean[back]
        else:
            word_logit = np.zeros(0)
        logit, _ = _logits(word_logit, words, *_spans(words), model.bias)
        out.append(1 / (1 + np.exp(-np.clip(logit, -500, 500))))
    return np.concatenate(out) if out else np.zeros(0)


def sample(docs: DataFrame, labels: DataFrame, text: str, label: str, texts: int, most_bytes: int) -> tuple[list, list]:
    """At most ``texts`` texts of each label and ``most_bytes`` of text in all, by the order of a hash of the id.

    Ids are drawn from the labels first, so of the texts only the drawn ones move (by a
    broadcast of at most four times ``texts`` ids). Ids with both labels are left out, texts longer than a
    twentieth of ``most_bytes`` passed over.
    """
    clear = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.min(label).cast("int").alias("label"), F.max(label).cast("int").alias("other"))
    clear = clear.where("label = other").select("doc_id", "label")
    got: tuple[list, list] = ([], [])
    for value in (0, 1):
        drawn = clear.where(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * texts)
        some = docs.select("doc_id", F.col(text).alias("text")).where(F.octet_length("text") <= most_bytes // 20)
        some = some.join(F.broadcast(drawn), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(texts)
        left = most_bytes // 2
        for row in some.select("text").collect():
            left -= len(row.text.encode())
            if left < 0:
                break
            got[0].append(row.text)
            got[1].append(value)
    return got


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "toxic", texts: int = SAMPLE_TEXTS, most_bytes: int = SAMPLE_BYTES) -> Model:
    """Train on a bounded sample (see ``sample``) of texts with a label of 0 or 1; both tables have ``doc_id``.

    Without a label of each kind the model scores every text alike, as the share of label 1.
    """
    x, y = sample(docs, labels, text, label, texts, most_bytes)
    if len(set(y)) < 2:
        share = (sum(y) + 0.5) / (len(y) + 1) if y else 0.0
        return Model(np.zeros(BUCKETS, np.float32), float(np.log(share / (1 - share))) if y else -10.0, len(y), sum(y))
    return train(x, y)


def scored(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``df`` with ``score``, the probability of label 1 of the whole text; a column of that name is replaced.

    Null and empty texts get the score of the bias alone. Rows stay as they
    are. No shuffle; the model is 1 MB whatever the table's size.
    """
    kept = [c for c in df.columns if c != "score"]
    base = df.select(*[f"`{c}`" for c in kept])
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema), "score double"])

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores(batch.column(kept.index(text)), model))], [*kept, "score"])

    return in_arrow(base, schema, run)
