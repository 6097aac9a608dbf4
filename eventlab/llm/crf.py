"""Personal data: exact patterns, and a linear-chain conditional random field over word shapes."""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import in_arrow

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *(f"{x}-{k}" for k in KINDS for x in "BI"))
FEATURES = 1 << 13
AROUND = 8  # tokens on each side of one that could belong to personal data
# Cells (tokens times labels) of one numpy pass.
CELLS = 400_000

# Fixed patterns: what they match is personal data if the check that follows holds.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

_TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]|_")
# Only near such tokens is anything decoded: digits, the sign, and written-out signs in brackets.
_TRIGGER = re.compile(r"[0-9@]+|[(\[{<]\s?(?:at|dot|AT|DOT)\s?[)\]}>]")
_CUES = frozenset("at dot mail email e contact write reach phone tel telephone call fax mobile cell ip host server address card visa account".split())


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if k % 2 == 0 else 2 * n - 9 * (n > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the fixed patterns (leftmost, not overlapping within a kind), by start and kind."""
    out = []
    at, behind = text.find("@"), 0
    while at >= 0:
        start = at
        while start > behind and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append(("email", start, found.end()))
            behind = found.end()
        at = text.find("@", max(at + 1, behind))
    if _DIGIT.search(text):
        out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x) <= 255 for x in m[0].split("."))]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
        if "+" in text:
            out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def labelled_rows(seed: int = 5, each: int = 14) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """The labelled table the model learns from: sentences with (kind, start, end) of their personal data.

    Made from a few sentence frames and ways of writing, with and without
    personal data; always the same rows.
    """
    rng = random.Random(seed)
    pick = rng.choice
    num = lambda n: "".join(pick("0123456789") for _ in range(n))
    word = lambda: "".join(pick(["an", "re", "lo", "ti", "mu", "ke", "sa", "do", "vi", "ber"]) for _ in range(rng.randint(1, 4)))

    def card() -> str:
        body = pick("3456") + num(14)
        return next(body + c for c in "0123456789" if luhn(body + c))

    def value(kind: str) -> str:
        octet = lambda: str(rng.randint(0, 255))
        if kind == "email":
            name, site, end = pick([word(), word() + "." + word(), word() + num(2)]), word(), pick(["com", "org", "net", "de", "example.com"])
            return pick([f"{name}@{site}.{end}", f"{name} (at) {site} (dot) {end}", f"{name} [at] {site} [dot] {end}", f"{name}(at){site}.{end}",
                         f"{name} @ {site}.{end}", f"{name} [at] {site}.{end}"])
        if kind == "ip":
            return pick(["{}.{}.{}.{}", "{}[.]{}[.]{}[.]{}", "{} . {} . {} . {}", "{}.{}.{}[.]{}"]).format(octet(), octet(), octet(), octet())
        if kind == "card":
            c = card()
            four = [c[:4], c[4:8], c[8:12], c[12:]]
            return pick([c, " ".join(four), "-".join(four), ".".join(four), "/".join(four)])
        a, b, c = num(3), num(3), num(4)
        return pick([f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+{num(2)} {num(3)} {num(7)}", f"00{num(2)} {num(3)} {num(6)}", f"+1-{a}-{b}-{c}", f"({a}) {b} {c}"])

    frames = {
        "email": ["{} write to {} today", "mail {}: {}", "{} of {} and the", "contact {} at {}, please."],
        "ip": ["{} host {} was", "from {} by {} the", "ip {} : {}", "server {} {} down"],
        "card": ["{} card {} of", "{} the {} and", "visa {} no {}", "{}, {} paid"],
        "phone": ["{} call {} now", "tel {} {}", "{} phone: {} and", "{} at {} of"],
    }
    none = ["on 2024-05-17 at 10:30 the {}", "version 1.2.3.4.5 of {}", "{} costs 1,299.00 now", "isbn 978-3-16-148410-{} in", "the {} (at) home", "{} in 1999 and 2001",
            "password=9c82e4685ca7e26784 {}", "{} token a3d0b907ff {}", "{} 12 of 15 {}", "section 3.2.1 and {}", "{} (dot) the and", "{} at the {} of", "order 1234567 of {}",
            "{} 5551234 and {}", "id 12345678901234567890 {}", "{} 2023/11/05 {}", "call {} at noon", "{} 300.400.500.600 {}", "@{} said {}", "{} 50% of 3.5 {}", "no. {} 4711-0815 {}",
            "page 12-14 of {}", "{} 1 2 3 4 5 6 7 {}", "{}: 3 [at] noon", "key \"9f86d081884c7d65\" {}", "{} 100.000.000 {}", "from 1990-2000 {} at 12:00:01.234"]
    rows = []
    for kind in KINDS:
        for _ in range(4 * each):
            frame, v, w = pick(frames[kind]), value(kind), " ".join(word() for _ in range(rng.randint(1, 3)))
            head = frame.split("{}")[0] + w + frame.split("{}")[1]
            rows.append((head + v + frame.split("{}")[2], [(kind, len(head), len(head) + len(v))]))
    for _ in range(each):
        rows += [(f.replace("{}", " ".join(word() for _ in range(rng.randint(1, 4)))), []) for f in none]
    return rows


def labelled_table(spark: SparkSession) -> DataFrame:
    """``labelled_rows`` as a table (text, spans)."""
    return spark.createDataFrame(labelled_rows(), "text string, spans array<struct<kind:string,start:int,end:int>>")


def tokens(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _TOKEN.finditer(text)]


def _shape(token: str) -> str:
    if token.isdecimal():  # what int() reads; superscripts and circled digits are none of these
        return f"9{min(len(token), 9)}"
    if token.isalpha():
        low = token.lower()
        return low if low in _CUES and len(low) > 1 else ("Xx" if token[0].isupper() else "x") + ("1" if len(token) == 1 else "")
    return token


def features(text: str, spans: list[tuple[int, int]]) -> list[list[int]]:
    """Numbers of the features of each token: shapes of it and its neighbours, alone and in pairs, and gaps."""
    shape = ["^^", "^"] + [_shape(text[a:b]) for a, b in spans] + ["$", "$$"]
    gap = [" " if k and spans[k][0] > spans[k - 1][1] else "" for k in range(len(spans))] + [" "]
    out = []
    for k, (a, b) in enumerate(spans):
        p2, p, s, n, n2 = shape[k:k + 5]
        octet = "o" if s[0] == "9" and b - a <= 3 and int(text[a:b]) <= 255 else ""
        names = (f"s{s}", f"p{p}", f"n{n}", f"a{p2}|{p}", f"b{n}|{n2}", f"c{p}{gap[k]}|{s}", f"d{s}|{gap[k + 1]}{n}", f"e{p}|{s}|{n}", f"f{p2}|{p}|{s}",
                 f"g{s}|{n}|{n2}", f"o{octet}{s[0]}", f"w{gap[k]}|{gap[k + 1]}|{s[0]}", f"h{p2}|{s}|{n2}")
        out.append([_number(x) for x in names])
    return out


@lru_cache(maxsize=100_000)
def _number(name: str) -> int:
    return int.from_bytes(hashlib.blake2b(name.encode(), digest_size=4).digest(), "little") % FEATURES


@dataclass
class Model:
    """Weights of features by label, of label pairs, and of first labels."""

    emit: np.ndarray
    move: np.ndarray
    first: np.ndarray


def _allowed() -> tuple[np.ndarray, np.ndarray]:
    """Pairs of labels that can follow each other, and labels that can come first: inside goes on from its own kind."""
    move, first = np.zeros((len(LABELS), len(LABELS))), np.zeros(len(LABELS))
    for j, b in enumerate(LABELS):
        if b[0] == "I":
            first[j] = -1e4
            for i, a in enumerate(LABELS):
                if a[1:] != b[1:]:
                    move[i, j] = -1e4
    return move, first


def _padded(sequences: list[list[list[int]]]) -> tuple[np.ndarray, np.ndarray]:
    size = max(map(len, sequences))
    width = len(sequences[0][0])
    numbers = np.zeros((len(sequences), size, width), np.int64)
    real = np.zeros((len(sequences), size), bool)
    for k, s in enumerate(sequences):
        numbers[k, :len(s)] = s
        real[k, :len(s)] = True
    return numbers, real


def train(rows: list[tuple[str, list[tuple[str, int, int]]]], steps: int = 150, decay: float = 0.002) -> Model:
    """Weights by gradient ascent (Adam) on the log-likelihood, by forward and backward sums over all rows at once."""
    sequences, wanted = [], []
    for text, spans in rows:
        found = tokens(text)
        if not found:
            continue
        label = np.zeros(len(found), np.int64)
        for kind, a, b in spans:
            inside = [k for k, (x, y) in enumerate(found) if x >= a and y <= b]
            if inside:
                label[inside] = LABELS.index(f"I-{kind}")
                label[inside[0]] = LABELS.index(f"B-{kind}")
        sequences.append(features(text, found))
        wanted.append(label)
    n, m = len(sequences), len(LABELS)
    numbers, real = _padded(sequences)
    size = numbers.shape[1]
    gold = np.zeros((n, size), np.int64)
    for k, w in enumerate(wanted):
        gold[k, :len(w)] = w
    rule_move, rule_first = _allowed()
    theta = [np.zeros((FEATURES, m)), np.zeros((m, m)), np.zeros(m)]
    mean, var = [np.zeros_like(t) for t in theta], [np.zeros_like(t) for t in theta]
    flat = numbers[real]
    truth = [np.zeros((FEATURES, m)), np.zeros((m, m)), np.zeros(m)]
    np.add.at(truth[0], (flat, gold[real][:, None]), 1)
    both = real[:, 1:]
    np.add.at(truth[1], (gold[:, :-1][both], gold[:, 1:][both]), 1)
    np.add.at(truth[2], gold[:, 0], 1)

    order = np.argsort(flat, axis=None, kind="stable")
    owner = np.repeat(np.arange(len(flat)), flat.shape[1])[order]
    active, begins = np.unique(flat.ravel()[order], return_index=True)
    for step in range(1, steps + 1):
        emit = theta[0][numbers].sum(axis=2)
        emit = np.exp(emit - emit.max(axis=2, keepdims=True))
        move, first = np.exp(theta[1] + rule_move), np.exp(theta[2] + rule_first)
        # Forward and backward sums, scaled to one at each token.
        ahead, back, scale = np.zeros((size, n, m)), np.ones((size, n, m)), np.ones((size, n, 1))
        ahead[0] = emit[:, 0] * first
        ahead[0] /= ahead[0].sum(axis=1, keepdims=True)
        for t in range(1, size):
            new = (ahead[t - 1] @ move) * emit[:, t]
            scale[t] = np.where(real[:, t, None], new.sum(axis=1, keepdims=True), 1.0)
            ahead[t] = np.where(real[:, t, None], new / scale[t], ahead[t - 1])
        for t in range(size - 2, -1, -1):
            back[t] = np.where(real[:, t + 1, None], (emit[:, t + 1] * back[t + 1] / scale[t + 1]) @ move.T, 1.0)
        node = ahead * back * real.T[:, :, None]
        want = [np.zeros((FEATURES, m)), np.zeros((m, m)), node[0].sum(axis=0)]
        want[0][active] = np.add.reduceat(node.transpose(1, 0, 2)[real][owner], begins, axis=0)
        for t in range(1, size):
            r = real[:, t]
            want[1] += move * (ahead[t - 1][r].T @ (emit[r, t] * back[t][r] / scale[t][r]))
        for k in range(3):
            grad = (truth[k] - want[k]) / n - decay * theta[k]
            mean[k] = 0.9 * mean[k] + 0.1 * grad
            var[k] = 0.99 * var[k] + 0.01 * grad**2
            theta[k] += 0.15 * (mean[k] / (1 - 0.9**step)) / (np.sqrt(var[k] / (1 - 0.99**step)) + 1e-8)
    return Model(theta[0], theta[1] + rule_move, theta[2] + rule_first)


def viterbi(model: Model, sequences: list[list[list[int]]]) -> list[np.ndarray]:
    """The likeliest labels of each sequence, many in one numpy pass; equal ones by the order of labels."""
    out: list = [None] * len(sequences)
    order = sorted(range(len(sequences)), key=lambda k: len(sequences[k]))
    at = 0
    while at < len(order):
        upto = at + 1
        while upto < len(order) and (upto + 1 - at) * len(sequences[order[upto]]) * len(LABELS) <= CELLS:
            upto += 1
        some = order[at:upto]
        numbers, real = _padded([sequences[k] for k in some])
        score = np.zeros((*numbers.shape[:2], len(LABELS)))
        for f in range(numbers.shape[2]):
            score += model.emit[numbers[:, :, f]]
        best = score[:, 0] + model.first
        came = np.zeros(score.shape, np.int8)
        for t in range(1, score.shape[1]):
            step = best[:, :, None] + model.move
            came[:, t] = step.argmax(axis=1)
            best = np.where(real[:, t, None], step.max(axis=1) + score[:, t], best)
        label = best.argmax(axis=1)
        path = np.zeros(real.shape, np.int64)
        rows = np.arange(len(some))
        for t in range(score.shape[1] - 1, -1, -1):
            path[:, t] = label
            label = np.where(real[:, t], came[rows, t, label], label) if t else label
        for r, k in enumerate(some):
            out[k] = path[r, :len(sequences[k])]
        at = upto
    return out


def windows(text: str) -> list[list[tuple[int, int]]]:
    """Tokens around anything that could belong to personal data; windows that touch are one."""
    near = [m.span() for m in _TRIGGER.finditer(text)]
    if not near:
        return []
    reach = 24 * AROUND  # characters that surely hold as many tokens, unless words are long
    stretches: list[list[int]] = []
    for a, b in near:
        a, b = max(0, a - reach), min(len(text), b + reach)
        if stretches and a <= stretches[-1][1]:
            stretches[-1][1] = b
        else:
            stretches.append([a, b])
    out, k = [], 0
    for a, b in stretches:
        # A stretch does not begin or end inside a word.
        while a > 0 and text[a - 1].isalnum():
            a -= 1
        while b < len(text) and text[b].isalnum():
            b += 1
        found = [m.span() for m in _TOKEN.finditer(text, a, b)]
        keep = np.zeros(len(found) + 1, np.int64)
        starts = np.array([f[0] for f in found])
        while k < len(near) and near[k][1] <= b:
            i, j = np.searchsorted(starts, near[k][0], "right") - 1, np.searchsorted(starts, near[k][1])
            keep[max(0, i - AROUND)] += 1
            keep[min(len(found), j + AROUND)] -= 1
            k += 1
        inside = np.cumsum(keep[:-1]) > 0
        edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
        out += [found[x:y] for x, y in zip(edges[0::2], edges[1::2])]
    return out


def plausible(kind: str, text: str) -> bool:
    """What a decoded span must hold to be reported."""
    digits = "".join(c for c in text if c in "0123456789")
    if kind == "email":
        return bool(re.search(r"@|[(\[{<]\s?at\s?[)\]}>]", text, re.I)) and bool(re.search(r"[A-Za-z0-9].*(\.|dot).*[A-Za-z]{2}\W*$", text, re.I | re.S))
    if kind == "ip":
        parts = re.findall(r"[0-9]+", text)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts) and not re.search(r"[A-Za-z]", text)
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits) and len(set(digits)) > 1
    return 10 <= len(digits) <= 15 and len(set(digits)) > 2 and bool(re.search(r"[^0-9]", text)) and not re.search(r"[A-Za-z]", text)


def added_spans(texts: list[str], known: list[list[tuple[str, int, int]]], model: Model) -> list[list[tuple[str, int, int]]]:
    """Spans that decoding finds beside the known ones, whose tokens are left out: what stands before and behind is decoded by itself."""
    owner, found = [], []
    for r, text in enumerate(texts):
        starts = sorted(x for _, x, _ in known[r])
        ends = list(accumulate((y for _, _, y in sorted(known[r], key=lambda s: s[1])), max))
        for w in windows(text):
            run: list[tuple[int, int]] = []
            for a, b in w:
                k = bisect_left(starts, b)
                if k and ends[k - 1] > a:
                    if run:
                        owner.append(r)
                        found.append(run)
                    run = []
                else:
                    run.append((a, b))
            if run:
                owner.append(r)
                found.append(run)
    labels = viterbi(model, [features(texts[r], w) for r, w in zip(owner, found)])
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    for r, w, path in zip(owner, found, labels):
        k = 0
        while k < len(w):
            if path[k] == 0:
                k += 1
                continue
            kind, j = LABELS[path[k]][2:], k + 1
            while j < len(w) and LABELS[path[j]] == f"I-{kind}":
                j += 1
            a, b = w[k][0], w[j - 1][1]
            if plausible(kind, texts[r][a:b]):
                out[r].append((kind, a, b))
            k = j
    return out


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def spans_of(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``df`` with ``base`` and ``spans``: arrays of (kind, start, end) by start and kind; columns of these names are replaced.

    ``base`` has what the fixed patterns match; ``spans`` has those and what the
    model adds. Places are code points, the end is exclusive. Null and empty
    texts have none; texts of any length are read whole, and decoded around each
    token that could belong to personal data. Rows stay as they are; no shuffle.
    """
    kept = [c for c in df.columns if c not in ("base", "spans")]
    base = df.select(*[f"`{c}`" for c in kept])
    kind = "array<struct<kind:string,start:int,end:int>>"
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema), f"base {kind}, spans {kind}"])
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = [t or "" for t in batch.column(kept.index(text)).to_pylist()]
        known = [base_spans(t) for t in texts]
        more = added_spans(texts, known, model)
        every = [sorted(a + b, key=lambda s: (s[1], KINDS.index(s[0]))) for a, b in zip(known, more)]
        asked = lambda lists: pa.array([[dict(zip(("kind", "start", "end"), s)) for s in x] for x in lists], arrow)
        yield pa.RecordBatch.from_arrays([*batch.columns, asked(known), asked(every)], [*kept, "base", "spans"])

    return in_arrow(base, schema, run)


def masked(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``df`` with each span of ``text`` replaced by its kind in brackets (``[EMAIL]``); spans that overlap become one, of the first kind.

    Null texts stay null; texts without spans stay as they are.
    """
    names = df.columns
    base = df.select(*[f"`{c}`" for c in names])
    at = names.index(text)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = batch.column(at).to_pylist()
        known = [base_spans(t or "") for t in texts]
        more = added_spans([t or "" for t in texts], known, model)
        out = []
        for t, a, b in zip(texts, known, more):
            parts, behind = [], 0
            for kind, x, y in sorted(a + b, key=lambda s: (s[1], KINDS.index(s[0]))):
                if x >= behind:
                    parts += [t[behind:x], f"[{kind.upper()}]"]
                behind = max(behind, y)
            out.append("".join(parts) + t[behind:] if parts else t)
        columns = list(batch.columns)
        columns[at] = pa.array(out, pa.string())
        yield pa.RecordBatch.from_arrays(columns, names)

    return in_arrow(base, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema), run)


def default_model(spark: SparkSession) -> Model:
    """The model of the labelled table."""
    rows = labelled_table(spark).collect()
    return train([(r["text"], [(s["kind"], s["start"], s["end"]) for s in r["spans"]]) for r in rows])
