"""Subword pieces of merge-type vocabularies: encoding by a score-ordered agenda, and decoding."""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from .common import in_arrow

MARK = "▁"  # stands for a space in a vocabulary
# Longer stretches without a place to cut have an agenda of their own, a heap.
LONG = 64
# Stretches whose ids a task remembers in each of two generations; the older one goes when the younger is full.
REMEMBERED = 250_000
# Stretches whose agendas are worked off side by side.
SIDE_BY_SIDE = 20_000
_NONE = np.int64(1 << 62)


class Vocabulary:
    """Pieces, scores and merges of a vocabulary file, and its encoder.

    For merge-type vocabularies with byte fallback whose text is not
    normalised but for spaces turned into marks with one in front. The
    library is used to read the file, to check ids and to decode.
    """

    def __init__(self, path: str):
        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=path)
        size = lib.get_piece_size()
        self.id_of = {lib.id_to_piece(i): i for i in range(size)
                      if not (lib.is_control(i) or lib.is_byte(i) or lib.is_unknown(i) or lib.is_unused(i))}
        self.byte = [lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if len(set(self.byte)) < 256:
            raise ValueError("the vocabulary has no piece for each byte")
        if any(MARK in p.lstrip(MARK) for p in self.id_of):
            raise ValueError("pieces with a mark inside cannot be cut at marks")
        # Symbols are piece ids; characters that are no piece get numbers above them.
        self.chars: dict[str, int] = {p: i for p, i in self.id_of.items() if len(p) == 1}
        self.size = size
        self.symbol = np.arange(0x110000, dtype=np.int64) + size
        for c, i in self.chars.items():
            self.symbol[ord(c)] = i
        # The order of merges: higher score first; equal scores share a place, the leftmost goes first.
        scores = np.array([lib.get_score(i) for i in range(size)])
        order = np.unique(-scores, return_inverse=True)[1]
        left, right, made = [], [], []
        for p, i in self.id_of.items():
            for cut in range(1, len(p)):
                a, b = self.id_of.get(p[:cut]), self.id_of.get(p[cut:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    made.append(i)
        keys = np.array(left, np.int64) * size + np.array(right, np.int64)
        made = np.array(made, np.int64)
        rank = order[made].astype(np.int64)
        self.merge = dict(zip(keys.tolist(), zip(rank.tolist(), made.tolist())))
        # The merges as a table with open addressing, at most a quarter full.
        self.bits = max(4, (4 * len(keys)).bit_length())
        self.slot_key = np.full(1 << self.bits, -1, np.int64)
        self.slot_rank = np.full(1 << self.bits, _NONE)
        self.slot_made = np.zeros(1 << self.bits, np.int64)
        left_over, at = np.arange(len(keys)), self._slot(keys)
        while len(left_over):
            free = np.flatnonzero(self.slot_key[at] == -1)
            free = free[np.unique(at[free], return_index=True)[1]]
            put = left_over[free]
            self.slot_key[at[free]], self.slot_rank[at[free]], self.slot_made[at[free]] = keys[put], rank[put], made[put]
            stay = np.ones(len(at), bool)
            stay[free] = False
            left_over, at = left_over[stay], (at[stay] + 1) & ((1 << self.bits) - 1)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def stretches(self, text: str) -> list[str]:
        """The text with marks, cut before each mark that follows another character; without the mark in front."""
        if not text:
            return []
        words = text.split(" ")
        if MARK not in text and "" not in words:
            return words
        out, marks = [], 0
        for w in text.replace(" ", MARK).split(MARK):
            marks += 1
            if w:
                out.append(MARK * (marks - 1) + w)
                marks = 0
        if marks:
            out.append(MARK * (marks - 1))
        return out

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _pairs(self, left: np.ndarray, right: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Agenda entry (place in the order of merges, then place ``at`` in the text; or none) and outcome of adjacent symbols."""
        key = np.where((left < self.size) & (right < self.size), left * self.size + right, -2)
        slot = self._slot(key)
        held = self.slot_key[slot]
        further = np.flatnonzero((held != key) & (held != -1) & (key != -2))
        while len(further):
            slot[further] = (slot[further] + 1) & (len(self.slot_key) - 1)
            held[further] = self.slot_key[slot[further]]
            further = further[(held[further] != key[further]) & (held[further] != -1)]
        return np.where(held == key, self.slot_rank[slot] << 32 | at, _NONE), self.slot_made[slot]

    def _agendas(self, stretches: list[str]) -> list[bytes]:
        """Piece ids (as 32-bit integers) of many short stretches, best sorted by length.

        Each stretch has an agenda of its adjacent pairs, ordered by score and
        then from the left; in each round the first entry of every agenda is taken off, its
        pair becomes one symbol, and the pairs with its new neighbours are entered.
        Symbols are linked lists in flat arrays, with one more that is no symbol behind the ends.
        """
        sizes = np.fromiter(map(len, stretches), np.int64, len(stretches))
        sym = np.append(self.symbol[np.frombuffer("".join(stretches).encode("utf-32-le"), np.uint32)], self.size)
        n = len(sym) - 1
        first = np.cumsum(sizes) - sizes
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        after[first + sizes - 1] = before[first] = after[n] = before[n] = n
        agenda, made = self._pairs(sym, sym[after], np.arange(n + 1))
        low, begins = 0, first
        while True:
            best = np.minimum.reduceat(agenda[low:n], begins - low)
            going = best != _NONE
            if not going.any():
                break
            done = int(going.argmax())  # short stretches are through first
            begins, low = begins[done:], int(begins[done])
            at = best[going] & 0xFFFFFFFF
            gone = after[at]
            sym[at] = made[at]
            sym[gone], agenda[gone] = -1, _NONE
            right, left = after[gone], before[at]
            after[at], before[right] = right, at
            agenda[at], made[at] = self._pairs(sym[at], sym[right], at)
            agenda[left], made[left] = self._pairs(sym[left], sym[at], left)
        live = sym[:n] >= 0
        ends = np.cumsum(np.add.reduceat(live, first))
        flat = sym[:n][live]
        ids, ends = flat.astype(np.int32).tobytes(), ends.tolist()
        out = [ids[4 * a:4 * b] for a, b in zip([0, *ends], ends)]
        for k in np.unique(np.searchsorted(ends, np.flatnonzero(flat >= self.size), "right")).tolist():
            out[k] = self._final(np.frombuffer(out[k], np.int32).tolist())
        return out

    def _agenda(self, stretch: str) -> list[int]:
        """Symbols of one stretch, by a heap of adjacent pairs."""
        sym = [self.chars[c] if c in self.chars else self.size + ord(c) for c in stretch]
        n = len(sym)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        alive = [True] * n
        heap: list = []

        def offer(i: int, j: int) -> None:
            if sym[i] < self.size and sym[j] < self.size:
                found = self.merge.get(sym[i] * self.size + sym[j])
                if found:
                    heapq.heappush(heap, (found[0], i, j, sym[i], sym[j], found[1]))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, i, j, a, b, made = heapq.heappop(heap)
            if not (alive[i] and alive[j] and sym[i] == a and sym[j] == b and after[i] == j):
                continue
            sym[i], alive[j], after[i] = made, False, after[j]
            if after[i] < n:
                before[after[i]] = i
                offer(i, after[i])
            if before[i] >= 0:
                offer(before[i], i)
        return [s for s, live in zip(sym, alive) if live]

    def _final(self, symbols: list[int]) -> bytes:
        """Piece ids of symbols: characters that are no piece become bytes."""
        out: list[int] = []
        for s in symbols:
            if s < self.size:
                out.append(s)
            else:
                out.extend(self.byte[b] for b in chr(s - self.size).encode())
        return np.array(out, np.int32).tobytes()

    def learn(self, stretches: set[str], check: bool) -> None:
        """See that ``known`` has all of these stretches; ``check`` holds new ones against the library."""
        if len(self.known) > REMEMBERED:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        new = [s for s in stretches if s not in known]
        if older:
            known.update((s, older[s]) for s in new if s in older)
            new = [s for s in new if s not in older]
        if not new:
            return
        new.sort(key=len)
        short = next((k for k, s in enumerate(new) if len(s) >= LONG), len(new)) if len(new[-1]) >= LONG else len(new)
        for at in range(0, short, SIDE_BY_SIDE):
            some = new[at:min(short, at + SIDE_BY_SIDE)]
            known.update(zip(some, self._agendas([MARK + s for s in some])))
        for s in new[short:]:
            known[s] = self._final(self._agenda(MARK + s))
        if check:
            self.compare(new)

    def compare(self, stretches: list[str]) -> None:
        """Raise if the library has other ids for these stretches, joined to texts of some thousand characters.

        Stretches of marks alone would run into the next one; they are left to the tests.
        """
        some = [s for s in stretches if s.strip(MARK)]
        ends = np.cumsum([len(s) + 1 for s in some]) // 2_000
        cuts = [0, *(np.flatnonzero(np.diff(ends)) + 1).tolist(), len(some)]
        parts = [some[a:b] for a, b in zip(cuts, cuts[1:]) if a < b]
        known = self.known
        for part, told in zip(parts, self.library.encode([" ".join(p).replace(MARK, " ") for p in parts], num_threads=1)):
            if b"".join([known[s] for s in part]) != np.array(told, np.int32).tobytes():
                raise ValueError(f"the agenda and the library differ on {' '.join(part)[:200]!r}")

    def encode(self, texts: list[str], check: bool = True) -> list[list[int]]:
        """Piece ids of each text."""
        return [np.frombuffer(x, np.int32).tolist() for x in self.packed(texts, check)]

    def packed(self, texts: list[str], check: bool = True) -> list[bytes]:
        """Piece ids of each text, as 32-bit integers."""
        cut = [self.stretches(t) for t in texts]
        self.learn(set().union(*cut), check)
        known = self.known
        return [b"".join([known[s] for s in c]) for c in cut]


_loaded: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a file, once in each process."""
    if path not in _loaded:
        _loaded[path] = Vocabulary(path)
    return _loaded[path]


def encoded(df: DataFrame, path: str, text: str = "text", check: bool = True, with_ids: bool = True) -> DataFrame:
    """Encode and decode the column ``text``.

    Adds ``ids`` (array, unless ``with_ids`` is off), ``n_tokens``,
    ``ids_sha256`` and ``decoded`` (a text); columns of these names are
    replaced. Null and empty texts have no ids and decode to an empty text.
    Rows stay as they are, repeated ones too; a text of any length is encoded
    whole. ``path`` is a vocabulary file that every executor has.

    Each Arrow batch is cut into stretches; those a task does not remember go through
    agendas, short ones side by side, and through the library as a check. No shuffle, and what a
    task remembers is bounded.
    """
    added = (["ids array<int>"] if with_ids else []) + ["n_tokens bigint", "ids_sha256 string", "decoded string"]
    names = {a.split()[0] for a in added} | {"ids"}
    kept = [c for c in df.columns if c not in names]
    if text not in kept:
        raise ValueError(f"no text column {text!r} beside the columns that are added")
    base = df.select(*[f"`{c}`" for c in kept])
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema), *added])

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        texts = [t or "" for t in batch.column(kept.index(text)).to_pylist()]
        ids, hashes, sizes, plain = [], [], [], []
        at = 0
        while at < len(texts):  # some megabytes at a time
            upto, chars = at, 0
            while upto < len(texts) and (upto == at or chars + len(texts[upto]) <= 2_000_000):
                chars += len(texts[upto])
                upto += 1
            packed = [np.frombuffer(x, np.int32) for x in vocab.packed(texts[at:upto], check)]
            some = [x.tolist() for x in packed]
            plain += vocab.library.decode(some)
            sizes += map(len, some)
            hashes += [hashlib.sha256(str(x)[1:-1].replace(" ", "").encode()).hexdigest() for x in some]
            if with_ids:
                ids += packed
            at = upto
        columns = list(batch.columns)
        if with_ids:
            ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
            columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)))
        columns += [pa.array(sizes, pa.int64()), pa.array(hashes, pa.string()), pa.array(plain, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, [*kept, *(a.split()[0] for a in added)])

    return in_arrow(base, schema, run)
