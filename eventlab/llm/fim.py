"""Fill-in-the-middle: texts cut in three at unit boundaries that a wavelet matrix over character classes locates."""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, in_arrow, texts_of
from .fmindex import WaveletMatrix

MARKS = ("<P>", "<S>", "<M>")
# Classes of the bytes of a text. A character's later bytes are REST, so ranks count code points, too.
REST, INSIDE, WORD, LINE, WORD_AND_LINE = range(5)
# The classes that start a unit.
STARTS = {
    "chars": (INSIDE, WORD, LINE, WORD_AND_LINE),
    "words": (WORD, WORD_AND_LINE),
    "lines": (LINE, WORD_AND_LINE),
}


class Boundaries:
    """Unit starts of some texts (bytes and offsets), counted and located by ranks over byte classes.

    A line starts a text or follows a line feed; a word is a run of anything
    but ASCII white space, and its unit holds the white space behind it (the
    first one what is in front, too), so units always make up the text.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, units: str):
        self.offsets, self.starts = offsets, STARTS[units]
        begin = np.zeros(len(data) + 1, bool)
        begin[offsets] = True
        space = SPACE[data]
        line, word = begin[:-1].copy(), begin[:-1].copy()
        line[1:] |= data[:-1] == 10
        word[1:] |= space[:-1]
        word &= ~space
        classes = np.where((data & 0xC0) == 0x80, REST, INSIDE + word * (WORD - INSIDE) + line * (LINE - INSIDE))
        self.matrix = WaveletMatrix(classes, WORD_AND_LINE)

    def count(self, classes: tuple[int, ...], at: np.ndarray) -> np.ndarray:
        """How many bytes of these classes stand before each place: ranks, added up."""
        return reduce(np.add, (self.matrix.rank(np.full(len(at), c), at) for c in classes))

    def units(self) -> np.ndarray:
        """Units of each text: 0 where it is empty, else 1 at least."""
        low, high = self.offsets[:-1], self.offsets[1:]
        return np.maximum(self.count(self.starts, high) - self.count(self.starts, low), low < high)

    def cut(self, units: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The place behind the first ``units`` of the ``n`` units of each text, by bisection on ranks.

        That is the text's start for none and its end for all; else the
        next unit's start, the last place with ``units`` starts in front of it.
        """
        first, end = self.offsets[:-1], self.offsets[1:]
        inner = (units > 0) & (units < n)
        low, high = first.copy(), end.copy()  # low has at most so many starts in front, high has more
        goal = self.count(self.starts, first) + units
        while True:
            open_ = np.flatnonzero(inner & (high - low > 1))
            if not len(open_):
                break
            mid = (low[open_] + high[open_]) >> 1
            more = self.count(self.starts, mid) > goal[open_]
            high[open_[more]] = mid[more]
            low[open_[~more]] = mid[~more]
        return np.where(inner, low, np.where(units > 0, end, first))

    def chars(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Code points between places."""
        return self.count(STARTS["chars"], high) - self.count(STARTS["chars"], low)


def _draws(seed: int, ids: list) -> np.ndarray:
    """Four numbers of 32 bits for each id: the first groups of the sha256 of ``seed:id``."""
    found = [struct.unpack(">4I", hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).digest()[:16]) for i in ids]
    return np.array(found, np.int64).reshape(-1, 4)


def transformed(
    df: DataFrame, units: str = "lines", seed: int = 7, rate: int = 100, spm: int = 50,
    marks: tuple[str, str, str] = MARKS, text: str = "text", doc_id: str = "doc_id",
) -> DataFrame:
    """Cut the column ``text`` in prefix, middle and suffix between units, and put the middle last.

    Adds ``n_units``, ``form``, ``prefix_chars``, ``middle_chars`` (code
    points, null where the form is plain) and ``output``; columns of these names are
    replaced, others stay. ``units`` are lines, words or chars. Both cuts, whether a text is
    cut at all (``rate`` in 100) and its form (``spm`` in 100 have the suffix
    first) are drawn from ``seed`` and the row's id, so a task that is run again
    cuts alike. Empty texts and those that hold a mark stay plain. A null text is empty, a null id is
    drawn as an empty one, repeated rows are cut alike, and an empty table gives an empty
    one. Texts of any length are cut whole; there is no shuffle.
    """
    if units not in STARTS:
        raise ValueError(f"units are one of {', '.join(STARTS)}, not {units!r}")
    if len(set(marks)) < 3 or not all(marks):
        raise ValueError("three different marks are needed")
    added = ["n_units bigint", "form string", "prefix_chars bigint", "middle_chars bigint", "output string"]
    names = {a.split()[0] for a in added}
    kept = [c for c in df.columns if c not in names]
    if text not in kept or doc_id not in kept:
        raise ValueError(f"no columns {text!r} and {doc_id!r} beside the columns that are added")
    base = df.select(*[f"`{c}`" for c in kept])
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema), *added])
    prefix, suffix, middle = (m.encode() for m in marks)

    def cut(data: np.ndarray, offsets: np.ndarray, ids: list):
        """(units, form, prefix, middle, output) of some texts, as lists."""
        places, draws = Boundaries(data, offsets, units), _draws(seed, ids)
        n = places.units()
        one, two = draws[:, 0] % (n + 1), draws[:, 1] % (n + 1)
        a, b = places.cut(np.minimum(one, two), n), places.cut(np.maximum(one, two), n)
        before, between = places.chars(offsets[:-1], a).tolist(), places.chars(a, b).tolist()
        raw, forms, outputs = data.tobytes(), [], []
        for r, (low, x, y, high) in enumerate(zip(offsets[:-1].tolist(), a.tolist(), b.tolist(), offsets[1:].tolist())):
            whole = raw[low:high]
            form, out = "plain", whole
            if whole and draws[r, 2] % 100 < rate and not any(m in whole for m in (prefix, suffix, middle)):
                if draws[r, 3] % 100 < spm:
                    form, out = "spm", b"".join((suffix, raw[y:high], prefix, raw[low:x], middle, raw[x:y]))
                else:
                    form, out = "psm", b"".join((prefix, raw[low:x], suffix, raw[y:high], middle, raw[x:y]))
                if any(out.count(m) != 1 for m in (prefix, suffix, middle)):
                    form, out = "plain", whole  # a mark made up by the text and another mark
            forms.append(form)
            outputs.append(out.decode())
            if form == "plain":
                before[r] = between[r] = None
        return n.tolist(), forms, before, between, outputs

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids = batch.column(kept.index(doc_id)).to_pylist()
        for i, j, data, offsets in texts_of(batch.column(kept.index(text))):
            columns = [pa.array(c, t) for c, t in zip(
                cut(data, offsets, ids[i:j]), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays(
                [*batch.slice(i, j - i).columns, *columns], [*kept, *(a.split()[0] for a in added)])

    return in_arrow(base, schema, run)


def restored(df: DataFrame, output: str = "output", form: str = "form", marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """Add ``restored``: the text that ``output`` was made from, read from it and its form alone; null stays null."""
    parts = F.split(F.col(output), "|".join(re.escape(m) for m in marks), -1)
    part = lambda i: F.get(parts, F.lit(i))
    return df.withColumn(
        "restored",
        F.when(F.col(form) == "psm", F.concat(part(1), part(3), part(2)))
        .when(F.col(form) == "spm", F.concat(part(2), part(3), part(1)))
        .otherwise(F.col(output)))
