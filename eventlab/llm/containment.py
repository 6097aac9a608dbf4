"""Benchmark items inside documents: size-partitioned MinHash containment search, exact shingle containment."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, mixed, powers, words_of

WORDS = 5  # of a shingle
PERCENT = 80  # of an item's shingles that a document must hold
HASHES = 64  # of a signature, each a band of its own
# Items of one block: their signatures and shingles are what a pass over the documents carries, whatever the benchmark's size.
BLOCK_ITEMS = 20_000
BLOCK_SHINGLES = 2_000_000


@dataclass
class Block:
    """An index of some items: of each size class (its largest size) the sorted signature values and whose they are, and all shingles."""

    items: list[int | None]
    sets: list[np.ndarray]
    texts: list[str]
    classes: list[tuple[int, list[tuple[np.ndarray, np.ndarray]]]]


def _factors() -> np.ndarray:
    """Odd factors: the least product with one over a set is a signature value; shingle hashes are already spread."""
    return mixed(powers(0xA0761D6478BD642F, HASHES + 1)[1:]) | np.uint64(1)


def _item_sets(column: pa.Array, k: int) -> list[np.ndarray]:
    """Distinct hashes of each text's shingles."""
    out = []
    for i, j, words in words_of(column, lower=True):
        shingle, at = words.shingles(k)
        cuts = np.searchsorted(words.row[at], np.arange(j - i + 1))
        out += [np.unique(shingle[cuts[r]:cuts[r + 1]]) for r in range(j - i)]
    return out


def _shingles(text: bytes, k: int) -> set[tuple[bytes, ...]]:
    words = text.lower().split()
    return {tuple(words[i:i + k]) for i in range(len(words) - k + 1)}


def index(items: list[int | None], sets: list[np.ndarray], texts: list[str]) -> Block:
    """Items dealt into classes by size (powers of two), each item with a signature of HASHES least products."""
    factors = _factors()
    sizes = np.array([len(s) for s in sets], np.int64)
    top = 1 << np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64)
    classes = []
    for most in np.unique(top[sizes > 0]):
        which = np.flatnonzero((top == most) & (sizes > 0))
        signature = np.stack([(sets[w][:, None] * factors[None, :]).min(axis=0) for w in which])
        bands = []
        for h in range(HASHES):
            order = np.argsort(signature[:, h], kind="stable")
            bands.append((signature[order, h], which[order]))
        classes.append((int(most), bands))
    return Block(items, sets, texts, classes)


def found_in(column: pa.Array, block: Block, percent: int, k: int) -> np.ndarray:
    """Rows (text, item, shared shingles, shingles of the item) of every item that a text of the column contains.

    For each size class a text is cut into passages of twice the class's
    largest size, half overlapping, so that an item's passage lies within one
    of them and is a large part of it; any agreeing signature value makes a
    candidate, which is then counted on all shingles of the text.
    """
    factors, n = _factors(), len(block.items)
    out: list[tuple] = []
    for i, j, words in words_of(column, lower=True):
        shingle, at = words.shingles(k)
        if not len(shingle) or not block.classes:
            continue
        row = words.row[at]
        begins = np.searchsorted(row, np.arange(j - i + 1))
        # Cells of the smallest class, and how each further class puts cells together; a passage is two cells of a text.
        base = block.classes[0][0]
        cell = (np.arange(len(row)) - begins[row]) // base
        first = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (cell[1:] != cell[:-1])))
        row, cell = row[first], cell[first]
        levels, before = [], np.arange(len(row))
        for most, bands in block.classes:
            wide = cell // (most // base)
            start = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (wide[1:] != wide[:-1])))
            levels.append((np.searchsorted(before, start), row[start], np.append(row[start][1:] != row[start][:-1], True), bands))
            before = start
        candidates: list[np.ndarray] = []
        for h in range(HASHES):
            least = np.minimum.reduceat(shingle * factors[h], first)
            for start, owner, last, bands in levels:
                least = np.minimum.reduceat(least, start)
                passage = least.copy()  # the last cell of a text stands alone
                passage[:-1] = np.where(last[:-1], least[:-1], np.minimum(least[:-1], least[1:]))
                value, item = bands[h]
                low, high = np.searchsorted(value, passage), np.searchsorted(value, passage, "right")
                hit = np.flatnonzero(high > low)
                if len(hit):
                    many = high[hit] - low[hit]
                    places = np.repeat(low[hit], many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
                    candidates.append(np.unique(np.repeat(owner[hit], many) * n + item[places]))
        if not candidates:
            continue
        known, whole, data = -1, np.zeros(0, np.uint64), words.data
        read, exact = -1, set()
        for pair in np.unique(np.concatenate(candidates)).tolist():
            r, w = divmod(pair, n)
            if r != known:
                known, whole = r, np.unique(shingle[begins[r]:begins[r + 1]])
            own = block.sets[w]
            place = np.minimum(np.searchsorted(whole, own), len(whole) - 1)
            shared = int((whole[place] == own).sum())
            if 100 * shared >= percent * len(own):
                # Equal hashes find it; equal words decide.
                if r != read:
                    read, exact = r, _shingles(data[words.offsets[r]:words.offsets[r + 1]].tobytes(), k)
                item = _shingles(block.texts[w].encode(), k)
                if 100 * len(item & exact) >= percent * len(item):
                    out.append((i + r, w, len(item & exact), len(item)))
    return np.array(out, np.int64).reshape(-1, 4)


def blocks(benchmark: DataFrame, k: int = WORDS, text: str = "text", item_id: str = "item_id") -> Iterator[Block]:
    """The benchmark's items in blocks of bounded size, each fetched and indexed when it is its turn."""
    rows = benchmark.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).alias("text")).where("text IS NOT NULL")
    size = rows.agg(F.count("*").alias("n"), F.sum(F.octet_length("text") / 2).alias("words")).first()
    many = max(1, -(-size.n // BLOCK_ITEMS), int((size.words or 0) // BLOCK_SHINGLES) + 1)
    for b in range(many):
        some = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(many)) == b).toArrow().combine_chunks()
        if some.num_rows:
            column = some["text"].chunk(0) if some["text"].num_chunks else pa.array([], pa.string())
            yield index(some["item_id"].to_pylist(), _item_sets(column.cast(pa.string()), k), column.to_pylist())


def leaks(df: DataFrame, benchmark: DataFrame, percent: int = PERCENT, k: int = WORDS, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, item_id, shared, n_shingles) of every item of ``benchmark`` (item_id, text) that a document contains.

    A document contains an item when it holds ``percent`` of the item's distinct runs of k
    words (A-Z lower-cased) or more, wherever they stand. Items with fewer
    than k words and null ones have no runs and are found nowhere. Repeated rows on either side give
    a row for each pair; null ids are kept as they are; empty tables give an empty one.

    Documents are not shuffled. The benchmark is taken in blocks of bounded
    size, one pass over the documents each. A passage that holds 80 in 100 of an item agrees
    with it in none of 64 signature values with a chance below 1e-5.
    """
    docs = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    schema = "doc_id bigint, item_id bigint, shared bigint, n_shingles bigint"
    out = docs.sparkSession.createDataFrame([], schema)
    for block in blocks(benchmark, k):
        def run(batch: pa.RecordBatch, block: Block = block) -> Iterator[pa.RecordBatch]:
            got = found_in(batch.column("text"), block, percent, k)
            items = pa.array(block.items, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(got[:, 0])), items.take(pa.array(got[:, 1])), pa.array(got[:, 2]), pa.array(got[:, 3])],
                ["doc_id", "item_id", "shared", "n_shingles"])

        out = out.unionByName(in_arrow(docs, schema, run))
    return out


def clean(df: DataFrame, benchmark: DataFrame, percent: int = PERCENT, k: int = WORDS, text: str = "text") -> DataFrame:
    """The rows of ``df`` that contain no item (see ``leaks``); null texts contain none. No shuffle."""
    names = df.columns
    out = df.select(*[f"`{c}`" for c in names])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema)
    for block in blocks(benchmark, k):
        def run(batch: pa.RecordBatch, block: Block = block) -> Iterator[pa.RecordBatch]:
            stay = np.ones(batch.num_rows, bool)
            stay[found_in(batch.column(names.index(text)), block, percent, k)[:, 0]] = False
            yield batch.filter(pa.array(stay))

        out = in_arrow(out, schema, run)
    return out
