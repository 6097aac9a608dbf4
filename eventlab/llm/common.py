"""Helpers of the text operators: words and shingles of Arrow batches, scratch tables, Arrow settings."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.sizing import join_side, settle
from ..session import configure

# Rows of a batch between the JVM and Python: texts may be long, so few.
BATCH_ROWS = 1_000
# Bytes of text that one numpy pass takes, unless a single text is longer.
CHUNK_BYTES = 1_000_000

_MASK = (1 << 64) - 1
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BYTES = np.random.default_rng(20240101).integers(1, 2**63, 256, dtype=np.int64).astype(np.uint64) | np.uint64(1)
# The low bytes of eight, by their number; bytes of a word beyond which a digest is taken.
_KEEP = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_LONG = 256
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers: dict[int, np.ndarray] = {}


def prepared(spark: SparkSession) -> SparkSession:
    """The session with small Arrow batches, as texts may be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return configure(spark)


def powers(base: int, n: int) -> np.ndarray:
    """``base`` to the powers 0 to n - 1, modulo 2^64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(12, (n - 1).bit_length())
        have = np.full(size, base & _MASK, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        _powers[base] = have
    return have[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def runs_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A hash of ``values[start:end]`` for each pair; equal runs get equal hashes, those of different seeds are independent.

    Hashes of all runs of 1, 2, 4, ... values are made from two halves each,
    mixed at every step so that no arrangement of values cancels out; a run is then the one at its start,
    the one at its end (they may overlap) and its length.
    """
    out = np.zeros(len(starts), np.uint64)
    length = (ends - starts).astype(np.int64)
    level, width = mixed(values ^ mixed(np.array([seed + 1], np.uint64))), 1
    while True:
        now = np.flatnonzero((length >= width) & (length < 2 * width))
        if len(now):
            out[now] = mixed(mixed(level[starts[now]] * _ODD + length[now].astype(np.uint64)) * _ODD + level[ends[now] - width])
        if not (length >= 2 * width).any():
            return out
        level = mixed(level[:len(level) - width] * _ODD + level[width:])
        width *= 2


def bytes_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of ``data[start:end]`` (bytes) for each pair, eight bytes after eight; of long ones by a digest."""
    length = ends - starts
    out = mixed(length.astype(np.uint64) + np.uint64(1))
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    live = np.flatnonzero(length <= _LONG)
    at, rest = starts[live], length[live]
    while len(live):
        out[live] = mixed(out[live] * _ODD ^ (eight[at] & _KEEP[np.minimum(rest, 8)]))
        more = rest > 8
        live, at, rest = live[more], at[more] + 8, rest[more] - 8
    for i in np.flatnonzero(length > _LONG):
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i]:ends[i]], digest_size=8).digest(), "little")
    return out


class Words:
    """Words (runs of anything but ASCII white space) of some texts, by numpy.

    ``hash`` is of the word's bytes, ``row`` the text it is in, ``start`` and
    ``end`` its bytes in ``data``, ``first`` the first word of each text.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        solid = ~SPACE[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets[:-1]] = True
        edge[offsets[-1]] = True
        begins = solid.copy()
        begins[1:] &= ~solid[:-1] | edge[1:-1]
        ends = solid.copy()
        ends[:-1] &= ~solid[1:] | edge[1:-1]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.hash = bytes_hash(data, self.start, self.end)
        self.first = np.searchsorted(self.start, offsets)
        self.row = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))

    def __len__(self) -> int:
        return len(self.start)

    def digests(self) -> list[bytes]:
        """128 bits of the words of each text, in order: a digest of the words with one space in front of each."""
        solid = ~SPACE[self.data]
        edge = np.zeros(len(self.data) + 1, np.int64)
        edge[self.start] = 1
        at = np.flatnonzero(solid)
        flat = np.full(len(at) + len(self.start), 32, np.uint8)
        flat[np.arange(len(at)) + np.cumsum(edge[:-1])[at]] = self.data[at]
        raw = flat.tobytes()
        # Letters and words before each text tell where it starts.
        letters = np.concatenate([[0], np.cumsum(solid)])[self.offsets]
        cuts = (letters + self.first).tolist()
        return [hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(cuts, cuts[1:])]

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash and starting word of every run of k words inside one text."""
        n = len(self) - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.row[:n] == self.row[k - 1:])
        return runs_hash(self.hash, at, at + k), at


def texts_of(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from row, to row, bytes, offsets) of an Arrow text column, in chunks of bounded size.

    Null texts are empty.
    """
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK_BYTES, "right")) - 1)
        yield i, j, data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]
        i = j


def words_of(column: pa.Array, lower: bool = False) -> Iterator[tuple[int, int, Words]]:
    """Words of an Arrow text column, chunk by chunk; ``lower`` turns A-Z into a-z first."""
    for i, j, data, offsets in texts_of(column):
        yield i, j, Words(LOWER[data] if lower else data, offsets)


def in_arrow(df: DataFrame, schema: str, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]) -> DataFrame:
    """``mapInArrow`` for a function of one batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from fn(batch)

    return df.mapInArrow(run, schema)


def signed(h: np.ndarray) -> pa.Array:
    """64-bit hashes as Spark's BIGINT."""
    return pa.array(h.view(np.int64))


def held_out(doc_id: str = "doc_id"):
    """Rows of the fold that no model may learn from: crc32 of the id's digits, modulo 5."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, and again from no lineage."""
    return settle(df, label)


def numbered(df: DataFrame, name: str = "_row") -> DataFrame:
    """``df`` with a whole number of its own for every row, the same each time the rows are read.

    Rows of Parquet files get the number of their file, in order of the paths, and their place in it;
    anything else is written first. Numbers that a plan gives rows by partition are not used, as Spark does not promise
    them twice.
    """
    file, place = f"{name}_file", f"{name}_place"
    try:
        placed = df.select("*", F.col("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(place))
    except AnalysisException:
        return written(df.withColumn(name, F.monotonically_increasing_id()), "numbered")
    # One row a file.
    files = placed.select(file).distinct().select(file, F.row_number().over(Window.orderBy(file)).cast("bigint").alias(name))
    return placed.join(join_side(written(files, "files")), file).withColumn(name, F.shiftleft(name, 40) + F.col(place)).drop(file, place)


def least_ids(links: DataFrame, label: str = "components") -> DataFrame:
    """(node, component) of every node of ``links`` (a, b): the smallest id that can be reached.

    Each round replaces links by links to the smallest neighbour of either end
    (as in alternating star contractions), on the links alone and written after each round,
    until nothing changes. Rounds grow with the logarithm of a component.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = written(edges, label)
    before = None
    while True:
        # Large star: every larger neighbour of a node points to the node's least neighbour.
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
        large = written(large.where("a <> b").distinct(), label)
        # Small star: a node and its smaller neighbours point to the least of them.
        low = large.groupBy("a").agg(F.min("b").alias("least"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).where("a <> b")
        edges = written(small.union(low.select("a", F.col("least").alias("b"))).distinct(), label)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
