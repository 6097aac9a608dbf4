"""Repeated lines: sharded cuckoo filters in front of exact reference tables, kept up by insertions and deletions of documents."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.sizing import join_side
from ..session import scratch_path
from .common import in_arrow, mixed

SLOTS = 4  # fingerprints of a bucket
BUCKETS = 1 << 12  # of a layer, so one takes 32 kB
# Keys of a shard when an index is begun, about; a shard that outgrows its layers gets more.
SHARD_KEYS = 12_000
# Rounds of evictions before what is left goes to another layer.
KICKS = 60
# References of one task that looks keys up; shards with more are dealt over several.
PART_ROWS = 25_000
BLANK = b" \t\n\v\f\r"
KEY = ["key_a", "key_b"]

_REFS = "doc_id bigint, key_a bigint, key_b bigint"
_TOTALS = "key_a bigint, key_b bigint, shard bigint, n bigint, last bigint, before bigint"
_FILTERS = "shard bigint, data binary"
_DELETED = "doc_id bigint"
_COMMITS = "shards bigint, least_docs bigint, least_chars bigint, kind string"


class CuckooFilter:
    """A multiset of 16-bit fingerprints, each in one of two buckets; both follow from fingerprint and either bucket.

    Layers are of one size, so a fingerprint has the same two buckets in all
    of them and any copy may be taken away for any key that has them. What ``count`` says is
    thus never below what was added, and does not depend on the order.
    """

    def __init__(self, data: bytes = b""):
        layer = BUCKETS * SLOTS
        stored = np.frombuffer(data, np.uint16)
        self.layers = [stored[i:i + layer].reshape(BUCKETS, SLOTS).copy() for i in range(0, len(stored), layer)]

    def tobytes(self) -> bytes:
        return b"".join(x.tobytes() for x in self.layers)

    @staticmethod
    def places(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(fingerprint, bucket, other bucket) of keys; fingerprint 0 stands for an empty slot."""
        h = mixed(keys.astype(np.uint64))
        mark = np.maximum(h >> np.uint64(48), np.uint64(1))
        one = (h & np.uint64(BUCKETS - 1)).astype(np.int64)
        return mark.astype(np.uint16), one, CuckooFilter.other(mark, one)

    @staticmethod
    def other(mark: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        return bucket ^ (mixed(mark.astype(np.uint64)) & np.uint64(BUCKETS - 1)).astype(np.int64)

    def count(self, keys: np.ndarray) -> np.ndarray:
        """Copies that the filter may hold of each key."""
        mark, one, two = self.places(keys)
        found = np.zeros(len(keys), np.int64)
        for x in self.layers:
            found += (x[one] == mark[:, None]).sum(1) + np.where(one != two, (x[two] == mark[:, None]).sum(1), 0)
        return found

    @staticmethod
    def _take(layer: np.ndarray, mark: np.ndarray, bucket: np.ndarray, want: np.ndarray, put: np.ndarray, same: np.ndarray) -> np.ndarray:
        """Set one slot each that holds ``want`` to ``put``; items with one ``same`` take different slots. True where there was one."""
        order = np.argsort(same, kind="stable")
        sorted_ = same[order]
        starts = np.flatnonzero(np.append(True, sorted_[1:] != sorted_[:-1]))
        rank = np.empty(len(same), np.int64)
        rank[order] = np.arange(len(same)) - np.repeat(starts, np.diff(np.append(starts, len(same))))
        fits = layer[bucket] == want[:, None]
        chosen = fits & (np.cumsum(fits, 1) == rank[:, None] + 1)
        hit = chosen.any(1)
        layer[bucket[hit], chosen[hit].argmax(1)] = put[hit]
        return hit

    def add(self, keys: np.ndarray, copies: np.ndarray) -> None:
        """Add ``copies`` of each key."""
        mark, one, two = (np.repeat(x, copies) for x in self.places(keys))
        at = 0
        while len(mark):
            if at == len(self.layers):
                self.layers.append(np.zeros((BUCKETS, SLOTS), np.uint16))
            layer, empty = self.layers[at], np.zeros(len(mark), np.uint16)
            done = self._take(layer, mark, one, empty, mark, one)
            mark, one, two = mark[~done], two[~done], one[~done]
            for turn in range(KICKS):
                if not len(mark):
                    break
                done = self._take(layer, mark, one, empty[:len(mark)], mark, one)
                mark, one = mark[~done], one[~done]
                # One item of each full bucket takes the place of another fingerprint, which goes to its other bucket.
                bucket, first = np.unique(one, return_index=True)
                slot = (mark[first].astype(np.int64) + turn) % SLOTS
                out = layer[bucket, slot]
                layer[bucket, slot] = mark[first]
                mark[first], one[first] = out, self.other(out, bucket)
            two = self.other(mark, one)
            at += 1

    def remove(self, keys: np.ndarray, copies: np.ndarray) -> None:
        """Take ``copies`` of each key away; they must have been added."""
        mark, one, two = (np.repeat(x, copies) for x in self.places(keys))
        for bucket_first in (True, False):
            for layer in self.layers:
                if len(mark):
                    bucket = one if bucket_first else two
                    done = self._take(layer, mark, bucket, mark, np.zeros(len(mark), np.uint16), bucket << 16 | mark)
                    mark, one, two = mark[~done], one[~done], two[~done]
        if len(mark):
            raise ValueError("keys to remove that the filter does not hold")


def line_key(line: bytes) -> bytes:
    """What lines are compared by: no ASCII white space at the ends, A-Z lower-cased."""
    return line.strip(BLANK).lower()


def _digest(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


def _long(key: bytes, least: int) -> bool:
    return len(key) >= least and (key.isascii() or len(key.decode()) >= least)


def _references(batch: pa.RecordBatch, least_chars: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, key_a, key_b): the different keys of each text, as 128 bits, once a text."""
    ids, texts = batch.column("doc_id").to_pylist(), batch.column("text")
    docs, keys = [], []

    def done() -> pa.RecordBatch:
        pairs = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["doc_id", *KEY])

    for doc, text in zip(ids, texts):
        lines = {k for line in (text.as_py() or "").encode().split(b"\n") if _long(k := line_key(line), least_chars)}
        docs += [doc] * len(lines)
        keys += map(_digest, lines)
        if len(docs) >= 100_000:
            yield done()
            docs.clear()
            keys.clear()
    yield done()


def _by_shard(filters: DataFrame, rows: DataFrame, cells: list[str], schema: str, visit, close) -> DataFrame:
    """Stream the rows of each cell (a shard, or a part of one) past its filter.

    Cells are dealt out by hash and sorted with the filter in front, so a task
    holds one filter and one batch, however many rows a cell has.
    ``visit(filter, batch)`` gives a batch or nothing, ``close(shard, filter)`` too.
    """
    front = filters.select(*cells, "data", F.lit(0).alias("kind"))
    for f in rows.schema:
        if f.name not in cells:
            front = front.withColumn(f.name, F.lit(None).cast(f.dataType))
    both = front.unionByName(rows.withColumn("data", F.lit(None).cast("binary")).withColumn("kind", F.lit(1)))
    both = both.repartition(*cells).sortWithinPartitions(*cells, "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held = None, None
        for batch in batches:
            of = list(zip(*(batch.column(c).to_pylist() for c in cells)))
            cuts = [0, *(i for i in range(1, len(of)) if of[i] != of[i - 1]), len(of)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                if of[a] != cell:
                    if cell is not None and (out := close(cell[0], held)) is not None:
                        yield out
                    cell, held = of[a], CuckooFilter()
                while part.num_rows and part.column("kind")[0].as_py() == 0:
                    held = CuckooFilter(part.column("data")[0].as_py())
                    part = part.slice(1)
                if part.num_rows and (out := visit(held, part)) is not None:
                    yield out
        if cell is not None and (out := close(cell[0], held)) is not None:
            yield out

    return both.mapInArrow(run, schema)


def _keys_of(batch: pa.RecordBatch) -> np.ndarray:
    a, b = (batch.column(c).to_numpy().view(np.uint64) for c in KEY)
    return a ^ mixed(b)


def _looked_up(filters: DataFrame, rows: DataFrame, cells: list[str], least: int) -> DataFrame:
    """``rows`` with ``maybe``: false where the filter of their shard holds fewer than ``least`` copies, which is certain."""
    names = rows.columns

    def visit(held: CuckooFilter, batch: pa.RecordBatch) -> pa.RecordBatch:
        maybe = pa.array(held.count(_keys_of(batch)) >= least)
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), maybe], [*names, "maybe"])

    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema), "maybe boolean"])
    return _by_shard(filters, rows, cells, schema, visit, lambda shard, held: None)


def _kept_up(filters: DataFrame, totals: DataFrame, least: int) -> DataFrame:
    """The filters after keys went from ``before`` to ``n`` references; a key has as many copies as references, ``least`` at most."""
    def visit(held: CuckooFilter, batch: pa.RecordBatch) -> None:
        keys = _keys_of(batch)
        change = np.minimum(batch.column("n").to_numpy(), least) - np.minimum(batch.column("before").to_numpy(), least)
        held.remove(keys[change < 0], -change[change < 0])
        held.add(keys[change > 0], change[change > 0])

    def close(shard: int, held: CuckooFilter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([held.tobytes()], pa.binary())], ["shard", "data"])

    return _by_shard(filters, totals.select("shard", *KEY, "n", "before"), ["shard"], _FILTERS, visit, close)


class LineIndex:
    """The lines of a set of documents that grows and shrinks, in a folder that all machines share.

    A line's key is the line without ASCII white space at its ends, A-Z
    lower-cased. Keys of at least ``least_chars`` code points that
    ``least_docs`` documents hold are repeated: all documents but those with the largest
    id among them lose their lines of that key. Every row is a document of its own; rows without an
    id are no documents: they neither count nor lose lines. Other columns are not looked at.

    Every generation adds to three tables: ``refs`` (which document has which
    key), ``totals`` (references and largest id of the keys that changed; the latest
    generation holds) and ``filters`` (of each shard of keys, a cuckoo filter with as many copies of a
    key as it has references, ``least_docs`` at most). The filter says
    which keys of new documents are new, so the tables are not searched for them, and which references can be
    of repeated lines. The tables decide. A generation counts when its
    commit is written, so a lost one is written again. Deleting documents takes their references
    back and gives their lines back to others.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, least_docs: int = 3, least_chars: int = 20, shards: int | None = None):
        self.spark, self.folder = spark, folder or scratch_path(spark, "lines")
        self.least_docs, self.least_chars, self.shards = least_docs, least_chars, shards
        self.generation, self.deletions = 0, False

    @classmethod
    def at(cls, spark: SparkSession, folder: str) -> LineIndex:
        """The index that a folder holds, as of its last commit."""
        found = spark.read.schema(f"{_COMMITS}, gen int").parquet(f"{folder}/commits").orderBy("gen").collect()
        index = cls(spark, folder, found[-1]["least_docs"], found[-1]["least_chars"], found[-1]["shards"])
        index.generation, index.deletions = found[-1]["gen"], any(c["kind"] == "delete" for c in found)
        return index

    def _table(self, name: str, schema: str, only: int | None = None) -> DataFrame:
        """A table as of the last commit, or of one generation alone."""
        if only is not None:
            return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}/gen={only}")
        if not self.generation:
            return self.spark.createDataFrame([], f"{schema}, gen int")
        return self.spark.read.schema(f"{schema}, gen int").parquet(f"{self.folder}/{name}").where(F.col("gen") <= self.generation)

    def _write(self, name: str, schema: str, df: DataFrame | None) -> DataFrame:
        """A table of the next generation."""
        df = self.spark.createDataFrame([], schema) if df is None else df
        path = f"{self.folder}/{name}/gen={self.generation + 1}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _commit(self, kind: str) -> None:
        self._write("commits", _COMMITS, self.spark.createDataFrame([(self.shards, self.least_docs, self.least_chars, kind)], _COMMITS).coalesce(1))
        self.generation += 1
        self.deletions |= kind == "delete"

    def _filters(self) -> DataFrame:
        return self._table("filters", _FILTERS, self.generation) if self.generation else self.spark.createDataFrame([], _FILTERS)

    def _latest(self) -> DataFrame:
        """(key_a, key_b, n, last) of the keys with references."""
        totals = self._table("totals", _TOTALS)
        if self.generation > 1:
            totals = totals.groupBy(*KEY).agg(F.max_by(F.struct("n", "last"), "gen").alias("t")).select(*KEY, "t.n", "t.last")
        return totals.select(*KEY, "n", "last").where("n > 0")

    def _references(self) -> DataFrame:
        """(doc_id, key_a, key_b) of the documents that are in."""
        refs = self._table("refs", _REFS)
        if self.deletions:
            gone = self._table("deleted", _DELETED).groupBy("doc_id").agg(F.max("gen").alias("until"))
            refs = refs.join(join_side(gone), "doc_id", "left").where("until IS NULL OR until < gen")
        return refs.select("doc_id", *KEY)

    def _shard(self):
        return F.pmod(F.col("key_a"), F.lit(self.shards)).alias("shard")

    def insert(self, df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> LineIndex:
        """Add documents; a null or empty text is one empty line, and lines of any length and number are taken whole."""
        docs = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where("doc_id IS NOT NULL")
        least = self.least_chars
        refs = self._write("refs", _REFS, in_arrow(docs, _REFS, lambda b: _references(b, least)))
        if self.shards is None:
            self.shards = max(1, -(-refs.count() // SHARD_KEYS))
        batch = refs.groupBy(*KEY).agg(F.count("*").alias("n"), F.max("doc_id").alias("last")).select(self._shard(), *KEY, "n", "last")
        if self.generation:
            batch = self._looked_up(batch)
            known = batch.where("maybe").alias("b").join(
                self._latest().select(*KEY, F.col("n").alias("old_n"), F.col("last").alias("old_last")), KEY, "left")
            batch = batch.where("NOT maybe").select("shard", *KEY, "n", "last", F.lit(0).cast("bigint").alias("before")).unionByName(known.select(
                "shard", *KEY, (F.col("n") + F.coalesce("old_n", F.lit(0))).alias("n"), F.greatest("last", "old_last").alias("last"),
                F.coalesce("old_n", F.lit(0)).cast("bigint").alias("before")))
        else:
            batch = batch.withColumn("before", F.lit(0).cast("bigint"))
        totals = self._write("totals", _TOTALS, batch.select(*KEY, "shard", "n", "last", "before"))
        self._write("filters", _FILTERS, _kept_up(self._filters(), totals, self.least_docs))
        self._write("deleted", _DELETED, None)
        self._commit("insert")
        return self

    def _looked_up(self, batch: DataFrame) -> DataFrame:
        """New keys with ``maybe``; written, as it is read twice."""
        found = _looked_up(self._filters(), batch, ["shard"], 1)
        path = scratch_path(self.spark, "lines-looked-up")
        found.write.parquet(path)
        return self.spark.read.schema(found.schema).parquet(path)

    def delete(self, ids: DataFrame, doc_id: str = "doc_id") -> LineIndex:
        """Take all documents with these ids out; ids that are not in, null ones and repeated ones change nothing."""
        if not self.generation:
            return self
        ids = self._write("deleted", _DELETED, ids.select(F.col(doc_id).cast("long").alias("doc_id")).where("doc_id IS NOT NULL").distinct())
        refs = self._references()
        gone = refs.join(join_side(ids), "doc_id", "left_semi").groupBy(*KEY).agg(F.count("*").alias("less"))
        path = scratch_path(self.spark, "lines-gone")
        gone.write.parquet(path)
        gone = self.spark.read.schema(gone.schema).parquet(path)
        left = refs.join(gone.select(*KEY), KEY, "left_semi").join(join_side(ids), "doc_id", "left_anti").groupBy(*KEY).agg(F.max("doc_id").alias("last"))
        old = self._latest().select(*KEY, F.col("n").alias("before"))
        totals = gone.join(old, KEY).join(left, KEY, "left").select(
            *KEY, self._shard(), (F.col("before") - F.col("less")).alias("n"), "last", "before")
        self._write("refs", _REFS, None)
        totals = self._write("totals", _TOTALS, totals)
        self._write("filters", _FILTERS, _kept_up(self._filters(), totals, self.least_docs))
        self._commit("delete")
        return self

    def repeated(self) -> DataFrame:
        """(key_a, key_b, last): the repeated keys and the largest id that has them."""
        return self._latest().where(F.col("n") >= self.least_docs).select(*KEY, "last")

    def drops(self) -> DataFrame:
        """(doc_id, key_a, key_b): which documents lose their lines of which key.

        Filters are streamed against the references of their shard; shards with
        many references (one very common line has that) are dealt over several tasks. What passes is held
        against the exact table.
        """
        if not self.generation:
            return self.spark.createDataFrame([], _REFS)
        latest = self._latest().select(self._shard(), "n").groupBy("shard").agg(F.sum("n").alias("n"))
        parts = latest.select("shard", F.ceil(F.col("n") / PART_ROWS).cast("bigint").alias("parts"))
        path = scratch_path(self.spark, "lines-parts")
        parts.write.parquet(path)
        parts = self.spark.read.schema(parts.schema).parquet(path)
        filters = self._filters().join(parts, "shard").select("shard", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part"), "data")
        rows = self._references().select("*", self._shard()).join(join_side(parts), "shard").select(
            "shard", F.pmod(F.xxhash64("doc_id"), F.col("parts")).alias("part"), "doc_id", *KEY)
        maybe = _looked_up(filters, rows, ["shard", "part"], self.least_docs).where("maybe")
        return maybe.join(join_side(self.repeated()), KEY).where("doc_id < last").select("doc_id", *KEY)

    def without(self, df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
        """(doc_id, n_lines, n_dropped, kept) of every row of ``df`` without the lines it loses; others are joined by a line feed.

        Documents that are not in the index lose nothing. A null or empty
        text is one empty line. Repeated rows stay.
        """
        docs = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
        lists = self.drops().groupBy("doc_id").agg(F.collect_set(F.struct(*KEY)).alias("cut"))
        least = self.least_chars

        def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            texts, cuts = batch.column("text"), batch.column("cut")
            n_lines, n_dropped, kept = [], [], []
            for r in range(batch.num_rows):
                text = texts[r].as_py() or ""
                lines = text.count("\n") + 1
                n_lines.append(lines)
                if cuts[r].is_valid:
                    pairs = cuts[r].values
                    cut = {x.tobytes() for x in np.column_stack([pairs.field(i).to_numpy() for i in (0, 1)])}
                    stay = [
                        line for line in text.encode().split(b"\n")
                        if not (_long(k := line_key(line), least) and _digest(k) in cut)]
                    n_dropped.append(lines - len(stay))
                    text = b"\n".join(stay).decode()
                else:
                    n_dropped.append(0)
                kept.append(text)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.string())],
                ["doc_id", "n_lines", "n_dropped", "kept"])

        return in_arrow(docs.join(lists, "doc_id", "left"), "doc_id bigint, n_lines bigint, n_dropped bigint, kept string", run)
