"""Near copies: similarity sketches by rounds of bin placement, banding, exact verification, classes."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, least_ids, mixed, powers, words_of, written

WORDS = 5  # of a shingle
# Coordinates of a sketch. They are cut into bands; two sets meet where a whole band agrees.
COORDINATES = 384
# Two low bits of each coordinate, packed, estimate a similarity before texts are fetched.
LANES = COORDINATES // 64
ESTIMATE = [f"bits{b}" for b in range(2 * LANES)]
# A pair is ruled out where the estimate is so many standard deviations below the threshold (at it: less than 4e-6).
DEVIATIONS = 4.5


def shape(percent: int) -> tuple[int, int]:
    """(bands, coordinates of a band): the widest bands that lose a pair at the threshold with less than 1e-6."""
    for width in (12, 8, 6, 4, 3, 2, 1):
        bands = COORDINATES // width
        if (1 - (percent / 100) ** width) ** bands < 1e-6:
            return bands, width
    raise ValueError("the threshold is too low for sketches of this size")


def _rounds(members: np.ndarray, t: int) -> np.ndarray:
    """A sketch of t coordinates: in each round every member is placed in a bin with a value of that round.

    Members fall into hashed bins in the first t rounds, and in round t + k
    all meet in bin k, so every coordinate fills. A bin keeps the least value, and
    earlier rounds are below later ones, so rounds after the last bin is full
    change nothing. The agreement of two sketches is concentrated around the
    similarity as if coordinates were drawn one by one.
    """
    none = np.uint64(np.iinfo(np.uint64).max)
    out = np.full(t, none, np.uint64)
    seeds = mixed(powers(0xD6E8FEB86659FD93, 2 * t + 1)[1:])
    low = np.uint64(0xFFFFFFFF)
    k, step = 0, max(1, 8 * t // len(members))
    while k < t:
        some = np.arange(k, min(t, k + step), dtype=np.uint64)
        h = mixed(members[None, :] ^ seeds[k:k + len(some), None])
        at = ((h >> np.uint64(32)) * np.uint64(t)) >> np.uint64(32)
        np.minimum.at(out, at.astype(np.int64).ravel(), ((some << np.uint64(32))[:, None] | (h & low)).ravel())
        if (out != none).all():
            return out
        k += len(some)
    for bin_ in np.flatnonzero(out == none):
        h = mixed(members ^ seeds[t + bin_])
        out[bin_] = (np.uint64(t + bin_) << np.uint64(32)) | (h & low).min()
    return out


def _sets(words, k: int):
    """Per text: distinct hashes of its shingles; of the whole text where it has fewer words."""
    shingle, at = words.shingles(k)
    row = words.row[at]
    cuts = np.searchsorted(row, np.arange(len(words.offsets)))
    for r in range(len(words.offsets) - 1):
        if cuts[r] < cuts[r + 1]:
            yield np.unique(shingle[cuts[r]:cuts[r + 1]])
        elif words.first[r] < words.first[r + 1]:
            raw = words.hash[words.first[r]:words.first[r + 1]]
            yield mixed(np.array([(raw * powers(0x9E3779B97F4A7C15, len(raw) + 1)[1:]).sum() + np.uint64(len(raw))], np.uint64))
        else:
            yield np.zeros(0, np.uint64)


def sketches(df: DataFrame, percent: int, k: int = WORDS) -> DataFrame:
    """(doc_id, n_shingles, key, bits, bands) of (doc_id, text): a digest of the words, packed low bits, a hash for each band."""
    n_bands, width = shape(percent)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids = batch.column("doc_id")
        for i, j, words in words_of(batch.column("text"), lower=True):
            sizes, bits, bands = [], [], []
            for members in _sets(words, k):
                sizes.append(len(members))
                if len(members):
                    sketch = _rounds(members, COORDINATES)
                    bits.append(np.packbits(np.concatenate([(sketch & np.uint64(b)).astype(bool) for b in (1, 2)])).view(np.int64))
                    rows = sketch.reshape(n_bands, width) * powers(0xC2B2AE3D27D4EB4F, width + 1)[1:]
                    bands.append(mixed(rows.sum(axis=1) + np.arange(n_bands, dtype=np.uint64)).view(np.int64))
                else:
                    bits.append(np.zeros(2 * LANES, np.int64))
                    bands.append(np.zeros(0, np.int64))
            ends = np.cumsum([0] + [len(b) for b in bands]).astype(np.int32)
            keys = np.frombuffer(b"".join(words.digests()), np.int64).reshape(-1, 2)
            bits = np.array(bits, np.int64).reshape(-1, 2 * LANES)
            yield pa.RecordBatch.from_arrays(
                [ids.slice(i, j - i), pa.array(sizes, pa.int64()), pa.array(keys[:, 0]), pa.array(keys[:, 1]),
                 *[pa.array(bits[:, b]) for b in range(2 * LANES)],
                 pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(bands) if bands else np.zeros(0, np.int64)))],
                ["doc_id", "n_shingles", "key_a", "key_b", *ESTIMATE, "bands"])

    lanes = ", ".join(f"{b} bigint" for b in ESTIMATE)
    return in_arrow(df, f"doc_id bigint, n_shingles bigint, key_a bigint, key_b bigint, {lanes}, bands array<bigint>", run)


def _close(a: str, b: str, percent: int):
    """Sizes allow the similarity, and sketches do not rule it out."""
    apart = lambda k: F.col(f"{a}.bits{k}").bitwiseXOR(F.col(f"{b}.bits{k}"))
    differ = reduce(lambda x, y: x + y, (F.bit_count(apart(k).bitwiseOR(apart(k + LANES))) for k in range(LANES)))
    odds = (1 - percent / 100) * 3 / 4
    most = int(COORDINATES * odds + DEVIATIONS * (COORDINATES * odds * (1 - odds)) ** 0.5)
    na, nb = F.col(f"{a}.n_shingles"), F.col(f"{b}.n_shingles")
    return (100 * F.least(na, nb) >= percent * F.greatest(na, nb)) & (differ <= most)


def _first_meeting(a: str, b: str):
    """The two sets share no earlier band than this row's, so a pair is met in one bucket only."""
    return ~F.arrays_overlap(F.slice(f"{a}.bands", 1, F.col(f"{a}.band")), F.slice(f"{b}.bands", 1, F.col(f"{b}.band")))


def _shingles(text: str | None, k: int) -> set:
    words = (text or "").encode().lower().split()
    return {tuple(words[i:i + k]) for i in range(len(words) - k + 1)} or ({tuple(words)} if words else set())


def confirmed(pairs: DataFrame, docs: DataFrame, percent: int, k: int = WORDS) -> DataFrame:
    """Pairs (a, b) whose full shingle sets have 100 * intersection >= percent * union."""
    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        stay, known = [], {}
        for a, b, x, y in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "text_a", "text_b"))):
            if len(known) > 500:
                known = {}
            for i, t in ((a, x), (b, y)):
                if i not in known:
                    known[i] = _shingles(t, k)
            both = len(known[a] & known[b])
            stay.append(100 * both >= percent * (len(known[a]) + len(known[b]) - both))
        yield batch.select(["a", "b"]).filter(pa.array(stay, pa.bool_()))

    side = lambda c: docs.select(F.col("doc_id").alias(c), F.col("text").alias(f"text_{c}"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "text_a", "text_b")
    return in_arrow(joined, "a bigint, b bigint", run)


def classes(df: DataFrame, percent: int = 85, k: int = WORDS, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every document.

    A document's set is its distinct runs of k words, A-Z lower-cased; with
    fewer words all of them as one; without words (null, empty) the set is empty, linked with
    nothing. Documents with 100 * intersection >= percent * union of their
    sets are linked; ``component_id`` is the smallest id that links reach.
    Ids are whole numbers, unique and not null. Repeated texts are one class;
    an empty table gives an empty one; other columns are not looked at.

    Texts of equal words (by a digest of 128 bits) fold first, so groups of exact copies count as one. Each distinct
    text's set takes part in a bucket for each band (48 of 8 coordinates at 85): at the
    threshold the chance to share none is below 1e-6. A bucket does not emit its pairs:
    its members first meet its most central one alone (each keeps one such pair), confirmed
    pairs join into classes, and only members of different classes in a bucket
    are then compared, by sizes and packed sketches inside the join, each pair in the first
    bucket it shares. Every link is confirmed on the full texts.
    """
    docs = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    made = written(sketches(docs, percent, k), "sketches")
    exact = made.where("n_shingles > 0").groupBy("key_a", "key_b").agg(F.min("doc_id").alias("rep"))
    exact = written(exact, "exact")
    sets = made.join(exact.select(F.col("rep").alias("doc_id")), "doc_id")
    sets = written(sets.select("doc_id", "n_shingles", *ESTIMATE, "bands"), "sets")
    narrow = sets.drop("bands")
    members = sets.select("doc_id", F.posexplode("bands").alias("band", "bucket"))
    shared = members.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    members = written(members.join(shared, "bucket"), "buckets")
    # The most central member of a bucket: the one whose buckets hold most, so copies meet what they were made from.
    central = members.groupBy("doc_id").agg(F.sum("n").alias("weight"))
    seats = members.join(central, "doc_id").select("bucket", "doc_id", "weight")
    heads = seats.groupBy("bucket").agg(F.max(F.struct("weight", -F.col("doc_id"))).alias("head")).select(
        "bucket", F.col("head.weight").alias("weight"), (-F.col("head.col2")).alias("head"))
    near = members.join(heads, "bucket").where("head <> doc_id").groupBy("doc_id", "head").agg(F.max("weight").alias("weight"))
    near = near.alias("p").join(narrow.alias("x"), F.col("p.doc_id") == F.col("x.doc_id")).join(
        narrow.alias("y"), F.col("p.head") == F.col("y.doc_id")).where(_close("x", "y", percent))
    one = near.groupBy("p.doc_id").agg(F.max(F.struct("p.weight", "p.head")).alias("m")).select(
        F.col("doc_id").alias("a"), F.col("m.head").alias("b"))
    reps = docs.join(exact.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
    links = written(confirmed(one, reps, percent, k), "links")
    found = written(least_ids(links), "classes")
    # What still stands in different classes of one bucket.
    placed = members.join(found.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left").select(
        "band", "bucket", "doc_id", F.coalesce("component", "doc_id").alias("component"))
    mixed_up = placed.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("bucket")
    rest = written(placed.join(mixed_up, "bucket"), "rest").join(sets, "doc_id")
    pairs = rest.alias("x").join(
        rest.alias("y"),
        (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.component") < F.col("y.component")) & _close("x", "y", percent) & _first_meeting("x", "y"),
    ).select(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b"))
    more = confirmed(pairs, reps, percent, k)
    found = least_ids(links.union(more))
    classed = exact.join(found.select(F.col("node").alias("rep"), "component"), "rep", "left").select(
        "key_a", "key_b", F.coalesce("component", "rep").alias("component"))
    out = made.select("doc_id", "n_shingles", "key_a", "key_b").join(classed, ["key_a", "key_b"], "left")
    own = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id"), (own == F.col("doc_id")).alias("kept"))
