"""Repeated passages: an FM-index per shard, matching statistics by backward search, intervals above a length."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, in_arrow, mixed, runs_hash, signed, words_of, written

# Words of an anchor: the least hash of the anchors in a window says which shard the window goes to.
ANCHOR = 6
# Words of a shard, about; memory of a task is some 150 bytes a word.
SHARD_WORDS = 100_000
# Different pieces of one anchor beyond which its windows go by their own hash instead of into one shard.
HOT_PIECES = 2_000
# And their words: with shards of whole anchors below this, no shard is much larger than SHARD_WORDS.
HOT_WORDS = 50_000
# Windows of a part that pieces of hot anchors are cut into; parts overlap, so that each window is in one.
PART_WINDOWS = 1_000
# Windows of hot anchors that one task cuts out, about.
TASK_WINDOWS = 10_000
# Words of the parts that one Arrow batch holds, about.
BATCH_WORDS = 500_000


class WaveletMatrix:
    """A sequence of small integers as one row of packed bits for each binary digit.

    ``rank`` counts a symbol in a prefix in one step for each digit; bits are
    held 64 to a word, with one count before each word.
    """

    def __init__(self, values: np.ndarray, top: int):
        self.n = len(values)
        self.levels = max(1, int(top).bit_length())
        self.bits, self.before, self.zeros = [], [], []
        for level in range(self.levels - 1, -1, -1):
            bit = ((values >> level) & 1).astype(bool)
            packed = np.packbits(np.concatenate([bit, np.zeros(-len(bit) % 64 + 64, bool)]), bitorder="little").view(np.uint64)
            self.bits.append(packed)
            counts = np.bitwise_count(packed).astype(np.int64)
            self.before.append(np.cumsum(counts) - counts)
            self.zeros.append(int(len(bit) - bit.sum()))
            values = np.concatenate([values[~bit], values[bit]])

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[level][word] + np.bitwise_count(self.bits[level][word] & mask)

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        low = np.zeros(len(at), np.int64)
        for k in range(self.levels):
            one = (symbol >> (self.levels - 1 - k)) & 1 == 1
            ones_low, ones_at = self._ones(k, low), self._ones(k, at)
            low = np.where(one, self.zeros[k] + ones_low, low - ones_low)
            at = np.where(one, self.zeros[k] + ones_at, at - ones_at)
        return at - low


class FMIndex:
    """Backward search over a text of integers >= 1, with 0 between its parts.

    Suffixes are sorted by their first ``depth`` symbols or more (doubling),
    which is enough for patterns of up to ``depth`` symbols.
    """

    def __init__(self, text: np.ndarray, depth: int):
        n = len(text)
        rank = text.astype(np.int64)
        order, h = np.argsort(rank, kind="stable"), 1
        while h < depth:
            after = np.zeros(n, np.int64)
            after[:n - h] = rank[h:] + 1
            key = rank * (n + 2) + after if int(rank.max()) < 2**62 // (n + 2) else None
            order = np.argsort(key, kind="stable") if key is not None else np.lexsort((after, rank))
            step = np.ones(n, np.int64)
            step[1:] = (rank[order[1:]] != rank[order[:-1]]) | (after[order[1:]] != after[order[:-1]])
            step[0] = 0
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(step)
            h *= 2
            if rank[order[-1]] == n - 1:
                break
        self.suffixes = order
        top = int(text.max())
        self.below = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=top + 1))])
        # The text is taken as a ring; the part before its first symbol ends in 0.
        self.last = WaveletMatrix(text[order - 1], top)

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the patterns with one more symbol in front."""
        start = self.below[symbol]
        return start + self.last.rank(symbol, low), start + self.last.rank(symbol, high)

    def first_of_window(self, text: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
        """For each window of ``size`` symbols that ends before ``ends``, its first place in the text.

        Matching statistics cut off at ``size``: a window is followed backwards
        as long as what was read also stands elsewhere; the window itself is
        the first place of those that end sooner.
        """
        found = ends - size
        least = None
        live = np.arange(len(ends))
        symbol = text[ends - 1]
        low, high = self.below[symbol], self.below[symbol + 1]
        for k in range(2, size + 1):
            more = high - low > 1
            live, low, high = live[more], low[more], high[more]
            if not len(live):
                return found
            low, high = self.extend(text[ends[live] - k], low, high)
        more = high - low > 1
        live, low, high = live[more], low[more], high[more]
        if len(live):
            # Intervals of different windows do not overlap: one minimum for each.
            starts, which = np.unique(low, return_inverse=True)
            stops = np.zeros(len(starts), np.int64)
            stops[which] = high
            cuts = np.empty(2 * len(starts), np.int64)
            cuts[0::2], cuts[1::2] = starts, stops
            least = np.minimum.reduceat(np.append(self.suffixes, len(text)), cuts)[0::2]
            found[live] = least[which]
        return found


def _windows(words: Words, size: int):
    """(anchor value of every window, first word of every window, anchors by word)."""
    grams, at = words.shingles(ANCHOR)
    value = np.full(len(words) + 1, np.iinfo(np.uint64).max, np.uint64)
    value[at] = mixed(grams)
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), value
    span, least, width = size - ANCHOR + 1, value[:-1].copy(), 1
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < span:
        least = np.minimum(least[:len(least) - (span - width)], least[span - width:])
    first = np.flatnonzero(words.row[:n] == words.row[size - 1:])
    return least[first], first, value


def _pieces(words: Words, size: int):
    """Runs of windows with one anchor: (first word, windows, anchor, windows may repeat inside)."""
    anchor, first, value = _windows(words, size)
    if not len(first):
        return first, first, anchor, np.zeros(0, bool)
    new = np.ones(len(first), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (first[1:] != first[:-1] + 1)
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(first)))
    start, anchor = first[at], anchor[at]
    span = size - ANCHOR + 1
    inside = count > span
    seen = np.zeros(len(at), np.int8)
    for t in range(2 * span - 1):
        p = np.minimum(start + t, len(value) - 1)
        seen += (value[p] == anchor) & (t < count + span - 1)
    return start, count, anchor, inside | (seen > 1)


def _anchors(batch: pa.RecordBatch, size: int) -> Iterator[pa.RecordBatch]:
    """Anchors of the pieces of a batch, with how many pieces have them; pieces that may repeat inside count twice."""
    for _, _, words in words_of(batch.column("text")):
        _, _, anchor, inside = _pieces(words, size)
        value, back = np.unique(anchor, return_inverse=True)
        n = np.bincount(back, 1 + inside).astype(np.int64) if len(back) else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([signed(value), pa.array(n)], ["anchor", "n"])


def _located(batch: pa.RecordBatch, size: int) -> Iterator[pa.RecordBatch]:
    """Pieces of a batch: document, first word, windows, anchor, 128 bits of the words, may repeat inside."""
    doc = batch.column("doc_id").to_numpy(zero_copy_only=False)
    for i, _, words in words_of(batch.column("text")):
        start, count, anchor, inside = _pieces(words, size)
        row = words.row[start]
        yield pa.RecordBatch.from_arrays(
            [pa.array(doc[i + row], pa.int64()), pa.array((start - words.first[row]).astype(np.int64)), pa.array(count.astype(np.int64)),
             signed(anchor), *(signed(runs_hash(words.hash, start, start + count + size - 1, seed)) for seed in (0, 1)), pa.array(inside)],
            ["doc_id", "start", "n", "anchor", "content", "content_b", "inside"])


def _ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first, first + 1, ... for ``count`` numbers each."""
    total = np.cumsum(count)
    return np.arange(int(total[-1]) if len(total) else 0) - np.repeat(total - count, count) + np.repeat(first, count)


def _contents(batch: pa.RecordBatch, size: int, part: int) -> Iterator[pa.RecordBatch]:
    """The words (as hashes) of the pieces that a document's row lists; hot ones in parts of ``part`` windows."""
    docs = batch.column("doc_id").to_numpy(zero_copy_only=False)
    lists = batch.column("pieces")
    out: dict[str, list] = {k: [] for k in ("shard", "hot", "doc_id", "start", "n", "words")}
    held = 0

    def done() -> pa.RecordBatch:
        arrays = [pa.array(out[k], t) for k, t in zip(out, (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))]
        for column in out.values():
            column.clear()
        return pa.RecordBatch.from_arrays(arrays, list(out))

    for i, j, words in words_of(batch.column("text")):
        for r in range(i, j):
            raw = words.hash[words.first[r - i]:words.first[r - i + 1]]
            for p in lists[r].as_py():
                a, n = p["start"], p["n"]
                if a + n + size - 1 > len(raw):
                    continue  # of another row with this id
                for at in range(a, a + n, part if p["hot"] else n):
                    many = min(part, a + n - at) if p["hot"] else n
                    out["shard"].append(p["shard"])
                    out["hot"].append(p["hot"])
                    out["doc_id"].append(int(docs[r]))
                    out["start"].append(at)
                    out["n"].append(many)
                    out["words"].append(raw[at:at + many + size - 1].tobytes())
                    held += many + size - 1
                    if held >= BATCH_WORDS:
                        yield done()
                        held = 0
    if held:
        yield done()


def _merged(doc: np.ndarray, first: np.ndarray, size: int):
    """Maximal runs of neighbouring windows as (document, first word, word behind the last)."""
    if not len(doc):
        return doc, first, first
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (first[1:] != first[:-1] + 1)
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(doc)) - 1
    return doc[at], first[at], first[last] + size


def _search(table: pa.Table, size: int) -> pa.Table:
    """Windows of a shard that also start earlier, by an FM-index of the shard."""
    order = np.lexsort((table["start"].to_numpy(), table["doc_id"].to_numpy()))
    table = table.take(pa.array(order))
    doc, start = table["doc_id"].to_numpy(), table["start"].to_numpy()
    # Rows that share an id count as one document.
    table = table.filter(pa.array(np.append(True, (doc[1:] != doc[:-1]) | (start[1:] != start[:-1]))))
    doc, start, n = (table[c].to_numpy() for c in ("doc_id", "start", "n"))
    raw = np.frombuffer(b"".join(table["words"].to_pylist()), np.uint64)
    length = n + size - 1
    symbol = np.unique(raw, return_inverse=True)[1] + 1
    offset = np.cumsum(length + 1) - (length + 1)  # each part is followed by a 0
    text = np.zeros(int(length.sum()) + len(length), np.int64)
    text[_ranges(offset, length)] = symbol
    index = FMIndex(text, size)
    begins = _ranges(offset, n)
    earliest = np.empty(len(begins), np.int64)
    for a in range(0, len(begins), 100_000):
        earliest[a:a + 100_000] = index.first_of_window(text, begins[a:a + 100_000] + size, size)
    hit = earliest < begins
    d, f, t = _merged(np.repeat(doc, n)[hit], _ranges(start, n)[hit], size)
    return pa.table({"doc_id": pa.array(d, pa.int64()), "from": pa.array(f, pa.int64()), "to": pa.array(t, pa.int64())})


def repeated(df: DataFrame, size: int = 20, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, from, to): word intervals covered by windows of ``size`` words that also start earlier.

    Earlier means in a document with a smaller id, or in the same one
    further in front. Words are runs of anything but ASCII white space. Ids
    are whole numbers and unique; repeated rows count as one document, rows without an id are left out. Null, empty and short texts have
    no interval; an empty table gives an empty one; other columns are not looked at.

    A window belongs to the least hash of the word sextuples (anchors) in it, so equal
    windows meet wherever they stand, and a document is cut into pieces of
    neighbouring windows with one anchor. Anchors met once are counted out
    first. Equal pieces fold to their first; later ones are repeats as a
    whole. Only anchors with several different pieces go on, to shards of
    about ``SHARD_WORDS`` words, each with an FM-index that its pieces are
    streamed against. Windows of anchors with very many different pieces, or more
    than ``HOT_WORDS`` words in them, go by the hash of the whole window instead, cut into
    parts of bounded length, so no shard grows with a hot passage or a long stretch.
    """
    docs = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where("doc_id IS NOT NULL")
    counted = in_arrow(docs.select("text"), "anchor bigint, n bigint", lambda b: _anchors(b, size))
    anchors = counted.groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1").select("anchor")
    anchors = written(anchors, "anchors")
    where = "doc_id bigint, start bigint, n bigint, anchor bigint, content bigint, content_b bigint, inside boolean"
    pieces = in_arrow(docs, where, lambda b: _located(b, size)).join(anchors, "anchor", "left_semi")
    pieces = written(pieces, "pieces")
    # The first of equal pieces.
    same = ["anchor", "content", "content_b"]
    firsts = written(pieces.groupBy(*same).agg(
        F.min(F.struct("doc_id", "start")).alias("first"), F.max("n").alias("n"), F.max("inside").alias("inside")), "firsts")
    later = (
        pieces.join(firsts.select(*same, "first"), same)
        .where((F.col("doc_id") != F.col("first.doc_id")) | (F.col("start") != F.col("first.start")))
        .select("doc_id", F.col("start").alias("from"), (F.col("start") + F.col("n") + size - 1).alias("to"))
    )
    several = firsts.groupBy("anchor").agg(
        F.count("*").alias("different"), F.sum(F.col("n") + size - 1).alias("words"), F.max("inside").alias("any")).where("different > 1 OR any")
    known = written(firsts.join(several, "anchor").select(
        "anchor", F.col("first.doc_id").alias("doc_id"), F.col("first.start").alias("start"), "n",
        ((F.col("different") > HOT_PIECES) | (F.col("words") > HOT_WORDS)).alias("hot")), "searched")
    part = PART_WINDOWS
    total, many = known.agg(F.coalesce(F.sum(F.col("n") + size), F.lit(0)), F.coalesce(F.sum(F.when(F.col("hot"), F.col("n"))), F.lit(0))).first()
    shards = max(1, -(-total // SHARD_WORDS))
    by_doc = known.withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards))).groupBy("doc_id").agg(
        F.collect_list(F.struct("shard", "hot", "start", "n")).alias("pieces"))
    contents = written(in_arrow(
        docs.join(by_doc, "doc_id"), "shard bigint, hot boolean, doc_id bigint, start bigint, n bigint, words binary",
        lambda b: _contents(b, size, part)), "contents")
    searched = (
        contents.where("NOT hot").groupBy("shard")
        .applyInArrow(lambda t: _search(t, size), "doc_id bigint, from bigint, to bigint")
    )
    return later.unionByName(searched).unionByName(_by_window(contents.where("hot"), size, many))


def _by_window(contents: DataFrame, size: int, many: int) -> DataFrame:
    """The same for the ``many`` windows of hot anchors: they meet by their own hash, folded to the first before they meet."""
    def cut(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if not batch.num_rows:
            return
        doc, start, n = (batch.column(c).to_numpy() for c in ("doc_id", "start", "n"))
        raw = np.frombuffer(b"".join(batch.column("words").to_pylist()), np.uint64)
        length = n + size - 1
        at = _ranges(np.cumsum(length) - length, n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(doc, n)), pa.array(_ranges(start, n)), *(signed(runs_hash(raw, at, at + size, seed)) for seed in (0, 1))],
            ["doc_id", "start", "window", "window_b"])

    # Dealt out evenly, as the documents that hold a hot passage may lie together.
    parts = contents.select("doc_id", "start", "n", "words").repartition(max(1, -(-many // TASK_WINDOWS)))
    windows = in_arrow(parts, "doc_id bigint, start bigint, window bigint, window_b bigint", cut)
    first = windows.groupBy("window", "window_b").agg(F.min(F.struct("doc_id", "start")).alias("first"))
    return (
        windows.join(first, ["window", "window_b"])
        .where((F.col("doc_id") != F.col("first.doc_id")) | (F.col("start") != F.col("first.start")))
        .select("doc_id", F.col("start").alias("from"), (F.col("start") + size).alias("to"))
    )


def without(df: DataFrame, intervals: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_words, n_removed, kept) of every document without the words of its intervals; kept joined by one space."""
    docs = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    lists = intervals.groupBy("doc_id").agg(F.collect_list(F.struct("from", "to")).alias("cut"))

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        cuts = batch.column("cut")
        texts = batch.column("text")
        n_words, n_removed, kept = [], [], []
        for r in range(batch.num_rows):
            words = (texts[r].as_py() or "").encode().split()
            n_words.append(len(words))
            cut = cuts[r].as_py()
            if cut:
                stay = np.zeros(len(words) + 1, np.int64)
                for c in cut:
                    stay[min(c["from"], len(words))] += 1
                    stay[min(c["to"], len(words))] -= 1
                words = [words[k] for k in np.flatnonzero(np.cumsum(stay[:-1]) == 0)]
            n_removed.append(n_words[-1] - len(words))
            kept.append(b" ".join(words).decode())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())],
            ["doc_id", "n_words", "n_removed", "kept"])

    return in_arrow(docs.join(lists, "doc_id", "left"), "doc_id bigint, n_words bigint, n_removed bigint, kept string", run)
