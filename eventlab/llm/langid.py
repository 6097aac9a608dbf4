"""Language of a text: interpolated Kneser-Ney character models in sorted hash arrays."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, in_arrow, mixed, numbered, signed, words_of, written

ORDER = 5
BITS = 12  # of a symbol: 0 before a word, 1 behind it, else a hash of the letter
SYMBOLS = 1 << BITS
# Cells (grams times languages) of the largest table of a model, and counted grams, that are held as arrays on the
# driver and in tasks. A model with more of them stays in Spark's tables, whole.
CELLS = 32_000_000
RUNS = 4_000_000
# Commonest words or grams that are joined by broadcast in that case.
COMMON = 1_000
# Grams that a task gathers before it folds them.
GATHERED = 2_000_000
SHARPNESS = tuple(float(2**k) for k in range(-2, 9))
TOLERATED = 0.995  # share of a language's own texts that are not rejected

_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1))
    return _letters[0]


def grams_of(words: Words, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed runs of five symbols of some words' lower-cased letters, and how many each word has (0 without a letter)."""
    if not len(which):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    raw = words.data.tobytes()
    text = b"\n".join([raw[a:b] for a, b in zip(words.start[which].tolist(), words.end[which].tolist())]).decode().lower()
    code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    owner = np.cumsum(code == 10)
    good = _is_letter()[code]
    owner, code = owner[good], code[good]
    size = np.bincount(owner, minlength=len(which))
    have = size > 0
    room = np.where(have, size + ORDER, 0)  # four marks in front and one behind
    at = np.cumsum(room) - room
    symbols = np.zeros(int(room.sum()), np.uint64)
    inside = np.arange(len(code)) - np.repeat(np.cumsum(size) - size, size)
    symbols[at[owner] + ORDER - 1 + inside] = 2 + code % (SYMBOLS - 3)
    symbols[(at + room - 1)[have]] = 1
    count = np.where(have, size + 1, 0)
    begins = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(at, count)
    packed = np.zeros(len(begins), np.uint64)
    for k in range(ORDER):
        packed = (packed << np.uint64(BITS)) | symbols[begins + k]
    return packed, count


def gram_counts(df: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, gram, n): how often each run of five symbols stands in the texts of each language; over all rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs: dict[str, int] = {}
        held: list = []

        def fold() -> None:
            if held:
                who, gram, n = (np.concatenate(x) for x in zip(*held))
                order = np.lexsort((gram, who))
                who, gram, n = who[order], gram[order], n[order]
                new = np.append(True, (who[1:] != who[:-1]) | (gram[1:] != gram[:-1]))
                at = np.flatnonzero(new)
                held[:] = [(who[at], gram[at], np.add.reduceat(n, at))]

        def out() -> pa.RecordBatch:
            fold()
            who, gram, n = held.pop()
            names = pa.array(list(langs), pa.string())
            return pa.RecordBatch.from_arrays([names.take(pa.array(who)), pa.array(gram.astype(np.int64)), pa.array(n)], ["lang", "gram", "n"])

        for batch in batches:
            labels = batch.column("lang").to_pylist()
            number = np.array([langs.setdefault(x, len(langs)) for x in labels], np.int64)
            for i, j, words in words_of(batch.column("text")):
                who = number[i:j][words.row]
                _, one, back = np.unique(words.hash ^ mixed(who.astype(np.uint64) + np.uint64(1)), return_index=True, return_inverse=True)
                times = np.bincount(back, minlength=len(one))
                gram, count = grams_of(words, one)
                held.append((np.repeat(who[one], count), gram, np.repeat(times, count)))
            if sum(len(h[1]) for h in held) > GATHERED:
                fold()
                if len(held[0][1]) > GATHERED:
                    yield out()
        if held:
            yield out()

    rows = df.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    return rows.mapInArrow(run, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    """Tables of each order, low to high: hashes in order, log probability by language; and of contexts, log of the weight left to shorter ones."""

    langs: list[str]
    grams: list[tuple[np.ndarray, np.ndarray]]
    contexts: list[tuple[np.ndarray, np.ndarray]]
    floor: float
    sharpness: float = 16.0
    limits: tuple[float, ...] = ()

    def log_prob(self, gram: np.ndarray) -> np.ndarray:
        """Log probability of the last symbol of each packed run after the others, by language."""
        out = np.zeros((len(gram), len(self.langs)), np.float32)
        live = np.arange(len(gram))
        for order in range(ORDER, 0, -1):
            key = gram[live] & np.uint64((1 << (BITS * order)) - 1)
            at, hit = _find(self.grams[order - 1][0], key)
            out[live[hit]] += self.grams[order - 1][1][at[hit]]
            live, key = live[~hit], key[~hit]
            at, hit = _find(self.contexts[order - 1][0], key >> np.uint64(BITS))
            out[live[hit]] += self.contexts[order - 1][1][at[hit]]
        out[live] += self.floor
        return out

    def entropies(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy of each text under each language in nats a symbol, and its symbols (0: no letter)."""
        found, sizes = [], []
        for i, j, words in words_of(column):
            total, symbols = np.zeros((j - i, len(self.langs))), np.zeros(j - i, np.int64)
            if len(words):
                _, one, back = np.unique(words.hash, return_index=True, return_inverse=True)
                gram, count = grams_of(words, one)
                owner = np.repeat(np.arange(len(one)), count)
                prob = self.log_prob(gram)
                by_word = np.stack([np.bincount(owner, prob[:, k], len(one)) for k in range(len(self.langs))], 1)
                has = np.flatnonzero(np.diff(words.first) > 0)
                total[has] = np.add.reduceat(by_word[back], words.first[has], axis=0)
                symbols[has] = np.add.reduceat(count[back], words.first[has])
            found.append(-total / np.maximum(symbols, 1)[:, None])
            sizes.append(symbols)
        if not found:
            return np.zeros((0, len(self.langs))), np.zeros(0, np.int64)
        return np.concatenate(found), np.concatenate(sizes)


def _find(table: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where hashes of the keys stand in a sorted array of hashes (with one more at its end), and whether they do.

    Hashes are spread evenly, so a search starts at the place that the upper bits
    tell and goes on by one.
    """
    h = mixed(key + np.uint64(1))
    bits = max(1, len(table).bit_length())
    start = _starts(table, bits)
    at = start[(h >> np.uint64(64 - bits)).astype(np.int64)]
    live = np.flatnonzero(table[at] < h)
    while len(live):
        at[live] += 1
        live = live[table[at[live]] < h[live]]
    return at, table[at] == h


_start_of: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _starts(table: np.ndarray, bits: int) -> np.ndarray:
    """First place of each value of the upper bits, remembered for the table."""
    have = _start_of.get(id(table))
    if have is None or have[0] is not table:
        if len(_start_of) > 64:
            _start_of.clear()
        have = (table, np.searchsorted(table, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)))
        _start_of[id(table)] = have
    return have[1]


def _sorted(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h = mixed(keys + np.uint64(1))
    order = np.argsort(h)
    return np.append(h[order], np.uint64(np.iinfo(np.uint64).max)), np.append(values[order], np.zeros((1, values.shape[1])), axis=0).astype(np.float32)


def build(counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> Model:
    """Interpolated Kneser-Ney models of {language: (packed runs, counts)}.

    The highest order discounts counts; lower ones discount how many different symbols
    a run follows; each is mixed with the next lower one, the lowest with an even share.
    """
    langs = sorted(counts)
    levels: list[dict] = []  # from the highest order down: language -> (keys, counts)
    level = {k: (counts[k][0].astype(np.uint64), counts[k][1].astype(np.float64)) for k in langs}
    for order in range(ORDER, 0, -1):
        levels.append(level)
        mask = np.uint64((1 << (BITS * (order - 1))) - 1)
        level = {k: tuple(np.unique(v[0] & mask, return_counts=True)) for k, v in level.items()}
    grams, contexts = [], []
    shorter_keys = np.zeros(1, np.uint64)
    alphabet = max(2, len(np.unique(np.concatenate([v[0] for v in levels[-1].values()]))) + 1 if langs else 2)
    shorter = np.full((1, len(langs)), 1.0 / alphabet)
    for order, level in enumerate(reversed(levels), 1):
        keys = np.unique(np.concatenate([v[0] for v in level.values()])) if langs else np.zeros(0, np.uint64)
        heads = np.unique(keys >> np.uint64(BITS))
        prob, left = np.zeros((len(keys), len(langs))), np.ones((len(heads), len(langs)))
        mask = np.uint64((1 << (BITS * (order - 1))) - 1)
        below = shorter[np.searchsorted(shorter_keys, keys & mask)]
        head = np.searchsorted(heads, keys >> np.uint64(BITS))
        for k, lang in enumerate(langs):
            own, n = level[lang]
            n = np.asarray(n, np.float64)
            once, twice = (n == 1).sum(), (n == 2).sum()
            discount = min(0.95, max(0.1, once / max(1, once + 2 * twice)))
            at = np.searchsorted(keys, own)
            total = np.bincount(head[at], n, len(heads))
            kinds = np.bincount(head[at], minlength=len(heads))
            seen = total > 0
            left[seen, k] = discount * kinds[seen] / total[seen]
            prob[at, k] = (n - discount) / total[head[at]]
            prob[:, k] += left[head, k] * below[:, k]
        grams.append(_sorted(keys, np.log(prob)))
        contexts.append(_sorted(heads, np.log(left)))
        shorter_keys, shorter = keys, prob
    return Model(langs, grams, contexts, float(-np.log(alphabet)))


def _collected(counted: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """All counts on the driver."""
    table = counted.select("lang", "gram", "n").toArrow()
    names = table["lang"].to_pandas().to_numpy()
    gram, n = table["gram"].to_numpy().view(np.uint64), table["n"].to_numpy()
    return {lang: (gram[names == lang], n[names == lang]) for lang in set(names)}


@dataclass
class Tables:
    """The same models as tables of each order, low to high: (key, parts: language and discounted share) and (head, lefts: language and weight left to shorter ones)."""

    langs: list[str]
    grams: list[DataFrame]
    contexts: list[DataFrame]
    floor: float
    sharpness: float = 16.0
    limits: tuple[float, ...] = ()


def tables(counted: DataFrame, langs: list[str]) -> Tables:
    """What ``build`` makes, from any number of counted runs: nothing but a few numbers a language comes to the driver."""
    spark = counted.sparkSession
    numbers = spark.createDataFrame(list(enumerate(langs)), "k int, lang string")
    level = written(counted.join(F.broadcast(numbers), "lang").select("k", F.col("gram").alias("key"), "n"), "level")
    grams, contexts = [], []
    for order in range(ORDER, 0, -1):
        counts = level.groupBy("k").agg(F.sum((F.col("n") == 1).cast("long")).alias("once"), F.sum((F.col("n") == 2).cast("long")).alias("twice")).collect()
        discounts = spark.createDataFrame([(r["k"], min(0.95, max(0.1, r["once"] / max(1, r["once"] + 2 * r["twice"])))) for r in counts], "k int, d double")
        level = level.withColumn("head", F.shiftright("key", BITS))
        heads = written(level.groupBy("k", "head").agg(F.sum("n").alias("total"), F.count("*").alias("kinds")).join(F.broadcast(discounts), "k"), "heads")
        parts = level.join(heads, ["k", "head"]).select("key", F.struct("k", ((F.col("n") - F.col("d")) / F.col("total")).alias("v")).alias("part"))
        grams.append(written(parts.groupBy("key").agg(F.collect_list("part").alias("parts")), "parts"))
        lefts = heads.select("head", F.struct("k", (F.col("d") * F.col("kinds") / F.col("total")).alias("v")).alias("left"))
        contexts.append(written(lefts.groupBy("head").agg(F.collect_list("left").alias("lefts")), "lefts"))
        if order > 1:
            shorter = F.col("key").bitwiseAND(F.lit((1 << (BITS * (order - 1))) - 1))
            level = written(level.groupBy("k", shorter.alias("key")).agg(F.count("*").alias("n")), "level")
    alphabet = max(2, grams[-1].count() + 1)
    return Tables(langs, grams[::-1], contexts[::-1], float(-np.log(alphabet)))


def log_probs(grams: DataFrame, model: Tables) -> DataFrame:
    """(gram, p): log probability by language of each distinct run of ``grams``, from the lowest order up."""
    many, floor, below = len(model.langs), model.floor, None

    def mix(batch: pa.RecordBatch, last: bool) -> Iterator[pa.RecordBatch]:
        n = batch.num_rows
        part, left = np.zeros((n, many)), np.ones((n, many))
        for name, into in (("parts", part), ("lefts", left)):
            column = batch.column(name)
            row = np.repeat(np.arange(n), column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            k, v = column.flatten().flatten()
            into[row, k.to_numpy(zero_copy_only=False)] = v.to_numpy(zero_copy_only=False)
        short = _dense(batch.column("below"), many) if "below" in batch.schema.names else np.exp(floor)
        p = part + left * short
        p = np.log(p) if last else p
        yield pa.RecordBatch.from_arrays([batch.column("key"), pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * many, p.ravel())], ["key", "p"])

    for order in range(1, ORDER + 1):
        key = F.col("gram").bitwiseAND(F.lit((1 << (BITS * order)) - 1))
        keys = grams.select(key.alias("key")).distinct().withColumn("head", F.shiftright("key", BITS))
        keys = keys.join(model.grams[order - 1], "key", "left").join(model.contexts[order - 1], "head", "left")
        if below is not None:
            keys = keys.withColumn("tail", F.col("key").bitwiseAND(F.lit((1 << (BITS * (order - 1))) - 1)))
            keys = keys.join(below.select(F.col("key").alias("tail"), F.col("p").alias("below")), "tail")
        keys = keys.drop("head", "tail")
        below = written(in_arrow(keys, "key bigint, p array<double>", lambda b, last=order == ORDER: mix(b, last)), "probs")
    return below.withColumnRenamed("key", "gram")


def _dense(column: pa.Array, many: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), many)


def _meet(rows: DataFrame, one: DataFrame, on: str) -> DataFrame:
    """Rows joined to the one row of their key; the commonest keys by broadcast, so that none goes to one task."""
    common = rows.groupBy(on).count().orderBy(F.desc("count"), on).limit(COMMON).select(on)
    common = written(common.join(one, on), "common")
    rest = rows.join(F.broadcast(common.select(on)), on, "left_anti").join(one, on)
    return rows.join(F.broadcast(common), on).unionByName(rest)


def with_sums(df: DataFrame, model: Tables, text: str = "text") -> DataFrame:
    """``df`` with ``_sums`` (log probability of the text by language) and ``_symbols``, by its distinct words and their distinct runs."""
    base = numbered(written(df, "texts"))
    texts = base.select("_row", F.col(f"`{text}`").alias("text"))

    def words_in(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        number = batch.column("_row").to_numpy()
        for i, _, words in words_of(batch.column("text")):
            key = words.hash ^ mixed(words.row.astype(np.uint64) + np.uint64(1))
            _, one, times = np.unique(key, return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(number[i + words.row[one]]), signed(words.hash[one]), pa.array(times)], ["_row", "word", "times"])

    def grams_in(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for _, _, words in words_of(batch.column("text")):
            value, one = np.unique(words.hash, return_index=True)
            gram, count = grams_of(words, one)
            lists = pa.ListArray.from_arrays(np.append(0, np.cumsum(count)).astype(np.int32), pa.array(gram.view(np.int64)))
            yield pa.RecordBatch.from_arrays([signed(value), lists], ["word", "grams"]).filter(pa.array(count > 0))

    vocabulary = in_arrow(texts.select("text"), "word bigint, grams array<bigint>", grams_in)
    vocabulary = written(vocabulary.groupBy("word").agg(F.first("grams").alias("grams")), "vocabulary")
    grams = vocabulary.select("word", F.explode("grams").alias("gram"))
    span = range(len(model.langs))
    by_word = _meet(grams, log_probs(grams.select("gram").distinct(), model), "gram").groupBy("word").agg(
        F.array(*[F.sum(F.col("p")[k]) for k in span]).alias("p"), F.count("*").alias("symbols"))
    rows = in_arrow(texts, "_row bigint, word bigint, times bigint", words_in)
    sums = _meet(rows, written(by_word, "words"), "word").groupBy("_row").agg(
        F.array(*[F.sum(F.col("p")[k] * F.col("times")) for k in span]).alias("_sums"), F.sum(F.col("symbols") * F.col("times")).alias("_symbols"))
    return base.join(sums, "_row", "left").drop("_row")


def _scored(df: DataFrame, model: Model | Tables, text: str):
    """Rows to go over, and what tells the cross-entropies and symbols of a batch of them."""
    if isinstance(model, Model):
        return df, lambda batch: model.entropies(batch.column(text))
    many = len(model.langs)

    def told(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        symbols = batch.column("_symbols").fill_null(0).to_numpy(zero_copy_only=False)
        entropy = np.zeros((batch.num_rows, many))
        entropy[symbols > 0] = -_dense(batch.column("_sums").drop_null(), many) / symbols[symbols > 0][:, None]
        return entropy, symbols

    return with_sums(df, model, text), told


def fit(learn: DataFrame, calibrate: DataFrame, text: str = "text", lang: str = "lang") -> Model | Tables:
    """Models from all rows of ``learn``, with sharpness and limits from all rows of ``calibrate``.

    Rows without text or language teach nothing. All counted runs are kept: models that fit
    ``CELLS`` and ``RUNS`` are arrays, larger ones stay tables that distinct runs are joined to.
    Limits are the cross-entropy that
    ``TOLERATED`` of a language's own texts stay below; sharpness is the power
    of two by which the posteriors of ``calibrate`` are likeliest.
    """
    counted = written(gram_counts(learn, text, lang), "grams")
    langs = sorted(r["lang"] for r in counted.select("lang").distinct().collect())
    runs = counted.count()
    small = runs <= RUNS and (runs * len(langs) <= CELLS or counted.select("gram").distinct().count() * len(langs) <= CELLS)
    model = build(_collected(counted)) if small else tables(counted, langs)
    rows = calibrate.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    if not langs:
        return model
    rows, told = _scored(rows, model, "text")
    number = {x: k for k, x in enumerate(langs)}

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        own = np.array([number.get(x, -1) for x in batch.column("lang").to_pylist()], np.int64)
        entropy, symbols = told(batch)
        good = (own >= 0) & (symbols > 0)
        entropy, own = entropy[good], own[good]
        here = entropy[np.arange(len(own)), own] if len(own) else np.zeros(0)
        cost = [_cost(entropy, own, s) for s in SHARPNESS]
        yield pa.RecordBatch.from_arrays(
            [pa.array(own), pa.array(here), *[pa.array(c) for c in cost]], ["own", "entropy", *[f"cost{k}" for k in range(len(cost))]])

    costs = ", ".join(f"cost{k} double" for k in range(len(SHARPNESS)))
    scored = in_arrow(rows, f"own bigint, entropy double, {costs}", run)
    by_lang = scored.groupBy("own").agg(
        F.percentile_approx("entropy", TOLERATED, 10_000).alias("limit"), *[F.sum(f"cost{k}").alias(f"cost{k}") for k in range(len(SHARPNESS))]).collect()
    limits = [float("inf")] * len(model.langs)
    for row in by_lang:
        limits[row["own"]] = row["limit"] + 0.1
    if by_lang:
        model.sharpness = min(SHARPNESS, key=lambda s: sum(r[f"cost{SHARPNESS.index(s)}"] for r in by_lang))
    model.limits = tuple(limits)
    return model


def _cost(entropy: np.ndarray, own: np.ndarray, sharpness: float) -> np.ndarray:
    if not len(own):
        return np.zeros(0)
    z = -sharpness * (entropy - entropy.min(axis=1, keepdims=True))
    return np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(own)), own]


def identified(df: DataFrame, model: Model | Tables, text: str = "text") -> DataFrame:
    """``df`` with ``lang_pred``, ``score`` (calibrated posterior, 0 to 1), ``entropy`` and ``rejected``; columns of these names are replaced.

    The language with the lowest cross-entropy a symbol wins, the first in
    alphabetical order among equals. Texts that are null or have no letter are
    ``und`` with score 0 and no entropy, and rejected; others keep their
    language and are marked ``rejected`` where the entropy is above the language's limit. Without
    a learned language every text is ``und``. Rows stay as they are; only a model
    of tables takes shuffles.
    """
    added = ["lang_pred", "score", "entropy", "rejected"]
    kept = [c for c in df.columns if c not in added]
    base = df.select(*[f"`{c}`" for c in kept])
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema), "lang_pred string, score double, entropy double, rejected boolean"])
    langs, sharpness, limits = model.langs, model.sharpness, np.array(model.limits or [np.inf] * len(model.langs))
    base, told = _scored(base, model, text) if langs else (base, None)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        n = batch.num_rows
        pred, score, best, far = np.full(n, "und", object), np.zeros(n), np.full(n, np.nan), np.ones(n, bool)
        if langs and n:
            entropy, symbols = told(batch)
            has = np.flatnonzero(symbols > 0)
            win = entropy[has].argmin(axis=1)
            least = entropy[has, win]
            weight = np.exp(-sharpness * (entropy[has] - least[:, None]))
            pred[has] = np.array(langs, object)[win]
            score[has] = 1 / weight.sum(axis=1)
            best[has] = least
            far[has] = least > limits[win]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:len(kept)], pa.array(pred, pa.string()), pa.array(score), pa.array(best, from_pandas=True), pa.array(far)], [*kept, *added])

    return in_arrow(base, schema, run)
