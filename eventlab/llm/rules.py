"""Quality rules with cutoffs that bound, for each stratum, how many good texts they reject. Built-in functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.sizing import join_side
from .common import written

SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# Rules reject a text whose share lies above the cutoff: symbols and exclamation marks by characters,
# capital letters by characters, words in repeated windows by words, repeated lines by lines.
RULES = ("marks", "capitals", "repeats", "lines")
CUTOFFS = (0.01, 0.02, 0.03, 0.05, 0.08, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)
# At most so many words of a text can be sorted together with their hashes in one number.
PACKED = 1 << 20
# Terms of a binomial tail that are summed one by one; what is left is bounded above.
TERMS = 4_000


@dataclass(frozen=True)
class Risk:
    """With probability 1 - ``delta``, in every stratum all rules together reject at most ``alpha`` of the good texts."""

    alpha: float = 0.02
    delta: float = 0.1


def _without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def measured(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of ``keep`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and a share for each rule.

    Words are runs of anything but ASCII white space. Null texts have none;
    shares are 0 where there is nothing to divide by.
    """
    t = F.coalesce(F.col("t"), F.lit(""))
    base = df.select(*[f"`{c}`" for c in keep], F.coalesce(F.col(text), F.lit("")).alias("t"))
    trimmed = F.btrim(t, F.lit(SPACES))
    base = base.select(
        *[f"`{c}`" for c in keep],
        F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+")).alias("w"),
        F.filter(F.split(t, "\n"), lambda x: _without(x, SPACES) != "").alias("lines"),
        F.char_length(t).cast("long").alias("chars"),
        F.char_length(_without(t, SPACES)).cast("long").alias("word_chars"),
        F.char_length(_without(t, SYMBOLS)).cast("long").alias("no_symbols"),
        F.char_length(_without(t, "!")).cast("long").alias("no_shouts"),
        F.char_length(_without(t, CAPITALS)).cast("long").alias("no_capitals"),
    )
    rest = [*keep, "word_chars", "n_symbols", "n_shouts", "n_capitals", "n_lines", "n_dup_lines", "n_words"]
    base = base.select(
        *[f"`{c}`" for c in keep], "w", "word_chars",
        (F.col("chars") - F.col("no_symbols")).alias("n_symbols"),
        (F.col("chars") - F.col("no_shouts")).alias("n_shouts"),
        (F.col("chars") - F.col("no_capitals")).alias("n_capitals"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("w").cast("long").alias("n_words"),
    )
    # Hashes of the three-word windows, in order.
    windows = F.when(F.col("n_words") >= 3, F.expr("transform(sequence(0, n_words - 3), i -> xxhash64(w[i], w[i + 1], w[i + 2]))"))
    base = base.select(*[f"`{c}`" for c in rest], windows.alias("g"))
    # Sorted, each with its place in the lower bits: windows that repeat become neighbours.
    base = base.select(
        *[f"`{c}`" for c in rest], "g",
        F.when(F.col("n_words") <= PACKED, F.expr(f"sort_array(transform(g, (x, i) -> (x & ~{PACKED - 1}L) | i))")).alias("s"))
    same = f"(s[j] & ~{PACKED - 1}L) = (s[j - 1] & ~{PACKED - 1}L)"
    # Windows that agree in the upper bits alone (next to never) or very long texts take the whole hashes.
    clash = F.expr(f"exists(sequence(1, size(s) - 1), j -> {same} AND g[CAST(s[j] & {PACKED - 1} AS INT)] <> g[CAST(s[j - 1] & {PACKED - 1} AS INT)])")
    whole = (F.col("n_words") > PACKED) | F.when(F.size("s") > 1, clash).otherwise(False)
    base = base.select(*[f"`{c}`" for c in rest], "s", F.when(whole, F.expr("sort_array(transform(g, (x, i) -> struct(x, CAST(i AS LONG) AS i)))")).alias("z"))
    places = F.when(
        F.col("z").isNotNull(),
        F.expr("transform(filter(z, (v, j) -> (j > 0 AND v.x = z[j - 1].x) OR (j < size(z) - 1 AND v.x = z[j + 1].x)), v -> v.i)"),
    ).when(
        F.size("s") > 1,
        F.expr(f"""transform(filter(s, (v, j) -> (j > 0 AND (v & ~{PACKED - 1}L) = (s[j - 1] & ~{PACKED - 1}L))
                   OR (j < size(s) - 1 AND (v & ~{PACKED - 1}L) = (s[j + 1] & ~{PACKED - 1}L))), v -> v & {PACKED - 1}L)"""),
    )
    base = base.select(*[f"`{c}`" for c in rest], F.sort_array(places).alias("p"))
    covered = F.when(F.size("p") > 0, F.expr("aggregate(p, struct(0L AS n, -3L AS last), (a, v) -> struct(a.n + least(3L, v - a.last) AS n, v AS last), a -> a.n)"))
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    base = base.select(*[f"`{c}`" for c in rest], F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))
    return base.select(
        *[f"`{c}`" for c in keep], "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        share(F.col("n_symbols") + F.col("n_shouts"), F.col("word_chars")).alias("marks"),
        share(F.col("n_capitals"), F.col("word_chars")).alias("capitals"),
        share(F.col("n_repeat_words"), F.col("n_words")).alias("repeats"),
        share(F.col("n_dup_lines"), F.col("n_lines")).alias("lines"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _log_gamma(x: str) -> str:
    """SQL for the logarithm of gamma at x >= 1, by Stirling's series eight steps up."""
    up = " * ".join(f"({x} + {k})" for k in range(8))
    y = f"({x} + 8)"
    return (f"(({y} - 0.5D) * ln({y}) - {y} + 0.91893853320467274178D + 1 / (12 * {y}) - 1 / (360 * pow({y}, 3)) "
            f"+ 1 / (1260 * pow({y}, 5)) - ln({up}))")


def binomial_tail(k: str, n: str, p: float) -> Column:
    """The probability of at most ``k`` successes in ``n`` trials of chance ``p``; 1 from the mean on.

    Terms are summed downwards from ``k``; after TERMS of them the rest is bounded by a geometric
    series, so the figure is never too low.
    """
    k, n = f"CAST({k} AS DOUBLE)", f"CAST({n} AS DOUBLE)"
    top = (f"exp({_log_gamma(f'({n} + 1)')} - {_log_gamma(f'({k} + 1)')} - {_log_gamma(f'({n} - {k} + 1)')} "
           f"+ {k} * ln({p!r}D) + ({n} - {k}) * ln({1 - p!r}D))")
    odds = f"{(1 - p) / p!r}D"
    low = f"greatest(1, CAST({k} AS BIGINT) - {TERMS} + 1)"
    ratio = lambda i: f"({i} / ({n} - {i} + 1) * {odds})"
    start = f"CASE WHEN {low} > 1 THEN 1 / (1 - {ratio(f'({low} - 1)')}) ELSE 1D END"
    total = f"aggregate(sequence({low}, CAST({k} AS BIGINT)), {start}, (a, i) -> 1 + {ratio('i')} * a)"
    return F.expr(f"CASE WHEN {k} >= {n} * {p!r}D THEN 1D WHEN {k} = 0 THEN {top} ELSE least(1D, {top} * {total}) END")


def tested(metrics: DataFrame, labels: DataFrame, risk: Risk = Risk(), stratum: str = "stratum") -> DataFrame:
    """(stratum, rule, cutoff, n, wrong, caught, p_value) from labelled rows of ``metrics`` that pass the base rules.

    ``n`` good texts, ``wrong`` of them above the cutoff, ``caught`` bad ones
    above it. ``labels`` has (doc_id, quality); ids with both labels are left
    out, repeated ones count once. The p-value is the exact binomial one for "the rule rejects
    more than its part of alpha".
    """
    clear = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("other"))
    clear = clear.where("quality = other").drop("other")
    above = lambda r: sum(((F.col(r) > c).cast("int") for c in CUTOFFS), F.lit(0)).alias("above")
    rows = metrics.where(~base_failed()).join(clear, "doc_id").select(
        F.col(stratum).alias("stratum"), "quality",
        F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), above(r)) for r in RULES])).alias("m"),
    ).select("stratum", "quality", "m.rule", "m.above")
    # Rows fold to one for each stratum, rule and number of cutoffs that lie below the share.
    folded = rows.groupBy("stratum", "rule", "above").agg(F.sum("quality").alias("good"), F.sum(1 - F.col("quality")).alias("bad"))
    spread = folded.select("stratum", "rule", "good", "bad", F.explode(F.expr(
        f"transform(sequence(0, {len(CUTOFFS) - 1}), k -> struct(k, k < above AS over))")).alias("c"))
    cutoff = F.element_at(F.array(*[F.lit(c) for c in CUTOFFS]), F.col("k") + 1)
    counts = spread.groupBy("stratum", "rule", F.col("c.k").alias("k")).agg(
        F.sum("good").alias("n"), F.sum(F.when(F.col("c.over"), F.col("good")).otherwise(0)).alias("wrong"),
        F.sum(F.when(F.col("c.over"), F.col("bad")).otherwise(0)).alias("caught"))
    return counts.where("n > 0").select("stratum", "rule", cutoff.alias("cutoff"), "n", "wrong", "caught",
                                        binomial_tail("wrong", "n", risk.alpha / len(RULES)).alias("p_value"))


def chosen(tests: DataFrame, risk: Risk = Risk()) -> DataFrame:
    """(stratum, a cutoff for each rule or null) of the strata with any valid cutoff.

    ``delta`` is shared evenly among strata and rules; within one, cutoffs are
    tested from the mildest down until one fails, which needs no further
    correction. Of the valid ones the one that catches most bad texts is taken, and of equals the mildest.
    """
    pairs = tests.select("stratum", "rule").distinct().agg(F.greatest(F.lit(1), F.count("*")).alias("pairs"))
    judged = tests.join(F.broadcast(pairs), F.lit(True)).withColumn("valid", F.col("p_value") <= F.lit(risk.delta) / F.col("pairs"))
    failed = judged.where("NOT valid").groupBy("stratum", "rule").agg(F.max("cutoff").alias("failed"))
    valid = judged.where("valid").join(failed, ["stratum", "rule"], "left").where("failed IS NULL OR cutoff > failed")
    best = valid.groupBy("stratum", "rule").agg(F.max(F.struct("caught", "cutoff")).alias("b")).where("b.caught > 0")
    return best.groupBy("stratum").agg(*[F.max(F.when(F.col("rule") == r, F.col("b.cutoff"))).alias(f"cut_{r}") for r in RULES])


def judged(df: DataFrame, labels: DataFrame, risk: Risk = Risk(), stratum: str = "lang", text: str = "text") -> DataFrame:
    """(doc_id, stratum, counts, base_failed, kept) of every row of ``df`` (doc_id, text and the stratum's column).

    ``kept`` is false where the base rules fail, and where a share lies above the cutoff that
    its stratum has for the rule. Strata with too few labelled texts have no
    cutoff, so there the base rules alone decide. A null stratum is a stratum
    of its own. Rows with repeated or null ids are judged each for itself; an empty table gives an
    empty one, empty labels no cutoffs.

    One pass over the texts (no shuffle) writes a narrow table of counts; the rest works on that.
    """
    source = df.select("doc_id", F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("stratum"), F.col(text).alias("text"))
    metrics = written(measured(source, "text", ("doc_id", "stratum")), "metrics")
    cuts = written(chosen(tested(metrics, labels, risk), risk), "cutoffs")
    over = [F.coalesce(F.col(r) > F.col(f"cut_{r}"), F.lit(False)) for r in RULES]
    fails = base_failed()
    return metrics.join(join_side(cuts), "stratum", "left").select(
        "doc_id", "stratum", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", fails.alias("base_failed"),
        (~(fails | over[0] | over[1] | over[2] | over[3])).alias("kept"))
