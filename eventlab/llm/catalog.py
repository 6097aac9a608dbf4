"""The queries of the text operators over the test tables, and their SQL where SQL has the words for it."""

from __future__ import annotations

import os
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import containment, crf, fim, fmindex, langid, lines, mincut, pieces, rules, sketch, spelling, toxicity, warc
from .common import held_out, prepared

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under ``name`` with the SQL it must agree with, if there is any."""
    def add(fn):
        @wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(prepared(spark), sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def piece_file() -> str:
    """The vocabulary file of the piece queries: EVENTLAB_PIECES, or the public one."""
    if "EVENTLAB_PIECES" in os.environ:
        return os.environ["EVENTLAB_PIECES"]
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@query("op2_toxicity")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from labels outside the held-out fold."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(~held_out())
    done = toxicity.scored(docs, toxicity.fit(docs, labels))
    return done.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def span_text(spans: str) -> str:
    """SQL for kind:start:end of an array of spans, joined by commas."""
    return f"array_join(transform({spans}, s -> concat_ws(':', s.kind, s.start, s.end)), ',')"


@query("op5_personal_data")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: counts and a digest of the fixed patterns, and all spans."""
    found = crf.spans_of(table(spark, sf_dir, "documents").select("doc_id", "text"), crf.default_model(spark))
    return found.select(
        "doc_id",
        *[F.expr(f"CAST(size(filter(base, s -> s.kind = '{k}')) AS BIGINT)").alias(f"n_{k}") for k in crf.KINDS],
        F.sha2(F.expr(span_text("base")), 256).alias("base_sha256"), F.expr(span_text("spans")).alias("spans"),
    )


@query("op7_near_copies")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of documents whose sets of five-word shingles agree to 85 in 100."""
    return sketch.classes(table(spark, sf_dir, "documents"), percent=85)


@query("op8_pieces")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as pieces and back."""
    done = pieces.encoded(table(spark, sf_dir, "documents").select("doc_id", "text"), piece_file(), with_ids=False)
    return done.select("doc_id", "n_tokens", "ids_sha256", F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


@query("op10_substrings")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the words of 20-word windows that start earlier too."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = fmindex.without(docs, fmindex.repeated(docs))
    return done.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


@query("op1_language")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; counts, limits and sharpness from folds that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    fold = F.crc32(F.col("doc_id").cast("string")) % 5
    model = langid.fit(docs.where(fold > 1), docs.where(fold == 1))
    done = langid.identified(docs.select("doc_id", "text"), model)
    return done.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "entropy", "rejected")


@query("op4_main_text")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return mincut.extracted(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


RISK = rules.Risk()

_SHARE = {
    "marks": "(n_symbols + n_shouts) / nullif(word_chars, 0)", "capitals": "n_capitals / nullif(word_chars, 0)",
    "repeats": "n_repeat_words / nullif(n_words, 0)", "lines": "n_dup_lines / nullif(n_lines, 0)",
}
RULES_SQL = f"""
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS t FROM documents),
split AS (
  SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM texts),
windows AS (
  SELECT r, i, w[i] || chr(10) || w[i + 1] || chr(10) || w[i + 2] AS g FROM split, unnest(range(1, len(w) - 1)) AS u(i)),
repeated AS (SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
words_in AS (SELECT r, count(DISTINCT i + d) AS n FROM repeated, range(3) AS k(d) GROUP BY r),
metrics AS (
  SELECT s.r, doc_id, stratum, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, length(regexp_replace(t, '[^!]', '', 'g'))::BIGINT AS n_shouts,
         length(regexp_replace(t, '[^A-Z]', '', 'g'))::BIGINT AS n_capitals, len(ls)::BIGINT AS n_lines,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM split s LEFT JOIN words_in USING (r)),
shares AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         {", ".join(f"coalesce({sql}, 0)::DOUBLE AS {name}" for name, sql in _SHARE.items())} FROM metrics),
clear AS (SELECT doc_id, min(quality) AS q FROM labels WHERE quality IN (0, 1) GROUP BY doc_id HAVING min(quality) = max(quality)),
pool AS (
  UNPIVOT (SELECT stratum, q, marks, capitals, repeats, lines FROM shares JOIN clear USING (doc_id) WHERE NOT base_failed)
  ON marks, capitals, repeats, lines INTO NAME rule VALUE share),
counts AS (
  SELECT stratum, rule, c, sum(q)::BIGINT AS n, coalesce(sum(q) FILTER (share > c), 0)::BIGINT AS k, coalesce(sum(1 - q) FILTER (share > c), 0)::BIGINT AS caught
  FROM pool, unnest([{", ".join(map(str, rules.CUTOFFS))}]::DOUBLE[]) AS u(c) GROUP BY ALL HAVING sum(q) > 0),
tests AS (
  SELECT *, CASE WHEN k >= n * {RISK.alpha / 4!r} THEN 1 ELSE list_sum(list_transform(range(0, k + 1), lambda i: exp(
    lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({RISK.alpha / 4!r}) + (n - i) * ln({1 - RISK.alpha / 4!r})))) END AS p FROM counts),
ok AS (SELECT *, p <= {RISK.delta!r} / (SELECT count(*) FROM (SELECT DISTINCT stratum, rule FROM tests)) AS valid FROM tests),
valid AS (SELECT *, max(c) FILTER (NOT valid) OVER (PARTITION BY stratum, rule) AS failed FROM ok),
best AS (
  SELECT stratum, rule, c FROM valid WHERE valid AND (failed IS NULL OR c > failed) AND caught > 0
  QUALIFY row_number() OVER (PARTITION BY stratum, rule ORDER BY caught DESC, c DESC) = 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR EXISTS (SELECT 1 FROM best b WHERE b.stratum = s.stratum AND
            CASE rule {" ".join(f"WHEN '{r}' THEN {r}" for r in rules.RULES)} END > c)) AS kept
FROM shares s"""


@query("op6_quality_rules", RULES_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document; cutoffs by language from the labelled ones."""
    done = rules.judged(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), table(spark, sf_dir, "labels").select("doc_id", "quality"), RISK)
    return done.drop("stratum")


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
LEAKS_SQL = f"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
v AS (SELECT row_number() OVER () AS q, item_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM benchmark),
d AS (SELECT DISTINCT r, doc_id, array_to_string(w[i:i + 4], chr(10)) AS s FROM w, unnest(range(1, len(w) - 3)) AS u(i)),
b AS (SELECT DISTINCT q, item_id, array_to_string(w[i:i + 4], chr(10)) AS s FROM v, unnest(range(1, len(w) - 3)) AS u(i)),
n AS (SELECT q, item_id, count(*) AS n FROM b GROUP BY ALL)
SELECT doc_id, n.item_id, count(*)::BIGINT AS shared, n::BIGINT AS n_shingles
FROM d JOIN b USING (s) JOIN n USING (q) GROUP BY r, doc_id, q, n.item_id, n HAVING 100 * count(*) >= {containment.PERCENT} * n"""


@query("op9_contamination", LEAKS_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item that a document contains."""
    return containment.leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An archive made from the pages: each page fetched once and asked for twice more, at times and with validators drawn from its id.

    Some pages have no full response, some answers another tag, a weak tag, only a date or nothing to compare.
    """
    draw = lambda salt: F.conv(F.substring(F.md5(F.concat(F.col("page_id").cast("string"), F.lit(salt))), 1, 8), 16, 10).cast("long")
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.md5("html").alias("tag"), draw("t").alias("t"), draw("k").alias("k"), draw("v").alias("v"))
    visit = F.explode(F.array(*[F.lit(i) for i in range(3)])).alias("visit")
    rows = pages.where("page_id IS NOT NULL").select("*", visit).where("visit > 0 OR k % 5 > 0")
    full = F.col("visit") == 0
    pair = lambda n, v: F.struct(F.lit(n).alias("name"), v.cast("string").alias("value"))
    case = (F.col("v") + F.col("visit")) % 6
    tag = F.when(full, F.concat(F.lit('"'), "tag", F.lit('"'))).when(case == 0, F.lit('"other"')).when(case == 1, F.concat(F.lit('W/"'), "tag", F.lit('"'))).when(
        case > 3, F.concat(F.lit('"'), "tag", F.lit('"')))
    changed = F.when(full | (case == 2), F.concat(F.lit("day "), F.col("page_id") % 50))
    headers = F.filter(F.array(
        pair("Date", F.col("t") % 1000 + F.col("visit")), pair("ETag", tag), pair("Last-Modified", changed),
        pair("Content-Length", F.when(full, F.lit("1000")).otherwise(F.lit("0"))), pair("cache-control", F.concat(F.lit("max-age="), F.col("visit")))),
        lambda h: h["value"].isNotNull())
    return rows.select(
        (F.col("page_id") * 3 + F.col("visit")).alias("record_id"), "url", F.timestamp_seconds(1_700_000_000 + F.col("t") % 500_000 + F.col("visit") * 90_000).alias("captured_at"),
        F.when(full, "response").otherwise("revisit").alias("kind"), headers.alias("headers"))


REVISITS_SQL = f"""
WITH p AS (SELECT page_id, url, html, md5(html) AS tag, {", ".join(f"('0x' || substr(md5(page_id || '{x}'), 1, 8))::BIGINT AS {x}" for x in "tkv")} FROM pages WHERE page_id IS NOT NULL),
r AS (
  SELECT *, page_id * 3 + visit AS record_id, 1700000000 + t % 500000 + visit * 90000 AS moment, visit = 0 AS is_full, (v + visit) % 6 AS c
  FROM p, unnest([0, 1, 2]) AS u(visit) WHERE visit > 0 OR k % 5 > 0),
h AS (
  SELECT *, CASE WHEN is_full OR c > 3 THEN '"' || tag || '"' WHEN c = 0 THEN '"other"' WHEN c = 1 THEN 'W/"' || tag || '"' END AS etag,
         CASE WHEN is_full OR c = 2 THEN 'day ' || (page_id % 50) END AS changed, (t % 1000 + visit)::VARCHAR AS day,
         regexp_replace(trim(url), '#.*$', '') AS plain FROM r),
parts AS (
  SELECT *, regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(plain, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)', 1)), '^.*@', ''), ':(80|443)?$', ''), '^www[0-9]*[.]', '') AS host,
         regexp_extract(plain, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*(.*)$', 1) AS rest FROM h),
query AS (
  SELECT *, regexp_replace(regexp_extract(rest, '^([^?]*)', 1), '/+$', '') AS path,
         list_sort(list_filter(string_split(regexp_extract(rest, '[?](.*)$', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(lower(x), '{warc.TRACKING}'))) AS qs FROM parts),
keyed AS (
  SELECT *, nullif(CASE WHEN regexp_matches(plain, '^[A-Za-z][A-Za-z0-9+.-]*://')
    THEN host || (CASE WHEN path = '' THEN '/' ELSE path END) || (CASE WHEN len(qs) > 0 THEN '?' || array_to_string(qs, '&') ELSE '' END) ELSE plain END, '') AS url_key FROM query),
seen AS (
  SELECT *, last_value(CASE WHEN is_full THEN record_id END IGNORE NULLS) OVER (PARTITION BY url_key ORDER BY moment, record_id) AS found FROM keyed),
judged AS (
  SELECT a.*, CASE WHEN a.url_key IS NOT NULL THEN a.found END AS response_id, f.html AS body, f.changed AS old_changed,
    coalesce(CASE WHEN a.etag IS NOT NULL THEN regexp_replace(a.etag, '^W/', '') = f.etag
                  WHEN a.changed IS NOT NULL THEN a.changed = f.changed ELSE f.etag IS NULL AND f.changed IS NULL END, false) AS good, f.etag AS old_etag
  FROM seen a LEFT JOIN keyed f ON f.record_id = a.found AND a.url_key IS NOT NULL WHERE NOT a.is_full),
told AS (SELECT *, CASE WHEN response_id IS NULL THEN 'none' WHEN good THEN 'resolved' ELSE 'mismatch' END AS outcome FROM judged)
SELECT record_id, url_key, outcome, response_id,
  CASE WHEN outcome = 'resolved' THEN concat_ws(chr(10), CASE WHEN etag IS NULL THEN 'ETag: ' || old_etag END, CASE WHEN changed IS NULL THEN 'Last-Modified: ' || old_changed END,
         'Content-Length: 1000', 'Date: ' || day, 'ETag: ' || etag, 'Last-Modified: ' || changed, 'cache-control: max-age=' || visit)
       ELSE concat_ws(chr(10), 'Date: ' || day, 'ETag: ' || etag, 'Last-Modified: ' || changed, 'Content-Length: 0', 'cache-control: max-age=' || visit) END AS headers,
  CASE WHEN outcome = 'resolved' THEN md5(body) END AS body_md5, CASE WHEN outcome = 'resolved' THEN length(body) END::BIGINT AS body_chars
FROM told"""


@query("op3_revisits", REVISITS_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every revisit of the archive made from the pages, with the body its response had."""
    found = warc.resolved(captures(spark, sf_dir))
    bodies = table(spark, sf_dir, "pages").where("page_id IS NOT NULL").select((F.col("page_id") * 3).alias("response_id"), F.md5("html").alias("body_md5"), F.char_length("html").alias("body_chars"))
    done = warc.with_payload(found, bodies)
    flat = F.array_join(F.transform("headers", lambda h: F.concat_ws(": ", h["name"], h["value"])), "\n")
    return done.select("record_id", "url_key", "outcome", "response_id", flat.alias("headers"), "body_md5", F.col("body_chars").cast("long").alias("body_chars"))


def slipped(runs: DataFrame, one_in: int = 199) -> DataFrame:
    """(word) of (doc_id, run): where the crc32 of ``doc_id:run`` is a multiple of ``one_in``, one of the run's code points is missing.

    A null id counts as an empty one.
    """
    draw = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")))
    at = runs.select("run", draw.alias("h"))
    gap = F.expr("CAST(h % char_length(run) AS INT)")
    short = F.concat(F.substring("run", F.lit(1), gap), F.substring("run", gap + 2, F.char_length("run")))
    return at.select(F.when(F.col("h") % one_in == 0, short).otherwise(F.col("run")).alias("word"))


@query("op11_spelling_variants")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frequent word of the documents with the word it may be a misspelling of; crc32 is not in DuckDB's SQL."""
    runs = spelling.runs_of(table(spark, sf_dir, "documents"))
    return spelling.variants(spelling.counted(slipped(runs), "word"))


_KEY = "translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
LINES_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT r, doc_id, i, ls[i] AS line FROM d, unnest(range(1, len(ls) + 1)) AS u(i)),
k AS (SELECT *, {_KEY} AS k FROM l),
often AS (
  SELECT k, max(doc_id) AS last FROM (SELECT DISTINCT r, doc_id, k FROM k WHERE length(k) >= 20 AND doc_id IS NOT NULL)
  GROUP BY k HAVING count(*) >= 3),
judged AS (SELECT k.*, coalesce(doc_id < last, false) AS dropped FROM k LEFT JOIN often USING (k))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (dropped)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY r, doc_id"""


@query("op12_lines", LINES_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its lines that three documents or more hold, but for the last of them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = lines.LineIndex(spark).insert(docs).without(docs)
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


_GROUPS = ", ".join(f"('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), {8 * i + 1}, 8))::BIGINT AS h{i + 1}" for i in range(4))
_JOIN = lambda a, b: f"array_to_string(u[{a} + 1:{b}], '')"
MIDDLE_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, {_GROUPS} FROM documents),
n AS (SELECT *, len(u)::BIGINT AS n FROM d),
cuts AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain'
              WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM n),
parts AS (SELECT *, {_JOIN("0", "a")} AS prefix, {_JOIN("a", "b")} AS middle, {_JOIN("b", "n")} AS suffix FROM cuts)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END::BIGINT AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(t) AS restored_sha256
FROM parts"""


@query("op13_fill_middle", MIDDLE_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with a middle of whole lines put last, and what is rebuilt from that."""
    made = fim.restored(fim.transformed(table(spark, sf_dir, "documents").select("doc_id", "text"), units="lines", seed=7, rate=100, spm=50))
    sha = lambda c: F.sha2(F.encode(c, "UTF-8"), 256).alias(f"{c}_sha256")
    return made.select("doc_id", F.col("n_units").alias("n"), "form", "prefix_chars", "middle_chars", sha("output"), sha("restored"))
