"""Web archives: not-modified revisits resolved to the latest earlier full response of their address."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

# Query parameters that tell where a visitor came from, not what is shown. Fixed values.
TRACKING = r"^(utm_[^=]*|ref|ref_src|fbclid|gclid|dclid|msclkid|mc_cid|mc_eid|igshid|sessionid|jsessionid|phpsessid)(=.*)?$"
# Headers that a not-modified answer may bring up to date. Fixed values.
PERMITTED = ("age", "cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary", "warning")
HEADERS = "array<struct<name:string,value:string>>"


def canonical(url: Column) -> Column:
    """An address without scheme, user, default port, leading www, fragment, tracking parameters and trailing slash.

    Host in lower case, parameters in order. What is no address with a host
    stays as it is, without fragment and outer blanks; null stays null, and empty becomes null.
    """
    plain = F.regexp_replace(F.btrim(url), "#.*$", "")
    start = r"^[A-Za-z][A-Za-z0-9+.-]*://"
    host = F.lower(F.regexp_extract(plain, start + r"([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, "^.*@", ""), r":(80|443)?$", ""), r"^www[0-9]*[.]", "")
    rest = F.regexp_extract(plain, start + r"[^/?]*(.*)$", 1)
    path = F.regexp_replace(F.regexp_extract(rest, r"^([^?]*)", 1), "/+$", "")
    parameters = F.array_sort(F.filter(F.split(F.regexp_extract(rest, r"[?](.*)$", 1), "&"), lambda p: (p != "") & ~F.lower(p).rlike(TRACKING)))
    whole = F.concat(host, F.when(path == "", "/").otherwise(path), F.when(F.size(parameters) > 0, F.concat(F.lit("?"), F.array_join(parameters, "&"))).otherwise(""))
    return F.nullif(F.when(plain.rlike(start), whole).otherwise(plain), F.lit(""))


def header(headers: Column, name: str) -> Column:
    """The first value of a header, whatever the case of its name; null if there is none."""
    return F.btrim(F.get(F.filter(headers, lambda h: F.lower(h["name"]) == name), F.lit(0))["value"])


def matches(own: Column, stored: Column) -> Column:
    """Whether the validators of a not-modified answer allow the stored response.

    A tag must be equal (weak marks are left out on both sides unless the
    answer's is strong and the stored one weak); without a tag the date of the last change;
    an answer with neither allows only a response that has neither too.
    """
    tag, old = header(own, "etag"), header(stored, "etag")
    date, old_date = header(own, "last-modified"), header(stored, "last-modified")
    bare = lambda t: F.regexp_replace(t, "^W/", "")
    by_tag = (bare(tag) == bare(old)) & (tag.startswith("W/") | ~old.startswith("W/"))
    found = F.when(tag.isNotNull(), by_tag).when(date.isNotNull(), date == old_date).otherwise(old.isNull() & old_date.isNull())
    return F.coalesce(found, F.lit(False))


def merged(own: Column, stored: Column) -> Column:
    """Stored headers, with the permitted ones of the answer in place of those of the same name."""
    new = F.filter(F.coalesce(own, F.array().cast(HEADERS)), lambda h: F.lower(h["name"]).isin(*PERMITTED))
    names = F.transform(new, lambda h: F.lower(h["name"]))
    kept = F.filter(F.coalesce(stored, F.array().cast(HEADERS)), lambda h: ~F.coalesce(F.array_contains(names, F.lower(h["name"])), F.lit(False)))
    return F.concat(kept, new)


def resolved(records: DataFrame) -> DataFrame:
    """(record_id, url_key, outcome, response_id, headers) of every revisit of an archive.

    ``records`` has record_id (whole number, unique), url, captured_at (timestamp),
    kind (``response`` or ``revisit``; others are left out) and headers (an
    array of name and value); more columns are not looked at. A revisit belongs to the full response with the
    same canonical address that comes last before it, by time and, at one
    time, by record_id. Outcomes: ``resolved`` (response_id, and headers
    merged), ``mismatch`` (response_id, but the validators differ; headers are the
    revisit's own), ``none`` (no earlier response, or no address or no time). Null
    headers count as none at all. An empty table gives an empty one.

    Records are dealt out by ranges of (address, time, id), so an address with
    any share of all records spreads over many tasks. Within a range the last
    response is a window; what a range inherits comes from one row for each address and range.
    """
    base = records.where(F.col("kind").isin("response", "revisit")).select(
        F.col("record_id").cast("long").alias("record_id"), canonical(F.col("url")).alias("url_key"), F.col("captured_at").alias("at"),
        (F.col("kind") == "response").alias("full"), F.col("headers").cast(HEADERS).alias("headers"))
    placed = F.col("url_key").isNotNull() & F.col("at").isNotNull()
    lost = base.where(~placed & ~F.col("full")).select("record_id", "url_key", F.lit("none").alias("outcome"), F.lit(None).cast("long").alias("response_id"), "headers")
    ranges = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slim = base.where(placed).select("url_key", "at", "record_id", "full")
    dealt = written(slim.repartitionByRange(ranges, "url_key", "at", "record_id").withColumn("part", F.spark_partition_id()), "ranges")
    before = Window.partitionBy("url_key", "part").orderBy("at", "record_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    within = dealt.withColumn("response_id", F.last(F.when(F.col("full"), F.col("record_id")), ignorenulls=True).over(before)).where("NOT full")
    # The last response of each range, and the one that a later range of the address inherits.
    ends = dealt.groupBy("url_key", "part").agg(F.max(F.when(F.col("full"), F.struct("at", "record_id"))).alias("end"))
    earlier = Window.partitionBy("url_key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    inherited = ends.select("url_key", "part", F.last("end.record_id", ignorenulls=True).over(earlier).alias("inherited")).where("inherited IS NOT NULL")
    found = within.join(inherited, ["url_key", "part"], "left").select(
        "record_id", "url_key", F.coalesce("response_id", "inherited").alias("response_id"))
    found = written(found, "revisits")
    own = base.where(~F.col("full")).select("record_id", "headers")
    stored = base.where("full").select(F.col("record_id").alias("response_id"), F.col("headers").alias("stored"))
    joined = found.join(own, "record_id").join(stored, "response_id", "left")
    good = matches(F.col("headers"), F.col("stored"))
    outcome = F.when(F.col("response_id").isNull(), "none").when(good, "resolved").otherwise("mismatch")
    return joined.select(
        "record_id", "url_key", outcome.alias("outcome"), "response_id",
        F.when(outcome == "resolved", merged(F.col("headers"), F.col("stored"))).otherwise(F.col("headers")).alias("headers"),
    ).unionByName(lost)


def with_payload(found: DataFrame, payloads: DataFrame) -> DataFrame:
    """``found`` with the columns of ``payloads`` (response_id, ...) where the outcome is ``resolved``, and null elsewhere."""
    key = F.when(F.col("outcome") == "resolved", F.col("response_id"))
    return found.withColumn("_key", key).join(payloads.withColumnRenamed("response_id", "_key"), "_key", "left").drop("_key")
