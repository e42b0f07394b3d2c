"""Not-modified revisits of web archives, resolved to the responses that they repeat.

An as-of join by canonical URL: a revisit takes the latest full response of its URL that
is not later. Time is cut into ranges of about equal numbers of records; inside a range the latest
response comes from a window, and from the last response of the earlier ranges where the range has none
before. So a URL with a third of all records is spread over many tasks. Headers go along, so nothing is joined by id.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: fixed values: headers that a 304 answer may renew
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")


def canonical_url(url: Column) -> Column:
    """Lower-case host without `www.` and default port, path without end slashes, query sorted and without utm_ parameters.
    A text that doesn't begin with letters, `://` and a host is its own key."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, r"^[A-Za-z]+://([^/?#]*)", 1)), r"^www\.|:(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(url, r"^[A-Za-z]+://[^/?#]*([^?#]*)", 1), "/+$", "")
    parts = F.filter(F.split(F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1), "&"), lambda p: (p != "") & ~p.startswith("utm_"))
    query = F.array_join(F.array_sort(parts), "&")
    parsed = F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(url.rlike(r"^[A-Za-z]+://[^/?#]"), parsed).otherwise(url)


def resolve(records: DataFrame, ranges: int = 64) -> DataFrame:
    """Records -> one row per revisit: record_id, url_key, response_id, verdict, headers.

    Records have record_id long, url string, at long, kind (`response` or `revisit`; rows of another or a null kind are
    ignored), etag, last_modified string, headers map<string,string> with lower-case names. Of responses at one time the one
    with the largest record_id counts; a response at the time of a revisit is earlier. Rows that repeat a
    record_id, or whole rows, are rows of their own; of responses that repeat a record_id at one time any one counts. verdict:
    `match` where the first validator that both have is equal (etag without `W/`, else last_modified), `mismatch` where it
    differs, `unverified` where they share none, `missing` without an earlier response (also for a null url or time). headers:
    the response's, renewed by the permitted ones of the revisit, for match and unverified; else the revisit's own.
    Null headers are empty. Other columns are ignored.
    """
    rows = records.where("kind IN ('response', 'revisit')").select("record_id", canonical_url(F.col("url")).alias("url_key"), F.col("at").cast("long").alias("at"), "kind", "etag", "last_modified", F.coalesce("headers", F.expr("cast(map() AS map<string,string>)")).alias("headers"))
    # cuts with about as many records between each two of them; one row of at most so many numbers
    cuts = rows.select(F.percentile_approx("at", [k / ranges for k in range(1, ranges)]).alias("c")).first()["c"] or []
    rows = rows.withColumn("range", F.size(F.filter(F.lit(sorted(set(cuts))).cast("array<bigint>"), lambda c: c < F.col("at"))) if cuts else F.lit(0))
    usable = F.col("url_key").isNotNull() & F.col("at").isNotNull()
    response = F.struct("at", "record_id", "etag", "last_modified", "headers")
    rows = rows.withColumn("response", F.when((F.col("kind") == "response") & usable, response))
    last = rows.where("response IS NOT NULL").groupBy("url_key", "range").agg(F.max_by("response", F.struct("at", "record_id")).alias("last"))
    # the last response of the ranges before each range in which the URL has records; one row for each of them
    held = rows.where(usable).groupBy("url_key", "range").agg(F.count("*").alias("n")).join(last, ["url_key", "range"], "left")
    before = Window.partitionBy("url_key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    held = held.select("url_key", "range", F.last("last", ignorenulls=True).over(before).alias("carried"))
    # at one time responses come first
    inside = Window.partitionBy("url_key", "range").orderBy("at", F.when(F.col("kind") == "response", 0).otherwise(1), "record_id")
    found = rows.where(usable).withColumn("near", F.last("response", ignorenulls=True).over(inside)).where("kind = 'revisit'").drop("response")
    found = found.join(held, ["url_key", "range"], "left").withColumn("r", F.coalesce("near", "carried")).drop("near", "carried")
    lost = rows.where(~usable & (F.col("kind") == "revisit")).withColumn("r", F.col("response")).drop("response")
    found = found.unionByName(lost)
    strip = lambda c: F.regexp_replace(c, "^W/", "")
    same = F.coalesce(strip(F.col("etag")) == strip(F.col("r.etag")), F.col("last_modified") == F.col("r.last_modified"))
    verdict = F.when(F.col("r").isNull(), "missing").when(same.isNull(), "unverified").when(same, "match").otherwise("mismatch")
    renewed = F.map_filter("headers", lambda k, v: k.isin(*PERMITTED))
    merged = F.map_concat(F.map_filter("r.headers", lambda k, v: ~F.array_contains(F.map_keys(renewed), k)), renewed)
    found = found.withColumn("verdict", verdict)
    headers = F.when(F.col("verdict").isin("match", "unverified"), merged).otherwise(F.col("headers"))
    return found.select("record_id", "url_key", F.col("r.record_id").alias("response_id"), "verdict", headers.alias("headers"))


def header_lines(headers: Column) -> Column:
    """`name: value` lines in the order of names."""
    lines = F.transform(F.array_sort(F.map_entries(headers)), lambda e: F.concat(e["key"], F.lit(": "), F.coalesce(e["value"], F.lit(""))))
    return F.array_join(lines, "\n")
