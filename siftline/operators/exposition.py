"""Text exposition bodies to metric points, and classic to exponential histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.functions import labels as L

MAX_BODY = 64 << 20
_NUMBER = r"\A[+-]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|[iI]nf(?:inity)?|[nN]a[nN])\z"
_LINE = r"\A([^\s{}]+)(?:[ \t]*\{((?:[^\"}]|\"(?:[^\"\\]|\\.)*\")*)\}[ \t]*|[ \t]+)(\S+)(?:[ \t]+(\S+))?"


def _number(text: Column) -> Column:
    """A double; null for texts that are no number. Names of infinity and NaN are read as such."""
    low = F.lower(text)
    special = F.when(low.rlike(r"\A[+]?inf(inity)?\z"), F.lit(float("inf"))).when(low.rlike(r"\A-inf(inity)?\z"), F.lit(float("-inf"))).when(low == "nan", F.lit(float("nan")))
    return F.when(text.rlike(_NUMBER), F.coalesce(special, F.expr("double(null)"), text.try_cast("double")))


def _unescape(text: Column) -> Column:
    parts = F.regexp_extract_all(text, F.lit(r"(?s)\\.|[^\\]+"), F.lit(0))
    plain = lambda p: F.when(p == "\\n", F.lit("\n")).when(p.startswith("\\"), F.substring(p, 2, 1)).otherwise(p)
    return F.array_join(F.transform(parts, plain), "")


def _labels(block: Column) -> Column:
    """Map of a label block; the first of repeated names counts, empty names are skipped."""
    pair = r'([^=,\s"]+)\s*=\s*"((?:[^"\\]|\\.)*)"'
    names = F.regexp_extract_all(block, F.lit(pair), F.lit(1))
    values = F.transform(F.regexp_extract_all(block, F.lit(pair), F.lit(2)), _unescape)
    entries = F.arrays_zip(names.alias("k"), values.alias("v"))
    entries = F.filter(entries, lambda e, i: (e["k"] != "") & (F.array_position(names, e["k"]) == i + 1))
    return F.map_from_entries(entries)


def lines(exposition: DataFrame) -> DataFrame:
    """(scrape_id, scraped_at_unix_nano, body, ...) -> one row per sample line with its parsed fields.

    Columns: line_no, name, labels (map), value double (maybe NaN or infinite), time_unix_nano. Bodies over
    64 MiB, blank lines, comments and lines that cannot be read give nothing. A time that is none, or passes 2^63-1 ns, is the scrape's.
    """
    body = exposition.where(F.octet_length("body") <= MAX_BODY)
    rows = body.select(*[c for c in body.columns if c != "body"], F.posexplode(F.split("body", "\n")).alias("line_no", "line"))
    rows = rows.withColumn("line", F.trim(F.regexp_replace("line", r"\A\s+|\s+\z", ""))).where((F.col("line") != "") & ~F.col("line").startswith("#"))
    part = lambda k: F.regexp_extract("line", _LINE, k)
    rows = rows.where(F.col("line").rlike(_LINE)).withColumns({"name": part(1), "labels": _labels(part(2)), "value": _number(part(3)), "_ms": part(4)})
    ms = F.when(F.col("_ms") != "", F.try_multiply(F.col("_ms").try_cast("bigint"), F.lit(1_000_000).cast("bigint")))
    return rows.where("value IS NOT NULL").withColumn("time_unix_nano", F.coalesce(ms, F.col("scraped_at_unix_nano"))).drop("line", "_ms")


def types(exposition: DataFrame) -> DataFrame:
    """`# TYPE name type` lines: scrape_id, line_no, family, type."""
    rows = exposition.select("scrape_id", F.posexplode(F.split("body", "\n")).alias("line_no", "line"))
    fields = F.split(F.regexp_replace("line", r"\A\s+|\s+\z", ""), r"\s+")
    rows = rows.withColumn("f", fields).where((F.size("f") >= 4) & (F.col("f")[0] == "#") & (F.col("f")[1] == "TYPE"))
    return rows.select("scrape_id", "line_no", F.col("f")[2].alias("family"), F.col("f")[3].alias("type"))


#: fixed values: ends of the names of a family's samples
_ENDS = ("_bucket", "_count", "_sum")


def _typed(samples: DataFrame, declared: DataFrame) -> DataFrame:
    """family, own_type and family_type of each sample: as declared by the latest earlier line for its name, and for its name without suffix.

    Samples and declarations are ordered together, by scrape and family; a declared name with a suffix stands in two families, its own
    and the one without the suffix. One window finds the latest declaration for each suffix.
    """
    end = rf"({'|'.join(_ENDS)})\z"
    kind = lambda name: F.regexp_extract(name, end, 1)
    rows = samples.select("scrape_id", "line_no", F.regexp_replace("name", end, "").alias("_part"), kind("name").alias("_kind"), F.struct(*samples.columns).alias("_s"))
    places = F.array(F.struct(F.regexp_replace("family", end, "").alias("_part"), kind("family").alias("_kind")), F.struct(F.col("family").alias("_part"), F.lit("").alias("_kind")))
    cut = declared.select("scrape_id", "line_no", F.col("type").alias("_type"), F.explode(F.array_distinct(places)).alias("p")).select("scrape_id", "line_no", "_type", "p.*")
    upto = Window.partitionBy("scrape_id", "_part").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    latest = {k: F.last(F.when(F.col("_kind") == k, F.col("_type")), ignorenulls=True).over(upto) for k in ("", *_ENDS)}
    rows = rows.unionByName(cut, allowMissingColumns=True).withColumns({f"_t{k}": v for k, v in latest.items()}).where("_s IS NOT NULL")
    own = F.coalesce(*[F.when(F.col("_kind") == k, F.col(f"_t{k}")) for k in latest])
    return rows.select("_s.*", F.col("_part").alias("family"), own.alias("own_type"), F.col("_t").alias("family_type"))


def parse_exposition(exposition: DataFrame) -> DataFrame:
    """Scalar points: counters are monotonic sums, gauges, untyped and summaries gauges, `_count` and `_sum` of summaries sums.

    A type holds for later lines only. Lines of histogram families are left to histogram_buckets. NaN and
    infinite values are dropped, whole numbers kept as integers. Input: scrape_id (one per body), scraped_at_unix_nano, body.
    """
    rows = _typed(lines(exposition), types(exposition))
    suffix = F.col("name") != F.col("family")
    histogram = (F.col("family_type") == "histogram") & suffix | (F.col("own_type") == "histogram")
    rows = rows.where(~F.coalesce(histogram, F.lit(False)) & L.finite(F.col("value")))
    summary_sum = (F.col("family_type") == "summary") & F.col("name").rlike(r"_(count|sum)\z")
    monotonic = F.coalesce(F.col("own_type") == "counter", F.lit(False)) | F.coalesce(F.col("own_type").isNull() & summary_sum, F.lit(False))
    whole = L.as_integer(F.col("value"))
    return rows.withColumns({"monotonic": monotonic, "metric_type": F.when(monotonic, "sum").otherwise("gauge"), "attrs": F.col("labels"), "int_value": whole, "float_value": F.when(whole.isNull(), F.col("value")), "is_float": whole.isNull()}).drop("labels", "value", "family", "own_type", "family_type")


def histogram_buckets(exposition: DataFrame) -> DataFrame:
    """Lines of histogram families: scrape_id, family, labels_key, le, cumulative, sum, count, line_no, time_unix_nano."""
    rows = _typed(lines(exposition), types(exposition)).where("family_type = 'histogram' AND name <> family")
    key = L.key_of(F.map_filter("labels", lambda k, v: k != "le"))
    part = F.regexp_extract("name", r"_(bucket|count|sum)\z", 1)
    le = F.coalesce(_number(F.col("labels")["le"]), F.lit(float("inf")))
    whole = F.when(L.finite(F.col("value")) & (F.col("value") >= 0), F.floor("value").cast("bigint"))
    return rows.select(
        "scrape_id", "family", key.alias("labels_key"), "line_no", "time_unix_nano", F.when(part == "bucket", F.when(F.isnan(le), float("inf")).otherwise(le)).alias("le"),
        F.when(part == "bucket", whole).alias("cumulative"), F.when((part == "sum") & L.finite(F.col("value")), F.col("value")).alias("sum"), F.when(part == "count", whole).alias("count"),
    )


def classic_to_exp_histogram(buckets: DataFrame, keys: list[str], scale: int = 3, order: str = "line_no") -> DataFrame:
    """(keys, le, cumulative, order) -> keys, zero_count, positive_offset, positive_counts (dense array), bucket_count.

    Of repeated bounds the last line counts. Falls of the cumulative count give 0. What lies in the infinite bucket is
    added at the largest positive finite bound, even an empty one; without such a bound it is lost. Rows
    with a null bound or count are ignored. A histogram without positive buckets has a null offset and no counts.
    """
    rows = buckets.where("le IS NOT NULL AND cumulative IS NOT NULL AND cumulative >= 0")
    rows = rows.groupBy(*keys, "le").agg(F.max_by("cumulative", order).alias("cumulative"))
    by_bound = Window.partitionBy(*keys).orderBy("le")
    rows = rows.withColumn("delta", F.greatest(F.col("cumulative") - F.coalesce(F.lag("cumulative").over(by_bound), F.lit(0)), F.lit(0)))
    finite = (F.col("le") > 0) & (F.col("le") < float("inf"))
    index = F.when(finite, L.exp_bucket_index(F.col("le"), scale))
    rows = rows.withColumn("index", index).withColumn("top", F.max("index").over(Window.partitionBy(*keys)))
    rows = rows.withColumn("index", F.when(F.col("le") == float("inf"), F.col("top")).otherwise(F.col("index")))
    per = rows.groupBy(*keys, "index").agg(F.sum(F.when(F.col("le") > 0, F.col("delta")).otherwise(0)).alias("n"), F.sum(F.when(F.col("le") <= 0, F.col("delta")).otherwise(0)).alias("zero"))
    some = (F.col("n") > 0) & F.col("index").isNotNull()
    out = per.groupBy(*keys).agg(F.sum("zero").alias("zero_count"), F.min(F.when(some, F.col("index"))).alias("positive_offset"), F.max(F.when(some, F.col("index"))).alias("_hi"), F.map_from_entries(F.collect_list(F.when(some, F.struct("index", "n")))).alias("_n"))
    dense = F.transform(F.sequence("positive_offset", "_hi"), lambda i: F.coalesce(F.col("_n")[i], F.lit(0).cast("bigint")))
    dense = F.when(F.col("_hi").isNotNull(), dense).otherwise(F.expr("cast(array() AS array<bigint>)"))
    return out.withColumn("positive_counts", dense).drop("_hi", "_n")


def render_exposition(counters: DataFrame) -> DataFrame:
    """(kind, name, label, label_value, value, seq) -> one row, body.

    Counters come in the order of seq, then gauges by name, then vectors (a label and its value) by name and
    label value. parse_exposition reads the text back. The table is a fixed small set of counters.
    """
    escaped = F.regexp_replace(F.regexp_replace(F.regexp_replace("label_value", r"\\", r"\\\\"), '"', r'\\"'), "\n", r"\\n")
    line = F.concat(F.col("name"), F.when(F.col("label").isNotNull(), F.concat(F.lit("{"), F.col("label"), F.lit('="'), escaped, F.lit('"}'))).otherwise(""), F.lit(" "), F.col("value").cast("string"))
    rank = F.when(F.col("label").isNotNull(), 2).when(F.col("kind") == "gauge", 1).otherwise(0)
    head = F.concat(F.lit("# TYPE "), F.col("name"), F.lit(" "), F.col("kind"))
    rows = counters.select(F.struct(rank.alias("rank"), F.when(rank == 0, F.col("seq")).otherwise(0).alias("seq"), F.col("name").alias("name"), F.coalesce("label_value", F.lit("")).alias("v"), head.alias("head"), line.alias("line")).alias("r"))
    all_rows = rows.agg(F.array_sort(F.collect_list("r")).alias("r"))
    first = lambda x, i: (i == 0) | (F.get(F.col("r"), i - 1)["name"] != x["name"])
    texts = F.transform("r", lambda x, i: F.when(first(x, i), F.concat(x["head"], F.lit("\n"), x["line"], F.lit("\n"))).otherwise(F.concat(x["line"], F.lit("\n"))))
    return all_rows.select(F.array_join(texts, "").alias("body"))
