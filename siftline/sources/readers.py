"""Readers and sinks: exposition bodies, telemetry JSON, raw lines with offsets, journals, and tables by kind."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftline.functions import labels as L

#: bytes of an exposition body that are read
MAX_BODY = 64 << 20
KINDS = ("metrics", "logs", "traces", "profiles")
_VALUE = "struct<stringValue:string,boolValue:boolean,intValue:string,doubleValue:double>"
_ATTRS = f"array<struct<key:string,value:{_VALUE}>>"
_POINTS = f"array<struct<attributes:{_ATTRS},timeUnixNano:string,asInt:string,asDouble:double>>"
_EXP = f"array<struct<attributes:{_ATTRS},timeUnixNano:string,count:string,sum:double,scale:int,zeroCount:string,positive:struct<offset:int,bucketCounts:array<string>>>>"
_METRIC = f"struct<name:string,unit:string,gauge:struct<dataPoints:{_POINTS}>,sum:struct<isMonotonic:boolean,dataPoints:{_POINTS}>,exponentialHistogram:struct<dataPoints:{_EXP}>,histogram:struct<dataPoints:array<struct<count:string>>>,summary:struct<dataPoints:array<struct<count:string>>>>"
METRICS_SCHEMA = f"struct<resourceMetrics:array<struct<resource:struct<attributes:{_ATTRS}>,scopeMetrics:array<struct<metrics:array<{_METRIC}>>>>>>"
_LOG = f"struct<timeUnixNano:string,observedTimeUnixNano:string,severityNumber:int,severityText:string,body:{_VALUE},attributes:{_ATTRS}>"
LOGS_SCHEMA = f"struct<resourceLogs:array<struct<resource:struct<attributes:{_ATTRS}>,scopeLogs:array<struct<logRecords:array<{_LOG}>>>>>>"
_SPAN = f"struct<traceId:string,spanId:string,parentSpanId:string,traceState:string,name:string,startTimeUnixNano:string,endTimeUnixNano:string,links:array<struct<traceId:string,spanId:string,traceState:string>>,attributes:{_ATTRS}>"
SPANS_SCHEMA = f"struct<resourceSpans:array<struct<resource:struct<attributes:{_ATTRS}>,scopeSpans:array<struct<spans:array<{_SPAN}>>>>>>"


def read_exposition(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: scrape_id (the path), scraped_at_unix_nano (its change time), body, truncated.

    Of a body over 64 MiB the first 64 MiB are read, up to the last whole character, and truncated is true.
    """
    files = spark.read.text(path, wholetext=True).select("value", "_metadata.file_path", "_metadata.file_modification_time")
    over = F.octet_length("value") > MAX_BODY
    raw = F.col("value").cast("binary")
    # a cut inside a character leaves an incomplete end of one to three bytes
    cuts = [F.try_validate_utf8(F.substring(raw, 1, MAX_BODY - k).cast("string")) for k in range(4)]
    body = F.when(over, F.coalesce(*cuts)).otherwise(F.col("value"))
    return files.select(F.col("file_path").alias("scrape_id"), (F.unix_micros("file_modification_time") * 1000).alias("scraped_at_unix_nano"), body.alias("body"), over.alias("truncated"))


def attributes_map(attrs: Column) -> Column:
    """array<struct<key,value>> as a map of texts; the first of repeated keys counts."""
    attrs = F.coalesce(attrs, F.from_json(F.lit("[]"), _ATTRS))
    keys = F.transform(attrs, lambda a: a["key"])
    first = F.filter(attrs, lambda a, i: a["key"].isNotNull() & (F.array_position(keys, a["key"]) == i + 1))
    return F.map_from_entries(F.transform(first, lambda a: F.struct(a["key"], L.any_value_to_string(a["value"]))))


def _flat(df: DataFrame, schema: str, outer: str, scopes: str, items: str) -> DataFrame:
    """request_id, resource_idx, scope_idx, idx, resource attributes and item, in wire order."""
    rows = df.select("request_id", F.from_json("body", schema).alias("r"))
    rows = rows.select("request_id", F.posexplode(f"r.{outer}").alias("resource_idx", "r"))
    rows = rows.select("request_id", "resource_idx", F.col("r.resource.attributes").alias("resource_attrs"), F.posexplode(f"r.{scopes}").alias("scope_idx", "s"))
    return rows.select("request_id", "resource_idx", "scope_idx", "resource_attrs", F.posexplode(f"s.{items}").alias("idx", "item"))


def read_otlp_metrics(df: DataFrame) -> DataFrame:
    """(request_id, body: JSON) -> points of gauges, sums and exponential histograms.

    A point without a value is skipped; explicit histograms and summaries are left to unsupported_points.
    """
    rows = _flat(df, METRICS_SCHEMA, "resourceMetrics", "scopeMetrics", "metrics")
    hist_type = "struct<scale:int,zero_count:bigint,positive_offset:int,positive_counts:array<bigint>,sum:double,count:bigint>"
    point = "struct<attributes:" + _ATTRS + ",timeUnixNano:string,asInt:string,asDouble:double>"
    some = lambda c, kind: F.coalesce(F.col(c), F.expr(f"cast(array() AS array<{kind}>)"))

    def tagged(kind: str, monotonic: Column, p: Column, i: Column, whole: Column, broken: Column, hist: Column) -> Column:
        return F.struct(F.lit(kind).alias("metric_type"), monotonic.alias("monotonic"), i.alias("point_idx"), p["attributes"].alias("attributes"), p["timeUnixNano"].alias("t"), whole.cast("string").alias("asInt"), broken.cast("double").alias("asDouble"), hist.cast(hist_type).alias("hist"))

    def held(p: Column) -> Column:
        return F.struct(
            F.coalesce(p["scale"], F.lit(0)).alias("scale"), F.coalesce(p["zeroCount"].try_cast("bigint"), F.lit(0)).alias("zero_count"), F.coalesce(p["positive"]["offset"], F.lit(0)).alias("positive_offset"),
            F.coalesce(F.transform(p["positive"]["bucketCounts"], lambda x: x.try_cast("bigint")), F.expr("cast(array() AS array<bigint>)")).alias("positive_counts"), p["sum"].alias("sum"), p["count"].try_cast("bigint").alias("count"),
        )

    none = F.lit(None)
    scalar = lambda kind, monotonic: F.transform(some(f"item.{kind}.dataPoints", point), lambda p, i: tagged(kind, monotonic, p, i, p["asInt"], p["asDouble"], none))
    exp = F.transform(some("item.exponentialHistogram.dataPoints", _EXP[len("array<") : -1]), lambda p, i: tagged("exponential_histogram", F.lit(False), p, i, none, none, held(p)))
    points = F.concat(scalar("gauge", F.lit(False)), scalar("sum", F.coalesce("item.sum.isMonotonic", F.lit(False))), exp)
    # one pass over the parsed bodies: points of all kinds in one array
    rows = rows.select("request_id", "resource_idx", "scope_idx", "idx", attributes_map(F.col("resource_attrs")).alias("resource"), F.col("item.name").alias("name"), F.col("item.unit").alias("unit"), F.explode(points).alias("p"))
    rows = rows.where(F.col("p.hist").isNotNull() | L.finite(F.coalesce(F.col("p.asInt").try_cast("bigint").cast("double"), F.col("p.asDouble"))))
    whole = F.col("p.asInt").try_cast("bigint")
    return rows.select(
        "request_id", "resource_idx", "scope_idx", "idx", "resource", "name", "unit", "p.metric_type", "p.monotonic", "p.point_idx", attributes_map(F.col("p.attributes")).alias("attrs"), F.col("p.t").try_cast("bigint").alias("time_unix_nano"),
        whole.alias("int_value"), F.when(F.col("p.asInt").isNull(), F.col("p.asDouble")).alias("float_value"), F.col("p.asInt").isNull().alias("is_float"), "p.hist",
    )


def unsupported_points(df: DataFrame) -> DataFrame:
    """request_id, unsupported: points of explicit histograms and summaries."""
    rows = _flat(df, METRICS_SCHEMA, "resourceMetrics", "scopeMetrics", "metrics")
    n = sum((F.coalesce(F.size(f"item.{k}.dataPoints"), F.lit(0)) for k in ("histogram", "summary")), F.lit(0))
    return rows.groupBy("request_id").agg(F.sum(F.greatest(n, F.lit(0))).alias("unsupported"))


def read_otlp_logs(df: DataFrame) -> DataFrame:
    """(request_id, body: JSON) -> log records in wire order; a null record is an empty one."""
    rows = _flat(df, LOGS_SCHEMA, "resourceLogs", "scopeLogs", "logRecords")
    return rows.select(
        "request_id", "resource_idx", "scope_idx", F.col("idx").alias("record_idx"), attributes_map(F.col("resource_attrs")).alias("resource"), F.coalesce(F.col("item.timeUnixNano").try_cast("bigint"), F.lit(0)).alias("time_unix_nano"),
        F.coalesce(F.col("item.observedTimeUnixNano").try_cast("bigint"), F.lit(0)).alias("observed_time_unix_nano"), L.any_value_to_string(F.col("item.body")).alias("body"), F.coalesce("item.severityNumber", F.lit(0)).alias("severity_number"),
        F.coalesce("item.severityText", F.lit("")).alias("severity_text"), attributes_map(F.col("item.attributes")).alias("attributes"), (F.octet_length(F.coalesce(F.to_json("item"), F.lit("{}"))) + 32).alias("size_bytes"),
    )


def read_otlp_spans(df: DataFrame) -> DataFrame:
    """(request_id, body: JSON) -> spans with binary ids; a null span stays, and is invalid. span_idx numbers a request's spans in wire order."""
    some = lambda c, kind: F.coalesce(c, F.expr(f"cast(array() AS array<{kind}>)"))
    scope, outer = f"struct<spans:array<{_SPAN}>>", f"struct<resource:struct<attributes:{_ATTRS}>,scopeSpans:array<struct<spans:array<{_SPAN}>>>>"
    item = lambda r, i, j, x: F.struct(i.alias("resource_idx"), j.alias("scope_idx"), r["resource"]["attributes"].alias("resource_attrs"), x.alias("item"))
    spans = lambda r, i: F.flatten(F.transform(some(r["scopeSpans"], scope), lambda s, j: F.transform(some(s["spans"], _SPAN), lambda x: item(r, i, j, x))))
    rows = df.select("request_id", F.from_json("body", SPANS_SCHEMA).alias("r"))
    rows = rows.select("request_id", F.posexplode(F.flatten(F.transform(some(F.col("r.resourceSpans"), outer), spans))).alias("span_idx", "x")).select("request_id", "span_idx", "x.*")
    binary = lambda c: F.when(c.rlike(r"\A([0-9a-fA-F]{2})*\z"), F.unhex(c))
    links = F.transform("item.links", lambda x: F.struct(binary(x["traceId"]).alias("trace_id"), binary(x["spanId"]).alias("span_id"), x["traceState"].alias("trace_state")))
    attrs = F.transform("resource_attrs", lambda a: F.struct(a["key"].alias("key"), L.any_value_to_string(a["value"]).alias("value")))
    return rows.select(
        "request_id", "resource_idx", "scope_idx", F.col("span_idx").cast("bigint").alias("span_idx"), attrs.alias("resource_attrs"), binary(F.col("item.traceId")).alias("trace_id"),
        binary(F.col("item.spanId")).alias("span_id"), binary(F.col("item.parentSpanId")).alias("parent_span_id"), F.col("item.traceState").alias("trace_state"), F.col("item.name").alias("name"), F.col("item.startTimeUnixNano").try_cast("bigint").alias("start_unix_nano"),
        F.col("item.endTimeUnixNano").try_cast("bigint").alias("end_unix_nano"), links.alias("links"), (F.octet_length(F.coalesce(F.to_json("item"), F.lit("{}"))) + 32).alias("size_bytes"),
    )


def discover_logs(spark: SparkSession, include: list[str], exclude: list[str] = (), start_at: str = "end", seen_before: str | None = None) -> DataFrame:
    """Paths that match an include glob and no exclude glob, sorted; `*` and `?` stand for no `/`. A scheme in an exclude glob must be the path's. start_at `end` leaves out files not changed after seen_before (a timestamp), which it needs."""
    if start_at == "end" and not seen_before:
        raise ValueError("start_at end needs seen_before")
    if start_at not in ("end", "beginning"):
        raise ValueError("start_at is end or beginning")
    reader = spark.read.format("binaryFile")
    if start_at == "end":
        reader = reader.option("modifiedAfter", seen_before)
    files = reader.load(include).select("path", "length", "modificationTime")
    for glob in exclude:
        # file:/x, file:///x and /x are the same file
        scheme = re.match(r"[A-Za-z][A-Za-z0-9+.-]*:/", glob) and not glob.startswith("file:")
        path = F.col("path") if scheme else F.regexp_replace("path", r"\A[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?/*", "/")
        if glob.startswith("file:"):
            path, glob = F.regexp_replace("path", r"\Afile:/*", "/"), re.sub(r"\Afile:/*", "/", glob)
        regex = "".join("[^/]*" if c == "*" else "[^/]" if c == "?" else f"\\Q{c}\\E" for c in glob)
        files = files.where(~path.rlike(rf"(?s)\A{regex}\z"))
    return files.distinct().orderBy("path")


def _in_block(batches):
    """Lines of blocks, each block's in order -> k and at: how many lines and bytes of its block come before a line."""
    block, n, size = None, 0, 0
    for x in batches:
        paths, starts, sizes = x["path"].dictionary_encode(), x["block"].to_numpy(), x["bytes"].to_numpy()
        if not len(sizes):
            continue
        codes = paths.indices.to_numpy()
        first = np.flatnonzero(np.concatenate(([True], (codes[1:] != codes[:-1]) | (starts[1:] != starts[:-1]))))
        runs = np.diff(np.append(first, len(sizes)))
        before = np.concatenate(([0], np.cumsum(sizes)))[:-1]
        k, at = np.arange(len(sizes)) - np.repeat(first, runs), before - np.repeat(before[first], runs)
        if (x["path"][0].as_py(), int(starts[0])) == block:
            k[: runs[0]] += n
            at[: runs[0]] += size
        block, n, size = (x["path"][len(sizes) - 1].as_py(), int(starts[-1])), int(k[-1]) + 1, int(at[-1] + sizes[-1])
        yield pa.RecordBatch.from_arrays([*x.columns, pa.array(k), pa.array(at)], names=[*x.schema.names, "k", "at"])


def read_raw_lines(spark: SparkSession, paths: str | list[str], closed: bool = False) -> DataFrame:
    """path, line_no, offset (byte of the line's start), end_offset, line. One `\\n` and then one `\\r` are cut off.

    A last line without end counts only if the file is closed; compressed files count as closed. Malformed bytes read as U+FFFD. Files are read in
    blocks of spark.sql.files.maxPartitionBytes, by as many tasks; a line belongs to the block that it begins in. Inside of a block
    lines are numbered as they are read; the lines and bytes of a file's earlier blocks are added.
    """
    meta = F.col("_metadata")
    raw = spark.read.text(paths, lineSep="\n").select(meta["file_path"].alias("path"), meta["file_block_start"].alias("block"), meta["file_size"].alias("file_size"), (F.octet_length("value") + 1).cast("bigint").alias("bytes"), F.make_valid_utf8("value").alias("line"))
    rows = raw.mapInArrow(_in_block, "path string, block bigint, file_size bigint, bytes bigint, line string, k bigint, at bigint")
    blocks = raw.groupBy("path", "block").agg(F.count("*").alias("_n"), F.sum("bytes").alias("_size"))
    earlier = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("path", "block", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_n"), F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_size"))
    rows = rows.join(blocks, ["path", "block"]).withColumns({"line_no": F.col("_n") + F.col("k"), "offset": F.col("_size") + F.col("at")})
    rows = rows.withColumn("end_offset", F.col("offset") + F.col("bytes"))
    # without its end the last line seems to pass the file's
    rows = rows.where(F.lit(closed) | (F.col("end_offset") <= F.col("file_size")) | F.col("path").rlike(r"\.(gz|bz2|zst|lz4|snappy|deflate)\z"))
    return rows.select("path", "line_no", "offset", F.when(F.col("end_offset") == F.col("file_size") + 1, F.col("file_size")).otherwise(F.col("end_offset")).alias("end_offset"), F.regexp_replace("line", r"\r\z", "").alias("line"))


#: fixed values: journal fields that are exported
JOURNAL_EXPORT = (
    "__CURSOR",
    "__REALTIME_TIMESTAMP",
    "MESSAGE",
    "PRIORITY",
    "SYSLOG_FACILITY",
    "SYSLOG_IDENTIFIER",
    "SYSLOG_PID",
    "_SYSTEMD_UNIT",
    "_SYSTEMD_USER_UNIT",
    "_PID",
    "_UID",
    "_GID",
    "_HOSTNAME",
    "_COMM",
    "_EXE",
    "_TRANSPORT",
    "_BOOT_ID",
)


def parse_journal(entries: DataFrame, max_message: int = 256 << 10, max_field: int = 4096) -> DataFrame:
    """(entry: lines `NAME=value`) -> cursor, realtime_usec, fields, message_oversized.

    The first of repeated fields counts. A MESSAGE over max_message is flagged and left out, other fields over max_field are
    left out. Entries without cursor or with a time of 0 give nothing.
    """
    lines = F.filter(F.split("entry", "\n"), lambda x: x.rlike(r"\A[A-Z0-9_]{1,64}="))
    pairs = F.transform(lines, lambda x: F.struct(F.substring_index(x, "=", 1).alias("k"), F.regexp_replace(x, r"\A[^=]*=", "").alias("v")))
    pairs = F.filter(pairs, lambda p: p["k"].isin(*JOURNAL_EXPORT))
    names = F.transform(pairs, lambda p: p["k"])
    first = F.filter(pairs, lambda p, i: F.array_position(names, p["k"]) == i + 1)
    rows = entries.withColumn("f", F.map_from_entries(first))
    cursor, usec = F.col("f")["__CURSOR"], F.col("f")["__REALTIME_TIMESTAMP"].try_cast("bigint")
    small = F.map_filter("f", lambda k, v: ~k.startswith("__") & (F.octet_length(v) <= F.when(k == "MESSAGE", max_message).otherwise(max_field)))
    over = F.coalesce(F.octet_length(F.col("f")["MESSAGE"]) > max_message, F.lit(False))
    return rows.where((F.coalesce(cursor, F.lit("")) != "") & (usec > 0)).select(cursor.alias("cursor"), usec.alias("realtime_usec"), small.alias("fields"), over.alias("message_oversized"))


def read_journal_entries(spark: SparkSession, path: str) -> DataFrame:
    """Text export of a journal: entries parted by empty lines."""
    return parse_journal(spark.read.text(path, lineSep="\n\n").select(F.col("value").alias("entry")))


def write_by_kind(df: DataFrame, path: str, quarantine: str, kinds: tuple[str, ...] = KINDS, mode: str = "append") -> None:
    """Known kinds to a table partitioned by kind; the rest, whose failure is permanent, to the quarantine."""
    known = F.coalesce(F.col("kind").isin(*kinds), F.lit(False))
    df.where(known).write.mode(mode).partitionBy("kind").parquet(path)
    df.where(~known).write.mode(mode).parquet(quarantine)


def to_otlp_metrics(points: DataFrame, block_points: int = 10_000) -> DataFrame:
    """(resource, name, unit, metric_type, monotonic, attrs, time_unix_nano, int_value, float_value, arrival_seq; hist where
    there are exponential histograms) -> resource_key, first_seq, body.

    A JSON block holds points of one resource in order of arrival; arrival_seq, which no two points share, is cut into
    ranges of block_points, so a block has no more of them. Sums and exponential histograms are cumulative, all
    other scalars gauges; attribute values are texts.
    """
    texts = lambda m: F.transform(F.array_sort(F.map_entries(F.coalesce(m, F.expr("cast(map() AS map<string,string>)")))), lambda e: F.struct(e["key"].alias("key"), F.struct(e["value"].alias("stringValue")).alias("value")))
    base = [texts(F.col("attrs")).alias("attributes"), F.col("time_unix_nano").cast("string").alias("timeUnixNano")]
    point = F.struct(*base, F.col("int_value").cast("string").alias("asInt"), F.when(F.col("int_value").isNull(), F.col("float_value")).alias("asDouble"))
    is_sum, is_hist = F.col("metric_type") == "sum", F.col("metric_type") == "exponential_histogram"
    kinds = [F.when(is_sum, F.struct(F.lit(2).alias("aggregationTemporality"), F.coalesce("monotonic", F.lit(False)).alias("isMonotonic"), F.array(point).alias("dataPoints"))).alias("sum"), F.when(~is_sum & ~is_hist, F.struct(F.array(point).alias("dataPoints"))).alias("gauge")]
    if "hist" in points.columns:
        h = lambda c: F.col(f"hist.{c}")
        positive = F.struct(h("positive_offset").alias("offset"), F.transform(h("positive_counts"), lambda n: n.cast("string")).alias("bucketCounts"))
        held = F.struct(*base, h("count").cast("string").alias("count"), h("sum").alias("sum"), h("scale").alias("scale"), h("zero_count").cast("string").alias("zeroCount"), positive.alias("positive"))
        kinds.append(F.when(is_hist, F.struct(F.lit(2).alias("aggregationTemporality"), F.array(held).alias("dataPoints"))).alias("exponentialHistogram"))
    metric = F.struct(F.col("name").alias("name"), F.col("unit").alias("unit"), *kinds)
    rows = points.select(L.key_of(F.col("resource")).alias("resource_key"), "arrival_seq", F.floor(F.col("arrival_seq") / block_points).alias("block"), texts(F.col("resource")).alias("r"), metric.alias("m"))
    out = rows.groupBy("resource_key", "block").agg(F.min("arrival_seq").alias("first_seq"), F.first("r").alias("r"), F.sort_array(F.collect_list(F.struct("arrival_seq", F.to_json("m").alias("m")))).alias("ms"))
    body = F.concat(F.lit('{"resourceMetrics":[{"resource":{"attributes":'), F.to_json("r"), F.lit('},"scopeMetrics":[{"metrics":['), F.array_join(F.transform("ms", lambda x: x["m"]), ","), F.lit("]}]}]}"))
    return out.select("resource_key", "first_seq", body.alias("body"))
