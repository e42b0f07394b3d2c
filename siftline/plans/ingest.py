"""Queries that run the front door over the driver's tables: telemetry JSON, inventories, host files, sinks."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.functions import labels as L
from siftline.operators import delivery, exposition, hosts, logs, targets, traces
from siftline.plans.registry import _map, _s, _snapshots, _spans, query, table
from siftline.sources import readers


def _attr(key: str, value) -> F.Column:
    return F.struct(F.lit(key).alias("key"), F.struct(value.cast("string").alias("stringValue")).alias("value"))


def _request(outer: str, scopes: str, items: str, resource, item) -> F.Column:
    """A JSON request with one resource and one scope."""
    scope = F.struct(F.array(F.struct(item.alias(items))).alias(scopes), F.struct(F.array(resource).alias("attributes")).alias("resource"))
    return F.to_json(F.struct(F.array(scope).alias(outer)))


# files -----------------------------------------------------------------------------------------------------------


def _scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path below spark.checkpoint.dir; a local session without it gets a temporary one."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-siftline-", dir="/tmp")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _document_files(spark: SparkSession, sf_dir: str) -> str:
    """documents as text files, 500 ids in each, one after the other."""
    path = _scratch(spark, "raw-lines")
    d = table(spark, sf_dir, "documents").select(F.expr("doc_id div 500").alias("bucket"), "doc_id", F.regexp_replace(F.coalesce("text", F.lit("")), "\r", "").alias("text"))
    d.repartition("bucket").sortWithinPartitions("bucket", "doc_id").select("bucket", "text").write.partitionBy("bucket").text(path)
    return path


@query("""
WITH l AS (SELECT doc_id, doc_id // 500 AS bucket, k, line FROM (
  SELECT doc_id, unnest(t) AS line, generate_subscripts(t, 1) AS k FROM (SELECT doc_id, string_split(replace(coalesce(text, ''), chr(13), ''), chr(10)) AS t FROM documents)))
SELECT bucket, row_number() OVER f - 1 AS line_no, CAST(sum(strlen(line) + 1) OVER f - strlen(line) - 1 AS BIGINT) AS first_byte, md5(line) AS line
FROM l WINDOW f AS (PARTITION BY bucket ORDER BY doc_id, k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
""")
def raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of files written from documents, with its number and byte offset in its file."""
    lines = readers.read_raw_lines(spark, _document_files(spark, sf_dir))
    return lines.select(F.regexp_extract("path", r"bucket=(\d+)", 1).cast("bigint").alias("bucket"), "line_no", F.col("offset").alias("first_byte"), F.md5("line").alias("line"))


@query("SELECT DISTINCT doc_id // 500 AS bucket FROM documents WHERE doc_id // 500 % 2 = 0")
def discovered_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that the patterns include and do not exclude."""
    path = _document_files(spark, sf_dir)
    found = readers.discover_logs(spark, [f"{path}/bucket=*/*.txt"], [f"{path}/bucket=*{odd}/*" for odd in "13579"], "beginning")
    return found.select(F.regexp_extract("path", r"bucket=(\d+)", 1).cast("bigint").alias("bucket"))


@query("""
WITH c AS (SELECT n_name, 'balance{customer="' || CAST(c_custkey AS VARCHAR) || '"} ' || CAST(CAST(round(c_acctbal) AS BIGINT) AS VARCHAR) AS line FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT n_name AS instance, count(*) AS samples, CAST(sum(CAST(split_part(line, ' ', 2) AS BIGINT)) AS BIGINT) AS total, false AS truncated FROM c GROUP BY n_name
""")
def exposition_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scraped bodies in files, one for each nation's customers, read and parsed."""
    path = _scratch(spark, "bodies")
    c = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    line = F.concat(F.lit('balance{customer="'), _s("c_custkey"), F.lit('"} '), F.round("c_acctbal").cast("bigint").cast("string"))
    c.select("n_name", line.alias("value")).repartition("n_name").sortWithinPartitions("n_name").write.partitionBy("n_name").text(path)
    bodies = readers.read_exposition(spark, f"{path}/*/*.txt").select("*", F.lit("j").alias("job"), F.col("scrape_id").alias("instance"))
    samples = exposition.lines(bodies)
    instance = F.replace(F.regexp_extract("instance", "n_name=([^/]+)", 1), F.lit("%20"), F.lit(" "))
    return samples.groupBy(instance.alias("instance")).agg(F.count("*").alias("samples"), F.sum("value").cast("bigint").alias("total"), F.bool_or("truncated").alias("truncated"))


@query("""
SELECT CAST(event_id AS VARCHAR) AS cursor, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_type END AS message, CASE WHEN event_id % 2 = 0 THEN 'unit' || CAST(user_id AS VARCHAR) END AS unit, CAST(user_id AS VARCHAR) AS pid,
       CASE WHEN event_id >= 9223 THEN NULL ELSE (event_id + 1) * 1000000000000000 END AS time_unix_nano FROM events WHERE event_id % 5 <> 4
""")
def journal_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Journal entries in text files: of a repeated field the first counts, other fields and entries without cursor are left out, a time beyond 2^63-1 ns is null."""
    path, i = _scratch(spark, "journal"), F.col("event_id")
    field = lambda name, v: F.concat(F.lit(name + "="), v, F.lit("\n"))
    text = F.concat(
        F.when(i % 5 == 4, "").otherwise(field("__CURSOR", i.cast("string"))), field("__REALTIME_TIMESTAMP", ((i + 1) * 1_000_000_000_000).cast("string")), F.when(i % 3 == 0, "").otherwise(field("MESSAGE", F.col("event_type"))), field("_PID", F.col("user_id").cast("string")),
        field("_PID", F.lit("again")), field("_CMDLINE", F.lit("x")), F.when(i % 2 == 0, field("_SYSTEMD_UNIT", F.concat(F.lit("unit"), F.col("user_id").cast("string")))).otherwise(""),
    )
    table(spark, sf_dir, "events").select(text.alias("value")).write.text(path)
    out = logs.journal_to_records(readers.read_journal_entries(spark, path))
    return out.select("cursor", F.when(~F.col("message_missing"), F.col("body")).alias("message"), F.col("attributes")["systemd.unit"].alias("unit"), F.col("attributes")["process.pid"].alias("pid"), "time_unix_nano")


@query("SELECT doc_id AS id, source AS kind, source IN ('src0', 'src1') AS known FROM documents")
def kinds_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of known kinds, and the quarantine, as read back."""
    path, quarantine = _scratch(spark, "kinds"), _scratch(spark, "quarantine")
    readers.write_by_kind(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("kind")), path, quarantine, ("src0", "src1"))
    known = spark.read.schema("id bigint, kind string").parquet(path).select("id", "kind", F.lit(True).alias("known"))
    return known.unionByName(spark.read.schema("id bigint, kind string").parquet(quarantine).select("id", "kind", F.lit(None).cast("boolean").isNotNull().alias("known")))


# telemetry JSON --------------------------------------------------------------------------------------------------


@query("""
SELECT l_orderkey * 10 + l_linenumber AS request_id, l_returnflag AS service, name, metric_type, monotonic, int_value, float_value, CAST(l_orderkey * 1000 AS BIGINT) AS time_unix_nano
FROM lineitem, LATERAL (VALUES ('quantity', 'sum', true, CAST(l_quantity AS BIGINT), NULL), ('price', 'gauge', false, NULL, CAST(l_extendedprice AS DOUBLE))) AS m(name, metric_type, monotonic, int_value, float_value)
""")
def otlp_metrics_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request per line item: a counter, a gauge and a point without value, which is skipped."""
    time = F.expr("cast(l_orderkey * 1000 AS string)")
    point = lambda **v: F.array(F.struct(time.alias("timeUnixNano"), *[c.alias(k) for k, c in v.items()]))
    metric = lambda name, total=None, gauge=None: F.struct(F.lit(name).alias("name"), (F.struct(F.lit(True).alias("isMonotonic"), total.alias("dataPoints")) if total is not None else F.lit(None)).cast("struct<isMonotonic:boolean,dataPoints:array<struct<timeUnixNano:string,asInt:string>>>").alias("sum"), (F.struct(gauge.alias("dataPoints")) if gauge is not None else F.lit(None)).cast("struct<dataPoints:array<struct<timeUnixNano:string,asDouble:double>>>").alias("gauge"))
    items = F.array(metric("quantity", total=point(asInt=F.col("l_quantity").cast("bigint").cast("string"))), metric("price", gauge=point(asDouble=F.col("l_extendedprice").cast("double"))), metric("none", gauge=point(asDouble=F.lit(None).cast("double"))))
    body = _request("resourceMetrics", "scopeMetrics", "metrics", _attr("service.name", F.col("l_returnflag")), items)
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("request_id"), body.alias("body"))
    return readers.read_otlp_metrics(rows).select("request_id", F.col("resource")["service.name"].alias("service"), "name", "metric_type", "monotonic", "int_value", "float_value", "time_unix_nano")


@query("""
SELECT doc_id AS request_id, source AS service, md5(coalesce(text, '')) AS body, CAST(n_chars % 24 AS INTEGER) AS severity_number, lang AS severity_text, CAST(doc_id AS VARCHAR) AS doc, CAST(doc_id * 5 AS BIGINT) AS time_unix_nano FROM documents
""")
def otlp_logs_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    record = F.struct((F.col("doc_id") * 5).cast("string").alias("timeUnixNano"), (F.col("n_chars") % 24).cast("int").alias("severityNumber"), F.col("lang").alias("severityText"), F.struct(F.col("text").alias("stringValue")).alias("body"), F.array(_attr("doc", F.col("doc_id"))).alias("attributes"))
    body = _request("resourceLogs", "scopeLogs", "logRecords", _attr("service.name", F.col("source")), F.array(record))
    out = readers.read_otlp_logs(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("request_id"), body.alias("body")))
    return out.select("request_id", F.col("resource")["service.name"].alias("service"), F.md5("body").alias("body"), "severity_number", "severity_text", F.col("attributes")["doc"].alias("doc"), "time_unix_nano")


@query("""
SELECT l_orderkey * 10 + l_linenumber AS request_id, CASE WHEN l_linenumber % 5 <> 0 THEN upper(md5(CAST(l_orderkey AS VARCHAR))) END AS trace_id, upper(substr(md5(CAST(l_linenumber AS VARCHAR)), 1, 16)) AS span_id, l_linestatus AS name,
  CAST(l_orderkey AS BIGINT) AS start_unix_nano, CAST(l_orderkey + 7 AS BIGINT) AS end_unix_nano, l_returnflag AS service, l_linenumber % 5 = 0 AS invalid FROM lineitem
""")
def otlp_spans_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request per line item; every fifth line's trace id is no hexadecimal text, which makes its span invalid."""
    trace = F.when(F.col("l_linenumber") % 5 != 0, F.md5(F.col("l_orderkey").cast("string"))).otherwise("not hex")
    span = F.struct(trace.alias("traceId"), F.substring(F.md5(F.col("l_linenumber").cast("string")), 1, 16).alias("spanId"), F.col("l_linestatus").alias("name"), F.col("l_orderkey").cast("string").alias("startTimeUnixNano"), (F.col("l_orderkey") + 7).cast("string").alias("endTimeUnixNano"))
    body = _request("resourceSpans", "scopeSpans", "spans", _attr("service.name", F.col("l_returnflag")), F.array(span))
    out = traces.validate_span_fields(readers.read_otlp_spans(table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("request_id"), body.alias("body"))))
    return out.select("request_id", F.hex("trace_id").alias("trace_id"), F.hex("span_id").alias("span_id"), "name", "start_unix_nano", "end_unix_nano", F.get("resource_attrs", F.lit(0))["value"].alias("service"), F.col("bad_trace_id").alias("invalid"))


@query("""
SELECT p_brand AS brand, CAST(p_partkey AS VARCHAR) AS part, metric_type, int_value, float_value, scale, zero_count, positive_offset, n FROM part, LATERAL (VALUES
  ('sum', CAST(p_size AS BIGINT), NULL, NULL, NULL, NULL, NULL), ('gauge', NULL, CAST(p_retailprice AS DOUBLE), NULL, NULL, NULL, NULL),
  ('exponential_histogram', NULL, NULL, 3, CAST(p_size AS BIGINT), CAST(p_partkey % 5 AS INTEGER), CAST(p_size + 3 AS BIGINT))) AS m(metric_type, int_value, float_value, scale, zero_count, positive_offset, n)
""")
def otlp_metrics_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scalars and histograms written as JSON blocks of a resource, and read again."""
    p = table(spark, sf_dir, "part")
    kinds = F.array(*[F.lit(k) for k in ("sum", "gauge", "exponential_histogram")])
    rows = p.select("*", F.posexplode(kinds).alias("k", "metric_type"))
    hist = F.struct(F.lit(3).alias("scale"), F.col("p_size").cast("bigint").alias("zero_count"), (F.col("p_partkey") % 5).cast("int").alias("positive_offset"), F.expr("array(1L, 2L)").alias("positive_counts"), F.col("p_retailprice").cast("double").alias("sum"), (F.col("p_size") + 3).cast("bigint").alias("count"))
    points = rows.select(
        _map("service.name", F.col("p_brand")).alias("resource"), F.concat(F.lit("m_"), "metric_type").alias("name"), F.lit("1").alias("unit"), "metric_type", F.lit(True).alias("monotonic"), _map("part", F.col("p_partkey").cast("string")).alias("attrs"), F.lit(9).cast("bigint").alias("time_unix_nano"),
        F.when(F.col("k") == 0, F.col("p_size").cast("bigint")).alias("int_value"), F.when(F.col("k") == 1, F.col("p_retailprice").cast("double")).alias("float_value"), F.when(F.col("k") == 2, hist).alias("hist"), (F.col("p_partkey") * 3 + F.col("k")).alias("arrival_seq"),
    )
    back = readers.read_otlp_metrics(readers.to_otlp_metrics(points).select(F.concat("resource_key", F.col("first_seq").cast("string")).alias("request_id"), "body"))
    return back.select(F.col("resource")["service.name"].alias("brand"), F.col("attrs")["part"].alias("part"), "metric_type", "int_value", "float_value", "hist.scale", "hist.zero_count", "hist.positive_offset", F.col("hist.count").alias("n"))


# logs ------------------------------------------------------------------------------------------------------------


@query("SELECT doc_id, md5(text) AS body, source AS path, CAST(doc_id * 3 AS VARCHAR) AS offset_text FROM documents")
def text_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("path"), (F.col("doc_id") * 3).alias("offset"), F.col("text").alias("line"))
    return logs.text_records(lines).select("doc_id", F.md5("body").alias("body"), F.col("attributes")["log.file.path"].alias("path"), F.col("attributes")["log.file.offset"].alias("offset_text"))


@query("""
WITH r AS (SELECT conv_id, turn, role, text, regexp_replace(text, '[aeiou]n[a-z]', '<cut>', 'g') AS body, len(regexp_extract_all(text, '[aeiou]n[a-z]')) AS n FROM conversations)
SELECT conv_id, turn, role, md5(body) AS body, CAST(n AS INTEGER) AS redactions FROM r WHERE body IS NULL OR strlen(body) <= 200
""")
def journal_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.col("text").alias("body"))
    return logs.redact_journal(rows, ["[aeiou]n[a-z]"], "<cut>", limit=200).select("conv_id", "turn", "role", F.md5("body").alias("body"), "redactions")


@query("""
WITH r AS (SELECT conv_id, turn, role, text, length(regexp_extract(text, '^[A-Za-z]*')) AS n FROM conversations),
b AS (SELECT *, repeat('#', n) || substr(text, n + 1) AS body FROM r)
SELECT conv_id, turn, role, md5(body) AS body, CAST(coalesce(n, 0) AS INTEGER) AS redactions FROM b
""")
def journal_redaction_anchored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pattern that begins with `^` holds again after each match: all letters at a text's head go one by one."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.col("text").alias("body"))
    return logs.redact_journal(rows, ["^[A-Za-z]"], "#").select("conv_id", "turn", "role", F.md5("body").alias("body"), "redactions")


@query("SELECT doc_id, strlen(text) > 2000 AS record_oversized, CASE WHEN strlen(text) > 2000 THEN md5('') ELSE md5(text) END AS body, CASE WHEN strlen(text) > 2000 THEN 0 ELSE 1 END AS n_attributes FROM documents")
def oversized_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("body"), F.octet_length("text").alias("size"), _map("lang", F.col("lang")).alias("attributes"))
    return logs.mark_oversized_record(d, "size", 2000).select("doc_id", "record_oversized", F.md5("body").alias("body"), F.size("attributes").alias("n_attributes"))


@query("""
SELECT event_id, unit, CAST(epoch_us(ts) // div AS BIGINT) * scale AS time_unix_nano FROM events, LATERAL (VALUES ('unix', 1000000, 1000000000), ('unix_ms', 1000, 1000000), ('unix_us', 1, 1000)) AS f(unit, div, scale)
UNION ALL SELECT event_id, 'unix_ns', epoch_us(ts) * 1000 FROM events
""")
def epoch_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times at the head of a line in the four epoch formats."""
    us = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast(ts AS timestamp_ntz))")
    out = None
    for unit, text in (("unix", F.floor(us / 1_000_000)), ("unix_ms", F.floor(us / 1000)), ("unix_us", us), ("unix_ns", us * 1000)):
        e = table(spark, sf_dir, "events").select("event_id", F.lit(unit).alias("unit"), F.concat(text.cast("string"), F.lit(" started")).alias("body"))
        rows = logs.extract_timestamp(e, "^([0-9]+) ", unit).select("event_id", "unit", "time_unix_nano")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("""
SELECT CAST(c_custkey AS VARCHAR) AS uid, k.name AS container, 'node' || CAST(c_custkey % 7 AS VARCHAR) AS node, 'rs' || CAST(c_nationkey AS VARCHAR) AS replicaset, n_name AS deployment,
  'reg.example/app' AS image, 'sha256:' || md5(CAST(c_custkey AS VARCHAR)) AS digest, c_mktsegment AS segment
FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND n_nationkey % 3 <> 0, LATERAL (VALUES ('main'), ('setup')) AS k(name)
""")
def workload_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pod per customer with two containers; its replica set's owner is known for two thirds of the nations."""
    ns = lambda c: F.concat(F.lit("ns"), F.col(c).cast("string"))
    container = lambda name: F.array(F.struct(F.lit(name).alias("name"), F.lit("reg.example/app:1.2").alias("image")))
    status = lambda name: F.struct(F.lit(name).alias("name"), F.lit("other").alias("image"), F.concat(F.lit("reg.example/app@sha256:"), F.md5(F.col("c_custkey").cast("string"))).alias("image_id"), F.concat(F.lit("containerd://"), F.col("c_custkey").cast("string")).alias("container_id"))
    pods = table(spark, sf_dir, "customer").select(
        ns("c_nationkey").alias("namespace"), F.col("c_custkey").cast("string").alias("uid"), F.concat(F.lit("node"), (F.col("c_custkey") % 7).cast("string")).alias("node_name"), _map("segment", F.col("c_mktsegment"), "other", F.lit("x")).alias("labels"),
        F.array(F.struct(F.lit("ReplicaSet").alias("kind"), F.concat(F.lit("rs"), F.col("c_nationkey").cast("string")).alias("name"), F.lit(True).alias("controller"))).alias("owner_refs"), container("main").alias("containers"), container("setup").alias("init_containers"),
        F.lit(None).cast("array<struct<name:string,image:string>>").alias("ephemeral_containers"), F.array(status("main"), status("setup")).alias("container_statuses"),
    )
    owners = table(spark, sf_dir, "nation").where("n_nationkey % 3 <> 0").select(ns("n_nationkey").alias("namespace"), F.lit("ReplicaSet").alias("kind"), F.concat(F.lit("rs"), F.col("n_nationkey").cast("string")).alias("name"), F.lit("Deployment").alias("owner_kind"), F.col("n_name").alias("owner_name"))
    api = lambda k: F.col("api")[k]
    out = logs.workload_identity(pods, owners, ["segment"])
    return out.select("uid", "container", api("k8s.node.name").alias("node"), api("k8s.replicaset.name").alias("replicaset"), api("k8s.deployment.name").alias("deployment"), api("container.image.name").alias("image"), api("container.image.digest").alias("digest"), api("k8s.pod.label.segment").alias("segment"))


# traces ----------------------------------------------------------------------------------------------------------

_INGEST_SQL = """
WITH s AS (SELECT l_orderkey // 2 AS request_id, l_orderkey AS k, l_quantity AS q, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS copies FROM lineitem),
kept AS (SELECT * FROM s WHERE request_id NOT IN (SELECT request_id FROM s WHERE q = 50 OR q < 3 OR copies > 1)),
t AS (SELECT request_id, k, count(*) AS spans, sum(CAST(q AS BIGINT) * 10) AS size FROM kept GROUP BY ALL)
"""


@query(_INGEST_SQL + """
SELECT request_id, CAST(CASE WHEN count(*) FILTER (WHERE size <= 1500) = 0 THEN 0 WHEN sum(size) FILTER (WHERE size <= 1500) <= 1500 THEN 1 ELSE 2 END AS BIGINT) AS chunks, count(*) FILTER (WHERE size <= 1500) AS selected_traces,
  count(*) FILTER (WHERE size > 1500) AS rejected_traces, CAST(coalesce(sum(spans) FILTER (WHERE size <= 1500), 0) AS BIGINT) AS selected_spans, CAST(coalesce(sum(spans) FILTER (WHERE size > 1500), 0) AS BIGINT) AS rejected_spans FROM t GROUP BY request_id
""")
def trace_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of two orders: those with an invalid span go, the rest is enriched and packed."""
    spans = _spans(table(spark, sf_dir, "lineitem"), False).withColumn("request_id", F.floor(F.col("span_idx") / 200))
    packed = traces.ingest_traces(spans, "reject", {"zone": "z1"}, max_bytes=1500)
    return traces.packing_summary(packed).select("request_id", "chunks", "selected_traces", "rejected_traces", "selected_spans", "rejected_spans")


@query("""
WITH t AS (SELECT l_orderkey // 2 AS request_id, l_orderkey, count(*) AS spans, sum(CAST(l_quantity AS BIGINT) * 10) AS size FROM lineitem GROUP BY ALL)
SELECT request_id, CAST(sum(spans) AS BIGINT) AS rejected_spans, count(*) AS rejected_traces, CAST(count(*) AS VARCHAR) || ' traces exceed the size limit' AS message FROM t WHERE size > 1500 GROUP BY request_id
""")
def trace_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = _spans(table(spark, sf_dir, "lineitem"), False).withColumn("request_id", F.floor(F.col("span_idx") / 200))
    return traces.derive_trace_response(traces.packing_summary(traces.pack_traces(spans, 1500)))


# delivery and targets --------------------------------------------------------------------------------------------


@query("""
WITH a AS (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'http' ELSE 'grpc' END AS protocol, CASE event_id % 6 WHEN 0 THEN '413' WHEN 1 THEN 'OutOfRange' WHEN 2 THEN '503' WHEN 3 THEN 'Unavailable' WHEN 4 THEN '422' ELSE '413' END AS status FROM events)
SELECT event_id, CASE WHEN (protocol = 'http' AND status IN ('400', '413', '422')) OR (protocol = 'grpc' AND status IN ('InvalidArgument', 'OutOfRange')) THEN 'quarantine' ELSE 'again' END AS place FROM a
""")
def quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.element_at(F.array(*[F.lit(x) for x in ("413", "OutOfRange", "503", "Unavailable", "422", "413")]), (F.col("event_id") % 6 + 1).cast("int"))
    attempts = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 2 == 0, "http").otherwise("grpc").alias("protocol"), status.alias("status"))
    again, gone = delivery.split_quarantine(attempts)
    return again.select("event_id", F.lit("again").alias("place")).unionByName(gone.select("event_id", F.lit("quarantine").alias("place")))


@query("""
SELECT 'supplier' AS job, 's' || CAST(s_suppkey AS VARCHAR) || ':9100' AS instance, NULL AS nation FROM supplier
UNION ALL SELECT 'customer', 'c' || CAST(c_custkey AS VARCHAR) || ':9100', CAST(c_nationkey AS VARCHAR) FROM customer
""")
def all_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets of two sources; only one of them has a nation."""
    a = table(spark, sf_dir, "supplier").select(F.lit("supplier").alias("job"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string"), F.lit(":9100")).alias("instance"))
    b = table(spark, sf_dir, "customer").select(F.lit("customer").alias("job"), F.concat(F.lit("c"), F.col("c_custkey").cast("string"), F.lit(":9100")).alias("instance"), F.col("c_nationkey").cast("string").alias("nation"))
    return targets.union_targets(a, b).select("job", "instance", "nation")


@query("""
SELECT '# TYPE wide_total counter' || chr(10) || 'wide_total ' || CAST(count(*) FILTER (WHERE value > 50) AS VARCHAR) || chr(10) || '# TYPE seen gauge' || chr(10) || 'seen ' || CAST(count(*) AS VARCHAR) || chr(10) ||
  '# TYPE kinds counter' || chr(10) || (SELECT string_agg('kinds{kind="' || event_type || '"} ' || CAST(n AS VARCHAR) || chr(10), '' ORDER BY event_type) FROM (SELECT event_type, count(*) AS n FROM events GROUP BY event_type)) AS body FROM events
""")
def own_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts over all events as an exposition text."""
    e = table(spark, sf_dir, "events")
    total = e.agg(F.count(F.when(F.col("value") > 50, 1)).alias("wide_total"), F.count("*").alias("seen"))
    none = F.lit(None).cast("string")
    one = lambda name, kind: total.select(F.lit(kind).alias("kind"), F.lit(name).alias("name"), none.alias("label"), none.alias("label_value"), F.col(name).alias("value"), F.lit(0).alias("seq"))
    per = e.groupBy("event_type").agg(F.count("*").alias("value")).select(F.lit("counter").alias("kind"), F.lit("kinds").alias("name"), F.lit("kind").alias("label"), F.col("event_type").alias("label_value"), "value", F.lit(0).alias("seq"))
    return exposition.render_exposition(one("wide_total", "counter").unionByName(one("seen", "gauge")).unionByName(per))


# host files ------------------------------------------------------------------------------------------------------


@query("SELECT CAST(p_partkey AS VARCHAR) AS host, name, CAST(v AS BIGINT) AS int_value FROM part, LATERAL (VALUES ('node_socket_inuse', p_size), ('node_socket_memory_pages', p_partkey), ('node_socket_memory_bytes', p_partkey * 4096), ('node_socket_inuse', 4)) AS m(name, v)")
def proc_socket(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("TCP: inuse "), _s("p_size"), F.lit(" mem "), _s("p_partkey"), F.lit("\nUDP6: inuse 4\nOther: inuse 9\nRAW: inuse"))
    return hosts.socket(_snapshots(spark, sf_dir, "net/sockstat", text)).select("host", "name", "int_value")


@query("SELECT CAST(p_partkey AS VARCHAR) AS host, name, t AS metric_type, CAST(v AS BIGINT) AS int_value FROM part, LATERAL (VALUES ('node_netstat_tcp_current_established', 'gauge', p_size), ('node_netstat_tcp_segments_received_total', 'sum', p_partkey + 9007199254740993), ('node_netstat_udp_no_port_errors_total', 'sum', 5)) AS m(name, t, v)")
def proc_netstat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A counter above 2^53 keeps all its digits."""
    text = F.concat(F.lit("Tcp: CurrEstab InSegs Unknown\nTcp: "), _s("p_size"), F.lit(" "), (F.col("p_partkey") + 9007199254740993).cast("string"), F.lit(" 1\nUdp: NoPorts\nUdp: 5\nIp: A\nIp: 1"))
    return hosts.netstat(_snapshots(spark, sf_dir, "net/snmp", text)).select("host", "name", "metric_type", "int_value")


@query("SELECT CAST(p_partkey AS VARCHAR) AS host, name, CAST(v AS BIGINT) AS int_value FROM part, LATERAL (VALUES ('node_disk_read_bytes_total', (p_partkey + 9007199254740) * 512), ('node_disk_reads_completed_total', 10), ('node_disk_io_now', p_size)) AS m(name, v)")
def proc_disk_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of a disk are whole numbers; the layout with 11 values has 11 points, of which the three with other values are kept apart."""
    text = F.concat(F.lit("8 0 sda 10 0 "), (F.col("p_partkey") + 9007199254740).cast("string"), F.lit(" 0 0 0 0 0 "), _s("p_size"), F.lit(" 0 0"))
    return hosts.disk(_snapshots(spark, sf_dir, "diskstats", text)).where("int_value <> 0").select("host", "name", "int_value")


@query("SELECT CAST(p_partkey AS VARCHAR) AS host, CAST(p_size AS DOUBLE) + 0.5 AS uptime, CAST(7 AS DOUBLE) / 1e9 - (p_size + 0.5) AS boot FROM part")
def proc_uptime(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = hosts.uptime(_snapshots(spark, sf_dir, "uptime", F.concat(_s("p_size"), F.lit(".5 99.1\n"))))
    of = lambda n: F.max(F.when(F.col("name") == n, F.col("float_value")))
    return points.groupBy("host").agg(of("node_uptime_seconds").alias("uptime"), of("node_boot_time_seconds").alias("boot"))


@query("SELECT CAST(s_suppkey AS VARCHAR) AS host, s_name AS nodename, 'Linux' AS sysname, '' AS domainname, CAST(1 AS BIGINT) AS int_value FROM supplier")
def host_uname(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("host"), F.lit(1).cast("bigint").alias("captured_at_unix_nano"), F.lit("Linux").alias("sysname"), F.lit("6").alias("release"), F.lit("v").alias("version"), F.lit("x").alias("machine"), F.col("s_name").alias("nodename"), F.lit(None).cast("string").alias("domainname"))
    out = hosts.uname_info(s)
    return out.select("host", F.col("attrs")["nodename"].alias("nodename"), F.col("attrs")["sysname"].alias("sysname"), F.col("attrs")["domainname"].alias("domainname"), "int_value")


@query("SELECT CAST(p_partkey AS VARCHAR) AS host, p_brand AS os_name, CAST(p_size AS VARCHAR) AS os_version, 'a \"' || p_brand || '\"' AS os_description FROM part")
def host_os_release(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("# c\nNAME="), _s("p_brand"), F.lit("\nVERSION_ID='"), _s("p_size"), F.lit("'\nPRETTY_NAME=\"a \\\""), _s("p_brand"), F.lit("\\\"\"\nID=x"))
    return hosts.os_release(_snapshots(spark, sf_dir, "os-release", text)).select("host", "os_name", "os_version", "os_description")


def _mixed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of each part's host, some of their lines bad for every third, fourth and fifth one; the last job has files of every second."""
    p, k = lambda file, text: _snapshots(spark, sf_dir, file, text), F.col("p_partkey")
    files = p("stat", F.concat(F.lit("cpu 1 1\ncpu0 "), F.when(k % 3 == 0, "x").otherwise(_s("p_size")), F.lit(" 2\ncpu1 7 -8\n")))
    files = files.union(p("diskstats", F.concat(F.lit("8 0 sda 1 2 3 4 5 6 7 8 9 10 11\n"), F.expr("repeat('8 1 sdb 1 2\n', cast(p_partkey % 40 AS int))"))))
    files = files.union(p("cpu.stat", F.concat(F.lit("usage_usec "), _s("p_size"), F.lit("\nuser_usec 3\nodd 1\n"), F.when(k % 4 == 0, "usage_usec 5\n").otherwise(""))))
    files = files.union(p("pressure/cpu", F.concat(F.lit("some avg10=1.50 avg60=0.10 avg300=0.05 total="), F.when(k % 5 == 0, "-1").otherwise(_s("p_partkey")))))
    return files.union(p("meminfo", F.concat(F.lit("MemTotal: "), _s("p_partkey"), F.lit(" kB"))).where(F.col("host").cast("bigint") % 2 == 0))


@query("""
SELECT CAST(p_partkey AS VARCHAR) AS host, job, n_errors, n_details FROM (
  SELECT p_partkey, 'cpu' AS job, CASE WHEN p_partkey % 3 = 0 THEN 2 ELSE 1 END AS n_errors, CASE WHEN p_partkey % 3 = 0 THEN 2 ELSE 1 END AS n_details FROM part
  UNION ALL SELECT p_partkey, 'disk', CAST(p_partkey % 40 AS INTEGER), CAST(least(p_partkey % 40, 16) AS INTEGER) FROM part WHERE p_partkey % 40 > 0
  UNION ALL SELECT p_partkey, 'cgroup', 1, 1 FROM part WHERE p_partkey % 4 = 0
  UNION ALL SELECT p_partkey, 'pressure', 1, 1 FROM part WHERE p_partkey % 5 = 0)
""")
def proc_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What could not be read: all of it is counted, 16 texts at most are kept."""
    parsed = hosts.parse(_mixed_files(spark, sf_dir), "cpu", "disk", "cgroup", "pressure", "memory")
    return hosts.errors(parsed).select("host", "job", "n_errors", F.size("details").alias("n_details"))


@query("""
SELECT CAST(p_partkey AS VARCHAR) AS host, tag, name, CAST(v AS BIGINT) AS int_value FROM part, LATERAL (VALUES
  ('point', 'node_cpu_milliseconds_total', CASE WHEN p_partkey % 3 <> 0 THEN p_size * 10 END), ('point', 'node_cpu_milliseconds_total', 20), ('point', 'node_cpu_milliseconds_total', 70),
  ('point', 'node_cgroup_cpu_usage_microseconds_total', p_size), ('point', 'node_cgroup_cpu_user_microseconds_total', 3)) AS m(tag, name, v) WHERE v IS NOT NULL
UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'error', NULL, CASE WHEN p_partkey % 3 = 0 THEN 2 ELSE 1 END FROM part
UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'error', NULL, 1 FROM part WHERE p_partkey % 4 = 0
""")
def proc_points_and_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both outputs of one pass: bad lines don't stop the others of their file."""
    out = hosts.tagged(hosts.parse(_mixed_files(spark, sf_dir), "cpu", "cgroup"))
    return out.select("host", "tag", "name", F.coalesce("int_value", F.col("n_errors").cast("bigint")).alias("int_value"))


@query("""
SELECT CAST(p_partkey AS VARCHAR) AS host, m.collector, m.status FROM part, LATERAL (VALUES ('cpu', 'error'), ('disk', CASE WHEN p_partkey % 40 > 0 THEN 'error' ELSE 'ok' END),
  ('cgroup', 'unsupported'), ('pressure', CASE WHEN p_partkey % 5 = 0 THEN 'error' ELSE 'ok' END), ('memory', CASE WHEN p_partkey % 2 = 0 THEN 'ok' ELSE 'unsupported' END), ('network', 'unsupported')) AS m(collector, status)
""")
def collector_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every host and job: unsupported without a file, error with bad lines."""
    return hosts.collector_status(_mixed_files(spark, sf_dir), "cpu", "disk", "cgroup", "pressure", "memory", "network").select("host", "collector", "status")


@query("""
WITH c AS (SELECT p_partkey % 50 AS host, p_partkey AS "at", CASE WHEN p_size % 3 = 0 THEN 'unsupported' WHEN p_size % 3 = 1 THEN 'error' ELSE 'ok' END AS status FROM part),
b AS (SELECT *, lag(status) OVER (PARTITION BY host ORDER BY "at") AS before FROM c)
SELECT CAST(host AS VARCHAR) AS host, "at" AS captured_at, status, before FROM b WHERE status IS DISTINCT FROM before
""")
def collector_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures of a host, in which loadavg is absent, bad or right, and what changed from one to the next."""
    p = table(spark, sf_dir, "part").select((F.col("p_partkey") % 50).cast("string").alias("host"), F.when(F.col("p_size") % 3 == 0, "uptime").otherwise("loadavg").alias("file"), F.col("p_partkey").alias("captured_at_unix_nano"), F.when(F.col("p_size") % 3 == 1, "1 2").otherwise("1 2 3").alias("content"))
    return hosts.transitions(hosts.collector_status(p, "load")).select("host", F.col("at").alias("captured_at"), "status", "before")


@query("""
WITH s AS (SELECT s_suppkey, s_suppkey % 4 AS k FROM supplier)
SELECT CAST(s_suppkey AS VARCHAR) AS host, m.mountpoint, m.name, CAST(m.v AS BIGINT) AS int_value FROM s, LATERAL (VALUES
  ('/', 'node_filesystem_size_bytes', s_suppkey * 4096), ('/', 'node_filesystem_free_bytes', 8192), ('/', 'node_filesystem_avail_bytes', 4096), ('/', 'node_filesystem_files', 9), ('/', 'node_filesystem_files_free', 8),
  ('/', 'node_filesystem_readonly', 0), ('/', 'node_filesystem_device_error', 0), ('/tmp', 'node_filesystem_device_error', 1), ('/over', 'node_filesystem_device_error', 1)) AS m(mountpoint, name, v)
WHERE k <> 0 OR m.mountpoint <> '/'
UNION ALL SELECT CAST(s_suppkey AS VARCHAR), '/', 'node_filesystem_device_error', 1 FROM s WHERE k = 0
""")
def filesystem_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tmpfs and overlay are local, ramfs, lustre and fuse.x are not; a block count that passes 2^63-1 bytes is an error, and so are no sizes."""
    host, one = F.col("s_suppkey").cast("string").alias("host"), F.lit(1).cast("bigint").alias("captured_at_unix_nano")
    text = "1 0 8:1 / / rw - ext4 /dev/a rw\n2 1 0:1 / /tmp rw - tmpfs t rw\n3 1 0:2 / /over ro - overlay o rw\n4 1 0:3 / /r rw - ramfs r rw\n5 1 0:4 / /l rw - lustre l rw\n6 1 0:5 / /f rw - fuse.x f rw"
    s = table(spark, sf_dir, "supplier")
    blocks = F.when(F.col("s_suppkey") % 4 == 0, F.lit(1 << 60)).otherwise(F.col("s_suppkey"))
    sizes = s.select(host, one, F.lit("/").alias("mountpoint"), F.lit(4096).alias("block_size"), blocks.alias("blocks"), F.lit(2).alias("blocks_free"), F.lit(1).alias("blocks_available"), F.lit(9).cast("bigint").alias("files"), F.lit(8).cast("bigint").alias("files_free"), F.lit(False).alias("read_only"))
    points, _ = hosts.filesystem(s.select(host, F.lit("mountinfo").alias("file"), one, F.lit(text).alias("content")), sizes)
    return points.select("host", F.col("attrs")["mountpoint"].alias("mountpoint"), "name", "int_value")


# functions -------------------------------------------------------------------------------------------------------


@query("SELECT doc_id, true AS fits, true AS is_head, true AS is_long FROM documents WHERE text IS NOT NULL")
def bounded_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts cut to 50 bytes: the cut fits, begins the cleaned text, and loses less than a character."""
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", L.bounded_text(F.col("text"), 1 << 30).alias("clean"), L.bounded_text(F.col("text"), 50).alias("b"))
    return d.select("doc_id", (F.octet_length("b") <= 50).alias("fits"), F.col("clean").startswith(F.col("b")).alias("is_head"), ((F.octet_length("clean") <= 50) | (F.octet_length("b") > 46)).alias("is_long"))


@query("""
WITH c AS (SELECT doc_id, regexp_replace(text, '[\\x00-\\x1F\\x7F-\\x{9F}]', chr(65533), 'g') AS t FROM documents)
SELECT doc_id, md5(left(t, list_max(list_filter(range(0, 51), lambda n: strlen(left(t, n)) <= 50)))) AS text FROM c
""")
def bounded_text_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Control characters replaced, then as many whole characters as 50 bytes hold."""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(L.bounded_text(F.col("text"), 50)).alias("text"))


@query("SELECT p_partkey, 'reg:5000/' || lower(replace(p_brand, '#', '-')) AS image, CASE WHEN p_size % 2 = 0 THEN 'sha256:' || md5(p_name) ELSE '' END AS digest, CASE WHEN p_size % 5 = 0 THEN '' ELSE '***' END AS secret FROM part")
def image_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    ref = F.concat(F.lit("reg:5000/"), F.lower(F.regexp_replace("p_brand", "#", "-")), F.lit(":v"), _s("p_size"), F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("@sha256:"), F.md5("p_name"))).otherwise(""))
    return p.select("p_partkey", L.image_name(ref).alias("image"), L.image_digest(ref).alias("digest"), L.mask_secret(F.when(F.col("p_size") % 5 != 0, F.col("p_name"))).alias("secret"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN CAST(p_size > 10 AS VARCHAR) WHEN 2 THEN CAST(p_size AS VARCHAR) ELSE CAST(p_size + 0.5 AS VARCHAR) END AS text FROM part")
def value_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("p_partkey") % 4
    value = F.struct(F.when(kind == 0, F.col("p_name")).alias("stringValue"), F.when(kind == 1, F.col("p_size") > 10).alias("boolValue"), F.when(kind == 2, _s("p_size")).alias("intValue"), F.when(kind == 3, F.col("p_size") + F.lit(0.5)).alias("doubleValue"))
    return table(spark, sf_dir, "part").select("p_partkey", L.any_value_to_string(value).alias("text"))
