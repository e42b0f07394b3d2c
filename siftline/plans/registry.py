"""Queries over the driver's tables, each with the DuckDB SQL that gives the same rows.

The tables stand in for telemetry: events are counters, documents are log files and
envelopes, orders and lineitem are traces and spans, conversations are container lines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.functions import labels as L
from siftline.operators import delivery, envelopes, exposition, hosts, logs, metrics, targets, traces

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _map(*pairs) -> F.Column:
    return F.create_map(*[F.lit(x) if isinstance(x, str) else x for x in pairs])


def _micros() -> F.Column:
    """Microseconds of events.ts, which has no time zone."""
    return F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast(ts AS timestamp_ntz))")


# metrics ---------------------------------------------------------------------------------------------------------


def _counters(spark: SparkSession, sf_dir: str, shuffled: bool = False) -> DataFrame:
    e = table(spark, sf_dir, "events").where("value IS NOT NULL")
    arrival = (F.col("event_id") * 7919) % 100003 if shuffled else F.col("event_id")
    return e.select("event_id", "user_id", "event_type", _micros().alias("at"), arrival.alias("arrival"), F.round(F.col("value") * 100).cast("bigint").alias("value"))


_COUNTERS_SQL = """
WITH c AS (SELECT event_id, user_id, event_type, epoch_us(ts) AS us, {arrival} AS arrival, CAST(round(value * 100) AS BIGINT) AS value FROM events WHERE value IS NOT NULL),
m AS (SELECT *, max(us) OVER (PARTITION BY user_id, event_type ORDER BY arrival, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest FROM c),
k AS (SELECT *, lag(value) OVER (PARTITION BY user_id, event_type ORDER BY arrival, event_id) AS last FROM m WHERE newest IS NULL OR us >= newest),
n AS (SELECT event_id, user_id, event_type, value + sum(CASE WHEN value < last THEN last ELSE 0 END) OVER (PARTITION BY user_id, event_type ORDER BY arrival, event_id) AS value FROM k)
"""


@query(_COUNTERS_SQL.format(arrival="event_id") + "SELECT event_id, user_id, event_type, CAST(value AS BIGINT) AS value FROM n")
def reset_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.normalize_resets(_counters(spark, sf_dir), ["user_id", "event_type"], "value", "at", ["arrival", "event_id"])
    return out.select("event_id", "user_id", "event_type", "value")


@query(_COUNTERS_SQL.format(arrival="(event_id * 7919) % 100003") + "SELECT event_id, CAST(value AS BIGINT) AS value FROM n")
def reset_late_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.normalize_resets(_counters(spark, sf_dir, True), ["user_id", "event_type"], "value", "at", ["arrival", "event_id"]).select("event_id", "value")


@query(_COUNTERS_SQL.format(arrival="event_id") + ", s AS (SELECT event_type, user_id, max(value) - min(value) AS d, count(*) AS n FROM n GROUP BY ALL) SELECT event_type, CAST(sum(d) AS BIGINT) AS increase, count(*) AS series, CAST(sum(n) AS BIGINT) AS points FROM s GROUP BY event_type")
def reset_increase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Total increase of each event type's counters: a healed counter never falls, so a series grew by its span."""
    healed = metrics.normalize_resets(_counters(spark, sf_dir), ["user_id", "event_type"], "value", "at", ["arrival", "event_id"])
    per = healed.groupBy("event_type", "user_id").agg((F.max("value") - F.min("value")).alias("d"), F.count("*").alias("n"))
    return per.groupBy("event_type").agg(F.sum("d").alias("increase"), F.count("*").alias("series"), F.sum("n").alias("points"))


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One series per customer."""
    c = table(spark, sf_dir, "customer")
    attrs = _map("segment", F.col("c_mktsegment"), "nation", F.col("c_nationkey").cast("string"), "__meta_key", F.col("c_custkey").cast("string"), "tmp_sign", F.when(F.col("c_acctbal") < 0, "neg").otherwise("pos"))
    return c.select(F.col("c_custkey").alias("id"), F.concat(F.lit("acct_"), F.lower("c_mktsegment")).alias("name"), _map("service.name", F.concat(F.lit("s"), (F.col("c_custkey") % 5).cast("string"))).alias("resource"), attrs.alias("attrs"))


_LABELLED_SQL = """
WITH l AS (SELECT c_custkey AS id, 'acct_' || lower(c_mktsegment) AS name, 's' || CAST(c_custkey % 5 AS VARCHAR) AS service, c_mktsegment AS segment, CAST(c_nationkey AS VARCHAR) AS nation,
  CAST(c_custkey AS VARCHAR) AS meta, CASE WHEN c_acctbal < 0 THEN 'neg' ELSE 'pos' END AS sign FROM customer)
"""


@query(_LABELLED_SQL + "SELECT id FROM l WHERE regexp_full_match(segment || ';' || sign, '(AUTO.*|BUILD.*);neg')")
def relabel_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.relabel(_labelled(spark, sf_dir), metrics.Rule("keep", ("segment", "tmp_sign"), regex="(AUTO.*|BUILD.*);neg")).select("id")


@query(_LABELLED_SQL + "SELECT id, service FROM l WHERE NOT regexp_full_match(name, 'acct_(house|mach).*')")
def relabel_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.relabel(_labelled(spark, sf_dir), metrics.Rule("drop", ("__name__",), regex="acct_(house|mach).*"))
    return out.select("id", F.col("resource")["service.name"].alias("service"))


@query(_LABELLED_SQL + "SELECT id, CASE WHEN regexp_full_match(service || '/' || nation, 's([0-9])/([0-9]+)') THEN regexp_extract(service || '/' || nation, 's([0-9])/([0-9]+)', 2) || '-' || regexp_extract(service, 's([0-9])', 1) || '$' END AS place, nation FROM l")
def relabel_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = metrics.Rule(source_labels=("service.name", "nation"), separator="/", regex="s([0-9])/([0-9]+)", target_label="place", replacement="${2}-$1$$")
    return metrics.relabel(_labelled(spark, sf_dir), rule).select("id", F.col("attrs")["place"].alias("place"), F.col("attrs")["nation"].alias("nation"))


@query(_LABELLED_SQL + "SELECT id, regexp_replace(name, '^acct_(.*)$', 'balance_\\1') AS name FROM l")
def relabel_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.relabel(_labelled(spark, sf_dir), metrics.Rule(source_labels=("__name__",), regex="acct_(.*)", target_label="__name__", replacement="balance_$1")).select("id", "name")


@query(_LABELLED_SQL + "SELECT id, '[\"__meta_key\",\"nation\",\"segment\"]' AS keys FROM l")
def relabel_labeldrop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.relabel(_labelled(spark, sf_dir), metrics.Rule("labeldrop", regex="tmp_.*")).select("id", F.to_json(L.keys_only(F.col("attrs"))).alias("keys"))


@query(_LABELLED_SQL + "SELECT id, '[\"nation\",\"segment\"]' AS keys FROM l")
def relabel_labelkeep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.relabel(_labelled(spark, sf_dir), metrics.Rule("labelkeep", regex="nation|segment")).select("id", F.to_json(L.keys_only(F.col("attrs"))).alias("keys"))


@query(_LABELLED_SQL + "SELECT id, '[\"nation\",\"segment\",\"tmp_sign\"]' AS keys FROM l WHERE sign = 'neg'")
def relabel_chain_meta_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chain of rules on the evolving labels, then the removal of meta labels."""
    rules = [metrics.Rule(source_labels=("tmp_sign",), target_label="sign"), metrics.Rule("keep", ("sign",), regex="neg"), metrics.Rule("labeldrop", regex="sign")]
    out = metrics.process(_labelled(spark, sf_dir), [lambda p: metrics.relabel_chain(p, rules)])
    return out.select("id", F.to_json(L.keys_only(F.col("attrs"))).alias("keys"))


@query("""
WITH e AS (SELECT event_id, user_id % 10 AS target, event_type || '/' || CAST(user_id AS VARCHAR) AS series FROM events),
f AS (SELECT target, series, min(event_id) AS first FROM e GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY first, series) AS rn FROM f)
SELECT e.target, count(*) AS points, count(DISTINCT e.series) AS series FROM e JOIN r ON e.target = r.target AND e.series = r.series AND rn <= 20 GROUP BY e.target
""")
def cardinality_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 10).alias("target"), F.concat("event_type", F.lit("/"), F.col("user_id").cast("string")).alias("series"))
    return metrics.limit_cardinality(e, "target", "series", 20, ["event_id"]).groupBy("target").agg(F.count("*").alias("points"), F.count_distinct("series").alias("series"))


@query("SELECT p_partkey AS id FROM part WHERE 2 + CASE WHEN p_size > 25 THEN 1 ELSE 0 END + CASE WHEN p_retailprice > 1200 THEN 1 ELSE 0 END <= 3")
def label_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    attrs = F.map_filter(_map("brand", F.col("p_brand"), "big", F.when(F.col("p_size") > 25, "y"), "dear", F.when(F.col("p_retailprice") > 1200, "y")), lambda k, v: v.isNotNull())
    return metrics.limit_labels(p.select(F.col("p_partkey").alias("id"), _map("type", F.col("p_type")).alias("resource"), attrs.alias("attrs")), 3).select("id")


@query("SELECT event_type, count(*) AS points, count(DISTINCT user_id) AS series FROM events GROUP BY event_type")
def series_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("series_key", L.series_key(F.col("event_type"), _map("u", F.col("user_id").cast("string")), _map("k", F.lit("v"))))
    return metrics.count_points(e, "event_type")


@query("SELECT event_id, CASE WHEN value = trunc(value) AND abs(value) < 9.2e18 THEN CAST(value AS BIGINT) END AS int_value, value <> trunc(value) AS is_float FROM events WHERE value IS NOT NULL")
def scalar_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.normalize_scalar(table(spark, sf_dir, "events"), "value").select("event_id", "int_value", "is_float")


def _bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One exposition body per order status: a counter, a gauge and a summary's count for each priority."""
    o = table(spark, sf_dir, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint")).alias("cents"))
    sample = lambda name: F.concat(F.lit(name + '{p="'), F.regexp_replace("o_orderpriority", "-", r"\\\\"), F.lit('"} '))
    lines = F.concat(sample("orders_total"), F.col("n").cast("string"), F.lit(" 1700000000000\n"), sample("cents"), F.col("cents").cast("string"), F.lit(".5\n"), sample("wait_count"), F.col("n").cast("string"), F.lit("\n"), sample("late"), F.lit("NaN\n"))
    body = F.concat(F.lit("# TYPE orders_total counter\n# TYPE wait summary\n\n"), F.array_join(F.sort_array(F.collect_list(lines)), ""), F.lit("# TYPE cents counter\n"))
    return o.groupBy("o_orderstatus").agg(body.alias("body")).select(F.col("o_orderstatus").alias("scrape_id"), F.lit(5_000_000_000).cast("bigint").alias("scraped_at_unix_nano"), "body")


@query("""
WITH o AS (SELECT o_orderstatus AS scrape_id, replace(o_orderpriority, '-', chr(92)) AS p, count(*) AS n, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents FROM orders GROUP BY ALL)
SELECT scrape_id, 'orders_total' AS name, p, true AS monotonic, n AS int_value, CAST(NULL AS DOUBLE) AS float_value, 1700000000000000000 AS time_unix_nano FROM o
UNION ALL SELECT scrape_id, 'cents', p, false, NULL, cents + 0.5, 5000000000 FROM o
UNION ALL SELECT scrape_id, 'wait_count', p, true, n, NULL, 5000000000 FROM o
""")
def exposition_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exposition.parse_exposition(_bodies(spark, sf_dir))
    return out.select("scrape_id", "name", F.col("attrs")["p"].alias("p"), "monotonic", "int_value", "float_value", "time_unix_nano")


@query("""
SELECT l_returnflag AS flag, CAST(count(*) FILTER (WHERE le <= 0) AS BIGINT) AS zero_count, CAST(count(*) FILTER (WHERE le > 0) AS BIGINT) AS total,
  CAST(min(CAST(ceil(log2(le) * 8) AS BIGINT) - 1) AS BIGINT) AS positive_offset, CAST(max(CAST(ceil(log2(le) * 8) AS BIGINT)) - min(CAST(ceil(log2(le) * 8) AS BIGINT)) + 1 AS BIGINT) AS buckets
FROM (SELECT l_returnflag, least(floor(l_extendedprice / 3000) * 3000 + 3000, 60000) + 0.7 AS le FROM lineitem) GROUP BY flag
""")
def exp_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cumulative price buckets of each return flag as an exponential histogram; what lies above 60000 is in the infinite bucket."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("flag"), F.least(F.floor(F.col("l_extendedprice") / 3000) * 3000 + 3000, F.lit(60000)).alias("le"))
    from pyspark.sql import Window

    per = li.groupBy("flag", "le").agg(F.count("*").alias("n"))
    cumulative = per.withColumn("cumulative", F.sum("n").over(Window.partitionBy("flag").orderBy("le"))).select("flag", (F.col("le") + 0.7).alias("le"), "cumulative", F.col("le").cast("bigint").alias("line_no"))
    h = exposition.classic_to_exp_histogram(cumulative, ["flag"], 3)
    total = F.aggregate("positive_counts", F.lit(0).cast("bigint"), lambda a, x: a + x)
    return h.select("flag", "zero_count", total.alias("total"), "positive_offset", F.size("positive_counts").cast("bigint").alias("buckets"))


# targets ---------------------------------------------------------------------------------------------------------


@query("SELECT 'n' || CAST(s_nationkey AS VARCHAR) AS job, s_name || ':9100' AS instance, 'http://' || s_name || ':9100/metrics' AS url, CAST(s_suppkey AS VARCHAR) AS key FROM supplier")
def file_sd_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    content = F.to_json(F.array(F.struct(F.array(F.concat("s_name", F.lit(":9100"))).alias("targets"), _map("job", F.concat(F.lit("n"), F.col("s_nationkey").cast("string")), "key", F.col("s_suppkey").cast("string")).alias("labels"))))
    return targets.targets_from_file_sd(s.select(content.alias("content"))).select("job", "instance", "url", F.col("labels")["key"].alias("key"))


def _pods(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    annotations = F.map_filter(_map("prometheus.io/scrape", F.when(F.col("c_custkey") % 3 != 0, "true"), "prometheus.io/port", F.when(F.col("c_custkey") % 2 == 0, "9100"), "prometheus.io/path", F.when(F.col("c_custkey") % 5 == 0, "m")), lambda k, v: v.isNotNull())
    return c.select(F.concat(F.lit("ns"), F.col("c_nationkey").cast("string")).alias("namespace"), F.lower("c_name").alias("pod_name"), F.lit("node").alias("node_name"), F.when(F.col("c_custkey") % 7 != 0, "Running").otherwise("Pending").alias("phase"), F.concat(F.lit("10.0.0."), (F.col("c_custkey") % 250).cast("string")).alias("pod_ip"), _map("app/x.y", F.col("c_mktsegment")).alias("labels"), annotations.alias("annotations"))


@query("""
SELECT 'ns' || CAST(c_nationkey AS VARCHAR) AS job, '10.0.0.' || CAST(c_custkey % 250 AS VARCHAR) || CASE WHEN c_custkey % 2 = 0 THEN ':9100' ELSE ':8080' END AS instance,
  'http://10.0.0.' || CAST(c_custkey % 250 AS VARCHAR) || CASE WHEN c_custkey % 2 = 0 THEN ':9100' ELSE ':8080' END || CASE WHEN c_custkey % 5 = 0 THEN '/m' ELSE '/metrics' END AS url,
  c_mktsegment AS app, lower(c_name) AS pod FROM customer WHERE c_custkey % 3 <> 0 AND c_custkey % 7 <> 0
""")
def pod_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = targets.targets_from_pods(_pods(spark, sf_dir), default_port=8080)
    return out.select("job", "instance", "url", F.col("labels")["__meta_kubernetes_pod_label_app_x_y"].alias("app"), F.col("labels")["__meta_kubernetes_pod_name"].alias("pod"))


@query("SELECT o_orderkey AS id, n_name AS service, 'n' || CAST(n_nationkey AS VARCHAR) || ':80' AS instance, CAST(n_regionkey AS VARCHAR) AS region FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def target_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("id"), F.col("c_nationkey").alias("target_id"), _map("old", "x").alias("resource"))
    t = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("target_id"), F.col("n_name").alias("job"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string"), F.lit(":80")).alias("instance"), _map("region", F.col("n_regionkey").cast("string")).alias("labels"))
    r = F.col("resource")
    return targets.attribute_to_target(points, t).select("id", r["service.name"].alias("service"), r["service.instance.id"].alias("instance"), r["region"].alias("region"))


@query("SELECT s_name AS job, s_name || '.svc:' || CAST(s_suppkey % 3 * 1000 AS VARCHAR) AS instance FROM supplier WHERE s_suppkey % 3 > 0")
def dns_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.lit("SRV").alias("type"), F.concat("s_name", F.lit(".svc.")).alias("host"), (F.col("s_suppkey") % 3 * 1000).alias("port"), F.lit(0).alias("query_port"))
    return targets.targets_from_dns_records(s).select("job", "instance")


@query("SELECT c_custkey AS host, CASE WHEN c_custkey % 2 = 0 THEN 'own' ELSE c_name END AS name, 'amd64' AS arch, CAST(NULL AS VARCHAR) AS machine FROM customer")
def missing_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    rows = c.select(F.col("c_custkey").alias("host"), F.map_filter(_map("host.name", F.when(F.col("c_custkey") % 2 == 0, "own")), lambda k, v: v.isNotNull()).alias("resource"))
    inventory = c.select(F.col("c_custkey").alias("host"), _map("host.name", F.col("c_name"), "host.arch", "x86_64", "host.id", "m").alias("detected"))
    r = F.col("resource")
    return targets.fill_missing_attributes(rows, inventory).select("host", r["host.name"].alias("name"), r["host.arch"].alias("arch"), r["host.id"].alias("machine"))


# logs ------------------------------------------------------------------------------------------------------------


def _doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every document; the file is the document."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("path"), F.posexplode(F.split("text", "\n")).alias("line_no", "line")).select("path", F.col("line_no").cast("bigint").alias("line_no"), (F.col("line_no") * 10).cast("bigint").alias("offset"), "line")


_LINES_SQL = "WITH s AS (SELECT doc_id AS path, string_split(text, chr(10)) AS p FROM documents), l AS (SELECT path, CAST(i AS BIGINT) AS line_no, p[i + 1] AS line FROM (SELECT path, p, unnest(range(len(p))) AS i FROM s))"


@query(_LINES_SQL + """,
g AS (SELECT *, sum(CASE WHEN strlen(line) <= 4000 AND regexp_matches(line, '^[A-M]') THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY line_no) AS grp FROM l),
r AS (SELECT path, grp, min(line_no) AS line_no, count(*) AS lines, sum(strlen(line)) + count(*) - 1 AS bytes, max(strlen(line)) AS longest, string_agg(line, chr(10) ORDER BY line_no) AS body FROM g GROUP BY path, grp)
SELECT path, line_no, lines, md5(body) AS body, grp = max(grp) OVER (PARTITION BY path) AS last FROM r QUALIFY lines <= 6 AND bytes <= 4000 AND longest <= 4000
""")
def multiline(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = logs.assemble_multiline(_doc_lines(spark, sf_dir), "^[A-M]", max_lines=6, max_bytes=4000, at_end="timeout")
    return out.select("path", "line_no", "lines", F.md5("body").alias("body"), F.col("flush_reason").isNotNull().alias("last"))


@query(_LINES_SQL + " SELECT path, count(*) AS lines, CAST(sum(strlen(line)) AS BIGINT) AS bytes FROM l WHERE strlen(line) <= 500 GROUP BY path")
def oversized_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.drop_oversized(_doc_lines(spark, sf_dir), 500).groupBy("path").agg(F.count("*").alias("lines"), F.sum(F.octet_length("line")).alias("bytes"))


_EMAIL = r"[a-zA-Z0-9._]+@[a-zA-Z0-9.]+"


@query("""
SELECT doc_id, md5(regexp_replace(regexp_replace(text, '[a-zA-Z0-9._]+@[a-zA-Z0-9.]+', '[$1]', 'g'), '[0-9]{9,}', '[$1]', 'g')) AS body,
  CAST(len(regexp_extract_all(text, '[a-zA-Z0-9._]+@[a-zA-Z0-9.]+')) + len(regexp_extract_all(regexp_replace(text, '[a-zA-Z0-9._]+@[a-zA-Z0-9.]+', '[$1]', 'g'), '[0-9]{9,}')) AS INTEGER) AS redactions FROM documents
""")
def redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("body"))
    return logs.redact(d, [_EMAIL, "[0-9]{9,}"], "[$1]", limit=1 << 30).select("doc_id", F.md5("body").alias("body"), "redactions")


@query("SELECT doc_id FROM documents WHERE len(regexp_extract_all(text, 'the ')) = 0 OR strlen(text) + len(regexp_extract_all(text, 'the ')) * 4 <= 3000")
def redact_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that outgrow the limit are dropped; the replacement is longer here, so the last match decides."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("body"))
    return logs.redact(d, ["the "], "********", limit=3000).select("doc_id")


@query("SELECT event_id, CASE WHEN user_id % 4 = 0 THEN 0 ELSE epoch_us(ts) * 1000 + event_id % 1000 END AS time_unix_nano FROM events")
def timestamp_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nanosecond RFC 3339 times in front of a message; every fourth user's messages have none."""
    stamp = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lpad((F.col("event_id") % 1000).cast("string"), 3, "0"), F.lit("Z"))
    e = table(spark, sf_dir, "events").select("event_id", F.concat(F.when(F.col("user_id") % 4 == 0, "no time").otherwise(stamp), F.lit(" "), F.col("event_type")).alias("body"))
    return logs.extract_timestamp(e, r"^(\S+) ", "rfc3339nano").select("event_id", "time_unix_nano")


def _cri_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation is a file: users write to stdout, others to stderr; every third turn ends a record, every eleventh line is broken."""
    c = table(spark, sf_dir, "conversations")
    flat = F.regexp_replace("text", "\n", " ")
    line = F.concat(F.lit("2026-07-18T10:11:12.123456789Z "), F.when(F.col("role") == "user", "stdout").otherwise("stderr"), F.when(F.col("turn") % 3 == 2, " F ").otherwise(" P "), flat)
    line = F.when((F.col("conv_id") + F.col("turn")) % 11 == 0, F.concat(F.lit("broken "), flat)).otherwise(line)
    return c.select(F.col("conv_id").cast("string").alias("path"), F.col("turn").alias("line_no"), F.col("turn").alias("offset"), line.alias("line"))


_CRI_SQL = """
WITH c AS (SELECT CAST(conv_id AS VARCHAR) AS path, turn AS line_no, role = 'user' AS out, turn % 3 = 2 AS f, (conv_id + turn) % 11 = 0 AS bad, replace(text, chr(10), ' ') AS t FROM conversations)
"""


@query(_CRI_SQL + "SELECT path, line_no, CASE WHEN NOT bad THEN 1784369472123456789 END AS time_unix_nano, CASE WHEN bad THEN NULL WHEN out THEN 'stdout' ELSE 'stderr' END AS stream, CASE WHEN bad THEN NULL WHEN f THEN 'F' ELSE 'P' END AS tag, md5(CASE WHEN bad THEN 'broken ' || t ELSE t END) AS content, bad AS parse_error FROM c")
def cri_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.parse_cri(_cri_lines(spark, sf_dir)).select("path", "line_no", "time_unix_nano", "stream", "tag", F.md5("content").alias("content"), "parse_error")


@query(_CRI_SQL + """,
p AS (SELECT *, lag(bad OR f, 1, true) OVER w AS ended, lag(CASE WHEN bad THEN NULL ELSE out END) OVER w AS before FROM c WINDOW w AS (PARTITION BY path ORDER BY line_no)),
g AS (SELECT *, sum(CASE WHEN ended OR bad OR before IS DISTINCT FROM out THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY line_no) AS grp FROM p),
r AS (SELECT path, grp, min(line_no) AS line_no, md5(string_agg(CASE WHEN bad THEN 'broken ' || t ELSE t END, '' ORDER BY line_no)) AS body, bool_or(bad) AS parse_error, NOT bool_or(bad) AND NOT bool_or(f) AS partial FROM g GROUP BY path, grp)
SELECT path, line_no, body, parse_error, partial, partial AND grp < max(grp) OVER (PARTITION BY path) AS sequence_error FROM r
""")
def cri_assemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = logs.assemble_cri(logs.parse_cri(_cri_lines(spark, sf_dir)), at_end="rotation")
    return out.select("path", "line_no", F.md5("body").alias("body"), "parse_error", "partial", "sequence_error")


@query("SELECT c_custkey AS id, c_custkey % 4 <> 0 AS found, CASE WHEN c_custkey % 4 <> 0 THEN lower(replace(n_name, '_', '-')) || 'x' END AS namespace, CASE WHEN c_custkey % 4 <> 0 THEN c_custkey % 9 END AS restart_count FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name NOT LIKE '% %'")
def pod_path_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log paths of pods; every fourth container has a name that is no DNS label."""
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation").where(~F.col("n_name").contains(" ")), F.col("c_nationkey") == F.col("n_nationkey"))
    path = F.concat(F.lit("/var/log/pods/"), F.lower(F.translate("n_name", "_", "-")), F.lit("x_pod-"), F.col("c_custkey").cast("string"), F.lit("_uid-"), F.col("c_custkey").cast("string"), F.when(F.col("c_custkey") % 4 == 0, "/API/").otherwise("/api/"), (F.col("c_custkey") % 9).cast("string"), F.lit(".log"))
    out = logs.pod_identity(c.select(F.col("c_custkey").alias("id"), path.alias("path"), _map("k8s.pod.name", "old").alias("resource")), "/var/log/pods")
    return out.select("id", F.col("identity_found").alias("found"), F.col("resource")["k8s.namespace.name"].alias("namespace"), "restart_count")


@query("""
WITH logs AS (SELECT event_id, user_id % 50 AS uid, CAST(floor(epoch(ts)) AS BIGINT) AS t FROM events),
inv AS (SELECT DISTINCT user_id % 50 AS uid, CAST(floor(epoch(ts)) AS BIGINT) // 20000 * 20000 AS taken FROM events WHERE user_id % 3 = 0),
j AS (SELECT event_id, t, max(taken) AS taken FROM logs LEFT JOIN inv ON logs.uid = inv.uid AND inv.taken <= logs.t GROUP BY event_id, t)
SELECT event_id, CASE WHEN t - taken <= 14400 THEN taken END AS snapshot, CASE WHEN taken IS NULL OR t - taken > 14400 THEN 'none' WHEN t - taken <= 3600 THEN 'fresh' ELSE 'stale' END AS freshness FROM j
""")
def enrich_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.floor(_micros() / 1e6).cast("bigint")
    e = table(spark, sf_dir, "events")
    left = e.select("event_id", (F.col("user_id") % 50).alias("uid"), t.alias("observed_at"))
    at = (F.floor(t / 20000) * 20000).cast("bigint")
    inventory = e.where("user_id % 3 = 0").select((F.col("user_id") % 50).alias("uid"), at.alias("fetched_at")).distinct().withColumn("api", F.struct(F.col("fetched_at").alias("at")))
    out = logs.enrich_from_inventory(left, inventory, ttl=3600, stale_after=14400)
    return out.select("event_id", F.col("api.at").alias("snapshot"), "freshness")


@query("""
WITH e AS (SELECT event_id, CAST(event_id % 9 AS VARCHAR) AS p FROM events)
SELECT event_id, event_id * 1000 + 1000 AS time_unix_nano, CASE p WHEN '0' THEN 24 WHEN '1' THEN 23 WHEN '2' THEN 22 WHEN '3' THEN 17 WHEN '4' THEN 13 WHEN '5' THEN 10 WHEN '6' THEN 9 WHEN '7' THEN 5 ELSE 0 END AS severity_number,
  CASE p WHEN '0' THEN 'EMERG' WHEN '1' THEN 'ALERT' WHEN '2' THEN 'CRIT' WHEN '3' THEN 'ERR' WHEN '4' THEN 'WARNING' WHEN '5' THEN 'NOTICE' WHEN '6' THEN 'INFO' WHEN '7' THEN 'DEBUG' END AS severity_text, event_id % 5 = 0 AS message_missing FROM e
""")
def journal_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = F.map_filter(_map("PRIORITY", (F.col("event_id") % 9).cast("string"), "MESSAGE", F.when(F.col("event_id") % 5 != 0, F.col("event_type"))), lambda k, v: v.isNotNull())
    e = table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("cursor"), (F.col("event_id") + 1).alias("realtime_usec"), fields.alias("fields"), F.lit(False).alias("message_oversized"))
    return logs.journal_to_records(e).select(F.col("cursor").cast("bigint").alias("event_id"), "time_unix_nano", "severity_number", "severity_text", "message_missing")


# traces ----------------------------------------------------------------------------------------------------------


def _spans(spans: DataFrame, loops: bool = True) -> DataFrame:
    """An order is a trace, its lines are spans; the parent is the line before, and in every seventh order the first line's parent is the last."""
    from pyspark.sql import Window

    binary = lambda c, n: F.unhex(F.lpad(F.hex(c), n, "0"))
    o = Window.partitionBy("l_orderkey")
    rows = spans.withColumns({"_last": F.max("l_linenumber").over(o), "_first": F.min("l_linenumber").over(o), "_before": F.lag("l_linenumber").over(o.orderBy("l_linenumber"))})
    parent = F.coalesce("_before", F.when((F.col("l_orderkey") % 7 == 0) & (F.col("_last") > F.col("_first")), F.col("_last")) if loops else F.lit(None).cast("int"))
    start = F.col("l_orderkey") * 1000 + 1
    return rows.select(
        (F.col("l_orderkey") % 1000).alias("request_id"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("span_idx"), binary(F.col("l_orderkey") + 1, 32).alias("trace_id"), binary(F.col("l_linenumber") + 1, 16).alias("span_id"),
        F.when(parent.isNotNull(), binary(parent + 1, 16)).alias("parent_span_id"), F.lit("a=b").alias("trace_state"), F.when(F.col("l_quantity") == 50, "").otherwise(F.col("l_linestatus")).alias("name"),
        start.alias("start_unix_nano"), (start + F.col("l_quantity").cast("bigint") - 3).alias("end_unix_nano"), F.expr("cast(array() AS array<struct<trace_id:binary,span_id:binary,trace_state:string>>)").alias("links"),
        F.array(F.struct(F.lit("service.name").alias("key"), F.col("l_returnflag").alias("value"))).alias("resource_attrs"), (F.col("l_quantity").cast("bigint") * 10).alias("size_bytes"),
    )


_SPANS_SQL = """
WITH s AS (SELECT l_orderkey AS k, l_linenumber AS n, l_quantity AS q, max(l_linenumber) OVER (PARTITION BY l_orderkey) AS last, min(l_linenumber) OVER (PARTITION BY l_orderkey) AS first, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS copies FROM lineitem),
u AS (SELECT DISTINCT k, n FROM s WHERE copies = 1),
v AS (SELECT k % 1000 AS request_id, k, n, copies, q = 50 AS empty_name, CAST(q AS BIGINT) - 3 < 0 AS bad_times, k % 7 = 0 AND last > first AS loops FROM s),
c AS (SELECT *, loops AND max(copies) OVER (PARTITION BY k) = 1 AS cycle FROM v)
"""


@query(_SPANS_SQL + "SELECT request_id, count(*) AS spans, CAST(sum(CASE WHEN empty_name THEN 1 ELSE 0 END) AS BIGINT) AS empty_name, CAST(sum(CASE WHEN bad_times THEN 1 ELSE 0 END) AS BIGINT) AS bad_times FROM c GROUP BY request_id")
def span_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = traces.validate_span_fields(_spans(table(spark, sf_dir, "lineitem")))
    total = lambda c: F.sum(F.col(c).cast("bigint")).alias(c)
    return rows.groupBy("request_id").agg(F.count("*").alias("spans"), total("empty_name"), total("bad_times"))


@query("WITH d AS (SELECT l_orderkey % 1000 AS request_id, l_partkey % 3 AS p, l_orderkey, count(*) OVER (PARTITION BY l_orderkey, l_partkey % 3) AS copies FROM lineitem) SELECT request_id, count(*) AS spans, CAST(sum(CASE WHEN copies > 1 THEN 1 ELSE 0 END) AS BIGINT) AS in_duplicates FROM d GROUP BY request_id")
def duplicate_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Span ids made of the part number, so that an order repeats some."""
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 1000).alias("request_id"), F.unhex(F.lpad(F.hex(F.col("l_orderkey") + 1), 32, "0")).alias("trace_id"), F.unhex(F.lpad(F.hex(F.col("l_partkey") % 3 + 1), 16, "0")).alias("span_id"))
    return traces.duplicate_span_ids(rows).groupBy("request_id").agg(F.count("*").alias("spans"), F.sum(F.col("duplicate_span").cast("bigint")).alias("in_duplicates"))


@query(_SPANS_SQL + "SELECT request_id, count(*) AS in_cycles FROM c WHERE cycle GROUP BY request_id")
def cycle_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.parent_cycle_spans(_spans(table(spark, sf_dir, "lineitem"))).groupBy("request_id").agg(F.count("*").alias("in_cycles"))


@query(_SPANS_SQL + """
SELECT request_id, count(*) AS spans, CAST(sum(CASE WHEN empty_name OR bad_times OR cycle OR copies > 1 THEN 1 ELSE 0 END) AS BIGINT) AS invalid_spans, CAST(sum(CASE WHEN empty_name THEN 1 ELSE 0 END) AS BIGINT) AS empty_name,
  CAST(sum(CASE WHEN bad_times THEN 1 ELSE 0 END) AS BIGINT) AS bad_times, CAST(sum(CASE WHEN cycle THEN 1 ELSE 0 END) AS BIGINT) AS parent_cycle, CAST(0 AS BIGINT) AS bad_trace_id FROM c GROUP BY request_id
""")
def trace_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = traces.validation_report(traces.validate_spans(_spans(table(spark, sf_dir, "lineitem"))))
    return report.select("request_id", "spans", "invalid_spans", "empty_name", "bad_times", "parent_cycle", "bad_trace_id")


@query(_SPANS_SQL + "SELECT k // 2 AS request_id, count(*) AS spans FROM c GROUP BY k // 2 HAVING NOT bool_or(empty_name OR bad_times OR cycle OR copies > 1)")
def trace_reject(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of two orders, so that at every scale some stay and some go."""
    spans = _spans(table(spark, sf_dir, "lineitem")).withColumn("request_id", F.floor(F.col("span_idx") / 200))
    kept = traces.apply_validation(traces.validate_spans(spans), "reject")
    return kept.groupBy("request_id").agg(F.count("*").alias("spans"))


@query("""
WITH RECURSIVE o AS (SELECT o_orderkey AS id, md5(CAST(o_orderkey AS VARCHAR)) AS h FROM orders),
f AS (SELECT id, h, 0 AS i, CAST(2166136261 AS BIGINT) AS acc FROM o
  UNION ALL SELECT id, h, i + 1, (xor(acc, CASE WHEN i = 0 THEN 73 WHEN i < 4 THEN 0 ELSE CAST('0x' || substr(h, (i - 4) * 2 + 1, 2) AS BIGINT) END) * 16777619) & 4294967295 FROM f WHERE i < 20)
SELECT id FROM f WHERE i = 20 AND (acc & 16383) < 1638
""")
def trace_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the traces, by ids of 16 hashed bytes."""
    spans = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.unhex(F.md5(F.col("o_orderkey").cast("string"))).alias("trace_id"))
    return traces.sample_traces(spans, 10.0, 73).select("id")


@query("""
SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true WHEN 3 THEN false WHEN 4 THEN false ELSE true END AS valid FROM part
""")
def tracestate_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.lower(F.regexp_replace("p_brand", "[^A-Za-z0-9]", ""))
    state = F.when(F.col("p_partkey") % 6 == 0, F.concat(k, F.lit("=v1, other=2"))).when(F.col("p_partkey") % 6 == 1, F.concat(k, F.lit("=1,"), k, F.lit("=2"))).when(F.col("p_partkey") % 6 == 2, F.lit("")).when(F.col("p_partkey") % 6 == 3, F.upper(F.concat(k, F.lit("=1"))))
    state = state.when(F.col("p_partkey") % 6 == 4, F.concat(k, F.lit("=a=b"))).otherwise(F.concat(k, F.lit("@sys=x,,")))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), traces.valid_tracestate(state).alias("valid"))


@query("""
SELECT l_orderkey % 1000 AS request_id, count(*) AS spans, CAST(sum(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) AS BIGINT) AS kept_env, CAST(count(*) AS BIGINT) AS with_zone FROM lineitem GROUP BY request_id
""")
def trace_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = traces.enrich_resource(_spans(table(spark, sf_dir, "lineitem")), {"service.name": "new", "zone": "z1"}, "preserve")
    get = lambda k: F.get(F.filter("resource_attrs", lambda a: a["key"] == k), F.lit(0))["value"]
    return rows.groupBy("request_id").agg(F.count("*").alias("spans"), F.sum((get("service.name") == "A").cast("bigint")).alias("kept_env"), F.sum((get("zone") == "z1").cast("bigint")).alias("with_zone"))


@query("""
WITH RECURSIVE t AS (SELECT l_orderkey % 1000 AS request_id, l_orderkey, CAST(sum(CAST(l_quantity AS BIGINT) * 10) AS BIGINT) AS size, min(l_orderkey * 100 + l_linenumber) AS first FROM lineitem GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY first) AS rn FROM t),
f AS (SELECT request_id, 0 AS rn, CAST(-1 AS BIGINT) AS chunk, CAST(99999999 AS BIGINT) AS used, false AS bad FROM (SELECT DISTINCT request_id FROM o)
  UNION ALL SELECT o.request_id, o.rn, CASE WHEN size > 1500 THEN chunk WHEN used + size > 1500 THEN chunk + 1 ELSE chunk END, CASE WHEN size > 1500 THEN used WHEN used + size > 1500 THEN size ELSE used + size END, size > 1500 FROM f JOIN o ON f.request_id = o.request_id AND o.rn = f.rn + 1)
SELECT request_id, CAST(count(DISTINCT chunk) FILTER (WHERE rn > 0 AND NOT bad) AS BIGINT) AS chunks, CAST(count(*) FILTER (WHERE rn > 0 AND NOT bad) AS BIGINT) AS selected_traces, CAST(count(*) FILTER (WHERE bad) AS BIGINT) AS rejected_traces FROM f GROUP BY request_id
""")
def trace_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = traces.pack_traces(_spans(table(spark, sf_dir, "lineitem"), False), 1500)
    return traces.packing_summary(packed).select("request_id", "chunks", "selected_traces", "rejected_traces")


# envelopes and delivery ------------------------------------------------------------------------------------------


def _envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("id"), F.col("source").alias("kind"), F.col("n_chars").alias("bytes"), F.col("doc_id").alias("captured_at"))


@query("""
SELECT doc_id, CASE WHEN doc_id % 5 = 1 THEN 'id' WHEN doc_id % 5 = 2 THEN 'kind' WHEN doc_id % 5 = 3 THEN 'captured_at' WHEN length(text) = 0 THEN 'payload' WHEN doc_id % 5 = 4 THEN 'resource' END AS reason FROM documents
""")
def envelope_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    m = F.col("doc_id") % 5
    rows = d.select(
        "doc_id", F.lit(1).alias("version"), F.when(m == 1, F.upper(F.md5(F.concat(F.lit("a"), F.col("doc_id").cast("string"))))).otherwise(F.md5(F.col("doc_id").cast("string"))).alias("id"), F.when(m == 2, "Bad Kind").otherwise(F.col("source")).alias("kind"), F.lit("s").alias("schema"), F.lit("e").alias("encoding"),
        F.when(m == 3, 0).otherwise(F.col("doc_id") + 1).alias("captured_at_unix_nano"), _map("k", F.when(m == 4, "a\nb").otherwise("v")).alias("resource"), F.col("text").cast("binary").alias("payload"),
    )
    return envelopes.with_reason(rows.withColumn("id", F.when(F.col("doc_id") % 5 == 1, F.concat(F.lit("X"), F.substring("id", 2, 31))).otherwise(F.col("id")))).select("doc_id", "reason")


@query("SELECT doc_id, sha256(text) AS digest FROM documents")
def payload_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("payload"))
    return envelopes.payload_digest(d).select("doc_id", "digest")


@query("SELECT doc_id, CASE WHEN doc_id % 3 <> 0 THEN source END AS service, CASE WHEN doc_id % 3 <> 0 THEN 3 END AS n FROM documents")
def resource_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    r = _map("service.name", F.when(F.col("doc_id") % 3 == 0, "a\tb").otherwise(F.col("source")), "process.pid", "7", "process.runtime.name", "r", "cloud.region", "c", "host.arch", "a", "os.type", "o", "deployment.environment", "d", "container.image.name", "i", "other", "x")
    i = envelopes.resource_identity(r)
    return d.select("doc_id", i["service.name"].alias("service"), F.when(i.isNotNull(), F.cardinality(i)).alias("n"))


@query("SELECT doc_id % 40 AS batch, CASE WHEN doc_id % 40 < 20 THEN 'any' WHEN count(lang) = count(*) AND min(lang) = max(lang) THEN min(lang) END AS region FROM documents GROUP BY batch")
def common_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the batches agree in what counts; what does not count differs in all of them."""
    batch = F.col("doc_id") % 40
    rows = table(spark, sf_dir, "documents").select(batch.alias("batch"), F.array(F.struct(F.lit("k8s.cluster.name").alias("key"), F.when(batch < 20, "any").otherwise(F.col("lang")).alias("value")), F.struct(F.lit("cloud.region").alias("key"), F.col("source").alias("value"))).alias("resource_attrs"))
    return envelopes.common_identity(rows, "batch").select("batch", F.col("identity")["k8s.cluster.name"].alias("region"))


@query("""
SELECT CASE WHEN ascii(right(source, 1)) % 2 = 0 THEN lang ELSE 'any' END || '-' || CAST(doc_id // 40 AS VARCHAR) AS batch, count(*) AS n,
  CASE WHEN count(lang) = count(*) AND min(lang) = max(lang) THEN min(lang) END AS region FROM documents GROUP BY batch
""")
def common_identity_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: for some sources a batch holds one language, for the others several."""
    d = table(spark, sf_dir, "documents")
    head = F.when(F.ascii(F.right("source", F.lit(1))) % 2 == 0, F.col("lang")).otherwise("any")
    rows = d.select(F.concat_ws("-", head, F.expr("doc_id div 40").cast("string")).alias("batch"), F.array(F.struct(F.lit("process.executable.name").alias("key"), F.col("lang").alias("value")), F.struct(F.lit("host.arch").alias("key"), F.col("source").alias("value"))).alias("resource_attrs"))
    sizes = rows.groupBy("batch").agg(F.count("*").alias("n"))
    return envelopes.common_identity(rows, "batch").join(sizes, "batch").select("batch", "n", F.col("identity")["process.executable.name"].alias("region"))


@query("""
WITH RECURSIVE o AS (SELECT doc_id % 50 AS request_id, doc_id, n_chars AS size, row_number() OVER (PARTITION BY doc_id % 50 ORDER BY doc_id) AS rn FROM documents),
f AS (SELECT request_id, 0 AS rn, CAST(-1 AS BIGINT) AS doc_id, CAST(-1 AS BIGINT) AS chunk, CAST(99999999 AS BIGINT) AS used FROM (SELECT DISTINCT request_id FROM o)
  UNION ALL SELECT o.request_id, o.rn, o.doc_id, CASE WHEN f.chunk = -1 THEN 0 WHEN used + size > 20000 THEN chunk + 1 ELSE chunk END, CASE WHEN used + size > 20000 THEN size ELSE used + size END FROM f JOIN o ON f.request_id = o.request_id AND o.rn = f.rn + 1)
SELECT doc_id, CAST(chunk AS INTEGER) AS chunk FROM f WHERE rn > 0
""")
def record_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select((F.col("doc_id") % 50).alias("path"), F.col("doc_id").alias("offset"), F.col("n_chars").alias("size_bytes"))
    return envelopes.batch_records(d, max_bytes=20000).select(F.col("offset").alias("doc_id"), "chunk")


@query("""
WITH RECURSIVE o AS (SELECT doc_id % 50 AS request_id, doc_id, n_chars AS size, row_number() OVER (PARTITION BY doc_id % 50 ORDER BY doc_id) AS rn FROM documents),
f AS (SELECT request_id, 0 AS rn, CAST(-1 AS BIGINT) AS doc_id, CAST(-1 AS BIGINT) AS chunk, CAST(99999999 AS BIGINT) AS used, false AS dead FROM (SELECT DISTINCT request_id FROM o)
  UNION ALL SELECT o.request_id, o.rn, o.doc_id, CASE WHEN dead OR size > 16000 THEN chunk WHEN used + size > 16000 THEN chunk + 1 ELSE chunk END, CASE WHEN used + size > 16000 THEN size ELSE used + size END, dead OR size > 16000 FROM f JOIN o ON f.request_id = o.request_id AND o.rn = f.rn + 1)
SELECT doc_id, CAST(CASE WHEN dead THEN -1 ELSE chunk END AS INTEGER) AS chunk FROM f WHERE rn > 0
""")
def log_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select((F.col("doc_id") % 50).alias("request_id"), F.col("doc_id").alias("record_idx"), F.col("n_chars").alias("size_bytes"))
    return envelopes.pack_logs(d, max_bytes=16000).select(F.col("record_idx").alias("doc_id"), "chunk")


@query("""
WITH RECURSIVE o AS (SELECT *, CASE WHEN grp = lag(grp) OVER (PARTITION BY request_id ORDER BY doc_id) THEN 0 ELSE head END AS extra, row_number() OVER (PARTITION BY request_id ORDER BY doc_id) AS rn
  FROM (SELECT doc_id % 20 AS request_id, doc_id, doc_id // 100 AS grp, 300 + doc_id // 100 % 5 * 50 AS head, n_chars AS size FROM documents)),
f AS (SELECT request_id, 0 AS rn, CAST(-1 AS BIGINT) AS doc_id, CAST(-1 AS BIGINT) AS chunk, CAST(99999999 AS BIGINT) AS used, false AS dead FROM (SELECT DISTINCT request_id FROM o)
  UNION ALL SELECT o.request_id, o.rn, o.doc_id, CASE WHEN dead OR size + head > 16000 THEN chunk WHEN used + size + extra > 16000 THEN chunk + 1 ELSE chunk END, CASE WHEN used + size + extra > 16000 THEN size + head ELSE used + size + extra END, dead OR size + head > 16000 FROM f JOIN o ON f.request_id = o.request_id AND o.rn = f.rn + 1)
SELECT doc_id, CAST(CASE WHEN dead THEN -1 ELSE chunk END AS INTEGER) AS chunk FROM f WHERE rn > 0
""")
def log_packing_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of a request in groups, whose header every chunk repeats that a group goes on in."""
    i = F.col("doc_id")
    d = table(spark, sf_dir, "documents").select((i % 20).alias("request_id"), i.alias("record_idx"), F.expr("doc_id div 100").alias("grp"), (F.expr("doc_id div 100") % 5 * 50 + 300).alias("head"), F.col("n_chars").alias("size_bytes"))
    return envelopes.pack_logs(d, max_bytes=16000, group="grp", header="head").select(F.col("record_idx").alias("doc_id"), "chunk")


@query("SELECT doc_id, doc_id % 4 = 0 OR text IS NULL AS corrupt FROM documents")
def corrupt_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads that no longer have their stored digest, a null payload among them."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("payload"))
    stored = envelopes.payload_digest(d).withColumn("payload", F.when(F.col("doc_id") % 4 == 0, F.concat("payload", F.lit("x").cast("binary"))).otherwise(F.col("payload")))
    good, bad = envelopes.split_corrupt(stored)
    return good.select("doc_id", F.lit(False).alias("corrupt")).unionByName(bad.select("doc_id", F.lit(True).alias("corrupt")))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN md5(CAST(doc_id AS VARCHAR)) ELSE substr(sha256(md5(CAST(doc_id AS VARCHAR)) || ':' || CAST(doc_id % 3 AS VARCHAR)), 1, 32) END AS chunk_id FROM documents")
def chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("doc_id") % 3
    return table(spark, sf_dir, "documents").select("doc_id", envelopes.chunk_id(F.md5(F.col("doc_id").cast("string")), m, m + 1).alias("chunk_id"))


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 AND event_id % 500 IN (400, 413, 422) OR event_id % 4 = 1 AND event_id % 3 = 0 THEN 'permanent' ELSE 'transient' END AS outcome FROM events")
def classify_delivery(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    protocol = F.when(i % 4 == 1, "grpc").otherwise("http")
    status = F.when(i % 4 == 1, F.when(i % 3 == 0, "OutOfRange").otherwise("ResourceExhausted")).when(i % 4 == 0, (i % 500).cast("string")).otherwise("503")
    return table(spark, sf_dir, "events").select("event_id", delivery.classify_delivery(protocol, status).alias("outcome"))


@query("SELECT doc_id AS id FROM documents WHERE doc_id >= 150")
def expire(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delivery.expire(_envelopes(spark, sf_dir), now=250, max_age=100).select("id")


@query("SELECT source AS kind, CAST(sum(n_chars) AS BIGINT) AS bytes, count(*) AS envelopes, CAST(grouping(source) AS TINYINT) AS is_total, sum(n_chars) >= 80000 AS pressure FROM documents GROUP BY ROLLUP (source)")
def depth_by_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delivery.depth_by_signal(_envelopes(spark, sf_dir), 100_000)


@query("SELECT doc_id AS id FROM documents WHERE n_chars <= CASE WHEN source = 'src0' THEN 1000 ELSE 5000 END")
def reject_too_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delivery.reject_too_large(_envelopes(spark, sf_dir), 5000, {"src0": 1000}).select("id")


@query("""
WITH k AS (SELECT doc_id, source, n_chars, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id DESC) AS run FROM documents),
a AS (SELECT *, sum(n_chars) OVER (ORDER BY doc_id DESC) AS total FROM k WHERE source NOT IN ('src0', 'src1') OR run <= 30000)
SELECT doc_id AS id FROM a WHERE total <= 700000
""")
def retain_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delivery.retain_newest(_envelopes(spark, sf_dir), 700_000, {"src0": 30_000, "src1": 30_000}).select("id")


@query("""
WITH m AS (SELECT event_id, event_type, ts, CASE WHEN value * 100 >= 8000 THEN true WHEN value * 100 <= 5000 THEN false END AS mark, value FROM events WHERE value IS NOT NULL)
SELECT event_id, coalesce(last_value(mark IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), false) AS pressure FROM m
""")
def pressure(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("value IS NOT NULL").select("event_id", F.col("event_type").alias("kind"), (F.col("value") * 100).alias("bytes"))
    return delivery.pressure_flag(e, 10_000, time="event_id").select("event_id", "pressure")


@query("""
WITH t AS (SELECT doc_id AS id, source AS kind, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS turn FROM documents)
SELECT id, CAST(turn AS INTEGER) AS turn, row_number() OVER (ORDER BY turn, kind) AS position FROM t
""")
def fair_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delivery.fair_interleave(_envelopes(spark, sf_dir)).select("id", "turn", "position")


@query("""
WITH m AS (SELECT event_id, event_type, CASE WHEN value * 100 >= 8000 THEN true WHEN value * 100 <= 5000 THEN false END AS mark FROM events WHERE value IS NOT NULL AND event_id % 2 = 0),
p AS (SELECT event_id, event_type, coalesce(last_value(mark IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), false) AS on_ FROM m),
x AS (SELECT e.event_id, max_by(p.on_, p.event_id) AS shed FROM events e LEFT JOIN p ON p.event_type = e.event_type AND p.event_id <= e.event_id WHERE e.event_id % 2 = 1 GROUP BY e.event_id)
SELECT event_id, coalesce(shed, false) AS shed FROM x
""")
def shed_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("kind"), F.col("event_id").alias("at"), (F.col("value") * 100).alias("bytes"))
    on = delivery.pressure_flag(e.where("bytes IS NOT NULL AND event_id % 2 = 0"), 10_000)
    return delivery.shed(e.where("event_id % 2 = 1").drop("bytes"), on.select("kind", "at", "pressure")).select("event_id", "shed")


@query("SELECT event_type AS receiver, CAST(sum(CASE WHEN event_id % 3 = 0 THEN event_id % 7 ELSE 0 END) AS BIGINT) AS rejected, count(*) AS responses FROM events GROUP BY event_type")
def rejected_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("receiver"), F.when(F.col("event_id") % 3 == 0, F.col("event_id") % 7).alias("rejected"))
    return delivery.rejected_counts(e, "receiver")


@query("SELECT 'late' AS counter, CAST(count(*) FILTER (WHERE event_id % 5 = 0) AS BIGINT) AS n FROM events UNION ALL SELECT 'large', CAST(count(*) FILTER (WHERE value > 50) AS BIGINT) FROM events")
def op_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select((F.col("event_id") % 5 == 0).alias("late"), (F.col("value") > 50).alias("large"))
    return delivery.op_counters(e, ["late", "large"])


# hosts -----------------------------------------------------------------------------------------------------------


def _snapshots(spark: SparkSession, sf_dir: str, file: str, content) -> DataFrame:
    # part is a small file of many hosts: few tasks read it, but the texts made of it are parsed by all
    part = table(spark, sf_dir, "part").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "p_partkey")
    return part.select(F.col("p_partkey").cast("string").alias("host"), F.lit(file).alias("file"), F.lit(7).cast("bigint").alias("captured_at_unix_nano"), content.alias("content"))


_s = lambda c: F.col(c).cast("string")


@query("SELECT CAST(p_partkey AS VARCHAR) AS host, mode, CAST(v * 10 AS DOUBLE) AS value FROM part, LATERAL (VALUES ('user', p_size), ('nice', 2), ('system', 30), ('idle', p_partkey)) AS m(mode, v)")
def proc_cpu(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("cpu  9 9 9 9\ncpu0 "), _s("p_size"), F.lit(" 2 30 "), _s("p_partkey"), F.lit("\nintr 5"))
    return hosts.cpu(_snapshots(spark, sf_dir, "stat", text)).select("host", F.col("attrs")["mode"].alias("mode"), "value")


@query("SELECT CAST(p_partkey AS VARCHAR) AS host, 'node_disk_read_bytes_total' AS name, CAST(p_size * 512 AS DOUBLE) AS value FROM part UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'node_disk_io_now', CAST(p_partkey AS DOUBLE) FROM part")
def proc_disk(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("   8       0 sda 10 2 "), _s("p_size"), F.lit(" 4 20 5 6 7 "), _s("p_partkey"), F.lit(" 8 9\n 8 1 sdb 1 2 3"))
    return hosts.disk(_snapshots(spark, sf_dir, "diskstats", text)).where(F.col("name").isin("node_disk_read_bytes_total", "node_disk_io_now")).select("host", "name", "value")


@query("SELECT CAST(p_partkey AS VARCHAR) AS host, name, CAST(v AS DOUBLE) AS value FROM part, LATERAL (VALUES ('node_network_receive_bytes_total', p_size), ('node_network_transmit_bytes_total', p_partkey)) AS m(name, v)")
def proc_net(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("Inter-| x\n  eth0: "), _s("p_size"), F.lit(" 1 0 0 0 0 0 0 "), _s("p_partkey"), F.lit(" 3 0\n  lo: 1 2"))
    return hosts.network(_snapshots(spark, sf_dir, "net/dev", text)).select("host", "name", "value")


@query("SELECT CAST(p_partkey AS VARCHAR) AS host, CAST(p_size AS DOUBLE) / 100 AS ratio, CAST(p_partkey AS DOUBLE) AS total FROM part")
def proc_psi(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("some avg10="), _s("p_size"), F.lit(".00 avg60=0.10 avg300=0.05 total="), _s("p_partkey"))
    points = hosts.pressure(_snapshots(spark, sf_dir, "pressure/io", text))
    ratio = F.max(F.when((F.col("name") == "node_pressure_io_waiting_ratio") & (F.col("attrs")["window"] == "10s"), F.col("value")))
    return points.groupBy("host").agg(ratio.alias("ratio"), F.max(F.when(F.col("name") == "node_pressure_io_waiting_microseconds_total", F.col("value"))).alias("total"))


@query("SELECT CAST(p_partkey AS VARCHAR) AS host, CASE WHEN p_partkey % 2 = 0 THEN CAST(p_size AS DOUBLE) END AS current_limit, CASE WHEN p_partkey % 2 = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS unlimited FROM part")
def proc_cgroup(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = hosts.cgroup(_snapshots(spark, sf_dir, "memory.max", F.concat(F.when(F.col("p_partkey") % 2 == 0, _s("p_size")).otherwise("max"), F.lit("\n"))))
    return points.groupBy("host").agg(F.max(F.when(F.col("name") == "node_cgroup_memory_limit_bytes", F.col("value"))).alias("current_limit"), F.max(F.when(F.col("name") == "node_cgroup_memory_limit_unlimited", F.col("value"))).alias("unlimited"))


@query("SELECT CAST(p_partkey AS VARCHAR) AS host, '/data disk' AS mountpoint, CAST(p_partkey + 50 AS BIGINT) AS mount_id, true AS read_only FROM part")
def proc_mounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("36 35 98:0 / /data\\040disk rw - ext4 /dev/a rw\n"), (F.col("p_partkey") + 50).cast("string"), F.lit(" 35 98:0 / /data\\040disk ro,noatime - ext4 /dev/b rw\n40 1 0:4 / /proc rw - proc proc rw"))
    return hosts.mounts(_snapshots(spark, sf_dir, "mountinfo", text)).select("host", "mountpoint", "mount_id", "read_only")


@query("SELECT CAST(p_partkey AS VARCHAR) AS host, CAST(p_size AS DOUBLE) AS load1, CAST(p_partkey * 1024 AS DOUBLE) AS memory FROM part")
def proc_load_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = hosts.load(_snapshots(spark, sf_dir, "loadavg", F.concat(_s("p_size"), F.lit(".0 2.5 3.75 1/1 1")))).where("name = 'node_load1'").select("host", F.col("value").alias("load1"))
    b = hosts.memory(_snapshots(spark, sf_dir, "meminfo", F.concat(F.lit("MemTotal:       "), _s("p_partkey"), F.lit(" kB\nOther: 4 kB")))).select("host", F.col("value").alias("memory"))
    return a.join(b, "host")


@query("""
WITH h AS (SELECT event_id, user_id, event_type, CASE WHEN value IS NULL THEN 'unsupported' WHEN value > 50 THEN 'error' ELSE 'ok' END AS status FROM events),
b AS (SELECT *, lag(status) OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS before FROM h)
SELECT event_id, status, before FROM b WHERE status IS DISTINCT FROM before
""")
def snapshot_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("host"), F.col("event_type").alias("collector"), F.col("event_id").alias("at"), F.when(F.col("value").isNull(), "unsupported").when(F.col("value") > 50, "error").otherwise("ok").alias("status"))
    return hosts.snapshot_health(e).select("event_id", "status", "before")


from siftline.plans import ingest  # noqa: E402, F401  (adds its queries)
