"""Log lines to records: assembly, timestamps, redaction, identities and the journal.

Lines are rows of path, line_no (order within a path), offset and line. An operator that
needs the order of a file works by path and line_no, so files are the unit of parallelism.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.functions import labels as L
from siftline.functions import patterns as P
from siftline.functions.scans import HOT_ROWS, slotted

MAX_LINE, MAX_BATCH = 256 << 10, 512 << 10
#: most bytes of a container line before its content: time, stream, tag and three spaces
CRI_HEAD = 128
RFC3339 = r"\A(\d{4}-\d{2}-\d{2})[Tt](\d{2}:\d{2}:\d{2})(?:\.(\d{1,9}))?\d*([Zz]|[+-]\d{2}:\d{2})\z"
#: fixed values: severity number and text of syslog priorities 0 to 7
SEVERITIES = ((24, "EMERG"), (23, "ALERT"), (22, "CRIT"), (17, "ERR"), (13, "WARNING"), (10, "NOTICE"), (9, "INFO"), (5, "DEBUG"))
#: fixed values: journal fields, and the attributes that they become
JOURNAL_ATTRIBUTES = {
    "SYSLOG_FACILITY": "syslog.facility",
    "SYSLOG_IDENTIFIER": "syslog.identifier",
    "SYSLOG_PID": "syslog.pid",
    "_BOOT_ID": "systemd.boot_id",
    "_COMM": "process.executable.name",
    "_EXE": "process.executable.path",
    "_GID": "group.id",
    "_HOSTNAME": "host.name",
    "_PID": "process.pid",
    "_SYSTEMD_UNIT": "systemd.unit",
    "_SYSTEMD_USER_UNIT": "systemd.user_unit",
    "_TRANSPORT": "systemd.transport",
    "_UID": "user.id",
}


def text_records(lines: DataFrame) -> DataFrame:
    """body, and attributes log.file.path and log.file.offset (of the line's first byte)."""
    return lines.withColumn("body", F.col("line")).withColumn("attributes", F.create_map(F.lit("log.file.path"), F.col("path"), F.lit("log.file.offset"), F.col("offset").cast("string")))


def drop_oversized(lines: DataFrame, max_bytes: int = MAX_LINE) -> DataFrame:
    """Lines of max_bytes bytes at most; null lines are dropped too."""
    return lines.where(F.octet_length("line") <= max_bytes)


def valid_body(raw: Column) -> Column:
    """Text of a line's bytes; each run of bytes that are not UTF-8 becomes one question mark."""
    text = raw.cast("string")
    return F.when(F.is_valid_utf8(text), text).otherwise(F.regexp_replace(F.make_valid_utf8(text), "�+", "?"))


def rfc3339_nanos(text: Column) -> Column:
    """Nanoseconds since 1970 of an RFC 3339 time, all nine digits kept; null if it is none."""
    part = lambda k: F.regexp_extract(text, RFC3339, k)
    zone = F.when(F.upper(part(4)) == "Z", "+00:00").otherwise(part(4))
    at = F.try_to_timestamp(F.concat(part(1), F.lit(" "), part(2), zone), F.lit("yyyy-MM-dd HH:mm:ssxxx"))
    seconds = F.unix_seconds(at)
    nanos = F.rpad(F.coalesce(part(3), F.lit("")), 9, "0").try_cast("bigint")
    return F.when(text.rlike(RFC3339) & (F.abs(seconds) < 9_223_372_036), seconds * 1_000_000_000 + nanos)


#: nanoseconds per unit of the epoch formats
_EPOCH = {"unix": 1_000_000_000, "unix_ms": 1_000_000, "unix_us": 1_000, "unix_ns": 1}


def extract_timestamp(records: DataFrame, pattern: str, fmt: str, column: str = "body") -> DataFrame:
    """time_unix_nano from the one capture group of pattern in column; 0 where that fails, the record is kept.

    Formats: rfc3339, rfc3339nano, unix, unix_ms, unix_us, unix_ns. Captures over 128 bytes and times beyond
    64 bits fail. Run it after assembly and before redaction.
    """
    if P.group_count(pattern) != 1 or P.matches_empty(pattern):
        raise ValueError("a timestamp pattern has one group and never matches an empty text")
    if fmt not in (*_EPOCH, "rfc3339", "rfc3339nano"):
        raise ValueError(f"unknown timestamp format {fmt!r}")
    text = F.regexp_extract(column, P.java_pattern(pattern), 1)
    if fmt in _EPOCH:
        number = F.when(text.rlike(r"\A[0-9]+\z"), text.try_cast("decimal(38,0)"))
        nanos = F.when(F.abs(number) < F.lit(1e19), (number * _EPOCH[fmt]).try_cast("bigint"))
    else:
        nanos = rfc3339_nanos(text)
    return records.withColumn("time_unix_nano", F.when(F.octet_length(text).between(1, 128), F.greatest(F.coalesce(nanos, F.lit(0)), F.lit(0))).otherwise(0).cast("bigint"))


def assemble_multiline(lines: DataFrame, start_pattern: str, max_lines: int = 256, max_bytes: int = MAX_LINE, at_end: str = "hold", keys: tuple[str, ...] = ("path",), hot_rows: int = HOT_ROWS) -> DataFrame:
    """Records of lines: keys, line_no and offset of the first line, body, lines, flush_reason.

    A line that matches begins a record; so does any line with nothing pending. A record with more than
    max_lines lines or max_bytes bytes is dropped with all lines to the next start, and so is one that holds a
    line over max_bytes, which is never a start. The last record of a file is held back (at_end `hold`) or given with
    flush_reason `timeout` or `rotation`. Null lines are ignored. A file with more than hot_rows lines goes by slots of them.
    """
    if not 1 <= max_lines <= 4096 or P.matches_empty(start_pattern):
        raise ValueError("max_lines is 1 to 4096, and the pattern never matches an empty text")
    if at_end not in ("hold", "timeout", "rotation"):
        raise ValueError(f"unknown end {at_end!r}")
    regex = P.java_pattern(start_pattern, 1024)
    size = F.octet_length("line")
    rows = lines.where("line IS NOT NULL").withColumn("_start", (size <= max_bytes) & F.col("line").rlike(regex))
    rows = slotted(rows, list(keys), "line_no", hot_rows=hot_rows).running(["line_no"], sums={"_group": F.col("_start").cast("bigint"), "_lines": F.lit(1).cast("bigint"), "_bytes": size.cast("bigint") + 1})
    # a record's lines and bytes up to each line: what has run up since its start
    start = F.when(F.col("_start"), F.struct((F.col("_lines") - 1).alias("lines"), (F.col("_bytes") - size - 1).alias("bytes")))
    rows = rows.running(["line_no"], lasts={"_from": start}).rows
    n, n_bytes = F.col("_lines") - F.coalesce("_from.lines", F.lit(0)), F.col("_bytes") - F.coalesce("_from.bytes", F.lit(0)) - 1
    over = (n > max_lines) | (n_bytes > max_bytes)
    # lines beyond a limit are counted but not collected, so no record outgrows its limits
    out = rows.withColumns({"_over": over, "_n": n}).groupBy("_key", "_group").agg(
        F.max("_over").alias("_over"), F.max("_n").alias("lines"), F.min(F.struct("line_no", "offset")).alias("_first"), F.sort_array(F.collect_list(F.when(~F.col("_over"), F.struct("line_no", "line")))).alias("_all"),
    )
    last = out.groupBy("_key").agg(F.max("_group").alias("_end"))
    out = out.where("NOT _over").join(last, "_key").withColumn("_last", F.col("_group") == F.col("_end"))
    if at_end == "hold":
        out = out.where("NOT _last")
    body = F.array_join(F.transform("_all", lambda x: x["line"]), "\n")
    reason = F.when(F.col("_last"), at_end)
    return out.select(*[F.col("_key")[k].alias(k) for k in keys], F.col("_first.line_no").alias("line_no"), F.col("_first.offset").alias("offset"), body.alias("body"), "lines", reason.alias("flush_reason"))


CRI = r"(?s)\A([^ ]+) (stdout|stderr) (P|F) (.*)\z"


def parse_cri(lines: DataFrame) -> DataFrame:
    """Container lines `time stream tag content`: columns time_unix_nano, stream, tag, content, parse_error.

    A line that cannot be read keeps its text as content, with parse_error and null for the rest.
    """
    part = lambda k: F.regexp_extract("line", CRI, k)
    nanos = rfc3339_nanos(part(1))
    ok = F.coalesce(F.col("line").rlike(CRI) & nanos.isNotNull() & (nanos >= 0), F.lit(False))
    return lines.withColumns({"time_unix_nano": F.when(ok, nanos), "stream": F.when(ok, part(2)), "tag": F.when(ok, part(3)), "content": F.when(ok, part(4)).otherwise(F.col("line")), "parse_error": ~ok})


def cri_fold(rows: Iterator[tuple], max_bytes: int, pending: dict | None = None, dropping: bool = False) -> tuple[list[dict], dict | None, bool]:
    """One file's fragments (line_no, offset, size, time, stream, tag, content, parse_error) in order -> records, what is pending, whether still dropping."""
    out: list[dict] = []

    def emit(record: dict, partial: bool = False, wrong: bool = False) -> None:
        out.append(record | {"partial": partial, "sequence_error": wrong})

    for line_no, offset, size, time, stream, tag, content, parse_error in rows:
        if size > max_bytes + CRI_HEAD:
            pending = None  # the line and what it would have continued are lost
            continue
        n = len(content.encode())
        if parse_error:
            dropping = False
            if pending:
                emit(pending, True, True)
                pending = None
            if n <= max_bytes:
                emit({"line_no": line_no, "offset": offset, "time_unix_nano": None, "stream": None, "body": content, "parse_error": True})
            continue
        if dropping:
            dropping = tag != "F"
            continue
        if pending and pending["stream"] != stream:
            emit(pending, True, True)
            pending = None
        if n + (len(pending["body"].encode()) if pending else 0) > max_bytes:
            pending, dropping = None, tag == "P"
            continue
        if pending:
            pending = pending | {"body": pending["body"] + content}
        else:
            pending = {"line_no": line_no, "offset": offset, "time_unix_nano": time, "stream": stream, "body": content, "parse_error": False}
        if tag == "F":
            emit(pending)
            pending = None
    return out, pending, dropping


_RECORD = "line_no long, offset long, time_unix_nano long, stream string, body string, parse_error boolean, partial boolean, sequence_error boolean"


def assemble_cri(fragments: DataFrame, max_bytes: int = MAX_LINE, at_end: str = "hold", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Fragments of parse_cri (with path, line_no, offset, line) -> path and records.

    P begins or continues a record and F ends it; time, stream and offset are the first fragment's. A change of
    stream and a line that cannot be read end the pending record, marked partial and sequence_error. A record over
    max_bytes is dropped up to the next F or unreadable line. A line over max_bytes + CRI_HEAD is lost with the record that it would
    continue. At the end of a file the pending record is held, or given as partial with at_end `rotation`.

    After an F and after a line that cannot be read the state is the same whatever came before: nothing pending, nothing
    dropped. These lines cut a file into stretches; what a stretch drops begins at its first record over max_bytes. So records are numbered
    by running sums, also over slots of a file with more than hot_rows lines, and no file is any single task's.
    """
    lost = F.octet_length("line") > max_bytes + CRI_HEAD
    rows = fragments.withColumns({"_lost": F.coalesce(lost, F.lit(False)), "_n": F.coalesce(F.octet_length("content"), F.lit(0)).cast("bigint")})
    rows = rows.withColumn("_sync", ~F.col("_lost") & (F.col("parse_error") | F.coalesce(F.col("tag") == "F", F.lit(False)))).withColumn("_n", F.when(F.col("_lost"), 0).otherwise(F.col("_n")))
    order = ["line_no"]
    cut = slotted(rows, ["path"], "line_no", hot_rows=hot_rows).running(order, before={"_before": F.struct("_sync", "_lost", "stream")})
    stretch = F.col("_before").isNull() | F.col("_before._sync")
    fresh = stretch | F.col("_before._lost") | (~F.col("_lost") & (F.col("parse_error") | ~F.col("stream").eqNullSafe(F.col("_before.stream"))))
    cut = cut.of(lambda rows: rows.withColumns({"_stretch": stretch, "_fresh": fresh})).running(order, sums={"_group": F.col("_fresh").cast("bigint"), "_bytes": F.col("_n")})
    cut = cut.running(order, lasts={"_from": F.when(F.col("_fresh"), F.col("_bytes") - F.col("_n"))})
    over = ~F.col("_lost") & ~F.col("parse_error") & (F.col("_bytes") - F.col("_from") > max_bytes)
    cut = cut.of(lambda rows: rows.withColumn("_over", over.cast("bigint"))).running(order, sums={"_overs": F.col("_over")})
    cut = cut.running(order, lasts={"_overs0": F.when(F.col("_stretch"), F.col("_overs") - F.col("_over"))})
    # from the first record of a stretch that is too large on, only a line that cannot be read is left
    gone = F.when(F.col("parse_error") & ~F.col("_lost"), F.col("_n") > max_bytes).otherwise(F.col("_lost") | (F.col("_overs") > F.col("_overs0")))
    rows = cut.rows.withColumn("_gone", gone)
    out = rows.groupBy("path", "_group").agg(
        F.max("_gone").alias("_gone"), F.min(F.struct("line_no", "offset", "time_unix_nano", "stream", "parse_error")).alias("_first"), F.max(F.struct("line_no", "tag")).alias("_end"),
        F.sort_array(F.collect_list(F.when(~F.col("_gone") & (F.col("_n") > 0), F.struct("line_no", "content")))).alias("_all"),
    )
    ends = out.groupBy("path").agg(F.max("_group").alias("_last")).withColumnRenamed("path", "_path")
    out = out.where("NOT _gone").join(ends, F.col("path").eqNullSafe(F.col("_path")))
    partial, last = F.coalesce(F.col("_end.tag") == "P", F.lit(False)), F.col("_group") == F.col("_last")
    if at_end == "hold":
        out = out.where(~(last & partial))
    return out.select("path", "_first.line_no", "_first.offset", "_first.time_unix_nano", "_first.stream", F.array_join(F.transform("_all", lambda x: x["content"]), "").alias("body"), "_first.parse_error", partial.alias("partial"), (partial & ~last).alias("sequence_error"))


def redact(records: DataFrame, patterns: list[str], replacement: str = "[REDACTED]", limit: int | None = MAX_LINE, column: str = "body", restart: bool = False) -> DataFrame:
    """Replace all matches of the patterns, in order; redactions counts them. Records that grow over limit bytes are dropped.

    The size is tested at every match from left to right, so a text that later matches would shrink
    again is dropped too. 1 to 16 patterns of 1 to 1024 bytes that never match an empty text; the replacement is
    literal, printable and 256 bytes at most. Null texts stay. Without limit nothing is dropped. restart: after a match
    the search begins anew in the rest of the text, where `^` holds again.
    """
    if not 1 <= len(patterns) <= 16 or any(not p or P.matches_empty(p) for p in patterns):
        raise ValueError("1 to 16 patterns that never match an empty text")
    if len(replacement.encode()) > 256 or not replacement.isprintable():
        raise ValueError("the replacement is printable and 256 bytes at most")
    names = records.columns
    n_bytes = len(replacement.encode())
    rows = records.withColumns({"_text": F.col(column), "_hits": F.lit(0), "_over": F.lit(False)})
    for p in patterns:
        regex = P.java_pattern(p, 1024)
        regex = P.restarting(regex) if restart else regex
        rows = rows.withColumn("_found", F.regexp_extract_all("_text", F.lit(f"({regex})"), F.lit(1)))
        over = F.lit(False)
        if limit is not None:
            size = F.octet_length("_text")
            step = lambda a, x: F.struct((a["now"] + n_bytes - F.octet_length(x)).alias("now"), F.greatest(a["most"], a["now"] + n_bytes - F.octet_length(x)).alias("most"))
            grown = F.aggregate("_found", F.struct(size.alias("now"), size.alias("most")), step)
            # matches are gone through one by one only where all of them together could pass the limit
            over = F.coalesce((F.size("_found") > 0) & (size + F.size("_found") * n_bytes > limit) & (grown["most"] > limit), F.lit(False))
        rows = rows.withColumns({"_over": F.col("_over") | over, "_hits": F.col("_hits") + F.greatest(F.size("_found"), F.lit(0)), "_text": F.regexp_replace("_text", regex, P.quoted_replacement(replacement))})
    return rows.where("NOT _over").select(*[F.col("_text").alias(c) if c == column else F.col(c) for c in names if c != "redactions"], F.col("_hits").alias("redactions"))


def redact_journal(records: DataFrame, patterns: list[str], replacement: str = "[REDACTED]", limit: int = MAX_LINE) -> DataFrame:
    """redact for a journal's MESSAGE, whose search begins anew after each match, so `^` may hold again there.

    Only the final size is tested.
    """
    return redact(records, patterns, replacement, None, restart=True).where((F.octet_length("body") <= limit) | F.col("body").isNull())


def pod_identity(records: DataFrame, root: str) -> DataFrame:
    """resource of records whose path is `root/<namespace>_<pod>_<uid>/<container>/<n>.log[.suffix]`; identity_found says so.

    Sets k8s.namespace.name, k8s.pod.name, k8s.pod.uid and k8s.container.name over what resource holds, and restart_count.
    """
    regex = "\\A\\Q" + root.rstrip("/") + r"\E/([^/_]+)_([^/_]+)_([^/_]+)/([^/]+)/(\d+)\.log(?:\.[^/]+)?\z"
    part = lambda k: F.regexp_extract("path", regex, k)
    restart = part(5).try_cast("bigint")
    ok = F.coalesce(F.col("path").rlike(regex) & L.valid_dns_label(part(1)) & L.valid_dns_subdomain(part(2)) & L.valid_uid(part(3)) & L.valid_dns_label(part(4)) & restart.isNotNull(), F.lit(False))
    names = ("k8s.namespace.name", "k8s.pod.name", "k8s.pod.uid", "k8s.container.name")
    found = F.create_map(*[x for k, n in enumerate(names) for x in (F.lit(n), part(k + 1))])
    other = F.map_filter(F.coalesce("resource", F.expr("cast(map() AS map<string,string>)")), lambda k, v: ~k.isin(*names))
    return records.withColumns({"identity_found": ok, "resource": F.when(ok, F.map_concat(other, found)).otherwise(F.col("resource")), "restart_count": F.when(ok, restart)})


_OWNERS = {"Deployment": "deployment", "ReplicaSet": "replicaset", "StatefulSet": "statefulset", "DaemonSet": "daemonset", "Job": "job", "CronJob": "cronjob"}


def workload_identity(pods: DataFrame, owners: DataFrame, allowed_labels: list[str]) -> DataFrame:
    """One row per pod and container: uid, container, api (map of identity attributes).

    pods: namespace, uid, node_name, labels, owner_refs array<struct<kind,name,controller>>, containers, init_containers and
    ephemeral_containers array<struct<name,image>>, container_statuses array<struct<name,image,image_id,container_id>>.
    owners: namespace, kind, name, owner_kind, owner_name, looked up one level for ReplicaSet and Job.
    """
    empty = F.expr("cast(map() AS map<string,string>)")
    pods = pods.withColumn("_own", F.get(F.filter("owner_refs", lambda r: r["controller"]), F.lit(0)))
    up = owners.select(F.col("namespace").alias("_ns"), F.col("kind").alias("_k"), F.col("name").alias("_n"), "owner_kind", "owner_name")
    pods = pods.join(up, (F.col("namespace") == F.col("_ns")) & (F.col("_own.kind") == F.col("_k")) & (F.col("_own.name") == F.col("_n")) & F.col("_k").isin("ReplicaSet", "Job"), "left")
    all_of = F.concat(*[F.coalesce(c, F.expr("cast(array() AS array<struct<name:string,image:string>>)")) for c in ("containers", "init_containers", "ephemeral_containers")])
    rows = pods.withColumn("_c", F.explode(all_of)).withColumn("_s", F.get(F.filter("container_statuses", lambda s: s["name"] == F.col("_c.name")), F.lit(0)))
    image = F.coalesce(F.when(F.col("_c.image") != "", F.col("_c.image")), F.col("_s.image"))
    kind = lambda k: F.create_map(*[F.lit(x) for kv in _OWNERS.items() for x in kv])[k]
    pairs = [
        (F.lit("k8s.node.name"), F.col("node_name")), (F.concat(F.lit("k8s."), kind(F.col("_own.kind")), F.lit(".name")), F.col("_own.name")),
        (F.concat(F.lit("k8s."), kind(F.col("owner_kind")), F.lit(".name")), F.col("owner_name")), (F.lit("container.image.name"), L.image_name(image)),
        (F.lit("container.id"), F.regexp_replace("_s.container_id", r"\A[^:]*://", "")), (F.lit("container.image.id"), F.col("_s.image_id")), (F.lit("container.image.digest"), L.image_digest(F.col("_s.image_id"))),
    ]
    entries = F.array(*[F.struct(k.alias("key"), L.bounded_text(v, 4096).alias("value")) for k, v in pairs])
    own = F.map_from_entries(F.filter(entries, lambda e: e["key"].isNotNull() & F.coalesce(e["value"] != "", F.lit(False))))
    kept = F.map_filter(F.coalesce("labels", empty), lambda k, v: k.isin(*allowed_labels))
    kept = F.transform_keys(kept, lambda k, v: F.concat(F.lit("k8s.pod.label."), k))
    return rows.select("uid", F.col("_c.name").alias("container"), F.map_concat(own, F.transform_values(kept, lambda k, v: L.bounded_text(v, 4096))).alias("api"))


def enrich_from_inventory(logs: DataFrame, inventory: DataFrame, ttl: int = 300, stale_after: int = 3600, keys: tuple[str, ...] = ("uid",), hot_rows: int = HOT_ROWS) -> DataFrame:
    """As-of left join: each log (keys, observed_at seconds) gets the latest snapshot (keys, fetched_at, api) not later than it.

    age decides: up to ttl seconds fresh, up to stale_after stale, else as without snapshot (api null, freshness `none`).
    One pass over both tables ordered by key and time; the snapshots' columns travel in a struct. A key with more than hot_rows rows goes
    by slots of time, into which the latest snapshot before them is carried.
    """
    names = logs.columns
    left = logs.select(*keys, F.col("observed_at").alias("_t"), F.lit(1).alias("_side"), F.struct(*names).alias("_log"), F.lit(None).cast(inventory.schema["api"].dataType).alias("_api"))
    right = inventory.select(*keys, F.col("fetched_at").alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(left.schema["_log"].dataType).alias("_log"), F.col("api").alias("_api"))
    snapshot = F.when(F.col("_side") == 0, F.struct(F.col("_t").alias("at"), F.col("_api").alias("api")))
    rows = slotted(left.union(right), list(keys), "_t", hot_rows=hot_rows).running(["_t", "_side"], lasts={"_found": snapshot}).rows.where("_side = 1")
    age = F.col("_t") - F.col("_found.at")
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    fresh = F.when(~known | age.isNull() | (age > stale_after), "none").when(age <= ttl, "fresh").otherwise("stale")
    rows = rows.withColumn("freshness", fresh)
    return rows.select("_log.*", F.when(F.col("freshness") != "none", F.col("_found.api")).alias("api"), "freshness")


def severity(priority: Column) -> tuple[Column, Column]:
    """Number and text of a syslog priority 0 to 7; null and 0 for any other."""
    number, text = F.lit(0), F.lit(None).cast("string")
    for k, (n, t) in enumerate(SEVERITIES):
        number, text = F.when(priority == str(k), n).otherwise(number), F.when(priority == str(k), t).otherwise(text)
    return number, text


def journal_to_records(entries: DataFrame, units: list[str] | None = None, identifiers: list[str] | None = None) -> DataFrame:
    """(cursor, realtime_usec, fields, message_oversized) -> log records.

    Optional filters by unit and identifier; attributes are those of JOURNAL_ATTRIBUTES that are not empty. A missing MESSAGE gives an
    empty body with message_missing, unless it was oversized. A time beyond 2^63-1 nanoseconds is null.
    """
    if units:
        entries = entries.where(F.col("fields")["_SYSTEMD_UNIT"].isin(*units))
    if identifiers:
        entries = entries.where(F.col("fields")["SYSLOG_IDENTIFIER"].isin(*identifiers))
    number, text = severity(F.col("fields")["PRIORITY"])
    name = F.create_map(*[F.lit(x) for kv in JOURNAL_ATTRIBUTES.items() for x in kv])
    body = F.col("fields")["MESSAGE"]
    return entries.select(
        "cursor", F.try_multiply("realtime_usec", F.lit(1000)).cast("bigint").alias("time_unix_nano"), F.coalesce(F.when(~F.col("message_oversized"), body), F.lit("")).alias("body"), number.alias("severity_number"), text.alias("severity_text"),
        F.transform_keys(F.map_filter("fields", lambda k, v: k.isin(*JOURNAL_ATTRIBUTES) & F.coalesce(v != "", F.lit(False))), lambda k, v: name[k]).alias("attributes"), "message_oversized", (body.isNull() & ~F.col("message_oversized")).alias("message_missing"),
    )


def mark_oversized_record(records: DataFrame, size: str, max_batch_bytes: int = MAX_BATCH) -> DataFrame:
    """Records larger than the bound keep time, severity and cursor, with an empty body, no attributes and record_oversized.

    marker_error says that even the marker (its JSON) is over the bound, as it may be for a very long cursor.
    """
    over = F.coalesce(F.col(size) > max_batch_bytes, F.lit(False))
    out = records.withColumns({"record_oversized": over, "body": F.when(over, "").otherwise(F.col("body"))})
    if "attributes" in records.columns:
        out = out.withColumn("attributes", F.when(over, F.expr("cast(map() AS map<string,string>)")).otherwise(F.col("attributes")))
    kept = [c for c in ("cursor", "time_unix_nano", "severity_number", "severity_text", "body", "attributes", "record_oversized") if c in out.columns]
    return out.withColumn("marker_error", over & (F.octet_length(F.to_json(F.struct(*kept))) > max_batch_bytes))
