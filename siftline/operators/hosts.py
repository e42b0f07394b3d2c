"""Captured kernel text files of many hosts to metric points, and what of them could not be read.

Input: host, file, captured_at_unix_nano, content. `parse` reads each file once, where it stands, into an array of
tagged entries: points, and texts of what is bad. `points` and `errors` are its two outputs, `tagged` both as rows
of one table. A point has host, name, attrs (map), metric_type (`gauge` or `sum`), value (a double), int_value,
float_value and time_unix_nano. Whole numbers (all counters are) stand in int_value exactly, others in float_value; the
other one is null. Bad records don't stop good ones; a file gives at most 16 texts of errors and the number of all.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.functions import labels as L

TICKS, PAGE_BYTES, SECTOR_BYTES, MOST_DETAILS = 100, 4096, 512, 16
_POINT = ("host", "name", "attrs", "metric_type", "value", "int_value", "float_value", "time_unix_nano")
_NONE = "cast(map() AS map<string,string>)"
_FILE = ("host", "file", "captured_at_unix_nano")


def count_of(text: Column) -> Column:
    """A whole number from 0 to 2^63-1, else null."""
    return F.when(text.rlike(r"\A[0-9]+\z"), text.try_cast("bigint"))


def _scaled(n: Column, by: int) -> Column:
    """n times by, null beyond 2^63-1."""
    return n if by == 1 else F.try_multiply(n, F.lit(by).cast("bigint"))


def _amount(text: Column) -> Column:
    """A finite double of 0 or more, else null."""
    v = F.when(text.rlike(r"\A[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?\z"), text.try_cast("double"))
    return F.when(L.finite(v), v)


def _labels(**values: Column) -> Column:
    return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v)]) if values else F.expr(_NONE)


def _entry(name: Column | str, attrs: Column, kind: Column | str, whole: Column | None = None, broken: Column | None = None, detail: Column | None = None) -> Column:
    """A point, or an error if there is a detail and no value; without either it is left out later."""
    whole, broken = (F.lit(None) if x is None else x for x in (whole, broken))
    name = F.lit(name) if isinstance(name, str) else name
    return F.struct(name.alias("name"), attrs.alias("attrs"), (F.lit(kind) if isinstance(kind, str) else kind).alias("metric_type"), whole.cast("bigint").alias("int_value"), broken.cast("double").alias("float_value"), (F.lit(None) if detail is None else detail).cast("string").alias("detail"))


def _error(detail: Column) -> Column:
    return _entry(F.lit(None).cast("string"), F.expr(_NONE), "gauge", detail=detail)


def _no(line: Column, text: Column | str) -> Column:
    return F.concat(F.lit("line "), line["no"].cast("string"), F.lit(": "), F.lit(text) if isinstance(text, str) else text)


def _words(text: Column) -> Column:
    """What stands between white space; none for blank texts."""
    return F.filter(F.split(text, r"\s+"), lambda x: x != "")


def _with_lines(files: DataFrame, keep: Callable[[Column], Column] | None = None) -> DataFrame:
    """lines: number from 1, text, words, of lines that are not blank."""
    lines = F.transform(F.split("content", "\n"), lambda x, i: F.struct((i + 1).alias("no"), x.alias("text"), _words(x).alias("f")))
    return files.withColumn("lines", F.filter(lines, lambda x: (F.size(x["f"]) > 0) & (keep(x) if keep else F.lit(True))))


def _each(files: DataFrame, entries: Callable[[Column], list[Column]], column: str = "lines") -> DataFrame:
    return files.withColumn("entries", F.flatten(F.transform(column, lambda x: F.array(*entries(x)))))


def _valued(name, attrs: Column, kind: str, text: Column, detail: Column, by: int = 1) -> Column:
    """The point of a whole number, times by; an error where it is none or too large."""
    v = _scaled(count_of(text), by)
    return _entry(name, attrs, kind, v, detail=F.when(v.isNull(), detail))


# each job: a DataFrame of its files with content -> the same with entries ----------------------------------------------


def _load(files: DataFrame) -> DataFrame:
    """The first bad field ends the file."""
    files = files.withColumn("f", _words(F.col("content"))).withColumn("v", F.transform(F.slice("f", 1, 3), _amount))
    bad = F.when(F.size("f") < 3, F.lit(0)).otherwise(F.array_position(F.transform("v", lambda x: x.isNull()), True).cast("int"))
    good = lambda k: (bad == 0) | (bad > k + 1)
    points = [_entry(f"node_load{n}", F.expr(_NONE), "gauge", broken=F.when((F.size("f") >= 3) & good(k), F.get("v", F.lit(k)))) for k, n in enumerate((1, 5, 15))]
    detail = F.when(F.size("f") < 3, "fewer than 3 fields").when(bad > 0, F.concat(F.lit("field "), bad.cast("string"), F.lit(" is no number of 0 or more")))
    return files.withColumn("entries", F.array(*points, _error(detail)))


#: fixed values: kernel names of memory figures and the metrics that they become
MEMORY = {
    "MemTotal": "node_memory_MemTotal_bytes",
    "MemFree": "node_memory_MemFree_bytes",
    "MemAvailable": "node_memory_MemAvailable_bytes",
    "Cached": "node_memory_Cached_bytes",
    "Buffers": "node_memory_Buffers_bytes",
}


def _memory(files: DataFrame) -> DataFrame:
    """kB figures in bytes; a fraction, or bytes beyond 2^63-1, is a double."""
    files = _with_lines(files, lambda x: F.substring_index(x["text"], ":", 1).isin(*MEMORY) & x["text"].contains(":"))
    after = lambda x: _words(F.substr(x["text"], F.instr(x["text"], ":") + 1))
    files = files.withColumn("lines", F.transform("lines", lambda x: F.struct(x["no"].alias("no"), F.substring_index(x["text"], ":", 1).alias("key"), after(x).alias("f"))))

    def entries(x: Column) -> list[Column]:
        key, f = x["key"], x["f"]
        name = F.create_map(*[F.lit(v) for kv in MEMORY.items() for v in kv])[key]
        by = F.when(F.get(f, F.lit(1)) == "kB", 1024).otherwise(1)
        n, v = count_of(F.get(f, F.lit(0))), _amount(F.get(f, F.lit(0)))
        whole = F.when(n <= F.lit((1 << 63) - 1) / by, F.try_multiply(n, by.cast("bigint")))
        return [_entry(name, F.expr(_NONE), "gauge", whole, F.when(whole.isNull(), v * by), F.when(v.isNull(), _no(x, F.concat(key, F.lit(" has no number of 0 or more")))))]

    return _each(files, entries)


CPU_MODES = ("user", "nice", "system", "idle", "iowait", "irq", "softirq", "steal")


def _cpu(files: DataFrame) -> DataFrame:
    """Milliseconds per CPU and mode; the line of all CPUs is skipped."""
    files = _with_lines(files, lambda x: x["f"][0].startswith("cpu") & (x["f"][0] != "cpu") & (F.size(x["f"]) > 1))

    values = lambda x: F.transform(F.slice(x["f"], 2, len(CPU_MODES)), lambda t: _scaled(count_of(t), 1000 // TICKS))
    files = files.withColumn("lines", F.transform("lines", lambda x: F.struct(x["no"].alias("no"), F.substr(x["f"][0], F.lit(4)).alias("cpu"), values(x).alias("v"))))

    def entries(x: Column) -> list[Column]:
        out = []
        for k, m in enumerate(CPU_MODES):
            v = F.get(x["v"], F.lit(k))
            out.append(_entry("node_cpu_milliseconds_total", _labels(cpu=x["cpu"], mode=F.lit(m)), "sum", v, detail=F.when((F.size(x["v"]) > k) & v.isNull(), _no(x, f"{m} is no count"))))
        return out

    return _each(files, entries)


def _network(files: DataFrame) -> DataFrame:
    """Received (field 0) and transmitted (field 8) bytes of each device; lines without a colon are headers."""
    files = _with_lines(files, lambda x: x["text"].contains(":"))
    after = lambda x: _words(F.substr(x["text"], F.instr(x["text"], ":") + 1))
    files = files.withColumn("lines", F.transform("lines", lambda x: F.struct(x["no"].alias("no"), F.trim(F.substring_index(x["text"], ":", 1)).alias("d"), after(x).alias("f"))))

    def entries(x: Column) -> list[Column]:
        few, d = F.size(x["f"]) < 9, _labels(device=x["d"])
        out = [_error(F.when(few, _no(x, "fewer than 9 fields")))]
        for name, k, what in (("node_network_receive_bytes_total", 0, "received"), ("node_network_transmit_bytes_total", 8, "transmitted")):
            v = F.when(~few, count_of(F.get(x["f"], F.lit(k))))
            out.append(_entry(name, d, "sum", v, detail=F.when(~few & v.isNull(), _no(x, f"{what} bytes are no count"))))
        return out

    return _each(files, entries)


#: fixed values: protocols of socket statistics, and their labels
SOCKET_PROTOCOLS = {
    "sockets": "sockets",
    "TCP": "tcp",
    "TCP6": "tcp",
    "UDP": "udp",
    "UDP6": "udp",
    "UDPLITE": "udplite",
    "UDPLITE6": "udplite",
    "RAW": "raw",
    "RAW6": "raw",
    "FRAG": "fragment",
    "FRAG6": "fragment",
}
#: fixed values: keys of socket statistics, and their metrics
SOCKET_KEYS = {
    "used": "node_socket_used",
    "inuse": "node_socket_inuse",
    "orphan": "node_socket_orphan",
    "tw": "node_socket_time_wait",
    "alloc": "node_socket_allocated",
    "mem": "node_socket_memory_pages",
    "memory": "node_socket_reassembly_memory_bytes",
}


def _map_of(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def _pairs(f: Column, start: int) -> Column:
    """key, text and first (the key has not come before) of the words from start on, two by two."""
    n = F.floor((F.size(f) - start) / 2).cast("int")
    keys = F.transform(F.slice(f, F.lit(start + 1), F.greatest(F.size(f) - start, F.lit(0))), lambda x, i: F.when(i % 2 == 0, x))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.get(f, 2 * i + start).alias("key"), F.get(f, 2 * i + start + 1).alias("text"), (F.array_position(keys, F.get(f, 2 * i + start)) == 2 * i + 1).alias("first")))).otherwise(F.expr("cast(array() AS array<struct<key:string,text:string,first:boolean>>)"))


def _socket(files: DataFrame) -> DataFrame:
    """`PROTOCOL: key value key value ...`; pages of memory are also given in bytes. Of a protocol the first line counts."""
    files = _with_lines(files)
    known = lambda x: F.when((F.size(x["f"]) >= 3) & (F.size(x["f"]) % 2 == 1) & x["f"][0].endswith(":"), F.regexp_replace(x["f"][0], ":$", ""))
    files = files.withColumn("lines", F.transform("lines", lambda x: F.struct(x["no"].alias("no"), known(x).alias("raw"), _map_of(SOCKET_PROTOCOLS)[known(x)].alias("p"), _pairs(x["f"], 1).alias("pairs"))))
    files = files.withColumn("seen", F.transform("lines", lambda x: x["p"]))
    family = F.when(F.col("file").endswith("6"), "ipv6").otherwise("ipv4")

    def entries(x: Column, i: Column) -> Column:
        first = F.array_position("seen", x["p"]) == i + 1
        kept = F.filter(x["pairs"], lambda p: p["key"].isin(*SOCKET_KEYS))
        labels = _labels(**{"family": family, "network.scope": F.lit("visible_namespace"), "protocol": x["p"]})
        n = lambda p: F.when(p["first"], count_of(p["text"]))
        detail = lambda p: F.when(~p["first"], _no(x, F.concat(F.lit("repeated key "), p["key"]))).when(n(p).isNull(), _no(x, F.concat(p["key"], F.lit(" is no count"))))
        points = F.transform(kept, lambda p: _entry(_map_of(SOCKET_KEYS)[p["key"]], labels, "gauge", n(p), detail=detail(p)))
        pages = F.transform(F.filter(kept, lambda p: p["key"] == "mem"), lambda p: _entry("node_socket_memory_bytes", labels, "gauge", _scaled(n(p), PAGE_BYTES)))
        none = F.array(_error(F.when(~F.exists(kept, lambda p: n(p).isNotNull()), _no(x, "no supported key"))))
        return (
            F.when(x["raw"].isNull(), F.array(_error(_no(x, "no protocol record"))))
            .when(x["p"].isNull(), F.filter(none, lambda e: F.lit(False)))
            .when(~first, F.array(_error(_no(x, F.concat(F.lit("repeated protocol "), x["p"])))))
            .otherwise(F.concat(points, pages, none))
        )

    return files.withColumn("entries", F.flatten(F.transform("lines", entries)))


#: fixed values: exported fields of protocol statistics, and their metrics
NETSTAT = {
    "Tcp": {
        "ActiveOpens": "node_netstat_tcp_active_opens_total",
        "PassiveOpens": "node_netstat_tcp_passive_opens_total",
        "AttemptFails": "node_netstat_tcp_attempt_failures_total",
        "EstabResets": "node_netstat_tcp_established_resets_total",
        "CurrEstab": "node_netstat_tcp_current_established",
        "InSegs": "node_netstat_tcp_segments_received_total",
        "OutSegs": "node_netstat_tcp_segments_sent_total",
        "RetransSegs": "node_netstat_tcp_segments_retransmitted_total",
        "InErrs": "node_netstat_tcp_receive_errors_total",
        "OutRsts": "node_netstat_tcp_resets_sent_total",
        "InCsumErrors": "node_netstat_tcp_checksum_errors_total",
    },
    "Udp": {
        "InDatagrams": "node_netstat_udp_datagrams_received_total",
        "NoPorts": "node_netstat_udp_no_port_errors_total",
        "InErrors": "node_netstat_udp_receive_errors_total",
        "OutDatagrams": "node_netstat_udp_datagrams_sent_total",
        "RcvbufErrors": "node_netstat_udp_receive_buffer_errors_total",
        "SndbufErrors": "node_netstat_udp_send_buffer_errors_total",
        "InCsumErrors": "node_netstat_udp_checksum_errors_total",
        "IgnoredMulti": "node_netstat_udp_ignored_multicast_total",
        "MemErrors": "node_netstat_udp_memory_errors_total",
    },
}


def _netstat(files: DataFrame) -> DataFrame:
    """Pairs of a header and a value line; CurrEstab is a gauge, all others count. Of a protocol the first pair counts."""
    files = _with_lines(files)
    n = F.ceil(F.size("lines") / 2).cast("int")
    pairs = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.get("lines", 2 * i).alias("h"), F.get("lines", 2 * i + 1).alias("v"))))
    good = lambda x: (F.size(x["h"]["f"]) >= 2) & (F.size(x["h"]["f"]) == F.size(x["v"]["f"])) & (x["h"]["f"][0] == x["v"]["f"][0]) & x["h"]["f"][0].endswith(":")
    pairs = F.transform(pairs, lambda x: F.struct(F.when(x["v"].isNull(), x["h"]["no"]).otherwise(x["v"]["no"]).alias("no"), x["h"]["f"].alias("h"), x["v"]["f"].alias("v"), F.when(x["v"].isNotNull() & good(x), F.regexp_replace(x["h"]["f"][0], ":$", "")).alias("p")))
    files = files.withColumn("lines", F.coalesce(pairs, F.expr("cast(array() AS array<struct<no:int,h:array<string>,v:array<string>,p:string>>)")))
    files = files.withColumn("seen", F.transform("lines", lambda x: x["p"]))
    labels = _labels(**{"network.scope": F.lit("visible_namespace")})

    names = _map_of({f"{p} {key}": name for p, keys in NETSTAT.items() for key, name in keys.items()})

    def entries(x: Column, i: Column) -> Column:
        def of(key: Column, k: Column) -> Column:
            name = names[F.concat(x["p"], F.lit(" "), key)]
            first, n = F.array_position(x["h"], key) == k + 1, count_of(F.get(x["v"], k))
            bad = F.when(name.isNotNull(), F.when(~first, F.concat(F.lit("repeated "), key)).when(n.isNull(), F.concat(key, F.lit(" is no count"))))
            return _entry(name, labels, F.when(key == "CurrEstab", "gauge").otherwise("sum"), F.when(first, n), detail=F.when(bad.isNotNull(), _no(x, bad)))

        first = F.array_position("seen", x["p"]) == i + 1
        return (
            F.when(x["p"].isNull(), F.array(_error(_no(x, "no pair of a header and values"))))
            .when(~x["p"].isin(*NETSTAT), F.array(_error(F.lit(None))))
            .when(~first, F.array(_error(_no(x, F.concat(F.lit("repeated protocol "), x["p"])))))
            .otherwise(F.transform(x["h"], of))
        )

    return files.withColumn("entries", F.flatten(F.transform("lines", entries)))


#: fixed values: fields of a disk's line after its name; (metric, factor, type)
DISK = (
    ("reads_completed_total", 1, "sum"),
    ("reads_merged_total", 1, "sum"),
    ("read_bytes_total", SECTOR_BYTES, "sum"),
    ("read_milliseconds_total", 1, "sum"),
    ("writes_completed_total", 1, "sum"),
    ("writes_merged_total", 1, "sum"),
    ("written_bytes_total", SECTOR_BYTES, "sum"),
    ("write_milliseconds_total", 1, "sum"),
    ("io_now", 1, "gauge"),
    ("io_milliseconds_total", 1, "sum"),
    ("io_weighted_milliseconds_total", 1, "sum"),
    ("discards_completed_total", 1, "sum"),
    ("discards_merged_total", 1, "sum"),
    ("discarded_bytes_total", SECTOR_BYTES, "sum"),
    ("discard_milliseconds_total", 1, "sum"),
    ("flush_requests_completed_total", 1, "sum"),
    ("flush_milliseconds_total", 1, "sum"),
)


def _disk(files: DataFrame) -> DataFrame:
    """11, 15 or 17 and more values after major, minor and device; one bad value spoils its line."""
    files = _with_lines(files)
    n = lambda x: F.size(x["f"]) - 3
    used = lambda x: F.when(n(x) >= 17, 17).when(n(x) >= 15, 15).otherwise(11)
    values = lambda x: F.transform(F.slice(x["f"], F.lit(4), used(x)), count_of)
    files = files.withColumn("lines", F.transform("lines", lambda x: F.struct(x["no"].alias("no"), x["f"].alias("f"), F.when(n(x) >= 11, values(x)).alias("v"))))

    labels = lambda x: _labels(device=F.get(x["f"], F.lit(2)), major=count_of(F.get(x["f"], F.lit(0))).cast("string"), minor=count_of(F.get(x["f"], F.lit(1))).cast("string"))

    def fault(x: Column) -> Column:
        f, v = x["f"], x["v"]
        bad = F.when(n(x) < 11, "fewer than 14 fields").when(F.octet_length(f[2]) > 255, "device name too long").when(count_of(f[0]).isNull() | count_of(f[1]).isNull(), "no device numbers")
        bad = bad.when((n(x) > 11) & (n(x) < 15), "incomplete discard fields").when(n(x) == 16, "incomplete flush fields").when(F.exists(v, lambda y: y.isNull()), "a field is no count")
        for k, (_, by, _t) in enumerate(DISK):
            if by > 1:
                bad = bad.when(F.get(v, F.lit(k)) > ((1 << 63) - 1) // by, "sectors are too many for bytes")
        return bad

    files = files.withColumn("lines", F.transform("lines", lambda x: F.struct(x["no"].alias("no"), x["f"].alias("f"), x["v"].alias("v"), labels(x).alias("labels"), fault(x).alias("bad"))))

    def entries(x: Column) -> Column:
        points = [_entry(f"node_disk_{name}", x["labels"], kind, _scaled(F.get(x["v"], F.lit(k)), by)) for k, (name, by, kind) in enumerate(DISK)]
        return F.when(x["bad"].isNotNull(), F.array(_error(_no(x, x["bad"])))).otherwise(F.array(*points))

    return files.withColumn("entries", F.flatten(F.transform("lines", entries)))


#: fixed values: keys of control group files, and their metrics
CPU_STAT = {
    "usage_usec": "node_cgroup_cpu_usage_microseconds_total",
    "user_usec": "node_cgroup_cpu_user_microseconds_total",
    "system_usec": "node_cgroup_cpu_system_microseconds_total",
    "nr_periods": "node_cgroup_cpu_periods_total",
    "nr_throttled": "node_cgroup_cpu_throttled_periods_total",
    "throttled_usec": "node_cgroup_cpu_throttled_microseconds_total",
}
MEMORY_EVENTS = ("low", "high", "max", "oom", "oom_kill", "oom_group_kill")
IO_STAT = {
    "rbytes": "node_cgroup_io_read_bytes_total",
    "wbytes": "node_cgroup_io_written_bytes_total",
    "rios": "node_cgroup_io_read_operations_total",
    "wios": "node_cgroup_io_write_operations_total",
    "dbytes": "node_cgroup_io_discarded_bytes_total",
    "dios": "node_cgroup_io_discard_operations_total",
}
CGROUP_VALUES = {
    "cpu.weight": "node_cgroup_cpu_weight",
    "memory.current": "node_cgroup_memory_current_bytes",
    "memory.swap.current": "node_cgroup_memory_swap_current_bytes",
    "pids.current": "node_cgroup_pids_current",
}
CGROUP_LIMITS = {
    "memory.max": ("node_cgroup_memory_limit_bytes", "node_cgroup_memory_limit_unlimited"),
    "memory.swap.max": ("node_cgroup_memory_swap_limit_bytes", "node_cgroup_memory_swap_limit_unlimited"),
    "pids.max": ("node_cgroup_pids_limit", "node_cgroup_pids_limit_unlimited"),
}


def _cgroup(files: DataFrame) -> DataFrame:
    """One scan for all files of a control group. `max` gives unlimited 1 and no limit; of a repeated key the first counts."""
    files = _with_lines(files).withColumn("all", _words(F.col("content")))
    scope = _labels(**{"cgroup.scope": F.lit("configured_root")})
    scoped = lambda **more: _labels(**{"cgroup.scope": F.lit("configured_root")}, **more)
    good = lambda x: (F.size(x["f"]) == 2) & count_of(F.get(x["f"], F.lit(1))).isNotNull()
    files = files.withColumn("keys", F.transform("lines", lambda x: F.when(good(x), x["f"][0])))

    def keyed(x: Column, i: Column) -> Column:
        key, n = x["f"][0], F.get(x["f"], F.lit(1))
        first = F.array_position("keys", key)
        again = (first > 0) & (first < i + 1)
        bad = F.when(F.size(x["f"]) != 2, "no key and value").when(again, "repeated key").when(~good(x), "no count")
        is_cpu = F.col("file") == "cpu.stat"
        name = F.when(is_cpu, _map_of(CPU_STAT)[key]).when(key.isin(*MEMORY_EVENTS), "node_cgroup_memory_events_total")
        attrs = F.when(is_cpu, scope).otherwise(scoped(event=key))
        return _entry(name, attrs, "sum", F.when(bad.isNull() & name.isNotNull(), count_of(n)), detail=F.when(bad.isNotNull(), _no(x, bad)))

    one = F.when(F.size("all") == 1, F.col("all")[0])
    alone = F.when(F.size("all") != 1, "not one field").when(count_of(one).isNull(), "no count")
    value = _entry(_map_of(CGROUP_VALUES)[F.col("file")], scope, "gauge", count_of(one), detail=alone)
    limit_of = lambda k: _map_of({f: v[k] for f, v in CGROUP_LIMITS.items()})[F.col("file")]
    limits = [_entry(limit_of(0), scope, "gauge", count_of(one)), _entry(limit_of(1), scope, "gauge", F.when(one == "max", 1).when(count_of(one).isNotNull(), 0), detail=F.when(F.coalesce(one != "max", F.lit(True)), alone))]
    two = F.size("all") == 2
    q, period = F.get("all", F.lit(0)), F.when(two, count_of(F.get("all", F.lit(1))))
    sound = F.coalesce(period > 0, F.lit(False))
    quota = [
        _entry("node_cgroup_cpu_period_microseconds", scope, "gauge", F.when(sound, period), detail=F.when(~two, "not two fields").when(~sound, "no period")), _entry("node_cgroup_cpu_quota_microseconds", scope, "gauge", F.when(sound, count_of(q))),
        _entry("node_cgroup_cpu_quota_unlimited", scope, "gauge", F.when(sound, F.when(q == "max", 1).when(count_of(q).isNotNull(), 0)), detail=F.when(sound & (q != "max") & count_of(q).isNull(), "no quota")),
    ]

    def devices(x: Column) -> Column:
        device = x["f"][0]
        # numbers of devices have 32 bits
        number = lambda t: F.coalesce(count_of(t) < (1 << 32), F.lit(False))
        named = device.rlike(r"\A[0-9]+:[0-9]+\z") & number(F.substring_index(device, ":", 1)) & number(F.substring_index(device, ":", -1)) & (F.size(x["f"]) >= 2)
        parts = F.slice(x["f"], F.lit(2), F.greatest(F.size(x["f"]) - 1, F.lit(0)))
        keys = F.transform(parts, lambda t: F.substring_index(t, "=", 1))

        def of(t: Column, i: Column) -> Column:
            key, text = F.substring_index(t, "=", 1), F.substr(t, F.instr(t, "=") + 1)
            known = key.isin(*IO_STAT)
            bad = F.when(~t.contains("="), "no key and value").when(known & (F.array_position(keys, key) < i + 1), F.concat(F.lit("repeated key "), key)).when(known & count_of(text).isNull(), F.concat(key, F.lit(" is no count")))
            return _entry(_map_of(IO_STAT)[key], scoped(device=device), "sum", F.when(bad.isNull() & known, count_of(text)), detail=F.when(bad.isNotNull(), _no(x, bad)))

        return F.when(named, F.transform(parts, of)).otherwise(F.array(_error(_no(x, "no device record"))))

    file = F.col("file")
    entries = (
        F.when(file.isin("cpu.stat", "memory.events"), F.transform("lines", keyed)).when(file == "io.stat", F.flatten(F.transform("lines", devices))).when(file == "cpu.max", F.array(*quota))
        .when(file.isin(*CGROUP_LIMITS), F.array(*limits)).when(file.isin(*CGROUP_VALUES), F.array(value)).otherwise(F.array(_entry("node_cgroup_v2_info", scope, "gauge", F.lit(1))))
    )
    return files.withColumn("entries", entries)


def _uptime(files: DataFrame) -> DataFrame:
    """Seconds since the start, and the start in seconds since 1970."""
    files = files.withColumn("u", _amount(F.get(_words(F.col("content")), F.lit(0))))
    bad = F.when(F.col("u").isNull(), "no number of 0 or more")
    return files.withColumn("entries", F.array(_entry("node_uptime_seconds", F.expr(_NONE), "gauge", broken=F.col("u"), detail=bad), _entry("node_boot_time_seconds", F.expr(_NONE), "gauge", broken=F.col("captured_at_unix_nano") / 1e9 - F.col("u"))))


WINDOWS = (10, 60, 300)


def _pressure(files: DataFrame) -> DataFrame:
    """`some` is waiting, `full` is stalled; averages are shares from 0 to 1 with a window label, total counts microseconds. The first bad line spoils its file."""
    files = _with_lines(files)
    files = files.withColumn("seen", F.transform("lines", lambda x: x["f"][0])).withColumn("r", F.substring_index("file", "/", -1))
    # of a repeated key the last counts
    of = lambda x, key: F.get(F.filter(F.reverse(F.slice(x["f"], 2, 4)), lambda t: t.startswith(key + "=")), F.lit(0))
    share = lambda x, w: _amount(F.substr(of(x, f"avg{w}"), F.lit(len(f"avg{w}=") + 1)))
    files = files.withColumn("lines", F.transform("lines", lambda x: F.struct(x["no"].alias("no"), x["f"].alias("f"), *[share(x, w).alias(f"s{w}") for w in WINDOWS], count_of(F.substr(of(x, "total"), F.lit(7))).alias("total"))))

    def fault(x: Column, i: Column) -> Column:
        bad = F.when((F.size(x["f"]) != 5) | ~x["f"][0].isin("some", "full"), "no pressure line").when(F.array_position("seen", x["f"][0]) < i + 1, F.concat(F.lit("repeated "), x["f"][0]))
        bad = bad.when(F.exists(F.slice(x["f"], 2, 4), lambda t: ~t.contains("=")), "no key and value")
        for w in WINDOWS:
            bad = bad.when(x[f"s{w}"].isNull() | (x[f"s{w}"] > 100), f"avg{w} is no percentage")
        return bad.when(x["total"].isNull(), "total is no count")

    files = files.withColumn("lines", F.transform("lines", lambda x, i: x.withField("bad", fault(x, i))))

    def entries(x: Column) -> Column:
        base = F.concat(F.lit("node_pressure_"), F.col("r"), F.when(x["f"][0] == "some", "_waiting").otherwise("_stalled"))
        points = [_entry(F.concat(base, F.lit("_microseconds_total")), F.expr(_NONE), "sum", x["total"]), *[_entry(F.concat(base, F.lit("_ratio")), _labels(window=F.lit(f"{w}s")), "gauge", broken=x[f"s{w}"] / 100) for w in WINDOWS]]
        return F.when(x["bad"].isNotNull(), F.array(_error(_no(x, x["bad"])))).otherwise(F.array(*points))

    files = files.withColumn("entries", F.flatten(F.transform("lines", entries)))
    wrong = F.filter("entries", lambda e: e["detail"].isNotNull())
    return files.withColumn("entries", F.when(F.size(wrong) > 0, F.slice(wrong, 1, 1)).otherwise(F.col("entries")))


#: fixed values: file systems that are no local device; types that begin with `fuse.` are none either
PSEUDO = frozenset("autofs binfmt_misc bpf cgroup cgroup2 configfs debugfs devpts devtmpfs efivarfs fuse fuseblk fusectl hugetlbfs mqueue nsfs proc pstore ramfs securityfs sysfs tracefs 9p afs ceph cifs glusterfs lustre nfs nfs4 smb3".split())


def _mount_lines(snapshots: DataFrame) -> DataFrame:
    """mounts: the readable records of a file; details: what is wrong with the others."""
    files = _files(snapshots, "mountinfo").withColumn("lines", F.filter(F.transform(F.split("content", "\n"), lambda x, i: F.struct((i + 1).alias("no"), x.alias("text"))), lambda x: x["text"] != ""))
    left = lambda x: _words(F.substring_index(x["text"], " - ", 1))
    right = lambda x: _words(F.substr(x["text"], F.instr(x["text"], " - ") + 3))
    files = files.withColumn("lines", F.transform("lines", lambda x: F.struct(x["no"].alias("no"), F.when(x["text"].contains(" - "), left(x)).alias("f"), right(x).alias("g"))))
    # an escape is a backslash and three octal digits, none of them of the value 0
    sound = lambda t: ~F.regexp_replace(t, r"\\[0-3][0-7]{2}", "").contains("\\") & ~t.contains(r"\000") & ~t.contains("\x00") & (F.octet_length(t) <= 4096)
    path = lambda t: F.regexp_replace(F.regexp_replace(L.decode_octal_escapes(t), r"(/\.)*/+(\./+)*", "/"), r"(?<=.)/\.?$", "")
    shape = lambda x: F.when(x["f"].isNull(), "no separator").when((F.size(x["f"]) < 6) | (F.size(x["g"]) < 3), "too few fields").when(count_of(x["f"][0]).isNull(), "no mount id").when(~sound(x["f"][4]) | ~x["f"][4].startswith("/"), "no absolute path").when(~sound(x["g"][0]) | ~sound(x["g"][1]), "bad escape")
    record = lambda x: F.struct(count_of(x["f"][0]).alias("mount_id"), path(x["f"][4]).alias("mountpoint"), L.decode_octal_escapes(x["g"][0]).alias("fstype"), L.decode_octal_escapes(x["g"][1]).alias("device"), F.array_contains(F.split(x["f"][5], ","), "ro").alias("read_only"))
    files = files.withColumn("lines", F.transform("lines", lambda x: x.withField("bad", shape(x))))
    good, bad = F.filter("lines", lambda x: x["bad"].isNull()), F.filter("lines", lambda x: x["bad"].isNotNull())
    return files.select(*_FILE, F.transform(good, record).alias("mounts"), F.transform(bad, lambda x: _no(x, x["bad"])).alias("details"))


def _local(mounts: DataFrame) -> DataFrame:
    rows = mounts.select("host", "captured_at_unix_nano", F.explode_outer("mounts").alias("m")).where("m IS NOT NULL").select("host", "captured_at_unix_nano", "m.*")
    best = rows.groupBy("host", "captured_at_unix_nano", "mountpoint").agg(F.max_by(F.struct("mount_id", "device", "fstype", "read_only"), "mount_id").alias("m"))
    out = best.select("host", "captured_at_unix_nano", "mountpoint", "m.*")
    return out.where(~F.col("fstype").isin(*sorted(PSEUDO)) & ~F.col("fstype").startswith("fuse."))


def mounts(snapshots: DataFrame) -> DataFrame:
    """One row per host and mount point: device, fstype, read_only. Of several mounts at a point the highest mount id counts."""
    return _local(_mount_lines(snapshots))


def _mounts(files: DataFrame) -> DataFrame:
    """Only what is wrong with the records; their points come from `filesystem`."""
    out = _mount_lines(files)
    none = F.when((F.size("mounts") == 0) & (F.size("details") == 0), F.array(F.lit("no mounts"))).otherwise(F.col("details"))
    return out.select(*_FILE, F.transform(none, lambda d: _error(d)).alias("entries"))


def filesystem(snapshots: DataFrame, statfs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Points of local file systems, and errors (host, mountpoint, captured_at_unix_nano, detail).

    statfs: host, captured_at_unix_nano, mountpoint, block_size, blocks, blocks_free, blocks_available, files, files_free,
    read_only. A mount without a row there, or with sizes that are none or pass 2^63-1, gives node_filesystem_device_error 1 only.
    """
    found = mounts(snapshots).join(statfs.withColumnRenamed("read_only", "flag").withColumn("there", F.lit(True)), ["host", "captured_at_unix_nano", "mountpoint"], "left")
    size = F.col("block_size").cast("bigint")
    bytes_of = {c: F.when((size > 0) & (F.col(c) >= 0), F.try_multiply(F.col(c).cast("bigint"), size)) for c in ("blocks", "blocks_free", "blocks_available")}
    sized = F.col("files").isNotNull() & (F.col("files") >= 0) & (F.col("files_free") >= 0)
    for v in bytes_of.values():
        sized = sized & v.isNotNull()
    good = F.coalesce(F.col("there") & sized, F.lit(False))
    # written out once: each row has its entries and, if bad, what is wrong
    labels = _labels(device=F.col("device"), fstype=F.col("fstype"), mountpoint=F.col("mountpoint"))
    when = lambda v: F.when(good, v)
    entries = [
        _entry("node_filesystem_size_bytes", labels, "gauge", when(bytes_of["blocks"])), _entry("node_filesystem_free_bytes", labels, "gauge", when(bytes_of["blocks_free"])), _entry("node_filesystem_avail_bytes", labels, "gauge", when(bytes_of["blocks_available"])),
        _entry("node_filesystem_files", labels, "gauge", when(F.col("files"))), _entry("node_filesystem_files_free", labels, "gauge", when(F.col("files_free"))),
        _entry("node_filesystem_readonly", labels, "gauge", when((F.col("read_only") | F.coalesce("flag", F.lit(False))).cast("int"))), _entry("node_filesystem_device_error", labels, "gauge", F.when(good, 0).otherwise(1)),
    ]
    rows = found.select("host", "captured_at_unix_nano", "mountpoint", F.filter(F.array(*entries), lambda e: e["int_value"].isNotNull()).alias("points"), F.when(F.col("there").isNull(), "no sizes").when(~good, "sizes are none or too large").alias("detail"))
    return points(rows), rows.where("detail IS NOT NULL").select("host", "mountpoint", "captured_at_unix_nano", "detail")


#: job: its files, its parser, and whether a file without any point and error is an error
JOBS = {
    "load": (("loadavg",), _load, True),
    "memory": (("meminfo",), _memory, True),
    "cpu": (("stat",), _cpu, True),
    "network": (("net/dev",), _network, True),
    "socket": (("net/sockstat", "net/sockstat6", "net/snmp"), lambda files: _socket(files.where("file <> 'net/snmp'")).select(*_FILE, "entries").unionByName(_netstat(files.where("file = 'net/snmp'")).select(*_FILE, "entries")), True),
    "disk": (("diskstats",), _disk, True),
    "mounts": (("mountinfo",), _mounts, False),
    "cgroup": (("cgroup.controllers", "cpu.stat", "cpu.max", "memory.events", "io.stat", *CGROUP_VALUES, *CGROUP_LIMITS), _cgroup, True),
    "uptime": (("uptime",), _uptime, True),
    "pressure": (("pressure/cpu", "pressure/memory", "pressure/io"), _pressure, True),
}


def _files(snapshots: DataFrame, *names: str) -> DataFrame:
    return snapshots.where(F.col("file").isin(*names)).select("host", "file", "captured_at_unix_nano", F.coalesce("content", F.lit("")).alias("content"))


def parse(snapshots: DataFrame, *jobs: str) -> DataFrame:
    """Rows of host, file, captured_at_unix_nano, job, points, n_errors and details (at most 16), one per file of the jobs (default: all).

    A file is read once and stays where it is: no shuffle, and nothing of a file is in two rows. A null content is an empty file.
    """
    out = None
    for job in jobs or JOBS:
        names, run, complains = JOBS[job]
        rows = run(_files(snapshots, *names)).withColumn("job", F.lit(job))
        good = F.filter("entries", lambda e: e["name"].isNotNull() & (e["int_value"].isNotNull() | e["float_value"].isNotNull()))
        bad = F.transform(F.filter("entries", lambda e: e["detail"].isNotNull()), lambda e: e["detail"])
        rows = rows.select(*_FILE, "job", good.alias("points"), bad.alias("details"))
        # an empty io.stat is in order
        empty = (F.size("points") == 0) & (F.size("details") == 0) & F.lit(complains) & (F.col("file") != "io.stat")
        rows = rows.withColumn("details", F.when(empty, F.array(F.lit("nothing that is supported"))).otherwise(F.col("details")))
        rows = rows.withColumn("n_errors", F.size("details")).withColumn("details", F.slice("details", 1, MOST_DETAILS))
        out = rows if out is None else out.unionByName(rows)
    return out


def points(parsed: DataFrame) -> DataFrame:
    # outer, here and below: Spark would ask first whether an inner explode's array is empty, and parse each file again for that
    out = parsed.select("host", F.col("captured_at_unix_nano").alias("time_unix_nano"), F.explode_outer("points").alias("p")).where("p IS NOT NULL").select("host", "p.*", "time_unix_nano")
    return out.withColumn("value", F.coalesce(F.col("int_value").cast("double"), "float_value")).select(*_POINT)


def errors(parsed: DataFrame) -> DataFrame:
    """host, file, captured_at_unix_nano, job, n_errors, details: files of which something could not be read."""
    rows = parsed.select(*_FILE, "job", F.explode_outer(F.array(F.struct("n_errors", "details"))).alias("e"))
    return rows.where("e.n_errors > 0").select(*_FILE, "job", "e.n_errors", "e.details")


def tagged(parsed: DataFrame) -> DataFrame:
    """Both outputs as rows, for one write by tag: `point` rows, and one `error` row for each file with errors."""
    rows = parsed.select(*_FILE, "job", F.explode_outer(F.concat(
        F.transform("points", lambda p: F.struct(F.lit("point").alias("tag"), p.alias("point"), F.lit(None).cast("int").alias("n_errors"), F.lit(None).cast("array<string>").alias("details"))),
        F.when(F.col("n_errors") > 0, F.array(F.struct(F.lit("error").alias("tag"), F.get("points", F.lit(-1)).alias("point"), F.col("n_errors"), F.col("details")))).otherwise(F.expr("array()")),
    )).alias("x")).where("x IS NOT NULL")
    return rows.select("x.tag", *_FILE, "job", "x.point.name", "x.point.attrs", "x.point.metric_type", "x.point.int_value", "x.point.float_value", "x.n_errors", "x.details")


def _job(name: str, *files: str) -> Callable[[DataFrame], DataFrame]:
    def run(snapshots: DataFrame) -> DataFrame:
        return points(parse(snapshots.where(F.col("file").isin(*files)) if files else snapshots, name))

    run.__doc__ = JOBS[name][1].__doc__
    return run


load, memory, cpu, network, disk, cgroup, uptime, pressure = (_job(name) for name in ("load", "memory", "cpu", "network", "disk", "cgroup", "uptime", "pressure"))
socket, netstat = _job("socket", "net/sockstat", "net/sockstat6"), _job("socket", "net/snmp")


def uname_info(hosts: DataFrame) -> DataFrame:
    """(host, captured_at_unix_nano, sysname, release, version, machine, nodename, domainname) -> a gauge of 1 with six labels."""
    names = ("sysname", "release", "version", "machine", "nodename", "domainname")
    return points(hosts.select("host", "captured_at_unix_nano", F.array(_entry("node_uname_info", _labels(**{n: F.coalesce(n, F.lit("")) for n in names}), "gauge", F.lit(1))).alias("points")))


#: fixed values: keys of os-release that are read, and the attributes that they become
RELEASE = {"NAME": "os.name", "VERSION_ID": "os.version", "PRETTY_NAME": "os.description"}
_HOSTNAME_BYTES, _VALUE_BYTES = 255, 4096


def _release(content: Column) -> Column:
    """key, value and detail of each line; a line without a key spoils its file, and so does a value with bad quotes."""
    lines = F.filter(F.transform(F.split(content, "\n"), lambda x, i: F.struct((i + 1).alias("no"), F.trim(x).alias("text"))), lambda x: (x["text"] != "") & ~x["text"].startswith("#"))

    def line(x: Column) -> Column:
        key, raw = F.regexp_extract(x["text"], r"\A([A-Z0-9_]+)=", 1), F.substr(x["text"], F.instr(x["text"], "=") + 1)
        double, single, bare = r"(?s)\A\"((?:[^\\]|\\[\"$'\\`])*)\"\z", r"(?s)\A'(.*)'\z", r"\A[^ \t\"'\\]*\z"
        good = (F.octet_length(raw) <= _VALUE_BYTES) & ~raw.contains("\x00") & F.when(raw.startswith('"'), raw.rlike(double)).when(raw.startswith("'"), raw.rlike(single)).otherwise(raw.rlike(bare))
        value = F.when(raw.startswith('"'), F.regexp_replace(F.regexp_extract(raw, double, 1), r"\\(.)", "$1")).when(raw.startswith("'"), F.regexp_extract(raw, single, 1)).otherwise(raw)
        wanted = key.isin(*RELEASE)
        bad = F.when(key == "", "no key").when(wanted & ~good, F.concat(F.lit("bad value of "), key))
        return F.struct(F.when(wanted & bad.isNull(), key).alias("key"), value.alias("value"), F.when(bad.isNotNull(), _no(x, bad)).alias("detail"))

    return F.transform(lines, line)


def host_identity(snapshots: DataFrame) -> DataFrame:
    """Files os-release, hostname and machine-id -> host, file, captured_at_unix_nano, detected (map of attributes), detail.

    detail says why a file gives nothing: a malformed line, a name with blanks or over 255 bytes, an id that is not 32 lower-case
    hexadecimal digits. Of a key that repeats the last value counts.
    """
    files = _files(snapshots, "os-release", "hostname", "machine-id").withColumn("r", F.when(F.col("file") == "os-release", _release(F.col("content"))))
    faults = F.filter("r", lambda x: x["detail"].isNotNull())
    found = F.filter("r", lambda x: x["key"].isNotNull())
    of = lambda k: F.get(F.filter(F.reverse(found), lambda x: x["key"] == k), F.lit(0))["value"]
    entries = F.filter(F.array(*[F.struct(F.lit(name).alias("k"), of(k).alias("v")) for k, name in RELEASE.items()]), lambda e: e["v"].isNotNull())
    text = F.regexp_replace("content", r"\A\s+|\s+\z", "")
    is_name, is_id = F.col("file") == "hostname", F.col("file") == "machine-id"
    good_name = (text != "") & (F.octet_length(text) <= _HOSTNAME_BYTES) & ~text.rlike(r"[\s\x00\u0085\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]")
    detail = F.when(is_name, F.when(~good_name, "no host name")).when(is_id, F.when(~text.rlike(r"\A[0-9a-f]{32}\z"), "no machine id")).otherwise(F.coalesce(F.get(faults, F.lit(0))["detail"], F.when(F.size(found) == 0, "nothing that is supported")))
    values = F.when(is_name, _labels(**{"host.name": text})).when(is_id, _labels(**{"host.id": text})).otherwise(F.map_from_entries(entries))
    return files.select(*_FILE, values.alias("detected"), detail.alias("detail")).withColumn("detected", F.when(F.col("detail").isNull(), F.col("detected")))


def _latest(identity: DataFrame, *keys: str) -> DataFrame:
    """d: the attributes of the latest readable file. Files are not filtered before: each would be parsed once more for that."""
    good = F.col("detail").isNull()
    rows = identity.groupBy(*keys).agg(F.max_by("detected", F.when(good, F.col("captured_at_unix_nano"))).alias("d"), F.count(F.when(good, 1)).alias("n"))
    return rows.where("n > 0").select(*keys, "d")


def os_release(snapshots: DataFrame) -> DataFrame:
    """host -> os_name, os_version, os_description from the latest readable os-release."""
    rows = _latest(host_identity(snapshots.where("file = 'os-release'")), "host")
    return rows.select("host", *[F.col("d")[name].alias(name.replace(".", "_")) for name in RELEASE.values()])


def detected_attributes(identity: DataFrame) -> DataFrame:
    """Rows of host_identity -> host, detected: one map of its files, the latest of each; what targets.fill_missing_attributes takes."""
    latest = _latest(identity, "host", "file")
    return latest.groupBy("host").agg(F.map_from_entries(F.flatten(F.collect_list(F.map_entries("d")))).alias("detected"))


def transitions(results: DataFrame) -> DataFrame:
    """(host, collector, at, status) -> the rows where the status changed, with the one before."""
    w = Window.partitionBy("host", "collector").orderBy("at")
    rows = results.withColumn("before", F.lag("status").over(w))
    return rows.where(~F.col("status").eqNullSafe(F.col("before")))


snapshot_health = transitions


def collector_status(snapshots: DataFrame, *jobs: str) -> DataFrame:
    """host, collector, at, status, for every capture of a host and every job, whether its files are there or not.

    unsupported: none of a job's files was captured (for cgroup: cgroup.controllers was not); error: one of them had errors; else ok.
    """
    jobs = jobs or tuple(JOBS)
    read = parse(snapshots, *jobs).select("host", "captured_at_unix_nano", "job", "file", (F.col("n_errors") > 0).alias("bad"))
    every = snapshots.select("host", "captured_at_unix_nano", F.lit(None).cast("string").alias("job"), F.lit(None).cast("string").alias("file"), F.lit(None).cast("boolean").alias("bad"))
    # captures without a job's files are made from what the capture has: no host, capture or job is lost
    seen = [F.max(F.when((F.col("job") == j) & ((F.col("file") == "cgroup.controllers") if j == "cgroup" else F.lit(True)), True)).alias(f"s_{j}") for j in jobs]
    bad = [F.max(F.when(F.col("job") == j, F.col("bad"))).alias(f"b_{j}") for j in jobs]
    grid = read.unionByName(every).groupBy("host", "captured_at_unix_nano").agg(*seen, *bad)
    status = lambda j: F.when(F.col(f"s_{j}").isNull(), "unsupported").when(F.col(f"b_{j}"), "error").otherwise("ok")
    rows = grid.select("host", F.col("captured_at_unix_nano").alias("at"), F.explode(F.array(*[F.struct(F.lit(j).alias("collector"), status(j).alias("status")) for j in jobs])).alias("x"))
    return rows.select("host", "x.collector", "at", "x.status")
