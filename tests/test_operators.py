"""Literal cases of single operators."""

import pytest
from pyspark.sql import functions as F

from siftline.functions import labels as L
from siftline.functions import patterns as P
from siftline.operators import delivery, exposition, hosts, logs, metrics, targets, traces
from siftline.operators.metrics import Rule
from siftline.sources import readers


@pytest.mark.parametrize(
    ("points", "expected"),
    [
        ([(100, 1), (150, 2), (20, 3), (30, 4), (15, 5)], [100, 150, 170, 180, 195]),
        ([(1000, 200), (990, 100), (1100, 300), (5, 400)], [1000, 1100, 1105]),
        ([(900, 100), (10, 300), (1000, 200), (20, 400)], [900, 910, 920]),
    ],
)
def test_resets(spark, points, expected):
    df = spark.createDataFrame([("a", i, v, t) for i, (v, t) in enumerate(points)], "s string, seq long, v long, t long")
    out = metrics.normalize_resets(df, ["s"], "v", "t", ["seq"]).orderBy("seq")
    assert [r["v"] for r in out.collect()] == expected


def test_resets_tracker_cap(spark):
    df = spark.createDataFrame([("a", 0, 100), ("b", 1, 100), ("c", 2, 42), ("a", 3, 200), ("a", 4, 5), ("c", 5, 1)], "s string, seq long, v long")
    out = metrics.normalize_resets(df, ["s"], "v", "seq", ["seq"], max_series=2).orderBy("seq")
    assert [r["v"] for r in out.collect()] == [100, 100, 42, 200, 205, 1]


def test_resets_gauge_unchanged(spark):
    df = spark.createDataFrame([("a", 0, 50), ("a", 1, 10)], "s string, seq long, v long")
    out = metrics.normalize_resets(df, ["s"], "v", "seq", ["seq"], applies=F.lit(False))
    assert sorted(r["v"] for r in out.collect()) == [10, 50]


def test_cardinality(spark):
    df = spark.createDataFrame([("a", "1", 0), ("a", "2", 1), ("a", "3", 2), ("b", "1", 3), ("b", "2", 4), ("a", "1", 5)], "t string, s string, arrival_seq long")
    assert metrics.limit_cardinality(df, "t", "s", 2).count() == 5
    assert metrics.limit_cardinality(df, "t", "s", 0).count() == 6
    # the third series comes when the tracker is full: it passes
    ids = spark.createDataFrame([("a", "1", 0), ("a", "2", 1), ("a", "3", 2), ("a", "1", 3)], "t string, s string, arrival_seq long")
    assert metrics.limit_cardinality(ids, "t", "s", 100, max_tracked=2).count() == 4


def series(spark, *items):
    return spark.createDataFrame([(n, {"job": "j"}, a) for n, a in items], "name string, resource map<string,string>, attrs map<string,string>")


def test_relabel(spark, rows):
    two = series(spark, ("go_gc_duration", {}), ("http_requests_total", {"code": "200"}))
    assert rows(metrics.relabel(two, Rule("drop", ("__name__",), regex="go_.*")), "name") == [("http_requests_total",)]
    envs = series(spark, ("a", {"env": "prod"}), ("b", {"env": "dev"}), ("c", {}))
    assert rows(metrics.relabel(envs, Rule("keep", ("env",), regex="prod")), "name") == [("a",)]
    chain = [Rule(source_labels=("code",), target_label="status"), Rule(source_labels=("__name__",), regex="http_(.*)", target_label="__name__", replacement="x_$1")]
    out = metrics.relabel_chain(two, chain).where("name LIKE 'x%'").collect()[0]
    assert (out["name"], out["attrs"]) == ("x_requests_total", {"code": "200", "status": "200"})
    gone = metrics.relabel(series(spark, ("a", {"drop_me": "x"})), Rule(source_labels=("drop_me",), target_label="drop_me", replacement="$2"))
    assert gone.collect()[0]["attrs"] == {}
    kept = metrics.relabel(series(spark, ("a", {"keep_a": "1", "drop_b": "2", "keep_c": "3"})), Rule("labelkeep", regex="keep_.*"))
    assert sorted(kept.collect()[0]["attrs"]) == ["keep_a", "keep_c"]
    with pytest.raises(ValueError):
        Rule(regex="(")
    with pytest.raises(ValueError):
        Rule("frobnicate")


def test_templates():
    assert P.template_parts("a$1x-${1}x$$") == ["a", ("name", "1x"), "-", 1, "x", "$"]
    with pytest.raises(ValueError):
        P.java_pattern("a(?=b)")


def test_final_newline_does_not_match(spark, rows):
    df = series(spark, ("a", {"k": "v\n"}), ("b", {"k": "v"}))
    assert rows(metrics.relabel(df, Rule("keep", ("k",), regex="v")), "name") == [("b",)]


BODY = """# TYPE http_requests_total counter
http_requests_total{method="post",code="200"} 1027
http_requests_total{method="post",code="400"} 3
# TYPE temperature_celsius gauge
temperature_celsius 23.5
go_goroutines\t42
edge{path="/a}b",code="200"} 5
# TYPE rpc_duration_seconds summary
rpc_duration_seconds{quantile="0.5"} 0.012
rpc_duration_seconds_count 2693
rpc_duration_seconds_sum 17.6
# TYPE lat histogram
lat_bucket{le="0.1"} 2
lat_bucket{le="0.5"} 5
lat_bucket{le="1"} 9
lat_bucket{le="+Inf"} 10
lat_sum 4.2
lat_count 10
nan_dropped{a="b"} NaN
inf_dropped +Inf
bad_number 1f
"""


def bodies(spark, text=BODY):
    return spark.createDataFrame([("s", 5, text)], "scrape_id string, scraped_at_unix_nano long, body string")


def test_exposition(spark):
    out = {(r["name"], r["attrs"].get("code")): r for r in exposition.parse_exposition(bodies(spark)).collect()}
    assert out["http_requests_total", "200"]["int_value"] == 1027 and out["http_requests_total", "200"]["monotonic"]
    assert out["temperature_celsius", None]["float_value"] == 23.5 and not out["temperature_celsius", None]["monotonic"]
    assert out["go_goroutines", None]["int_value"] == 42
    assert out["edge", "200"]["attrs"]["path"] == "/a}b"
    assert not out["rpc_duration_seconds", None]["monotonic"]
    assert out["rpc_duration_seconds_count", None]["monotonic"] and out["rpc_duration_seconds_sum", None]["monotonic"]
    assert not {n for n, _ in out} & {"nan_dropped", "inf_dropped", "bad_number", "lat_bucket", "lat_sum", "lat_count"}


def test_histogram(spark):
    rows = exposition.histogram_buckets(bodies(spark))
    h = exposition.classic_to_exp_histogram(rows, ["scrape_id", "family", "labels_key"]).collect()
    assert len(h) == 1 and h[0]["zero_count"] == 0 and sum(h[0]["positive_counts"]) == 10
    assert rows.agg(F.max("sum"), F.max("count")).collect()[0][:] == (4.2, 10)


@pytest.mark.parametrize(
    ("buckets", "scale", "zero", "total"),
    [([(0.1, 0), (float("inf"), 42)], 3, 0, 42), ([(0.5, 3), (2.0, 7), (float("inf"), 7)], 0, 0, 7), ([(0.5, 3), (2.0, 7), (float("inf"), 7)], 5, 0, 7), ([(0.0, 1), (1.0, 3), (float("inf"), 3)], 3, 1, 2)],
)
def test_histogram_conserves(spark, buckets, scale, zero, total):
    df = spark.createDataFrame([("k", i, b, c) for i, (b, c) in enumerate(buckets)], "k string, line_no int, le double, cumulative long")
    h = exposition.classic_to_exp_histogram(df, ["k"], scale).collect()[0]
    assert (h["zero_count"], sum(h["positive_counts"])) == (zero, total)


def test_bucket_index_of_powers_of_two(spark):
    df = spark.createDataFrame([(k, 2.0**k) for k in range(-40, 61)], "k int, v double")
    assert all(r["i"] == r["k"] * 8 - 1 for r in df.select("k", L.exp_bucket_index(F.col("v"), 3).alias("i")).collect())


def test_render_round_trip(spark):
    counters = spark.createDataFrame([("counter", "a_total", None, None, 3, 1), ("gauge", "g", None, None, 4, 2), ("counter", "v_total", "kind", 'x"y', 5, 3)], "kind string, name string, label string, label_value string, value long, seq int")
    body = exposition.render_exposition(counters).collect()[0]["body"]
    out = {(r["name"], r["attrs"].get("kind")): (r["int_value"], r["monotonic"]) for r in exposition.parse_exposition(bodies(spark, body)).collect()}
    assert out == {("a_total", None): (3, True), ("g", None): (4, False), ("v_total", 'x"y'): (5, True)}


def lines_of(spark, *texts, path="f"):
    at, out = 0, []
    for i, t in enumerate(texts):
        out.append((path, i, at, t))
        at += len(t) + 1
    return spark.createDataFrame(out, "path string, line_no long, offset long, line string")


def test_multiline(spark):
    df = lines_of(spark, "2026-07-18 first", "  stack one", "2026-07-18 second", "  stack two")
    held = logs.assemble_multiline(df, r"^\d{4}-\d{2}-\d{2} ").collect()
    assert [r["body"] for r in held] == ["2026-07-18 first\n  stack one"]
    ended = logs.assemble_multiline(df, r"^\d{4}-\d{2}-\d{2} ", at_end="timeout").orderBy("line_no").collect()
    assert [(r["body"], r["flush_reason"]) for r in ended][1] == ("2026-07-18 second\n  stack two", "timeout")


def cri(spark, *texts, **kw):
    return logs.assemble_cri(logs.parse_cri(lines_of(spark, *texts)), **kw).orderBy("line_no").collect()


def test_cri(spark):
    out = cri(spark, "2026-07-18T10:11:12.123456789Z stdout P hel", "2026-07-18T10:11:12.223456789Z stdout F lo", "2026-07-18T10:11:13Z stderr F failed")
    assert [(r["body"], r["stream"]) for r in out] == [("hello", "stdout"), ("failed", "stderr")]
    assert out[0]["time_unix_nano"] == 1784369472123456789 and out[0]["offset"] == 0
    out = cri(spark, "2026-07-18T10:11:12Z stdout P first", "2026-07-18T10:11:12Z stderr F second")
    assert [(r["partial"], r["sequence_error"]) for r in out] == [(True, True), (False, False)]
    assert cri(spark, "not a CRI record")[0]["parse_error"]
    assert cri(spark, "2026-07-18T10:11:12Z stdout P orphan") == []
    assert cri(spark, "2026-07-18T10:11:12Z stdout P orphan", at_end="rotation")[0]["partial"]


def test_cri_oversized_drops_to_the_next_end(spark):
    t = "2026-07-18T10:11:12Z"
    out = cri(spark, f"{t} stdout P aaaa", f"{t} stdout P bbbbbbb", f"{t} stderr P x", f"{t} stdout F y", f"{t} stdout F ok", max_bytes=8)
    assert [r["body"] for r in out] == ["ok"]


def test_redaction(spark):
    df = spark.createDataFrame([("auth=Bearer abc.def card=4111111111111111",), ("secret",)], "body string")
    out = logs.redact(df, [r"Bearer [a-z.]+", r"\b[0-9]{16}\b"]).collect()
    assert (out[0]["body"], out[0]["redactions"]) == ("auth=[REDACTED] [REDACTED]".replace(" [", " card=["), 2)
    assert logs.redact(df, ["secret"], "$1").collect()[1]["body"] == "$1"
    grow = spark.createDataFrame([("aaaa",)], "body string")
    assert logs.redact(grow, ["a"], "1234", limit=8).count() == 0
    with pytest.raises(ValueError):
        logs.redact(df, ["a*"])


@pytest.mark.parametrize(
    ("text", "pattern", "fmt", "expected"),
    [
        ("2026-07-18T10:11:12.123456789Z message", r"^(\S+)", "rfc3339nano", 1784369472123456789), ("10 message", r"^(\S+)", "unix", 10**10), ("10 message", r"^(\S+)", "unix_ms", 10**7), ("10 message", r"^(\S+)", "unix_ns", 10),
        ("message", r"^([0-9]+)", "unix", 0), ("18446744073709551615 m", r"^(\S+)", "unix", 0),
    ],
)
def test_timestamps(spark, text, pattern, fmt, expected):
    df = spark.createDataFrame([(text,)], "body string")
    assert logs.extract_timestamp(df, pattern, fmt).collect()[0]["time_unix_nano"] == expected


def test_pod_path(spark):
    good = "/r/payments_checkout-7c8d9_275ecb36-5aa8-4c2a-9c47-d8bb681b9aff/api/3.log"
    paths = [good, good.replace("3.log", "0.log.20260718-101112"), "/r/a/b.log", "/r/A_b_c/api/1.log", "/r/a_b_c/api/x.log", "/q/a_b_c/api/1.log"]
    df = spark.createDataFrame([(p, None) for p in paths], "path string, resource map<string,string>")
    assert [r["identity_found"] for r in logs.pod_identity(df, "/r").collect()] == [True, True, False, False, False, False]


def test_pods_and_dns(spark):
    pods = spark.createDataFrame(
        [("n", "p1", "node", "Running", "10.0.0.1", {"a/b": "c"}, {"prometheus.io/scrape": "true", "prometheus.io/port": "9100", "prometheus.io/path": "m"}), ("n", "p2", "node", "Running", "10.0.0.2", {}, {"prometheus.io/scrape": "true"}), ("n", "p3", "node", "Pending", "10.0.0.3", {}, {"prometheus.io/scrape": "true"})],
        "namespace string, pod_name string, node_name string, phase string, pod_ip string, labels map<string,string>, annotations map<string,string>",
    )
    out = sorted(r["url"] for r in targets.targets_from_pods(pods, default_port=8080).collect())
    assert out == ["http://10.0.0.1:9100/m", "http://10.0.0.2:8080/metrics"]


def span(spark, *rows):
    schema = "request_id long, span_idx long, trace_id binary, span_id binary, parent_span_id binary, trace_state string, name string, start_unix_nano long, end_unix_nano long, links array<struct<trace_id:binary,span_id:binary,trace_state:string>>, resource_attrs array<struct<key:string,value:string>>, size_bytes long"
    return spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], schema)


T = bytes([0x11] * 16)


def one(span_id, parent=None, name="n", start=100, end=200, trace=T, links=(), state="", size=10):
    return (bytearray(trace), bytearray(span_id), bytearray(parent) if parent else None, state, name, start, end, list(links), [("service.name", "checkout")], size)


def s(k):
    return bytes([k] * 8)


def report(spark, *rows):
    return traces.validation_report(traces.validate_spans(span(spark, *rows))).collect()[0].asDict()


def test_span_validation(spark):
    good = report(spark, one(s(2), name="POST /checkout"))
    assert good["invalid_spans"] == 0
    bad = report(spark, one(b"", b"\0", "", 0, 0, b"", [(None, None, "")], "==="))
    assert bad["invalid_spans"] == 1 and all(bad[k] == 1 for k in traces.REASONS[:7])
    cycle = report(spark, one(s(1), s(2)), one(s(2), s(1)), one(s(3), s(1)), one(s(4), s(9)))
    assert (cycle["parent_cycle"], cycle["invalid_spans"]) == (2, 2)
    twice = report(spark, one(s(1), s(1)), one(s(1), s(1)))
    assert (twice["duplicate_span"], twice["invalid_spans"], twice["parent_cycle"]) == (1, 2, 0)
    long = report(spark, *[one(s(k), s(k % 9 + 1)) for k in range(1, 10)], *[one(s(k), s(k - 1)) for k in range(10, 20)])
    assert long["parent_cycle"] == 9


def test_enrichment(spark):
    df = span(spark, one(s(1)))
    value = lambda d, p: [tuple(a) for a in traces.enrich_resource(df, d, p).collect()[0]["resource_attrs"]]
    assert value({"service.name": "x", "zone": "z"}, "preserve") == [("service.name", "checkout"), ("zone", "z")]
    assert value({"service.name": "x"}, "replace") == [("service.name", "x")]
    assert traces.enrich_resource(df, {"service.name": "x"}, "reject").count() == 0
    assert traces.enrich_resource(df, {"service.name": "checkout"}, "reject").count() == 1


def fnv(seed, data):
    h = 2166136261
    for b in seed.to_bytes(4, "little") + data:
        h = ((h ^ b) * 16777619) & 0xFFFFFFFF
    return h


def test_sampling(spark):
    ids = spark.range(1, 65537).select("id", F.unhex(F.lpad(F.hex("id"), 32, "0")).alias("trace_id"))
    ten, fifty = ({r["id"] for r in traces.sample_traces(ids, p, 73).collect()} for p in (10.0, 50.0))
    assert ten < fifty and 6000 <= len(ten) <= 7100 and 32000 <= len(fifty) <= 33500
    assert ten == {k for k in range(1, 65537) if fnv(73, k.to_bytes(16, "big")) & 0x3FFF < 1638}
    with pytest.raises(ValueError):
        traces.sampling_threshold(0.001)


def test_packing(spark):
    rows = [one(s(k), trace=bytes([t] * 16), size=10) for t in (1, 2, 3) for k in (1, 2)]
    packed = traces.pack_traces(span(spark, *rows), 20).collect()
    assert {(bytes(r["trace_id"])[0], r["chunk"]) for r in packed} == {(1, 0), (2, 1), (3, 2)}
    assert {r["chunk"] for r in traces.pack_traces(span(spark, *rows), 60).collect()} == {0}
    assert {r["chunk"] for r in traces.pack_traces(span(spark, *rows), 15).collect()} == {-1}


def test_label_keys(spark):
    df = spark.createDataFrame([({"a": "1", "b": "2"}, {"b": "2", "a": "1"}, {"a": "b", "c": "d"}, {"a": "b\0c=d"})], "w map<string,string>, x map<string,string>, y map<string,string>, z map<string,string>")
    w, x, y, z = df.select(*[L.key_of(F.col(c)) for c in "wxyz"]).collect()[0]
    assert w == x and y != z


@pytest.fixture
def envelopes(spark):
    """One kind holds most rows, one has no name; many rows share a time, one lies far off, some have none."""
    import random

    rng = random.Random(5)
    items = [(i, rng.choice(["a"] * 6 + ["b", "c", None]), rng.randint(1, 30), rng.choice([None, *range(50)])) for i in range(400)]
    items.append((400, "a", 7, 10**15))
    return items, spark.createDataFrame(items, "id long, kind string, bytes long, captured_at long")


def _age(item):
    """Order by time and id, rows without a time first."""
    return (item[3] is not None, item[3] or 0, item[0])


def _run(items, cap):
    out = []
    for item in sorted(items, key=_age, reverse=True):
        cap -= item[2]
        if cap < 0:
            break
        out.append(item)
    return out


def test_retention_is_the_longest_newest_run(envelopes):
    items, df = envelopes
    for total, caps in ((1000, None), (3000, {"a": 900, "b": 100}), (0, None), (10**6, None)):
        left = items
        if caps:
            left = [i for k in {i[1] for i in items} for i in _run([j for j in items if j[1] == k], caps.get(k, 10**9))]
        expected = {i[0] for i in _run(left, total)}
        assert {r["id"] for r in delivery.retain_newest(df, total, caps).collect()} == expected
    assert delivery.retain_newest(df.limit(0), 1000, {"a": 5}).collect() == []


@pytest.mark.parametrize("slots", [1, 5, 128])
def test_turns_over_slots(envelopes, slots):
    items, df = envelopes
    for failed in (None, lambda i: i[2] == 30):
        queues = {}
        for i in sorted(items, key=_age):
            queue = queues.setdefault(i[1], [])
            if not (failed and queue and failed(queue[-1])):
                queue.append(i)
        order = sorted((turn, kind is not None, kind or "", i[0]) for kind, queue in queues.items() for turn, i in enumerate(queue, 1))
        expected = [(x[3], x[0], place) for place, x in enumerate(order, 1)]
        out = delivery.fair_interleave(df, F.col("bytes") == 30 if failed else None, slots=slots, block=16)
        assert [tuple(r) for r in out.select("id", "turn", "position").orderBy("position").collect()] == expected
        assert set(out.columns) == {*df.columns, "turn", "position"}


@pytest.mark.parametrize("slots", [1, 5, 128])
def test_pressure_over_slots(spark, slots):
    import random

    rng = random.Random(6)
    depth = [(rng.choice(["a"] * 6 + ["b", None]), t, rng.choice([None, *range(0, 100, 5)])) for t in [*range(300), 10**15]]
    points = [(rng.choice(["a", "a", "b", "c", None]), rng.randint(-5, 320)) for _ in range(200)]
    on, flags, history = {}, [], []
    for kind, at, n in depth:
        if n is not None and (n >= 80 or n <= 50):
            on[kind] = n >= 80
        flags.append((kind, at, n, on.get(kind, False)))
        history.append((at, kind, on.get(kind, False)))
    df = spark.createDataFrame(depth, "kind string, at long, bytes long")
    got = delivery.pressure_flag(df, 100, slots=slots)
    assert [tuple(r) for r in got.orderBy("at").collect()] == flags
    shed = delivery.shed(spark.createDataFrame(points, "kind string, at long"), got.select("kind", "at", "pressure"), slots=slots)
    expected = [(k, t, next((x[2] for x in reversed(history) if x[1] == k and x[0] <= t), False)) for k, t in points]
    key = lambda r: (str(r[0]), r[1])
    assert sorted((tuple(r) for r in shed.collect()), key=key) == sorted(expected, key=key)


def snapshot(spark, file, content):
    return spark.createDataFrame([("h", file, 10**9, content)], "host string, file string, captured_at_unix_nano long, content string")


def values(df):
    return {(r["name"], *sorted(r["attrs"].values())): r["value"] for r in df.collect()}


def test_host_files(spark):
    assert values(hosts.load(snapshot(spark, "loadavg", "1.25 2.50 3.75 1/1 1\n")))[("node_load1",)] == 1.25
    assert values(hosts.memory(snapshot(spark, "meminfo", "MemTotal:  1024 kB\nX: 1 kB")))[("node_memory_MemTotal_bytes",)] == 1048576
    assert values(hosts.cpu(snapshot(spark, "stat", "cpu 1 1\ncpu0 100 2 30 400 5 6 7 8")))[("node_cpu_milliseconds_total", "0", "user")] == 1000
    net = values(hosts.network(snapshot(spark, "net/dev", " eth0: 123 1 0 0 0 0 0 0 456 1 0")))
    assert (net[("node_network_receive_bytes_total", "eth0")], net[("node_network_transmit_bytes_total", "eth0")]) == (123, 456)
    disk = hosts.disk(snapshot(spark, "diskstats", "8 0 sda 10 2 3 4 20 5 6 7 1 8 9 30 4 5 6 40 7\n7 0 loop0 1 2 3 4 5 6 7 8 9 10 11"))
    got = values(disk)
    assert got[("node_disk_read_bytes_total", "0", "8", "sda")] == 3 * 512 and got[("node_disk_discarded_bytes_total", "0", "8", "sda")] == 5 * 512 and got[("node_disk_flush_requests_completed_total", "0", "8", "sda")] == 40
    assert sum("loop0" in k for k in got) == 11
    text = "36 35 98:0 / / rw - ext4 /dev/a rw\n50 35 98:0 / / rw - ext4 /dev/b rw\n51 35 98:0 / /data\\040disk ro - ext4 /dev/c rw\n52 1 0:4 / /proc rw - proc proc rw"
    mounts = {r["mountpoint"]: (r["device"], r["read_only"]) for r in hosts.mounts(snapshot(spark, "mountinfo", text)).collect()}
    assert mounts == {"/": ("/dev/b", False), "/data disk": ("/dev/c", True)}
    tcp = values(hosts.netstat(snapshot(spark, "net/snmp", "Tcp: ActiveOpens CurrEstab\nTcp: 7 5\nUdp: InDatagrams\nUdp: 9")))
    assert tcp == {("node_netstat_tcp_active_opens_total", "visible_namespace"): 7, ("node_netstat_tcp_current_established", "visible_namespace"): 5, ("node_netstat_udp_datagrams_received_total", "visible_namespace"): 9}
    group = values(hosts.cgroup(snapshot(spark, "cpu.max", "20000 100000\n").union(snapshot(spark, "memory.swap.max", "max\n")).union(snapshot(spark, "io.stat", "8:0 rbytes=1 wbytes=2")).union(snapshot(spark, "cpu.stat", "usage_usec 5\nuser_usec 3"))))
    assert group[("node_cgroup_cpu_quota_microseconds", "configured_root")] == 20000 and group[("node_cgroup_memory_swap_limit_unlimited", "configured_root")] == 1 and group[("node_cgroup_cpu_usage_microseconds_total", "configured_root")] == 5 and group[("node_cgroup_io_read_bytes_total", "8:0", "configured_root")] == 1
    os = hosts.os_release(snapshot(spark, "os-release", 'NAME="A \\"B\\""\nVERSION_ID=12\nPRETTY_NAME=\'A 12\'')).collect()[0]
    assert (os["os_name"], os["os_version"], os["os_description"]) == ('A "B"', "12", "A 12")
    assert values(hosts.socket(snapshot(spark, "net/sockstat", "sockets: used 5\nTCP: inuse 2 mem 3")))[("node_socket_memory_bytes", "ipv4", "tcp", "visible_namespace")] == 12288


def test_journal(spark):
    df = spark.createDataFrame([("__CURSOR=c1\n__REALTIME_TIMESTAMP=1700000000000000\nPRIORITY=4\nMESSAGE=one\nMESSAGE=two",), ("MESSAGE=no cursor",), ("__CURSOR=c2\n__REALTIME_TIMESTAMP=5\nMESSAGE=" + "x" * 100,)], "entry string")
    out = readers.parse_journal(df, max_message=50).orderBy("cursor").collect()
    assert [(r["cursor"], r["message_oversized"]) for r in out] == [("c1", False), ("c2", True)] and out[0]["fields"]["MESSAGE"] == "one"
    rec = logs.journal_to_records(readers.parse_journal(df, max_message=50)).orderBy("cursor").collect()
    assert (rec[0]["severity_text"], rec[0]["time_unix_nano"], rec[1]["body"]) == ("WARNING", 1700000000000000000, "")


def test_raw_lines(spark, tmp_path):
    (tmp_path / "a.log").write_bytes(b"one\r\nt\xc3\xa4o\nrest")
    path = str(tmp_path / "a.log")
    assert [(r["offset"], r["line"]) for r in readers.read_raw_lines(spark, path).orderBy("line_no").collect()] == [(0, "one"), (5, "täo")]
    assert readers.read_raw_lines(spark, path, closed=True).count() == 3


def test_otlp_json(spark):
    body = '{"resourceMetrics":[{"resource":{"attributes":[{"key":"service.name","value":{"stringValue":"a"}}]},"scopeMetrics":[{"metrics":[{"name":"g","gauge":{"dataPoints":[{"timeUnixNano":"5","asDouble":1.5},{"timeUnixNano":"6"}]}},{"name":"s","sum":{"isMonotonic":true,"dataPoints":[{"timeUnixNano":"7","asInt":"3","attributes":[{"key":"n","value":{"intValue":"4"}}]}]}},{"name":"h","histogram":{"dataPoints":[{"count":"1"}]}}]}]}]}'
    df = spark.createDataFrame([("r", body)], "request_id string, body string")
    out = {r["name"]: r for r in readers.read_otlp_metrics(df).collect()}
    assert set(out) == {"g", "s"} and out["g"]["float_value"] == 1.5 and out["s"]["int_value"] == 3 and out["s"]["monotonic"] and out["s"]["attrs"] == {"n": "4"} and out["g"]["resource"] == {"service.name": "a"}
    assert readers.unsupported_points(df).collect()[0]["unsupported"] == 1
    again = readers.to_otlp_metrics(readers.read_otlp_metrics(df).withColumn("arrival_seq", F.col("time_unix_nano")))
    assert {(r["name"], r["int_value"], r["float_value"]) for r in readers.read_otlp_metrics(again.select(F.lit("q").alias("request_id"), "body")).collect()} == {("g", None, 1.5), ("s", 3, None)}
    spans = spark.createDataFrame([("r", '{"resourceSpans":[{"scopeSpans":[{"spans":[{"traceId":"' + "11" * 16 + '","spanId":"' + "22" * 8 + '","name":"n","startTimeUnixNano":"1","endTimeUnixNano":"2"},null]}]}]}')], "request_id string, body string")
    assert [r["invalid"] for r in traces.validate_spans(readers.read_otlp_spans(spans)).orderBy("span_idx").collect()] == [False, True]
    recs = spark.createDataFrame([("r", '{"resourceLogs":[{"scopeLogs":[{"logRecords":[{"timeUnixNano":"9","body":{"stringValue":"b"}},null]}]}]}')], "request_id string, body string")
    assert [r["body"] for r in readers.read_otlp_logs(recs).orderBy("record_idx").collect()] == ["b", ""]


def test_text_helpers(spark):
    df = spark.createDataFrame([("a\tbé", "reg/x/app:1@sha256:ab", "a\\040b")], "t string, i string, o string")
    r = df.select(L.bounded_text(F.col("t"), 7).alias("t"), L.image_name(F.col("i")).alias("n"), L.image_digest(F.col("i")).alias("d"), L.decode_octal_escapes(F.col("o")).alias("o")).collect()[0]
    assert (r["t"], r["n"], r["d"], r["o"]) == ("a�bé", "reg/x/app", "sha256:ab", "a b")
    assert spark.createDataFrame([("aéé",)], "t string").select(L.bounded_text(F.col("t"), 4)).collect()[0][0] == "aé"


def test_a_chain_is_no_cycle(spark):
    """What is left of a chain after peeling must not look like a cycle; a loop to itself is one."""
    binary = lambda n, size: bytes(size - 1) + bytes([n])
    rows = []
    for trace, n in enumerate(range(2, 12), start=1):
        rows += [(1, binary(trace, 16), binary(k, 8), binary(k - 1, 8) if k > 1 else None) for k in range(1, n + 1)]
    rows += [(1, binary(90, 16), binary(1, 8), binary(1, 8)), *[(1, binary(91, 16), binary(k, 8), binary(k % 5 + 1, 8)) for k in range(1, 6)]]
    found = traces.parent_cycle_spans(spark.createDataFrame(rows, "request_id int, trace_id binary, span_id binary, parent_span_id binary")).collect()
    assert sorted((bytes(r["trace_id"])[-1], bytes(r["span_id"])[-1]) for r in found) == [(90, 1), *[(91, k) for k in range(1, 6)]]


def test_readers_of_files(spark, tmp_path, monkeypatch):
    (tmp_path / "a.prom").write_text("up 1\n")
    (tmp_path / "b.prom").write_text("é" * 10)
    monkeypatch.setattr(readers, "MAX_BODY", 7)
    got = {r["scrape_id"][-6:]: (r["body"], r["truncated"]) for r in readers.read_exposition(spark, str(tmp_path / "*.prom")).collect()}
    assert got == {"a.prom": ("up 1\n", False), "b.prom": ("ééé", True)}
    with pytest.raises(ValueError):
        readers.discover_logs(spark, [str(tmp_path / "*.prom")])
    assert [r["path"][-6:] for r in readers.discover_logs(spark, [str(tmp_path / "*.prom")], [str(tmp_path / "b*")], "beginning").collect()] == ["a.prom"]
    assert readers.discover_logs(spark, [str(tmp_path / "*.prom")], seen_before="2100-01-01T00:00:00").count() == 0
    (tmp_path / "j.txt").write_text("__CURSOR=c1\n__REALTIME_TIMESTAMP=5\nMESSAGE=m\n\nMESSAGE=no cursor\n\n")
    assert [(r["cursor"], r["realtime_usec"], r["fields"]) for r in readers.read_journal_entries(spark, str(tmp_path / "j.txt")).collect()] == [("c1", 5, {"MESSAGE": "m"})]
    rows = spark.createDataFrame([("logs", 1), ("odd", 2), (None, 3)], "kind string, id int")
    readers.write_by_kind(rows, str(tmp_path / "t"), str(tmp_path / "q"))
    assert [(r["id"], r["kind"]) for r in spark.read.parquet(str(tmp_path / "t")).collect()] == [(1, "logs")]
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "q")).collect()) == [2, 3]


def test_excluded_files_of_folders(spark, tmp_path, monkeypatch):
    """An exclude glob with or without a scheme; with more than one bucket of documents, the odd ones are left out."""
    from siftline.plans import ingest
    from siftline.sources import readers

    for k in range(3):
        (tmp_path / f"k={k}").mkdir()
        (tmp_path / f"k={k}" / "x.txt").write_text("x")
    for head in ("", "file:", "file://"):
        found = readers.discover_logs(spark, [f"{head}{tmp_path}/k=*/*.txt"], [f"{head}{tmp_path}/k=1/*", "*/k=2/*"], "beginning")
        assert [r["path"].rsplit("/", 2)[1] for r in found.collect()] == ["k=0", "k=2"]
    documents = spark.range(0, 2000, 100).select(F.col("id").alias("doc_id"), F.lit("a").alias("text"))
    monkeypatch.setattr(ingest, "table", lambda *_: documents)
    assert sorted(r["bucket"] for r in ingest.discovered_files(spark, "").collect()) == [0, 2]
