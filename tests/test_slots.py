"""Hot groups cut into slots give what row-by-row folds give; host files route what they can't read."""

import random
import re

import pytest
from pyspark.sql import functions as F

from siftline.functions import patterns as P
from siftline.functions import scans
from siftline.operators import delivery, envelopes, hosts, logs, metrics, packing, traces

HOT = [1 << 20, 20]


@pytest.fixture(autouse=True)
def few_slots(monkeypatch):
    monkeypatch.setattr(scans.slotted, "__defaults__", (7, 1 << 20))


@pytest.mark.parametrize("hot_rows", HOT)
def test_running_values(spark, hot_rows):
    r = random.Random(1)
    rows = [(k, i, r.choice([None, *range(-5, 9)])) for k, n in (("a", 200), ("b", 3), (None, 30), ("c", 1)) for i in range(n)]
    df = spark.createDataFrame(rows, "k string, i long, v long")
    cut = scans.slotted(df, ["k"], "i", hot_rows=hot_rows)
    assert cut.n_hot == (2 if hot_rows == 20 else 0)
    got = {(x["k"], x["i"]): (x["s"], x["m"], x["l"], x["b"]) for x in cut.running(["i"], sums={"s": F.col("v")}, maxima={"m": F.col("v")}, lasts={"l": F.col("v")}, before={"b": F.col("v")}).rows.collect()}
    expected, state = {}, {}
    for k, i, v in rows:
        s, m, last, before = state.get(k, (0, None, None, None))
        s, m, last = s + (v or 0), m if v is None else v if m is None else max(m, v), last if v is None else v
        expected[k, i] = (s, m, last, before)
        state[k] = (s, m, last, v)
    assert got == expected


@pytest.mark.parametrize("hot_rows", HOT)
def test_resets(spark, hot_rows):
    r = random.Random(2)
    rows = [(s, a, r.randint(0, 40) + a, r.randint(0, 50)) for s, n in (("hot", 300), ("b", 4), ("c", 1)) for a in range(n)]
    out = {}
    newest, last, offset = {}, {}, {}
    for s, a, t, v in rows:
        if t < newest.get(s, t):
            continue
        newest[s] = max(t, newest.get(s, t))
        offset[s] = offset.get(s, 0) + (last[s] if s in last and v < last[s] else 0)
        last[s] = v
        out[s, a] = v + offset[s]
    df = spark.createDataFrame(rows, "s string, a long, t long, v long")
    got = metrics.normalize_resets(df, ["s"], "v", time="t", order=["a"], hot_rows=hot_rows).collect()
    assert {(x["s"], x["a"]): x["v"] for x in got} == out


@pytest.mark.parametrize("hot_rows", [10, 1])
def test_resets_beyond_64_bits(spark, hot_rows):
    top = (1 << 63) - 1
    df = spark.createDataFrame([("a", 1, top - 1), ("a", 2, 5), ("a", 3, 9), ("b", 1, 3)], "s string, t long, v long")
    got = metrics.normalize_resets(df, ["s"], "v", time="t", hot_rows=hot_rows).collect()
    assert {(x["s"], x["t"]): x["v"] for x in got} == {("a", 1): top - 1, ("a", 2): None, ("a", 3): None, ("b", 1): 3}


def cri_lines(n, seed):
    r = random.Random(seed)
    out = []
    for i in range(n):
        kind = r.random()
        text = "x" * r.choice([0, 1, 3, 6, 11, 25, 200]) if r.random() < 0.7 else "é" * 3
        out.append("not to be read " + text if kind < 0.1 else f"2026-07-18T10:11:{i % 60:02d}Z {r.choice(['stdout', 'stdout', 'stderr'])} {r.choice('PPPF')} {text}")
    return out


@pytest.mark.parametrize("hot_rows", HOT)
@pytest.mark.parametrize("at_end", ["hold", "rotation"])
def test_container_lines(spark, hot_rows, at_end, monkeypatch):
    monkeypatch.setattr(logs, "CRI_HEAD", 40)
    files = {"hot": cri_lines(400, 1), "b": cri_lines(15, 2), "c": ["2026-07-18T10:11:12Z stdout P a"] * 3, "d": ["2026-07-18T10:11:12Z stdout P " + "y" * 9] * 30}
    rows = [(p, i, i * 10, line) for p, lines in files.items() for i, line in enumerate(lines)]
    parsed = logs.parse_cri(spark.createDataFrame(rows, "path string, line_no long, offset long, line string"))
    expected = []
    for path in files:
        own = [(x["line_no"], x["offset"], len(x["line"].encode()), x["time_unix_nano"], x["stream"], x["tag"], x["content"], x["parse_error"]) for x in parsed.where(F.col("path") == path).orderBy("line_no").collect()]
        records, pending, _ = logs.cri_fold(iter(own), 20)
        if pending and at_end == "rotation":
            records.append(pending | {"partial": True, "sequence_error": False})
        expected += [(path, *[x[c] for c in ("line_no", "offset", "time_unix_nano", "stream", "body", "parse_error", "partial", "sequence_error")]) for x in records]
    got = [tuple(x) for x in logs.assemble_cri(parsed, max_bytes=20, at_end=at_end, hot_rows=hot_rows).collect()]
    assert sorted(got, key=str) == sorted(expected, key=str) and len(got) > 100


@pytest.mark.parametrize("hot_rows", HOT)
def test_multiline_over_slots(spark, hot_rows):
    r = random.Random(4)
    files = {"hot": ["S" * (r.random() < 0.3) + "z" * r.choice([0, 1, 4, 9, 30]) for _ in range(300)], "b": ["z", "Sa", "z"], "c": ["z"] * 40}
    rows = [(p, i, i * 7, x) for p, lines in files.items() for i, x in enumerate(lines)]
    expected = []
    for p, lines in files.items():
        groups = []
        for i, x in enumerate(lines):
            if not groups or (x.startswith("S") and len(x) <= 20):
                groups.append([])
            groups[-1].append((i, x))
        for g in groups:
            body = "\n".join(x for _, x in g)
            if len(g) <= 5 and len(body) <= 20 and all(len(x) <= 20 for _, x in g):
                expected.append((p, g[0][0], g[0][0] * 7, body, len(g), "timeout" if g is groups[-1] else None))
    df = spark.createDataFrame(rows, "path string, line_no long, offset long, line string")
    got = [tuple(x) for x in logs.assemble_multiline(df, "^S", max_lines=5, max_bytes=20, at_end="timeout", hot_rows=hot_rows).collect()]
    assert sorted(got) == sorted(expected) and len(got) > 25


def fold(records, limit, rule):
    """(group, size, header) in order -> chunks."""
    out, chunk, used, last, dead = [], -1, limit + 1, None, False
    for group, size, head in records:
        join, fresh = size + (0 if (group,) == last else head), size + head
        last = (group,)
        dead |= rule == "stop" and fresh > limit
        if dead:
            out.append(-1)
            continue
        if used + join > limit:
            chunk, used = chunk + 1, fresh
        else:
            used += join
        out.append(chunk)
    return out


@pytest.mark.parametrize("hot_rows", HOT)
@pytest.mark.parametrize("rule", ["stop", "alone"])
@pytest.mark.parametrize("header", [0, 7])
def test_packing(spark, hot_rows, rule, header):
    r = random.Random(5)
    streams = {"hot": (400, 40), "long": (300, 5), "b": (12, 40), "small": (3, 9), "none": (30, 0), "large": (60, 130)}
    rows = []
    for name, (n, most) in streams.items():
        group = 0
        for i in range(n):
            group += r.random() < 0.2
            rows.append((name, i * 3, None if group == 3 else group, 0 if name == "none" else r.choice([0, 1, most // 2, most]), header))
    expected = {}
    for name in streams:
        own = [x for x in rows if x[0] == name]
        expected |= {(name, x[1]): c for x, c in zip(own, fold([x[2:] for x in own], 100, rule))}
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "path string, offset long, g int, size_bytes long, head long")
    got = packing.packed(df, "path", "offset", "size_bytes", 100, rule, *(["g", "head"] if header else []), hot_rows=hot_rows).collect()
    assert {(x["path"], x["offset"]): x["chunk"] for x in got} == expected and len(got) == len(rows)


def test_packing_by_its_users(spark):
    df = spark.createDataFrame([("r", 0, 40), ("r", 1, 40), ("r", 2, 40), ("r", 3, 500), ("r", 4, 1), ("q", 0, None)], "request_id string, record_idx int, size_bytes int")
    assert [x["chunk"] for x in envelopes.pack_logs(df, max_bytes=100).orderBy("request_id", "record_idx").collect()] == [0, 0, 0, 1, -1, -1]
    files = df.toDF("path", "offset", "size_bytes")
    assert [x["chunk"] for x in envelopes.batch_records(files, max_bytes=100).orderBy("path", "offset").collect()] == [0, 0, 0, 1, 2, 3]
    assert envelopes.pack_logs(df.limit(0), max_bytes=100).collect() == []


def test_trace_counts_by_unit(spark):
    ids = [b"\x01" * 16, b"\x02" * 16, b"", None]
    rows = [("r", i, ids[i % 4], b"", 30) for i in range(12)]
    spans = spark.createDataFrame(rows, "request_id string, span_idx int, trace_id binary, span_id binary, size_bytes int")
    kept = spans.where("span_idx <> 0 AND span_idx <> 4 AND span_idx <> 8")
    got = traces.packing_summary(traces.pack_traces(kept, 100), spans).first().asDict()
    assert (got["selected_traces"], got["selected_spans"], got["bypassed_traces"], got["bypassed_spans"], got["excluded_traces"], got["excluded_spans"], got["rejected_spans"]) == (7, 9, 6, 6, 1, 3, 0)


@pytest.mark.parametrize(("pattern", "text"), [("^a", "aab"), (r"\Aa", "aaba"), (r"\bfoo", "foofoo xfoo foo"), (r"x\B", "xxx x"), ("[^a]^b|[]^]c", "]c^cab"), (r"(?m)^x", "xx\nxx"), (r"a\\bb", r"a\bb")])
def test_search_begins_anew(spark, pattern, text):
    plain = re.compile(pattern.replace("[]^]", r"[\]^]"))
    rest, expected = text, ""
    while rest and (m := plain.search(rest)):
        expected += rest[: m.start()] + "#"
        rest = rest[m.end() :]
    got = logs.redact_journal(spark.createDataFrame([(text,)], "body string"), [pattern], "#").first()
    assert got["body"] == expected + rest and got["redactions"] == expected.count("#")


def test_anchors_are_rewritten_outside_of_classes():
    assert P.restarting(r"[^\]x]^\A[[:^alpha:]^]\\A") == r"[^\]x](?:\G|^)(?:\G|\A)[[:^alpha:]^]\\A"


# host files ------------------------------------------------------------------------------------------------------


def read(spark, job, *files):
    df = spark.createDataFrame([("h", name, 10**9, text) for name, text in files], "host string, file string, captured_at_unix_nano long, content string")
    parsed = hosts.parse(df, job)
    points = sorted((x["name"], *sorted(x["attrs"].items()), x["value"]) for x in hosts.points(parsed).collect())
    return points, {x["file"]: (x["n_errors"], x["details"]) for x in hosts.errors(parsed).collect()}


def names(points):
    return [p[0].removeprefix("node_") for p in points]


def test_bad_records_are_routed(spark):
    points, bad = read(spark, "load", ("loadavg", "1 x 3"))
    assert points == [("node_load1", 1.0)] and bad["loadavg"] == (1, ["field 2 is no number of 0 or more"])
    assert read(spark, "load", ("loadavg", None)) == ([], {"loadavg": (1, ["fewer than 3 fields"])})
    points, bad = read(spark, "memory", ("meminfo", "MemTotal: 4 kB\nMemFree:\nCached: 7\nBuffers: 1.5 kB\nMemAvailable: 99999999999999999 kB\nOther: x"))
    assert points[0] == ("node_memory_Buffers_bytes", 1536.0) and ("node_memory_Cached_bytes", 7.0) in points and len(points) == 4 and bad["meminfo"][0] == 1
    points, bad = read(spark, "cpu", ("stat", "cpu 1\ncpu0 1 -2 3\ncpu1 99999999999999999999\nintr 5"))
    assert sorted(p[-1] for p in points) == [10.0, 30.0] and bad["stat"] == (2, ["line 2: nice is no count", "line 3: user is no count"])
    points, bad = read(spark, "network", ("net/dev", "head | head\n eth0: 1 0 0 0 0 0 0 0 x\nlo: 1 2"))
    assert len(points) == 1 and bad["net/dev"][0] == 2
    assert read(spark, "uptime", ("uptime", "-1 2"))[1]["uptime"][0] == 1


def test_errors_of_a_file_are_counted_and_bounded(spark):
    points, bad = read(spark, "disk", ("diskstats", "8 0 sda 1 2 3 4 5 6 7 8 9 10 11\n" + "8 1 sdb 1 2\n" * 50 + "8 2 sdc " + "1 " * 13 + "\n8 3 sdd " + "1 " * 16 + "\nx 3 sde " + "1 " * 11 + "\n8 4 sdf 1 1 99999999999999999 " + "1 " * 8))
    assert len(points) == 11 and bad["diskstats"][0] == 54 and len(bad["diskstats"][1]) == 16


def test_repeated_records(spark):
    points, bad = read(spark, "socket", ("net/sockstat", "sockets: used 5\nTCP: inuse 2 inuse 3 mem 9999999999999999 odd 1\nTCP: inuse 9\nUDP: inuse\nRAW: odd 1\nOTHER: inuse 1"), ("net/sockstat6", "TCP6: inuse x"), ("net/snmp", "Tcp: InSegs CurrEstab InSegs\nTcp: 1 2 3\nTcp: InSegs\nTcp: 9\nIp: A\nIp: 1\nUdp: NoPorts"))
    assert names(points) == ["netstat_tcp_current_established", "netstat_tcp_segments_received_total", "socket_inuse", "socket_memory_pages", "socket_used"]
    assert {k: v[0] for k, v in bad.items()} == {"net/sockstat": 4, "net/sockstat6": 2, "net/snmp": 3}
    points, bad = read(spark, "cgroup", ("cpu.stat", "usage_usec 1\nusage_usec 2\nodd\nuser_usec x\nother 7"), ("io.stat", "8:0 rbytes=1 rbytes=2 wbytes=x odd rios=4\n99999999999:0 rios=1\nx rios=1"), ("memory.max", "max"), ("pids.max", "max 1"), ("memory.current", "7\n"), ("cpu.max", "max 0"), ("memory.events", "low 1\nodd 2"), ("cgroup.controllers", "cpu"))
    assert names(points) == ["cgroup_cpu_usage_microseconds_total", "cgroup_io_read_bytes_total", "cgroup_io_read_operations_total", "cgroup_memory_current_bytes", "cgroup_memory_events_total", "cgroup_memory_limit_unlimited", "cgroup_v2_info"]
    assert {k: v[0] for k, v in bad.items()} == {"cpu.stat": 3, "io.stat": 5, "pids.max": 1, "cpu.max": 1}
    assert read(spark, "cgroup", ("io.stat", "\n")) == ([], {})


def test_a_bad_pressure_line_spoils_its_file(spark):
    good = "some avg10=1.50 avg60=100 avg300=0 total=7"
    points, bad = read(spark, "pressure", ("pressure/cpu", good), ("pressure/io", good + "\nfull avg10=101 avg60=1 avg300=0 total=7"), ("pressure/memory", good + "\n" + good))
    assert len(points) == 4 and points[0][-1] == 7.0 and {k: v[1] for k, v in bad.items()} == {"pressure/io": ["line 2: avg10 is no percentage"], "pressure/memory": ["line 2: repeated some"]}


def test_mounts_and_sizes(spark):
    text = "1 0 8:1 / / rw - ext4 /dev/a rw\n2 1 8:2 / /da\\040ta//x/ ro - xfs /dev/b rw\nno separator\n3 1 8:3 / rel rw - ext4 d rw\n4 1 8:4 / /bad\\9 rw - ext4 d rw\n5 1 0:1 / /proc rw - proc p rw\n6 1 0:2 / /f rw - fuseblk f rw\n7 1 0:3 / /t rw - tmpfs t rw\n8 1 x"
    df = spark.createDataFrame([("h", "mountinfo", 5, text)], "host string, file string, captured_at_unix_nano long, content string")
    assert {(m["mountpoint"], m["read_only"]) for m in hosts.mounts(df).collect()} == {("/", False), ("/da ta/x", True), ("/t", False)}
    assert hosts.errors(hosts.parse(df, "mounts")).first()["n_errors"] == 4
    sizes = spark.createDataFrame([("h", 5, "/", 4096, 10, 5, 4, 100, 50, False), ("h", 5, "/t", 0, 1, 1, 1, 1, 1, False)], "host string, captured_at_unix_nano long, mountpoint string, block_size long, blocks long, blocks_free long, blocks_available long, files long, files_free long, read_only boolean")
    points, bad = hosts.filesystem(df, sizes)
    got = {(p["attrs"]["mountpoint"], p["name"].removeprefix("node_filesystem_")): p["int_value"] for p in points.collect()}
    assert got[("/", "size_bytes")] == 40960 and got[("/", "device_error")] == 0 and got[("/da ta/x", "device_error")] == 1 and got[("/t", "device_error")] == 1 and len(got) == 9
    assert {(b["mountpoint"], b["detail"]) for b in bad.collect()} == {("/da ta/x", "no sizes"), ("/t", "sizes are none or too large")}


def test_states_of_captures(spark):
    rows = [("h", "loadavg", 1, "1 2 3"), ("h", "loadavg", 2, "1"), ("h", "uptime", 3, "5"), ("h", "loadavg", 4, "1 2 3"), ("g", "uptime", 1, "x")]
    df = spark.createDataFrame(rows, "host string, file string, captured_at_unix_nano long, content string")
    status = hosts.collector_status(df, "load", "uptime")
    assert status.count() == 10
    changes = [(x["host"], x["at"], x["status"], x["before"]) for x in hosts.transitions(status.where("collector = 'load'")).orderBy("host", "at").collect()]
    assert changes == [("g", 1, "unsupported", None), ("h", 1, "ok", None), ("h", 2, "error", "ok"), ("h", 3, "unsupported", "error"), ("h", 4, "ok", "unsupported")]
    assert {x["status"] for x in status.where("collector = 'uptime' AND at = 1").collect()} == {"unsupported", "error"}


def test_host_identity(spark):
    rows = [
        ("a", "os-release", 1, 'NAME="A \\"B\\" \\$x"\nNAME=last\nID=x\n# c\nVERSION_ID=12\nPRETTY_NAME=\'A 12\''), ("a", "hostname", 1, "old\n"), ("a", "hostname", 2, " web-1 \n"), ("a", "machine-id", 1, "0123456789abcdef" * 2 + "\n"),
        ("b", "os-release", 1, "NAME=x\nodd line"), ("b", "hostname", 1, "two words"), ("b", "machine-id", 1, "0123456789ABCDEF" * 2), ("c", "os-release", 1, 'NAME="bad \\n escape"'), ("c", "hostname", 1, None), ("d", "os-release", 1, "ID=x"), ("e", "os-release", 1, "NAME=two words"), ("e", "hostname", 1, "x" * 256),
    ]
    identity = hosts.host_identity(spark.createDataFrame(rows, "host string, file string, captured_at_unix_nano long, content string"))
    assert {(r["host"], r["file"]): r["detail"] for r in identity.where("detail IS NOT NULL").collect()} == {
        ("b", "os-release"): "line 2: no key", ("b", "hostname"): "no host name", ("b", "machine-id"): "no machine id", ("c", "os-release"): "line 1: bad value of NAME", ("c", "hostname"): "no host name",
        ("d", "os-release"): "nothing that is supported", ("e", "os-release"): "line 1: bad value of NAME", ("e", "hostname"): "no host name",
    }
    found = {r["host"]: r["detected"] for r in hosts.detected_attributes(identity).collect()}
    assert found == {"a": {"os.name": "last", "os.version": "12", "os.description": "A 12", "host.name": "web-1", "host.id": "0123456789abcdef" * 2}}


@pytest.mark.parametrize("slots", [1, 9])
def test_changes_at_one_time(spark, slots):
    depth = [("a", 1, 90, 1), ("a", 1, 10, 2), ("a", 2, 60, 3), ("a", 3, 10, 5), ("a", 3, 90, 4)]
    points = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("b", 1)], "kind string, at long")
    for order in (depth, depth[::-1]):
        flags = delivery.pressure_flag(spark.createDataFrame(order, "kind string, at long, bytes long, seq long"), 100, slots=slots, tie="seq")
        assert {r["seq"]: r["pressure"] for r in flags.collect()} == {1: True, 2: False, 3: False, 4: True, 5: False}
        shed = delivery.shed(points, flags.select("kind", "at", "pressure", "seq"), slots=slots, tie="seq")
        assert {(r["kind"], r["at"]): r["shed"] for r in shed.collect()} == {("a", 1): False, ("a", 2): False, ("a", 3): False, ("b", 1): False}


def test_lines_of_blocks(spark, tmp_path):
    """Files in blocks of some bytes, lines over several of them, ends of all kinds."""
    from siftline.sources import readers

    r = random.Random(8)
    files = {"a": b"".join(b"x" * r.choice([0, 1, 5, 40, 300]) + r.choice([b"\n", b"\r\n"]) for _ in range(200)), "b": b"one\r\nt\xc3\xa4o\nrest", "c": b"", "d": b"\n\n", "e": b"bad \xff byte\n"}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]
    spark.conf.set(names[0], "512")
    spark.conf.set(names[1], "0")
    try:
        for closed in (False, True):
            expected = []
            for name, data in files.items():
                at = 0
                parts = data.split(b"\n")
                for k, part in enumerate(parts):
                    last = k == len(parts) - 1
                    end = at + len(part) + (not last)
                    if not last or (closed and part):
                        expected.append((name, k, at, end, (part[:-1] if part.endswith(b"\r") else part).decode(errors="replace")))
                    at = end
            out = readers.read_raw_lines(spark, str(tmp_path), closed=closed)
            got = [(x["path"].rsplit("/", 1)[1], x["line_no"], x["offset"], x["end_offset"], x["line"]) for x in out.collect()]
            assert sorted(got) == sorted(expected)
        assert spark.read.text(str(tmp_path / "a"), lineSep="\n").rdd.getNumPartitions() > 8
    finally:
        for n, v in zip(names, before):
            spark.conf.set(n, v)


@pytest.mark.parametrize("hot_rows", HOT)
def test_inventory_over_slots(spark, hot_rows):
    r = random.Random(9)
    seen = [(r.choice(["u", "u", "u", "v", None]), r.randint(0, 3000), i) for i in range(150)]
    pods = [(r.choice(["u", "v", "w", None]), t * 40, {"v": str(t)}) for t in range(60)]
    expected = []
    for uid, at, i in seen:
        best = max(((t, api) for u, t, api in pods if u == uid and t <= at and uid is not None), key=lambda x: x[0], default=None)
        age = at - best[0] if best else None
        fresh = "none" if age is None or age > 200 else "fresh" if age <= 60 else "stale"
        expected.append((uid, at, i, best[1] if fresh != "none" else None, fresh))
    got = logs.enrich_from_inventory(spark.createDataFrame(seen, "uid string, observed_at long, i int"), spark.createDataFrame(pods, "uid string, fetched_at long, api map<string,string>"), ttl=60, stale_after=200, hot_rows=hot_rows)
    assert sorted((tuple(x) for x in got.collect()), key=str) == sorted(expected, key=str)


def test_a_file_is_parsed_once(spark):
    """No filter on what a file gives goes below its parser, where it would be a second one."""
    df = spark.createDataFrame([("h", "loadavg", 1, "1 2 3")], "host string, file string, captured_at_unix_nano long, content string")
    parsed = hosts.parse(df, "load", "disk", "socket")
    for out in (hosts.points(parsed), hosts.errors(parsed), hosts.tagged(parsed), hosts.mounts(df), hosts.os_release(df), hosts.detected_attributes(hosts.host_identity(df))):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert not [line for line in plan.splitlines() if "Filter" in line and "split(" in line]


def test_small_streams_are_packed_in_batches(spark):
    """Many small streams are not a call each."""
    df = spark.range(900).select(F.expr("id div 3").alias("s"), "id", F.lit(4).alias("n"))
    out = packing.numbered(df, "s", "id", "n", "n", 8)
    assert "FlatMapGroupsInArrow" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((x["s"], x["id"], x["chunk"]) for x in out.collect()) == [(i // 3, i, i % 3 // 2) for i in range(900)]


@pytest.mark.parametrize("walked", [0, 4, 10_000])
def test_cycles_of_small_and_large_traces(spark, walked):
    r = random.Random(5)
    rows, expected = [], set()
    for t in range(1, 60):
        n = r.randint(1, 9)
        parent = {i: r.choice([None, *range(1, n + 2)]) for i in range(1, n + 1)}
        for i, p in parent.items():
            rows.append((t % 3, len(rows), t.to_bytes(16), i.to_bytes(8), p and p.to_bytes(8)))
            at, seen = p, set()
            while at in parent and at not in seen:
                seen.add(at)
                if at == i:
                    expected.add((t % 3, t, i))
                at = parent[at]
    df = spark.createDataFrame(rows, "request_id int, span_idx int, trace_id binary, span_id binary, parent_span_id binary")
    got = [(x["request_id"], int.from_bytes(x["trace_id"]), int.from_bytes(x["span_id"])) for x in traces.parent_cycle_spans(df, walked=walked).collect()]
    assert sorted(got) == sorted(expected) and expected
