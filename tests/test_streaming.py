"""A stream cut into several micro-batches gives the rows of the finished table."""

import time

import pytest
from pyspark.sql import functions as F

from siftline.operators import delivery, logs, metrics
from siftline.streaming import counters, sinks, stateful


@pytest.fixture
def replay(spark, tmp_path):
    def run(parts, make):
        """Write each part of the input as a file, read one file per micro-batch, return all rows given."""
        schema = parts[0].schema
        source = tmp_path / "in"
        source.mkdir()
        for i, p in enumerate(parts):
            import os

            p.coalesce(1).write.parquet(str(tmp_path / f"part{i}"))
            f = next((tmp_path / f"part{i}").glob("*.parquet"))
            os.rename(f, source / f"{i}.parquet")
            os.utime(source / f"{i}.parquet", (1000 + i * 10, 1000 + i * 10))
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
        q = make(stream).writeStream.format("memory").queryName("out").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
        try:
            q.processAllAvailable()
            return [tuple(r) for r in spark.table("out").collect()]
        finally:
            q.stop()

    return run


def halves(spark, data, schema, cuts):
    return [spark.createDataFrame(data[a:b], schema) for a, b in zip([0, *cuts], [*cuts, len(data)], strict=True)]


def test_resets(spark, replay):
    data = [("a", i, v, t) for i, (v, t) in enumerate([(900, 100), (10, 300), (1000, 200), (20, 400), (5, 500), (7, 500)])]
    schema = "s string, seq long, v long, t long"
    got = replay(halves(spark, data, schema, [2, 4]), lambda d: stateful.normalize_resets(d, ["s"], "v", "t", ["seq"]))
    full = metrics.normalize_resets(spark.createDataFrame(data, schema), ["s"], "v", "t", ["seq"])
    assert sorted(got) == sorted(tuple(r) for r in full.collect())


def test_cardinality(spark, replay):
    data = [("a", str(i % 5), i) for i in range(12)] + [("b", "1", 20)]
    schema = "t string, s string, arrival_seq long"
    got = replay(halves(spark, data, schema, [3, 7]), lambda d: stateful.limit_cardinality(d, "t", "s", 2, ["arrival_seq"]))
    assert sorted(got) == sorted(tuple(r) for r in metrics.limit_cardinality(spark.createDataFrame(data, schema), "t", "s", 2).collect())


def test_multiline(spark, replay):
    texts = ["x lead", "S one", " a", " b", "S " + "y" * 30, " lost", "S two", " c", " d", " e", " f", "S three", "S last"]
    data = [("f", i, i * 10, t) for i, t in enumerate(texts)]
    schema = "path string, line_no long, offset long, line string"
    got = replay(halves(spark, data, schema, [1, 3, 8]), lambda d: stateful.assemble_multiline(d, "^S", max_lines=4, max_bytes=20))
    full = logs.assemble_multiline(spark.createDataFrame(data, schema), "^S", max_lines=4, max_bytes=20)
    assert sorted(got, key=str) == sorted((tuple(r) for r in full.collect()), key=str)


def test_cri(spark, replay):
    t = "2026-07-18T10:11:12Z"
    texts = [f"{t} stdout P a", f"{t} stdout P b", f"{t} stdout F c", f"{t} stderr P {'z' * 30}", f"{t} stdout P x", f"{t} stderr F y", "bad", f"{t} stdout P d", f"{t} stderr F e"]
    data = [("f", i, i * 10, x) for i, x in enumerate(texts)]
    parts = halves(spark, data, "path string, line_no long, offset long, line string", [1, 4, 5])
    got = replay(parts, lambda d: stateful.assemble_cri(logs.parse_cri(d), max_bytes=20))
    full = logs.assemble_cri(logs.parse_cri(spark.createDataFrame(data, parts[0].schema)), max_bytes=20)
    assert sorted(got, key=str) == sorted((tuple(r) for r in full.collect()), key=str)


def test_pressure(spark, replay):
    data = [("k", i, float(b)) for i, b in enumerate([10, 85, 70, 60, 50, 70, 90, 40])]
    schema = "kind string, at long, bytes double"
    got = replay(halves(spark, data, schema, [2, 3, 6]), lambda d: stateful.pressure_flag(d, 100))
    assert sorted(got) == sorted(tuple(r) for r in delivery.pressure_flag(spark.createDataFrame(data, schema), 100).collect())


@pytest.fixture
def files(spark, tmp_path):
    """A streaming source whose parts are files, one per micro-batch."""

    def make(parts):
        import os

        source = tmp_path / "in"
        source.mkdir()
        for i, p in enumerate(parts):
            p.coalesce(1).write.parquet(str(tmp_path / f"part{i}"))
            os.rename(next((tmp_path / f"part{i}").glob("*.parquet")), source / f"{i}.parquet")
            os.utime(source / f"{i}.parquet", (1000 + i * 10, 1000 + i * 10))
        return spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", 1).parquet(str(source))

    return make


def test_counts_of_a_stream_are_those_of_the_table(spark, files, tmp_path):
    t = "2026-07-18T10:11:12Z"
    texts = ["bad", f"{t} stdout F secret and secret", "x" * 90, f"{t} stdout P a", None, f"{t} stderr F none", "also bad", "y" * 91]
    data = [("f", i, i * 10, x) for i, x in enumerate(texts)]
    parts = halves(spark, data, "path string, line_no long, offset long, line string", [1, 4, 5])

    def chain(df):
        parsed = counters.parse_cri(counters.drop_oversized(df, 80)).withColumnRenamed("content", "body")
        return counters.redact(parsed, ["secret"], limit=1000)

    seen = counters.Counters()
    spark.streams.addListener(seen)
    try:
        q = chain(files(parts)).writeStream.format("memory").queryName("counted").option("checkpointLocation", str(tmp_path / "cp")).start()
        q.processAllAvailable()
        expected = {("oversized_lines", "lines"): 8, ("oversized_lines", "dropped"): 3, ("container_lines", "lines"): 5, ("container_lines", "parse_errors"): 2, ("redaction.in", "rows"): 5, ("redaction.out", "rows"): 5, ("redaction.out", "redactions"): 2}
        end = time.time() + 20
        while seen.totals() != expected and time.time() < end:
            time.sleep(0.2)
        q.stop()
    finally:
        spark.streams.removeListener(seen)
    assert seen.totals() == expected
    assert {(r["operator"], r["counter"]): r["n"] for r in seen.table(spark).collect()} == expected
    whole = spark.createDataFrame(data, parts[0].schema)
    df, counts = counters.counted(logs.parse_cri(logs.drop_oversized(whole, 80)), "cri", lines=F.lit(1), parse_errors=F.col("parse_error"))
    assert df.count() == 5 and counts() == {"lines": 5, "parse_errors": 2}


def test_late_points_of_a_stream_are_counted(spark, files, tmp_path):
    data = [("a", i, v, t) for i, (v, t) in enumerate([(900, 100), (10, 300), (1000, 200), (20, 400), (5, 100), (7, 500)])]
    parts = halves(spark, data, "s string, seq long, v long, t long", [2, 4])
    seen = counters.Counters()
    spark.streams.addListener(seen)
    try:
        out = counters.watched(files(parts), "resets", lambda d: stateful.normalize_resets(d, ["s"], "v", "t", ["seq"]))
        q = out.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "cp")).start()
        q.processAllAvailable()
        expected = {("resets.in", "rows"): 6, ("resets.out", "rows"): 4}
        end = time.time() + 20
        while seen.totals() != expected and time.time() < end:
            time.sleep(0.2)
        q.stop()
    finally:
        spark.streams.removeListener(seen)
    assert seen.totals() == expected


def test_a_batch_that_runs_again_leaves_no_second_copy(spark, tmp_path):
    rows = spark.createDataFrame([("logs", 1, "http", "400"), ("odd", 2, "http", "503"), (None, 3, "grpc", "OutOfRange")], "kind string, id int, protocol string, status string")
    a, b, c, d = (str(tmp_path / x) for x in "abcd")
    kinds, tries = sinks.by_kind(a, b), sinks.attempts(c, d)
    for batch in (0, 1, 1, 0):
        kinds(rows, batch)
        tries(rows.where(F.col("id") > batch), batch)
    read = lambda path: sorted((r["batch"], r["id"]) for r in spark.read.parquet(path).collect())
    assert read(a) == [(0, 1), (1, 1)] and read(b) == [(0, 2), (0, 3), (1, 2), (1, 3)]
    assert read(c) == [(0, 2), (1, 2)] and read(d) == [(0, 1), (0, 3), (1, 3)]


def test_traces_of_a_stream(spark, files, tmp_path):
    span = lambda r, i, t, size: (r, i, bytes([t]) * 16, bytes([i + 1]) * 8, None, "", "n", 1, 2, [], 0, [], size)
    schema = "request_id string, span_idx int, trace_id binary, span_id binary, parent_span_id binary, trace_state string, name string, start_unix_nano long, end_unix_nano long, links array<struct<trace_id:binary,span_id:binary,trace_state:string>>, resource_idx int, resource_attrs array<struct<key:string,value:string>>, size_bytes long"
    one, two = [span("a", i, 1 + i // 2, 40) for i in range(6)], [span("b", 0, 9, 500), span("b", 1, 8, 10)]
    parts = [spark.createDataFrame(x, schema) for x in (one, two)]
    path, answers = str(tmp_path / "out"), str(tmp_path / "answers")
    q = files(parts).writeStream.foreachBatch(sinks.ingested_traces(path, answers, max_bytes=100)).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = sorted((r["request_id"], r["span_idx"], r["chunk"]) for r in spark.read.parquet(path).collect())
    assert got == [("a", 0, 0), ("a", 1, 0), ("a", 2, 1), ("a", 3, 1), ("a", 4, 2), ("a", 5, 2), ("b", 1, 0)]
    assert [(r["request_id"], r["rejected_spans"]) for r in spark.read.parquet(answers).collect()] == [("b", 1)]
