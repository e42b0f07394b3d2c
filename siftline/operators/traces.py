"""Spans: validation, parent cycles, enrichment, whole-trace sampling and packing.

Spans have request_id, span_idx (order in the request), trace_id, span_id, parent_span_id (binary), trace_state, name,
start_unix_nano, end_unix_nano, links array<struct<trace_id,span_id,trace_state>>, resource_idx and
resource_attrs array<struct<key,value>>, size_bytes.
"""

from __future__ import annotations

import struct
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.functions import labels as L
from siftline.functions.scans import HOT_ROWS
from siftline.operators import packing
from siftline.operators.packing import REQUEST_BYTES

REASONS = ("bad_trace_id", "bad_span_id", "bad_parent_id", "empty_name", "bad_times", "bad_links", "bad_trace_state", "duplicate_span", "parent_cycle")


def valid_id(data: Column, length: int) -> Column:
    """Of that many bytes, not all zero."""
    return F.coalesce((F.octet_length(data) == length) & (F.hex(data) != "00" * length), F.lit(False))


def valid_tracestate(state: Column) -> Column:
    """Up to 32 comma-separated `key=value` members; empty members count but are skipped, keys are not repeated."""
    members = F.transform(F.split(state, ","), lambda m: F.regexp_replace(m, r"\A[ \t]+|[ \t]+\z", ""))
    some = F.filter(members, lambda m: m != "")
    key = r"(?:[a-z][a-z0-9_*/-]{0,255}|[a-z0-9][a-z0-9_*/-]{0,240}@[a-z][a-z0-9_*/-]{0,13})"
    grammar = rf"\A{key}=[\x20-\x2B\x2D-\x3C\x3E-\x7E]{{0,255}}[\x21-\x2B\x2D-\x3C\x3E-\x7E]\z"
    keys = F.transform(some, lambda m: F.substring_index(m, "=", 1))
    good = (F.size(members) <= 32) & F.forall(some, lambda m: m.rlike(grammar)) & (F.size(F.array_distinct(keys)) == F.size(keys))
    return F.coalesce(state, F.lit("")).eqNullSafe("") | F.coalesce(good, F.lit(False))


def validate_span_fields(spans: DataFrame) -> DataFrame:
    """Add a boolean for each bad field; bad_links and bad_trace_state are counts (a link's state counts if its ids are good)."""
    links = F.coalesce("links", F.expr("cast(array() AS array<struct<trace_id:binary,span_id:binary,trace_state:string>>)"))
    good = lambda x: x.isNotNull() & valid_id(x["trace_id"], 16) & valid_id(x["span_id"], 8)
    start, end = F.coalesce("start_unix_nano", F.lit(0)), F.coalesce("end_unix_nano", F.lit(0))
    return spans.withColumns({
        "bad_trace_id": ~valid_id(F.col("trace_id"), 16), "bad_span_id": ~valid_id(F.col("span_id"), 8),
        "bad_parent_id": F.coalesce(F.octet_length("parent_span_id") > 0, F.lit(False)) & ~valid_id(F.col("parent_span_id"), 8), "empty_name": F.coalesce("name", F.lit("")) == "",
        "bad_times": (start == 0) | (end == 0) | (end < start), "bad_links": F.size(F.filter(links, lambda x: ~good(x))),
        "bad_trace_state": (~valid_tracestate(F.col("trace_state"))).cast("int") + F.size(F.filter(links, lambda x: good(x) & ~valid_tracestate(x["trace_state"]))),
    })


def duplicate_span_ids(spans: DataFrame) -> DataFrame:
    """Column duplicate_span: the span's ids are valid and stand more than once in the request. copies: how often."""
    ok = valid_id(F.col("trace_id"), 16) & valid_id(F.col("span_id"), 8)
    # spans without valid ids don't meet: they are told apart by their number
    alone = [F.when(~ok, F.col("span_idx"))] if "span_idx" in spans.columns else []
    ids = Window.partitionBy("request_id", "trace_id", "span_id", *alone)
    return spans.withColumn("copies", F.when(ok, F.count("*").over(ids)).otherwise(1)).withColumn("duplicate_span", F.col("copies") > 1)


def _on_cycles(batches):
    """Edges sorted by trace, _begins at the first of each -> those of spans on a cycle. A trace may stand in several batches."""

    def found(t: pa.Table) -> list[pa.RecordBatch]:
        nodes, to, on = t["node"].to_pylist(), t["to"].to_pylist(), np.zeros(len(t), bool)
        starts = np.union1d(np.flatnonzero(t["_begins"].to_numpy()), [0]).tolist()
        for low, high in zip(starts, [*starts[1:], len(nodes)]):
            parent, walk, cycle = dict(zip(nodes[low:high], to[low:high])), {}, set()
            for begin in parent:
                n = begin
                while n in parent and n not in walk:
                    walk[n] = begin
                    n = parent[n]
                if n in parent and walk[n] == begin:
                    while n not in cycle:
                        cycle.add(n)
                        n = parent[n]
            for i in range(low, high) if cycle else ():
                on[i] = nodes[i] in cycle
        return t.filter(pa.array(on)).drop_columns(["to", "_begins"]).rename_columns(["request_id", "trace_id", "span_id"]).to_batches()

    rest = None
    for x in batches:
        t = pa.Table.from_batches([x])
        t = t if rest is None else pa.concat_tables([rest, t])
        # the last trace may go on in the next batch
        last = int(np.append(np.flatnonzero(t["_begins"].to_numpy()), 0).max())
        if last:
            yield from found(t.slice(0, last))
        rest = t.slice(last).combine_chunks()
    if rest is not None and len(rest):
        yield from found(rest)


def parent_cycle_spans(spans: DataFrame, keep: Callable[[DataFrame], DataFrame] | None = None, walked: int = 10_000) -> DataFrame:
    """request_id, trace_id, span_id of the spans on a cycle of parents.

    A trace with up to so many parents (walked) is followed from span to span in one task. In larger ones only spans with a parent and a child in the
    request and trace can be on a cycle, so the others are peeled off; then each round doubles the reach of every span's pointer, until it covers the
    largest trace left. keep (such as DataFrame.checkpoint) cuts the lineage between rounds; without a checkpoint folder rounds are
    persisted. Spans with repeated or invalid ids are left out.
    """
    keep = keep or (lambda df: df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df.persist())
    key = ["request_id", "trace_id"]
    unique = duplicate_span_ids(spans).where(valid_id(F.col("trace_id"), 16) & valid_id(F.col("span_id"), 8) & ~F.col("duplicate_span"))
    edges = unique.where(valid_id(F.col("parent_span_id"), 8)).select(*key, F.col("span_id").alias("node"), F.col("parent_span_id").alias("to"))
    edges = edges.where("request_id IS NOT NULL")
    large = keep(edges.groupBy(*key).count().where(F.col("count") > walked).select(*key))
    some_large = not large.isEmpty()
    small = edges.join(large, key, "left_anti") if some_large else edges
    w = Window.partitionBy(*key).orderBy("node")
    small = small.select(*key, "node", "to", (F.row_number().over(w) == 1).alias("_begins")).sortWithinPartitions(*key, "node")
    cycles = small.mapInArrow(_on_cycles, f"request_id {edges.schema['request_id'].dataType.simpleString()}, trace_id binary, span_id binary")
    if not some_large:
        return cycles
    edges = keep(edges.join(large, key, "left_semi"))
    for _ in range(2):
        # unresolved parents and childless spans go
        edges = edges.join(edges.select(*key, F.col("node").alias("to")), [*key, "to"], "left_semi").select(*key, "node", "to")
        edges = edges.join(edges.select(*key, F.col("to").alias("node")).distinct(), [*key, "node"], "left_semi").select(*key, "node", "to")
    edges = keep(edges)
    largest = edges.groupBy(*key).count().agg(F.max("count")).first()[0]
    # a pointer must reach further than the longest chain left, so that only cycles keep theirs
    for _ in range((largest or 0).bit_length()):
        step = edges.select(*key, F.col("node").alias("to"), F.col("to").alias("next"))
        # a pointer that leaves the graph is dropped: its span is on no cycle
        edges = keep(edges.join(step, [*key, "to"]).select(*key, "node", F.col("next").alias("to")))
    return cycles.unionByName(edges.select(*key, F.col("to").alias("span_id")).distinct())


def validate_spans(spans: DataFrame) -> DataFrame:
    """All nine reasons and invalid, per span."""
    cycles = parent_cycle_spans(spans).withColumn("_cycle", F.lit(True))
    rows = duplicate_span_ids(validate_span_fields(spans)).join(cycles, ["request_id", "trace_id", "span_id"], "left")
    rows = rows.withColumn("parent_cycle", F.coalesce("_cycle", F.lit(False)) & ~F.col("duplicate_span")).drop("_cycle")
    bad = F.lit(False)
    for r in REASONS:
        bad = bad | (F.col(r).cast("int") > 0)
    return rows.withColumn("invalid", bad)


def validation_report(validated: DataFrame) -> DataFrame:
    """One row per request: spans, invalid_spans and the count of each reason (duplicates count the extra copies)."""
    counts = [F.sum(F.col(r).cast("bigint")).alias(r) for r in REASONS if r != "duplicate_span"]
    extra = F.sum(F.when(F.col("duplicate_span"), (F.col("copies") - 1) / F.col("copies")).otherwise(0.0))
    return validated.groupBy("request_id").agg(F.count("*").alias("spans"), F.sum(F.col("invalid").cast("bigint")).alias("invalid_spans"), *counts, F.round(extra).cast("bigint").alias("duplicate_span"))


def apply_validation(validated: DataFrame, mode: str = "report") -> DataFrame:
    """`off` and `report` keep all; `reject` drops every span of a request with an invalid one."""
    if mode not in ("off", "report", "reject"):
        raise ValueError(f"unknown validation mode {mode!r}")
    if mode != "reject":
        return validated
    return validated.join(validated.where("invalid").select("request_id").distinct(), "request_id", "left_anti")


def enrich_resource(spans: DataFrame, attributes: dict[str, str], policy: str = "preserve") -> DataFrame:
    """Set attributes on resource_attrs array<struct<key,value>>: preserve adds missing ones, replace removes and appends.

    reject drops every span of a request in which some resource has another value for one of them. 32 attributes at most.
    """
    if len(attributes) > 32 or policy not in ("preserve", "replace", "reject"):
        raise ValueError("at most 32 attributes; the policy is preserve, replace or reject")
    attrs = F.coalesce("resource_attrs", F.expr("cast(array() AS array<struct<key:string,value:string>>)"))
    conflict = F.lit(False)
    out = attrs
    has = lambda k: lambda a: a["key"] == k
    lacks = lambda k: lambda a: a["key"] != k
    other = lambda k, v: lambda a: (a["key"] == k) & ~a["value"].eqNullSafe(F.lit(v))
    for k, v in sorted(attributes.items()):
        new = F.array(F.struct(F.lit(k).alias("key"), F.lit(v).alias("value")))
        if policy == "replace":
            out = F.concat(F.filter(out, lacks(k)), new)
        else:
            conflict = conflict | F.exists(attrs, other(k, v))
            out = F.concat(out, F.when(F.exists(attrs, has(k)), F.slice(new, 1, 0)).otherwise(new))
    enriched = spans.withColumns({"_conflict": conflict, "resource_attrs": out})
    if policy == "reject":
        enriched = enriched.join(enriched.where("_conflict").select("request_id").distinct(), "request_id", "left_anti")
    return enriched.drop("_conflict")


def sampling_threshold(percentage: float) -> int:
    """Of 16384 hash values, how many are kept; all arithmetic in single precision."""
    single = lambda x: struct.unpack("f", struct.pack("f", x))[0]
    if not 0 <= percentage <= 100:
        raise ValueError("a percentage from 0 to 100")
    threshold = int(single(single(percentage) * single(16384 / 100)))
    if percentage > 0 and threshold == 0:
        raise ValueError("the percentage is too small to keep any trace")
    return min(threshold, 16384)


def sample_traces(spans: DataFrame, percentage: float, hash_seed: int = 0) -> DataFrame:
    """Whole traces by a hash of their id; spans with an invalid trace id are kept. A larger percentage keeps a superset."""
    threshold = sampling_threshold(percentage)
    if threshold >= 16384:
        return spans
    kept = L.fnv1a32(F.col("trace_id"), hash_seed).bitwiseAND(F.lit(0x3FFF).cast("bigint")) < threshold
    return spans.where(~valid_id(F.col("trace_id"), 16) | kept)


def pack_traces(spans: DataFrame, max_bytes: int = REQUEST_BYTES, header: str | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Add chunk: a request's traces go in first-seen order into chunks of max_bytes, none split; 0 means 3 MiB.

    A trace larger than a chunk is rejected (chunk -1). Each span with an invalid trace id is a unit of its own. header names a column
    with the bytes of a span's resource and scope: a trace takes those of each of its (resource_idx, scope_idx) once, in its own chunk
    entry. Only requests over the limit are packed, from one row per trace; all others are chunk 0.
    """
    max_bytes = max_bytes or REQUEST_BYTES
    rows = spans.withColumn("_unit", unit_of())
    if header:
        parts = rows.groupBy("request_id", "_unit", "resource_idx", "scope_idx").agg((F.sum("size_bytes") + F.max(F.coalesce(F.col(header), F.lit(0)))).alias("size_bytes"), F.min("span_idx").alias("span_idx"))
    else:
        parts = rows
    units = parts.groupBy("request_id", "_unit").agg(F.sum("size_bytes").alias("size"), F.min("span_idx").alias("first"))
    total = units.groupBy("request_id").agg(F.sum("size").alias("total")).where(F.col("total") > max_bytes)
    large = units.join(total.select("request_id"), "request_id")
    kept = packing.numbered(large.where(F.col("size") <= max_bytes), "request_id", "first", "size", "size", max_bytes, hot_rows)
    packed = large.join(kept, ["request_id", "first"], "left").select("request_id", "_unit", F.coalesce("chunk", F.lit(-1)).alias("chunk"))
    return rows.join(packed, ["request_id", "_unit"], "left").withColumn("chunk", F.coalesce("chunk", F.lit(0))).drop("_unit")


def unit_of() -> Column:
    """What is sampled and packed as one: the trace, or the span alone if its trace id is invalid."""
    return F.when(valid_id(F.col("trace_id"), 16), F.hex("trace_id")).otherwise(F.concat(F.lit("span "), F.col("span_idx").cast("string")))


def packing_summary(packed: DataFrame, sampled_from: DataFrame | None = None) -> DataFrame:
    """Per request: chunks, selected and rejected traces and spans, and bypassed ones (kept by sampling for their invalid id).

    A span with an invalid trace id counts as a trace of its own. With sampled_from, the spans before sampling, also excluded traces and spans.
    """
    gone, odd = F.col("chunk") < 0, ~valid_id(F.col("trace_id"), 16)
    out = packed.withColumn("_unit", unit_of()).groupBy("request_id").agg(
        F.count_distinct(F.when(~gone, F.col("chunk"))).alias("chunks"), F.count_distinct(F.when(~gone, F.col("_unit"))).alias("selected_traces"), F.count_distinct(F.when(gone, F.col("_unit"))).alias("rejected_traces"),
        F.sum((~gone).cast("bigint")).alias("selected_spans"), F.sum(gone.cast("bigint")).alias("rejected_spans"), F.sum(odd.cast("bigint")).alias("bypassed_spans"), F.count_distinct(F.when(odd, F.col("_unit"))).alias("bypassed_traces"),
    )
    if sampled_from is None:
        return out
    before = sampled_from.withColumn("_unit", unit_of()).groupBy("request_id").agg(F.count_distinct("_unit").alias("_traces"), F.count("*").alias("_spans"))
    counts = [c for c in out.columns if c != "request_id"]
    out = before.join(out, "request_id", "left").na.fill(0, counts)
    return out.select("request_id", *counts, (F.col("_traces") - F.col("selected_traces") - F.col("rejected_traces")).alias("excluded_traces"), (F.col("_spans") - F.col("selected_spans") - F.col("rejected_spans")).alias("excluded_spans"))


def ingest_traces(spans: DataFrame, mode: str = "report", attributes: dict[str, str] | None = None, policy: str = "preserve", percentage: float = 100.0, hash_seed: int = 0, max_bytes: int = REQUEST_BYTES) -> DataFrame:
    """Validate, enrich, sample, pack, in this order."""
    rows = spans if mode == "off" else apply_validation(validate_spans(spans), mode)
    rows = enrich_resource(rows, attributes, policy) if attributes else rows
    return pack_traces(sample_traces(rows, percentage, hash_seed), max_bytes)


def derive_trace_response(summary: DataFrame) -> DataFrame:
    """Requests with rejected traces: rejected_spans and a message."""
    message = F.concat(F.col("rejected_traces").cast("string"), F.lit(" traces exceed the size limit"))
    return summary.where("rejected_spans > 0").select("request_id", "rejected_spans", "rejected_traces", message.alias("message"))
