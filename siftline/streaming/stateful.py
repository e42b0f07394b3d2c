"""Order-dependent operators over streams: per-key state, the same results as over a finished table.

Each function takes a streaming DataFrame and gives one for `outputMode("update")` or `append`. State is kept per
key in the state store; within a micro-batch the rows of a key are put in their order first.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from siftline.functions import patterns as P
from siftline.operators.logs import _RECORD, CRI_HEAD, MAX_LINE, cri_fold


def _batch(parts: Iterator[pd.DataFrame], order: list[str]) -> pd.DataFrame:
    return pd.concat(list(parts), ignore_index=True).sort_values(order, kind="stable")


def _schema(df: DataFrame, columns: list[str]) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)


def normalize_resets(points: DataFrame, keys: list[str], value: str, time: str, order: list[str]) -> DataFrame:
    """Streaming form of metrics.normalize_resets for whole-number counters; the state is last value, offset and newest time."""
    columns = points.columns

    def step(key: Any, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, offset, newest = state.get if state.exists else (None, 0, None)
        rows = []
        for row in _batch(parts, order).to_dict("records"):
            if newest is not None and row[time] < newest:
                continue
            raw = int(row[value])
            if last is not None and raw < last:
                offset += last
            last, newest = raw, row[time]
            rows.append(row | {value: raw + offset})
        if last is not None:
            state.update((last, offset, int(newest)))
        yield pd.DataFrame(rows, columns=columns)

    return points.groupBy(*keys).applyInPandasWithState(step, _schema(points, columns), "last long, offset long, newest long", "append", GroupStateTimeout.NoTimeout)


def limit_cardinality(points: DataFrame, target: str, series: str, max_per_target: int, order: list[str]) -> DataFrame:
    """Streaming form of metrics.limit_cardinality: a target's state is the series that it has admitted, max_per_target at most."""
    columns = points.columns

    def step(key: Any, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        admitted = set(state.get[0]) if state.exists else set()
        keep = []
        rows = _batch(parts, order)
        for s in rows[series]:
            if s not in admitted and len(admitted) < max_per_target:
                admitted.add(s)
            keep.append(s in admitted)
        state.update((sorted(admitted),))
        yield rows[keep][columns]

    kind = points.schema[series].dataType.simpleString()
    return points.groupBy(target).applyInPandasWithState(step, _schema(points, columns), f"admitted array<{kind}>", "append", GroupStateTimeout.NoTimeout)


def assemble_multiline(lines: DataFrame, start_pattern: str, max_lines: int = 256, max_bytes: int = MAX_LINE, flush_after_ms: int | None = None) -> DataFrame:
    """Streaming form of logs.assemble_multiline, per path. A pending record is held, or given after flush_after_ms without lines.

    The pattern is used by Python here; one that the batch form refuses is refused too.
    """
    import re

    P.java_pattern(start_pattern, 1024)
    starts = re.compile(start_pattern)
    columns = ["line_no", "offset", "body", "lines", "flush_reason"]
    timeout = GroupStateTimeout.ProcessingTimeTimeout if flush_after_ms else GroupStateTimeout.NoTimeout

    def step(key: Any, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        # pending: the number of its lines is 0 without a record; dropping: up to the next start
        line_no, offset, body, n, dropping = state.get if state.exists else (0, 0, "", 0, False)
        out = []
        if state.hasTimedOut:
            if n:
                out.append((line_no, offset, body, n, "timeout"))
            state.remove()
            yield pd.DataFrame([(key[0], *r) for r in out], columns=["path", *columns])
            return
        for row in _batch(parts, ["line_no"]).to_dict("records"):
            line = row["line"]
            if line is None:
                continue
            size = len(line.encode())
            if size > max_bytes:
                n, body, dropping = 0, "", True
            elif starts.search(line):
                if n:
                    out.append((line_no, offset, body, n, None))
                line_no, offset, body, n, dropping = row["line_no"], row["offset"], line, 1, False
            elif dropping:
                continue
            elif not n:
                line_no, offset, body, n = row["line_no"], row["offset"], line, 1
            elif n + 1 > max_lines or len(body.encode()) + 1 + size > max_bytes:
                n, body, dropping = 0, "", True
            else:
                body, n = body + "\n" + line, n + 1
        state.update((int(line_no), int(offset), body, n, dropping))
        if flush_after_ms:
            state.setTimeoutDuration(flush_after_ms)
        yield pd.DataFrame([(key[0], *r) for r in out], columns=["path", *columns])

    return lines.groupBy("path").applyInPandasWithState(step, "path string, line_no long, offset long, body string, lines long, flush_reason string", "line_no long, offset long, body string, n long, dropping boolean", "append", timeout)


def assemble_cri(fragments: DataFrame, max_bytes: int = MAX_LINE) -> DataFrame:
    """Streaming form of logs.assemble_cri, per path; the pending record is held."""
    fields = ["line_no", "offset", "time_unix_nano", "stream", "body", "parse_error", "partial", "sequence_error"]

    def step(key: Any, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pending, dropping = None, False
        if state.exists:
            line_no, offset, time, stream, body, held, dropping = state.get
            if held:
                pending = {"line_no": line_no, "offset": offset, "time_unix_nano": time, "stream": stream, "body": body, "parse_error": False}
        rows = _batch(parts, ["line_no"])
        rows["_size"] = rows["line"].map(lambda x: len(x.encode()))
        rows = rows[["line_no", "offset", "_size", "time_unix_nano", "stream", "tag", "content", "parse_error"]].astype(object).where(lambda x: x.notna(), None)
        out, pending, dropping = cri_fold(rows.itertuples(index=False), max_bytes, pending, dropping)
        p = pending or {"line_no": 0, "offset": 0, "time_unix_nano": 0, "stream": "", "body": ""}
        state.update((int(p["line_no"]), int(p["offset"]), int(p["time_unix_nano"]), p["stream"], p["body"], pending is not None, dropping))
        found = pd.DataFrame(out, columns=fields).astype({"time_unix_nano": "Int64"})
        found.insert(0, "path", key[0])
        yield found

    return fragments.groupBy("path").applyInPandasWithState(step, f"path string, {_RECORD}", "line_no long, offset long, time long, stream string, body string, held boolean, dropping boolean", "append", GroupStateTimeout.NoTimeout)


def pressure_flag(depth: DataFrame, max_bytes: int, high: float = 0.8, low: float = 0.5, time: str = "at") -> DataFrame:
    """Streaming form of delivery.pressure_flag, per kind: the state is whether the pressure is on."""
    low = low if low < high else high / 2
    columns = depth.columns

    def step(key: Any, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (on,) = state.get if state.exists else (False,)
        rows = _batch(parts, [time])
        flags = []
        for n in rows["bytes"]:
            on = True if n >= high * max_bytes else False if n <= low * max_bytes else on
            flags.append(on)
        state.update((on,))
        yield rows.assign(pressure=flags)[[*columns, "pressure"]]

    return depth.groupBy("kind").applyInPandasWithState(step, _schema(depth, columns) + ", pressure boolean", "is_on boolean", "append", GroupStateTimeout.NoTimeout)


__all__ = ["CRI_HEAD", "assemble_cri", "assemble_multiline", "limit_cardinality", "normalize_resets", "pressure_flag"]
