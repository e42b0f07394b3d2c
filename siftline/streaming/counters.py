"""Counts of what operators drop, change or keep, in streams and in finished tables.

`observed` marks a place in a plan; Spark counts there as rows pass, without a pass of its own. A listener adds up what
the micro-batches report: a batch that is run again replaces its counts, so a replay counts nothing twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

from siftline.operators import logs

_PREFIX = "siftline."


def _aggregates(counts: dict[str, Column]) -> list[Column]:
    return [F.coalesce(F.sum(v.cast("bigint")), F.lit(0)).alias(k) for k, v in counts.items()]


def observed(df: DataFrame, operator: str, **counts: Column) -> DataFrame:
    """df, with counts (booleans or whole numbers, null as 0) added up under the operator's name as its rows pass. For streams."""
    return df.observe(_PREFIX + operator, *_aggregates(counts))


def counted(df: DataFrame, operator: str, **counts: Column) -> tuple[DataFrame, Callable[[], dict[str, int]]]:
    """The same for a finished table: df, and a function that gives the counts once an action has run over df."""
    seen = Observation(_PREFIX + operator)
    return df.observe(seen, *_aggregates(counts)), lambda: {k: int(v or 0) for k, v in seen.get.items()}


def watched(df: DataFrame, operator: str, run: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """run(df), with the rows that go in and come out: `rows` of operator.in and of operator.out. Their difference is what a stateful operator
    drops (late points, series over a budget, records over a bound)."""
    one = F.lit(1)
    return observed(run(observed(df, f"{operator}.in", rows=one)), f"{operator}.out", rows=one)


def drop_oversized(lines: DataFrame, max_bytes: int = logs.MAX_LINE) -> DataFrame:
    """logs.drop_oversized; counts lines and dropped under `oversized_lines`."""
    over = F.coalesce(F.octet_length("line") > max_bytes, F.lit(True))
    return logs.drop_oversized(observed(lines, "oversized_lines", lines=F.lit(1), dropped=over), max_bytes)


def parse_cri(lines: DataFrame) -> DataFrame:
    """logs.parse_cri; counts lines and parse_errors under `container_lines`."""
    return observed(logs.parse_cri(lines), "container_lines", lines=F.lit(1), parse_errors=F.col("parse_error"))


def redact(records: DataFrame, patterns: list[str], **options) -> DataFrame:
    """logs.redact; counts records in (`redaction.in`), and records and redactions out (`redaction.out`)."""
    out = logs.redact(observed(records, "redaction.in", rows=F.lit(1)), patterns, **options)
    return observed(out, "redaction.out", rows=F.lit(1), redactions=F.col("redactions"))


class Counters(StreamingQueryListener):
    """Adds up what observed places report. Register with spark.streams.addListener(counters)."""

    def __init__(self) -> None:
        self.batches: dict[tuple[str, int], dict[str, dict[str, int]]] = {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        found = {name.removeprefix(_PREFIX): {k: int(v or 0) for k, v in row.asDict().items()} for name, row in event.progress.observedMetrics.items() if name.startswith(_PREFIX)}
        # by the query's id, which outlives restarts, and the batch: run again, a batch takes the place of its first run
        if found:
            self.batches[str(event.progress.id), event.progress.batchId] = found

    def totals(self) -> dict[tuple[str, str], int]:
        out: dict[tuple[str, str], int] = {}
        for found in list(self.batches.values()):
            for operator, counts in found.items():
                for counter, n in counts.items():
                    out[operator, counter] = out.get((operator, counter), 0) + n
        return out

    def table(self, spark: SparkSession) -> DataFrame:
        """operator, counter, n: a row for each counter there is, few and fixed in number."""
        return spark.createDataFrame([(o, c, n) for (o, c), n in sorted(self.totals().items())], "operator string, counter string, n long")
