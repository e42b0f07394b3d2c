"""Sinks of micro-batches: functions for DataStreamWriter.foreachBatch whose batches are written once, however often they run.

A batch's rows go to folders of its number, in place of what an earlier run of the same batch has left there. Readers see the
number as column batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.operators import delivery, traces
from siftline.sources.readers import KINDS

Sink = Callable[[DataFrame, int], None]


def _put(df: DataFrame, path: str, batch_id: int, *by: str) -> None:
    df.write.mode("overwrite").partitionBy(*by).parquet(f"{path}/batch={batch_id}")


def _once(split: Callable[[DataFrame], list[tuple[DataFrame, str, tuple[str, ...]]]]) -> Sink:
    """Each output of a batch is written whole or again; the batch is read once for all of them."""

    def run(batch: DataFrame, batch_id: int) -> None:
        held = batch.persist()
        try:
            for df, path, by in split(held):
                _put(df, path, batch_id, *by)
        finally:
            held.unpersist()

    return run


def by_kind(path: str, quarantine: str, kinds: tuple[str, ...] = KINDS) -> Sink:
    """Rows of known kinds by batch and kind; others, whose failure is permanent, to the quarantine."""
    known = F.coalesce(F.col("kind").isin(*kinds), F.lit(False))
    return _once(lambda df: [(df.where(known), path, ("kind",)), (df.where(~known), quarantine, ())])


def attempts(pending: str, quarantine: str) -> Sink:
    """Delivery attempts (protocol, status, ...): what may be sent again, and what failed for good, which holds up nothing."""

    def split(df: DataFrame) -> list:
        again, never = delivery.split_quarantine(df)
        return [(again, pending, ()), (never, quarantine, ())]

    return _once(split)


def ingested_traces(path: str, responses: str, **options) -> Sink:
    """traces.ingest_traces over each batch: chunks of whole traces (column chunk), and answers to requests with rejected traces.

    A request must lie in one batch, as one file or message does.
    """

    def split(df: DataFrame) -> list:
        packed = traces.ingest_traces(df, **options)
        return [(packed.where("chunk >= 0"), path, ()), (traces.derive_trace_response(traces.packing_summary(packed)), responses, ())]

    return _once(split)
