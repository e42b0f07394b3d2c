"""Next-fit packing of ordered records into chunks, also of a stream that holds most of all records.

A stream is cut into slots. What a slot does to the open chunk is a step function: from the bytes that are used when it begins to
those used when it ends, and the chunks begun meanwhile. Steps come from prefix sums; each record's next chunk begins where the
sum passes the limit. The steps of a stream's slots, one row each, are followed from the first to the last; then
every slot numbers its own records.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftline.functions.scans import HOT_ROWS, slotted

REQUEST_BYTES = 3 << 20


def _sorted(table: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """Rows in order, sums of what each adds to an open chunk, and what each takes at the start of a chunk."""
    table = table.sort_by("_order")
    return table, np.cumsum(table["_join"].to_numpy()), table["_fresh"].to_numpy()


def _next(sums: np.ndarray, fresh: np.ndarray, limit: int) -> np.ndarray:
    """For each record that begins a chunk, the one that begins the next."""
    at = np.searchsorted(sums, limit - fresh + sums, "right")
    return np.maximum(at, np.arange(len(sums)) + 1)


def _steps(limit: int) -> Callable:
    """One row per slot. firsts: sums up to the record that may be the first not to fit, with the bytes used and the chunks begun at the slot's end."""

    def run(key, table):
        table, sums, fresh = _sorted(table)
        n, after = len(sums), _next(sums, fresh, limit)
        used, begun = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
        for i in range(n - 1, -1, -1):
            j = after[i]
            used[i], begun[i] = (fresh[i] + sums[-1] - sums[i], 1) if j == n else (used[j], begun[j] + 1)
        # records of no size are never the first not to fit
        firsts = np.flatnonzero((np.concatenate(([0], sums[:-1])) <= limit) & (np.diff(sums, prepend=-1) > 0))
        return pa.table({"_key": table["_key"][:1], "_slot": table["_slot"][:1], "total": [int(sums[-1])], "firsts": [sums[firsts].tolist()], "used": [used[firsts].tolist()], "begun": [begun[firsts].tolist()]})

    return run


def _followed(limit: int) -> Callable:
    """The bytes used and the last chunk's number when each slot of a stream begins; no chunk is open at first."""

    def run(key, table):
        table = table.sort_by("_slot")
        used, chunk, out = limit + 1, -1, []
        for total, firsts, ends, begun in zip(*(table[c].to_pylist() for c in ("total", "firsts", "used", "begun"))):
            out.append((used, chunk))
            k = int(np.searchsorted(firsts, limit - used, "right"))
            if k < len(firsts):
                used, chunk = ends[k], chunk + begun[k]
            else:
                used += total
        return pa.table({"_key": table["_key"], "_slot": table["_slot"], "_used": pa.array([x[0] for x in out], pa.int64()), "_chunk": pa.array([x[1] for x in out], pa.int64())})

    return run


def _numbered(limit: int) -> Callable:
    """Batches of sorted slots, many in one or one over many; _begins marks the first record of each."""

    def run(batches):
        used, chunk = limit + 1, -1
        for x in batches:
            join, fresh, begins = x["_join"].to_numpy(), x["_fresh"].to_numpy(), x["_begins"].to_numpy(zero_copy_only=False)
            n = len(join)
            if not n:
                continue
            sums, out = np.cumsum(join), np.empty(n, np.int32)
            lows = np.union1d(np.flatnonzero(begins), [0])
            highs = np.append(lows[1:], n)
            after = np.minimum(_next(sums, fresh, limit), np.repeat(highs, highs - lows)).tolist()
            upto, firsts = sums.tolist(), fresh.tolist()
            at = pa.array(lows)
            for low, high, new, u, c in zip(lows.tolist(), highs.tolist(), begins[lows].tolist(), x["_used"].take(at).to_pylist(), x["_chunk"].take(at).to_pylist()):
                if new:
                    used, chunk = (limit + 1, -1) if u is None else (u, c)
                i, before = low, upto[low] - int(join[low])
                if used <= limit:
                    i = min(max(int(np.searchsorted(sums, limit - used + before, "right")), low), high)
                    if i > low:
                        out[low:i], used = chunk, used + upto[i - 1] - before
                while i < high:
                    j, chunk = after[i], chunk + 1
                    out[i:j], used = chunk, firsts[i] + upto[j - 1] - upto[i]
                    i = j
            yield pa.RecordBatch.from_arrays([x["_key"], x["_order"], pa.array(out)], names=["_key", "_order", "chunk"])

    return run


def numbered(records: DataFrame, stream: str, order: str, join: str, fresh: str, limit: int, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(stream, order, chunk) of next-fit. join is what a record adds to an open chunk, fresh what it takes as a chunk's first; order is a whole number, unique in its stream."""
    cut = slotted(records.select(stream, F.col(order).cast("bigint").alias("_order"), F.col(join).cast("bigint").alias("_join"), F.col(fresh).cast("bigint").alias("_fresh")), [stream], "_order", hot_rows=hot_rows)
    rows, key = cut.rows.drop(stream), f"_key struct<`{stream}`:{records.schema[stream].dataType.simpleString()}>"
    if cut.n_hot:
        steps = rows.where("_hot").groupBy("_key", "_slot").applyInArrow(_steps(limit), f"{key}, _slot int, total bigint, firsts array<bigint>, used array<bigint>, begun array<bigint>")
        carried = steps.groupBy("_key").applyInArrow(_followed(limit), f"{key}, _slot int, _used bigint, _chunk bigint")
        rows = rows.join(carried, ["_key", "_slot"], "left")
    else:
        rows = rows.withColumns({"_used": F.lit(None).cast("bigint"), "_chunk": F.lit(None).cast("bigint")})
    # streams are sorted and read one after the other: a call for each would take longer than its records where they are many and small
    begins = F.row_number().over(Window.partitionBy("_key", "_slot").orderBy("_order")) == 1
    rows = rows.select("_key", "_slot", "_order", "_join", "_fresh", "_used", "_chunk", begins.alias("_begins")).sortWithinPartitions("_key", "_slot", "_order")
    out = rows.mapInArrow(_numbered(limit), f"{key}, _order bigint, chunk int")
    return out.select(F.col("_key")[stream].alias(stream), F.col("_order").alias(order), "chunk")


def packed(records: DataFrame, stream: str, order: str, size: str, limit: int, rule: str, group: str | None = None, header: str | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Add chunk by next-fit; streams that fit as a whole are chunk 0. A null size is 0.

    rule for a record that fits no chunk: `stop` ends the stream there (chunk -1 from it on), `alone` gives it a chunk of its own.
    """
    bytes_of = F.coalesce(F.col(size), F.lit(0)).cast("bigint")
    sized = records.select(stream, order, bytes_of.alias("_fresh"), bytes_of.alias("_join"), *([F.col(group).alias("_group"), F.coalesce(F.col(header), F.lit(0)).cast("bigint").alias("_head")] if group else []))
    if group:
        cut = slotted(sized, [stream], order, hot_rows=hot_rows).running([order], before={"_last": F.struct(F.col("_group").alias("g"))})
        again = F.col("_last").isNotNull() & F.col("_last.g").eqNullSafe(F.col("_group"))
        sized = cut.rows.select(stream, order, (F.col("_fresh") + F.col("_head")).alias("_fresh"), (F.col("_join") + F.when(again, 0).otherwise(F.col("_head"))).alias("_join"))
    bad = F.min(F.when(F.col("_fresh") > limit, F.col(order))).alias("_stop")
    large = sized.groupBy(stream).agg(F.sum("_join").alias("_total"), bad).where((F.col("_total") > limit) | F.col("_stop").isNotNull()).select(stream, "_stop")
    sized = sized.join(large, stream)
    if rule == "stop":
        sized = sized.withColumn("_dead", F.coalesce(F.col(order) >= F.col("_stop"), F.lit(False)))
        dead = sized.where("_dead").select(stream, order, F.lit(-1).alias("chunk"))
        sized = sized.where("NOT _dead")
    found = numbered(sized, stream, order, "_join", "_fresh", limit, hot_rows)
    found = found.withColumn(order, F.col(order).cast(records.schema[order].dataType))
    found = found.unionByName(dead) if rule == "stop" else found
    return records.join(found, [stream, order], "left").withColumn("chunk", F.coalesce("chunk", F.lit(0)))
