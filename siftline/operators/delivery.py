"""Delivery analytics over tables of envelopes and attempts: kind, id, bytes, captured_at, status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

#: fixed values: answers that make a failure permanent
PERMANENT_HTTP = (400, 413, 422)
PERMANENT_GRPC = ("InvalidArgument", "OutOfRange")


def classify_delivery(protocol: Column, status: Column) -> Column:
    """`permanent` or `transient` for a failed attempt (`http` or `grpc` with its status as text)."""
    http = (protocol == "http") & status.isin(*map(str, PERMANENT_HTTP))
    return F.when(F.coalesce(http | ((protocol == "grpc") & status.isin(*PERMANENT_GRPC)), F.lit(False)), "permanent").otherwise("transient")


def split_quarantine(attempts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What may be sent again, and what failed for good."""
    kind = classify_delivery(F.col("protocol"), F.col("status"))
    return attempts.where(kind == "transient"), attempts.where(kind == "permanent")


def expire(envelopes: DataFrame, now: int, max_age: int = 6 * 3600, column: str = "captured_at") -> DataFrame:
    """Without envelopes captured before now - max_age; a negative age disables."""
    return envelopes if max_age < 0 else envelopes.where(F.col(column) >= now - max_age)


def depth_by_signal(envelopes: DataFrame, max_bytes: int, high: float = 0.8) -> DataFrame:
    """bytes, envelopes and pressure of each kind, and of all (kind null, from the same pass)."""
    out = envelopes.rollup("kind").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("envelopes"), F.grouping("kind").alias("is_total"))
    return out.withColumn("pressure", F.col("bytes") >= high * max_bytes)


def reject_too_large(envelopes: DataFrame, max_bytes: int, per_kind: dict[str, int] | None = None) -> DataFrame:
    """Without envelopes that alone exceed the cap of their kind or of all."""
    cap = F.lit(max_bytes)
    for kind, n in sorted((per_kind or {}).items()):
        cap = F.when(F.col("kind") == kind, F.least(F.lit(n), F.lit(max_bytes))).otherwise(cap)
    return envelopes.where(F.col("bytes") <= cap)


#: ranges of time that a group's rows are cut into
SLOTS = 128


def _slotted(rows: DataFrame, time: str, slots: int) -> DataFrame:
    """Add _slot: the number of the row's range of time; ranges hold about as many rows each. A null time is in the first.

    The cuts, slots - 1 numbers at most, come from one pass over the times, which runs while the plan is built.
    """
    t = F.col(time).cast("bigint")
    cuts = sorted(set(rows.select(F.percentile_approx(t, [k / slots for k in range(1, slots)]).alias("c")).first()["c"] or []))

    def among(low: int, high: int) -> Column:
        middle = (low + high) // 2
        return F.lit(low) if low == high else F.when(t > cuts[middle], among(middle + 1, high)).otherwise(among(low, middle))

    return rows.withColumn("_slot", among(0, len(cuts)))


def _with(rows: DataFrame, facts: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join facts by keys, of which null equals null."""
    renamed = facts.withColumnsRenamed({k: f"_of{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_of{k}"))
    return rows.join(renamed, same, how).drop(*[f"_of{k}" for k in keys])


def _earlier(*by: str) -> WindowSpec:
    return Window.partitionBy(*by).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)


def _last_known(rows: DataFrame, value: Column, by: list[str], order: list[str], slots: int) -> DataFrame:
    """Add _now: the last value that is not null up to each row of its group, in an order that begins with the time.

    A window runs inside one slot of time; the last value of the slots before is carried in, so one group may hold most rows.
    """
    rows = _slotted(rows.withColumn("_value", value), order[0], slots)
    ends = rows.groupBy(*by, "_slot").agg(F.max_by("_value", F.when(F.col("_value").isNotNull(), F.struct(*order))).alias("_end"))
    ends = ends.select(*by, "_slot", F.last("_end", ignorenulls=True).over(_earlier(*by)).alias("_carried"))
    upto = Window.partitionBy(*by, "_slot").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = _with(rows.withColumn("_near", F.last("_value", ignorenulls=True).over(upto)), ends, [*by, "_slot"])
    return rows.withColumn("_now", F.coalesce("_near", "_carried")).drop("_value", "_slot", "_near", "_carried")


def _newest(envelopes: DataFrame, cap: Column, by: list[str], time: str, tie: str, slots: int = SLOTS) -> DataFrame:
    """The longest run of newest envelopes within cap bytes, per group, without one window over all rows.

    Bytes are summed per slot of time; the slot in which the cap is reached is found from those sums, and a
    window runs inside that slot only. One group may hold most rows. A null time is the oldest.
    """
    rows = _slotted(envelopes, time, slots).withColumn("_cap", cap)
    sums = rows.groupBy(*by, "_slot").agg(F.sum("bytes").alias("_n"), F.max("_cap").alias("_c"))
    newer = Window.partitionBy(*by).orderBy(F.desc("_slot")).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_before", F.coalesce(F.sum("_n").over(newer), F.lit(0)))
    sums = sums.select(*by, "_slot", "_before", (F.col("_before") + F.col("_n") <= F.col("_c")).alias("_whole"), (F.col("_before") <= F.col("_c")).alias("_some"))
    rows = _with(rows, sums.where("_some"), [*by, "_slot"])
    inside = Window.partitionBy(*by, "_slot").orderBy(F.desc(time), F.desc(tie)).rowsBetween(Window.unboundedPreceding, 0)
    cut = rows.where("NOT _whole").withColumn("_run", F.col("_before") + F.sum("bytes").over(inside)).where("_run <= _cap")
    return rows.where("_whole").select(*envelopes.columns).union(cut.select(*envelopes.columns))


def retain_newest(envelopes: DataFrame, max_bytes: int, per_kind: dict[str, int] | None = None, time: str = "captured_at", tie: str = "id") -> DataFrame:
    """Evict the oldest: first within each kind to its cap, then over all kinds to max_bytes."""
    rows = envelopes
    if per_kind:
        cap = F.lit(1 << 62)
        for kind, n in sorted(per_kind.items()):
            cap = F.when(F.col("kind") == kind, n).otherwise(cap)
        rows = _newest(rows, cap, ["kind"], time, tie)
    return _newest(rows.withColumn("_all", F.lit(0)), F.lit(max_bytes), ["_all"], time, tie).drop("_all")


def pressure_flag(depth: DataFrame, max_bytes: int, high: float = 0.8, low: float = 0.5, by: list[str] | None = None, time: str = "at", slots: int = SLOTS, tie: str | None = None) -> DataFrame:
    """Add pressure: on from bytes >= high, off from bytes <= low, else as before; off at first.

    A low mark that is not below the high one is moved to half of it. Null bytes change nothing. tie
    orders rows of one kind and time; without it they come in the order of their bytes, null first.
    """
    low = low if low < high else high / 2
    mark = F.when(F.col("bytes") >= high * max_bytes, True).when(F.col("bytes") <= low * max_bytes, False)
    rows = _last_known(depth, mark, by or ["kind"], [time, tie or "bytes"], slots)
    return rows.withColumn("pressure", F.coalesce("_now", F.lit(False))).drop("_now")


#: turns of a pass that one task puts in order
_BLOCK = 1 << 20


def fair_interleave(envelopes: DataFrame, failed: Column | None = None, time: str = "captured_at", tie: str = "id", slots: int = SLOTS, block: int = _BLOCK) -> DataFrame:
    """Add turn and position: round-robin over kinds, first in first out within a kind.

    After the first envelope for which failed holds, a kind gives no more rows in this pass. position orders by turn and kind.
    Rows are numbered inside slots of time and blocks of turns, with the sizes of those before added, so one kind may hold most rows.
    """
    rows = _slotted(envelopes, time, slots)
    sizes = rows.groupBy("kind", "_slot").agg(F.count("*").alias("_n"))
    sizes = sizes.select("kind", "_slot", F.coalesce(F.sum("_n").over(_earlier("kind")), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("kind", "_slot").orderBy(time, tie)
    rows = _with(rows.withColumn("_row", F.row_number().over(inside)), sizes, ["kind", "_slot"])
    rows = rows.withColumn("turn", F.col("_before") + F.col("_row")).drop("_slot", "_row", "_before")
    if failed is not None:
        first = rows.where(failed).groupBy("kind").agg(F.min("turn").alias("_stop"))
        rows = _with(rows, first, ["kind"], "left").where(F.col("_stop").isNull() | (F.col("turn") <= F.col("_stop"))).drop("_stop")
    rows = rows.withColumn("_block", F.floor((F.col("turn") - 1) / block))
    blocks = rows.groupBy("_block").agg(F.count("*").alias("_n"))
    # one row for so many turns
    earlier = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("_block", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    rows = rows.withColumn("_row", F.row_number().over(Window.partitionBy("_block").orderBy("turn", "kind"))).join(blocks, "_block")
    return rows.withColumn("position", F.col("_before") + F.col("_row")).drop("_block", "_row", "_before")


def shed(points: DataFrame, pressure: DataFrame, time: str = "at", slots: int = SLOTS, tie: str | None = None) -> DataFrame:
    """Points (kind, at, ...) with shed: was the pressure (kind, at, pressure) on at the latest change not later than the point?

    Of changes at one time the last by tie, a whole number in pressure, counts; without it one that is on counts.
    """
    names = points.columns
    left = points.select("kind", F.col(time).alias("_t"), F.lit(1).alias("_side"), F.lit(0).cast("bigint").alias("_tie"), F.struct(*names).alias("_p"), F.lit(None).cast("boolean").alias("_on"))
    right = pressure.select("kind", F.col(time).alias("_t"), F.lit(0).alias("_side"), (F.col(tie) if tie else F.col("pressure").cast("int")).cast("bigint").alias("_tie"), F.lit(None).cast(left.schema["_p"].dataType).alias("_p"), F.col("pressure").alias("_on"))
    rows = _last_known(left.union(right), F.col("_on"), ["kind"], ["_t", "_side", "_tie"], slots)
    return rows.where("_side = 1").select("_p.*", F.coalesce("_now", F.lit(False)).alias("shed"))


def rejected_counts(responses: DataFrame, *by: str) -> DataFrame:
    """Records that the receiver refused in part; they are not sent again."""
    return responses.groupBy(*by).agg(F.sum(F.greatest(F.coalesce("rejected", F.lit(0)), F.lit(0))).alias("rejected"), F.count("*").alias("responses"))


def op_counters(flagged: DataFrame, flags: list[str]) -> DataFrame:
    """counter, n: how many rows have each boolean flag set."""
    sums = flagged.agg(*[F.coalesce(F.sum(F.col(f).cast("bigint")), F.lit(0)).alias(f) for f in flags])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(f).alias("counter"), F.col(f).alias("n")) for f in flags])).alias("c")).select("c.*")
