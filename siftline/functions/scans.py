"""Running values over ordered groups of which one may hold most of all rows.

A group with more than so many rows is cut into slots, ranges of its order. Sums, maxima and last values are taken inside of each slot;
each slot's total goes into the slots after it. So a group's work is many tasks', and what is carried is a
row per slot. Groups with fewer rows are one slot.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: slots that a large group is cut into, and the rows from which on it is
SLOTS, HOT_ROWS = 128, 1 << 20
#: rows of carried values up to which they go to every task
_BROADCAST = 100_000


def slot_of(value: Column, cuts: list[int]) -> Column:
    """How many of the sorted cuts lie below value, by halving; a null value is in the first slot."""

    def among(low: int, high: int) -> Column:
        middle = (low + high) // 2
        return F.lit(low) if low == high else F.when(value > cuts[middle], among(middle + 1, high)).otherwise(among(low, middle))

    return among(0, len(cuts))


@dataclass(frozen=True)
class Slotted:
    """rows with _key (a struct, so null equals null), _hot and _slot; how many keys are hot; slots of each of them."""

    rows: DataFrame
    n_hot: int
    slots: int

    def of(self, change: Callable[[DataFrame], DataFrame]) -> Slotted:
        """With rows changed, but not their keys and slots."""
        return Slotted(change(self.rows), self.n_hot, self.slots)

    def running(self, order: list[str], sums: dict[str, Column] | None = None, maxima: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None, before: dict[str, Column] | None = None) -> Slotted:
        """More columns, each over its key up to and with the row itself, in order: sums (null counts 0; a whole number beyond
        2^63-1 is null), maxima and lasts (of values that are not null); before: the value of the row before (null for the first)."""
        sums, maxima, lasts, before = (x or {} for x in (sums, maxima, lasts, before))
        sums = {k: F.coalesce(v, F.lit(0)) for k, v in sums.items()}
        before = {k: F.struct(v.alias("v")) for k, v in before.items()}
        inside = Window.partitionBy("_key", "_slot").orderBy(*order)
        upto = inside.rowsBetween(Window.unboundedPreceding, 0)
        near = {k: F.try_sum(v).over(upto) for k, v in sums.items()} | {k: F.max(v).over(upto) for k, v in maxima.items()}
        near |= {k: F.last(v, ignorenulls=True).over(upto) for k, v in lasts.items()} | {k: F.lag(v).over(inside) for k, v in before.items()}
        if not self.n_hot:
            return self.of(lambda rows: rows.withColumns({k: v["v"] if k in before else v for k, v in near.items()}))
        place = F.struct(*order)
        ends = [F.try_sum(v).alias(k) for k, v in sums.items()] + [F.max(v).alias(k) for k, v in maxima.items()]
        ends += [F.max_by(v, F.when(v.isNotNull(), place)).alias(k) for k, v in lasts.items()] + [F.max_by(v, place).alias(k) for k, v in before.items()]
        earlier = Window.partitionBy("_key").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
        carried = {k: F.when(F.count("*").over(earlier) == 0, 0).otherwise(F.try_sum(k).over(earlier)) for k in sums} | {k: F.max(k).over(earlier) for k in maxima}
        carried |= {k: F.last(k, ignorenulls=True).over(earlier) for k in (*lasts, *before)}
        facts = self.rows.where("_hot").groupBy("_key", "_slot").agg(*ends).select("_key", "_slot", *[v.alias(f"_c_{k}") for k, v in carried.items()])
        if self.n_hot * self.slots <= _BROADCAST:
            facts = F.broadcast(facts)
        rows = self.rows.withColumns({f"_n_{k}": v for k, v in near.items()}).join(facts, ["_key", "_slot"], "left")
        n, c = (lambda k: F.col(f"_n_{k}")), (lambda k: F.col(f"_c_{k}"))
        out = {k: F.when(F.col("_hot"), F.try_add(n(k), c(k))).otherwise(n(k)) for k in sums} | {k: F.greatest(n(k), c(k)) for k in maxima}
        out |= {k: F.coalesce(n(k), c(k)) for k in lasts} | {k: F.coalesce(n(k), c(k))["v"] for k in before}
        rows = rows.withColumns(out).drop(*[f"_{x}_{k}" for k in near for x in "nc"])
        return Slotted(rows, self.n_hot, self.slots)


def slotted(rows: DataFrame, keys: list[str], order: str, slots: int = SLOTS, hot_rows: int = HOT_ROWS) -> Slotted:
    """Cut keys with more than hot_rows rows into slots of order, a number or a time; rows of one order are in one slot.

    Up to two passes run while the plan is built: one counts the rows of each key, the other finds the cuts for keys that are hot,
    slots - 1 numbers at most. Results don't depend on the slots.
    """
    rows = rows.withColumn("_key", F.struct(*keys))
    hot = rows.groupBy("_key").agg(F.count("*").alias("_n")).where(F.col("_n") > hot_rows).select("_key", F.lit(True).alias("_hot"))
    n_hot = hot.count()
    if not n_hot or rows.schema[order].dataType.typeName() in ("string", "binary"):
        return Slotted(rows.withColumns({"_hot": F.lit(False), "_slot": F.lit(0)}), 0, slots)
    if n_hot <= _BROADCAST:
        hot = F.broadcast(hot)
    at = F.col(order).cast("bigint")
    cuts = rows.join(hot, "_key", "left_semi").select(F.percentile_approx(at, [k / slots for k in range(1, slots)]).alias("c")).first()["c"]
    rows = rows.join(hot, "_key", "left").withColumn("_hot", F.coalesce("_hot", F.lit(False)))
    return Slotted(rows.withColumn("_slot", F.when(F.col("_hot"), slot_of(at, sorted(set(cuts or [])))).otherwise(0)), n_hot, slots)
