"""Metric points: relabelling, counter resets, series budgets and counts.

Points have one row each: name, unit, metric_type, monotonic, resource and attrs (maps of
labels), arrival_seq, time_unix_nano, int_value, float_value, is_float. Operators use the
columns that their docstrings name and keep the others.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.functions import labels as L
from siftline.functions import patterns as P
from siftline.functions.scans import HOT_ROWS, slotted

ACTIONS = ("replace", "keep", "drop", "labeldrop", "labelkeep")


@dataclass(frozen=True)
class Rule:
    """One relabelling rule; the defaults are those of an empty configuration entry."""

    action: str = "replace"
    source_labels: Sequence[str] = ()
    separator: str = ";"
    regex: str = "(.*)"
    target_label: str = ""
    replacement: str = "$1"

    def __post_init__(self):
        if self.action not in ACTIONS:
            raise ValueError(f"unknown relabel action {self.action!r}")
        P.java_pattern(self.regex)


def _joined(rule: Rule) -> Column:
    values = [L.label_get(F.col("name"), F.col("attrs"), F.col("resource"), s) for s in rule.source_labels]
    return F.array_join(F.array(*values), rule.separator) if values else F.lit("")


def relabel(points: DataFrame, rule: Rule) -> DataFrame:
    """Apply one rule to (name, resource, attrs).

    keep and drop filter rows by the joined source labels. replace writes to attrs, or to name where the
    target is `__name__`; an empty result removes the attribute and never the name. labeldrop and
    labelkeep work on attribute names. Null maps read as empty.
    """
    points = points.withColumns({c: F.coalesce(c, F.expr("cast(map() AS map<string,string>)")) for c in ("resource", "attrs")})
    regex = P.anchored(rule.regex)
    if rule.action in ("labeldrop", "labelkeep"):
        hit = lambda k, v: k.rlike(regex) if rule.action == "labelkeep" else ~k.rlike(regex)
        return points.withColumn("attrs", F.map_filter("attrs", hit))
    text = _joined(rule)
    matched = text.rlike(regex)
    if rule.action != "replace":
        return points.where(matched if rule.action == "keep" else ~matched)
    # source text, target and value once each, in a column of their own
    names = points.columns
    points = points.withColumn("_text", text)
    points = points.withColumn("_new", F.when(F.col("_text").rlike(regex), F.struct(P.expand(rule.target_label, F.col("_text"), rule.regex).alias("target"), P.expand(rule.replacement, F.col("_text"), rule.regex).alias("value"))))
    target, value = F.col("_new.target"), F.col("_new.value")
    active = F.col("_new").isNotNull() & (target != "")
    without = F.map_filter("attrs", lambda k, v: k != target)
    attrs = F.when(~active | (target == "__name__"), F.col("attrs")).when(value == "", without).otherwise(F.map_concat(without, F.create_map(target, value)))
    name = F.when(active & (target == "__name__") & (value != ""), value).otherwise(F.col("name"))
    return points.select(*[attrs.alias(c) if c == "attrs" else name.alias(c) if c == "name" else F.col(c) for c in names])


def relabel_chain(points: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Rules in order, each on the labels that those before left."""
    for rule in rules:
        points = relabel(points, rule)
    return points


def process(points: DataFrame, steps: Sequence[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Processors in their order, then the removal of meta labels."""
    for step in steps:
        points = points.transform(step)
    return strip_meta(points)


def strip_meta(points: DataFrame) -> DataFrame:
    """Remove `__meta_*` labels from resource and attrs."""
    plain = lambda k, v: ~k.startswith("__meta_")
    return points.withColumns({c: F.map_filter(c, plain) for c in ("resource", "attrs")})


def normalize_resets(points: DataFrame, keys: Sequence[str], value: str, time: str = "time_unix_nano", order: Sequence[str] | None = None, applies: Column | None = None, max_series: int | None = 1 << 20, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Make monotonic counters continue over resets: column value is replaced, late points are dropped.

    keys identify a series, order is the arrival order (time alone if None; unique within a series for a
    fixed result). A point earlier than the newest one of its series that arrived before is dropped; equal
    times stay. Where a value is below the one before it, the offset grows by the one before. applies
    selects the monotonic sums, all other rows pass unchanged. Series beyond the first max_series to
    arrive pass unchanged too. Integers stay integers; one that would pass 2^63-1 is null. Null times and values pass unchanged.
    A series with more than hot_rows points goes by slots of the first order column: the newest time, the last value and the
    sum of falls of the slots before are carried into each.
    """
    order = list(order or [time])
    applies = F.lit(True) if applies is None else applies
    names = points.columns
    points = points.withColumn("_on", F.coalesce(applies & F.col(value).isNotNull() & F.col(time).isNotNull(), F.lit(False)))
    if max_series is not None:
        points = _tracked(points, keys, order, max_series)
    seen = slotted(points, [*keys, "_on"], order[0], hot_rows=hot_rows).running(order, maxima={"_newest": F.col(time)})
    seen = seen.of(lambda rows: rows.where("NOT _on OR " + f"`{time}` >= _newest")).running(order, before={"_last": F.col(value)})
    fall = F.when(F.col("_on") & (F.col(value) < F.col("_last")), F.col("_last")).otherwise(F.lit(0).cast(points.schema[value].dataType))
    rows = seen.running(order, sums={"_falls": fall}).rows
    return rows.withColumn(value, F.when(F.col("_on"), F.try_add(value, "_falls")).otherwise(F.col(value))).select(*names)


def _tracked(points: DataFrame, keys: Sequence[str], order: Sequence[str], max_series: int) -> DataFrame:
    """_on stays only for the first max_series series to arrive. One row per series is looked at."""
    firsts = points.where("_on").groupBy(*keys).agg(F.min(F.struct(*order)).alias("_first"))
    if firsts.limit(max_series + 1).count() <= max_series:
        return points
    cut = firsts.orderBy("_first").limit(max_series).agg(F.max("_first").alias("_cut"))
    known = firsts.join(F.broadcast(cut), F.col("_first") <= F.col("_cut")).select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.lit(True).alias("_known"))
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    joined = points.join(known, same, "left")
    return joined.withColumn("_on", F.col("_on") & F.coalesce("_known", F.lit(False))).drop("_known", *[f"_k_{k}" for k in keys])


def limit_cardinality(points: DataFrame, target: str, series: str, max_per_target: int, order: Sequence[str] = ("arrival_seq",), max_tracked: int | None = 1 << 20) -> DataFrame:
    """Points of the first max_per_target series of each target, in the order of arrival; zero or less disables.

    Ranks are taken over one row per series, so a hot target stays small. Once max_tracked series have
    been admitted over all targets, a new series of a target with budget left passes without being counted.
    """
    if max_per_target <= 0:
        return points
    firsts = points.groupBy(target, series).agg(F.min(F.struct(*order)).alias("_first"))
    ranked = firsts.withColumn("_rank", F.row_number().over(Window.partitionBy(target).orderBy("_first", series)))
    admitted = ranked.where(F.col("_rank") <= max_per_target)
    if max_tracked is not None and admitted.limit(max_tracked + 1).count() > max_tracked:
        # the budget counts tracked series only: once the tracker is full, targets with budget left stay open
        cut = admitted.orderBy("_first").limit(max_tracked).agg(F.max("_first").alias("_cut"))
        tracked = admitted.join(F.broadcast(cut), F.col("_first") <= F.col("_cut"))
        full = tracked.groupBy(target).agg(F.count("*").alias("_n")).where(F.col("_n") >= max_per_target).select(F.col(target).alias("_full"))
        extra = firsts.join(F.broadcast(cut), F.col("_first") > F.col("_cut")).join(full, F.col(target).eqNullSafe(F.col("_full")), "left_anti")
        admitted = tracked.select(target, series).union(extra.select(target, series))
    admitted = admitted.select(F.col(target).alias("_t"), F.col(series).alias("_s"))
    return points.join(admitted, F.col(target).eqNullSafe(F.col("_t")) & F.col(series).eqNullSafe(F.col("_s")), "left_semi")


def limit_labels(points: DataFrame, max_labels: int) -> DataFrame:
    """Drop points with more labels, of resource and attrs together, than max_labels; zero or less disables."""
    n = lambda c: F.coalesce(F.cardinality(c), F.lit(0))
    return points if max_labels <= 0 else points.where(n(F.col("resource")) + n(F.col("attrs")) <= max_labels)


def count_points(points: DataFrame, *by: str) -> DataFrame:
    """points and series (by series_key) in each group."""
    return points.groupBy(*by).agg(F.count("*").alias("points"), F.count_distinct("series_key").alias("series"))


def normalize_scalar(points: DataFrame, value: str) -> DataFrame:
    """int_value, float_value and is_float from a double column: whole numbers are kept as integers, NaN and infinities dropped."""
    v = F.col(value)
    whole = L.as_integer(v)
    return points.where(L.finite(v)).withColumns({"int_value": whole, "float_value": F.when(whole.isNull(), v), "is_float": whole.isNull()})
