"""Join patterns of telemetry: lookups, as-of, interpolation, intervals, delayed labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lookup(df: DataFrame, small: DataFrame, key: str, required: str | None = None) -> DataFrame:
    """N:1 join to a table of one row per key; with ``required``, a miss fails the job. The planner decides on a broadcast by size."""
    out = df.join(small, key, "left")
    if required is None:
        return out
    return out.withColumn(required, F.when(F.col(required).isNull(), F.raise_error(F.concat(F.lit(f"no {required} for "), F.col(key).cast("string")))).otherwise(F.col(required)))


def asof(left: DataFrame, right: DataFrame, by: list[str], time: str, values: list[str], tie: str | None = None) -> DataFrame:
    """Each left row with the latest right row at or before it: one sort of the union instead of a range join."""
    rows = left.withColumn("_side", F.lit(1))
    for v in values:
        rows = rows.withColumn(f"r_{v}", F.lit(None).cast(right.schema[v].dataType))
    other = right.select(*by, time, F.lit(0).alias("_side"), *[F.col(v).alias(f"r_{v}") for v in values], *([F.col(tie)] if tie else []))
    both = rows.unionByName(other.withColumn("_hit", F.lit(True)), allowMissingColumns=True)
    w = Window.partitionBy(*by).orderBy(time, "_side", *([tie] if tie else [])).rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("_hit"), F.struct(*[f"r_{v}" for v in values])), ignorenulls=True).over(w)
    return both.withColumn("_last", last).where("_side = 1").select(*left.columns, *[F.col(f"_last.r_{v}").alias(f"r_{v}") for v in values])


def interpolated(at: DataFrame, series: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """``series`` read linearly at the places of ``at``, held constant beyond its ends."""
    both = at.select(*by, x, F.lit(None).cast("double").alias(y), F.lit(True).alias("_at")).unionByName(series.select(*by, x, F.col(y).cast("double").alias(y), F.lit(False).alias("_at")))
    back = Window.partitionBy(*by).orderBy(F.col(x), F.col("_at")).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*by).orderBy(F.col(x), F.col("_at").desc()).rowsBetween(0, Window.unboundedFollowing)
    point = F.when(~F.col("_at"), F.struct(F.col(x).alias("x"), F.col(y).alias("y")))
    both = both.withColumns({"_a": F.last(point, True).over(back), "_b": F.first(point, True).over(ahead)})
    a, b = F.col("_a"), F.col("_b")
    blend = F.when(a.isNull(), b["y"]).when(b.isNull() | (b["x"] == a["x"]), a["y"]).otherwise(a["y"] + (b["y"] - a["y"]) * (F.col(x) - a["x"]) / (b["x"] - a["x"]))
    return both.where("_at").select(*by, x, blend.alias(y))


def within_intervals(points: DataFrame, intervals: DataFrame, by: list[str], at: str, start: str, end: str, width: float) -> DataFrame:
    """Points joined to the half-open intervals that hold them. Both sides are put into bins of ``width``, so the join is on equality."""
    i = intervals.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))
    p = points.withColumn("_bin", F.floor(F.col(at) / width))
    return p.join(i, [*by, "_bin"]).where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("_bin")


def outside_intervals(points: DataFrame, intervals: DataFrame, by: list[str], key: list[str], at: str, start: str, end: str, width: float) -> DataFrame:
    """Points that no interval holds."""
    return points.join(within_intervals(points, intervals, by, at, start, end, width).select(*key).distinct(), key, "left_anti")


def step_function(cycles: DataFrame, events: DataFrame, by: list[str], cycle: str, values: list[str]) -> DataFrame:
    """All events up to a cycle, applied in order: the last value of each setting."""
    return asof(cycles, events, by, cycle, values)


def visible_labels(decisions: DataFrame, labels: DataFrame, by: list[str], cycle: str, delay: float, value: str) -> DataFrame:
    """For each decision, count and mean of the labels whose cycle is at least ``delay`` earlier: a running sum over the union, no range join."""
    moved = labels.select(*by, (F.col(cycle) + delay).alias(cycle), F.col(value).alias("_v"), F.lit(0).alias("_side"))
    both = decisions.withColumn("_side", F.lit(1)).unionByName(moved, allowMissingColumns=True)
    w = Window.partitionBy(*by).orderBy(cycle, "_side").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumns({"n_labels": F.count("_v").over(w), "mean_label": F.avg("_v").over(w)})
    return seen.where("_side = 1").select(*decisions.columns, "n_labels", "mean_label")


def alias_resolved(df: DataFrame, aliases: DataFrame, name: str, source: str) -> DataFrame:
    """Canonical names by (source, alias); a name without an alias passes through."""
    a = F.broadcast(aliases.select(F.col("source").alias(source), F.col("alias").alias(name), "canonical"))
    return df.join(a, [source, name], "left").withColumn("canonical", F.coalesce("canonical", name))


def at_offset(df: DataFrame, future: DataFrame, by: list[str], cycle: str, step: str, value: Column) -> DataFrame:
    """Forecast rows (origin ``cycle``, ``step``) with the row that came true."""
    realised = future.select(*by, F.col(cycle).alias("_due"), value.alias("realised"))
    return df.withColumn("_due", F.col(cycle) + F.col(step)).join(realised, [*by, "_due"], "left").drop("_due")
