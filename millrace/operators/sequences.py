"""Ordered operators: differences, slopes, runs, epochs, filters with fixed weights."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _w(by: list[str], order: list[str]) -> Window:
    return Window.partitionBy(*by).orderBy(*order)


def differences(df: DataFrame, by: list[str], order: list[str], y: str) -> DataFrame:
    w = _w(by, order)
    return df.withColumns({"d1": F.col(y) - F.lag(y).over(w), "d2": F.col(y) - 2 * F.lag(y, 1).over(w) + F.lag(y, 2).over(w)})


def trailing_slope(df: DataFrame, by: list[str], order: list[str], x: str, y: str, window: int) -> DataFrame:
    """Least-squares slope over the last ``window`` rows, null until there are so many; x and y are centred on the window's last row."""
    w = _w(by, order).rowsBetween(-(window - 1), 0)
    xs, ys = F.collect_list(F.col(x).cast("double")).over(w), F.collect_list(F.col(y).cast("double")).over(w)
    n = float(window)

    def slope(a: Column, b: Column) -> Column:
        a = F.transform(a, lambda v: v - F.element_at(a, -1))
        b = F.transform(b, lambda v: v - F.element_at(b, -1))
        add = lambda c: F.aggregate(c, F.lit(0.0), lambda p, v: p + v)
        sx, sy = add(a), add(b)
        return F.try_divide(n * add(F.zip_with(a, b, lambda p, q: p * q)) - sx * sy, n * add(F.transform(a, lambda p: p * p)) - sx * sx)

    return df.withColumns({"_xs": xs, "_ys": ys}).withColumn("slope", F.when(F.size("_xs") == window, slope(F.col("_xs"), F.col("_ys")))).drop("_xs", "_ys")


def moving_average(df: DataFrame, by: list[str], order: list[str], y: str, half: int, edge: str = "shrink") -> DataFrame:
    """Centred mean of 2 half + 1 rows. edge: shrink (mean of what is there), zero (pads zeros) or nearest (repeats the ends)."""
    full = 2 * half + 1
    w = _w(by, order)
    total, n = F.sum(y).over(w.rowsBetween(-half, half)), F.count(y).over(w.rowsBetween(-half, half))
    if edge == "shrink":
        return df.withColumn("smooth", total / n)
    if edge == "zero":
        return df.withColumn("smooth", total / full)
    everything = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    i = F.row_number().over(w)
    size = F.count("*").over(everything)
    before, after = F.greatest(half - (i - 1), F.lit(0)), F.greatest(half - (size - i), F.lit(0))
    return df.withColumn("smooth", (total + before * F.first(y).over(everything) + after * F.last(y).over(everything)) / full)


def epochs(df: DataFrame, by: list[str], order: list[str], is_event: Column) -> DataFrame:
    """Running count of events: rows between two events share a number."""
    return df.withColumn("epoch", F.sum(is_event.cast("long")).over(_w(by, order).rowsBetween(Window.unboundedPreceding, 0)))


def islands(df: DataFrame, by: list[str], order: list[str], x: str, above: Column, gap: float, least: int, widen: float = 0.0) -> DataFrame:
    """Runs of rows that satisfy ``above``, split where x jumps by more than ``gap``; short runs dropped; (start, end, n)."""
    up = df.where(above)
    w = _w(by, order)
    new = F.coalesce(F.col(x) - F.lag(x).over(w) > gap, F.lit(True)).cast("int")
    runs = up.withColumn("_new", new).withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = runs.groupBy(*by, "island").agg((F.min(x) - widen).alias("start"), (F.max(x) + widen).alias("end"), F.count("*").alias("n"))
    return out.where(F.col("n") >= least)


def trailing_run(df: DataFrame, by: list[str], index: str, holds: Column, least: int) -> DataFrame:
    """The contiguous run of rows that hold and end at the last row: (run_start, n), if it has ``least`` rows."""
    s = df.groupBy(*by).agg(F.max(index).alias("_last"), F.max(F.when(~holds, F.col(index))).alias("_break"), F.min(index).alias("_first"))
    start = F.coalesce(F.col("_break") + 1, F.col("_first"))
    return s.select(*by, start.alias("run_start"), (F.col("_last") - start + 1).alias("n")).where(F.col("n") >= least)


def first_after(df: DataFrame, by: list[str], index: str, holds: Column, after: int) -> DataFrame:
    return df.where(holds & (F.col(index) >= after)).groupBy(*by).agg(F.min(index).alias("first"))


def settled_at(df: DataFrame, by: list[str], index: str, bad: Column) -> DataFrame:
    """One past the last bad row; the first row if none is."""
    return df.groupBy(*by).agg(F.coalesce(F.max(F.when(bad, F.col(index))) + 1, F.min(index)).alias("settled"))


def every_kth(df: DataFrame, by: list[str], order: list[str], k: int) -> DataFrame:
    return df.withColumn("_i", F.row_number().over(_w(by, order)) - 1).where(F.col("_i") % k == 0).drop("_i")


def evenly_spaced(df: DataFrame, by: list[str], order: list[str], n: int) -> DataFrame:
    """The rows at positions floor(i (N - 1) / (n - 1)) of a group of N, each once."""
    rows = df.withColumn("_i", F.row_number().over(_w(by, order)).cast("long") - 1)
    sizes = df.groupBy(*by).agg(F.count("*").alias("_all"))
    picks = sizes.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).select(*by, F.floor(F.col("_k") * (F.col("_all") - 1) / (n - 1)).alias("_i")).distinct()
    return rows.join(picks, [*by, "_i"], "left_semi").drop("_i")


def durations(df: DataFrame, by: list[str], order: list[str], time: str) -> DataFrame:
    """Time until the next event."""
    return df.withColumn("duration", F.lead(time).over(_w(by, order)) - F.col(time))


def trapezoid_weights(df: DataFrame, by: list[str], x: str) -> DataFrame:
    """Quadrature weights of a grid: half the distance between the neighbours, half a cell at the ends."""
    w = _w(by, [x])
    return df.withColumn("weight", (F.coalesce(F.lead(x).over(w), F.col(x)) - F.coalesce(F.lag(x).over(w), F.col(x))) / 2)


def window_means(df: DataFrame, by: list[str], index: str, value: str, size: int) -> DataFrame:
    """Means over windows that don't overlap; the tail is dropped."""
    out = df.groupBy(*by, F.floor(F.col(index) / size).alias("window")).agg(F.avg(value).alias("mean"), F.count("*").alias("n"))
    return out.where(F.col("n") == size).drop("n")


def thinned(values: Column, step: float) -> Column:
    """Of a descending array: each value at least ``step`` below the last one kept, the first always."""
    none = F.array().cast("array<double>")

    def keep(acc: Column, v: Column) -> Column:
        take = (F.size(acc) == 0) | (F.element_at(acc, -1) - v >= step)
        return F.when(take, F.concat(acc, F.array(v))).otherwise(acc)

    return F.aggregate(F.transform(values, lambda v: v.cast("double")), none, keep)


def thinned_summary(values: Column, step: float) -> Column:
    """How many values ``thinned`` keeps, and the last of them: (n, last), in linear time."""
    begin = F.struct(F.lit(0).alias("n"), F.lit(None).cast("double").alias("last"))

    def keep(acc: Column, v: Column) -> Column:
        take = acc["last"].isNull() | (acc["last"] - v >= step)
        return F.struct((acc["n"] + take.cast("int")).alias("n"), F.when(take, v).otherwise(acc["last"]).alias("last"))

    return F.aggregate(F.transform(values, lambda v: v.cast("double")), begin, keep)


def savgol_weights(window: int, order: int, deriv: int = 0, dx: float = 1.0, at: int | None = None) -> np.ndarray:
    """Weights of a least-squares polynomial read at row ``at`` of the window (its middle unless given)."""
    at = window // 2 if at is None else at
    x = np.arange(window) - at
    fit = np.linalg.pinv(np.vander(x, order + 1, increasing=True))
    return fit[deriv] * float(np.prod(np.arange(1, deriv + 1))) / dx**deriv


def savgol(df: DataFrame, by: list[str], order: list[str], y: str, window: int, poly: int = 2, deriv: int = 0, dx: float = 1.0, causal: bool = False, out: str = "smooth") -> DataFrame:
    """Savitzky-Golay smoothing or derivative as a fixed filter over a row frame.

    Centred, with the ends repeated, or causal, with null for the first window - 1 rows.
    """
    weights = savgol_weights(window, poly, deriv, dx, window - 1 if causal else None)
    w = _w(by, order)
    if causal:
        terms = [F.lag(y, window - 1 - k).over(w) * float(c) for k, c in enumerate(weights)]
    else:
        half = window // 2
        all_ = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        first, last = F.first(y).over(all_), F.last(y).over(all_)
        shift = lambda k: F.coalesce(F.lag(y, -k).over(w), first if k < 0 else last)
        terms = [shift(k - half) * float(c) for k, c in enumerate(weights)]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return df.withColumn(out, total)


def glr_sums(df: DataFrame, by: list[str], order: list[str], residual: str, variance: str, lengths: list[float], h: str) -> DataFrame:
    """Running sums of a matched filter for exponential signatures of several lengths, and the log likelihood ratio of each row.

    Long form: one row per input row and length; the ratio tests "no change" against a change of free amplitude.
    """
    long = df.withColumn("length", F.explode(F.array(*[F.lit(float(x)) for x in lengths])))
    shape = F.exp(-F.col(h) / F.col("length"))
    w = Window.partitionBy(*by, "length").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    long = long.withColumns({"num": F.sum(shape * F.col(residual) / F.col(variance)).over(w), "den": F.sum(shape * shape / F.col(variance)).over(w)})
    return long.withColumn("llr", F.when(F.col("den") > 0, F.greatest(F.col("num"), F.lit(0.0)) * F.greatest(F.col("num"), F.lit(0.0)) / (2 * F.col("den"))).otherwise(0.0))
