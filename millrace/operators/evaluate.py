"""Evaluation of results: recovery, scaled class windows, correlations, consistency bounds, a plain derivative detector."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.numeric import chi2_quantile
from millrace.operators.sequences import savgol


def recovery_pct(actual: Column, baseline: Column, unit: Column, whole: Column) -> Column:
    """What a baseline would have spent more, in ``unit`` each, as a percentage of ``whole``; null where the whole is 0."""
    return F.when(whole != 0, 100 * (baseline - actual) * unit / whole)


def floored_sd(value: str, floor: float) -> Column:
    """Population standard deviation, not below a floor."""
    return F.greatest(F.coalesce(F.stddev_pop(value), F.lit(floor)), F.lit(floor))


def correlations(df: DataFrame, left: list[str], right: list[str]) -> DataFrame:
    """Pearson correlation of every pair in long form (a, b, r), from one aggregate."""
    pairs = [(a, b) for a in left for b in right]
    row = df.agg(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(a, b).alias("r")) for a, b in pairs]).alias("all"))
    return row.select(F.inline("all"))


def scaled_windows(df: DataFrame, by: list[str], position: str, windows: DataFrame, label: str) -> DataFrame:
    """Rows inside their class's window. ``windows``: label, lo, hi as parts of the number of rows of a stream (``by``); half-open."""
    sized = df.withColumn("_n", F.count("*").over(Window.partitionBy(*by)))
    inside = (F.col(position) >= F.col("lo") * F.col("_n")) & (F.col(position) < F.col("hi") * F.col("_n"))
    return sized.join(windows.select(label, "lo", "hi"), label).where(inside).drop("_n", "lo", "hi")


def nis_bounds(size: int, dims: int, level: float = 0.95) -> tuple[float, float]:
    """Two-sided bounds of a mean of ``size`` normalised innovations squared of ``dims`` variables: chi-square quantiles over the size."""
    return tuple(chi2_quantile(q, size * dims) / size for q in ((1 - level) / 2, (1 + level) / 2))


def derivative_onset(df: DataFrame, by: list[str], order: list[str], index: str, y: str, window: int, limit: float) -> DataFrame:
    """Per stream the first row whose causal second derivative lies ``limit`` robust deviations from the stream's median: (by, onset)."""
    rows = savgol(df, by, order, y, window, deriv=2, causal=True, out="_d2").where("_d2 is not null")
    middle = rows.groupBy(*by).agg(F.median("_d2").alias("_m"))
    spread = rows.join(middle, by).withColumn("_off", F.abs(F.col("_d2") - F.col("_m")))
    scale = spread.groupBy(*by).agg(F.median("_off").alias("_mad"))
    return spread.join(scale, by).where(F.col("_off") > limit * 1.4826 * F.col("_mad")).groupBy(*by).agg(F.min(index).alias("onset"))


def fingerprints(df: DataFrame) -> DataFrame:
    """name and sha256 of files read with the ``binaryFile`` source."""
    return df.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("sha256"))
