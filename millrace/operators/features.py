"""From samples to one feature row per cycle, as windows over a cycle's rows and one aggregate: a single shuffle.

Published methods: range masks; truncation of the start transient by the marginal standard error rule (White
1997); one change in mean by the largest between-segment sum of squares (Bai 1994); noise from second
differences; least-squares slopes; trapezoid areas. The same expressions serve a table and, through
``foreachBatch``, a stream's micro-batch of whole cycles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.quality import in_range

FEATURES = [
    "n", "n_rejected", "duration", "mean", "sd", "low", "high", "first", "last", "step_rms", "noise", "slope", "intercept", "residual_sd", "area", "peak_at",
    "transient", "settled_mean", "settled_sd", "onset", "onset_gain", "before", "after", "change", "end_slope", "above_mean",
]


def masked(samples: DataFrame, by: list[str], t: str, y: str, low: Column, high: Column) -> DataFrame:
    """Valid rows (finite, in range) with the time since the cycle's first sample (_t) and the count of its rejected ones (n_rejected)."""
    w = Window.partitionBy(*by)
    ok = in_range(F.col(y).cast("double"), low, high)
    rows = samples.withColumns({"_ok": ok, "n_rejected": F.sum((~ok).cast("long")).over(w), "_t": F.col(t).cast("double") - F.min(F.col(t).cast("double")).over(w)})
    return rows.where("_ok").drop("_ok")


def preprocessed(valid: DataFrame, by: list[str], order: list[str], y: str) -> DataFrame:
    """Adds, for each row of a cycle: position and count, differences, the end of the start transient, and the gain of a change before the row."""
    w, whole = Window.partitionBy(*by).orderBy(*order), Window.partitionBy(*by)
    rest = w.rowsBetween(0, Window.unboundedFollowing)
    v = F.col(y).cast("double")
    rows = valid.withColumns({"_y": v, "_j": F.row_number().over(w) - 1, "_n": F.count("*").over(whole), "_d1": v - F.lag(v).over(w), "_d2": v - 2 * F.lag(v, 1).over(w) + F.lag(v, 2).over(w), "_dt": F.col("_t") - F.lag("_t").over(w), "_py": F.lag(v).over(w), "_m": F.avg(v).over(whole)})
    left = F.col("_n") - F.col("_j")
    d = F.col("_y") - F.col("_m")  # about the mean, so that large offsets cost no digits
    rows = rows.withColumns({"_s1": F.sum(d).over(rest), "_s2": F.sum(d * d).over(rest)})
    rule = (F.col("_s2") / left - F.col("_s1") * F.col("_s1") / (left * left)) / left
    # the rule may cut off half of the cycle at most
    rows = rows.withColumn("transient", F.min(F.when(2 * F.col("_j") <= F.col("_n"), F.struct(F.round(rule, 9).alias("rule"), F.col("_j").alias("j")))).over(whole)["j"])
    rows = rows.withColumn("_in", F.col("_j") >= F.col("transient"))
    total, size = F.sum(F.when(F.col("_in"), d)).over(whole), F.sum(F.col("_in").cast("int")).over(whole)
    rows = rows.withColumns({"_total": total, "_size": size, "_run": F.sum(F.when(F.col("_in"), d).otherwise(0.0)).over(w.rowsBetween(Window.unboundedPreceding, 0)), "_k": F.col("_j") - F.col("transient") + 1})
    off = F.col("_run") - F.col("_k") * F.col("_total") / F.col("_size")
    gain = F.when(F.col("_in") & (F.col("_k") < F.col("_size")), F.round(off * off * F.col("_size") / (F.col("_k") * (F.col("_size") - F.col("_k"))), 9))
    best = F.max(F.when(gain.isNotNull(), F.struct(gain.alias("gain"), (-F.col("_j")).alias("j")))).over(whole)
    return rows.withColumns({"onset": 1 - best["j"], "onset_gain": best["gain"]})


def feature_rows(samples: DataFrame, by: list[str], order: list[str], t: str, y: str, low: Column, high: Column, last: int = 5) -> DataFrame:
    """One row of ``FEATURES`` per cycle that has a valid sample. ``onset``: position of the first row after the change; null in cycles that settle in one row."""
    p = preprocessed(masked(samples, by, t, y, low, high), by, order, y)
    x, v = F.col("_t"), F.col("_y")
    settled, after = F.when(F.col("_in"), v), F.col("_j") >= F.col("onset")
    before_ = F.avg(F.when(F.col("_in") & ~after, v))
    end = F.col("_j") >= F.col("_n") - last
    rows = p.groupBy(*by).agg(
        F.count("*").alias("n"), F.first("n_rejected").alias("n_rejected"), (F.max(x) - F.min(x)).alias("duration"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("sd"), F.min(v).alias("low"), F.max(v).alias("high"),
        F.min_by(v, "_j").alias("first"), F.max_by(v, "_j").alias("last"), F.sqrt(F.avg(F.col("_d1") * F.col("_d1"))).alias("step_rms"), F.sqrt(F.avg(F.col("_d2") * F.col("_d2")) / 6).alias("noise"),
        F.regr_slope(v, x).alias("slope"), F.regr_intercept(v, x).alias("intercept"), F.when(F.count("*") > 2, F.sqrt(F.greatest(F.lit(0.0), (F.regr_syy(v, x) - F.regr_slope(v, x) * F.regr_sxy(v, x)) / F.count("*")))).otherwise(0.0).alias("residual_sd"),
        F.coalesce(F.sum((v + F.col("_py")) / 2 * F.col("_dt")), F.lit(0.0)).alias("area"), F.min_by(x, F.struct((-v).alias("v"), F.col("_j").alias("j"))).alias("peak_at"),
        F.first("transient").cast("long").alias("transient"), F.avg(settled).alias("settled_mean"), F.stddev_pop(settled).alias("settled_sd"), F.first("onset").cast("long").alias("onset"), F.sqrt(F.first("onset_gain")).alias("onset_gain"),
        before_.alias("before"), F.avg(F.when(after, v)).alias("after"), (F.avg(F.when(after, v)) - before_).alias("change"), F.regr_slope(F.when(end, v), F.when(end, x)).alias("end_slope"), F.avg((v > F.col("_m")).cast("double")).alias("above_mean"),
    )
    return rows.select(*by, *FEATURES)


def with_truth(features: DataFrame, truth: DataFrame, by: list[str], names: list[str]) -> DataFrame:
    """Truth columns of the same cycle under the prefix y_; a cycle without truth keeps its features."""
    return features.join(truth.select(*by, *[F.col(c).alias(f"y_{c}") for c in names]), by, "left")
