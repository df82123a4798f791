"""Aggregations of telemetry. Everything that can be a mergeable sum is one."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.sources.tables import stored


def bin_average(df: DataFrame, by: list[str], x: str, y: str, x_min: float, width: float, bins: int) -> DataFrame:
    """Mean of y per bin of x; values at the upper edge belong to the last bin."""
    k = F.least(F.floor((F.col(x) - x_min) / width), F.lit(bins - 1)).cast("int")
    inside = df.where((F.col(x) >= x_min) & (F.col(x) <= x_min + width * bins))
    return inside.groupBy(*by, k.alias("bin")).agg(F.avg(y).alias("y"), F.count("*").alias("n"))


def filled_bins(binned: DataFrame, by: list[str], bins: int) -> DataFrame:
    """Empty bins filled linearly between their neighbours, held constant beyond the first and last."""
    grid = binned.select(*by).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    full = grid.join(binned, [*by, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    point = F.when(F.col("y").isNotNull(), F.struct("bin", "y"))
    w = Window.partitionBy(*by).orderBy("bin")
    full = full.withColumns({"_a": F.last(point, True).over(w.rowsBetween(Window.unboundedPreceding, 0)), "_b": F.first(point, True).over(w.rowsBetween(0, Window.unboundedFollowing))})
    a, b = F.col("_a"), F.col("_b")
    y = F.when(a.isNull(), b["y"]).when(b.isNull() | (a["bin"] == b["bin"]), a["y"]).otherwise(a["y"] + (b["y"] - a["y"]) * (F.col("bin") - a["bin"]) / (b["bin"] - a["bin"]))
    return full.withColumn("y", y).drop("_a", "_b")


def block_mean(df: DataFrame, by: list[str], index: str, block: int, *values: str) -> DataFrame:
    """Means over blocks of consecutive rows; a last block that isn't full is dropped. ``index`` counts from 0."""
    out = df.groupBy(*by, F.floor(F.col(index) / block).alias("block")).agg(F.count("*").alias("_n"), *[F.avg(v).alias(v) for v in values])
    return out.where(F.col("_n") == block).drop("_n")


def robust_noise_sd(df: DataFrame, by: list[str], order: list[str], y: str) -> DataFrame:
    """Scaled median absolute deviation of second differences; white noise of unit variance gives 1."""
    w = Window.partitionBy(*by).orderBy(*order)
    d2 = df.withColumn("_d2", F.col(y) - 2 * F.lag(y, 1).over(w) + F.lag(y, 2).over(w)).where("_d2 is not null")
    mid = d2.groupBy(*by).agg(F.median("_d2").alias("_m"), F.count("*").alias("n"))
    away = d2.join(mid, by).groupBy(*by).agg(F.median(F.abs(F.col("_d2") - F.col("_m"))).alias("_mad"), F.first("n").alias("n"))
    return away.select(*by, (F.col("_mad") * 1.4826 / F.sqrt(F.lit(6.0))).alias("noise_sd"), "n")


def cycle_summary(df: DataFrame, by: list[str], time: str, value: str, tie: str) -> DataFrame:
    """Mean, minimum, trapezoid integral over time and last value of a signal per cycle."""
    w = Window.partitionBy(*by).orderBy(time, tie)
    area = (F.col(value) + F.lag(value).over(w)) / 2 * (F.col(time) - F.lag(time).over(w))
    return df.withColumn("_area", area).groupBy(*by).agg(F.avg(value).alias("mean"), F.min(value).alias("low"), F.coalesce(F.sum("_area"), F.lit(0.0)).alias("area"), F.max_by(value, F.struct(time, tie)).alias("last"))


def line_fit(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    return df.groupBy(*by).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_count(y, x).alias("n"))


def weighted_line_fit(df: DataFrame, by: list[str], x: str, y: str, weight: Column) -> DataFrame:
    """Least squares with weights on the squared residuals, from five sums."""
    w, a, b = weight, F.col(x), F.col(y)
    s = df.groupBy(*by).agg(F.sum(w).alias("w"), F.sum(w * a).alias("x"), F.sum(w * b).alias("y"), F.sum(w * a * a).alias("xx"), F.sum(w * a * b).alias("xy"))
    slope = F.try_divide(F.col("w") * F.col("xy") - F.col("x") * F.col("y"), F.col("w") * F.col("xx") - F.col("x") * F.col("x"))
    return s.select(*by, slope.alias("slope"), ((F.col("y") - slope * F.col("x")) / F.col("w")).alias("intercept"))


def decay_length(df: DataFrame, by: list[str], x: str, r: str) -> DataFrame:
    """Length of an exponential decay, from a line through log residuals weighted by the residuals."""
    up = df.where(F.col(r) > 0).withColumn("_log", F.log(r))
    fit = weighted_line_fit(up, by, x, "_log", F.col(r))
    return fit.select(*by, F.when(F.col("slope") != 0, -1 / F.col("slope")).alias("length"), F.exp("intercept").alias("amplitude"))


def moments(df: DataFrame, by: list[str], xs: list[str], y: str | None = None) -> DataFrame:
    """Sums for a regression of y on xs with an intercept: X'X, X'y, y'y and n. Mergeable over any partitioning."""
    one = [F.lit(1.0), *[F.col(c).cast("double") for c in xs]]
    sums = [F.sum(one[i] * one[j]).alias(f"x{i}_{j}") for i in range(len(one)) for j in range(i, len(one))]
    if y is not None:
        sums += [F.sum(one[i] * F.col(y)).alias(f"xy{i}") for i in range(len(one))] + [F.sum(F.col(y) * F.col(y)).alias("yy")]
    return df.groupBy(*by).agg(F.count("*").alias("n"), *sums)


def ols(df: DataFrame, by: list[str], xs: list[str], y: str) -> DataFrame:
    """Coefficients (intercept first) and residual root mean square per group; the rows are reduced before Python sees one row a group."""
    k = len(xs) + 1
    schema = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in by) + ", beta array<double>, rms double, n long"

    def solve(batches):
        import pandas as pd

        for b in batches:
            beta, rms = [], []
            for row in b.to_dict("records"):
                xx = np.array([[row[f"x{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
                xy = np.array([row[f"xy{i}"] for i in range(k)])
                fit = np.linalg.lstsq(xx, xy, rcond=1e-12)[0]
                beta.append(fit.tolist())
                rms.append(float(np.sqrt(max(0.0, row["yy"] - 2 * fit @ xy + fit @ xx @ fit) / row["n"])))
            yield pd.DataFrame({**{c: b[c] for c in by}, "beta": beta, "rms": rms, "n": b["n"]})

    return moments(df, by, xs, y).mapInPandas(solve, schema)


def confusion(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Per class: support, recall, precision and F1, from one count per pair of classes."""
    pairs = df.groupBy(F.col(truth).alias("t"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    rows = pairs.groupBy(F.col("t").alias("label")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0)).alias("hits"))
    cols = pairs.groupBy(F.col("p").alias("label")).agg(F.sum("n").alias("predicted"))
    both = rows.join(cols, "label", "full").na.fill(0, ["support", "hits", "predicted"])
    recall, precision = F.try_divide("hits", "support"), F.try_divide("hits", "predicted")
    return both.select("label", "support", "predicted", "hits", recall.alias("recall"), precision.alias("precision"), F.try_divide(2 * F.col("hits"), F.col("support") + F.col("predicted")).alias("f1"))


def confusion_table(df: DataFrame, truth: str, predicted: str, labels: list) -> DataFrame:
    return df.groupBy(truth).pivot(predicted, labels).count().na.fill(0)


def errors(df: DataFrame, by: list[str], truth: str, estimate: str) -> DataFrame:
    e = F.col(estimate) - F.col(truth)
    return df.groupBy(*by).agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.max(F.abs(e)).alias("worst"), F.corr(truth, estimate).alias("r"), F.count("*").alias("n"))


def spread(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Root mean square, median, 5 and 95 percent quantiles of what was observed, and the share that wasn't."""
    v = F.when(~F.isnan(value), F.col(value))
    return df.groupBy(*by).agg(F.sqrt(F.avg(v * v)).alias("rms"), F.median(v).alias("median"), F.percentile(v, F.lit(0.05)).alias("p05"), F.percentile(v, F.lit(0.95)).alias("p95"), F.avg(v.isNull().cast("double")).alias("missing"))


def coverage(df: DataFrame, by: list[str], value: str, low: str, high: str) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(F.col(value).between(F.col(low), F.col(high)).cast("double")).alias("coverage"), F.count("*").alias("n"))


def covariance(df: DataFrame, cols: list[str]) -> tuple[np.ndarray, np.ndarray, int]:
    """Mean, sample covariance and n; the driver gets one row whatever the input."""
    k = len(cols)
    row = df.agg(F.count("*").alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)], *[F.covar_samp(cols[i], cols[j]).alias(f"c{i}_{j}") for i in range(k) for j in range(i, k)]).first()
    cov = np.array([[row[f"c{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)], dtype=float)
    return np.array([row[f"m{i}"] for i in range(k)], dtype=float), cov, row["n"]


def class_moments(df: DataFrame, label: str, cols: list[str], floor: float) -> DataFrame:
    """Per class and feature: mean and variance, the variance not below ``floor``; long form."""
    long = df.select(label, F.explode(F.create_map(*[x for c in cols for x in (F.lit(c), F.col(c).cast("double"))])).alias("feature", "value"))
    return long.groupBy(label, "feature").agg(F.avg("value").alias("mean"), F.greatest(F.coalesce(F.var_samp("value"), F.lit(floor)), F.lit(floor)).alias("var"), F.count("value").alias("n"))


def pooled_variance(per_class: DataFrame) -> DataFrame:
    return per_class.groupBy("feature").agg(F.avg("var").alias("pooled_var"))


def resampled_indices(n: int, draws: int, seed: int) -> Column:
    """Cluster index of draw ``slot`` in replicate ``rep``: a hash, so it is the same everywhere."""
    return F.pmod(F.xxhash64(F.lit(seed), F.col("rep"), F.col("slot")), F.lit(n))


def cluster_bootstrap_mean(df: DataFrame, cluster: str, value: str, draws: int, seed: int = 0, level: float = 0.9) -> DataFrame:
    """Mean with a percentile interval from resampling whole clusters.

    Clusters are reduced to a sum and a count first; replicates are drawn over those, so the rows are read once.
    """
    sums = df.groupBy(cluster).agg(F.sum(value).alias("_s"), F.count(value).alias("_c"))
    sums = sums.withColumn("idx", F.row_number().over(Window.orderBy(F.col(cluster))) - 1)
    n = sums.count()
    spark = df.sparkSession
    slots = spark.range(draws * n).select((F.col("id") / n).cast("long").alias("rep"), (F.col("id") % n).alias("slot"))
    drawn = slots.withColumn("idx", resampled_indices(n, draws, seed)).join(sums.select("idx", "_s", "_c"), "idx").groupBy("rep").agg((F.sum("_s") / F.sum("_c")).alias("m"))
    a = (1 - level) / 2
    ci = drawn.agg(F.percentile("m", F.lit(a)).alias("low"), F.percentile("m", F.lit(1 - a)).alias("high"))
    return df.agg(F.avg(value).alias("mean")).crossJoin(ci)  # one row each


def block_rates(df: DataFrame, by: list[str], index: str, flag: str, size: int) -> DataFrame:
    """Rate of a flag per block of consecutive rows of a stream; the tail beyond whole blocks is dropped."""
    out = df.groupBy(*by, F.floor(F.col(index) / size).alias("block")).agg(F.sum(F.col(flag).cast("long")).alias("hits"), F.count("*").alias("n"))
    return out.where(F.col("n") == size)


def horizon_summary(df: DataFrame, step: str, value: str) -> DataFrame:
    return df.groupBy(step).agg(F.avg(value).alias("mean"), F.median(value).alias("median"), F.percentile(value, F.lit(0.05)).alias("p05"), F.percentile(value, F.lit(0.95)).alias("p95"))


def time_to_limit(df: DataFrame, path: str, step: str, value: str, limit: float) -> DataFrame:
    """Share of paths that reach the limit, and quantiles of the first step at which they do."""
    first = df.groupBy(path).agg(F.min(F.when(F.col(value) >= limit, F.col(step))).alias("ttl"))
    q = [F.percentile("ttl", F.lit(p)).alias(f"p{int(100 * p)}") for p in (0.1, 0.5, 0.9)]
    return first.agg(F.avg(F.col("ttl").isNotNull().cast("double")).alias("share"), *q, F.count("*").alias("n_paths"))


def weighted_quantile(df: DataFrame, by: list[str], value: str, weight: str, q: float) -> DataFrame:
    """The first value at which the running weight reaches the share q."""
    w = Window.partitionBy(*by).orderBy(value)
    run = df.withColumns({"_run": F.sum(weight).over(w), "_all": F.sum(weight).over(Window.partitionBy(*by))})
    return run.where(F.col("_run") >= q * F.col("_all")).groupBy(*by).agg(F.min(value).alias("quantile"))


def block_bootstrap_rate(blocks: DataFrame, draws: int, seed: int = 0, level: float = 0.9) -> tuple[float, float, float]:
    """Rate with a percentile interval from resampling whole blocks (``block_rates``).

    Blocks of one size with equally many hits are alike, so a replicate is a multinomial draw over the counts
    of hits: the driver gets one number for each count, however many blocks there are.
    """
    counts = sorted((r["hits"], r["n"], r["c"]) for r in blocks.groupBy("hits", "n").agg(F.count("*").alias("c")).collect())
    if not counts:
        return float("nan"), float("nan"), float("nan")
    hits, size, c = (np.array(x, dtype=float) for x in zip(*counts, strict=True))
    drawn = np.random.default_rng(seed).multinomial(int(c.sum()), c / c.sum(), draws)
    rates = drawn @ hits / (drawn @ size)
    low, high = np.percentile(rates, [50 * (1 - level), 50 * (1 + level)])
    return float(c @ hits / (c @ size)), float(low), float(high)


def exact_quantiles(df: DataFrame, stats: list[str], probabilities: list[float]) -> list[np.ndarray | None]:
    """The values of rank ceil(p n) of each column, for rising p; None for a column without values.

    A sketch gives a bound a little below the least rank. The different values from there on are counted, dealt by range
    and ranked inside their part, so no task holds a column. Should the bound be too high, everything is ranked.
    """
    xs = [F.col(s).cast("double") for s in stats]
    bound = max(0.0, probabilities[0] - 0.001)
    head = df.agg(*[F.count(x).alias(f"n{i}") for i, x in enumerate(xs)], *[F.percentile_approx(x, bound, 10_000).alias(f"b{i}") for i, x in enumerate(xs)]).first()
    total = [head[f"n{i}"] for i in range(len(xs))]
    ranks = [np.array([min(n, max(1, math.ceil(p * n))) for p in probabilities]) for n in total]
    for bounds in ([head[f"b{i}"] for i in range(len(xs))], [None] * len(xs)):
        kept = F.array(*[x if b is None else F.when(x >= b, x) for x, b in zip(xs, bounds, strict=True)])
        values = df.select(F.posexplode(kept).alias("stat", "value")).where("value is not null").groupBy("stat", "value").agg(F.count("*").alias("n"))
        values = stored(values.repartitionByRange("stat", "value").withColumn("part", F.spark_partition_id()))
        before, seen = {}, [0] * len(xs)
        for r in sorted(values.groupBy("stat", "part").agg(F.sum("n").alias("n")).collect()):  # a row a part, and one more a column
            before[r["stat"], r["part"]] = seen[r["stat"]]
            seen[r["stat"]] += r["n"]
        if all(n == 0 or n - m < r[0] for n, m, r in zip(total, seen, ranks, strict=True)):
            break
    before = {k: m + total[k[0]] - seen[k[0]] for k, m in before.items()}

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, b in batch.groupby(["stat", "part"]):
                upto = b["upto"].to_numpy() + before[key]
                first, end = (np.searchsorted(ranks[key[0]], r, side="right") for r in (upto - b["n"].to_numpy(), upto))
                yield pd.DataFrame({"stat": key[0], "first": first, "end": end, "value": b["value"].to_numpy()})[end > first]

    ranked = values.withColumn("upto", F.sum("n").over(Window.partitionBy("stat", "part").orderBy("value")))
    grids = [np.zeros(len(probabilities)) if n else None for n in total]
    for r in ranked.mapInPandas(pick, "stat int, first int, end int, value double").collect():  # at most a row a probability and column
        grids[r["stat"]][r["first"] : r["end"]] = r["value"]
    return grids


def joint_limits(df: DataFrame, stats: list[str], rate: float, points: int = 1000) -> dict[str, float]:
    """Limits of several statistics at one common quantile, the least at which any of them alarms in at most the wanted share of rows.

    Each statistic's quantiles on a grid are exact, as one rank more or less moves first alarms. A last pass counts
    the level that each row's worst statistic reaches; the common quantile is read from the counts of levels. A null never alarms.
    """
    edges = exact_quantiles(df, stats, [1 - rate + rate * j / points for j in range(points + 1)])
    if any(e is None for e in edges):
        return {}

    @F.pandas_udf("int")
    def level(*columns: pd.Series) -> pd.Series:
        return pd.Series(np.max([np.where(np.isnan(x := c.to_numpy(float)), 0, np.searchsorted(e, x)) for c, e in zip(columns, edges, strict=True)], axis=0))

    counted = {r["level"]: r["n"] for r in df.select(level(*[F.col(s).cast("double") for s in stats]).alias("level")).groupBy("level").agg(F.count("*").alias("n")).collect()}
    beyond = sum(counted.values()) - np.cumsum([counted.get(j, 0) for j in range(points + 1)])  # rows above the grid's j-th point
    at = int(np.argmax(beyond <= rate * sum(counted.values())))
    return {s: float(e[at]) for s, e in zip(stats, edges, strict=True)}
