"""Range checks against a contract, commissioning profiles, reject counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def in_range(value: Column, low: Column, high: Column) -> Column:
    """Finite and inside; a null or NaN value is not."""
    return F.coalesce(~F.isnan(value) & value.between(low, high), F.lit(False))


def range_checked(samples: DataFrame, contract: DataFrame, signal: str = "signal", value: str = "value") -> DataFrame:
    """Adds ``ok``. The contract has one row a signal; it is broadcast, being bounded by the number of signals."""
    limits = F.broadcast(contract.select(F.col("signal").alias(signal), "lo", "hi"))
    return samples.join(limits, signal, "left").withColumn("ok", in_range(F.col(value).cast("double"), F.col("lo"), F.col("hi"))).drop("lo", "hi")


def reject_counts(checked: DataFrame, signal: str = "signal") -> DataFrame:
    return checked.groupBy(signal).agg(F.count("*").alias("n"), F.count_if(~F.col("ok")).alias("n_rejected"))


def first_bad(checked: DataFrame, order: list[str], n: int = 5) -> DataFrame:
    """The first n rejected rows, for an error message."""
    return checked.where(~F.col("ok")).orderBy(*order).limit(n)


def require(df: DataFrame, ok: Column, message: str) -> DataFrame:
    """``df``, failing the job on the first row that is not ok."""
    return df.where(F.when(ok, F.lit(True)).otherwise(F.raise_error(F.lit(message)).cast("boolean")))


def commissioning_profile(checked: DataFrame, signal: str, time: str, value: str, tie: str) -> DataFrame:
    """Per signal: samples, observed rate, whether times never fall, mean, standard deviation, share in range."""
    w = Window.partitionBy(signal).orderBy(tie)
    steps = checked.withColumn("_back", F.coalesce(F.col(time) < F.lag(time).over(w), F.lit(False)))
    span = F.max(time) - F.min(time)
    return steps.groupBy(signal).agg(
        F.count("*").alias("n"),
        F.when(span > 0, (F.count("*") - 1) / span).alias("rate"),
        (~F.bool_or("_back")).alias("monotonic"),
        F.avg(value).alias("mean"),
        F.stddev_pop(value).alias("sd"),
        F.avg(F.col("ok").cast("double")).alias("in_range"),
    )


def commissioning_verdicts(profile: DataFrame, expected_rate: Column, least_in_range: float = 0.99) -> DataFrame:
    issues = F.array_compact(
        F.array(
            F.when(F.col("n") < 2, "dead"),
            F.when(F.col("in_range") < least_in_range, "out_of_range"),
            F.when(~F.col("monotonic"), "time_goes_back"),
            F.when(F.col("rate") < 0.5 * expected_rate, "slow"),
            F.when((F.col("n") > 1) & (F.col("sd") == 0), "constant"),
        )
    )
    return profile.withColumn("issues", issues)


def latency_health(df: DataFrame, latency: str, limit: float) -> DataFrame:
    p99 = F.percentile(latency, F.lit(0.99))
    return df.agg(F.count("*").alias("n"), F.avg(latency).alias("mean"), p99.alias("p99"), F.max(latency).alias("max"), F.count_if(F.col(latency) > limit).alias("n_late"), F.when(p99 > limit, "warn").otherwise("ok").alias("status"))
