"""Synthetic telemetry: seeded mean-reverting processes per stream, and recordings at several rates."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def cycle_seed(seed: int, *keys: str) -> Column:
    """An independent seed per key."""
    return F.xxhash64(F.lit(seed), *keys)


def mean_reverting(spark: SparkSession, streams: int, steps: int, mean: float, rate: float, sigma: float, seed: int, low: float = -np.inf, high: float = np.inf) -> DataFrame:
    """Ornstein-Uhlenbeck paths, exact in discrete time, clipped: (stream, step, value). A stream is a chain, so it is one Python call; streams are spread over tasks."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        stream = int(pdf["stream"].iloc[0])
        rng = np.random.default_rng([seed, stream])
        a = np.exp(-rate)
        sd = sigma * np.sqrt((1 - a * a) / (2 * rate))
        x, out = mean, np.empty(steps)
        for t, e in enumerate(rng.standard_normal(steps)):
            x = mean + a * (x - mean) + sd * e
            out[t] = x = min(max(x, low), high)
        return pd.DataFrame({"stream": stream, "step": np.arange(steps), "value": out})

    return spark.range(streams).select(F.col("id").alias("stream")).groupBy("stream").applyInPandas(run, "stream long, step long, value double")


def recording(cycles: DataFrame, start: str, duration: str, rates: dict[str, float]) -> DataFrame:
    """Cycles expanded into tag samples: each signal (a column of ``cycles``) at its own rate in hertz: (cycle, t, signal, value)."""
    out = None
    for signal, rate in rates.items():
        ticks = F.sequence(F.lit(0), F.floor(F.col(duration) * rate).cast("int"))
        part = cycles.select("cycle", F.col(start).alias("_t0"), F.col(signal).cast("double").alias("value"), F.explode(ticks).alias("_k"))
        part = part.select("cycle", (F.col("_t0") + F.col("_k") / rate).alias("t"), F.lit(signal).alias("signal"), "value")
        out = part if out is None else out.unionByName(part)
    return out
