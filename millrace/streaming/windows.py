"""Windowed aggregates with watermarks, and monitors that carry state between micro-batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from millrace.operators.monitor import ewma_path

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def file_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def tumbling(events: DataFrame, time: str, width: str, keys: list[str], value: str, late: str | None = None) -> DataFrame:
    """Count, sum and maximum per window; the same expression in batch and, with a watermark, in streaming."""
    rows = events if late is None else events.withWatermark(time, late)
    return rows.groupBy(F.window(time, width).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.max(value).alias("peak"))


def sliding(events: DataFrame, time: str, width: str, slide: str, keys: list[str], value: str, late: str | None = None) -> DataFrame:
    rows = events if late is None else events.withWatermark(time, late)
    return rows.groupBy(F.window(time, width, slide).alias("w"), *keys).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))


def sessions(events: DataFrame, time: str, gap: str, keys: list[str], value: str, late: str | None = None) -> DataFrame:
    rows = events if late is None else events.withWatermark(time, late)
    return rows.groupBy(F.session_window(time, gap).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))


def mewma_stream(events: DataFrame, key: str, key_type: str, order: list[str], cols: list[str], mean: np.ndarray, cov: np.ndarray, weight: float) -> DataFrame:
    """The multivariate EWMA of ``operators.monitor`` with its vector and step kept as state."""
    inverse, k = np.linalg.pinv(cov), len(cols)

    def step(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        z, t = (np.array(state.get[0]), state.get[1]) if state.exists else (np.zeros(k), 0)
        pdf = pd.concat(list(batches)).sort_values(order, kind="stable")
        x = pdf[cols].to_numpy(float)
        path = ewma_path(np.where(np.isnan(x), mean, x) - mean, weight, z)
        scale = weight / (2 - weight) * (1 - (1 - weight) ** (2.0 * np.arange(t + 1, t + len(x) + 1)))
        out = np.einsum("ij,jk,ik->i", path, inverse, path) / scale
        state.update((path[-1].tolist() if len(path) else z.tolist(), t + len(x)))
        yield pdf[[*order]].assign(**{key: group[0], "mewma": out})[[key, *order, "mewma"]]

    types = dict(events.dtypes)
    schema = f"{key} {key_type}, " + ", ".join(f"{c} {types[c]}" for c in order) + ", mewma double"
    return events.groupBy(key).applyInPandasWithState(step, schema, "z array<double>, t long", "append", GroupStateTimeout.NoTimeout)


def publish(names: set[str], write) -> object:
    """A foreachBatch function that hands on only rows whose name is a known output."""

    def each(batch: DataFrame, epoch: int) -> None:
        write(batch.where(F.col("name").isin(*sorted(names))), epoch)

    return each
