"""Recordings: tag samples (cycle, t, signal, value) as Parquet by signal, in time order within files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_recording(samples: DataFrame, path: str) -> None:
    """Ranges of time go to files of their own, so a scan of some signals over some time reads little, and a hot signal is split."""
    samples.repartitionByRange("signal", "t").sortWithinPartitions("signal", "t").write.partitionBy("signal").parquet(path)


def scan_recording(spark: SparkSession, path: str, signals: list[str] | None = None, start: float | None = None, end: float | None = None) -> DataFrame:
    """Half-open in time; signals prune folders, times are pushed down."""
    df = spark.read.parquet(path).withColumn("signal", F.col("signal").cast("string"))
    if signals is not None:
        df = df.where(F.col("signal").isin(*signals))
    if start is not None:
        df = df.where(F.col("t") >= start)
    return df if end is None else df.where(F.col("t") < end)
