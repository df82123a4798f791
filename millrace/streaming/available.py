"""Streams that run until their source is read (``availableNow``), with sink and checkpoint in the folder that all executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.sources.tables import work_dir


def event_stream(spark: SparkSession, d: str) -> DataFrame:
    """The events table as a stream, its times as instants."""
    path = f"{d}/events.parquet"
    rows = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path + "*")
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def run_available(df: DataFrame, mode: str, timeout: int | None = None) -> DataFrame:
    """Run a stream to the end of its source and return what its sink holds: all rows (append), or the last state (complete).

    A batch that runs again overwrites its own folder, so every row is there once.
    """
    folder, last = work_dir(df.sparkSession), [0]

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={epoch}")
        last[0] = epoch

    q = df.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination(timeout) if timeout else q.awaitTermination()
    out = df.sparkSession.read.schema(df.schema).parquet(f"{folder}/out/batch={last[0]}" if mode == "complete" else f"{folder}/out/batch=*")
    return out
