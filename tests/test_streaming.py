"""Streaming forms give what the batch forms give."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import monitor as M
from millrace.plans.streams import samples
from millrace.sources.tables import table
from millrace.streaming import assembler, windows


@pytest.fixture(scope="module")
def split_events(spark, data, tmp_path_factory):
    """The events in six files, in time order."""
    path = str(tmp_path_factory.mktemp("events"))
    e = table(spark, data, "events").select("event_id", "ts", "user_id", "event_type", "value").toPandas().sort_values("ts")
    e["user_id"] = e["user_id"] % 5
    size = -(-len(e) // 6)
    for k, part in enumerate(e[i : i + size] for i in range(0, len(e), size)):
        spark.createDataFrame(part, "event_id long, ts timestamp, user_id long, event_type string, value double").coalesce(1).write.parquet(f"{path}/tmp{k}")
        import glob
        import os
        import time

        os.rename(glob.glob(f"{path}/tmp{k}/part-*.parquet")[0], f"{path}/{k}.parquet")
        os.utime(f"{path}/{k}.parquet", (time.time() - 100 + k, time.time() - 100 + k))
    return path


SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double"


def run(df, tmp, name, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return df.sparkSession.table(name)


def test_assembler(spark, split_events, tmp_path):
    batch = spark.read.schema(SCHEMA).parquet(*[f"{split_events}/{k}.parquet" for k in range(6)])
    want = assembler.assemble(samples(batch), "signup", "purchase").toPandas().sort_values(["press", "cycle"]).reset_index(drop=True)
    stream = windows.file_stream(spark, f"{split_events}/*.parquet", SCHEMA)
    got = run(assembler.assemble_stream(samples(stream), "signup", "purchase"), tmp_path, "assembled").toPandas().sort_values(["press", "cycle"]).reset_index(drop=True)
    assert len(want) > 3 and (got[["press", "cycle", "n"]].to_numpy() == want[["press", "cycle", "n"]].to_numpy()).all()
    for c in ("mean", "low", "held"):
        assert np.allclose(got[c].astype(float), want[c].astype(float), equal_nan=True)


def test_mewma(spark, split_events, tmp_path):
    batch = spark.read.schema(SCHEMA).parquet(*[f"{split_events}/{k}.parquet" for k in range(6)]).withColumn("k", (F.col("event_id") % 7).cast("double"))
    mean, cov = np.array([50.0, 3.0]), np.diag([600.0, 4.0])
    want = M.mewma(batch, ["user_id"], ["ts", "event_id"], ["value", "k"], mean, cov, 0.2).toPandas().set_index("event_id")["mewma"]
    stream = windows.file_stream(spark, f"{split_events}/*.parquet", SCHEMA).withColumn("k", (F.col("event_id") % 7).cast("double"))
    got = run(windows.mewma_stream(stream, "user_id", "long", ["ts", "event_id"], ["value", "k"], mean, cov, 0.2), tmp_path, "mewma").toPandas().set_index("event_id")["mewma"]
    assert len(got) == len(want) and np.allclose(got.sort_index(), want.sort_index())


def test_tumbling_with_watermark(spark, split_events, tmp_path):
    batch = spark.read.schema(SCHEMA).parquet(*[f"{split_events}/{k}.parquet" for k in range(6)])
    want = {(r["w"]["start"], r["event_type"]): r["n"] for r in windows.tumbling(batch, "ts", "12 hours", ["event_type"], "value").collect()}
    stream = windows.file_stream(spark, f"{split_events}/*.parquet", SCHEMA)
    rows = run(windows.tumbling(stream, "ts", "12 hours", ["event_type"], "value", late="1 hour"), tmp_path, "tumbling").collect()
    got = {(r["w"]["start"], r["event_type"]): r["n"] for r in rows}
    assert got and all(want[k] == n for k, n in got.items()) and len(got) > 0.8 * len(want)


def test_late_rows_are_dropped(spark, tmp_path):
    path = str(tmp_path / "late_in")
    for k, stamps in enumerate((["2024-01-01 00:10:00", "2024-01-01 05:00:00"], ["2024-01-01 05:30:00"], ["2024-01-01 00:20:00", "2024-01-01 05:40:00"])):
        spark.createDataFrame([(s, 1.0) for s in stamps], "s string, value double").select(F.to_timestamp("s").alias("ts"), "value").coalesce(1).write.mode("append").parquet(path)
    stream = windows.file_stream(spark, path, "ts timestamp, value double")
    rows = run(windows.tumbling(stream, "ts", "1 hour", [], "value", late="30 minutes"), tmp_path, "late").collect()
    assert [r["n"] for r in rows] == [1]


def test_publish_filters_names(spark):
    out = []
    each = windows.publish({"a"}, lambda df, epoch: out.extend(r["name"] for r in df.collect()))
    each(spark.createDataFrame([("a",), ("b",)], "name string"), 0)
    assert out == ["a"]
