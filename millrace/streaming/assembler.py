"""Cycles assembled from an event-delimited stream of samples; the same rules in batch and in streaming.

A sample row is (press, ts, seq, signal, value, phase): ``phase`` is set on phase events and null on
numeric samples. Numeric samples count while the phase is the collecting one. A cycle is given out when the
phase changes away from it, if it has enough samples. The last value of one numeric signal is held across cycles.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

CYCLES = "press long, cycle long, n long, mean double, low double, held double"


def assemble(samples: DataFrame, collecting: str, held_signal: str, least: int = 2) -> DataFrame:
    """Batch form: windows over each press's rows in order, then one aggregate."""
    w = Window.partitionBy("press").orderBy("ts", "seq")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    rows = samples.withColumns(
        {
            "_phase": F.last("phase", True).over(so_far),
            "_change": F.when(F.col("phase").isNotNull() & ~F.col("phase").eqNullSafe(F.last("phase", True).over(before)), 1).otherwise(0),
            "_held": F.last(F.when(F.col("signal") == held_signal, F.col("value")), True).over(so_far),
        }
    ).withColumn("_epoch", F.sum("_change").over(so_far))
    rows = rows.withColumn("_last", F.max("_epoch").over(Window.partitionBy("press")))
    inside = rows.where((F.col("_phase") == collecting) & F.col("phase").isNull() & (F.col("_epoch") < F.col("_last")))
    out = inside.groupBy("press", "_epoch").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.min("value").alias("low"), F.max_by("_held", F.struct("ts", "seq")).alias("held"))
    return out.where(F.col("n") >= least).select("press", F.col("_epoch").cast("long").alias("cycle"), "n", "mean", "low", "held")


class _Assembler(StatefulProcessor):
    """State per press: phase, epoch, count, count of known values, their sum, least value, held value."""

    def __init__(self, collecting: str, held_signal: str, least: int):
        self.collecting, self.held_signal, self.least = collecting, held_signal, least

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("open", "phase string, epoch long, n long, known long, total double, low double, held double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        phase, epoch, n, known, total, low, held = self.state.get() if self.state.exists() else (None, 0, 0, 0, 0.0, None, None)
        out = []
        batch = pd.concat(list(rows)).sort_values(["ts", "seq"], kind="stable")
        for signal, value, event in zip(batch["signal"], batch["value"], batch["phase"], strict=True):
            if isinstance(event, str):
                if event != phase:
                    if phase == self.collecting and n >= self.least:
                        out.append((key[0], epoch, n, total / known if known else None, low, held))
                    phase, epoch, n, known, total, low = event, epoch + 1, 0, 0, 0.0, None
                continue
            if signal == self.held_signal and not pd.isna(value):
                held = float(value)
            if phase == self.collecting:
                n += 1  # a sample without a value counts as a sample, as in the batch form
                if not pd.isna(value):
                    known, total, low = known + 1, total + float(value), float(value) if low is None else min(low, float(value))
        self.state.update((phase, epoch, n, known, total, low, held))
        yield pd.DataFrame(out, columns=["press", "cycle", "n", "mean", "low", "held"])

    def close(self) -> None:
        pass


def assemble_stream(samples: DataFrame, collecting: str, held_signal: str, least: int = 2) -> DataFrame:
    """Streaming form. Needs the RocksDB state store provider."""
    return samples.groupBy("press").transformWithStateInPandas(statefulProcessor=_Assembler(collecting, held_signal, least), outputStructType=CYCLES, outputMode="Append", timeMode="None")
