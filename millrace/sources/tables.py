"""Table loading: one place for paths, timestamp types and the NaN policy."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LOCAL_CONF = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true"}


def work_dir(spark: SparkSession) -> str:
    """A new folder in ``spark.checkpoint.dir``; only a local session without that setting gets a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='millrace-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/work/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder and read from there: what is read several times is computed once, and survives lost executors."""
    path = work_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return with_instants(spark.read.parquet(f"{root}/{name}.parquet"))


def with_instants(df: DataFrame) -> DataFrame:
    """Timestamps without zone are read as UTC instants, so that watermarks and epoch arithmetic work."""
    return df.withColumns({f.name: F.to_utc_timestamp(F.col(f.name).cast("timestamp"), F.current_timezone()) for f in df.schema if isinstance(f.dataType, T.TimestampNTZType)})


def seconds(ts: str) -> F.Column:
    """Epoch seconds as a double, to the microsecond."""
    return F.unix_micros(ts) / 1e6


def nan_to_null(df: DataFrame, *names: str) -> DataFrame:
    """NaN marks a value that was not observed; SQL aggregates want a null for that."""
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in names})
