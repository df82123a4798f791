"""Intermediate tables in the shared checkpoint folder, written as Parquet.

A written table cuts lineage, survives the loss of executors, gives the planner real sizes, and is read
back with column pruning. The folder is the one the cluster names in ``spark.checkpoint.dir``; only a
local session without that setting gets a temporary folder of its own.
"""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables; raises on a cluster that names none."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="millrace-")
    spark.conf.set("spark.checkpoint.dir", f"file://{folder}")
    return f"file://{folder}"


ROWS_PER_FILE = 200_000
#: Whole texts go to Python in batches; of the default number of rows, a batch of long ones would be hundreds of megabytes.
ROWS_PER_BATCH, BYTES_PER_BATCH = 1000, 4 << 20
_ROWS, _BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of a session that has the default bounds. It stays so: frames are handed out that run later."""
    if int(spark.conf.get(_ROWS, "10000")) == 10000:
        spark.conf.set(_ROWS, str(ROWS_PER_BATCH))
    if spark.conf.get(_BYTES) == f"{64 << 20}b":
        spark.conf.set(_BYTES, str(BYTES_PER_BATCH))


def release_memory() -> None:
    """At the end of a task's Python function: give freed memory back, as workers are kept for later tasks."""
    gc.collect()
    try:
        import pyarrow

        pyarrow.default_memory_pool().release_unused()
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


def write_table(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write ``df`` once and return a frame that reads the written table.

    ``rows``: about how many narrow rows there are, if that is known; small tables then don't become many tiny files.
    """
    spark = df.sparkSession
    small_batches(spark)
    if rows is not None:
        df = df.coalesce(rows // ROWS_PER_FILE + 1)
    path = f"{shared_dir(spark)}/millrace/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _made.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._millrace_path = path
    return out


def drop_table(df: DataFrame) -> None:
    """Delete a table of ``write_table`` that nothing reads any more."""
    path = getattr(df, "_millrace_path", None)
    if path:
        _delete(df.sparkSession, path)


def tables_made() -> int:
    """A mark for ``drop_since``."""
    return len(_made)


def drop_since(mark: int, *keep: DataFrame) -> None:
    """Delete the tables written since ``mark``, but for ``keep``: what was made from them is stored by now."""
    kept = {getattr(df, "_millrace_path", None) for df in keep}
    for spark, path in [x for x in _made[mark:] if x[1] not in kept]:
        _delete(spark, path)
        _made.remove((spark, path))


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _clean() -> None:
    for spark, path in _made:
        if spark.sparkContext._jsc is not None and spark.sparkContext._gateway is not None:
            try:
                _delete(spark, path)
            except Exception:  # the JVM may be gone before Python ends; the folder's owner cleans up then
                return
