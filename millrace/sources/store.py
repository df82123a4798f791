"""Feature store: Parquet by stream, idempotent upserts by cycle with atomic commits, half-open range scans."""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def safe_name(name: Column) -> Column:
    """Stream names as path parts. Two names can collide."""
    return F.regexp_replace(name, r"[^\p{Alnum}_-]", "_")


class CycleStore:
    """``root/data/version=.../stream=...`` and ``root/commits/<number>.json``, which names every stream's version.

    An upsert rewrites the streams it touches under a new version and publishes them by renaming one complete
    commit file into place, so a reader sees a whole state at all times, and a writer that dies leaves the last
    one. Of two writers that started from one state the second fails. ``vacuum`` deletes what no commit names.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _commits(self) -> list[int]:
        fs, p = self._fs(f"{self.root}/commits")
        return sorted(int(f.getPath().getName()[:-5]) for f in fs.listStatus(p) if f.getPath().getName().endswith(".json")) if fs.exists(p) else []

    def _state(self) -> tuple[int, dict[str, str]]:
        """Number of the last commit, and stream -> version."""
        numbers = self._commits()
        if not numbers:
            return 0, {}
        return numbers[-1], json.loads(self.spark.read.text(f"{self.root}/commits/{numbers[-1]:012}.json", wholetext=True).first()[0])

    def _publish(self, number: int, versions: dict[str, str]) -> None:
        jvm, gateway = self.spark.sparkContext._jvm, self.spark.sparkContext._gateway
        fs, draft = self._fs(f"{self.root}/commits/.{uuid.uuid4().hex}")
        out = fs.create(draft)
        out.write(bytearray(json.dumps(versions, sort_keys=True).encode()))
        out.close()
        final = self._fs(f"{self.root}/commits/{number:012}.json")[1]
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        try:  # a rename that does not overwrite
            context.rename(fs.makeQualified(draft), fs.makeQualified(final), gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Py4JJavaError as e:
            fs.delete(draft, False)
            raise RuntimeError(f"another writer published commit {number} meanwhile; run the upsert again") from e

    def _frame(self, versions: dict[str, str]) -> DataFrame:
        paths = [f"{self.root}/data/version={v}/stream={s}" for s, v in sorted(versions.items())]
        df = self.spark.read.option("mergeSchema", "true").option("basePath", f"{self.root}/data").parquet(*paths).drop("version")
        return df.withColumn("stream", F.col("stream").cast("string"))

    def upsert(self, rows: DataFrame) -> None:
        """Rows of ``(stream, cycle)`` pairs in ``rows`` replace the stored ones; repeats inside ``rows`` stay."""
        number, versions = self._state()
        rows = rows.withColumn("stream", safe_name(F.col("stream")))
        touched = [r[0] for r in rows.select("stream").distinct().collect()]
        if not touched:
            return
        old = {s: versions[s] for s in touched if s in versions}
        if old:
            rows = upserted(self._frame(old), rows, ["stream", "cycle"])
        version = uuid.uuid4().hex
        rows.repartition("stream", F.floor(F.col("cycle") / 1_000_000)).sortWithinPartitions("stream", "cycle").write.partitionBy("stream").parquet(f"{self.root}/data/version={version}")
        self._publish(number + 1, versions | {s: version for s in touched})

    def read(self, stream: str | None = None, columns: list[str] | None = None, cycle_from: int | None = None, cycle_to: int | None = None) -> DataFrame:
        """Only the stream's files, a pushed-down range on cycle, only the columns asked for (and cycle)."""
        versions = self._state()[1]
        if stream is not None:
            name = self.spark.range(1).select(safe_name(F.lit(stream))).first()[0]
            versions = {s: v for s, v in versions.items() if s == name}
        if not versions:
            return self.spark.createDataFrame([], "stream string, cycle long")
        return scan(self._frame(versions), "cycle", cycle_from, cycle_to, None if columns is None else ["stream", "cycle", *[c for c in columns if c not in ("stream", "cycle")]])

    def streams(self) -> list[str]:
        return sorted(self._state()[1])

    def vacuum(self, keep: int = 1) -> None:
        """Delete all commits but the last ``keep``, and the versions that none of these names. Readers of older states must be done."""
        numbers = self._commits()
        fs, data = self._fs(f"{self.root}/data")
        used: set[str] = set()
        for n in numbers[-keep:]:
            used |= set(json.loads(self.spark.read.text(f"{self.root}/commits/{n:012}.json", wholetext=True).first()[0]).values())
        for n in numbers[:-keep]:
            fs.delete(self._fs(f"{self.root}/commits/{n:012}.json")[1], False)
        for f in fs.listStatus(data) if fs.exists(data) else []:
            if f.getPath().getName().removeprefix("version=") not in used:
                fs.delete(f.getPath(), True)


def scan(df: DataFrame, key: str, low: object | None, high: object | None, columns: list[str] | None) -> DataFrame:
    """Half-open range [low, high) on ``key``, then a projection."""
    if low is not None:
        df = df.where(F.col(key) >= F.lit(low))
    if high is not None:
        df = df.where(F.col(key) < F.lit(high))
    return df if columns is None else df.select(*columns)


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def content_hash(df: DataFrame) -> DataFrame:
    """Row count and an order-free hash of a table's content, mergeable over partitions."""
    return df.agg(F.count("*").alias("n_rows"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).cast("string").alias("hash"))


def manifest(df: DataFrame, by: str, fingerprint: str = "") -> str:
    """JSON manifest: rows in all, rows per value of ``by``, content hash."""
    per = {str(r[0]): r[1] for r in df.groupBy(by).count().orderBy(by).collect()}
    h = content_hash(df).first()
    return json.dumps({"rows": h["n_rows"], "per": per, "hash": h["hash"], "fingerprint": fingerprint}, sort_keys=True)


def write_json_log(df: DataFrame, path: str) -> None:
    """One JSON object per row."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("append").text(path)


def markdown(df: DataFrame, digits: int = 3) -> str:
    """A small result as a Markdown table."""
    rows = df.collect()
    show = lambda v: "" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "-|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(show(v) for v in r) + " |" for r in rows])
