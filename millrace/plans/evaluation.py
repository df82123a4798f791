"""Queries of evaluation and of the feature store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import evaluate as V
from millrace.operators import sequences as S
from millrace.plans.ordered import _RANKED, BY, ORDER, _ranked
from millrace.plans.registry import query
from millrace.plans.relational import _events
from millrace.sources.store import CycleStore
from millrace.sources.tables import table, work_dir


@query("SELECT l_orderkey, l_linenumber, round(100 * (50 - l_quantity) * l_tax / l_extendedprice, 6) AS recovery FROM lineitem")
def a9_recovery_pct(spark: SparkSession, d: str) -> DataFrame:
    share = V.recovery_pct(F.col("l_quantity"), F.lit(50.0), F.col("l_tax"), F.col("l_extendedprice"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(share, 6).alias("recovery"))


@query("SELECT event_type, round(greatest(stddev_pop(value), 28.8), 6) AS sd FROM events GROUP BY 1")
def a16_floored_sd(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type").agg(F.round(V.floored_sd("value", 28.8), 6).alias("sd"))


@query(
    """WITH e AS (SELECT value, (props->>'k')::DOUBLE AS k, user_id::DOUBLE AS u FROM events)
    SELECT 'value' AS a, 'k' AS b, round(corr(value, k), 6) AS r FROM e UNION ALL SELECT 'value', 'u', round(corr(value, u), 6) FROM e UNION ALL SELECT 'k', 'k', round(corr(k, k), 6) FROM e UNION ALL SELECT 'k', 'u', round(corr(k, u), 6) FROM e"""
)
def a27_correlations(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d).select("value", F.get_json_object("props", "$.k").cast("double").alias("k"), F.col("user_id").cast("double").alias("u"))
    return V.correlations(e, ["value", "k"], ["k", "u"]).select("a", "b", F.round("r", 6).alias("r"))


_WINDOWS = [("click", 0.0, 0.2), ("purchase", 0.3, 0.6), ("error", 0.5, 1.0)]
_WINDOW_ROWS = "(VALUES " + ", ".join(f"('{k}', {a}::DOUBLE, {b}::DOUBLE)" for k, a, b in _WINDOWS) + ") w(event_type, lo, hi)"


@query(f"SELECT event_id, r.event_type FROM (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM {_RANKED}) r JOIN {_WINDOW_ROWS} USING (event_type) WHERE i - 1 >= lo * n AND i - 1 < hi * n")
def f15_scaled_class_windows(spark: SparkSession, d: str) -> DataFrame:
    windows = spark.createDataFrame(_WINDOWS, "event_type string, lo double, hi double")
    rows = _ranked(spark, d).withColumn("i", F.col("i") - 1)
    return V.scaled_windows(rows, BY, "i", windows, "event_type").select("event_id", "event_type")


@query("SELECT regexp_replace(o_orderpriority, '[^A-Za-z0-9_-]', '_', 'g') AS stream, o_orderkey AS cycle, round(o_totalprice + CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END, 4) AS price FROM orders")
def s2_all_streams(spark: SparkSession, d: str) -> DataFrame:
    """Orders go to a store, a third of them again with other values; all streams are read back with their names."""
    store = CycleStore(spark, f"{work_dir(spark)}/store")
    rows = table(spark, d, "orders").select(F.col("o_orderpriority").alias("stream"), F.col("o_orderkey").alias("cycle"), F.col("o_totalprice").alias("price"))
    store.upsert(rows)
    store.upsert(rows.where("cycle % 3 = 0").withColumn("price", F.col("price") + 1))
    return store.read().select("stream", "cycle", F.round("price", 4).alias("price"))


_LOW, _HIGH = V.nis_bounds(6, 1)


@query(f'SELECT user_id, ((i - 1) // 6)::BIGINT AS "window", avg(((value - 50) / 25) ** 2) BETWEEN {_LOW!r}::DOUBLE AND {_HIGH!r}::DOUBLE AS consistent FROM {_RANKED} GROUP BY 1, 2 HAVING count(*) = 6')
def w17_nis_consistency(spark: SparkSession, d: str) -> DataFrame:
    r = _ranked(spark, d).withColumns({"i": F.col("i") - 1, "nis": ((F.col("value") - 50) / 25) * ((F.col("value") - 50) / 25)})
    return S.window_means(r, BY, "i", "nis", 6).select("user_id", "window", F.col("mean").between(_LOW, _HIGH).alias("consistent"))


_WEIGHTS = S.savgol_weights(7, 2, 2, 1.0, 6)


@query(
    f"""WITH f AS (SELECT user_id, i, {" + ".join(f"lag(value, {6 - k}) OVER w * {float(c)!r}::DOUBLE" for k, c in enumerate(_WEIGHTS))} AS d2 FROM {_RANKED} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    m AS (SELECT user_id, median(d2) AS m FROM f WHERE d2 IS NOT NULL GROUP BY 1), o AS (SELECT f.user_id, i, abs(d2 - m) AS off FROM f JOIN m USING (user_id) WHERE d2 IS NOT NULL), s AS (SELECT user_id, median(off) AS mad FROM o GROUP BY 1)
    SELECT o.user_id, min(i) AS onset FROM o JOIN s USING (user_id) WHERE off > 2.5 * 1.4826 * mad GROUP BY 1"""
)
def w19_derivative_onset(spark: SparkSession, d: str) -> DataFrame:
    return V.derivative_onset(_ranked(spark, d), BY, ORDER, "i", "value", 7, 2.5)


@query()
def k4_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    """Of the two smallest tables' files; a file is one row, so this is for configuration."""
    return V.fingerprints(spark.read.format("binaryFile").load([f"{d}/region.parquet", f"{d}/nation.parquet"]))
