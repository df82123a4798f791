"""Queries over the driver's tables: scans, filters, joins, aggregates, set operations, scalars."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions.numeric import clip, dot, log_sum_exp, logistic, normal_cdf, ramp, softmax, temporal_split
from millrace.operators import aggregates as A
from millrace.operators import joins as J
from millrace.operators import quality as Q
from millrace.operators import sequences as S
from millrace.plans.registry import query
from millrace.sources.contract import contract_table, retagged
from millrace.sources.store import safe_name, scan, upserted
from millrace.sources.tables import seconds, table

#: A contract for the event table: one signal per event type.
SIGNALS = {
    "click": {"tag": "ns=1;s=P01.click", "unit": "1", "rate_hz": 1.0, "type": "float", "lo": 0.0, "hi": 60.0, "kind": "input"},
    "purchase": {"tag": "ns=1;s=P01.purchase", "unit": "1", "rate_hz": 1.0, "type": "float", "lo": 10.0, "hi": 90.0, "kind": "input"},
    "view": {"tag": "ns=1;s=P01.view", "unit": "1", "rate_hz": 1.0, "type": "float", "lo": 0.0, "hi": 100.0, "kind": "input"},
    "signup": {"tag": "ns=1;s=P01.signup", "unit": "1", "rate_hz": 0.1, "type": "float", "lo": 5.0, "hi": 50.0, "kind": "input"},
    "error": {"tag": "ns=1;s=P01.error", "unit": "1", "rate_hz": 0.1, "type": "float", "lo": 0.0, "hi": 75.0, "kind": "output"},
}
_LIMITS = "(VALUES " + ", ".join(f"('{k}', {v['lo']}::DOUBLE, {v['hi']}::DOUBLE)" for k, v in SIGNALS.items()) + ") c(signal, lo, hi)"


def _events(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.withColumns({"t": seconds("ts") - 1704067200.0, "signal": F.col("event_type")})


_EVENTS = "(SELECT *, epoch_us(ts) / 1e6 - 1704067200.0 AS t, event_type AS signal FROM events) e"


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey >= 100 AND l_orderkey < 2000")
def s1_range_scan(spark: SparkSession, d: str) -> DataFrame:
    return scan(table(spark, d, "lineitem"), "l_orderkey", 100, 2000, ["l_orderkey", "l_linenumber", "l_quantity"])


@query("SELECT DISTINCT l_returnflag AS stream FROM lineitem")
def s3_list_streams(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_returnflag").alias("stream")).distinct().orderBy("stream")


@query("SELECT p_partkey, regexp_replace(p_name || ' #' || p_brand, '[^A-Za-z0-9_-]', '_', 'g') AS safe FROM part")
def s4_safe_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", safe_name(F.concat("p_name", F.lit(" #"), "p_brand")).alias("safe"))


@query(
    """WITH e AS (SELECT *, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS epoch FROM events)
    SELECT user_id, epoch::BIGINT AS epoch, event_type AS signal, count(*)::BIGINT AS n, round(sum(value), 6) AS total, max(event_id) AS last_id FROM e GROUP BY ALL"""
)
def s7_replay_blocks(spark: SparkSession, d: str) -> DataFrame:
    e = S.epochs(_events(spark, d), ["user_id"], ["ts", "event_id"], F.col("event_type") == "signup")
    return e.groupBy("user_id", "epoch", "signal").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"), F.max("event_id").alias("last_id"))


@query("SELECT signal, CASE WHEN signal = 'error' THEN tag WHEN signal = 'view' THEN 'ns=3;s=X' ELSE replace(tag, 'ns=1;s=P01', 'ns=2;s=P07') END AS tag FROM (VALUES " + ", ".join(f"('{k}', '{v['tag']}')" for k, v in SIGNALS.items()) + ") c(signal, tag)")
def s13_site_tags(spark: SparkSession, d: str) -> DataFrame:
    over = spark.createDataFrame([("view", "ns=3;s=X"), ("error", "ignored")], "signal string, tag string")
    return retagged(contract_table(spark, SIGNALS), r"^ns=1;s=P01", "ns=2;s=P07", over).select("signal", "tag")


_OLD = "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey % 3 <> 0"
_NEW = "SELECT o_orderkey, o_custkey, o_totalprice * 2 AS o_totalprice FROM orders WHERE o_orderkey % 2 = 0"


@query(f"WITH old AS ({_OLD}), new AS ({_NEW}) SELECT o_orderkey, o_custkey, round(o_totalprice, 4) AS price FROM (SELECT * FROM old WHERE o_orderkey NOT IN (SELECT o_orderkey FROM new) UNION ALL SELECT * FROM new)")
def k1_upsert(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    old, new = o.where("o_orderkey % 3 <> 0"), o.where("o_orderkey % 2 = 0").withColumn("o_totalprice", F.col("o_totalprice") * 2)
    return upserted(old, new, ["o_orderkey"]).select("o_orderkey", "o_custkey", F.round("o_totalprice", 4).alias("price"))


@query("SELECT o_orderstatus, count(*)::BIGINT AS n_rows, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def k2_manifest(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n_rows"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT user_id, to_json({'user_id': user_id, 'n': count(*), 'types': list_sort(list(DISTINCT event_type))})::VARCHAR AS entry FROM events GROUP BY user_id")
def k7_json_log(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d).groupBy("user_id").agg(F.count("*").alias("n"), F.sort_array(F.collect_set("event_type")).alias("types"))
    return e.select("user_id", F.to_json(F.struct("user_id", "n", "types")).alias("entry"))


@query(f"SELECT e.event_id, coalesce(e.value BETWEEN c.lo AND c.hi, false) AS ok FROM {_EVENTS} LEFT JOIN {_LIMITS} USING (signal)")
def f1_range_check(spark: SparkSession, d: str) -> DataFrame:
    return Q.range_checked(_events(spark, d), contract_table(spark, SIGNALS)).select("event_id", "ok")


@query(f"SELECT event_id, value FROM {_EVENTS} LEFT JOIN {_LIMITS} USING (signal) WHERE NOT coalesce(value BETWEEN lo AND hi, false) ORDER BY event_id LIMIT 5")
def f2_first_bad_rows(spark: SparkSession, d: str) -> DataFrame:
    return Q.first_bad(Q.range_checked(_events(spark, d), contract_table(spark, SIGNALS)), ["event_id"]).select("event_id", "value")


@query("SELECT event_id, (props->>'k')::BIGINT AS k, event_type IN ('click', 'view', 'signup', 'error', 'purchase', 'scroll') AND length(event_type) > 0 AND (props->>'k') IS NOT NULL AS valid FROM events")
def f3_record_validation(spark: SparkSession, d: str) -> DataFrame:
    record = F.from_json("props", "k long", {"mode": "FAILFAST"})
    valid = F.col("event_type").isin("click", "view", "signup", "error", "purchase", "scroll") & (F.length("event_type") > 0) & F.col("r.k").isNotNull()
    return _events(spark, d).withColumn("r", record).select("event_id", F.col("r.k").alias("k"), valid.alias("valid"))


@query("SELECT event_id, value FROM events WHERE event_id % 7 = 0")
def f5_stride_filter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").where(F.col("event_id") % 7 == 0).select("event_id", "value")


@query("SELECT event_id, event_type FROM events WHERE event_type IN ('click', 'purchase')")
def f6_membership_filter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").where(F.col("event_type").isin("click", "purchase")).select("event_id", "event_type")


@query(
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events)
    SELECT DISTINCT user_id, event_id FROM r, range(10) k(k) WHERE i = (k * (n - 1)) // 9"""
)
def f7_evenly_spaced_rows(spark: SparkSession, d: str) -> DataFrame:
    return S.evenly_spaced(_events(spark, d), ["user_id"], ["ts", "event_id"], 10).select("user_id", "event_id")


@query("SELECT event_id, value FROM events ORDER BY md5('42:' || event_id), event_id LIMIT 500")
def f8_seeded_sample(spark: SparkSession, d: str) -> DataFrame:
    """Without replacement, by a hash of the key and the seed: the same rows wherever and however often it runs."""
    place = F.md5(F.concat(F.lit("42:"), F.col("event_id").cast("string")).cast("binary"))
    return table(spark, d, "events").withColumn("_u", place).orderBy("_u", "event_id").limit(500).select("event_id", "value")


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events) WHERE i % 4 = 0")
def f9_every_kth_row(spark: SparkSession, d: str) -> DataFrame:
    return S.every_kth(_events(spark, d), ["user_id"], ["ts", "event_id"], 4).select("user_id", "event_id")


@query("SELECT l_orderkey, l_linenumber, round(50.0 - l_quantity, 6) AS h FROM lineitem WHERE 50.0 - l_quantity >= 12.5")
def f10_horizon_filter(spark: SparkSession, d: str) -> DataFrame:
    h = F.lit(50.0) - F.col("l_quantity")
    return table(spark, d, "lineitem").where(h >= 12.5).select("l_orderkey", "l_linenumber", F.round(h, 6).alias("h"))


_FLASH = [(100000.0, 200000.0), (900000.0, 950000.0), (1500000.0, 1800000.0)]


@query(f"SELECT event_id FROM {_EVENTS} WHERE t > 50000 AND " + " AND ".join(f"NOT (t >= {a} AND t < {b})" for a, b in _FLASH))
def f11_gate_outside_windows(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d).where("t > 50000")
    flash = spark.createDataFrame([("all", a, b) for a, b in _FLASH], "k string, a double, b double")
    return J.outside_intervals(e.withColumn("k", F.lit("all")), flash, ["k"], ["event_id"], "t", "a", "b", 250000.0).select("event_id")


@query(
    """WITH r AS (SELECT event_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::DOUBLE / count(*) OVER (PARTITION BY user_id) AS s FROM events)
    SELECT event_id, CASE WHEN s < 0.6::DOUBLE THEN 'train' WHEN s < 0.6::DOUBLE + 0.05::DOUBLE THEN NULL WHEN s < 0.6::DOUBLE + 0.05::DOUBLE + 0.2::DOUBLE THEN 'calibrate' WHEN s < 0.6::DOUBLE + 2 * 0.05::DOUBLE + 0.2::DOUBLE THEN NULL ELSE 'test' END AS split FROM r"""
)
def f12_split_with_embargo(spark: SparkSession, d: str) -> DataFrame:
    i = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    e = _events(spark, d).withColumns({"_i": i.cast("double"), "_n": F.count("*").over(Window.partitionBy("user_id"))})
    return e.select("event_id", temporal_split(F.col("_i"), F.col("_n"), 0.6, 0.2, 0.05).alias("split"))


@query("SELECT o_orderkey AS cycle, o_totalprice AS y_price, o_orderstatus AS y_status FROM orders")
def f13_truth_prefix(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus").withColumnsRenamed({"o_orderkey": "cycle", "o_totalprice": "y_price", "o_orderstatus": "y_status"})


@query("SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge, least(greatest(l_quantity, 10.0), 40.0)::DOUBLE AS clamped, l_extendedprice / l_quantity AS unit_price FROM lineitem")
def f14_derived_columns(spark: SparkSession, d: str) -> DataFrame:
    charge = F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", charge.alias("charge"), clip(F.col("l_quantity"), 10.0, 40.0).alias("clamped"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_price"))


@query("SELECT o_orderkey, c_name, n_name, r_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def j1_lookup_chain(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    o = J.lookup(o, table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey"), "c_custkey")
    nation = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("c_nationkey"), "n_name", "r_name")
    return J.lookup(o, nation, "c_nationkey", required="n_name").select("o_orderkey", "c_name", "n_name", "r_name")


@query("SELECT event_id, CASE WHEN user_id % 2 = 0 AND event_type = 'click' THEN 'press' WHEN user_id % 2 = 1 AND event_type = 'view' THEN 'look' ELSE event_type END AS canonical FROM events")
def j3_alias_names(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d).withColumn("source", F.when(F.col("user_id") % 2 == 0, "even").otherwise("odd"))
    aliases = spark.createDataFrame([("even", "click", "press"), ("odd", "view", "look")], "source string, alias string, canonical string")
    return J.alias_resolved(e, aliases, "event_type", "source").select("event_id", "canonical")


@query(
    """WITH a AS (SELECT user_id, event_id, ts, value FROM events WHERE event_type = 'click'), b AS (SELECT user_id, ts, arg_max(value, event_id) AS value FROM events WHERE event_type = 'purchase' GROUP BY ALL)
    SELECT a.event_id, round(b.value, 6) AS last_value FROM a ASOF LEFT JOIN b ON a.user_id = b.user_id AND a.ts >= b.ts"""
)
def j12_asof_last_event(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d)
    out = J.asof(e.where("event_type = 'click'"), e.where("event_type = 'purchase'"), ["user_id"], "ts", ["value"], "event_id")
    return out.select("event_id", F.round("r_value", 6).alias("last_value"))


@query(
    f"""WITH a AS (SELECT user_id, event_id, t FROM {_EVENTS} WHERE event_type = 'click'), s AS (SELECT user_id, t, avg(value) AS value FROM {_EVENTS} WHERE event_type = 'view' GROUP BY ALL),
    lo AS (SELECT a.*, s.t AS t0, s.value AS v0 FROM a ASOF LEFT JOIN s ON a.user_id = s.user_id AND a.t >= s.t), hi AS (SELECT a.event_id, s.t AS t1, s.value AS v1 FROM a ASOF LEFT JOIN s ON a.user_id = s.user_id AND a.t <= s.t)
    SELECT DISTINCT user_id, round(t, 6) AS t, round(CASE WHEN t0 IS NULL THEN v1 WHEN t1 IS NULL OR t1 = t0 THEN v0 ELSE v0 + (v1 - v0) * (t - t0) / (t1 - t0) END, 6) AS value FROM lo JOIN hi USING (event_id)"""
)
def j5_interpolating_asof(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d)
    series = e.where("event_type = 'view'").groupBy("user_id", "t").agg(F.avg("value").alias("value"))
    at = e.where("event_type = 'click'").select("user_id", "t").distinct()
    return J.interpolated(at, series, ["user_id"], "t", "value").select("user_id", F.round("t", 6).alias("t"), F.round("value", 6).alias("value"))


@query(
    """WITH d AS (SELECT user_id, event_id FROM events WHERE event_type = 'click'), l AS (SELECT user_id, event_id + 200 AS due, value FROM events WHERE event_type = 'purchase')
    SELECT d.event_id, count(l.value)::BIGINT AS n_labels, round(avg(l.value), 6) AS mean_label FROM d LEFT JOIN l ON d.user_id = l.user_id AND l.due <= d.event_id GROUP BY d.event_id"""
)
def j8_delayed_labels(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d).select("user_id", "event_id", "event_type", "value")
    out = J.visible_labels(e.where("event_type = 'click'").drop("value"), e.where("event_type = 'purchase'"), ["user_id"], "event_id", 200, "value")
    return out.select("event_id", "n_labels", F.round("mean_label", 6).alias("mean_label"))


@query(
    f"""WITH f AS (SELECT user_id, min(t) FILTER (value > 80) AS alarm, min(t) FILTER (value > 95) AS breach FROM {_EVENTS} GROUP BY user_id)
    SELECT user_id, round(breach - alarm, 3) AS lead FROM f WHERE alarm IS NOT NULL AND breach IS NOT NULL"""
)
def j10_alarm_to_breach(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d)
    alarm = e.where("value > 80").groupBy("user_id").agg(F.min("t").alias("alarm"))
    breach = e.where("value > 95").groupBy("user_id").agg(F.min("t").alias("breach"))
    return alarm.join(breach, "user_id").select("user_id", F.round(F.col("breach") - F.col("alarm"), 3).alias("lead"))


@query("SELECT a.l_orderkey, a.l_linenumber AS origin, s.step, round(b.l_quantity, 4) AS realised FROM lineitem a CROSS JOIN (SELECT unnest([1, 2, 3])::INT AS step) s LEFT JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + s.step")
def j11_forecast_join(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    origins = li.select("l_orderkey", "l_linenumber", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("step"))
    out = J.at_offset(origins, li, ["l_orderkey"], "l_linenumber", "step", F.col("l_quantity"))
    return out.select("l_orderkey", F.col("l_linenumber").alias("origin"), "step", F.round("realised", 4).alias("realised"))


_FAULTS = [(1, "drift", 100000.0, 600000.0, 0.5), (2, "step", 400000.0, 900000.0, 1.5), (3, "drift", 1200000.0, 2000000.0, 2.0)]
_FAULT_ROWS = "(VALUES " + ", ".join(f"({i}, '{k}', {a}::DOUBLE, {b}::DOUBLE, {s}::DOUBLE)" for i, k, a, b, s in _FAULTS) + ") f(id, kind, a, b, severity)"


@query(f"SELECT event_id, round(sum(severity), 6) AS total, max(severity) AS worst, count(*)::BIGINT AS n FROM {_EVENTS} JOIN {_FAULT_ROWS} ON t >= a AND t < b GROUP BY event_id")
def j13_interval_overlap(spark: SparkSession, d: str) -> DataFrame:
    faults = spark.createDataFrame([("all", *f) for f in _FAULTS], "k string, id int, kind string, a double, b double, severity double")
    hits = J.within_intervals(_events(spark, d).withColumn("k", F.lit("all")), faults, ["k"], "t", "a", "b", 250000.0)
    return hits.groupBy("event_id").agg(F.round(F.sum("severity"), 6).alias("total"), F.max("severity").alias("worst"), F.count("*").alias("n"))


@query("SELECT event_id, CASE WHEN value < 10 THEN 'start' WHEN value < 50 THEN 'body' WHEN value < 90 THEN 'tail' ELSE 'end' END AS region FROM events")
def j15_band_join(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("value")
    return table(spark, d, "events").select("event_id", F.when(v < 10, "start").when(v < 50, "body").when(v < 90, "tail").otherwise("end").alias("region"))


@query(f"SELECT signal, count(*)::BIGINT AS n, count(*) FILTER (NOT coalesce(value BETWEEN lo AND hi, false))::BIGINT AS n_rejected FROM {_EVENTS} LEFT JOIN {_LIMITS} USING (signal) GROUP BY signal")
def a10_reject_counts(spark: SparkSession, d: str) -> DataFrame:
    return Q.reject_counts(Q.range_checked(_events(spark, d), contract_table(spark, SIGNALS)))


@query(
    f"""WITH g AS (SELECT user_id, unnest(range(30))::INT AS bin FROM (SELECT DISTINCT user_id FROM events WHERE ts IS NOT NULL)),
    b AS (SELECT user_id, least(floor(t / 86400.0), 29)::INT AS bin, avg(value) AS y, count(*) AS n FROM {_EVENTS} WHERE t >= 0 AND t <= 2592000 GROUP BY ALL),
    lo AS (SELECT g.user_id, g.bin, b.bin AS b0, b.y AS y0, b.n AS n0 FROM g ASOF LEFT JOIN b ON g.user_id = b.user_id AND g.bin >= b.bin), hi AS (SELECT g.user_id, g.bin, b.bin AS b1, b.y AS y1 FROM g ASOF LEFT JOIN b ON g.user_id = b.user_id AND g.bin <= b.bin)
    SELECT user_id, bin, round(CASE WHEN b0 IS NULL THEN y1 WHEN b1 IS NULL OR b1 = b0 THEN y0 ELSE y0 + (y1 - y0) * (bin - b0) / (b1 - b0) END, 6) AS y, (CASE WHEN b0 = bin THEN n0 ELSE 0 END)::BIGINT AS n FROM lo JOIN hi USING (user_id, bin)"""
)
def a1_bin_resample(spark: SparkSession, d: str) -> DataFrame:
    binned = A.bin_average(_events(spark, d), ["user_id"], "t", "value", 0.0, 86400.0, 30)
    return A.filled_bins(binned, ["user_id"], 30).select("user_id", "bin", F.round("y", 6).alias("y"), "n")


@query(
    """WITH a AS (SELECT user_id, value - 2 * lag(value, 1) OVER w + lag(value, 2) OVER w AS d2 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    m AS (SELECT user_id, median(d2) AS m, count(*) AS n FROM a WHERE d2 IS NOT NULL GROUP BY 1)
    SELECT a.user_id, round(median(abs(d2 - m)) * 1.4826 / sqrt(6.0), 6) AS noise_sd, any_value(n)::BIGINT AS n FROM a JOIN m USING (user_id) WHERE d2 IS NOT NULL GROUP BY 1"""
)
def a2_robust_noise(spark: SparkSession, d: str) -> DataFrame:
    return A.robust_noise_sd(_events(spark, d), ["user_id"], ["ts", "event_id"], "value").select("user_id", F.round("noise_sd", 6).alias("noise_sd"), "n")


@query(
    """WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events)
    SELECT user_id, (i // 8)::BIGINT AS block, round(avg(value), 6) AS value FROM r GROUP BY 1, 2 HAVING count(*) = 8"""
)
def a3_block_mean(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d).withColumn("i", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1)
    return A.block_mean(e, ["user_id"], "i", 8, "value").select("user_id", "block", F.round("value", 6).alias("value"))


@query(
    f"""WITH s AS (SELECT *, (value + lag(value) OVER w) / 2 * (t - lag(t) OVER w) AS area FROM {_EVENTS} WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id))
    SELECT user_id, round(avg(value), 6) AS mean, round(min(value), 6) AS low, round(coalesce(sum(area), 0.0) / 3600, 3) AS energy, round(arg_max(value, (t, event_id)), 6) AS last FROM s GROUP BY user_id"""
)
def a4_cycle_summary(spark: SparkSession, d: str) -> DataFrame:
    s = A.cycle_summary(_events(spark, d), ["user_id"], "t", "value", "event_id")
    return s.select("user_id", F.round("mean", 6).alias("mean"), F.round("low", 6).alias("low"), F.round(F.col("area") / 3600, 3).alias("energy"), F.round("last", 6).alias("last"))


@query("SELECT l_suppkey, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept, regr_count(l_extendedprice, l_quantity)::BIGINT AS n FROM lineitem GROUP BY 1")
def a5_line_fit(spark: SparkSession, d: str) -> DataFrame:
    f = A.line_fit(table(spark, d, "lineitem"), ["l_suppkey"], "l_quantity", "l_extendedprice")
    return f.select("l_suppkey", F.round("slope", 4).alias("slope"), F.round("intercept", 3).alias("intercept"), "n")


@query(
    """WITH s AS (SELECT l_suppkey, sum(w) AS w, sum(w * x) AS x, sum(w * y) AS y, sum(w * x * x) AS xx, sum(w * x * y) AS xy FROM (SELECT l_suppkey, l_extendedprice AS w, l_quantity AS x, ln(l_extendedprice) AS y FROM lineitem WHERE l_extendedprice > 0) GROUP BY 1)
    SELECT l_suppkey, round(-1 / ((w * xy - x * y) / (w * xx - x * x)), 3) AS length FROM s"""
)
def a6_decay_length(spark: SparkSession, d: str) -> DataFrame:
    return A.decay_length(table(spark, d, "lineitem"), ["l_suppkey"], "l_quantity", "l_extendedprice").select("l_suppkey", F.round("length", 3).alias("length"))


@query(
    """SELECT l_returnflag, count(*)::BIGINT AS n, round(sum(l_quantity), 2) AS x0_1, round(sum(l_quantity * l_quantity), 2) AS x1_1, round(sum(l_quantity * l_discount), 4) AS x1_2, round(sum(l_discount * l_discount), 6) AS x2_2,
    round(sum(l_extendedprice), 2) AS xy0, round(sum(l_quantity * l_extendedprice), 1) AS xy1, round(sum(l_discount * l_extendedprice), 2) AS xy2 FROM lineitem GROUP BY 1"""
)
def a7_regression_moments(spark: SparkSession, d: str) -> DataFrame:
    m = A.moments(table(spark, d, "lineitem"), ["l_returnflag"], ["l_quantity", "l_discount"], "l_extendedprice")
    digits = {"x0_1": 2, "x1_1": 2, "x1_2": 4, "x2_2": 6, "xy0": 2, "xy1": 1, "xy2": 2}
    return m.select("l_returnflag", "n", *[F.round(c, k).alias(c) for c, k in digits.items()])


@query(
    """WITH c AS (SELECT l_returnflag AS g, count(*) AS n, avg(l_quantity) AS m1, avg(l_discount) AS m2, avg(l_tax) AS m3, avg(l_extendedprice) AS my, var_pop(l_quantity) AS a, covar_pop(l_quantity, l_discount) AS b, covar_pop(l_quantity, l_tax) AS c, var_pop(l_discount) AS d, covar_pop(l_discount, l_tax) AS e, var_pop(l_tax) AS f,
        covar_pop(l_quantity, l_extendedprice) AS u, covar_pop(l_discount, l_extendedprice) AS v, covar_pop(l_tax, l_extendedprice) AS w, var_pop(l_extendedprice) AS vy FROM lineitem GROUP BY 1),
    i AS (SELECT *, a * (d * f - e * e) - b * (b * f - c * e) + c * (b * e - c * d) AS det FROM c),
    s AS (SELECT *, ((d * f - e * e) * u + (c * e - b * f) * v + (b * e - c * d) * w) / det AS b1, ((c * e - b * f) * u + (a * f - c * c) * v + (b * c - a * e) * w) / det AS b2, ((b * e - c * d) * u + (b * c - a * e) * v + (a * d - b * b) * w) / det AS b3 FROM i)
    SELECT g AS l_returnflag, round(my - b1 * m1 - b2 * m2 - b3 * m3, 3) AS b0, round(b1, 3) AS b1, round(b2, 3) AS b2, round(b3, 3) AS b3, round(sqrt(vy - b1 * u - b2 * v - b3 * w), 3) AS rms, n::BIGINT AS n FROM s"""
)
def a7_multivariate_ols(spark: SparkSession, d: str) -> DataFrame:
    fit = A.ols(table(spark, d, "lineitem"), ["l_returnflag"], ["l_quantity", "l_discount", "l_tax"], "l_extendedprice")
    return fit.select("l_returnflag", *[F.round(F.col("beta")[i], 3).alias(f"b{i}") for i in range(4)], F.round("rms", 3).alias("rms"), "n")


@query("SELECT o_orderpriority, round(avg(o_totalprice), 4) AS mean, round(1000 * avg((o_totalprice > 200000)::INT), 4) AS per_thousand, round(quantile_cont(o_totalprice, 0.5), 4) AS p50, round(quantile_cont(o_totalprice, 0.99), 4) AS p99, count(*)::BIGINT AS n FROM orders GROUP BY 1")
def a8_scenario_summary(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("o_totalprice")
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(F.round(F.avg(p), 4).alias("mean"), F.round(1000 * F.avg((p > 200000).cast("double")), 4).alias("per_thousand"), F.round(F.median(p), 4).alias("p50"), F.round(F.percentile(p, F.lit(0.99)), 4).alias("p99"), F.count("*").alias("n"))


_GUESS = "CASE WHEN value > 66 THEN 'click' WHEN value > 33 THEN 'view' ELSE event_type END"


@query(
    f"""WITH e AS (SELECT event_type AS t, {_GUESS} AS p FROM events), r AS (SELECT t AS label, count(*) AS support, count(*) FILTER (t = p) AS hits FROM e GROUP BY 1), c AS (SELECT p AS label, count(*) AS predicted FROM e GROUP BY 1)
    SELECT label, coalesce(support, 0)::BIGINT AS support, coalesce(predicted, 0)::BIGINT AS predicted, round(hits / support, 6) AS recall, round(hits / predicted, 6) AS "precision", round(2 * hits / (coalesce(support, 0) + coalesce(predicted, 0)), 6) AS f1 FROM r FULL JOIN c USING (label)"""
)
def a11_confusion_metrics(spark: SparkSession, d: str) -> DataFrame:
    c = A.confusion(table(spark, d, "events").withColumn("guess", F.expr(_GUESS)), "event_type", "guess")
    return c.select("label", "support", "predicted", *[F.round(x, 6).alias(x) for x in ("recall", "precision", "f1")])


@query("SELECT event_type, round(sqrt(avg((user_id - value) ** 2)), 6) AS rmse, round(avg(abs(user_id - value)), 6) AS mae, round(max(abs(user_id - value)), 6) AS worst, round(corr(value, user_id), 6) AS r FROM events GROUP BY 1")
def a12_error_metrics(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("u", F.col("user_id").cast("double"))
    return A.errors(e, ["event_type"], "value", "u").select("event_type", *[F.round(c, 6).alias(c) for c in ("rmse", "mae", "worst", "r")])


@query("SELECT event_type, round(sqrt(avg(v * v)), 6) AS rms, round(median(v), 6) AS median, round(quantile_cont(v, 0.05), 6) AS p05, round(quantile_cont(v, 0.95), 6) AS p95, round(avg((v IS NULL)::INT), 6) AS missing FROM (SELECT event_type, CASE WHEN event_id % 11 <> 0 THEN value END AS v FROM events) GROUP BY 1")
def a13_spread_of_observed(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("v", F.when(F.col("event_id") % 11 != 0, F.col("value")).otherwise(F.lit(float("nan"))))
    return A.spread(e, ["event_type"], "v").select("event_type", *[F.round(c, 6).alias(c) for c in ("rms", "median", "p05", "p95", "missing")])


@query("SELECT round(avg(l_quantity), 6) AS m, round(covar_samp(l_quantity, l_extendedprice), 3) AS c01, round(covar_samp(l_quantity, l_discount), 6) AS c02, round(stddev_pop(l_quantity), 6) AS sd, round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem")
def a15_mean_covariance(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").agg(F.round(F.avg("l_quantity"), 6).alias("m"), F.round(F.covar_samp("l_quantity", "l_extendedprice"), 3).alias("c01"), F.round(F.covar_samp("l_quantity", "l_discount"), 6).alias("c02"), F.round(F.stddev_pop("l_quantity"), 6).alias("sd"), F.round(F.corr("l_quantity", "l_extendedprice"), 6).alias("r"))


@query(
    """WITH l AS (SELECT event_type, 'value' AS feature, value AS x FROM events UNION ALL SELECT event_type, 'k', (props->>'k')::DOUBLE FROM events), c AS (SELECT event_type, feature, avg(x) AS mean, greatest(coalesce(var_samp(x), 1e-3), 1e-3) AS var, count(x) AS n FROM l GROUP BY 1, 2)
    SELECT event_type, feature, round(mean, 6) AS mean, round(var, 5) AS var, n::BIGINT AS n, round(avg(var) OVER (PARTITION BY feature), 5) AS pooled FROM c"""
)
def a17_class_moments(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("double"))
    c = A.class_moments(e, "event_type", ["value", "k"], 1e-3)
    return c.join(A.pooled_variance(c), "feature").select("event_type", "feature", F.round("mean", 6).alias("mean"), F.round("var", 5).alias("var"), "n", F.round("pooled_var", 5).alias("pooled"))


@query()
def a18_cluster_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    return A.cluster_bootstrap_mean(table(spark, d, "events"), "user_id", "value", draws=200, seed=1)


@query(
    """WITH r AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, value > 90 AS flag FROM events)
    SELECT user_id, (i // 10)::BIGINT AS block, sum(flag::BIGINT)::BIGINT AS hits, count(*)::BIGINT AS n FROM r GROUP BY 1, 2 HAVING count(*) = 10"""
)
def a19_block_rates(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d).withColumns({"i": F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1, "flag": F.col("value") > 90})
    return A.block_rates(e, ["user_id"], "i", "flag", 10)


@query("SELECT count(*)::BIGINT AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.99), 6) AS p99, round(max(value), 6) AS max, count(*) FILTER (value > 200)::BIGINT AS n_late, CASE WHEN quantile_cont(value, 0.99) > 200 THEN 'warn' ELSE 'ok' END AS status FROM events")
def a21_latency_health(spark: SparkSession, d: str) -> DataFrame:
    h = Q.latency_health(table(spark, d, "events"), "value", 200.0)
    return h.select("n", *[F.round(c, 6).alias(c) for c in ("mean", "p99", "max")], "n_late", "status")


@query(
    f"""WITH c AS (SELECT *, coalesce(value BETWEEN lo AND hi, false) AS ok, coalesce(t < lag(t) OVER (PARTITION BY signal ORDER BY event_id), false) AS back FROM {_EVENTS} LEFT JOIN {_LIMITS} USING (signal)),
    p AS (SELECT signal, count(*) AS n, (count(*) - 1) / (max(t) - min(t)) AS rate, NOT bool_or(back) AS monotonic, avg(value) AS mean, stddev_pop(value) AS sd, avg(ok::INT) AS in_range FROM c GROUP BY 1)
    SELECT signal, n::BIGINT AS n, round(rate, 9) AS rate, monotonic, round(mean, 6) AS mean, round(sd, 6) AS sd, round(in_range, 6) AS in_range, CASE WHEN in_range < 0.99 THEN 'out_of_range' ELSE '' END || CASE WHEN NOT monotonic THEN ',time_goes_back' ELSE '' END || CASE WHEN rate < 0.00025 THEN ',slow' ELSE '' END AS issues FROM p"""
)
def a22_commissioning(spark: SparkSession, d: str) -> DataFrame:
    checked = Q.range_checked(_events(spark, d), contract_table(spark, SIGNALS))
    p = Q.commissioning_verdicts(Q.commissioning_profile(checked, "signal", "t", "value", "event_id"), F.lit(0.0005))
    issues = F.concat(*[F.when(F.array_contains("issues", k), (("," if i else "") + k)).otherwise("") for i, k in enumerate(["out_of_range", "time_goes_back", "slow"])])
    return p.select("signal", "n", F.round("rate", 9).alias("rate"), "monotonic", *[F.round(c, 6).alias(c) for c in ("mean", "sd", "in_range")], issues.alias("issues"))


@query("SELECT l_linenumber AS step, round(avg(l_extendedprice), 4) AS mean, round(median(l_extendedprice), 4) AS median, round(quantile_cont(l_extendedprice, 0.05), 4) AS p05, round(quantile_cont(l_extendedprice, 0.95), 4) AS p95 FROM lineitem GROUP BY 1")
def a24_horizon_summary(spark: SparkSession, d: str) -> DataFrame:
    h = A.horizon_summary(table(spark, d, "lineitem"), "l_linenumber", "l_extendedprice")
    return h.select(F.col("l_linenumber").alias("step"), *[F.round(c, 4).alias(c) for c in ("mean", "median", "p05", "p95")])


@query(
    """WITH f AS (SELECT l_orderkey, min(l_linenumber) FILTER (l_quantity >= 45) AS ttl FROM lineitem GROUP BY 1)
    SELECT round(avg((ttl IS NOT NULL)::INT), 6) AS share, round(quantile_cont(ttl, 0.1), 6) AS p10, round(quantile_cont(ttl, 0.5), 6) AS p50, round(quantile_cont(ttl, 0.9), 6) AS p90, count(*)::BIGINT AS n_paths FROM f"""
)
def a25_time_to_limit(spark: SparkSession, d: str) -> DataFrame:
    t = A.time_to_limit(table(spark, d, "lineitem"), "l_orderkey", "l_linenumber", "l_quantity", 45)
    return t.select(*[F.round(c, 6).alias(c) for c in ("share", "p10", "p50", "p90")], "n_paths")


@query(
    """WITH r AS (SELECT l_returnflag, l_extendedprice AS v, sum(l_quantity) OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) AS run, sum(l_quantity) OVER (PARTITION BY l_returnflag) AS total FROM lineitem)
    SELECT l_returnflag, round(min(v), 4) AS quantile FROM r WHERE run >= 0.9 * total GROUP BY 1"""
)
def a26_weighted_quantile(spark: SparkSession, d: str) -> DataFrame:
    q = A.weighted_quantile(table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", "l_quantity", 0.9)
    return q.select("l_returnflag", F.round("quantile", 4).alias("quantile"))


@query("SELECT p_brand AS tag, count(*)::BIGINT AS n FROM part GROUP BY 1 HAVING count(*) > 1")
def a28_repeated_tags(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").groupBy(F.col("p_brand").alias("tag")).agg(F.count("*").alias("n")).where("n > 1")


@query("SELECT p_brand AS level, count(*)::BIGINT AS n, (dense_rank() OVER (ORDER BY p_brand) - 1)::BIGINT AS code FROM part GROUP BY 1")
def a30_group_levels(spark: SparkSession, d: str) -> DataFrame:
    levels = table(spark, d, "part").groupBy(F.col("p_brand").alias("level")).agg(F.count("*").alias("n")).withColumn("k", F.lit(0))
    return levels.select("level", "n", (F.dense_rank().over(Window.partitionBy("k").orderBy("level")) - 1).cast("long").alias("code"))


@query("SELECT event_type, round(avg((value BETWEEN user_id - 50 AND user_id + 50)::INT), 6) AS coverage, count(*)::BIGINT AS n FROM events GROUP BY 1")
def a31_interval_coverage(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumns({"lo": F.col("user_id") - 50, "hi": F.col("user_id") + 50})
    return A.coverage(e, ["event_type"], "value", "lo", "hi").select("event_type", F.round("coverage", 6).alias("coverage"), "n")


@query("SELECT event_id, ts_rank::BIGINT AS position FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, (event_type <> 'signup'), event_id) AS ts_rank FROM events)")
def o1_event_first_order(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", F.col("event_type") != "signup", "event_id")
    return table(spark, d, "events").select("event_id", F.row_number().over(w).cast("long").alias("position"))


@query("SELECT user_id, event_type, n::BIGINT AS n FROM (SELECT user_id, event_type, count(*) AS n, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS r FROM events GROUP BY 1, 2) WHERE r <= 3")
def o3_top_three(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return n.withColumn("_r", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("n"), "event_type"))).where("_r <= 3").drop("_r")


@query("SELECT user_id, arg_max(event_type, (value, event_id)) AS at_max, arg_min(event_type, (value, event_id)) AS at_min FROM events GROUP BY 1")
def o5_argmax_argmin(spark: SparkSession, d: str) -> DataFrame:
    v = F.struct("value", "event_id")
    return table(spark, d, "events").groupBy("user_id").agg(F.max_by("event_type", v).alias("at_max"), F.min_by("event_type", v).alias("at_min"))


@query("SELECT s_suppkey AS k, s_name AS name, NULL::VARCHAR AS segment FROM supplier UNION ALL SELECT c_custkey, c_name, c_mktsegment FROM customer")
def u1_union_by_name(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"))
    c = table(spark, d, "customer").select(F.col("c_mktsegment").alias("segment"), F.col("c_custkey").alias("k"), F.col("c_name").alias("name"))
    return s.unionByName(c, allowMissingColumns=True)


@query("SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders")
def u2_set_difference(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey").subtract(table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")))


@query("SELECT l_orderkey, l_linenumber, round(exp(-l_quantity / 10) * sqrt(l_extendedprice), 6) AS a, round(asinh(l_quantity), 6) AS b, round(0.5 * (1 + tanh((l_quantity - 25) / 2)), 6) AS c, round(ln(exp(l_quantity - greatest(l_quantity, l_discount * 100)) + exp(l_discount * 100 - greatest(l_quantity, l_discount * 100))) + greatest(l_quantity, l_discount * 100), 6) AS lse, round(sqrt(l_quantity ** 2 + l_tax ** 2), 6) AS hyp FROM lineitem")
def x_scalar_math(spark: SparkSession, d: str) -> DataFrame:
    q, p = F.col("l_quantity"), F.col("l_extendedprice")
    lse = log_sum_exp(F.array(q, F.col("l_discount") * 100))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(F.exp(-q / 10) * F.sqrt(p), 6).alias("a"), F.round(F.asinh(q), 6).alias("b"), F.round(logistic(q - 25), 6).alias("c"), F.round(lse, 6).alias("lse"), F.round(F.hypot(q, F.col("l_tax")), 6).alias("hyp"))


@query(
    f"""WITH z AS (SELECT event_id, (value - 50) / 20 AS x, abs((value - 50) / 20) / {math.sqrt(2)!r}::DOUBLE AS a FROM events), t AS (SELECT *, 1 / (1 + 0.3275911::DOUBLE * a) AS t FROM z),
    p AS (SELECT *, ((((1.061405429::DOUBLE * t - 1.453152027::DOUBLE) * t + 1.421413741::DOUBLE) * t - 0.284496736::DOUBLE) * t + 0.254829592::DOUBLE) * t * exp(-a * a) / 2 AS tail FROM t)
    SELECT event_id, round(CASE WHEN x >= 0 THEN 1 - tail ELSE tail END, 6) AS phi FROM p"""
)
def x4_normal_tail(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.round(normal_cdf((F.col("value") - 50) / 20), 6).alias("phi"))


@query("SELECT vec_id, round(list_sum([x::DOUBLE * x::DOUBLE FOR x IN embedding]), 4) AS norm2, len(embedding)::INT AS n, round(list_max(embedding)::DOUBLE, 6) AS top, round(list_sum([x::DOUBLE FOR x IN embedding[1:8]]), 5) AS head FROM embeddings")
def x8_array_functions(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("embedding")
    head = F.aggregate(F.slice(v, 1, 8), F.lit(0.0), lambda a, x: a + x.cast("double"))
    return table(spark, d, "embeddings").select("vec_id", F.round(dot(v, v), 4).alias("norm2"), F.size(v).alias("n"), F.round(F.array_max(v).cast("double"), 6).alias("top"), F.round(head, 5).alias("head"))


@query("SELECT vec_id, round(exp(e1) / (exp(e1) + exp(e2) + exp(e3)), 6) AS p1, round(exp(e3) / (exp(e1) + exp(e2) + exp(e3)), 6) AS p3 FROM (SELECT vec_id, embedding[1]::DOUBLE AS e1, embedding[2]::DOUBLE AS e2, embedding[3]::DOUBLE AS e3 FROM embeddings)")
def x5_softmax(spark: SparkSession, d: str) -> DataFrame:
    p = softmax(F.transform(F.slice("embedding", 1, 3), lambda x: x.cast("double")))
    return table(spark, d, "embeddings").withColumn("_p", p).select("vec_id", F.round(F.col("_p")[0], 6).alias("p1"), F.round(F.col("_p")[2], 6).alias("p3"))


@query("SELECT c_custkey, regexp_matches(c_name, '^Customer#[0-9]+$') AS ok, starts_with(c_mktsegment, 'B') AS b, printf('%s/%05d', c_mktsegment, c_custkey) AS tag FROM customer")
def x10_strings(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", F.col("c_name").rlike("^Customer#[0-9]+$").alias("ok"), F.col("c_mktsegment").startswith("B").alias("b"), F.format_string("%s/%05d", "c_mktsegment", "c_custkey").alias("tag"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso, epoch_us(ts)::BIGINT AS us, strftime(ts + INTERVAL 90 SECOND, '%H:%M:%S') AS later FROM events")
def x11_time(spark: SparkSession, d: str) -> DataFrame:
    ts = F.col("ts")
    return table(spark, d, "events").select("event_id", F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss").alias("iso"), F.unix_micros(ts).alias("us"), F.date_format(ts + F.expr("INTERVAL 90 SECONDS"), "HH:mm:ss").alias("later"))


@query("SELECT event_id, (props->>'k')::BIGINT AS k, '{\"id\":' || event_id || ',\"k\":' || (props->>'k') || '}' AS out FROM events")
def x12_json(spark: SparkSession, d: str) -> DataFrame:
    k = F.from_json("props", "k long")["k"]
    return table(spark, d, "events").select("event_id", k.alias("k"), F.to_json(F.struct(F.col("event_id").alias("id"), k.alias("k"))).alias("out"))


@query("SELECT o_orderkey, round(sum(l_quantity) FILTER (l_linenumber = 1), 4) AS phase_1, round(sum(l_quantity) FILTER (l_linenumber = 2), 4) AS phase_2, round(sum(l_quantity), 4) AS total FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def x13_map_columns(spark: SparkSession, d: str) -> DataFrame:
    phase = F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("l_linenumber").alias("k"), F.col("q").alias("v")))))
    li = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.sum("l_quantity").alias("q"))
    m = li.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(phase.alias("m")).join(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", "left_semi")
    total = F.aggregate(F.map_values("m"), F.lit(0.0), lambda a, x: a + x)
    return m.select("o_orderkey", F.round(F.try_element_at("m", F.lit(1)), 4).alias("phase_1"), F.round(F.try_element_at("m", F.lit(2)), 4).alias("phase_2"), F.round(total, 4).alias("total"))


@query("SELECT event_id, CASE WHEN value > 90 THEN 'high' WHEN value > 60 THEN 'low' ELSE 'none' END AS confidence, sha256(event_type || ':' || event_id) AS digest FROM events")
def x14_ladder_and_hash(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("value")
    return table(spark, d, "events").select("event_id", F.when(v > 90, "high").when(v > 60, "low").otherwise("none").alias("confidence"), F.sha2(F.concat_ws(":", "event_type", F.col("event_id").cast("string")), 256).alias("digest"))


@query(f"SELECT event_id, round(CASE WHEN t >= 300000 AND t < 1500000 THEN least(greatest((t - 300000) / 600000, 0.0), 1.0) ELSE 0.0 END, 6) AS linear, CASE WHEN t >= 300000 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS step, round(CASE WHEN t >= 300000 THEN 1 - exp(-(t - 300000) / 600000) ELSE 0.0 END, 6) AS expo FROM {_EVENTS}")
def m2_activation_ramps(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("t")
    return _events(spark, d).select("event_id", F.round(ramp(t, 300000.0, 600000.0, "linear", 1500000.0), 6).alias("linear"), ramp(t, 300000.0, 600000.0, "step").alias("step"), F.round(ramp(t, 300000.0, 600000.0, "exp"), 6).alias("expo"))
