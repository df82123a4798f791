"""Batch forms of the streaming operators; tests hold the streaming forms against them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import physics as P
from millrace.operators import simulate as U
from millrace.operators.aggregates import covariance
from millrace.operators.features import FEATURES, feature_rows, with_truth
from millrace.plans import ordered  # noqa: F401  (its SQL is used here)
from millrace.plans.registry import ORACLES, query
from millrace.plans.relational import _events
from millrace.sources.recording import scan_recording, write_recording
from millrace.sources.tables import table, work_dir
from millrace.streaming import assembler, windows
from millrace.streaming.available import event_stream, run_available


def samples(events: DataFrame) -> DataFrame:
    """Events as tag samples: signups and errors are phase events, the rest numeric samples."""
    phase = F.when(F.col("event_type").isin("signup", "error"), F.col("event_type"))
    return events.select(F.col("user_id").alias("press"), "ts", F.col("event_id").alias("seq"), F.col("event_type").alias("signal"), "value", phase.alias("phase"))


@query(
    """WITH s AS (SELECT user_id AS press, ts, event_id AS seq, event_type AS signal, value, CASE WHEN event_type IN ('signup', 'error') THEN event_type END AS phase FROM events),
    p AS (SELECT *, last_value(phase IGNORE NULLS) OVER w AS cur, last_value(phase IGNORE NULLS) OVER (PARTITION BY press ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev, last_value(CASE WHEN signal = 'purchase' THEN value END IGNORE NULLS) OVER w AS held FROM s WINDOW w AS (PARTITION BY press ORDER BY ts, seq ROWS UNBOUNDED PRECEDING)),
    e AS (SELECT *, sum((phase IS NOT NULL AND phase IS DISTINCT FROM prev)::INT) OVER (PARTITION BY press ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS epoch FROM p), m AS (SELECT *, max(epoch) OVER (PARTITION BY press) AS top FROM e)
    SELECT press, epoch::BIGINT AS cycle, count(*)::BIGINT AS n, round(avg(value), 6) AS mean, round(min(value), 6) AS low, round(arg_max(held, (ts, seq)), 6) AS held FROM m WHERE cur = 'signup' AND phase IS NULL AND epoch < top GROUP BY 1, 2 HAVING count(*) >= 2"""
)
def t1_cycle_assembler(spark: SparkSession, d: str) -> DataFrame:
    c = assembler.assemble(samples(_events(spark, d)), "signup", "purchase")
    return c.select("press", "cycle", "n", *[F.round(x, 6).alias(x) for x in ("mean", "low", "held")])


@query("SELECT event_type, epoch_us(time_bucket(INTERVAL 6 HOUR, ts))::BIGINT AS start_us, count(*)::BIGINT AS n, round(sum(value), 6) AS total, round(max(value), 6) AS peak FROM events GROUP BY 1, 2")
def t5_tumbling_windows(spark: SparkSession, d: str) -> DataFrame:
    w = windows.tumbling(_events(spark, d), "ts", "6 hours", ["event_type"], "value")
    return w.select("event_type", F.unix_micros("w.start").alias("start_us"), "n", F.round("total", 6).alias("total"), F.round("peak", 6).alias("peak"))


@query(
    """WITH x AS (SELECT user_id, ts, value, CASE WHEN coalesce(ts - lag(ts) OVER w >= INTERVAL 12 HOUR, true) THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM x)
    SELECT user_id, epoch_us(min(ts))::BIGINT AS start_us, count(*)::BIGINT AS n, round(sum(value), 6) AS total FROM s GROUP BY user_id, k"""
)
def t5_session_windows(spark: SparkSession, d: str) -> DataFrame:
    w = windows.sessions(_events(spark, d), "ts", "12 hours", ["user_id"], "value")
    return w.select("user_id", F.unix_micros("w.start").alias("start_us"), "n", F.round("total", 6).alias("total"))


@query("SELECT l_orderkey, l_linenumber, round(asinh(exp(((ln(l_quantity) + 150000.0 / (8.314462618 * (l_extendedprice / 200 + 600))) - 24.0) / 5.0)) / 0.02, 6) AS stress FROM lineitem")
def x1_flow_stress(spark: SparkSession, d: str) -> DataFrame:
    log_z = P.zener_hollomon(F.col("l_quantity"), 150000.0, F.col("l_extendedprice") / 200 + 600)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(P.flow_stress(log_z, 0.02, 24.0, 5.0), 6).alias("stress"))


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice * (pi() * 0.25 / 4) - l_quantity * (pi() * 0.25 / 4 - pi() * 0.09 / 4), 6) AS force FROM lineitem")
def x3_cylinder_force(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(P.cylinder_force(F.col("l_extendedprice"), F.col("l_quantity"), 0.5, 0.3), 6).alias("force"))


@query()
def m1_mean_reverting_process(spark: SparkSession, d: str) -> DataFrame:
    return U.mean_reverting(spark, 16, 500, 50.0, 0.05, 2.0, 11, 0.0, 100.0)


@query("SELECT o_orderkey AS cycle, round(o_orderkey * 100.0 + k / r, 6) AS t, s AS signal, CASE WHEN s = 'price' THEN o_totalprice ELSE o_custkey::DOUBLE END AS value FROM orders, (VALUES ('price', 2.0::DOUBLE, 20), ('cust', 0.5::DOUBLE, 5)) x(s, r, top), range(21) t(k) WHERE k <= top")
def m10_recording(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("cycle"), (F.col("o_orderkey") * 100.0).alias("t0"), F.lit(10.0).alias("len"), F.col("o_totalprice").alias("price"), F.col("o_custkey").alias("cust"))
    return U.recording(o, "t0", "len", {"price": 2.0, "cust": 0.5}).withColumn("t", F.round("t", 6))


#: Cycles of twelve samples of a user, in order; samples outside [0.5, 99] are rejected.
_CYCLES = """(SELECT user_id, (rn - 1) // 12 AS cycle, (rn - 1) % 12 AS i, t, value, event_type FROM (SELECT *, epoch_us(ts) / 1e6 - 1704067200.0 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events) r) c"""
_FEATURES_SQL = f"""WITH a AS (SELECT *, coalesce(value BETWEEN 0.5 AND 99, false) AS ok FROM {_CYCLES}),
    m AS (SELECT *, sum((NOT ok)::INT) OVER (PARTITION BY user_id, cycle) AS n_rejected, t - min(t) OVER (PARTITION BY user_id, cycle) AS x FROM a),
    b AS (SELECT user_id, cycle, i, x, value AS y, n_rejected, row_number() OVER w - 1 AS j, count(*) OVER (PARTITION BY user_id, cycle) AS n, y - lag(y) OVER w AS d1, y - 2 * lag(y, 1) OVER w + lag(y, 2) OVER w AS d2, x - lag(x) OVER w AS dt, lag(y) OVER w AS py, avg(y) OVER (PARTITION BY user_id, cycle) AS mu FROM m WHERE ok WINDOW w AS (PARTITION BY user_id, cycle ORDER BY i)),
    s AS (SELECT *, y - mu AS d, sum(y - mu) OVER r AS s1, sum((y - mu) ** 2) OVER r AS s2 FROM b WINDOW r AS (PARTITION BY user_id, cycle ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
    u AS (SELECT *, round((s2 / (n - j) - s1 * s1 / ((n - j) * (n - j))) / (n - j), 9) AS rule FROM s),
    tr AS (SELECT user_id, cycle, arg_min(j, (rule, j)) AS transient FROM u WHERE 2 * j <= n GROUP BY 1, 2),
    v AS (SELECT u.*, transient, j >= transient AS inside, j - transient + 1 AS k FROM u JOIN tr USING (user_id, cycle)),
    g AS (SELECT *, sum(d) FILTER (inside) OVER (PARTITION BY user_id, cycle) AS total, sum(inside::INT) OVER (PARTITION BY user_id, cycle) AS size, sum(CASE WHEN inside THEN d ELSE 0 END) OVER (PARTITION BY user_id, cycle ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM v),
    h AS (SELECT *, CASE WHEN inside AND k < size THEN round((run - k * total / size) ** 2 * size / (k * (size - k)), 9) END AS gain FROM g),
    o AS (SELECT user_id, cycle, max(gain) AS onset_gain, arg_max(j, (gain, -j)) FILTER (gain IS NOT NULL) + 1 AS onset FROM h GROUP BY 1, 2), z AS (SELECT * FROM h JOIN o USING (user_id, cycle)),
    f AS (SELECT user_id, cycle, count(*) AS n, any_value(n_rejected) AS n_rejected, max(x) - min(x) AS duration, avg(y) AS mean, stddev_pop(y) AS sd, min(y) AS low, max(y) AS high, arg_min(y, j) AS first, arg_max(y, j) AS last, sqrt(avg(d1 * d1)) AS step_rms, sqrt(avg(d2 * d2) / 6) AS noise,
        nullif(regr_slope(y, x), 'nan'::DOUBLE) AS slope, nullif(regr_intercept(y, x), 'nan'::DOUBLE) AS intercept, CASE WHEN count(*) > 2 THEN sqrt(greatest(0, coalesce(nullif((regr_syy(y, x) - regr_slope(y, x) * regr_sxy(y, x)) / count(*), 'nan'::DOUBLE), 0))) ELSE 0 END AS residual_sd, coalesce(sum((y + py) / 2 * dt), 0) AS area, arg_min(x, (-y, j)) AS peak_at, any_value(transient) AS transient, avg(y) FILTER (inside) AS settled_mean, stddev_pop(y) FILTER (inside) AS settled_sd,
        any_value(onset) AS onset, sqrt(any_value(onset_gain)) AS onset_gain, avg(y) FILTER (inside AND j < onset) AS before, avg(y) FILTER (j >= onset) AS after, nullif(regr_slope(y, x) FILTER (j >= z.n - 5), 'nan'::DOUBLE) AS end_slope, avg((y > mu)::INT) AS above_mean FROM z GROUP BY 1, 2)"""
_DIGITS = {c: 6 for c in FEATURES if c not in ("n", "n_rejected", "transient", "onset")}
_SELECTED = ", ".join(f"round({'after - before' if c == 'change' else c}, {_DIGITS[c]}) AS {c}" if c in _DIGITS else f"{c}::BIGINT AS {c}" for c in FEATURES)


def _cycle_samples(spark: SparkSession, d: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return _events(spark, d).withColumns({"cycle": F.floor(rank / 12), "i": rank % 12})


def _feature_rows(spark: SparkSession, d: str) -> DataFrame:
    return feature_rows(_cycle_samples(spark, d), ["user_id", "cycle"], ["i"], "t", "value", F.lit(0.5), F.lit(99.0))


@query(f"{_FEATURES_SQL} SELECT user_id, cycle::BIGINT AS cycle, {_SELECTED} FROM f")
def e5_feature_rows(spark: SparkSession, d: str) -> DataFrame:
    """Samples to one row of 26 features a cycle, over all users (mask, transient, change, aggregates)."""
    return _feature_rows(spark, d).select("user_id", "cycle", *[F.round(c, _DIGITS[c]).alias(c) if c in _DIGITS else c for c in FEATURES])


@query(f"{_FEATURES_SQL}, y AS (SELECT user_id, cycle, count(*) FILTER (event_type = 'error')::BIGINT AS errors FROM {_CYCLES} GROUP BY 1, 2) SELECT user_id, f.cycle::BIGINT AS cycle, round(mean, 6) AS mean, onset::BIGINT AS onset, errors AS y_errors FROM f JOIN y USING (user_id, cycle)")
def j6_truth_on_features(spark: SparkSession, d: str) -> DataFrame:
    truth = _cycle_samples(spark, d).groupBy("user_id", "cycle").agg(F.count_if(F.col("event_type") == "error").alias("errors"))
    return with_truth(_feature_rows(spark, d), truth, ["user_id", "cycle"], ["errors"]).select("user_id", "cycle", F.round("mean", 6).alias("mean"), "onset", "y_errors")


@query("SELECT event_type, epoch_us(time_bucket(INTERVAL 6 HOUR, ts))::BIGINT AS start_us, count(*)::BIGINT AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def t4_streamed_windows(spark: SparkSession, d: str) -> DataFrame:
    """Watermarked windows through a stream that runs until its source is read; each window's last update counts."""
    out = run_available(windows.tumbling(event_stream(spark, d), "ts", "6 hours", ["event_type"], "value", late="1 hour"), "complete")
    return out.select("event_type", F.unix_micros("w.start").alias("start_us"), "n", F.round("total", 6).alias("total"))


@query(ORACLES["t1_cycle_assembler"])
def t1_streamed_assembler(spark: SparkSession, d: str) -> DataFrame:
    """The assembler with its state, as a stream."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", windows.ROCKSDB)
    c = run_available(assembler.assemble_stream(samples(event_stream(spark, d)), "signup", "purchase"), "append")
    return c.select("press", "cycle", "n", *[F.round(x, 6).alias(x) for x in ("mean", "low", "held")])


@query(ORACLES["w13_mewma_stream"])
def t6_streamed_mewma(spark: SparkSession, d: str) -> DataFrame:
    """The multivariate EWMA with its vector kept as state, as a stream; moments come from the table."""
    e = _events(spark, d).withColumn("k", F.get_json_object("props", "$.k").cast("double"))
    mean, cov, _ = covariance(e, ["value", "k"])
    stream = event_stream(spark, d).withColumn("k", F.get_json_object("props", "$.k").cast("double"))
    return run_available(windows.mewma_stream(stream, "user_id", "long", ["ts", "event_id"], ["value", "k"], mean, cov, 0.1), "append").select("event_id", F.round("mewma", 6).alias("mewma"))


@query(ORACLES["m10_recording"])
def s6_recording_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """A recording is written by signal, sorted by time, and scanned back."""
    path = f"{work_dir(spark)}/recording"
    write_recording(m10_recording(spark, d), path)
    return scan_recording(spark, path).select("cycle", "t", "signal", "value")


@query("SELECT event_type, epoch_us(time_bucket(INTERVAL 6 HOUR, ts) - k * INTERVAL 6 HOUR)::BIGINT AS start_us, count(*)::BIGINT AS n, round(avg(value), 6) AS mean FROM events, range(2) w(k) GROUP BY 1, 2")
def t5_sliding_windows(spark: SparkSession, d: str) -> DataFrame:
    w = windows.sliding(_events(spark, d), "ts", "12 hours", "6 hours", ["event_type"], "value")
    return w.select("event_type", F.unix_micros("w.start").alias("start_us"), "n", F.round("mean", 6).alias("mean"))
