"""Queries of ordered operators, smoothing, monitoring, classification, regression and signal processing."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.operators import aggregates as A
from millrace.operators import classify as C
from millrace.operators import monitor as M
from millrace.operators import regression as R
from millrace.operators import sequences as S
from millrace.operators import signal as G
from millrace.plans.registry import query
from millrace.plans.relational import _EVENTS, _events
from millrace.sources.tables import stored, table

BY, ORDER = ["user_id"], ["ts", "event_id"]
_W = "(PARTITION BY user_id ORDER BY ts, event_id)"


def _fir_sql(weights: np.ndarray, causal: bool) -> str:
    """The filter as SQL over lag and lead, ends repeated."""
    n, terms = len(weights), []
    for k, c in enumerate(weights):
        shift = n - 1 - k if causal else n // 2 - k
        v = "value" if shift == 0 else f"lag(value, {shift}) OVER w" if shift > 0 else f"lead(value, {-shift}) OVER w"
        if not causal and shift:
            v = f"coalesce({v}, {'first' if shift > 0 else 'last'}_value(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"
        terms.append(f"{v} * {float(c)!r}::DOUBLE")
    return f"SELECT event_id, round({' + '.join(terms)}, 6) AS smooth FROM events WINDOW w AS {_W}"


@query(_fir_sql(S.savgol_weights(7, 2), False))
def w1_savgol_smooth(spark: SparkSession, d: str) -> DataFrame:
    return S.savgol(_events(spark, d), BY, ORDER, "value", 7).select("event_id", F.round("smooth", 6).alias("smooth"))


@query(_fir_sql(S.savgol_weights(9, 2, 1, 1.0, 8), True))
def w1_savgol_causal_slope(spark: SparkSession, d: str) -> DataFrame:
    return S.savgol(_events(spark, d), BY, ORDER, "value", 9, deriv=1, causal=True).select("event_id", F.round("smooth", 6).alias("smooth"))


@query(
    f"""WITH r AS (SELECT event_id, t, value, count(*) OVER w AS n, last_value(t) OVER w AS t0, last_value(value) OVER w AS v0, list(t) OVER w AS ts_, list(value) OVER w AS vs FROM {_EVENTS} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS 9 PRECEDING))
    SELECT event_id, round(CASE WHEN n = 10 THEN 1000 * (10 * list_sum([(ts_[i] - t0) * (vs[i] - v0) FOR i IN range(1, 11)]) - list_sum([x - t0 FOR x IN ts_]) * list_sum([x - v0 FOR x IN vs])) / nullif(10 * list_sum([(x - t0) * (x - t0) FOR x IN ts_]) - list_sum([x - t0 FOR x IN ts_]) ** 2, 0) END, 6) AS slope FROM r"""
)
def w5_trailing_slope(spark: SparkSession, d: str) -> DataFrame:
    s = S.trailing_slope(_events(spark, d), BY, ORDER, "t", "value", 10)
    return s.select("event_id", F.round(1000 * F.col("slope"), 6).alias("slope"))


@query(f"SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5, 6) AS same, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS shrink FROM events")
def w6_moving_average(spark: SparkSession, d: str) -> DataFrame:
    a = S.moving_average(_events(spark, d), BY, ORDER, "value", 2, "zero").withColumnRenamed("smooth", "same")
    return S.moving_average(a, BY, ORDER, "value", 2).select("event_id", F.round("same", 6).alias("same"), F.round("smooth", 6).alias("shrink"))


@query("SELECT event_id, sum((event_type = 'purchase')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS epoch FROM events")
def w7_event_epochs(spark: SparkSession, d: str) -> DataFrame:
    return S.epochs(_events(spark, d), BY, ORDER, F.col("event_type") == "purchase").select("event_id", "epoch")


@query(
    f"""WITH u AS (SELECT user_id, t, event_id, CASE WHEN coalesce(t - lag(t) OVER w > 40000, true) THEN 1 ELSE 0 END AS new FROM {_EVENTS} WHERE value > 40 WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS island FROM u)
    SELECT user_id, island::BIGINT AS island, round(min(t) - 60, 3) AS start, round(max(t) + 60, 3) AS "end", count(*)::BIGINT AS n FROM i GROUP BY 1, 2 HAVING count(*) >= 3"""
)
def w8_gaps_and_islands(spark: SparkSession, d: str) -> DataFrame:
    out = S.islands(_events(spark, d), BY, ORDER, "t", F.col("value") > 40, 40000.0, 3, 60.0)
    return out.select("user_id", "island", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"), "n")


_RANKED = "(SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events) r"


def _ranked(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).withColumn("i", F.row_number().over(Window.partitionBy(*BY).orderBy(*ORDER)).cast("long"))


@query(f"WITH s AS (SELECT user_id, max(i) AS l, coalesce(max(i) FILTER (value > 80) + 1, min(i)) AS run_start FROM {_RANKED} GROUP BY 1) SELECT user_id, run_start::BIGINT AS run_start, (l - run_start + 1)::BIGINT AS n FROM s WHERE l - run_start + 1 >= 3")
def w9_trailing_run(spark: SparkSession, d: str) -> DataFrame:
    return S.trailing_run(_ranked(spark, d), BY, "i", F.col("value") <= 80, 3)


@query(f"SELECT event_id, round(value - lag(value) OVER w, 6) AS d1, round(value - 2 * lag(value, 1) OVER w + lag(value, 2) OVER w, 6) AS d2 FROM events WINDOW w AS {_W}")
def w10_differences(spark: SparkSession, d: str) -> DataFrame:
    return S.differences(_events(spark, d), BY, ORDER, "value").select("event_id", F.round("d1", 6).alias("d1"), F.round("d2", 6).alias("d2"))


@query("SELECT o_custkey, o_totalprice AS x, round((coalesce(lead(o_totalprice) OVER w, o_totalprice) - coalesce(lag(o_totalprice) OVER w, o_totalprice)) / 2, 4) AS weight FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice)")
def w11_trapezoid_weights(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_custkey", F.col("o_totalprice").alias("x"))
    return S.trapezoid_weights(o, ["o_custkey"], "x").select("o_custkey", "x", F.round("weight", 4).alias("weight"))


@query(f"SELECT user_id, min(i)::BIGINT AS first FROM {_RANKED} WHERE value > 85 AND i >= 5 GROUP BY 1")
def w14_first_alarm(spark: SparkSession, d: str) -> DataFrame:
    return S.first_after(_ranked(spark, d), BY, "i", F.col("value") > 85, 5)


@query(f"WITH RECURSIVE r AS (SELECT user_id, i, value FROM {_RANKED}), k AS (SELECT user_id, i, value, value AS kept, 1 AS n FROM r WHERE i = 1 UNION ALL SELECT r.user_id, r.i, r.value, CASE WHEN k.kept - r.value >= 10 THEN r.value ELSE k.kept END, k.n + (k.kept - r.value >= 10)::INT FROM k JOIN r ON r.user_id = k.user_id AND r.i = k.i + 1) SELECT user_id, arg_max(n, i)::INT AS n_kept, round(arg_max(kept, i), 6) AS last_kept FROM k GROUP BY 1")
def w15_checkpoint_thinning(spark: SparkSession, d: str) -> DataFrame:
    path = F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "value"))), lambda e: e["value"])
    kept = _events(spark, d).groupBy("user_id").agg(S.thinned_summary(path, 10.0).alias("k"))
    return kept.select("user_id", F.col("k.n").alias("n_kept"), F.round("k.last", 6).alias("last_kept"))


@query(f'SELECT user_id, ((i - 1) // 6)::BIGINT AS "window", round(avg(((value - 50) / 25) ** 2), 6) AS mean FROM {_RANKED} GROUP BY 1, 2 HAVING count(*) = 6')
def w17_windowed_nis(spark: SparkSession, d: str) -> DataFrame:
    r = _ranked(spark, d).withColumns({"i": F.col("i") - 1, "nis": ((F.col("value") - 50) / 25) * ((F.col("value") - 50) / 25)})
    return S.window_means(r, BY, "i", "nis", 6).select("user_id", "window", F.round("mean", 6).alias("mean"))


@query(
    f"""WITH l AS (SELECT r.*, unnest([5.0, 20.0])::DOUBLE AS length FROM {_RANKED}), s AS (SELECT event_id, length, sum(exp(-i / length) * (value - 50) / 625) OVER w AS num, sum(exp(-i / length) ** 2 / 625) OVER w AS den FROM l WINDOW w AS (PARTITION BY user_id, length ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))
    SELECT event_id, length, round(CASE WHEN den > 0 THEN greatest(num, 0.0) ** 2 / (2 * den) ELSE 0.0 END, 6) AS llr FROM s"""
)
def w18_glr_running_sums(spark: SparkSession, d: str) -> DataFrame:
    r = _ranked(spark, d).withColumns({"res": F.col("value") - 50, "var": F.lit(625.0)})
    return S.glr_sums(r, BY, ORDER, "res", "var", [5.0, 20.0], "i").select("event_id", "length", F.round("llr", 6).alias("llr"))


@query(f"SELECT user_id, coalesce(max(i) FILTER (value > 90) + 1, min(i))::BIGINT AS settled FROM {_RANKED} GROUP BY 1")
def w20_settled_at(spark: SparkSession, d: str) -> DataFrame:
    return S.settled_at(_ranked(spark, d), BY, "i", F.col("value") > 90)


@query(f"WITH x AS (SELECT user_id, event_id - lag(event_id) OVER w AS step FROM events WINDOW w AS {_W}) SELECT user_id, median(step) AS stride FROM x WHERE step IS NOT NULL GROUP BY 1")
def w21_stride(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d).withColumn("step", F.col("event_id") - F.lag("event_id").over(Window.partitionBy(*BY).orderBy(*ORDER)))
    return e.where("step is not null").groupBy("user_id").agg(F.median("step").alias("stride"))


@query(f"SELECT event_id, round(lead(t) OVER (PARTITION BY user_id ORDER BY ts, event_id) - t, 3) AS duration FROM {_EVENTS}")
def w22_phase_durations(spark: SparkSession, d: str) -> DataFrame:
    return S.durations(_events(spark, d), BY, ORDER, "t").select("event_id", F.round("duration", 3).alias("duration"))


@query(
    f"""WITH RECURSIVE r AS (SELECT user_id, i, value FROM {_RANKED}), z AS (SELECT user_id, i, 0.2 * (value - 50) AS z FROM r WHERE i = 1 UNION ALL SELECT r.user_id, r.i, 0.2 * (r.value - 50) + 0.8 * z.z FROM z JOIN r ON r.user_id = z.user_id AND r.i = z.i + 1)
    SELECT user_id, round(arg_max(z, i), 6) AS z, round(max(abs(z)), 6) AS peak FROM z GROUP BY 1"""
)
def w13_ewma(spark: SparkSession, d: str) -> DataFrame:
    path = F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "value"))), lambda e: e["value"] - 50)
    z = _events(spark, d).groupBy("user_id").agg(M.ewma_summary(path, 0.2).alias("s"))
    return z.select("user_id", F.round("s.z", 6).alias("z"), F.round("s.peak", 6).alias("peak"))


def _features(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).withColumn("k", F.get_json_object("props", "$.k").cast("double"))


#: Moments, centred rows and the two-variable MEWMA of every stream, as SQL. DuckDB's recursion carries the vector (zx, zy).
_MEWMA = """WITH RECURSIVE e AS (SELECT event_id, user_id, ts, value AS x, (props->>'k')::DOUBLE AS y FROM events),
    m AS (SELECT avg(x) AS mx, avg(y) AS my, covar_samp(x, x) AS a, covar_samp(x, y) AS b, covar_samp(y, y) AS c FROM e),
    r AS (SELECT event_id, user_id, coalesce(x - mx, 0) AS dx, coalesce(y - my, 0) AS dy, a, b, c, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM e, m),
    z AS (SELECT user_id, event_id, i, dx, dy, a, b, c, 0.1 * dx AS zx, 0.1 * dy AS zy FROM r WHERE i = 1
        UNION ALL SELECT r.user_id, r.event_id, r.i, r.dx, r.dy, r.a, r.b, r.c, 0.1 * r.dx + 0.9 * z.zx, 0.1 * r.dy + 0.9 * z.zy FROM z JOIN r ON r.user_id = z.user_id AND r.i = z.i + 1),
    p AS (SELECT *, atan2(2 * b, a - c) / 2 AS angle FROM z),
    s AS (SELECT user_id, event_id, (c * zx ** 2 - 2 * b * zx * zy + a * zy ** 2) / (a * c - b * b) / (0.1 / 1.9 * (1 - 0.9 ** (2 * i))) AS mewma,
        (c * dx ** 2 - 2 * b * dx * dy + a * dy ** 2) / (a * c - b * b) AS t2, (cos(angle) * dy - sin(angle) * dx) ** 2 AS spe FROM p)"""


@query(f"{_MEWMA} SELECT event_id, round(mewma, 6) AS mewma FROM s")
def w13_mewma_stream(spark: SparkSession, d: str) -> DataFrame:
    e = _features(spark, d)
    mean, cov, _ = A.covariance(e, ["value", "k"])
    return M.mewma(e, BY, ORDER, ["value", "k"], mean, cov, 0.1).select("event_id", F.round("mewma", 6).alias("mewma"))


@query(f"{_MEWMA} SELECT event_id, round(spe, 6) AS spe FROM s")
def e25_spe(spark: SparkSession, d: str) -> DataFrame:
    """Squared prediction error of one component of two."""
    e = _features(spark, d)
    mean, cov, _ = A.covariance(e, ["value", "k"])
    return M.charts(e, ["value", "k"], mean, cov, 1).select("event_id", F.round("spe", 6).alias("spe"))


@query(
    """WITH e AS (SELECT event_id, value AS x, (props->>'k')::DOUBLE AS y FROM events), m AS (SELECT avg(x) AS mx, avg(y) AS my, covar_samp(x, x) AS a, covar_samp(x, y) AS b, covar_samp(y, y) AS c FROM e)
    SELECT event_id, round((c * (x - mx) ** 2 - 2 * b * (x - mx) * (y - my) + a * (y - my) ** 2) / (a * c - b * b), 6) AS t2 FROM e, m"""
)
def e25_hotelling_t2(spark: SparkSession, d: str) -> DataFrame:
    e = _features(spark, d)
    return M.t_squared_of(e, ["value", "k"], e).select("event_id", F.round("t2", 6).alias("t2"))


#: The share of rows that may alarm, and the grid of quantiles from which the common one is taken.
_RATE, _POINTS = 0.02, 1000


def _joint_sql(rows: str, stats: list[str], rate: float, points: int) -> str:
    """CTEs from ``rows`` to lim (one column a statistic): the least common quantile at which at most ``rate`` of the rows alarm."""
    ranked = ", ".join(f"row_number() OVER (ORDER BY {x}) AS r_{x}" for x in stats)
    grids = ", ".join(f"max({x}) FILTER (r_{x} = greatest(1, ceil(q * n))) AS {x}" for x in stats)
    alarm = " OR ".join(f"o.{x} > g.{x}" for x in stats)
    return f"""kk AS (SELECT *, {ranked}, count(*) OVER () AS n FROM {rows}), q AS (SELECT j, 1 - {rate}::DOUBLE + {rate}::DOUBLE * j / {points} AS q FROM range({points + 1}) t(j)),
    g AS (SELECT j, {grids} FROM q, kk GROUP BY j, q), o AS (SELECT {", ".join(stats)} FROM {rows}),
    f AS (SELECT g.j, count(*) FILTER ({alarm}) AS beyond, count(*) AS n FROM g, o GROUP BY g.j), lim AS (SELECT g.* FROM g JOIN (SELECT min(j) AS j FROM f WHERE beyond <= {rate}::DOUBLE * n) USING (j))"""


@query(f"{_MEWMA}, {_joint_sql('s', ['t2', 'spe', 'mewma'], _RATE, _POINTS)} SELECT s.user_id, min(s.event_id) AS first_alarm FROM s, lim WHERE s.t2 > lim.t2 OR s.spe > lim.spe OR s.mewma > lim.mewma GROUP BY 1")
def e25_monitor_first_alarms(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: baseline moments, T2, SPE and MEWMA per stream in one grouped pass, jointly calibrated limits, first alarm per stream."""
    e = _features(spark, d).select("user_id", "ts", "event_id", "value", "k")
    mean, cov, _ = A.covariance(e, ["value", "k"])
    stats = M.mewma(M.charts(e, ["value", "k"], mean, cov, 1), BY, ORDER, ["value", "k"], mean, cov, 0.1, keep=["t2", "spe"])
    stats = stored(stats.select(*BY, "event_id", "t2", "spe", "mewma"))
    return M.first_alarms(M.alarms(stats, A.joint_limits(stats, ["t2", "spe", "mewma"], _RATE, _POINTS)), BY, "event_id")


@query(
    """WITH e AS (SELECT event_id, value AS x, (props->>'k')::DOUBLE AS y FROM events), m AS (SELECT avg(x) AS mx, avg(y) AS my, stddev_samp(x) AS sx, stddev_samp(y) AS sy FROM e), z AS (SELECT event_id, (x - mx) / sx AS zx, (y - my) / sy AS zy FROM e, m)
    SELECT event_id, CASE WHEN zx IS NULL AND zy IS NULL THEN NULL WHEN zx IS NULL OR abs(zy) >= abs(zx) THEN 'k' ELSE 'value' END AS cause, round(CASE WHEN zx IS NULL OR abs(zy) >= abs(zx) THEN zy ELSE zx END, 6) AS z FROM z"""
)
def e26_alarm_contributions(spark: SparkSession, d: str) -> DataFrame:
    e = _features(spark, d)
    mean, cov, _ = A.covariance(e, ["value", "k"])
    out = M.contributions(e, ["value", "k"], mean, np.sqrt(np.diag(cov)), 1)
    return out.select("event_id", F.col("top")[0]["feature"].alias("cause"), F.round(F.col("top")[0]["z"], 6).alias("z"))


@query()
def e6_functional_components(spark: SparkSession, d: str) -> DataFrame:
    """Components of the embedding curves with the share of variance; distributed moments, one small eigenproblem."""
    _, cov, _ = M.vector_moments(table(spark, d, "embeddings"), "embedding")
    values = np.sort(np.linalg.eigvalsh(cov))[::-1][: M.choose_k(cov, 0.8)]
    return spark.createDataFrame([(i, round(float(v), 6), round(float(v / np.trace(cov)), 6)) for i, v in enumerate(values)], "component int, variance double, share double")


@query()
def e7_projection(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    mean, cov, _ = M.vector_moments(e, "embedding")
    model = M.fit_components(mean, cov, 5)
    out = M.project(e, "embedding", model)
    return out.select("vec_id", F.round(M.t_squared(F.col("scores"), model.variances), 6).alias("t2"), F.round("spe", 6).alias("spe"))


@query(f"WITH o_ AS (SELECT value, (props->>'k')::DOUBLE AS k FROM events), {_joint_sql('o_', ['value', 'k'], 0.05, 400)}" + " SELECT 'value' AS stat, round(value, 6) AS upper FROM lim UNION ALL SELECT 'k', round(k, 6) FROM lim")
def a14_joint_limits(spark: SparkSession, d: str) -> DataFrame:
    e = _features(spark, d).select("value", "k")
    limits = A.joint_limits(e, ["value", "k"], 0.05, 400)
    return spark.createDataFrame([(k, round(float(v), 6)) for k, v in limits.items()], "stat string, upper double")


@query(
    """WITH s AS (SELECT event_type, avg(value) AS mean, greatest(var_samp(value), 1e-3) AS var FROM events GROUP BY 1), l AS (SELECT e.event_id, s.event_type AS label, -0.5 * ((e.value - s.mean) ** 2 / s.var + ln(s.var)) AS score, ln(s.var) AS v FROM events e, s),
    r AS (SELECT event_id, label, score FROM l UNION ALL SELECT event_id, 'unknown', -0.5 * (1.8 ** 2 + min(v)) FROM l GROUP BY 1), x AS (SELECT *, exp(score - max(score) OVER (PARTITION BY event_id)) AS e FROM r)
    SELECT event_id, label, round(e / sum(e) OVER (PARTITION BY event_id), 6) AS posterior FROM x"""
)
def e27_fault_posterior(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    signatures = A.class_moments(e, "event_type", ["value"], 1e-3).withColumnRenamed("event_type", "label")
    p = C.gaussian_posterior(e, ["event_id"], ["value"], signatures.select("label", "feature", "mean", "var"), "label", 1.8)
    return p.select("event_id", "label", F.round("posterior", 6).alias("posterior"))


@query(
    """WITH r AS (SELECT event_type, abs(value - 50) AS s, row_number() OVER (PARTITION BY event_type ORDER BY abs(value - 50)) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events)
    SELECT event_type, round(s, 6) AS q, n::BIGINT AS n FROM r WHERE r = ceil((n + 1) * 0.9)"""
)
def e18_conformal_quantile(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("s", F.abs(F.col("value") - 50))
    return C.conformal_quantile(e, ["event_type"], "s", 0.1).select("event_type", F.round("q", 6).alias("q"), "n")


@query(
    f"""WITH RECURSIVE r AS (SELECT event_id, user_id, abs(value - 50) AS s, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
    c AS (SELECT event_id, user_id, i, s, [s] AS seen, NULL::DOUBLE AS q, 0.1::DOUBLE AS level, true AS covered FROM r WHERE i = 1
        UNION ALL SELECT event_id, user_id, i, s, list_append(seen, s), q, level, s <= q FROM (
            SELECT r.event_id, r.user_id, r.i, r.s, n.seen, n.level, list_sort(n.seen)[greatest(1, least(n.rank, len(n.seen)))::INT] * CASE WHEN n.rank > len(n.seen) THEN {C.WIDEN}::DOUBLE ELSE 1.0::DOUBLE END AS q
            FROM (SELECT *, ceil((len(seen) + 1) * (1 - level)) AS rank FROM (SELECT user_id, i, list_slice(seen, -500, -1) AS seen, least(greatest(level + 0.02::DOUBLE * (0.1::DOUBLE - (NOT covered)::INT), 0.001), 0.999)::DOUBLE AS level FROM c)) n JOIN r ON r.user_id = n.user_id AND r.i = n.i + 1))
    SELECT event_id, round(q, 6) AS q, round(level, 6) AS alpha_t, covered FROM c"""
)
def e19_adaptive_conformal(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d).withColumn("s", F.abs(F.col("value") - 50))
    return C.adaptive_conformal(e, BY, ORDER, "s", 0.1, 0.02).select("event_id", F.round("q", 6).alias("q"), F.round("alpha_t", 6).alias("alpha_t"), "covered")


def _pooled(spark: SparkSession, d: str) -> tuple[DataFrame, R.Pooled]:
    li = table(spark, d, "lineitem").withColumn("brand", F.concat("l_returnflag", "l_linestatus"))
    li = li.withColumn("y", F.log("l_extendedprice")).withColumn("x", F.log("l_quantity"))
    return li, R.fit_pooled(li, ["x", "l_discount"], ["brand", "l_linenumber"], "y", iterations=600, burn_in=200, seed=3)


@query()
def e15_partial_pooling(spark: SparkSession, d: str) -> DataFrame:
    _, model = _pooled(spark, d)
    return spark.createDataFrame([(n, round(m, 4), round(s, 4), round(z, 4)) for n, m, s, z in R.coefficients(model)], "name string, mean double, sd double, geweke double")


@query()
def e16_pooled_prediction(spark: SparkSession, d: str) -> DataFrame:
    li, model = _pooled(spark, d)
    out = R.predict_pooled(li, model, ["brand", "l_linenumber"])
    return out.select("l_orderkey", "l_linenumber", F.round("predicted", 6).alias("predicted"), F.round("variance", 6).alias("variance"))


def _curve(fn, schema: str):
    return lambda spark, d: G.by_curve(_events(spark, d).select("user_id", "ts", "event_id", "t", "value"), BY, ORDER, fn, schema)


@query()
def w2_window_choice(spark: SparkSession, d: str) -> DataFrame:
    choose = lambda p: pd.DataFrame({"user_id": [p["user_id"][0]], "window": [G.best_window(p["value"].to_numpy(), [3, 5, 7, 9, 13, 17, 25])]})
    return _curve(choose, "user_id long, window int")(spark, d)


@query()
def w3_adaptive_window(spark: SparkSession, d: str) -> DataFrame:
    def fit(p: pd.DataFrame) -> pd.DataFrame:
        y, w = G.lepski(p["value"].to_numpy(), [3, 5, 7, 11, 17, 25])
        return pd.DataFrame({"event_id": p["event_id"], "y": y.round(6), "window": w})

    return _curve(fit, "event_id long, y double, window int")(spark, d)


@query()
def w4_zero_phase_lowpass(spark: SparkSession, d: str) -> DataFrame:
    sections = G.butterworth_sections(4, 0.1, 1.0)
    return _curve(lambda p: pd.DataFrame({"event_id": p["event_id"], "y": G.zero_phase(p["value"].to_numpy(float), sections).round(6)}), "event_id long, y double")(spark, d)


@query()
def w12_curve_registration(spark: SparkSession, d: str) -> DataFrame:
    def place(p: pd.DataFrame) -> pd.DataFrame:
        t = p["t"].to_numpy(float)
        y = G.registered(t, p["value"].to_numpy(float), 20, 10, float(t[-1]), float(t[-1] - t[0]) * 0.2)
        return pd.DataFrame({"user_id": p["user_id"][0], "i": np.arange(len(y), dtype="int32"), "y": y.round(6)})

    return _curve(place, "user_id long, i int, y double")(spark, d)


@query()
def e13_change_points(spark: SparkSession, d: str) -> DataFrame:
    return _curve(lambda p: pd.DataFrame({"event_id": p["event_id"], "p": G.change_points((p["value"].to_numpy(float) - 50) / 25, 0.02).round(6)}), "event_id long, p double")(spark, d)


@query()
def e28_regime_particle_filter(spark: SparkSession, d: str) -> DataFrame:
    def track(p: pd.DataFrame) -> pd.DataFrame:
        switch = np.array([[0.95, 0.05], [0.1, 0.9]])
        user = p["user_id"][0]
        seed = 2**64 if pd.isna(user) else int(user) % 2**64
        out = G.particle_filter(p["value"].to_numpy(float), 300, np.array([0.0, 0.5]), np.array([0.5, 2.0]), 20.0, switch, seed)
        return pd.concat([p[["event_id"]], out.round(6)], axis=1)

    e = _events(spark, d).select("user_id", "ts", "event_id", "value")
    return G.by_curve(e, BY, ORDER, track, "event_id long, mean double, sd double, low double, high double, regime_0 double, regime_1 double")
