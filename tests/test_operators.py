"""Operators against NumPy, closed forms and recovered truths."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace.functions import numeric as N
from millrace.operators import aggregates as A
from millrace.operators import classify as C
from millrace.operators import joins as J
from millrace.operators import monitor as M
from millrace.operators import optimize as O
from millrace.operators import quality as Q
from millrace.operators import regression as R
from millrace.operators import sequences as S
from millrace.operators import signal as G
from millrace.operators import simulate as U
from millrace.sources.contract import config_leaves, contract_issues, contract_table
from millrace.sources.store import CycleStore, content_hash, manifest, markdown


def test_savgol_is_exact_on_a_quadratic(spark):
    x = np.arange(40.0)
    y = 0.3 * x * x - 2 * x + 1
    df = spark.createDataFrame([("a", float(i), float(v)) for i, v in zip(x, y)], "k string, x double, y double")
    out = S.savgol(df, ["k"], ["x"], "y", 7, 2, 1).orderBy("x").toPandas()["smooth"].to_numpy()
    assert np.allclose(out[3:-3], (0.6 * x - 2)[3:-3])
    causal = S.savgol(df, ["k"], ["x"], "y", 7, 2, 1, causal=True).orderBy("x").toPandas()["smooth"].to_numpy()
    assert np.isnan(causal[:6]).all() and np.allclose(causal[6:], (0.6 * x - 2)[6:])
    assert np.allclose(G.savgol_curve(y, 7, 2)[3:-3], y[3:-3])


def test_causal_outputs_ignore_the_future(spark):
    rng = np.random.default_rng(0)
    y = rng.standard_normal(60)
    z = np.concatenate([y[:40], y[40:] + 100])
    outs = []
    for v in (y, z):
        df = spark.createDataFrame([("a", i, float(v[i])) for i in range(60)], "k string, i int, y double")
        outs.append(S.savgol(df, ["k"], ["i"], "y", 9, causal=True).orderBy("i").toPandas()["smooth"].to_numpy()[:40])
    assert np.array_equal(outs[0], outs[1], equal_nan=True)


def test_trailing_slope_matches_polyfit(spark):
    rng = np.random.default_rng(1)
    x, y = np.cumsum(rng.random(50)) + 1e6, rng.standard_normal(50)
    df = spark.createDataFrame([("a", i, float(x[i]), float(y[i])) for i in range(50)], "k string, i int, x double, y double")
    got = S.trailing_slope(df, ["k"], ["i"], "x", "y", 8).orderBy("i").toPandas()["slope"].to_numpy()
    want = [np.polyfit(x[i - 7 : i + 1] - x[i], y[i - 7 : i + 1], 1)[0] for i in range(7, 50)]
    assert np.isnan(got[:7]).all() and np.allclose(got[7:], want, rtol=1e-6)


def test_moving_average_edges(spark):
    y = np.array([1.0, 4, 2, 8, 5])
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(y)], "k string, i int, y double")
    near = S.moving_average(df, ["k"], ["i"], "y", 1, "nearest").orderBy("i").toPandas()["smooth"].to_numpy()
    assert np.allclose(near, np.convolve(np.pad(y, 1, "edge"), np.ones(3) / 3, "valid"))
    zero = S.moving_average(df, ["k"], ["i"], "y", 1, "zero").orderBy("i").toPandas()["smooth"].to_numpy()
    assert np.allclose(zero, np.convolve(y, np.ones(3) / 3, "same"))


def test_robust_noise_of_white_noise(spark):
    y = np.random.default_rng(2).standard_normal(4000) * 3
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(y)], "k string, i int, y double")
    assert A.robust_noise_sd(df, ["k"], ["i"], "y").first()["noise_sd"] == pytest.approx(3, rel=0.08)
    assert G.noise_sd(y) == pytest.approx(3, rel=0.08)


def test_ols_and_decay(spark):
    rng = np.random.default_rng(3)
    x = rng.random((300, 2))
    y = 1 + x @ [2.0, -3.0] + 0.01 * rng.standard_normal(300)
    df = spark.createDataFrame([("a", *map(float, r), float(v)) for r, v in zip(x, y)], "k string, x1 double, x2 double, y double")
    fit = A.ols(df, ["k"], ["x1", "x2"], "y").first()
    want = np.linalg.lstsq(np.column_stack([np.ones(300), x]), y, rcond=None)[0]
    assert np.allclose(fit["beta"], want) and fit["rms"] == pytest.approx(np.sqrt(np.mean((y - np.column_stack([np.ones(300), x]) @ want) ** 2)), rel=1e-5)
    decay = spark.createDataFrame([("a", float(h), float(5 * math.exp(-h / 7))) for h in range(30)], "k string, h double, r double")
    out = A.decay_length(decay, ["k"], "h", "r").first()
    assert out["length"] == pytest.approx(7) and out["amplitude"] == pytest.approx(5)


def test_interpolation_and_asof(spark):
    series = spark.createDataFrame([("a", 0.0, 0.0), ("a", 10.0, 100.0), ("a", 20.0, 0.0)], "k string, t double, v double")
    at = spark.createDataFrame([("a", t) for t in (-5.0, 0.0, 2.5, 10.0, 15.0, 30.0)], "k string, t double")
    got = [r["v"] for r in J.interpolated(at, series, ["k"], "t", "v").orderBy("t").collect()]
    assert got == pytest.approx(np.interp([-5, 0, 2.5, 10, 15, 30], [0, 10, 20], [0, 100, 0]))
    assert [r["r_v"] for r in J.asof(at, series, ["k"], "t", ["v"]).orderBy("t").collect()] == [None, 0.0, 0.0, 100.0, 100.0, 0.0]


def test_lookup_fails_on_a_miss(spark):
    left = spark.createDataFrame([("x",), ("y",)], "die string")
    right = spark.createDataFrame([("x", 2.0)], "die string, ratio double")
    with pytest.raises(Exception, match="no ratio for y"):
        J.lookup(left, right, "die", required="ratio").collect()


def test_filled_bins(spark):
    df = spark.createDataFrame([("a", 1.5, 10.0), ("a", 4.2, 40.0), ("a", 6.0, 7.0)], "k string, x double, y double")
    out = A.filled_bins(A.bin_average(df, ["k"], "x", "y", 0.0, 1.0, 6), ["k"], 6).orderBy("bin").collect()
    assert [r["y"] for r in out] == [10.0, 10.0, 20.0, 30.0, 40.0, 7.0] and [r["n"] for r in out] == [0, 1, 0, 0, 1, 1]


def test_weighted_quantile_and_ttl(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0), ("a", 2.0, 3.0), ("a", 3.0, 6.0)], "k string, v double, w double")
    assert A.weighted_quantile(df, ["k"], "v", "w", 0.4).first()["quantile"] == 2.0
    paths = spark.createDataFrame([(p, s, float(p * s)) for p in range(4) for s in range(5)], "sim int, step int, v double")
    row = A.time_to_limit(paths, "sim", "step", "v", 4.0).first()
    assert row["share"] == 0.75 and row["p50"] == 2.0


def test_bootstrap_interval_holds_the_mean(spark):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(int(c), float(rng.normal(c % 3, 1))) for c in range(30) for _ in range(20)], "c int, v double")
    r = A.cluster_bootstrap_mean(df, "c", "v", 300, 5).first()
    assert r["low"] < r["mean"] < r["high"] and r["high"] - r["low"] < 1.2


def test_joint_limits_meet_the_rate(spark):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([tuple(map(float, r)) for r in rng.standard_normal((4000, 2))], "a double, b double")
    limits = A.joint_limits(df, ["a", "b"], 0.05)
    assert df.where((F.col("a") > limits["a"]) | (F.col("b") > limits["b"])).count() / 4000 == pytest.approx(0.05, abs=0.002)


def test_components_and_monitor(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((500, 3)) @ np.array([[2, 0.5, 0, 0], [0, 1, 0.3, 0], [0, 0, 0.5, 0.1]])
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id int, v array<double>")
    mean, cov, n = M.vector_moments(df, "v")
    assert n == 500 and np.allclose(mean, x.mean(axis=0)) and np.allclose(cov, np.cov(x.T))
    model = M.fit_components(mean, cov, 3)
    out = M.project(df, "v", model).withColumn("t2", M.t_squared(F.col("scores"), model.variances)).toPandas()
    scores = (x - mean) @ model.axes.T
    assert np.allclose(np.vstack(out["scores"]), scores) and np.allclose(out["spe"], ((x - mean - scores @ model.axes) ** 2).sum(axis=1), atol=1e-9)
    assert out["t2"].mean() == pytest.approx(3, rel=0.02)


def test_mewma_startup_and_alarm(spark):
    rng = np.random.default_rng(7)
    x = rng.standard_normal((400, 2))
    x[300:] += 1.5
    df = spark.createDataFrame([(0, i, float(a), float(b)) for i, (a, b) in enumerate(x)], "s int, i int, a double, b double")
    out = M.mewma(df, ["s"], ["i"], ["a", "b"], np.zeros(2), np.eye(2), 0.1).orderBy("i").toPandas()["mewma"].to_numpy()
    assert out[0] == pytest.approx(x[0] @ x[0])
    assert out[320:].min() > N.chi2_quantile(0.999, 2) > np.quantile(out[:300], 0.9)


def test_posterior_and_reject_class(spark):
    sig = spark.createDataFrame([("a", "x", 0.0, 1.0), ("b", "x", 5.0, 1.0)], "label string, feature string, mean double, var double")
    df = spark.createDataFrame([(1, 0.1), (2, 5.2), (3, 60.0), (4, None)], "id int, x double")
    p = {(r["id"], r["label"]): r["posterior"] for r in C.gaussian_posterior(df, ["id"], ["x"], sig, "label", 3.0).collect()}
    assert p[1, "a"] > 0.9 and p[2, "b"] > 0.9 and p[3, "unknown"] > 0.99
    assert sum(v for (i, _), v in p.items() if i == 1) == pytest.approx(1)


def test_conformal_coverage(spark):
    rng = np.random.default_rng(8)
    s = np.abs(rng.standard_normal(2000))
    q = C.conformal_quantile(spark.createDataFrame([("k", float(v)) for v in s], "k string, s double"), ["k"], "s", 0.1).first()["q"]
    assert q == np.sort(s)[math.ceil(2001 * 0.9) - 1]
    shifted = np.concatenate([s[:800], 2 * s[800:]])
    df = spark.createDataFrame([("k", i, float(v)) for i, v in enumerate(shifted)], "k string, i int, s double")
    out = C.adaptive_conformal(df, ["k"], ["i"], "s", 0.1, 0.02).toPandas().sort_values("i")
    assert out["covered"][1000:].mean() == pytest.approx(0.9, abs=0.03)


def test_partial_pooling_recovers_slopes(spark):
    rng = np.random.default_rng(9)
    rows = []
    g, h = rng.normal(0, 1, 8), rng.normal(0, 0.5, 4)
    for _ in range(1500):
        x1, x2, i, j = rng.standard_normal(), rng.standard_normal(), rng.integers(8), rng.integers(4)
        rows.append((float(x1), float(x2), f"g{i}", f"h{j}", float(1 + 2 * x1 - x2 + g[i] + h[j] + 0.3 * rng.standard_normal())))
    df = spark.createDataFrame(rows, "x1 double, x2 double, die string, alloy string, y double")
    model = R.fit_pooled(df, ["x1", "x2"], ["die", "alloy"], "y", 600, 200, 1)
    coef = {n: m for n, m, _, _ in R.coefficients(model)}
    assert coef["x1"] == pytest.approx(2, abs=0.05) and coef["x2"] == pytest.approx(-1, abs=0.05)
    out = R.predict_pooled(df, model, ["die", "alloy"]).withColumn("in", (F.abs(F.col("y") - F.col("predicted")) < 1.645 * F.sqrt("variance")).cast("double"))
    assert out.agg(F.avg("in")).first()[0] == pytest.approx(0.9, abs=0.04)
    unseen = R.predict_pooled(df.limit(1).withColumn("die", F.lit("new")), model, ["die", "alloy"]).first()["variance"]
    assert unseen > out.first()["variance"] + 0.2


def test_filters_and_windows():
    t = np.arange(400)
    slow, fast = np.sin(2 * np.pi * t / 100), np.sin(2 * np.pi * t / 5)
    out = G.zero_phase(slow + fast, G.butterworth_sections(4, 0.04, 1.0))
    assert np.abs(out - slow)[50:-50].max() < 0.05
    assert np.allclose(G.zero_phase(np.full(50, 3.0), G.butterworth_sections(3, 0.1, 1.0)), 3.0)
    rng = np.random.default_rng(10)
    noisy = slow + 0.2 * rng.standard_normal(400)
    w = G.best_window(noisy, [3, 7, 15, 31, 101, 201])
    assert 7 <= w <= 101
    est, chosen = G.lepski(noisy, [3, 7, 15, 31, 61])
    assert np.mean((est - slow) ** 2) < np.mean((noisy - slow) ** 2) / 3 and chosen.min() >= 3


def test_change_points_and_particles():
    rng = np.random.default_rng(11)
    z = np.concatenate([rng.standard_normal(100), rng.standard_normal(60) + 4])
    p = G.change_points(z, 0.01, 10.0)
    assert p[100:104].max() > 5 * p[20:99].max() and p[20:99].mean() < 0.1
    truth = np.cumsum(np.r_[np.zeros(50), np.full(50, 0.5)])
    out = G.particle_filter(truth + rng.standard_normal(100), 800, np.array([0.0, 0.5]), np.array([0.05, 0.1]), 1.0, np.array([[0.97, 0.03], [0.03, 0.97]]), 1)
    assert np.abs(out["mean"] - truth).mean() < 0.8 and out["regime_1"][80:].mean() > out["regime_1"][10:40].mean()


def test_change_points_of_a_stream_longer_than_any_kept_window():
    rng = np.random.default_rng(19)
    z = np.concatenate([0.3 + 0.1 * rng.standard_normal(3500), 1.5 + rng.standard_normal(300)])
    hazard, prior = 0.02, 1.0
    log_p, n, total, want = np.zeros(1), np.zeros(1), np.zeros(1), []
    for v in z:  # every run length, nothing dropped
        var = prior / (1 + n * prior)
        log_p = log_p - 0.5 * ((v - var * total) ** 2 / (1 + var) + np.log1p(var))
        log_p -= log_p.max() + np.log(np.exp(log_p - log_p.max()).sum())
        log_p, n, total = np.r_[np.log(hazard), log_p + np.log(1 - hazard)], np.r_[0, n + 1], np.r_[0, total + v]
        want.append(np.exp(log_p[:2]).sum() if len(want) else hazard)
    assert np.allclose(G.change_points(z, hazard, prior), want, atol=1e-9)


def test_particle_filter_query_covers_every_event(spark):
    from millrace.plans.ordered import e28_regime_particle_filter

    ids = [r.event_id for r in e28_regime_particle_filter(spark, "/root/testdata/sf0.01").select("event_id").collect()]
    events = spark.read.parquet("/root/testdata/sf0.01/events.parquet")
    assert events.where("user_id >= 30").count() > 0 and sorted(ids) == sorted(r.event_id for r in events.select("event_id").collect())


def test_unscented_is_exact_for_linear_maps():
    m, cov, a = np.array([1.0, -2]), np.array([[2, 0.3], [0.3, 1]]), np.array([[1.0, 2], [0, 1], [3, -1]])
    mean, out, cross = G.unscented(m, cov, lambda x: a @ x)
    assert np.allclose(mean, a @ m) and np.allclose(out, a @ cov @ a.T) and np.allclose(cross, cov @ a.T)


def test_optimisers_and_recursive_regression():
    x = np.linspace(0, 4, 60)
    y = 2 * np.exp(-x / 1.5) + 0.5
    fit = O.least_squares(lambda p: p[0] * np.exp(-x / p[1]) + p[2] - y, np.array([1.0, 1, 0]), np.array([0, 0.1, -1.0]), np.array([10, 10, 1.0]))
    assert np.allclose(fit, [2, 1.5, 0.5], atol=1e-4)
    assert np.allclose(O.nelder_mead(lambda p: (p[0] - 3) ** 2 + 2 * (p[1] + 1) ** 2, np.array([0.0, 0])), [3, -1], atol=1e-3)
    rng = np.random.default_rng(12)
    a = rng.standard_normal((50, 3))
    b = a @ [1.0, 2, 3] + 0.1 * rng.standard_normal(50)
    seq = O.recursive_regression(a, b, np.zeros(3), np.eye(3) * 10, 0.01)
    mean, cov = O.batch_posterior(a.T @ a, a.T @ b, np.zeros(3), np.eye(3) * 10, 0.01)
    assert np.allclose(seq[0], mean) and np.allclose(seq[1], cov)
    t = np.linspace(0, 10, 400)
    end, p = O.start_transient(t, 5 + 0.1 * t + 3 * np.exp(-t / 0.5) + 0.02 * rng.standard_normal(400))
    assert p[3] == pytest.approx(0.5, abs=0.05) and 1.0 < end < 3.0


def test_numeric_functions(spark):
    assert N.chi2_quantile(0.95, 2) == pytest.approx(5.99146, abs=1e-4)
    assert N.chi2_quantile(0.99, 6) == pytest.approx(16.8119, abs=1e-3)
    assert N.normal_quantile(0.975) == pytest.approx(1.959964, abs=1e-5)
    row = spark.range(1).select(N.normal_cdf(F.lit(-1.96)).alias("a"), N.logistic(F.lit(800.0)).alias("b"), N.log_sum_exp(F.array(F.lit(1000.0), F.lit(1000.0))).alias("c")).first()
    assert row["a"] == pytest.approx(0.0249979, abs=1e-6) and row["b"] == 1.0 and row["c"] == pytest.approx(1000 + math.log(2))


def test_process_is_reproducible_and_stationary(spark):
    a, b = (U.mean_reverting(spark, 8, 2000, 10.0, 0.1, 1.0, 3).orderBy("stream", "step").toPandas() for _ in range(2))
    pd.testing.assert_frame_equal(a, b)
    assert a["value"].mean() == pytest.approx(10, abs=0.5) and a["value"].std() == pytest.approx(1 / math.sqrt(0.2), rel=0.15)


def test_contract_and_config(spark):
    bad = {"a": {"tag": "t", "lo": 2, "hi": 1, "type": "float"}, "b": {"tag": "t", "type": "enum", "colour": 1}}
    assert len(contract_issues(bad)) == 4
    with pytest.raises(ValueError):
        contract_table(spark, bad)
    assert dict(config_leaves({"a": {"b": {"value": 1, "unit": "mm"}}, "c": 2})) == {"a.b": 1, "c": 2}


def test_range_check_and_verdicts(spark):
    c = contract_table(spark, {"s": {"tag": "x", "lo": 0.0, "hi": 1.0}})
    df = spark.createDataFrame([("s", 0, 0.5), ("s", 1, float("nan")), ("s", 2, None), ("s", 3, 2.0), ("z", 4, 0.5)], "signal string, t int, value double")
    ok = {r["t"]: r["ok"] for r in Q.range_checked(df, c).collect()}
    assert ok == {0: True, 1: False, 2: False, 3: False, 4: False}
    flat = spark.createDataFrame([("s", t, 1.0) for t in (0, 2, 1)], "signal string, t int, value double").withColumn("i", F.monotonically_increasing_id())
    prof = Q.commissioning_verdicts(Q.commissioning_profile(Q.range_checked(flat, c), "signal", "t", "value", "i"), F.lit(10.0))
    assert set(prof.first()["issues"]) == {"time_goes_back", "slow", "constant"}


def test_store_upsert_and_scan(spark, tmp_path):
    store = CycleStore(spark, f"file://{tmp_path}/store")
    assert store.read().count() == 0
    rows = lambda xs: spark.createDataFrame([("press 1", c, a) for c, a in xs], "stream string, cycle long, a double")
    store.upsert(rows([(1, 1.0), (2, 2.0), (3, 3.0)]))
    store.upsert(rows([(3, 30.0), (4, 4.0)]))
    assert sorted((r["cycle"], r["a"]) for r in store.read("press 1").collect()) == [(1, 1.0), (2, 2.0), (3, 30.0), (4, 4.0)]
    assert sorted(r["cycle"] for r in store.read("press 1", ["a"], 2, 4).collect()) == [2, 3]
    assert store.streams() == ["press_1"]
    before = content_hash(store.read()).first()
    store.upsert(rows([(3, 30.0), (4, 4.0)]))
    assert content_hash(store.read()).first() == before
    other = spark.createDataFrame([("press 2", 1, 9.0, "x")], "stream string, cycle long, a double, b string")
    store.upsert(other)
    assert store.streams() == ["press_1", "press_2"] and store.read("press 2").first()["b"] == "x" and store.read().count() == 5
    assert store._state()[1]["press_1"] != store._state()[1]["press_2"]
    stale = CycleStore(spark, store.root)
    stale._state = lambda state=store._state(): state
    store.upsert(other)
    with pytest.raises(RuntimeError, match="another writer"):
        stale.upsert(other)
    store.vacuum()
    assert store.read().count() == 5 and len(store._commits()) == 1
    store = CycleStore(spark, f"file://{tmp_path}/plain")
    store.upsert(rows([(1, 1.0), (2, 2.0), (3, 30.0), (4, 4.0)]))
    assert '"rows": 4' in manifest(store.read(), "stream") and markdown(store.read("press 1").orderBy("cycle")).startswith("| a |") is False


def test_features_of_a_known_cycle(spark):
    from millrace.operators.features import feature_rows

    y = [90.0, 40.0, 10.0, 10.1, 9.9, 10.0, 10.1, 9.9, 20.0, 20.1, 19.9, 20.0]
    rows = [("a", i, 100.0 + 2 * i, v) for i, v in enumerate(y)] + [("a", 12, 124.0, 1e9), ("a", 13, 126.0, None), ("b", 0, 5.0, 7.0)]
    df = spark.createDataFrame(rows, "k string, i int, t double, v double")
    got = {r["k"]: r for r in feature_rows(df, ["k"], ["i"], "t", "v", F.lit(0.0), F.lit(100.0)).collect()}
    a, b = got["a"], got["b"]
    assert (a["n"], a["n_rejected"], a["duration"], a["first"], a["last"]) == (12, 2, 22.0, 90.0, 20.0)
    assert a["transient"] == 2 and a["onset"] == 8 and a["change"] == pytest.approx(10.0) and a["settled_mean"] == pytest.approx(np.mean(y[2:]))
    assert a["slope"] == pytest.approx(np.polyfit(2.0 * np.arange(12), y, 1)[0]) and a["area"] == pytest.approx(np.trapezoid(y, dx=2.0)) and a["peak_at"] == 0.0
    assert a["end_slope"] == pytest.approx(np.polyfit(2.0 * np.arange(5), y[-5:], 1)[0]) and a["noise"] == pytest.approx(np.sqrt(np.mean(np.diff(y, 2) ** 2) / 6))
    assert b["n"] == 1 and b["onset"] is None and b["transient"] == 0 and b["area"] == 0.0


def test_pooled_prediction_is_the_mean_and_variance_over_draws(spark):
    rng = np.random.default_rng(8)
    rows = [(float(rng.random()), "xyz"[i % 3], int(i % 4), float(rng.random())) for i in range(200)]
    df = spark.createDataFrame(rows, "x double, g string, h int, y double")
    model = R.fit_pooled(df, ["x"], ["g", "h"], "y", 300, 100, 1)
    new = spark.createDataFrame([(0.5, "x", 1), (0.1, "new", 2), (0.2, None, 9)], "x double, g string, h int")
    for r in R.predict_pooled(new, model, ["g", "h"]).collect():
        value, extra = model.draws[:, 0] + r["x"] * model.draws[:, 1], model.sigma2.mean()
        for a, (name, at) in enumerate((("g", 2), ("h", 5))):
            if r[name] in model.levels[name]:
                value = value + model.draws[:, at + model.levels[name].index(r[name])]
            else:
                extra += model.tau2[:, a].mean()
        assert r["predicted"] == pytest.approx(value.mean()) and r["variance"] == pytest.approx(value.var() + extra)


def test_geweke_of_white_and_drifting_chains():
    rng = np.random.default_rng(3)
    z = np.array([R.geweke(rng.standard_normal(2000)) for _ in range(200)])
    assert 0.8 < z.std() < 1.3 and abs(R.geweke(np.linspace(0, 5, 2000) + rng.standard_normal(2000))) > 5 and R.geweke(np.ones(50)) == 0


def test_joint_limits_against_all_quantiles(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((3000, 2)) @ [[1, 0.6], [0, 1]]
    limits = A.joint_limits(spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double"), ["a", "b"], 0.05, 500)
    alarm = lambda q: np.mean((x > np.quantile(x, q, axis=0, method="inverted_cdf")).any(axis=1))
    want = min(q for q in 0.95 + 0.05 * np.arange(501) / 500 if alarm(q) <= 0.05)
    assert [limits["a"], limits["b"]] == pytest.approx(np.quantile(x, want, axis=0, method="inverted_cdf"))


def test_joint_limits_are_values_of_exact_rank(spark):
    n = 300_000
    x = np.stack([np.arange(n) * 7919 % n / 7, np.arange(n) * 104729 % n // 1000], axis=1).astype(float)  # all different; 1,000 of each
    df = spark.range(n).select((F.col("id") * 7919 % n / 7).alias("a"), F.floor(F.col("id") * 104729 % n / 1000).cast("double").alias("b"))
    ordered, q = np.sort(x, axis=0), [1 - 0.02 + 0.02 * j / 1000 for j in range(1001)]
    grid = ordered[[math.ceil(p * n) - 1 for p in q]]
    at = next(j for j in range(1001) if (x > grid[j]).any(axis=1).sum() <= 0.02 * n)
    assert A.joint_limits(df, ["a", "b"], 0.02) == {"a": grid[at, 0], "b": grid[at, 1]}
    with_nulls = df.select("a", F.when(F.col("b") < 10, F.col("b")).alias("b"), F.lit(None).cast("double").alias("c"))
    got = A.exact_quantiles(with_nulls, ["a", "b", "c"], [0.5, 0.75, 1.0])
    assert got[0].tolist() == ordered[[n // 2 - 1, 3 * n // 4 - 1, n - 1], 0].tolist() and got[1].tolist() == [4.0, 7.0, 9.0] and got[2] is None


def test_block_bootstrap_of_a_rate(spark):
    rng = np.random.default_rng(7)
    df = spark.createDataFrame([("a", i, bool(v)) for i, v in enumerate(rng.random(3000) < 0.2)], "k string, i int, f boolean")
    rate, low, high = A.block_bootstrap_rate(A.block_rates(df, ["k"], "i", "f", 10), 500, 2)
    assert low < rate < high and rate == pytest.approx(0.2, abs=0.03) and high - low == pytest.approx(2 * 1.645 * math.sqrt(0.16 / 3000), rel=0.3)


def test_ewma_path_and_moments(spark):
    rng = np.random.default_rng(5)
    x, z, want = rng.standard_normal((300, 2)), np.array([1.0, -2.0]), []
    for v in x:
        z = 0.1 * v + 0.9 * z
        want.append(z)
    assert np.allclose(M.ewma_path(x, 0.1, np.array([1.0, -2.0])), want)
    df = spark.createDataFrame([([float(1e6 + a) for a in r],) for r in rng.standard_normal((400, 5))] + [(None,)], "v array<double>").repartition(5)
    mean, cov, n = M.vector_moments(df, "v")
    rows = np.array([r["v"] for r in df.where("v is not null").collect()])
    assert n == 400 and np.allclose(mean, rows.mean(axis=0)) and np.allclose(cov, np.cov(rows.T))
