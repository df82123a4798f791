"""Every registered query runs; those with SQL give DuckDB's rows."""

from __future__ import annotations

import hashlib
import math

import duckdb
import numpy as np
import pandas as pd
import pytest

from millrace.operators import signal as G
from millrace.plans import evaluation, ordered, relational, streams  # noqa: F401
from millrace.plans.registry import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v + 0.0
    return tuple(plain(x) for x in v) if isinstance(v, list) else v


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return c


def curves(data):
    e = pd.read_parquet(f"{data}/events.parquet").sort_values(["user_id", "ts", "event_id"], kind="stable")
    e["t"] = (e["ts"] - pd.Timestamp("2024-01-01")).dt.total_seconds()
    return [g.reset_index(drop=True) for _, g in e.groupby("user_id")]


def per_row(data, fn, *names):
    """Rows (event_id, ...) of a function of each curve's values."""
    return {int(i): tuple(float(x) for x in row) for g in curves(data) for i, *row in zip(g["event_id"], *fn(g), strict=True)}


def same(got, names, want, tolerance=2e-6):
    assert {r["event_id"] for r in got} == set(want)
    assert all(abs(float(r[n]) - x) <= tolerance for r in got for n, x in zip(names, want[r["event_id"]], strict=True))


def run_lengths(z, hazard):
    """Change-point posterior with every run kept, by the recursion as published: run length -> (weight, mean, variance)."""
    runs, out = {0: (1.0, 0.0, 1.0)}, []
    for t, v in enumerate(z):
        after, born = {}, 0.0
        for r, (w, m, s) in runs.items():
            like = w * math.exp(-0.5 * (v - m) ** 2 / (1 + s)) / math.sqrt(2 * math.pi * (1 + s))
            after[r + 1] = (like * (1 - hazard), m + s / (1 + s) * (v - m), s / (1 + s))
            born += like * hazard
        after[0] = (born, 0.0, 1.0)
        total = sum(w for w, _, _ in after.values())
        runs = {r: (w / total, m, s) for r, (w, m, s) in after.items()}
        out.append(runs[0][0] + runs[1][0] if t else hazard)
    return out


def brute_a18(got, data):
    e, r = pd.read_parquet(f"{data}/events.parquet"), got[0]
    own = [g.to_numpy() for _, g in e.groupby("user_id")["value"]]
    rng = np.random.default_rng(0)
    means = [np.concatenate([own[k] for k in rng.integers(0, len(own), len(own))]).mean() for _ in range(2000)]
    low, high = np.percentile(means, [5, 95])
    assert r["mean"] == pytest.approx(e["value"].mean()) and abs(r["low"] - low) < 0.3 * (high - low) and abs(r["high"] - high) < 0.3 * (high - low)


def brute_e6(got, data):
    x = np.stack(pd.read_parquet(f"{data}/embeddings.parquet")["embedding"])
    values = np.sort(np.linalg.eigvalsh(np.cov(x.astype(float).T)))[::-1]
    k = int(np.argmax(np.cumsum(values) >= 0.8 * values.sum())) + 1
    assert [r["variance"] for r in sorted(got, key=lambda r: r["component"])] == pytest.approx(values[:k], abs=2e-6)


def brute_e7(got, data):
    e = pd.read_parquet(f"{data}/embeddings.parquet")
    x = np.stack(e["embedding"]).astype(float)
    x -= x.mean(axis=0)
    u, s, v = np.linalg.svd(x, full_matrices=False)
    t2, spe = (u[:, :5] ** 2).sum(axis=1) * (len(x) - 1), ((x - x @ v[:5].T @ v[:5]) ** 2).sum(axis=1)
    want = dict(zip(e["vec_id"], zip(t2, spe, strict=True), strict=True))
    assert all((r["t2"], r["spe"]) == pytest.approx(want[r["vec_id"]], abs=1e-5) for r in got) and len(got) == len(e)


def design(data):
    li = pd.read_parquet(f"{data}/lineitem.parquet")
    return li, np.column_stack([np.log(li["l_quantity"].astype(float)), li["l_discount"].astype(float)]), np.log(li["l_extendedprice"].astype(float)), pd.get_dummies(li["l_returnflag"] + li["l_linestatus"]).to_numpy(float), pd.get_dummies(li["l_linenumber"]).to_numpy(float)


def brute_e15(got, data):
    _, x, y, a, b = design(data)
    beta = np.linalg.lstsq(np.column_stack([x, a, b]), y, rcond=None)[0]
    rows = {r["name"]: r for r in got}
    assert set(rows) == {"intercept", "x", "l_discount"}
    assert all(abs(rows[n]["mean"] - beta[i]) < 5 * rows[n]["sd"] + 1e-3 and abs(rows[n]["geweke"]) < 6 for i, n in enumerate(("x", "l_discount")))


def brute_e16(got, data):
    li, x, y, a, b = design(data)
    fit = np.column_stack([x, a, b])
    fixed = fit @ np.linalg.lstsq(fit, y, rcond=None)[0]
    sd = np.std(y - fixed)
    want = {(k, n): p for k, n, p in zip(li["l_orderkey"], li["l_linenumber"], fixed, strict=True)}
    off = np.array([r["predicted"] - want[r["l_orderkey"], r["l_linenumber"]] for r in got])
    assert len(got) == len(li) and np.abs(off).max() < 0.25 * sd and np.median([r["variance"] for r in got]) == pytest.approx(sd**2, rel=0.1)


def brute_m1(got, data):
    want = []
    for stream in range(16):
        x, a = 50.0, np.exp(-0.05)
        for step, e in enumerate(np.random.default_rng([11, stream]).standard_normal(500)):
            x = float(np.clip(50 + a * (x - 50) + 2 * np.sqrt((1 - a * a) / 0.1) * e, 0, 100))
            want.append((stream, step, x))
    rows = sorted((r["stream"], r["step"], r["value"]) for r in got)
    assert [r[:2] for r in rows] == [w[:2] for w in want] and [r[2] for r in rows] == pytest.approx([w[2] for w in want])


def brute_w2(got, data):
    risk = lambda y, w: np.mean((y - G.savgol_curve(y, w)) ** 2) + 2 * G.noise_sd(y) ** 2 * G.savgol_weights(w, 2)[w // 2]
    for g in curves(data):
        y = g["value"].to_numpy()
        found = next(r["window"] for r in got if r["user_id"] == g["user_id"][0])
        assert risk(y, found) <= min(risk(y, w) for w in (3, 5, 7, 9, 13, 17, 25) if w <= len(y)) + 1e-12


def brute_w12(got, data):
    rows = {(r["user_id"], r["i"]): r["y"] for r in got}
    for g in curves(data):
        t, y = g["t"].to_numpy(), g["value"].to_numpy()
        split = t[-1] - 0.2 * (t[-1] - t[0])
        at = [t[0] + (split - t[0]) * i / 20 for i in range(20)] + [split + (t[-1] - split) * i / 9 for i in range(10)]
        assert [rows[g["user_id"][0], i] for i in range(30)] == pytest.approx(np.interp(at, t, y), abs=2e-6)


def brute_k4(got, data):
    want = {n: hashlib.sha256(open(f"{data}/{n}", "rb").read()).hexdigest() for n in ("region.parquet", "nation.parquet")}
    assert {r["name"]: r["sha256"] for r in got} == want


#: Queries without SQL: what their rows must be, by plain Python over the files.
BRUTE = {
    "a18_cluster_bootstrap": brute_a18,
    "e6_functional_components": brute_e6,
    "e7_projection": brute_e7,
    "e15_partial_pooling": brute_e15,
    "e16_pooled_prediction": brute_e16,
    "k4_fingerprints": brute_k4,
    "m1_mean_reverting_process": brute_m1,
    "w2_window_choice": brute_w2,
    "w3_adaptive_window": lambda got, data: same(got, ["y", "window"], per_row(data, lambda g: G.lepski(g["value"].to_numpy(), [3, 5, 7, 11, 17, 25]))),
    "w4_zero_phase_lowpass": lambda got, data: same(got, ["y"], per_row(data, lambda g: [G.zero_phase(g["value"].to_numpy(), G.butterworth_sections(4, 0.1, 1.0))])),
    "w12_curve_registration": brute_w12,
    "e13_change_points": lambda got, data: same(got, ["p"], per_row(data, lambda g: [run_lengths((g["value"].to_numpy() - 50) / 25, 0.02)])),
    "e28_regime_particle_filter": lambda got, data: same(got, ["mean"], per_row(data, lambda g: [G.particle_filter(g["value"].to_numpy(), 300, np.array([0.0, 0.5]), np.array([0.5, 2.0]), 20.0, np.array([[0.95, 0.05], [0.1, 0.9]]), int(g["user_id"][0]))["mean"]])),
}


def test_every_query_is_held_against_something():
    assert set(QUERIES) == set(ORACLES) | set(BRUTE) and not set(ORACLES) & set(BRUTE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, duck, name):
    df = QUERIES[name](spark, data)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(plain(r[c]) for c in cols)) for r in df.collect())
    if name not in ORACLES:
        assert len(got) > 0
        BRUTE[name](df.collect(), data)
        return
    want = duck.sql(ORACLES[name])
    assert sorted(want.columns) == cols
    at = [want.columns.index(c) for c in cols]
    assert got == sorted(repr(tuple(plain(r[k]) for k in at)) for r in want.fetchall())
