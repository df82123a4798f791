"""Partial pooling: Gaussian regression with crossed random intercepts, sampled from sufficient statistics.

Spark reduces the rows once to cross products of the design (fixed effects and one indicator per level);
the Gibbs sampler runs on those, so its cost does not depend on the number of rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Pooled:
    columns: list[str]
    levels: dict[str, list]
    draws: np.ndarray  # draw x (intercept, slopes, level effects)
    sigma2: np.ndarray
    tau2: np.ndarray  # draw x group


def cross_products(df: DataFrame, xs: list[str], groups: list[str], y: str) -> tuple[np.ndarray, np.ndarray, float, int, dict[str, list]]:
    """Z'Z, Z'y, y'y and n of the design [1, xs, indicators]. The driver gets sums per level and per pair of levels."""
    levels = {g: [r[0] for r in df.select(g).distinct().orderBy(g).collect()] for g in groups}
    one = [F.lit(1.0), *[F.col(c).cast("double") for c in xs]]
    k = len(one)
    size = k + sum(map(len, levels.values()))
    zz, zy = np.zeros((size, size)), np.zeros(size)
    at = {g: k + sum(len(levels[h]) for h in groups[: i]) for i, g in enumerate(groups)}
    place = {g: {v: at[g] + j for j, v in enumerate(levels[g])} for g in groups}
    target = F.col(y).cast("double")
    row = df.agg(*[F.sum(one[i] * one[j]).alias(f"{i}_{j}") for i in range(k) for j in range(k)], *[F.sum(one[i] * target).alias(f"y{i}") for i in range(k)], F.sum(target * target).alias("yy"), F.count("*").alias("n")).first()
    for i in range(k):
        zy[i] = row[f"y{i}"]
        for j in range(k):
            zz[i, j] = row[f"{i}_{j}"]
    for g in groups:
        for r in df.groupBy(g).agg(*[F.sum(o).alias(f"x{i}") for i, o in enumerate(one)], F.sum(target).alias("y")).collect():
            p = place[g][r[g]]
            zy[p], zz[p, p] = r["y"], r["x0"]
            for i in range(k):
                zz[p, i] = zz[i, p] = r[f"x{i}"]
    for a in range(len(groups)):
        for b in range(a + 1, len(groups)):
            for r in df.groupBy(groups[a], groups[b]).count().collect():
                p, q = place[groups[a]][r[0]], place[groups[b]][r[1]]
                zz[p, q] = zz[q, p] = r["count"]
    return zz, zy, row["yy"], row["n"], levels


def fit_pooled(df: DataFrame, xs: list[str], groups: list[str], y: str, iterations: int = 2000, burn_in: int = 500, seed: int = 0) -> Pooled:
    zz, zy, yy, n, levels = cross_products(df, xs, groups, y)
    k, rng = 1 + len(xs), np.random.default_rng(seed)
    spans, at = [], k
    for g in groups:
        spans.append(slice(at, at + len(levels[g])))
        at += len(levels[g])
    beta, sigma2, tau2 = np.zeros(at), max(yy / n, 1e-12), np.ones(len(groups))
    draws, s2, t2 = [], [], []
    for it in range(iterations):
        prior = np.zeros(at)
        prior[:k] = 1e-8
        for s, t in zip(spans, tau2, strict=True):
            prior[s] = 1 / t
        root = np.linalg.cholesky(zz / sigma2 + np.diag(prior))
        mean = np.linalg.solve(root.T, np.linalg.solve(root, zy / sigma2))
        beta = mean + np.linalg.solve(root.T, rng.standard_normal(at))
        sse = max(yy - 2 * beta @ zy + beta @ zz @ beta, 1e-12)
        sigma2 = (1e-3 + sse / 2) / rng.gamma(1e-3 + n / 2)
        tau2 = np.array([(1e-3 + np.sum(beta[s] ** 2) / 2) / rng.gamma(1e-3 + (s.stop - s.start) / 2) for s in spans])
        if it >= burn_in:
            draws.append(beta)
            s2.append(sigma2)
            t2.append(tau2)
    return Pooled(xs, levels, np.array(draws), np.array(s2), np.array(t2))


def long_run_variance(x: np.ndarray) -> float:
    """Spectral density at frequency zero, times 2 pi, by Bartlett weights up to the square root of the length (Newey and West, 1987)."""
    d, n = x - x.mean(), len(x)
    lags = int(math.isqrt(n))
    shares = [1 - j / (lags + 1) for j in range(1, lags + 1)]
    return float(d @ d / n + 2 * sum(w * (d[j:] @ d[:-j]) / n for j, w in enumerate(shares, 1)))


def geweke(chain: np.ndarray, head: float = 0.1, tail: float = 0.5) -> float:
    """Difference of the means of a chain's first and last parts in standard errors that allow for autocorrelation (Geweke, 1992); 0 for a constant chain."""
    first, last = np.array_split(chain, [max(2, round(head * len(chain)))])[0], chain[-max(2, round(tail * len(chain))) :]
    error = math.sqrt(max(0.0, long_run_variance(first) / len(first) + long_run_variance(last) / len(last)))
    return float(first.mean() - last.mean()) / error if error else 0.0


def coefficients(model: Pooled) -> list[tuple[str, float, float, float]]:
    """(name, mean, sd, Geweke z) of the intercept and slopes."""
    return [(name, float(model.draws[:, i].mean()), float(model.draws[:, i].std()), geweke(model.draws[:, i])) for i, name in enumerate(["intercept", *model.columns])]


def predict_pooled(df: DataFrame, model: Pooled, groups: list[str]) -> DataFrame:
    """Adds the posterior predictive mean and variance, as column expressions.

    Both are forms in the row's design vector: linear in the posterior mean, quadratic in the posterior covariance.
    What a level adds (its mean, its variance, its covariance with each fixed effect and with the levels of later
    groups) comes from small tables by a left join, so an unseen level adds nothing but its group's spread.
    """
    mean, cov = model.draws.mean(axis=0), np.cov(model.draws.T, bias=True).reshape(model.draws.shape[1], -1)
    k, spark = 1 + len(model.columns), df.sparkSession
    x = [F.lit(1.0), *[F.col(c).cast("double") for c in model.columns]]
    starts = np.cumsum([k, *[len(model.levels[g]) for g in groups]])
    predicted = sum((float(mean[i]) * x[i] for i in range(k)), F.lit(0.0))
    variance = F.lit(float(model.sigma2.mean())) + sum((float(cov[i, j]) * x[i] * x[j] for i in range(k) for j in range(k)), F.lit(0.0))
    kind = {g: df.schema[g].dataType.simpleString() for g in groups}
    extra: list[str] = []
    for a, g in enumerate(groups):
        own = [int(starts[a]) + i for i in range(len(model.levels[g]))]
        fields = [f"_l{a}_mean", f"_l{a}_var", *[f"_l{a}_x{i}" for i in range(k)]]
        rows = [(v, float(mean[p]), float(cov[p, p]), *[2 * float(cov[p, i]) for i in range(k)]) for v, p in zip(model.levels[g], own, strict=True)]
        df = df.join(spark.createDataFrame(rows, f"`{g}` {kind[g]}, " + ", ".join(f"{f} double" for f in fields)), g, "left")
        predicted = predicted + F.coalesce(fields[0], F.lit(0.0))
        with_fixed = sum((F.col(fields[2 + i]) * x[i] for i in range(k)), F.col(fields[1]))
        variance = variance + F.coalesce(with_fixed, F.lit(float(model.tau2[:, a].mean())))
        extra += fields
        for b in range(a + 1, len(groups)):
            other = groups[b]
            pairs = [(v, w, 2 * float(cov[p, int(starts[b]) + j])) for v, p in zip(model.levels[g], own, strict=True) for j, w in enumerate(model.levels[other])]
            df = df.join(spark.createDataFrame(pairs, f"`{g}` {kind[g]}, `{other}` {kind[other]}, _p{a}_{b} double"), [g, other], "left")
            variance = variance + F.coalesce(f"_p{a}_{b}", F.lit(0.0))
            extra.append(f"_p{a}_{b}")
    return df.withColumns({"predicted": predicted, "variance": variance}).drop(*extra)
