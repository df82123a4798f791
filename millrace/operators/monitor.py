"""Multivariate process monitoring: principal components, Hotelling's T2, squared prediction error, MEWMA.

Published methods: Hotelling 1947; Jackson and Mudholkar 1979; Lowry et al. 1992. The model is small (a
mean, k components, their variances) and travels as literals.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.numeric import chi2_quantile, dot, vector
from millrace.operators.aggregates import covariance


@dataclass(frozen=True)
class Components:
    mean: np.ndarray
    axes: np.ndarray  # k x p, orthonormal
    variances: np.ndarray


def vector_moments(df: DataFrame, column: str) -> tuple[np.ndarray, np.ndarray, int]:
    """Mean, sample covariance and n of an array column in one pass: a task gives one count, sum and outer product, whatever its rows.

    Null vectors are left out. Sums are taken about the first row of the data, so that a large common offset loses no digits.
    """
    long = df.select(F.transform(F.col(column), lambda x: x.cast("double")).alias("v")).where("v is not null")
    first = long.first()
    if first is None:
        return np.zeros(0), np.zeros((0, 0)), 0
    about = np.array(first["v"], dtype=float)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, total, outer = 0, np.zeros(len(about)), np.zeros((len(about), len(about)))
        for b in batches:
            x = np.stack(b["v"].to_numpy()) - about if len(b) else np.zeros((0, len(about)))
            n, total, outer = n + len(x), total + x.sum(axis=0), outer + x.T @ x
        yield pd.DataFrame({"n": [n], "total": [total], "outer": [outer.ravel()]})

    n, total, outer = 0, np.zeros(len(about)), np.zeros((len(about), len(about)))
    for r in long.mapInPandas(sums, "n long, total array<double>, outer array<double>").toLocalIterator():  # one row a task
        n, total, outer = n + r["n"], total + np.array(r["total"]), outer + np.array(r["outer"]).reshape(outer.shape)
    cov = (outer - np.outer(total, total) / n) / max(1, n - 1)
    return about + total / n, cov, n


def fit_components(mean: np.ndarray, cov: np.ndarray, k: int) -> Components:
    """Leading eigenvectors; each has its largest entry positive, so the sign is fixed."""
    values, vectors = np.linalg.eigh(cov)
    axes = vectors[:, ::-1][:, :k].T
    axes = axes * np.sign(axes[np.arange(k), np.abs(axes).argmax(axis=1)])[:, None]
    return Components(mean, axes, values[::-1][:k])


def choose_k(cov: np.ndarray, share: float) -> int:
    """The fewest components that explain ``share`` of the variance."""
    values = np.sort(np.linalg.eigvalsh(cov))[::-1].clip(min=0)
    return int(np.searchsorted(np.cumsum(values) / values.sum(), share) + 1)


def project(df: DataFrame, column: str, model: Components) -> DataFrame:
    """Adds scores and spe, the squared length of what the components leave over."""
    centred = F.zip_with(F.col(column), vector(model.mean), lambda x, m: x.cast("double") - m)
    df = df.withColumn("_c", centred)
    df = df.withColumn("scores", F.array(*[dot(F.col("_c"), vector(a)) for a in model.axes]))
    return df.withColumn("spe", F.greatest(dot(F.col("_c"), F.col("_c")) - dot(F.col("scores"), F.col("scores")), F.lit(0.0))).drop("_c")


def t_squared(scores: Column, variances: np.ndarray) -> Column:
    return F.aggregate(F.zip_with(scores, vector(variances), lambda s, v: s * s / v), F.lit(0.0), lambda a, x: a + x)


def quadratic_form(xs: list[Column], inverse: np.ndarray) -> Column:
    total: Column = F.lit(0.0)
    for i in range(len(xs)):
        for j in range(i, len(xs)):
            total = total + float(inverse[i, j]) * (1 if i == j else 2) * xs[i] * xs[j]
    return total


def t_squared_of(df: DataFrame, cols: list[str], baseline: DataFrame) -> DataFrame:
    """Mahalanobis distance squared to the baseline's mean; a missing value stands at the mean."""
    mean, cov, _ = covariance(baseline, cols)
    inverse = np.linalg.pinv(cov)
    xs = [F.coalesce(F.col(c).cast("double"), F.lit(float(m))) - float(m) for c, m in zip(cols, mean, strict=True)]
    return df.withColumn("t2", quadratic_form(xs, inverse))


def charts(df: DataFrame, cols: list[str], mean: np.ndarray, cov: np.ndarray, k: int) -> DataFrame:
    """Adds t2 (Mahalanobis distance squared) and spe (squared distance from the plane of the k leading components); a missing value stands at the mean."""
    model = fit_components(mean, cov, k)
    xs = [F.coalesce(F.col(c).cast("double"), F.lit(float(m))) - float(m) for c, m in zip(cols, mean, strict=True)]
    plane = np.eye(len(cols)) - model.axes.T @ model.axes
    return df.withColumns({"t2": quadratic_form(xs, np.linalg.pinv(cov)), "spe": F.greatest(quadratic_form(xs, plane), F.lit(0.0))})


def spe_limit(residual_values: np.ndarray, z: float) -> float:
    """Jackson-Mudholkar limit from the eigenvalues of the left-over space."""
    t1, t2, t3 = (float(np.sum(residual_values**k)) for k in (1, 2, 3))
    h0 = 1 - 2 * t1 * t3 / (3 * t2 * t2)
    return t1 * (z * np.sqrt(2 * t2 * h0 * h0) / t1 + 1 + t2 * h0 * (h0 - 1) / (t1 * t1)) ** (1 / h0)


def ewma(xs: Column, weight: float) -> Column:
    """The whole path of z = w x + (1 - w) z, z starting at 0, of an ordered array."""
    none = F.array().cast("array<double>")
    return F.aggregate(xs, none, lambda a, x: F.concat(a, F.array(weight * x + (1 - weight) * F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0.0)))))


def ewma_summary(xs: Column, weight: float) -> Column:
    """The last value of ``ewma`` and its largest absolute value: (z, peak), in linear time."""
    begin = F.struct(F.lit(0.0).alias("z"), F.lit(0.0).alias("peak"))

    def step(a: Column, x: Column) -> Column:
        z = weight * x + (1 - weight) * a["z"]
        return F.struct(z.alias("z"), F.greatest(a["peak"], F.abs(z)).alias("peak"))

    return F.aggregate(xs, begin, step)


def ewma_path(x: np.ndarray, weight: float, start: np.ndarray, block: int = 128) -> np.ndarray:
    """z[t] = w x[t] + (1 - w) z[t - 1] for rows of vectors: a block at a time is a product with the powers of 1 - w."""
    lag = np.arange(block)[:, None] - np.arange(block)[None, :]
    powers = np.where(lag >= 0, weight * (1 - weight) ** np.maximum(lag, 0), 0.0)
    out, z = np.empty_like(x, dtype=float), np.asarray(start, dtype=float)
    for at in range(0, len(x), block):
        part = x[at : at + block]
        n = len(part)
        out[at : at + n] = powers[:n, :n] @ part + (1 - weight) ** np.arange(1, n + 1)[:, None] * z
        z = out[at + n - 1]
    return out


def mewma(df: DataFrame, by: list[str], order: list[str], cols: list[str], mean: np.ndarray, cov: np.ndarray, weight: float, keep: list[str] | None = None) -> DataFrame:
    """Multivariate EWMA statistic with the exact start-up covariance, one stream per group; ``keep``: columns that come along.

    The recursion runs over each stream's rows in order, a block at a time; streams are independent. A missing value stands at the mean.
    """
    inverse, held = np.linalg.pinv(cov), [*by, *order, *(keep or [])]
    schema = df.select(*held).schema.simpleString()[7:-1].replace(":", " ") + ", mewma double"

    def run(pdf):
        pdf = pdf.sort_values(order, kind="stable")
        x = pdf[cols].to_numpy(float)
        z = ewma_path(np.where(np.isnan(x), mean, x) - mean, weight, np.zeros(len(cols)))
        scale = weight / (2 - weight) * (1 - (1 - weight) ** (2.0 * np.arange(1, len(x) + 1)))
        return pdf[held].assign(mewma=np.einsum("ij,jk,ik->i", z, inverse, z) / scale)

    return df.groupBy(*by).applyInPandas(run, schema)


def contributions(df: DataFrame, cols: list[str], mean: np.ndarray, sd: np.ndarray, top: int = 3) -> DataFrame:
    """The features that are farthest out, by absolute z: array of (feature, z)."""
    z = F.array(*[F.struct(F.lit(c).alias("feature"), ((F.col(c) - float(m)) / float(s)).alias("z")) for c, m, s in zip(cols, mean, sd, strict=True)])
    known = F.filter(z, lambda e: e["z"].isNotNull())
    order = lambda a, b: F.when(F.abs(a["z"]) > F.abs(b["z"]), -1).when(F.abs(a["z"]) < F.abs(b["z"]), 1).when(a["feature"] < b["feature"], -1).otherwise(1)
    return df.withColumn("top", F.slice(F.array_sort(known, order), 1, top))


def alarms(df: DataFrame, limits: dict[str, float]) -> DataFrame:
    any_ = F.lit(False)
    for stat, limit in limits.items():
        any_ = any_ | (F.col(stat) > limit)
    return df.withColumn("alarm", F.coalesce(any_, F.lit(False)))


def first_alarms(df: DataFrame, by: list[str], order: str) -> DataFrame:
    return df.where("alarm").groupBy(*by).agg(F.min(order).alias("first_alarm"))


def t2_limit(k: int, rate: float) -> float:
    return chi2_quantile(1 - rate, k)
