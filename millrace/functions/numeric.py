"""Scalar functions as column expressions; NumPy twins where a driver-side value is needed."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(x: Column, low: float | Column, high: float | Column) -> Column:
    lift = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.least(F.greatest(x, lift(low)), lift(high))


def logistic(x: Column) -> Column:
    """1 / (1 + e^-x) by way of tanh, which cannot overflow."""
    return 0.5 * (1 + F.tanh(x / 2))


#: Abramowitz and Stegun 7.1.26, complementary error function, absolute error below 1.5e-7.
_AS = (0.3275911, (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429))


def normal_cdf(x: Column) -> Column:
    """Standard normal distribution function, to 1e-7."""
    p, coefficients = _AS
    z = F.abs(x) / math.sqrt(2)
    t = 1 / (1 + p * z)
    poly = F.lit(0.0)
    for c in reversed(coefficients):
        poly = (poly + c) * t
    tail = poly * F.exp(-z * z) / 2
    return F.when(x >= 0, 1 - tail).otherwise(tail)


def normal_quantile(q: float) -> float:
    """Inverse of the standard normal distribution function by bisection on erfc."""
    low, high = -40.0, 40.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if 0.5 * math.erfc(-mid / math.sqrt(2)) < q else (low, mid)
    return (low + high) / 2


def chi2_cdf(x: float, k: float) -> float:
    a, x = k / 2, x / 2
    if x <= 0:
        return 0.0
    term = total = 1 / a
    n = a
    while term > total * 1e-16:
        n += 1
        term *= x / n
        total += term
    return min(1.0, total * math.exp(-x + a * math.log(x) - math.lgamma(a)))


def chi2_quantile(q: float, k: float) -> float:
    low, high = 0.0, k + 40 * math.sqrt(2 * k) + 40
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, k) < q else (low, mid)
    return (low + high) / 2


def log_sum_exp(xs: Column) -> Column:
    """Of an array, shifted by its maximum."""
    top = F.array_max(xs)
    return top + F.log(F.aggregate(xs, F.lit(0.0), lambda a, x: a + F.exp(x - top)))


def softmax(xs: Column) -> Column:
    top = F.array_max(xs)
    total = F.aggregate(xs, F.lit(0.0), lambda a, x: a + F.exp(x - top))
    return F.transform(xs, lambda x: F.exp(x - top) / total)


def dot(xs: Column, ys: Column) -> Column:
    return F.aggregate(F.zip_with(xs, ys, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda a, x: a + x)


def vector(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def temporal_split(position: Column, total: Column, train: float, calibrate: float, embargo: float) -> Column:
    """train, then a gap, then calibrate, then a gap, then test; rows in a gap belong to none."""
    share = position / total
    return (
        F.when(share < train, "train")
        .when(share < train + embargo, F.lit(None))
        .when(share < train + embargo + calibrate, "calibrate")
        .when(share < train + 2 * embargo + calibrate, F.lit(None))
        .otherwise("test")
    )


def ramp(cycle: Column, onset: float, length: float, shape: str, end: float | None = None) -> Column:
    """Activation of a change that starts at ``onset``: step, linear or exponential over ``length``."""
    u = (cycle - onset) / length
    level = {"step": F.lit(1.0), "linear": clip(u, 0.0, 1.0), "exp": 1 - F.exp(-u)}[shape]
    active = (cycle >= onset) if end is None else (cycle >= onset) & (cycle < end)
    return F.when(active, level).otherwise(0.0)
