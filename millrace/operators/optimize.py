"""Small optimisers on NumPy: bounded Levenberg-Marquardt, Nelder-Mead, recursive Bayesian regression."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def least_squares(residual: Callable[[np.ndarray], np.ndarray], start: np.ndarray, low: np.ndarray, high: np.ndarray, steps: int = 100) -> np.ndarray:
    """Levenberg-Marquardt with projection on a box and a numeric Jacobian."""
    x, damping = np.clip(np.asarray(start, float), low, high), 1e-2
    r = residual(x)
    for _ in range(steps):
        h = 1e-6 * np.maximum(1, np.abs(x))
        h = np.where(x + h > high, -h, h)
        jac = np.column_stack([(residual(x + np.eye(len(x))[k] * h[k]) - r) / h[k] for k in range(len(x))])
        normal, grad = jac.T @ jac, jac.T @ r
        for _ in range(12):
            step = np.linalg.lstsq(normal + damping * np.diag(np.maximum(np.diag(normal), 1e-12)), -grad, rcond=None)[0]
            new = np.clip(x + step, low, high)
            new_r = residual(new)
            if new_r @ new_r < r @ r:
                break
            damping *= 4
        else:
            return x
        done = r @ r - new_r @ new_r <= 1e-12 * (1 + r @ r)
        x, r, damping = new, new_r, max(damping / 5, 1e-12)
        if done:
            break
    return x


def nelder_mead(f: Callable[[np.ndarray], float], start: np.ndarray, scale: float = 0.1, steps: int = 400) -> np.ndarray:
    n = len(start)
    points = [np.asarray(start, float)] + [np.asarray(start, float) + scale * np.maximum(1, np.abs(start[k])) * np.eye(n)[k] for k in range(n)]
    values = [f(p) for p in points]
    for _ in range(steps):
        order = np.argsort(values)
        points, values = [points[k] for k in order], [values[k] for k in order]
        if abs(values[-1] - values[0]) < 1e-12 * (1 + abs(values[0])):
            break
        centre = np.mean(points[:-1], axis=0)
        trial = centre + (centre - points[-1])
        v = f(trial)
        if v < values[0]:
            far = centre + 2 * (centre - points[-1])
            if (w := f(far)) < v:
                trial, v = far, w
        elif v >= values[-2]:
            trial = centre + 0.5 * ((trial if v < values[-1] else points[-1]) - centre)
            v = f(trial)
            if v >= min(values[-1], f(centre + (centre - points[-1]))):
                points = [points[0]] + [points[0] + 0.5 * (p - points[0]) for p in points[1:]]
                values = [values[0]] + [f(p) for p in points[1:]]
                continue
        points[-1], values[-1] = trial, v
    return points[int(np.argmin(values))]


def recursive_regression(x: np.ndarray, y: np.ndarray, mean: np.ndarray, cov: np.ndarray, noise: float, drift: float = 0.0) -> tuple[np.ndarray, np.ndarray, float]:
    """Row-by-row Bayesian linear regression (a Kalman filter with static or drifting state): mean, covariance, log likelihood.

    Without drift the result equals the batch posterior, so it can be taken from mergeable sums as well.
    """
    mean, cov, loglik = mean.astype(float).copy(), cov.astype(float).copy(), 0.0
    for row, target in zip(x, y, strict=True):
        cov = cov + drift * np.eye(len(mean))
        s = row @ cov @ row + noise
        e = target - row @ mean
        gain = cov @ row / s
        mean, cov = mean + gain * e, cov - np.outer(gain, gain) * s
        loglik -= 0.5 * (np.log(2 * np.pi * s) + e * e / s)
    return mean, cov, float(loglik)


def batch_posterior(xx: np.ndarray, xy: np.ndarray, mean: np.ndarray, cov: np.ndarray, noise: float) -> tuple[np.ndarray, np.ndarray]:
    """The same posterior from X'X and X'y."""
    prior = np.linalg.inv(cov)
    post = np.linalg.inv(prior + xx / noise)
    return post @ (prior @ mean + xy / noise), post


def start_transient(x: np.ndarray, y: np.ndarray, k_sigma: float = 3.0) -> tuple[float, np.ndarray]:
    """End of a decaying start: a line plus an exponential, fitted in bounds, refitted without outliers; where the exponential falls below k_sigma of noise."""
    from millrace.operators.signal import noise_sd

    sd, span = max(noise_sd(y), 1e-9), float(x[-1] - x[0])
    shape = lambda p, at: p[0] + p[1] * (at - x[0]) + p[2] * np.exp(-(at - x[0]) / p[3])
    big = 10 * (np.ptp(y) + 1)
    low, high = np.array([y.min() - big, -big / span, -big, span / 200]), np.array([y.max() + big, big / span, big, span / 2])
    p = least_squares(lambda p: shape(p, x) - y, np.array([np.median(y), 0.0, y[0] - np.median(y), span / 20]), low, high)
    keep = np.abs(shape(p, x) - y) < 5 * sd
    if keep.sum() > 8:
        p = least_squares(lambda p: shape(p, x[keep]) - y[keep], p, low, high)
    end = x[0] + p[3] * max(0.0, np.log(max(abs(p[2]), 1e-12) / (k_sigma * sd)))
    return float(min(end, x[-1])), p
