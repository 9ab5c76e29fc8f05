"""Gamma distribution in numpy: maximum-likelihood fit and cumulative probability, and normal quantiles."""

from __future__ import annotations

from math import lgamma
from statistics import NormalDist

import numpy as np

CLIP = 1e-6


def digamma(x: np.ndarray) -> np.ndarray:
    """By recurrence up to 10, then the asymptotic series."""
    x = np.array(x, float)
    out = np.zeros_like(x)
    while (low := x < 10).any():
        out[low] -= 1 / x[low]
        x[low] += 1
    y = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y * (1 / 240 - y / 132))))


def trigamma(x: np.ndarray) -> np.ndarray:
    x = np.array(x, float)
    out = np.zeros_like(x)
    while (low := x < 10).any():
        out[low] += 1 / (x[low] * x[low])
        x[low] += 1
    y = 1 / (x * x)
    return out + 1 / x + y / 2 + y / x * (1 / 6 - y * (1 / 30 - y * (1 / 42 - y / 30)))


def gamma_fit(mean: np.ndarray, mean_log: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shapes and scales that maximise likelihood with location zero, by Newton's method on ln a - digamma(a) = s; NaN where
    values have no spread."""
    mean, mean_log = np.atleast_1d(np.asarray(mean, float)), np.atleast_1d(np.asarray(mean_log, float))
    with np.errstate(all="ignore"):
        s = np.log(mean) - mean_log
    a = np.full(len(s), np.nan)
    ok = np.isfinite(s) & (s > 1e-12)
    s, now = s[ok], (3 - s[ok] + np.sqrt((s[ok] - 3) ** 2 + 24 * s[ok])) / (12 * s[ok])
    for _ in range(50):
        step = (np.log(now) - digamma(now) - s) / (1 / now - trigamma(now))
        now, old = np.maximum(now - step, now / 10), now
        if (abs(now - old) <= 1e-14 * now).all():
            break
    a[ok] = now
    return a, mean / a


def gamma_cdf(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised lower incomplete gamma function P(a, x): a series below a + 1, a continued fraction above. Values that have
    converged to a double's precision leave the iteration."""
    x = np.asarray(x, float)
    a = np.broadcast_to(np.asarray(a, float), x.shape)
    shapes, of = np.unique(a, return_inverse=True)
    log_gamma = np.array([lgamma(v) if v > 0 else np.nan for v in shapes])[of]
    out = np.zeros_like(x)
    with np.errstate(all="ignore"):
        front = np.exp(-x + a * np.log(x) - log_gamma)
    i = np.flatnonzero((x > 0) & (x < a + 1))
    term = total = 1 / a[i]
    for k in range(1, 10_000):
        if not len(i):
            break
        term = term * x[i] / (a[i] + k)
        total = total + term
        out[i] = total * front[i]
        on = term > 1e-17 * total
        i, term, total = i[on], term[on], total[on]
    i = np.flatnonzero(x >= a + 1)
    b = x[i] + 1 - a[i]
    c, d = np.full(len(i), 1e300), 1 / b
    h = d
    for k in range(1, 10_000):
        if not len(i):
            break
        an = -k * (k - a[i])
        b = b + 2
        d = 1 / np.where(abs(an * d + b) < 1e-300, 1e-300, an * d + b)
        c = np.where(abs(b + an / c) < 1e-300, 1e-300, b + an / c)
        h = h * d * c
        out[i] = 1 - front[i] * h
        on = abs(d * c - 1) > 1e-14
        i, b, c, d, h = i[on], b[on], c[on], d[on], h[on]
    return out


def normal_quantile(p: np.ndarray) -> np.ndarray:
    """Of probabilities kept off 0 and 1 by CLIP."""
    p = np.clip(np.asarray(p, float), CLIP, 1 - CLIP)
    return np.fromiter(map(NormalDist().inv_cdf, p.tolist()), float, len(p))
