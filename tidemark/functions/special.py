"""Distribution functions Spark does not have, vectorised over small arrays.

Used on aggregated rows and inside window kernels, never per input row.
"""

from __future__ import annotations

import math

import numpy as np


def _log_beta(a, b):
    lg = np.vectorize(math.lgamma, otypes=[float])
    return lg(a) + lg(b) - lg(np.add(a, b))


def beta_inc(a, b, x):
    """Regularised incomplete beta by its continued fraction (modified Lentz)."""
    a, b, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(b, float), np.asarray(x, float))
    flip = x > (a + 1) / (a + b + 2)
    p, q, z = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    inside = (z > 0) & (z < 1)
    zz = np.where(inside, z, 0.5)
    front = np.exp(p * np.log(zz) + q * np.log1p(-zz) - _log_beta(p, q)) / p
    tiny = 1e-300
    c = np.ones_like(zz)
    d = 1 - (p + q) * zz / (p + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 400):
        m2 = 2 * m
        for num in (
            m * (q - m) * zz / ((p + m2 - 1) * (p + m2)),
            -(p + m) * (p + q + m) * zz / ((p + m2) * (p + m2 + 1)),
        ):
            d = 1 + num * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + num / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            step = c * d
            h = h * step
        if np.all(np.abs(step - 1) < 1e-15):
            break
    val = np.where(inside, front * h, np.where(z >= 1, 1.0, 0.0))
    return np.where(flip, 1 - val, val)


def t_two_sided(t, dof):
    """P(|T| >= |t|)."""
    t, dof = np.asarray(t, float), np.asarray(dof, float)
    return beta_inc(dof / 2, 0.5, dof / (dof + t * t))


def beta_ppf(p, a, b):
    """Inverse of ``beta_inc`` by bisection."""
    p, a, b = np.broadcast_arrays(np.asarray(p, float), np.asarray(a, float), np.asarray(b, float))
    lo, hi = np.zeros(p.shape), np.ones(p.shape)
    for _ in range(80):
        mid = (lo + hi) / 2
        low = beta_inc(a, b, mid) < p
        lo, hi = np.where(low, mid, lo), np.where(low, hi, mid)
    return (lo + hi) / 2


def binomial_interval(k, n, level: float = 0.95):
    """Exact (Clopper-Pearson) interval of a proportion."""
    k, n = np.asarray(k, float), np.asarray(n, float)
    tail = (1 - level) / 2
    lo = np.where(k > 0, beta_ppf(tail, np.maximum(k, 1), n - k + 1), 0.0)
    hi = np.where(k < n, beta_ppf(1 - tail, k + 1, np.maximum(n - k, 1)), 1.0)
    return lo, hi


def norm_cdf(x):
    return 0.5 * np.vectorize(math.erfc, otypes=[float])(-np.asarray(x, float) / math.sqrt(2))
