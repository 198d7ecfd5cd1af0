"""Special functions and distributions on numpy arrays."""

from __future__ import annotations

import math

import numpy as np

_erf = np.vectorize(math.erf, otypes=[float])
_lgamma = np.vectorize(math.lgamma, otypes=[float])


def norm_cdf(x):
    return 0.5 * (1 + _erf(np.asarray(x, float) / math.sqrt(2)))


def norm_pdf(x):
    x = np.asarray(x, float)
    return np.exp(-0.5 * x * x) / math.sqrt(2 * math.pi)


def norm_ppf(p):
    """By Newton's method on the distribution function, started from a logistic guess."""
    p = np.clip(np.asarray(p, float), 1e-300, 1 - 1e-16)
    x = np.log(p / (1 - p)) * 0.5513
    low, high = np.full_like(x, -39.0), np.full_like(x, 9.0)
    for _ in range(60):
        f = norm_cdf(x) - p
        low, high = np.where(f < 0, x, low), np.where(f > 0, x, high)
        d = norm_pdf(x)
        step = np.where(d > 1e-300, x - f / np.maximum(d, 1e-300), (low + high) / 2)
        x = np.where((step > low) & (step < high), step, (low + high) / 2)
    return x


def digamma(x):
    """Recurrence up to 10, then the asymptotic series."""
    x = np.asarray(x, float).copy()
    out = np.zeros_like(x)
    while (small := x < 10).any():
        out = np.where(small, out - 1 / x, out)
        x = np.where(small, x + 1, x)
    i2 = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - i2 * (1 / 12 - i2 * (1 / 120 - i2 * (1 / 252 - i2 / 240)))


def trigamma(x):
    x = np.asarray(x, float).copy()
    out = np.zeros_like(x)
    while (small := x < 10).any():
        out = np.where(small, out + 1 / (x * x), out)
        x = np.where(small, x + 1, x)
    i2 = 1 / (x * x)
    return out + 1 / x + i2 / 2 + (1 / x) * i2 * (1 / 6 - i2 * (1 / 30 - i2 * (1 / 42 - i2 / 30)))


def beta_cdf(x, a, b):
    """The regularised incomplete beta function, by Lentz's continued fraction."""
    x, a, b = np.broadcast_arrays(np.asarray(x, float), np.asarray(a, float), np.asarray(b, float))
    swap = x > (a + 1) / (a + b + 2)
    y, p, q = np.where(swap, 1 - x, x), np.where(swap, b, a), np.where(swap, a, b)
    y = np.clip(y, 1e-300, 1 - 1e-16)
    front = np.exp(_lgamma(p + q) - _lgamma(p) - _lgamma(q) + p * np.log(y) + q * np.log1p(-y)) / p
    tiny = 1e-300
    c, d = np.ones_like(y), 1 - (p + q) * y / (p + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 300):
        for top in (m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 + top * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + top / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * c * d
        if np.all(np.abs(c * d - 1) < 1e-15):
            break
    tail = front * h
    out = np.where(swap, 1 - tail, tail)
    return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, out))


def beta_pdf(x, a, b):
    x = np.asarray(x, float)
    inside = (x > 0) & (x < 1)
    y = np.where(inside, x, 0.5)
    return np.where(inside, np.exp(_lgamma(a + b) - _lgamma(a) - _lgamma(b) + (a - 1) * np.log(y) + (b - 1) * np.log1p(-y)), 0.0)


def beta_ppf(u, a, b):
    """By bisection on the distribution function."""
    u = np.asarray(u, float)
    low, high = np.zeros(np.broadcast(u, a, b).shape), np.ones(np.broadcast(u, a, b).shape)
    for _ in range(60):
        middle = (low + high) / 2
        below = beta_cdf(middle, a, b) < u
        low, high = np.where(below, middle, low), np.where(below, high, middle)
    return (low + high) / 2
