"""Tails of distributions, without further libraries."""

from __future__ import annotations

import math

import numpy as np


def normal_two_sided(z: np.ndarray) -> np.ndarray:
    return np.array([math.erfc(abs(v) / math.sqrt(2)) if v == v else np.nan for v in np.asarray(z, float)])


def beta_regularized(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction (Lentz)."""
    if not 0 <= x <= 1 or a <= 0 or b <= 0:
        return math.nan
    if x in (0.0, 1.0):
        return x
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_regularized(b, a, 1 - x)
    front = math.exp(a * math.log(x) + b * math.log1p(-x) - math.log(a) - (math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)))
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    f = d
    for k in range(1, 400):
        for term in (k * (b - k) * x / ((a + 2 * k - 1) * (a + 2 * k)), -(a + k) * (a + b + k) * x / ((a + 2 * k) * (a + 2 * k + 1))):
            d = 1 + term * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + term / c
            c = c if abs(c) > tiny else tiny
            f *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * f


def f_tail(f: float, d1: float, d2: float) -> float:
    """P(F >= f)."""
    return 1.0 if f <= 0 else beta_regularized(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def t_two_sided(t: float, df: float) -> float:
    return beta_regularized(df / 2, 0.5, df / (df + t * t)) if df > 0 else math.nan


def spline_basis(t: np.ndarray, interior: np.ndarray, degree: int = 3) -> np.ndarray:
    """B-spline basis on [0, 1] by the Cox-de Boor recursion, one column a function."""
    t = np.clip(np.asarray(t, float), 0, 1)
    knots = np.concatenate([np.zeros(degree + 1), np.asarray(interior, float), np.ones(degree + 1)])
    n = len(knots) - 1
    out = np.array([(knots[i] <= t) & (t < knots[i + 1]) for i in range(n)], float)
    last = np.flatnonzero(knots[:-1] < knots[1:])[-1]
    out[last][t == 1] = 1
    for d in range(1, degree + 1):
        new = np.zeros((n - d, len(t)))
        for i in range(n - d):
            a, b = knots[i + d] - knots[i], knots[i + d + 1] - knots[i + 1]
            new[i] = (t - knots[i]) / a * out[i] if a > 0 else 0
            if b > 0:
                new[i] += (knots[i + d + 1] - t) / b * out[i + 1]
        out = new
    return out.T
