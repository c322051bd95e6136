"""Tails of the usual distributions, as vectorised functions of numpy arrays (one value for each dataset)."""

from __future__ import annotations

import math

import numpy as np

from . import exact


def _each(f):
    return lambda *a: np.array([f(*map(float, x)) if all(v is not None and np.isfinite(v) for v in x) else np.nan for x in np.broadcast(*map(np.asarray, a))])


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny, c, d = 1e-300, 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + num * d, 1 + num / c
            d, c = 1 / (d if abs(d) > tiny else tiny), (c if abs(c) > tiny else tiny)
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def _chi2(x: float, df: float) -> float:
    """Upper tail: Poisson sum for even degrees, recurrence from the normal tail for odd ones."""
    if x <= 0:
        return 1.0
    k, h = int(df), x / 2
    term, total, start = (math.exp(-h), math.exp(-h), 1.0) if k % 2 == 0 else (0.0, math.erfc(math.sqrt(h)), 0.5)
    if k % 2:
        term = math.exp(-h) * math.sqrt(h) / math.gamma(1.5)
        steps = (k - 1) // 2
        for i in range(steps):
            total += term
            term *= h / (start + 1 + i)
        return min(total, 1.0)
    for i in range(1, k // 2):
        term *= h / i
        total += term
    return min(total, 1.0)


def _kolmogorov(d: float, n: float) -> float:
    """Two-sided asymptotic tail with the usual small-sample correction of the argument."""
    z = d * (math.sqrt(n) + 0.12 + 0.11 / math.sqrt(n))
    if z < 0.2:
        return 1.0
    return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * z * z) for k in range(1, 101))))


def _signed_rank(w: float, n: float) -> float:
    """Two-sided p-value of the lesser sum of signed ranks without ties."""
    if n > 50:
        spread = math.sqrt(n * (n + 1) * (2 * n + 1) / 24)
        return math.erfc(abs(w - n * (n + 1) / 4) / spread / math.sqrt(2))
    return exact.signed_rank([2 * k for k in range(1, int(n) + 1)], w)


normal_two_sided = _each(lambda z: math.erfc(abs(z) / math.sqrt(2)))
normal_cdf = _each(lambda z: 0.5 * math.erfc(-z / math.sqrt(2)))
t_two_sided = _each(lambda t, df: beta_inc(df / 2, 0.5, df / (df + t * t)))
f_upper = _each(lambda f, a, b: beta_inc(b / 2, a / 2, b / (b + a * f)) if f > 0 else 1.0)
chi2_upper = _each(_chi2)
signed_rank_two_sided = _each(_signed_rank)
kolmogorov_upper = _each(_kolmogorov)
