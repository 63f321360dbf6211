"""Tail probabilities for single test statistics (one number each, computed on the driver)."""

from __future__ import annotations

import math


def chi2_1_tail(x: float) -> float:
    return math.erfc(math.sqrt(x / 2.0))


def binomial_two_sided(k: int, n: int) -> float:
    """Exact two-sided test of k successes in n fair trials."""
    if n == 0:
        return 1.0
    low = min(k, n - k)
    return min(1.0, 2.0 * sum(math.comb(n, i) for i in range(low + 1)) / 2.0**n)


def f_tail(f: float, d1: float, d2: float) -> float:
    """Upper tail of the F distribution by the regularised incomplete beta function."""
    if f <= 0:
        return 1.0
    return _beta_regularised(d2 / (d2 + d1 * f), d2 / 2.0, d1 / 2.0)


def _beta_regularised(x: float, a: float, b: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1.0 - _beta_regularised(1.0 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    total = d
    for m in range(1, 500):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                     -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + step * d
            c = 1.0 + step / c
            d, c = 1.0 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            total *= d * c
        if abs(d * c - 1.0) < 1e-14:
            break
    return front * total
