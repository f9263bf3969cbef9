"""Student's t distribution, on the driver."""

from __future__ import annotations

import math


def _beta_share(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_share(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    total = d
    for m in range(1, 500):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + top * d
            c = 1 + top / c
            d = 1 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            total *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * total


def t_cdf(t: float, freedom: float) -> float:
    tail = 0.5 * _beta_share(freedom / (freedom + t * t), freedom / 2, 0.5)
    return 1 - tail if t >= 0 else tail


def t_quantile(p: float, freedom: float) -> float:
    if not 0 < p < 1:
        raise ValueError("p must be between 0 and 1")
    if p < 0.5:
        return -t_quantile(1 - p, freedom)
    low, high = 0.0, 1.0
    while t_cdf(high, freedom) < p:
        high *= 2
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if t_cdf(middle, freedom) < p else (low, middle)
    return (low + high) / 2
