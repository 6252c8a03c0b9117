"""Distribution functions for scalars, applied to one test result per series."""

from __future__ import annotations

import math
from statistics import NormalDist

_NORMAL = NormalDist()


def norm_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2.0))


def norm_sf(x: float) -> float:
    return 0.5 * math.erfc(x / math.sqrt(2.0))


def norm_ppf(p: float) -> float:
    return _NORMAL.inv_cdf(p)


def gamma_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function Q(a, x)."""
    if x <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1.0 - total * front)
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / _guard(an * d + b, tiny)
        c = _guard(b + an / c, tiny)
        step = d * c
        h *= step
        if abs(step - 1) < 1e-15:
            break
    return front * h


def _guard(x: float, tiny: float) -> float:
    return x if abs(x) > tiny else tiny


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function I_x(a, b)."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - beta_inc(b, a, 1 - x)
    log_front = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    tiny = 1e-300
    c, d = 1.0, 1 / _guard(1 - (a + b) * x / (a + 1), tiny)
    h = d
    for m in range(1, 10_000):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for coefficient in (even, odd):
            d = 1 / _guard(1 + coefficient * d, tiny)
            c = _guard(1 + coefficient / c, tiny)
            step = c * d
            h *= step
        if abs(step - 1) < 1e-15:
            break
    return math.exp(log_front) * h / a


def t_two_sided(t: float, df: float) -> float:
    return beta_inc(df / 2, 0.5, df / (df + t * t))


def t_sf(t: float, df: float) -> float:
    half = 0.5 * t_two_sided(t, df)
    return half if t >= 0 else 1 - half


def f_sf(f: float, d1: float, d2: float) -> float:
    return 1.0 if f <= 0 else beta_inc(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def chi2_sf(x: float, k: float) -> float:
    return gamma_upper(k / 2, x / 2)


def interpolate(x: float, xs: list[float], ys: list[float]) -> float:
    """Piecewise linear with flat ends; ``xs`` ascending."""
    if x <= xs[0]:
        return ys[0]
    for (x0, y0), (x1, y1) in zip(zip(xs, ys), zip(xs[1:], ys[1:])):
        if x <= x1:
            return y0 + (y1 - y0) * (x - x0) / (x1 - x0)
    return ys[-1]
