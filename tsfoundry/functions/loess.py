"""Local linear smoothing on a regular grid, for one chunk of a series."""

from __future__ import annotations

import numpy as np


def loess_weights(n: int, q: int, at: float) -> tuple[int, np.ndarray]:
    """First index and weights of the local line through the q points nearest ``at``."""
    size = min(q, n)
    left = int(np.clip(round(at) - (size - 1) // 2, 0, n - size))
    j = np.arange(left, left + size, dtype=float)
    reach = max(at - left, left + size - 1 - at)
    if q > n:
        reach += (q - n) // 2
    r = np.abs(j - at)
    w = np.where(r <= 0.999 * reach, np.where(r <= 0.001 * reach, 1.0, (1 - (r / max(reach, 1e-300)) ** 3) ** 3), 0.0)
    w = w / w.sum()
    centre = w @ j
    spread = w @ (j - centre) ** 2
    if np.sqrt(spread) > 0.001 * (n - 1):
        w = w * (1 + (at - centre) / spread * (j - centre))
    return left, w


def loess(y: np.ndarray, q: int, extend: int = 0) -> np.ndarray:
    """Smooth ``y`` at every point, and at ``extend`` points beyond both ends."""
    n = len(y)
    if n == 1:
        return np.full(1 + 2 * extend, y[0])
    out = np.empty(n + 2 * extend)
    half = (min(q, n) - 1) // 2
    inner = np.arange(half, n - half) if q <= n else np.arange(0)
    if len(inner):
        _, w = loess_weights(n, q, float(half))
        out[extend + half: extend + half + len(inner)] = np.correlate(y, w, "valid")[: len(inner)]
    done = set(inner.tolist())
    for p in range(-extend, n + extend):
        if p not in done:
            left, w = loess_weights(n, q, float(p))
            out[extend + p] = w @ y[left: left + len(w)]
    return out


def moving_average(x: np.ndarray, k: int) -> np.ndarray:
    return np.convolve(x, np.full(k, 1.0 / k), "valid")


def stl(y: np.ndarray, period: int, seasonal: int = 7, inner: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Trend and seasonal part of the seasonal-trend decomposition, not robust."""
    n = len(y)
    trend_q = int(np.ceil(1.5 * period / (1 - 1.5 / seasonal)))
    trend_q += 1 - trend_q % 2
    low_q = period + 1 + period % 2
    trend, season = np.zeros(n), np.zeros(n)
    for _ in range(inner):
        rest = y - trend
        cycle = np.empty(n + 2 * period)
        for j in range(period):
            cycle[j::period] = loess(rest[j::period], seasonal, 1)
        low = moving_average(moving_average(moving_average(cycle, period), period), 3)
        season = cycle[period: period + n] - loess(low, low_q)
        trend = loess(y - season, trend_q)
    return trend, season


def stl_reach(period: int, seasonal: int = 7, inner: int = 5) -> int:
    """Rows beyond which a value has no influence, rounded up to whole periods."""
    trend_q = int(np.ceil(1.5 * period / (1 - 1.5 / seasonal))) + 1
    per_pass = (seasonal // 2 + 1) * period + (period + 2) + (period + 2) // 2 + trend_q // 2
    return -(-inner * per_pass // period) * period
