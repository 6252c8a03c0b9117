import math

import numpy as np
import pytest

from tsfoundry.functions import mathx
from tsfoundry.functions.loess import stl
from tsfoundry.operators.neighbours import bds, knn_impute
from tsfoundry.operators.spectral import seasonal_decompose, stl_decompose

K = ["series_id"]


def brute_knn(x, k):
    out = x.copy()
    for c in range(x.shape[1]):
        for i in np.where(np.isnan(x[:, c]))[0]:
            found = []
            for j in np.where(~np.isnan(x[:, c]))[0]:
                both = ~np.isnan(x[i]) & ~np.isnan(x[j])
                if both.any():
                    found.append((math.sqrt(((x[i] - x[j])[both] ** 2).sum() * x.shape[1] / both.sum()), j))
            out[i, c] = np.mean([x[j, c] for _, j in sorted(found)[:k]]) if found else np.nanmean(x[:, c])
    return out


@pytest.mark.parametrize("size", [7, 2048])
def test_knn_impute_is_exact(series, size):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(90, 3))
    x[rng.random((90, 3)) < 0.15] = np.nan
    x[10:40, 0] = 0.25  # many equal values in the ordering column
    x[5] = np.nan
    cols = {c: [None if np.isnan(v) else v for v in x[:, j]] for j, c in enumerate("abc")}
    got = knn_impute(series(cols), K, "idx", ["a", "b", "c"], k=5, size=size).orderBy("idx").collect()
    want = brute_knn(x, 5)
    assert np.allclose([[r.a, r.b, r.c] for r in got], want)


@pytest.mark.parametrize("size", [16, 4096])
def test_bds(series, size):
    rng = np.random.default_rng(5)
    x = np.zeros(90)
    for i in range(1, 90):
        x[i] = 0.6 * x[i - 1] + rng.normal()
    n = len(x)
    near = np.abs(x[:, None] - x[None, :]) < 1.5 * x.std(ddof=1)
    up = np.triu_indices
    c1, cl = near[up(n, 1)].mean(), near[1:, 1:][up(n - 1, 1)].mean()
    joint = near[1:, 1:] & near[:-1, :-1]
    c2 = joint[up(n - 1, 1)].mean()
    k = ((near.sum(1) ** 2).sum() - 3 * near.sum() + 2 * n) / (n * (n - 1) * (n - 2))
    stat = math.sqrt(n - 1) * (c2 - cl**2) / math.sqrt(4 * (k**2 - 2 * k * c1**2 + c1**4))
    got = bds(series({"y": x}), K, "idx", "y", size=size).first()
    assert got.statistic == pytest.approx(stat, rel=1e-9)
    assert got.p_value == pytest.approx(2 * mathx.norm_sf(abs(stat)), rel=1e-9)


def test_stl_recovers_line_and_season():
    t = np.arange(12 * 8)
    season = np.tile(np.arange(12) - 5.5, 8)
    trend, seasonal = stl(0.3 * t + 2 + season, 12)
    assert np.allclose(trend, 0.3 * t + 2, atol=1e-6) and np.allclose(seasonal, season, atol=1e-6)


def test_stl_in_chunks_equals_the_whole(series):
    rng = np.random.default_rng(7)
    n = 700
    y = np.cumsum(rng.normal(size=n)) + 5 * np.sin(np.arange(n) / 6 * 2 * np.pi)
    trend, seasonal = stl(y, 6)
    rows = stl_decompose(series({"y": y}, start=3), K, "idx", "y", 6, chunk=120).orderBy("idx").collect()
    assert len(rows) == n
    assert np.allclose([r.trend for r in rows], trend, atol=1e-9)
    assert np.allclose([r.seasonal for r in rows], seasonal, atol=1e-9)


@pytest.mark.parametrize("period", [4, 5])
def test_classical_decomposition(series, period):
    n = 40
    season = np.tile(np.arange(period) - (period - 1) / 2, n // period)
    y = 2.0 * np.arange(n) + season
    rows = seasonal_decompose(series({"y": y}), K, "idx", "y", period).orderBy("idx").collect()
    half = period // 2
    assert [r.trend is None for r in rows] == [i < half or i >= n - half for i in range(n)]
    for i, r in enumerate(rows):
        assert r.seasonal == pytest.approx(season[i])
        if r.trend is not None:
            assert r.trend == pytest.approx(2.0 * i) and r.resid == pytest.approx(0.0, abs=1e-9)
