import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tsfoundry.functions import mathx
from tsfoundry.functions.normal import norm_cdf, norm_ppf
from tsfoundry.operators import hypothesis as hy
from tsfoundry.operators.linalg import lagged, lasso

K = ["series_id"]


def ar(n, phi, seed):
    rng = np.random.default_rng(seed)
    y = np.zeros(n)
    for i in range(1, n):
        y[i] = phi * y[i - 1] + rng.normal()
    return y + 100


def ols(x, y):
    b, *_ = np.linalg.lstsq(x, y, rcond=None)
    r = y - x @ b
    return b, float(r @ r), np.linalg.inv(x.T @ x)


def test_distribution_functions():
    assert mathx.chi2_sf(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-10)
    assert mathx.chi2_sf(18.307038053275146, 10) == pytest.approx(0.05, abs=1e-10)
    assert mathx.t_two_sided(2.2281388519649385, 10) == pytest.approx(0.05, abs=1e-10)
    assert mathx.f_sf(4.102821015289854, 2, 10) == pytest.approx(0.05, abs=1e-8)
    assert mathx.t_sf(-2.2281388519649385, 10) == pytest.approx(0.975, abs=1e-10)


def test_normal_columns(spark):
    xs = [-9.0, -3.3, -1.0, 0.0, 0.4, 2.0, 7.5]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    for r in df.select("x", norm_cdf(F.col("x")).alias("p"), norm_ppf(norm_cdf(F.col("x"))).alias("b")).collect():
        assert r.p == pytest.approx(mathx.norm_cdf(r.x), rel=1e-6, abs=1e-15)
        if abs(r.x) < 6:
            assert r.b == pytest.approx(r.x, abs=1e-7)


@pytest.mark.parametrize("diff", [0, 1])
def test_adf(series, diff):
    raw = ar(160, 0.8, 4)
    y = np.diff(raw, diff) if diff else raw
    n = len(y)
    top = math.ceil(12 * (n / 100) ** 0.25)
    dy = np.diff(y)

    def design(lags, skip):
        t = np.arange(skip + 1, n)
        cols = [y[t - 1], np.ones(len(t)), *[dy[t - 1 - k] for k in range(1, lags + 1)]]
        return np.column_stack(cols), dy[t - 1]

    best = min(range(top + 1), key=lambda p: (lambda x, v: len(v) * math.log(ols(x, v)[1] / len(v)) + 2 * x.shape[1])(*design(p, top)))
    x, v = design(best, best)
    b, ssr, inv = ols(x, v)
    tau = b[0] / math.sqrt(ssr / (len(v) - x.shape[1]) * inv[0, 0])
    got = hy.adf(series({"y": raw}), K, "idx", "y", diff).first()
    assert got.lags == best and got.statistic == pytest.approx(tau, rel=1e-7)
    assert 0 <= got.p_value <= 1


@pytest.mark.parametrize("diff", [0, 1])
def test_kpss(series, diff):
    raw = ar(300, 0.6, 9)
    y = np.diff(raw, diff) if diff else raw
    n, r = len(y), y - y.mean()
    s0, s1 = r @ r / n, 0.0
    for i in range(1, int(n ** (2 / 9)) + 1):
        p = r[i:] @ r[:n - i] / (n / 2)
        s0, s1 = s0 + p, s1 + i * p
    lags = min(int(1.1447 * ((s1 / s0) ** 2) ** (1 / 3) * n ** (1 / 3)), n - 1)
    s_hat = (r @ r + 2 * sum((1 - i / (lags + 1)) * (r[i:] @ r[:n - i]) for i in range(1, lags + 1))) / n
    got = hy.kpss(series({"y": raw}), K, "idx", "y", diff).first()
    assert got.lags == lags
    assert got.statistic == pytest.approx((np.cumsum(r) ** 2).sum() / n**2 / s_hat, rel=1e-7)


def test_pacf_solves_yule_walker(series):
    y = ar(200, 0.7, 3)
    r = y - y.mean()
    n = len(r)
    g = np.array([r[k:] @ r[:n - k] / (n - k) for k in range(6)])
    got = [x.pacf for x in hy.pacf(series({"y": y}), K, "idx", "y", 5).orderBy("lag").collect()]
    for k in range(1, 6):
        toeplitz = np.array([[g[abs(i - j)] for j in range(k)] for i in range(k)])
        assert got[k] == pytest.approx(np.linalg.solve(toeplitz, g[1:k + 1])[-1], rel=1e-9)


def test_ljung_box_p_value(series):
    got = hy.ljung_box(series({"y": ar(100, 0.0, 1)}), K, "idx", "y", [10]).first()
    assert got.p_value == pytest.approx(mathx.chi2_sf(got.statistic, 10))


def test_anderson_darling_with_ties(series):
    y = np.round(np.random.default_rng(8).normal(5, 2, 80), 1)
    z = np.sort((y - y.mean()) / y.std(ddof=1))
    n = len(z)
    i = np.arange(1, n + 1)
    cdf = np.array([mathx.norm_cdf(v) for v in z])
    sf = np.array([mathx.norm_sf(v) for v in z])
    want = -n - ((2 * i - 1) * (np.log(cdf) + np.log(sf[::-1]))).sum() / n
    assert hy.anderson_darling(series({"y": y}), K, "y").first().statistic == pytest.approx(want, rel=1e-9)


def test_shapiro_wilk_published_example(series):
    weights = [148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]
    assert hy.shapiro_wilk(series({"y": weights}), K, "y").first().statistic == pytest.approx(0.79, abs=0.005)
    normal = [mathx.norm_ppf((i - 0.5) / 100) for i in range(1, 101)]
    good = hy.shapiro_wilk(series({"y": normal}), K, "y").first()
    assert good.statistic > 0.995 and good.p_value > 0.9
    skewed = hy.shapiro_wilk(series({"y": np.exp(normal)}), K, "y").first()
    assert skewed.p_value < 1e-6


def test_arch_granger_chow_vif(series):
    rng = np.random.default_rng(12)
    n = 220
    x = rng.normal(size=n) + 3
    y = np.zeros(n)
    for i in range(1, n):
        y[i] = 0.5 * y[i - 1] + 0.4 * x[i - 1] + rng.normal()
    df = series({"y": y, "x": x})
    t = np.arange(n)

    b, _, _ = ols(np.column_stack([np.ones(n), t]), y)
    sq = (y - b[0] - b[1] * t) ** 2
    rows = np.arange(10, n)
    d = np.column_stack([np.ones(len(rows)), *[sq[rows - k] for k in range(1, 11)]])
    v = sq[rows]
    stat = len(v) * (1 - ols(d, v)[1] / ((v - v.mean()) ** 2).sum())
    assert hy.arch_lm(df, K, "idx", "y").first().statistic == pytest.approx(stat, rel=1e-7)

    L = 3
    rows = np.arange(L, n)
    own = np.column_stack([np.ones(len(rows)), *[y[rows - k] for k in range(1, L + 1)]])
    full = np.column_stack([own, *[x[rows - k] for k in range(1, L + 1)]])
    r0, r1 = ols(own, y[rows])[1], ols(full, y[rows])[1]
    f = (r0 - r1) / L / (r1 / (len(rows) - 2 * L - 1))
    got = hy.granger(df, K, "idx", "y", ["x"], L).first()
    assert got.statistic == pytest.approx(f, rel=1e-7) and got.p_value < 0.01

    xs, h = np.column_stack([np.ones(n), x]), n // 2
    whole, a, c = ols(xs, y)[1], ols(xs[:h], y[:h])[1], ols(xs[h:], y[h:])[1]
    chow = ((whole - a - c) / 2) / ((a + c) / (n - 4))
    assert hy.chow(df, K, "idx", "y", ["x"]).first().statistic == pytest.approx(chow, rel=1e-7)

    want = (x @ x) / ols(y[:, None], x)[1]
    got = {r.feature: r.vif for r in hy.vif(df, K, ["y", "x"]).collect()}
    assert got["x"] == pytest.approx(want, rel=1e-9)

    small = hy.anova_nested(df.withColumn("z", F.col("idx").cast("double")), K, "y", ["x"], ["x", "z"]).first()
    s0, s1 = ols(xs, y)[1], ols(np.column_stack([xs, t]), y)[1]
    assert small.statistic == pytest.approx((s0 - s1) / (s1 / (n - 3)), rel=1e-6)


def test_johansen(series):
    rng = np.random.default_rng(21)
    n = 150
    x = np.cumsum(rng.normal(size=n))
    y = x + rng.normal(size=n)
    got = hy.johansen(series({"y": y, "x": x}), K, "idx", ["y", "x"]).orderBy("rank").collect()
    data = np.column_stack([y, x])
    data = data - data.mean(0)
    dx = np.diff(data, axis=0)
    z, d, lv = dx[:-1], dx[1:], data[1:-1]
    z, d, lv = [m - m.mean(0) for m in (z, d, lv)]

    def resid(m):
        return m - z @ np.linalg.lstsq(z, m, rcond=None)[0]

    r0, rk = resid(d), resid(lv)
    s00, skk, sk0 = r0.T @ r0 / len(r0), rk.T @ rk / len(r0), rk.T @ r0 / len(r0)
    eig = np.sort(np.real(np.linalg.eigvals(np.linalg.inv(skk) @ sk0 @ np.linalg.inv(s00) @ sk0.T)))[::-1]
    logs = -len(r0) * np.log(1 - eig)
    assert got[0].trace == pytest.approx(logs.sum(), rel=1e-7)
    assert got[1].max_eigen == pytest.approx(logs[1], rel=1e-7)


def test_lof_matches_brute_force(series):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(0, 1, 60), [8.0, 9.0], [0.5, 0.5, 0.5]])
    k = 5
    n = len(x)
    dist = np.abs(x[:, None] - x[None, :])
    np.fill_diagonal(dist, np.inf)
    near = np.argsort(dist, axis=1, kind="stable")[:, :k]
    kd = np.take_along_axis(dist, near, 1)[:, -1]
    lrd = np.array([1 / (np.maximum(dist[i, near[i]], kd[near[i]]).mean() + 1e-10) for i in range(n)])
    want = np.array([lrd[near[i]].mean() / lrd[i] for i in range(n)])
    got = np.array([r.lof for r in hy.lof(series({"y": x}), K, "idx", "y", k).orderBy("idx").collect()])
    assert np.allclose(got, want, rtol=1e-6)


def test_lasso_optimality():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(100, 3))
    y = x @ [2.0, 0.0, -1.0] + rng.normal(size=100)
    z = np.column_stack([x, y])
    b = lasso(z.T @ z, 100, range(3), 3, 0.1)
    grad = x.T @ (y - x @ b) / 100
    for g, w in zip(grad, b):
        assert (abs(g) <= 0.1 + 1e-8) if w == 0 else g == pytest.approx(0.1 * np.sign(w), abs=1e-8)


def test_diebold_mariano_alternatives(spark):
    rows = [(float(i), float(i) + 0.1 * (i % 3), float(i) + 1 + 0.1 * (i % 2)) for i in range(30)]
    df = spark.createDataFrame(rows, "y double, a double, b double")
    two, less, greater = [hy.diebold_mariano(df, [], "y", "a", "b", alternative=x).first() for x in ("two-sided", "less", "greater")]
    assert two.statistic < 0 and two.p_value < 1e-6
    assert less.p_value + greater.p_value == pytest.approx(1.0)
    assert less.p_value == pytest.approx(two.p_value / 2)


def test_lagged():
    assert np.isnan(lagged(np.arange(3.0), 5)).all()
    assert list(lagged(np.arange(4.0), 2)[2:]) == [0.0, 1.0]
