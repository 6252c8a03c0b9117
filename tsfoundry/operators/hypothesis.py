"""Statistical tests per series."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tsfoundry.functions import mathx
from tsfoundry.functions.normal import norm_cdf, norm_ppf
from tsfoundry.operators.chunking import over_chunks, row_numbers, running_sum
from tsfoundry.operators.linalg import centred_gram, finish, from_zero, gram, lag_gram, lagged, solve, unpack
from tsfoundry.operators.lookup import INTEGRAL, attach
from tsfoundry.operators.metrics import diebold_mariano_terms
from tsfoundry.operators.quantiles import exact_quantiles, value_cumcounts
from tsfoundry.operators.spectral import acf, autocovariances, centred
from tsfoundry.session import cut_lineage

RESULT = "statistic double, p_value double"


def _p(fn: Callable[..., float]) -> Callable:
    """Vectorised p-value over the few result rows."""

    @F.pandas_udf(T.DoubleType())
    def udf(*args: pd.Series) -> pd.Series:
        return pd.Series([
            None if any(v is None or v != v for v in vals) else fn(*vals) for vals in zip(*args)
        ], dtype="float64")

    return udf


chi2_p = _p(mathx.chi2_sf)
t_p = _p(mathx.t_two_sided)
t_upper_p = _p(mathx.t_sf)
f_p = _p(mathx.f_sf)
norm_two_sided_p = _p(lambda z: 2 * mathx.norm_sf(abs(z)))


def ratio(a: float, b: float) -> float | None:
    """``a / b``; null where a short or constant series leaves nothing to divide by."""
    value = a / b if b > 0 else math.nan
    return float(value) if math.isfinite(value) else None


def f_test(bound: float, free: float, d1: int, d2: int) -> dict:
    """Statistic and p-value of ``d1`` restrictions; nulls without degrees of freedom."""
    stat = ratio((bound - free) / d1, free / d2) if d2 > 0 else None
    return {"statistic": stat, "p_value": None if stat is None else mathx.f_sf(max(stat, 0.0), d1, d2)}


def trend(df: DataFrame, keys: Sequence[str], idx: str) -> DataFrame:
    """Add ``t``, the 0-based row position, and ``n``, the series length."""
    out = row_numbers(df, keys, idx, out="__rn", total="n")
    return out.withColumn("t", (F.col("__rn") - 1).cast("double")).drop("__rn")


def trend_residuals(df: DataFrame, keys: Sequence[str], idx: str, value: str) -> DataFrame:
    """Residuals ``r`` (and ``fitted``) of the regression of a series on time."""
    d = trend(df, keys, idx)
    fit = d.groupBy(*keys).agg(F.regr_slope(value, "t").alias("__b"), F.regr_intercept(value, "t").alias("__a"))
    out = attach(d, fit, keys, spread=[idx]).withColumn("fitted", F.col("__a") + F.col("__b") * F.col("t"))
    return out.withColumn("r", F.col(value) - F.col("fitted")).drop("__a", "__b")


def difference(df: DataFrame, keys: Sequence[str], idx: str, value: str, order: int) -> DataFrame:
    for _ in range(order):
        d = over_chunks(df, keys, idx, 1, lambda w: {"__d": F.col(value) - F.lag(value, 1).over(w)})
        df = d.filter(F.col("__d").isNotNull()).withColumn(value, F.col("__d")).drop("__d")
    return df


# --- stationarity -------------------------------------------------------------

# MacKinnon's approximate p-value surface, one variable, constant.
_TAU_STAR, _TAU_MIN, _TAU_MAX = -1.61, -18.83, 2.74
_TAU_SMALL = [2.1659, 1.4412, 0.038269]
_TAU_LARGE = [1.7339, 0.93202, -0.12745, -0.010368]


def mackinnon_p(tau: float) -> float:
    if tau > _TAU_MAX:
        return 1.0
    if tau < _TAU_MIN:
        return 0.0
    coefficients = _TAU_SMALL if tau <= _TAU_STAR else _TAU_LARGE
    return mathx.norm_cdf(sum(c * tau**i for i, c in enumerate(coefficients)))


def adf_lags(n: int) -> int:
    return max(0, min(math.ceil(12 * (n / 100) ** 0.25), n // 2 - 2))


def adf(df: DataFrame, keys: Sequence[str], idx: str, value: str, diff: int = 0) -> DataFrame:
    """Augmented Dickey-Fuller test with a constant; the lag order minimises AIC.

    One pass gives the Gram matrices of every sample the choice needs: the
    common sample of all candidates and, per candidate, the longer sample the
    final fit uses. They differ by the first rows only, so each is the common
    matrix plus those few rows.
    """
    d = difference(df.select(*keys, idx, value), keys, idx, value, diff)
    d = trend(d, keys, idx)
    c = centred(d, keys, [value]).select(*keys, idx, "t", "n", F.col(f"__d_{value}").alias("y"))

    def design(a: dict[str, np.ndarray]) -> np.ndarray:
        y, top = a["y"], adf_lags(int(a["n"][0]))
        dy = y - lagged(y, 1)
        past = [np.nan_to_num(lagged(dy, k)) for k in range(1, top + 1)]
        return np.column_stack([lagged(y, 1), np.ones_like(y), *past, dy])

    def common(a: dict[str, np.ndarray]) -> np.ndarray:
        return np.where((a["t"] > adf_lags(int(a["n"][0])))[:, None], design(a), np.nan)

    n = F.col("n").cast("double")
    cap = F.greatest(F.lit(0), F.least(F.ceil(12 * F.pow(n / 100, F.lit(0.25))), F.floor(n / 2) - 2)).cast("int")
    main = lag_gram(c, keys, idx, ["y", "t", "n"], cap + 2, common)
    first = c.filter(F.col("t") <= cap + 2).groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("t", "y"))).alias("head"), F.max("n").alias("len")
    )  # a few values per key more than lags
    joined = main.join(first.select(*keys, F.transform("head", lambda s: s["y"]).alias("head"), "len"), list(keys))
    fields = ", ".join(f"`{k}` {joined.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                rec = r._asdict()
                rows.append({**{k: rec[k] for k in keys}, **_adf_finish(
                    unpack(np.asarray(rec["g"], dtype=float)), int(rec["n"]), int(rec["len"]), np.asarray(rec["head"], dtype=float))})
            yield pd.DataFrame(rows, columns=[*keys, "lags", "statistic", "p_value"])

    return joined.mapInPandas(run, f"{fields}, lags int, {RESULT}")


def _adf_finish(m: np.ndarray, n: int, length: int, head: np.ndarray) -> dict:
    cap = adf_lags(length)
    y_col = m.shape[0] - 1
    best = (math.inf, 0)
    for p in range(cap + 1):
        if n < 1:
            break
        _, _, ssr = solve(m, range(2 + p), y_col)
        k = 2 + p
        aic = n * math.log(max(ssr, 1e-300) / n) + 2 * k
        if aic < best[0] - 1e-12:
            best = (aic, p)
    p = best[1]
    full, rows = m.copy(), n
    dy = np.diff(head)  # dy[i] belongs to row t = i + 1
    for t in range(p + 1, cap + 1):
        line = np.zeros(m.shape[0])
        line[0], line[1], line[y_col] = head[t - 1], 1.0, dy[t - 1]
        for k in range(1, p + 1):
            line[1 + k] = dy[t - 1 - k]
        full += np.outer(line, line)
        rows += 1
    b, inv, ssr = solve(full, range(2 + p), y_col)
    error = ssr / (rows - 2 - p) * inv[0, 0] if rows > 2 + p else 0.0
    if not error > 0:  # a short or constant series
        return {"lags": p, "statistic": None, "p_value": None}
    tau = b[0] / math.sqrt(error)
    return {"lags": p, "statistic": tau, "p_value": mackinnon_p(tau)}


# Critical values of the level-stationarity test and their p-values.
_KPSS_CRIT, _KPSS_P = [0.347, 0.463, 0.574, 0.739], [0.10, 0.05, 0.025, 0.01]


def kpss(df: DataFrame, keys: Sequence[str], idx: str, value: str, diff: int = 0) -> DataFrame:
    """Level-stationarity test with data-dependent bandwidth.

    A few short lags give each series its bandwidth, which then is a column of
    the second pass.
    """
    d = difference(df.select(*keys, idx, value), keys, idx, value, diff)
    length = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("__len"))
    short = F.greatest(F.lit(1), F.floor(F.pow(F.col("__len").cast("double"), F.lit(2 / 9))))
    row = autocovariances(attach(d, length, keys, spread=[idx]), keys, idx, value, short).withColumn("lags", _bandwidth_column())
    bandwidths = row.select(*keys, "lags")
    c = centred(d, keys, [value])
    steps = running_sum(c, keys, idx, {"s": F.col(f"__d_{value}")})
    eta = steps.groupBy(*keys).agg(F.sum(F.col("s") * F.col("s")).alias("ss"))
    wide = attach(d, bandwidths.withColumnRenamed("lags", "__reach"), keys, spread=[idx])
    cov = autocovariances(wide, keys, idx, value, F.greatest(F.lit(1), F.col("__reach"))).join(eta, list(keys)).join(bandwidths, list(keys))
    fields = ", ".join(f"`{k}` {cov.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                rec = r._asdict()
                n, sums = rec["n"], np.asarray(rec["gamma"], dtype=float) * rec["n"]
                lags = int(rec["lags"])
                near = sums[1:lags + 1]
                weights = 1 - np.arange(1, len(near) + 1) / (lags + 1)
                s_hat = (sums[0] + 2 * weights @ near) / n
                # a constant series has no answer
                stat = rec["ss"] / n**2 / s_hat if s_hat > 0 else None
                p = None if stat is None else mathx.interpolate(stat, _KPSS_CRIT, _KPSS_P)
                rows.append({**{k: rec[k] for k in keys}, "lags": lags, "statistic": stat, "p_value": p})
            yield pd.DataFrame(rows, columns=[*keys, "lags", "statistic", "p_value"])

    return cov.mapInPandas(run, f"{fields}, lags int, {RESULT}")


def _bandwidth_column() -> Column:
    """Automatic lag order from the columns ``n`` and ``gamma``, whose lags are the ones it uses."""
    n = F.col("n").cast("double")
    used = F.slice("gamma", 2, F.greatest(F.lit(0), F.size("gamma") - 1))
    far = F.transform(used, lambda g, i: g * (i + 1))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)
    s0, s1 = F.col("gamma")[0] + 2 * total(used), 2 * total(far)
    ratio = s1 / F.nullif(s0, F.lit(0.0))
    lags = F.floor(1.1447 * F.pow(ratio * ratio, F.lit(1 / 3)) * F.pow(n, F.lit(1 / 3)))
    return F.coalesce(F.least(lags, F.col("n") - 1), F.lit(0)).cast("int")


# --- autocorrelation ----------------------------------------------------------


def ljung_box(df: DataFrame, keys: Sequence[str], idx: str, value: str, lags: Sequence[int]) -> DataFrame:
    """Portmanteau statistic for each number of lags."""
    r = acf(df, keys, idx, value, max(lags)).filter(F.col("lag") > 0)
    term = F.col("acf") * F.col("acf") / (F.col("n") - F.col("lag"))
    sums = r.groupBy(*keys, "n").agg(*[F.sum(F.when(F.col("lag") <= k, term)).alias(f"k{k}") for k in lags])
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("lags"), F.col(f"k{k}").alias("s")) for k in lags]))
    long = sums.select(*keys, "n", rows.alias("r")).select(*keys, "n", "r.*")
    return long.select(*keys, "lags", (F.col("n") * (F.col("n") + 2) * F.col("s")).alias("statistic")).withColumn(
        "p_value", chi2_p("statistic", F.col("lags").cast("double"))
    )


def pacf(df: DataFrame, keys: Sequence[str], idx: str, value: str, max_lag: int) -> DataFrame:
    """Partial autocorrelations by Yule-Walker, products divided by n - k."""
    cov = autocovariances(df, keys, idx, value, max_lag)
    fields = ", ".join(f"`{k}` {cov.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                rec = r._asdict()
                n, g = rec["n"], np.asarray(rec["gamma"], dtype=float)
                for k, v in enumerate(durbin_levinson(g * n / (n - np.arange(len(g))))):
                    rows.append({**{c: rec[c] for c in keys}, "lag": k, "pacf": v})
            yield pd.DataFrame(rows, columns=[*keys, "lag", "pacf"])

    return cov.mapInPandas(run, f"{fields}, lag int, pacf double")


def durbin_levinson(gamma: np.ndarray) -> list[float]:
    out, phi, v = [1.0], np.zeros(0), gamma[0]
    for k in range(1, len(gamma)):
        if v <= 0:
            out.append(float("nan"))
            continue
        a = (gamma[k] - phi @ gamma[k - 1:0:-1][: len(phi)]) / v if k > 1 else gamma[1] / v
        phi = np.append(phi - a * phi[::-1], a)
        v *= 1 - a * a
        out.append(float(a))
    return out


# --- normality ----------------------------------------------------------------


def jarque_bera(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    s = df.groupBy(*keys).agg(F.count(value).alias("n"), F.skewness(value).alias("skew"), F.kurtosis(value).alias("kurt"))
    stat = F.col("n") / 6 * (F.col("skew") ** 2 + F.col("kurt") ** 2 / 4)
    return s.withColumn("statistic", stat).withColumn("p_value", F.exp(-F.col("statistic") / 2))


def dagostino_k2(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Omnibus test from the normalised skewness and kurtosis; null below eight rows."""
    s = df.groupBy(*keys).agg(F.count(value).alias("cnt"), F.skewness(value).alias("skew"), F.kurtosis(value).alias("kurt"))
    s = s.withColumn("n", F.when(F.col("cnt") >= 8, F.col("cnt").cast("double")))
    n = F.col("n")
    y = F.col("skew") * F.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    b2 = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = -1 + F.sqrt(2 * (b2 - 1))
    delta = 1 / F.sqrt(0.5 * F.log(w2))
    ratio = y / F.sqrt(2 / (w2 - 1))
    z_skew = delta * F.log(ratio + F.sqrt(ratio * ratio + 1))
    mean = 3 * (n - 1) / (n + 1)
    var = 24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))
    x = (F.col("kurt") + 3 - mean) / F.sqrt(var)
    root = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / root * (2 / root + F.sqrt(1 + 4 / (root * root)))
    denominator = 1 + x * F.sqrt(2 / (a - 4))
    term = F.signum(denominator) * F.pow((1 - 2 / a) / F.nullif(F.abs(denominator), F.lit(0.0)), F.lit(1 / 3))
    z_kurt = (1 - 2 / (9 * a) - term) / F.sqrt(2 / (9 * a))
    out = s.withColumn("z_skew", z_skew).withColumn("z_kurt", z_kurt)
    out = out.withColumn("statistic", F.col("z_skew") ** 2 + F.col("z_kurt") ** 2)
    return out.withColumn("p_value", F.exp(-F.col("statistic") / 2)).drop("n").withColumnRenamed("cnt", "n")


def anderson_darling(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """A-squared against the normal law with estimated mean and deviation.

    Works on distinct values with counts: a value holding ranks a+1 .. a+c
    carries the weight sums of those ranks in closed form.
    """
    stats = df.groupBy(*keys).agg(F.avg(value).alias("__m"), F.stddev_samp(value).alias("__s"))
    ranked = attach(value_cumcounts(df, keys, value), stats, keys, spread=["below"])
    z = (F.col("v") - F.col("__m")) / F.nullif(F.col("__s"), F.lit(0.0))
    # the upper tail is taken from the mirrored argument, not from 1 - cdf
    low, high = F.log(norm_cdf(z)), F.log(norm_cdf(-z))
    a, c, n = F.col("below"), F.col("c"), F.col("n")
    up = (a + c) * (a + c) - a * a
    down = (n - a) * (n - a) - (n - a - c) * (n - a - c)
    sums = ranked.groupBy(*keys, "n").agg(F.sum(up * low + down * high).alias("s"))
    # Critical values at 15, 10, 5, 2.5 and 1 percent.
    critical = [0.576, 0.656, 0.787, 0.918, 1.092]
    factor = 1 + 4 / F.col("n") - 25 / F.col("n") / F.col("n")
    return sums.select(
        *keys, (-F.col("n") - F.col("s") / F.col("n")).alias("statistic"),
        F.array(*[F.round(F.lit(x) / factor, 3) for x in critical]).alias("critical_values"),
    )


def normal_scores(df: DataFrame, keys: Sequence[str], value: str, a: float = 0.375, b: float = 0.25) -> DataFrame:
    """Distinct values with the normal score of each of their ranks.

    Ranks are listed per value in slices of a fixed length, so a value that
    repeats often becomes several bounded rows.
    """
    ranked = value_cumcounts(df, keys, value)
    slice_len = 4096
    starts = F.sequence(F.col("below") + 1, F.col("below") + F.col("c"), F.lit(slice_len).cast("long"))
    sliced = ranked.select(*keys, "v", "n", (F.col("below") + F.col("c")).alias("__end"), F.explode(starts).alias("__start"))
    ranks = sliced.select(
        *keys, "v", "n",
        F.explode(F.sequence(F.col("__start"), F.least(F.col("__start") + (slice_len - 1), F.col("__end")))).alias("rank"),
    )
    return ranks.withColumn("score", norm_ppf((F.col("rank") - a) / (F.col("n") + b)))


def qq_points(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Ordered values against normal quantiles at (i - 0.5) / n."""
    s = normal_scores(df, keys, value, 0.5, 0.0)
    return s.select(*keys, "rank", F.col("score").alias("theoretical"), F.col("v").alias("sample"))


# Royston's polynomials (highest power first) for the two
# outermost weights and for the normalising transform.
_ROYSTON_AN = [-2.706056, 4.434685, -2.071190, -0.147981, 0.221157]
_ROYSTON_AN1 = [-3.582633, 5.682633, -1.752461, -0.293762, 0.042981]
_ROYSTON_MU = [0.0038915, -0.083751, -0.31082, -1.5861]
_ROYSTON_SIGMA = [0.0030302, -0.082676, -0.4803]


def shapiro_wilk(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """W and its p-value by Royston's approximation (n >= 12).

    The p-value is meant for at most 5000 rows; W itself has no such limit.
    """
    s = normal_scores(df, keys, value)
    n, rank = F.col("n"), F.col("rank")
    m = F.col("score")
    edge = [F.sum(F.when(rank == n - k, F.col("v")) ).alias(f"hi{k}") for k in (0, 1)]
    edge += [F.sum(F.when(rank == 1 + k, F.col("v"))).alias(f"lo{k}") for k in (0, 1)]
    score_edge = [F.max(F.when(rank == n - k, m)).alias(f"m{k}") for k in (0, 1)]
    inner = (rank > 2) & (rank < n - 1)
    sums = s.groupBy(*keys, "n").agg(
        F.nullif(F.sum(m * m), F.lit(0.0)).alias("mm"), F.sum(F.when(inner, m * F.col("v"))).alias("mx"),
        F.var_samp("v").alias("var"), *edge, *score_edge,
    )
    u = 1 / F.sqrt(F.col("n").cast("double"))

    def poly(x: Column, coefficients: list[float], last: Column | None) -> Column:
        out = F.lit(coefficients[0])
        for c in coefficients[1:]:
            out = out * x + c
        return out * x + last if last is not None else out

    a_n = poly(u, _ROYSTON_AN, F.col("m0") / F.sqrt(F.col("mm")))
    a_n1 = poly(u, _ROYSTON_AN1, F.col("m1") / F.sqrt(F.col("mm")))
    d = sums.withColumn("an", a_n).withColumn("an1", a_n1)
    phi = (F.col("mm") - 2 * F.col("m0") ** 2 - 2 * F.col("m1") ** 2) / (1 - 2 * F.col("an") ** 2 - 2 * F.col("an1") ** 2)
    top = (
        F.col("an") * (F.col("hi0") - F.col("lo0")) + F.col("an1") * (F.col("hi1") - F.col("lo1"))
        + F.col("mx") / F.sqrt(phi)
    )
    w = top * top / F.nullif(F.col("var") * (F.col("n") - 1), F.lit(0.0))
    ln = F.log(F.col("n").cast("double"))
    mu, sigma = poly(ln, _ROYSTON_MU, None), F.exp(poly(ln, _ROYSTON_SIGMA, None))
    z = (F.log(1 - F.col("statistic")) - mu) / sigma
    return d.withColumn("statistic", w).select(*keys, "n", "statistic", norm_cdf(-z).alias("p_value"))


# --- heteroskedasticity and breaks --------------------------------------------


def breusch_pagan(df: DataFrame, keys: Sequence[str], idx: str, value: str) -> DataFrame:
    """n R2 of squared trend residuals on time; one degree of freedom."""
    d = trend_residuals(df, keys, idx, value)
    r2 = F.regr_r2(F.col("r") * F.col("r"), F.col("t"))
    out = d.groupBy(*keys).agg((F.count("r") * r2).alias("statistic"))
    return out.withColumn("p_value", chi2_p("statistic", F.lit(1.0)))


def goldfeld_quandt(df: DataFrame, keys: Sequence[str], idx: str, value: str) -> DataFrame:
    """Residual variance of the second over the first half; y on t without constant."""
    d = trend(df, keys, idx)
    split = F.floor(F.col("n") / 2)
    half = F.when(F.col("t") < split, 0).otherwise(1)
    sums = d.groupBy(*keys, half.alias("half")).agg(
        F.count(F.lit(1)).alias("k"), F.sum(F.col(value) ** 2).alias("yy"),
        F.sum(F.col("t") * F.col(value)).alias("ty"), F.sum(F.col("t") ** 2).alias("tt"),
    )
    mse = (F.col("yy") - F.col("ty") ** 2 / F.nullif(F.col("tt"), F.lit(0.0))) / F.nullif(F.col("k") - 1, F.lit(0))
    row = sums.groupBy(*keys).agg(
        F.max(F.when(F.col("half") == 1, mse)).alias("b"), F.max(F.when(F.col("half") == 0, mse)).alias("a"),
        F.max(F.when(F.col("half") == 1, F.col("k") - 1)).alias("d1"), F.max(F.when(F.col("half") == 0, F.col("k") - 1)).alias("d2"),
    )
    stat = row.withColumn("statistic", F.col("b") / F.nullif(F.col("a"), F.lit(0.0)))
    return stat.withColumn("p_value", f_p("statistic", F.col("d1").cast("double"), F.col("d2").cast("double"))).select(*keys, "statistic", "p_value")


def arch_lm(df: DataFrame, keys: Sequence[str], idx: str, value: str, lags: int = 10) -> DataFrame:
    """n R2 of squared trend residuals on their own lags."""
    d = trend_residuals(df, keys, idx, value)
    sq = d.withColumn("__q", F.col("r") * F.col("r"))
    c = centred(sq, keys, ["__q"]).withColumn("q", F.col("__d___q")).select(*keys, idx, "q")

    def design(a):
        q = a["q"]
        return np.column_stack([np.ones_like(q), *[lagged(q, k) for k in range(1, lags + 1)], q])

    def result(m, n):
        _, _, ssr = solve(m, range(lags + 1), lags + 1)
        total = m[-1, -1] - m[0, -1] ** 2 / n
        rest = ratio(ssr, total) if n > lags + 1 else None
        stat = None if rest is None else n * (1 - rest)
        return {"statistic": stat, "p_value": None if stat is None else mathx.chi2_sf(stat, lags)}

    return finish(lag_gram(c, keys, idx, ["q"], lags, design), keys, result, RESULT)


def chow(df: DataFrame, keys: Sequence[str], idx: str, target: str, regressors: Sequence[str]) -> DataFrame:
    """Break at the middle row, all regressors and a constant; one grouped aggregate."""
    d = trend(df, keys, idx)
    half = F.when(F.col("t") < F.floor(F.col("n") / 2), 0).otherwise(1)
    d = d.withColumn("half", half).drop("n")
    parts = centred_gram(d, [*keys, "half"], [*[F.col(c) for c in regressors], F.col(target)])
    both = parts.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("half", "n", "mean", "g"))).alias("__s"),
    )  # two matrices per key
    each = both.select(*keys, "n", *[F.transform("__s", lambda x: x[c]).alias(c) for c in ("mean", "g")], F.transform("__s", lambda x: x["n"]).alias("size"))
    each = each.select(*keys, "n", F.flatten("mean").alias("mean"), F.flatten("g").alias("g"), "size")
    fields = ", ".join(f"`{k}` {both.schema[k].dataType.simpleString()}" for k in keys)
    k = len(regressors) + 1

    def run(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                rec = r._asdict()
                out = {"statistic": None, "p_value": None}
                if len(rec["size"]) == 2:  # a single row has no first half
                    g = np.asarray(rec["g"], dtype=float).reshape(2, -1)
                    m1, m2 = unpack(g[0]), unpack(g[1])
                    n1, n2 = (int(x) for x in rec["size"])
                    gap = np.concatenate(([0.0], np.subtract(*np.asarray(rec["mean"], dtype=float).reshape(2, -1))))
                    m = m1 + m2 + np.outer(gap, gap) * n1 * n2 / (n1 + n2)
                    ssr = [solve(x, range(k), k)[2] for x in (m, m1, m2)]
                    out = f_test(ssr[0], ssr[1] + ssr[2], k, n1 + n2 - 2 * k)
                rows.append({**{c: rec[c] for c in keys}, **out})
            yield pd.DataFrame(rows, columns=[*keys, "statistic", "p_value"])

    return each.mapInPandas(run, f"{fields}, {RESULT}")


# --- relations between series -------------------------------------------------


def granger(df: DataFrame, keys: Sequence[str], idx: str, target: str, exog: Sequence[str], lags: int = 24) -> DataFrame:
    """F test that the lags of each covariate add to the target's own lags."""
    out = None
    for var in exog:
        c = centred(df.select(*keys, idx, target, var), keys, [target, var]).select(
            *keys, idx, F.col(f"__d_{target}").alias("y"), F.col(f"__d_{var}").alias("x")
        )

        def design(a):
            y, x = a["y"], a["x"]
            own = [lagged(y, k) for k in range(1, lags + 1)]
            other = [lagged(x, k) for k in range(1, lags + 1)]
            return np.column_stack([np.ones_like(y), *own, *other, y])

        def result(m, n):
            k = m.shape[0] - 1
            free = solve(m, range(k), k)[2]
            bound = solve(m, range(lags + 1), k)[2]
            return f_test(bound, free, lags, n - k)

        one = finish(lag_gram(c, keys, idx, ["y", "x"], lags, design), keys, result, RESULT)
        one = one.select(*keys, F.lit(var).alias("variable"), "statistic", "p_value")
        out = one if out is None else out.unionByName(one)
    return out


# 90, 95 and 99 percent critical values of the trace and the
# maximum-eigenvalue statistic with a constant, for 1 to 5 remaining relations.
_TRACE_CRIT = [
    [2.7055, 3.8415, 6.6349], [13.4294, 15.4943, 19.9349], [27.0669, 29.7961, 35.4628],
    [44.4929, 47.8545, 54.6815], [65.8202, 69.8189, 77.8202],
]
_MAX_CRIT = [
    [2.7055, 3.8415, 6.6349], [12.2971, 14.2639, 18.5200], [18.8928, 21.1314, 25.8650],
    [25.1236, 27.5858, 32.7172], [31.2379, 33.8777, 39.3693],
]


def johansen(df: DataFrame, keys: Sequence[str], idx: str, cols: Sequence[str], k_diff: int = 1) -> DataFrame:
    """Trace and maximum-eigenvalue statistics, constant term, up to five series."""
    m_vars = len(cols)
    if m_vars > len(_TRACE_CRIT):
        raise ValueError(f"at most {len(_TRACE_CRIT)} series")
    c = centred(df.select(*keys, idx, *cols), keys, cols).select(*keys, idx, *[F.col(f"__d_{x}").alias(x) for x in cols])

    def design(a):
        diffs = [a[x] - lagged(a[x], 1) for x in cols]
        past = [lagged(d, j) for j in range(1, k_diff + 1) for d in diffs]
        levels = [lagged(a[x], k_diff) for x in cols]
        return np.column_stack([np.ones(len(diffs[0])), *past, *diffs, *levels])

    def result(m, n):
        z = list(range(1 + m_vars * k_diff))
        d = [len(z) + i for i in range(m_vars)]
        lv = [len(z) + m_vars + i for i in range(m_vars)]
        rest = d + lv
        p = m[np.ix_(rest, rest)] - m[np.ix_(rest, z)] @ np.linalg.pinv(m[np.ix_(z, z)]) @ m[np.ix_(z, rest)]
        s00, skk, sk0 = p[:m_vars, :m_vars] / n, p[m_vars:, m_vars:] / n, p[m_vars:, :m_vars] / n
        eig = np.linalg.eigvals(np.linalg.inv(skk) @ sk0 @ np.linalg.inv(s00) @ sk0.T)
        eig = np.sort(np.real(eig))[::-1]
        logs = -n * np.log(1 - eig)
        return [{
            "rank": i, "eigenvalue": float(eig[i]), "trace": float(logs[i:].sum()), "max_eigen": float(logs[i]),
            "trace_95": _TRACE_CRIT[m_vars - i - 1][1], "max_95": _MAX_CRIT[m_vars - i - 1][1],
        } for i in range(m_vars)]

    grams = lag_gram(c, keys, idx, cols, k_diff + 1, design)
    return finish(grams, keys, result, "rank int, eigenvalue double, trace double, max_eigen double, trace_95 double, max_95 double")


def vif(df: DataFrame, keys: Sequence[str], cols: Sequence[str], add_const: bool = False) -> DataFrame:
    """Variance inflation of every column on the others, without constant by default."""
    names, shift = list(cols), int(add_const)

    def result(m, n, mean=None):
        rows = []
        for i, name in enumerate(names):
            j = i + shift
            others = [q for q in range(m.shape[0]) if q != j]
            ssr = solve(m, others, j)[2]
            rows.append({"feature": name, "vif": float(m[j, j] / ssr) if ssr > 0 else float("inf")})
        return rows

    grams = (centred_gram if add_const else gram)(df, keys, [F.col(c) for c in cols])
    return finish(grams, keys, result, "feature string, vif double")


def ols_summary(df: DataFrame, keys: Sequence[str], target: str, regressors: Sequence[str]) -> DataFrame:
    """Coefficients with standard error, t, p; R2 and n repeated per row.

    Without degrees of freedom the errors are null, with a constant target R2 is.
    """
    names = ["const", *regressors]
    k = len(names)

    def result(m, n, mean):
        b, inv, ssr = solve(m, range(k), k)
        b, inv = from_zero(b, inv, mean)
        s2 = ssr / (n - k) if n > k else None
        rest = ratio(ssr, m[k, k])
        rows = []
        for i, name in enumerate(names):
            se = None if s2 is None else math.sqrt(max(s2 * inv[i, i], 0.0))
            t = ratio(b[i], se) if se else None
            rows.append({"term": name, "coef": float(b[i]), "se": se, "t": t,
                         "p_value": None if t is None else mathx.t_two_sided(t, n - k), "r2": None if rest is None else 1 - rest, "n": n})
        return rows

    cols = [*[F.col(c) for c in regressors], F.col(target)]
    return finish(centred_gram(df, keys, cols), keys, result,
                  "term string, coef double, se double, t double, p_value double, r2 double, n long")


def ols_residuals(df: DataFrame, keys: Sequence[str], target: str, regressors: Sequence[str]) -> DataFrame:
    """Add ``fitted`` and ``resid`` of the regression per key."""
    coefs = ols_summary(df, keys, target, regressors).groupBy(*keys).agg(*[
        F.max(F.when(F.col("term") == n, F.col("coef"))).alias(f"__b_{n}") for n in ("const", *regressors)
    ])
    joined = attach(df, coefs, keys)
    fitted = F.col("__b_const")
    for r in regressors:
        fitted = fitted + F.col(f"__b_{r}") * F.col(r)
    out = joined.withColumn("fitted", fitted)
    return out.withColumn("resid", F.col(target) - F.col("fitted")).drop(*[f"__b_{n}" for n in ("const", *regressors)])


def anova_nested(df: DataFrame, keys: Sequence[str], target: str, small: Sequence[str], large: Sequence[str]) -> DataFrame:
    """F test of a smaller regression nested in a larger one."""
    added = [c for c in large if c not in small]
    order = [*small, *added]

    def result(m, n, mean):
        k = len(order) + 1
        bound = solve(m, range(len(small) + 1), k)[2]
        free = solve(m, range(k), k)[2]
        return {"ssr_small": bound, "ssr_large": free, **f_test(bound, free, len(added), n - k)}

    cols = [*[F.col(c) for c in order], F.col(target)]
    return finish(centred_gram(df, keys, cols), keys, result, f"ssr_small double, ssr_large double, {RESULT}")


def f_regression(df: DataFrame, keys: Sequence[str], target: str, features: Sequence[str]) -> DataFrame:
    row = df.groupBy(*keys).agg(F.count(target).alias("n"), *[F.corr(c, target).alias(c) for c in features])
    long = row.unpivot([*keys, "n"], list(features), "feature", "r")
    r2 = F.col("r") * F.col("r")
    out = long.withColumn("statistic", r2 / F.nullif(1 - r2, F.lit(0.0)) * (F.col("n") - 2))
    return out.withColumn("p_value", f_p("statistic", F.lit(1.0), (F.col("n") - 2).cast("double"))).select(*keys, "feature", "statistic", "p_value")


def mutual_information(
    df: DataFrame, keys: Sequence[str], target: str, features: Sequence[str], bins: int = 10
) -> DataFrame:
    """Binned mutual information in nats.

    Columns are cut at ranks: a value falls into bin floor(bins * below / n),
    so equal values share a bin.
    """
    y = F.col(target).cast("double")
    cells = F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("__x")) for c in features
    ]))
    stable = [c for c, t in df.dtypes if t in INTEGRAL and c not in keys][:2]
    long = df.filter(y.isNotNull()).select(*keys, *stable, y.alias("__y"), cells.alias("c")).select(
        *keys, *stable, "__y", "c.*"
    ).filter(F.col("__x").isNotNull())
    both = [*keys, "feature"]

    def edges(c: str, out: str) -> DataFrame:
        """Smallest value of each bin: at most ``bins`` entries per key and feature."""
        r = value_cumcounts(long, both, c)
        slot = F.floor(F.col("below") * bins / F.col("n")).cast("int")
        low = r.groupBy(*both, slot.alias("b")).agg(F.min("v").alias("v"))
        return low.groupBy(*both).agg(F.array_sort(F.collect_list(F.struct("v", "b"))).alias(out))

    def place(c: str, e: str) -> Column:
        return F.aggregate(e, F.lit(-1), lambda acc, s: F.when(s["v"] <= F.col(c), s["b"]).otherwise(acc))

    cuts = edges("__x", "__ex").join(edges("__y", "__ey"), both)
    binned = attach(long, cuts, both, spread=stable)
    joint = binned.groupBy(*both, place("__x", "__ex").alias("__bx"), place("__y", "__ey").alias("__by")).agg(
        F.count(F.lit(1)).alias("w")
    )
    by = [*keys, "feature"]
    grid = joint.groupBy(*by).agg(  # at most bins^2 cells per key and feature
        F.collect_list(F.struct("__bx", "__by", "w")).alias("cells"), F.sum("w").alias("n")
    )
    rows = grid.select(*by, "n", "cells", F.explode("cells").alias("c"))

    def margin(field: str) -> Column:
        return F.aggregate(
            F.filter("cells", lambda s: s[field] == F.col("c")[field]), F.lit(0).cast("long"), lambda acc, s: acc + s["w"]
        )

    w, n = F.col("c")["w"], F.col("n")
    term = w / n * F.log(w * n / (margin("__bx") * margin("__by")))
    return rows.withColumn("__t", term).groupBy(*by).agg(F.sum("__t").alias("mi"))


# --- forecast comparison ------------------------------------------------------


def diebold_mariano(
    df: DataFrame, by: Sequence[str], y: str, a: str, b: str,
    loss: Callable[[Column, Column], Column] | None = None, alternative: str = "two-sided",
) -> DataFrame:
    """Equal accuracy of forecasts ``a`` and ``b`` over their matched rows."""
    d = diebold_mariano_terms(y, a, b, loss)
    s = df.filter(d.isNotNull()).groupBy(*by).agg(
        F.avg(d).alias("m"), F.var_samp(d).alias("v"), F.count(F.lit(1)).alias("n")
    )
    stat = s.withColumn("statistic", F.col("m") / F.nullif(F.sqrt(F.col("v") / F.col("n")), F.lit(0.0)))
    df_t = (F.col("n") - 1).cast("double")
    p = {
        "two-sided": lambda: t_p("statistic", df_t),
        "greater": lambda: t_upper_p("statistic", df_t),
        "less": lambda: t_upper_p(-F.col("statistic"), df_t),
    }[alternative]()
    return stat.withColumn("p_value", p).select(*by, "n", "statistic", "p_value")


# --- outliers -----------------------------------------------------------------


def lof(df: DataFrame, keys: Sequence[str], idx: str, value: str, k: int = 20) -> DataFrame:
    """Local outlier factor of a single column.

    In one dimension the k nearest neighbours lie within k places in value
    order, so the factor is three windows over chunks of the rank.
    """
    ranked = value_cumcounts(df, keys, value)
    rows = df.withColumn("v", F.col(value).cast("double") + F.lit(0.0)).join(
        ranked.select(*keys, "v", "below"), [*keys, "v"]
    )
    tied = row_numbers(rows, [*keys, "v"], idx, out="__tie")
    base = tied.withColumn("rank", F.col("below") + F.col("__tie") - 1).drop("below", "__tie")
    x = F.col("v")

    def around(col: Column):
        return lambda w: {"__near": F.concat(
            F.collect_list(col).over(w.rowsBetween(-k, -1)), F.collect_list(col).over(w.rowsBetween(1, k))
        )}

    def nearest(df_in: DataFrame, fields: list[str]) -> DataFrame:
        """The k nearest as an array of structs (d, fields...)."""
        near = over_chunks(df_in, keys, "rank", k, around(F.struct(x.alias("x"), F.col("rank").alias("r"), *fields)), lookahead=k)
        pairs = F.transform("__near", lambda s: F.struct(
            F.abs(s["x"] - x).alias("d"), s["r"].alias("r"), *[s[f].alias(f) for f in fields]))
        return near.withColumn("__near", F.slice(F.array_sort(pairs), 1, k))

    def mean(values: Column) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda a, b: a + b) / F.size(values)

    first = nearest(base, []).withColumn("kdist", F.element_at("__near", -1)["d"]).drop("__near")
    second = nearest(first, ["kdist"])
    reach = F.transform("__near", lambda s: F.greatest(s["d"], s["kdist"]))
    second = second.withColumn("lrd", 1 / (mean(reach) + 1e-10)).drop("__near")
    third = nearest(second, ["lrd"])
    factor = mean(F.transform("__near", lambda s: s["lrd"])) / F.col("lrd")
    return third.withColumn("lof", factor).drop("__near", "kdist", "lrd", "rank", "v")


# --- the battery --------------------------------------------------------------


def battery(
    df: DataFrame, keys: Sequence[str], idx: str, value: str, regressors: Sequence[str] = (),
    tests: Sequence[str] | None = None,
) -> DataFrame:
    """The chosen tests as one long table (test, keys, statistic, p_value).

    The panel is written once and read by every test, whatever it took to make it.
    """
    from tsfoundry.operators.neighbours import bds  # which uses the laws of this module

    df = cut_lineage(df.select(*keys, idx, value, *[r for r in regressors if r not in (*keys, idx, value)]))
    known: dict[str, Callable[[], DataFrame]] = {
        "adf_d0": lambda: adf(df, keys, idx, value), "adf_d1": lambda: adf(df, keys, idx, value, 1),
        "kpss_d0": lambda: kpss(df, keys, idx, value), "kpss_d1": lambda: kpss(df, keys, idx, value, 1),
        "jarque_bera": lambda: jarque_bera(df, keys, value), "dagostino_k2": lambda: dagostino_k2(df, keys, value),
        "shapiro_wilk": lambda: shapiro_wilk(df, keys, value), "breusch_pagan": lambda: breusch_pagan(df, keys, idx, value),
        "goldfeld_quandt": lambda: goldfeld_quandt(df, keys, idx, value), "arch_lm": lambda: arch_lm(df, keys, idx, value),
        "ljung_box_10": lambda: ljung_box(df, keys, idx, value, [10]), "ljung_box_20": lambda: ljung_box(df, keys, idx, value, [20]),
        "bds": lambda: bds(df, keys, idx, value),
        **{f"f_regression_{x}": lambda x=x: f_regression(df, keys, value, [x]) for x in regressors},
        "chow": lambda: chow(df, keys, idx, value, regressors),
    }
    chosen = list(tests) if tests is not None else [t for t in known if t != "chow" or regressors]
    unknown = [t for t in chosen if t not in known]
    if unknown:
        raise ValueError(f"unknown tests {unknown}")
    parts = [known[t]().select(F.lit(t).alias("test"), *keys, "statistic", "p_value") for t in chosen]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
