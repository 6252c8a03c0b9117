"""Forecast evaluation. Long frames hold one row per (keys, ts, q)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tsfoundry.operators.chunking import over_chunks, row_numbers, running_sum
from tsfoundry.operators.lookup import attach
from tsfoundry.operators.quantiles import value_cumcounts

#: Smallest denominator of a percentage error (float64 machine epsilon).
EPS = 2.220446049250313e-16


def residual(y: str = "y", yhat: str = "yhat") -> Column:
    """Forecast minus actual."""
    return F.col(yhat) - F.col(y)


def to_long(
    df: DataFrame, keep: Sequence[str], quantiles: dict[float, str], q: str = "q", yhat: str = "yhat"
) -> DataFrame:
    """One row per quantile from one column per quantile."""
    pairs = F.array(*[
        F.struct(F.lit(float(p)).alias(q), F.col(c).alias(yhat)) for p, c in quantiles.items()
    ])
    return df.select(*keep, F.explode(pairs).alias("__p")).select(*keep, "__p.*")


def to_wide(df: DataFrame, keep: Sequence[str], quantiles: dict[float, str]) -> DataFrame:
    wide = [F.max(F.when(F.col("q") == p, F.col("yhat"))).alias(c) for p, c in quantiles.items()]
    return df.groupBy(*keep).agg(*wide)


def point_errors(df: DataFrame, by: Sequence[str], y: str, yhat: str) -> DataFrame:
    """MAE, RMSE and MAPE over rows where both values are known."""
    e = F.col(yhat) - F.col(y)
    return df.filter(e.isNotNull()).groupBy(*by).agg(
        F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(F.abs(e) / F.greatest(F.abs(F.col(y)), F.lit(EPS))).alias("mape"),
    )


def pinball_term(q: Column, y: str = "y", yhat: str = "yhat") -> Column:
    e = F.col(y) - F.col(yhat)
    return F.greatest(q * e, (q - 1) * e)


def pinball(df: DataFrame, by: Sequence[str], y: str = "y", yhat: str = "yhat") -> DataFrame:
    term = pinball_term(F.col("q"), y, yhat)
    return df.groupBy(*by, "q").agg(F.avg(term).alias("pinball"))


def d2_pinball(
    df: DataFrame, by: Sequence[str], y: str = "y", yhat: str = "yhat", base: str = "yhat_base"
) -> DataFrame:
    """1 - loss / baseline loss over matched rows; null where the baseline is exact."""
    known = df.filter(F.col(yhat).isNotNull() & F.col(base).isNotNull())
    losses = known.groupBy(*by, "q").agg(
        F.avg(pinball_term(F.col("q"), y, yhat)).alias("pinball"),
        F.avg(pinball_term(F.col("q"), y, base)).alias("pinball_base"),
    )
    return losses.withColumn("d2", 1 - F.col("pinball") / F.nullif("pinball_base", F.lit(0.0)))


def coverage(df: DataFrame, by: Sequence[str], y: str, lo: str, hi: str) -> DataFrame:
    known = df.filter(F.col(lo).isNotNull() & F.col(hi).isNotNull() & F.col(y).isNotNull())
    return known.groupBy(*by).agg(
        F.avg(F.col(y).between(F.col(lo), F.col(hi)).cast("double")).alias("coverage"),
        F.count(F.lit(1)).alias("n"),
    )


def sharpness(df: DataFrame, by: Sequence[str], lo: str, hi: str) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(F.col(hi) - F.col(lo)).alias("sharpness"))


def pit_value(y: str, quantiles: dict[float, str]) -> Column:
    """Probability integral transform of ``y`` on a piecewise linear quantile curve.

    0 and 1 in the tails; within, the first neighbouring pair enclosing ``y``
    counts, with crossing quantiles taken as they are; a flat pair gives its
    middle level. Null where an outer quantile is missing.
    """
    if len(quantiles) < 2:
        raise ValueError("at least two quantiles are needed")
    levels = sorted(quantiles)
    obs = F.col(y)
    first, last = F.col(quantiles[levels[0]]), F.col(quantiles[levels[-1]])
    segments = []
    for low, high in zip(levels, levels[1:]):
        a, b = F.col(quantiles[low]), F.col(quantiles[high])
        inside = (obs >= F.least(a, b)) & (obs <= F.greatest(a, b)) & a.isNotNull() & b.isNotNull()
        flat = F.abs(b - a) < 1e-9
        slope = F.lit(low) + (obs - a) / F.nullif(b - a, F.lit(0.0)) * F.lit(high - low)
        segments.append(F.when(inside, F.when(flat, 0.5 * (low + high)).otherwise(slope)))
    body = F.when(obs <= first, 0.0).when(obs >= last, 1.0).otherwise(F.coalesce(*segments))
    return F.when(first.isNotNull() & last.isNotNull(), body)


def pit_histogram(df: DataFrame, by: Sequence[str], pit: str, bins: int = 5, min_rows: int = 10) -> DataFrame:
    """Share of rows per equal bin, the last one closed; groups below ``min_rows`` are left out."""
    known = df.filter(F.col(pit).isNotNull())
    slot = F.least(F.floor(F.col(pit) * bins), F.lit(bins - 1)).cast("int")
    counts = known.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(slot == b).alias(f"b{b}") for b in range(bins)],
    ).filter(F.col("total") >= min_rows)
    rows = F.explode(F.array(*[
        F.struct(F.lit(b).alias("bin"), F.col(f"b{b}").alias("n")) for b in range(bins)
    ]))
    flat = counts.select(*by, "total", rows.alias("r")).select(*by, "total", "r.*")
    return flat.select(*by, "bin", "n", (F.col("n") / F.col("total")).alias("frequency"))


def pit_ecdf(df: DataFrame, by: Sequence[str], pit: str) -> DataFrame:
    """Empirical distribution: one row per distinct value with the share at or below it."""
    ranked = value_cumcounts(df, by, pit)
    return ranked.select(*by, F.col("v").alias(pit), ((F.col("below") + F.col("c")) / F.col("n")).alias("ecdf"))


def array_quantile(values: Column, p: float, size: int) -> Column:
    """Linear quantile of a short array of exactly ``size`` non-null values."""
    ordered = F.array_sort(values)
    pos = (size - 1) * p
    low = int(pos)
    high = min(low + 1, size - 1)
    return ordered[low] + (ordered[high] - ordered[low]) * F.lit(pos - low)


def hour_weekday_pivot(
    df: DataFrame, ts: str, value: str, days: dict[int, str], probs: Sequence[float]
) -> DataFrame:
    """Mean per hour and weekday, then mean and quantiles across the weekdays.

    An hour counts only when all the weekdays have it.
    """
    wd = F.weekday(ts)
    means = df.groupBy(F.hour(ts).alias("hour")).agg(
        *[F.avg(F.when(wd == d, F.col(value))).alias(name) for d, name in days.items()]
    )
    names = list(days.values())
    full = means.na.drop(subset=names)
    row = F.array(*names)
    total = sum((F.col(n) for n in names[1:]), F.col(names[0]))
    return full.select(
        "hour", *names, (total / len(names)).alias("mean"),
        *[array_quantile(row, p, len(names)).alias(f"q{p}") for p in probs],
    )


def evaluation_table(
    df: DataFrame, by: Sequence[str], periods: dict[str, Column], y: str = "y", yhat: str = "yhat",
    base: str = "yhat_base",
) -> DataFrame:
    """Long (period, by, q, metric, value) over matched long forecasts.

    A row belongs to every period whose condition holds, so one pass serves
    all periods. Point errors are those of the median.
    """
    named = F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in periods.items()]))
    rows = df.select("*", F.explode(named).alias("period"))
    keys = ["period", *by]
    quantile = d2_pinball(rows, keys, y, yhat, base).select(*keys, "q", "pinball", "d2")
    point = point_errors(rows.filter(F.col("q") == 0.5), keys, y, yhat).withColumn("q", F.lit(0.5))
    long = quantile.unpivot([*keys, "q"], ["pinball", "d2"], "metric", "value")
    return long.unionByName(point.unpivot([*keys, "q"], ["mae", "rmse", "mape"], "metric", "value"))


def period_report(
    df: DataFrame, by: Sequence[str], idx: str, periods: dict[str, Column], quantiles: dict[float, str],
    base: dict[float, str], y: str = "y", lags: int = 10, bins: int = 10,
) -> DataFrame:
    """Long (period, by, metric, q, value): all figures of a forecast report from one aggregate.

    ``df`` holds one row per step with the forecast quantiles and those of a
    baseline; a row belongs to every period whose condition holds. For each
    period: pinball loss and its share explained against the baseline per
    quantile; share of observations below each quantile (calibration); absolute,
    squared and percentage error of the median; coverage and width of the outer
    interval; the counts of the transform's histogram; the regression of the
    observations on the median; the test of equal accuracy against the
    baseline; mean, deviation, skewness, excess and normality statistic of the
    residuals, their portmanteau statistic over ``lags`` rows of the period, and
    the greatest deviation of their running sum. Residual sums over lags come
    from chunked windows, so one long series is spread over many tasks.
    """
    probs = sorted(quantiles)
    lo, mid, hi = quantiles[probs[0]], quantiles[0.5], quantiles[probs[-1]]
    known = df.filter(F.col(y).isNotNull() & F.col(mid).isNotNull() & F.col(base[0.5]).isNotNull())
    named = F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in periods.items()]))
    rows = known.select("*", F.explode(named).alias("period")).withColumn("__e", F.col(mid) - F.col(y))
    keys = ["period", *by]
    rows = row_numbers(rows, keys, idx, out="__rn")
    rows = over_chunks(rows, keys, "__rn", lags, lambda w: {f"__e{k}": F.lag("__e", k).over(w) for k in range(1, lags + 1)})
    rows = running_sum(rows, keys, "__rn", {"__sum": F.col("__e")})

    def loss(q: float, c: str) -> Column:
        return F.avg(pinball_term(F.lit(q), y, c))

    e, d = F.col("__e"), F.abs(F.col(y) - F.col(mid)) - F.abs(F.col(y) - F.col(base[0.5]))
    slot = F.least(F.floor(F.round(pit_value(y, {q: quantiles[q] for q in probs}) * bins, 6)), F.lit(bins - 1))
    n = F.count(F.lit(1)).cast("double")
    figures: dict[tuple[str, float], Column] = {("n", 0.5): n}
    for q in probs:
        figures["pinball", q] = loss(q, quantiles[q])
        figures["d2", q] = 1 - loss(q, quantiles[q]) / F.nullif(loss(q, base[q]), F.lit(0.0))
        figures["below", q] = F.avg((F.col(y) <= F.col(quantiles[q])).cast("double"))
    figures |= {
        ("mae", 0.5): F.avg(F.abs(e)), ("rmse", 0.5): F.sqrt(F.avg(e * e)),
        ("mape", 0.5): F.avg(F.abs(e) / F.greatest(F.abs(F.col(y)), F.lit(EPS))),
        ("coverage", 0.5): F.avg(F.col(y).between(F.col(lo), F.col(hi)).cast("double")),
        ("sharpness", 0.5): F.avg(F.col(hi) - F.col(lo)),
        ("regression_intercept", 0.5): F.regr_intercept(y, mid), ("regression_slope", 0.5): F.regr_slope(y, mid),
        ("regression_r2", 0.5): F.regr_r2(y, mid),
        ("equal_accuracy", 0.5): F.avg(d) / F.nullif(F.sqrt(F.var_samp(d) / n), F.lit(0.0)),
        ("residual_mean", 0.5): F.avg(e), ("residual_std", 0.5): F.stddev_samp(e),
        ("residual_skewness", 0.5): F.skewness(e), ("residual_kurtosis", 0.5): F.kurtosis(e),
        ("jarque_bera", 0.5): n / 6 * (F.skewness(e) ** 2 + F.kurtosis(e) ** 2 / 4),
    }
    for b in range(bins):
        figures["pit_count", b / bins] = F.count_if(slot == b).cast("double")
    terms = []
    for k in range(1, lags + 1):
        past = F.col(f"__e{k}")
        both = F.when(past.isNotNull(), e)
        # products of deviations from the mean over all rows, from sums over the pairs
        pair = F.sum(both * past) - F.avg(e) * (F.sum(both) + F.sum(past)) + F.avg(e) ** 2 * F.count(past)
        r = pair / F.nullif(F.var_pop(e) * n, F.lit(0.0))
        terms.append(F.coalesce(r * r / F.nullif(n - k, F.lit(0.0)), F.lit(0.0)))
    figures["ljung_box", 0.5] = n * (n + 2) * sum(terms[1:], terms[0])
    # the running sum of deviations is the running sum less its share of the total
    names = [f"__f{i}" for i in range(len(figures))]
    wide = rows.groupBy(*keys).agg(*[c.alias(f) for f, c in zip(names, figures.values())])
    mean = names[list(figures).index(("residual_mean", 0.5))]
    peaks = attach(rows.select(*keys, "__rn", "__sum"), wide.select(*keys, F.col(mean).alias("__m")), keys, spread=["__rn"])
    peaks = peaks.groupBy(*keys).agg(F.max(F.abs(F.col("__sum") - F.col("__rn") * F.col("__m"))).alias("__peak"))
    wide = wide.join(peaks, keys)
    cells = [F.struct(F.lit(m).alias("metric"), F.lit(float(q)).alias("q"), F.col(f).alias("value")) for f, (m, q) in zip(names, figures)]
    cells.append(F.struct(F.lit("cusum_peak").alias("metric"), F.lit(0.5).alias("q"), F.col("__peak").alias("value")))
    return wide.select(*keys, F.explode(F.array(*cells)).alias("c")).select(*keys, "c.*")


def diebold_mariano_terms(
    y: str, a: str, b: str, loss: Callable[[Column, Column], Column] | None = None
) -> Column:
    """Loss difference of forecasts ``a`` and ``b``; absolute error by default."""
    loss = loss or (lambda obs, fc: F.abs(obs - fc))
    return loss(F.col(y), F.col(a)) - loss(F.col(y), F.col(b))


def mincer_zarnowitz(df: DataFrame, by: Sequence[str], y: str, yhat: str) -> DataFrame:
    """Regression y = a + b * yhat per group."""
    known = df.filter(F.col(y).isNotNull() & F.col(yhat).isNotNull())
    return known.groupBy(*by).agg(
        F.regr_intercept(y, yhat).alias("intercept"), F.regr_slope(y, yhat).alias("slope"),
        F.regr_r2(y, yhat).alias("r2"), F.count(F.lit(1)).alias("n"),
    )
