"""Feature columns: calendar, lags, differences, rolling statistics, interactions."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tsfoundry.functions import time as tm
from tsfoundry.operators.chunking import over_chunks

CALENDAR: dict[str, Callable[[str], Column]] = {
    "hour": lambda ts: F.hour(ts),
    "weekday": lambda ts: tm.weekday(ts),
    "month": lambda ts: F.month(ts),
    "is_weekend": lambda ts: F.when(tm.weekday(ts) >= tm.SAT, 1).otherwise(0),
}


def add_calendar(df: DataFrame, ts: str, names: Sequence[str], fourier: bool = False) -> DataFrame:
    """Calendar parts; with ``fourier`` also the cycles of the hour and weekday chosen."""
    out = df.select("*", *[CALENDAR[n](ts).alias(n) for n in names])
    return add_fourier(out, ts, [n for n in ("hour", "weekday") if n in names]) if fourier else out


def add_fourier(df: DataFrame, ts: str, parts: Sequence[str] = ("hour", "weekday")) -> DataFrame:
    period = {"hour": 24, "weekday": 7}
    cols = []
    for part in parts:
        angle = CALENDAR[part](ts) * (2 * math.pi / period[part])
        cols += [F.sin(angle).alias(f"{part}_sin"), F.cos(angle).alias(f"{part}_cos")]
    return df.select("*", *cols)


def add_season(df: DataFrame, ts: str) -> DataFrame:
    """Summer runs from April to September, winter is the rest."""
    summer = F.month(ts).between(4, 9)
    return df.withColumns({
        "summer_dummy": F.when(summer, 1).otherwise(0),
        "winter_dummy": F.when(summer, 0).otherwise(1),
    })


def add_lags(df: DataFrame, keys: Sequence[str], idx: str, col: str, lags: Sequence[int]) -> DataFrame:
    """``lag_k``: the value k steps earlier on a gap-free grid."""
    return over_chunks(
        df, keys, idx, max(lags), lambda w: {f"lag_{k}": F.lag(col, k).over(w) for k in lags}
    )


def add_diffs(
    df: DataFrame, keys: Sequence[str], idx: str, cols: Sequence[str], lags: Sequence[int], unit: str = "h"
) -> DataFrame:
    return over_chunks(
        df, keys, idx, max(lags),
        lambda w: {f"{c}_diff_{k}{unit}": F.col(c) - F.lag(c, k).over(w) for c in cols for k in lags},
    )


def _frame_stat(name: str, c: str) -> Column:
    if name.startswith("q"):
        return F.percentile(c, F.lit(float(name[1:])))
    return {
        "mean": F.avg, "std": F.stddev_samp, "var": F.var_samp, "min": F.min, "max": F.max,
        "sum": F.sum, "count": F.count, "median": lambda x: F.percentile(x, F.lit(0.5)),
    }[name](c)


def add_rolling(
    df: DataFrame, keys: Sequence[str], idx: str, cols: Sequence[str], windows: Sequence[int],
    stats: Sequence[str] = ("mean", "std", "min", "max"), min_periods: int = 1, unit: str = "h",
) -> DataFrame:
    """``{col}_{stat}_{n}h`` over the last n rows including the current one.

    ``stats`` may name mean, std, var, min, max, sum, count, median and ``q0.9``
    style quantiles (the dot becomes ``_``). Fewer than ``min_periods`` non-null rows give null.
    """

    def build(w: Window) -> dict[str, Column]:
        out = {}
        for n in windows:
            frame = w.rowsBetween(-(n - 1), 0)
            for c in cols:
                for s in stats:
                    value = _frame_stat(s, c).over(frame)
                    if min_periods > 1:
                        value = F.when(F.count(c).over(frame) >= min_periods, value)
                    out[f"{c}_{s}_{n}{unit}".replace(".", "_")] = value
        return out

    return over_chunks(df, keys, idx, max(windows) - 1, build)


def add_moments(
    df: DataFrame, keys: Sequence[str], idx: str, cols: Sequence[str], windows: Sequence[int], unit: str = "h"
) -> DataFrame:
    """Biased skewness and excess kurtosis over full windows only."""

    def build(w: Window) -> dict[str, Column]:
        out = {}
        for n in windows:
            frame = w.rowsBetween(-(n - 1), 0)
            for c in cols:
                full = F.count(c).over(frame) == n
                out[f"{c}_skew_{n}{unit}"] = F.when(full, F.skewness(c).over(frame))
                out[f"{c}_kurtosis_{n}{unit}"] = F.when(full, F.kurtosis(c).over(frame))
        return out

    return over_chunks(df, keys, idx, max(windows) - 1, build)


def add_interactions(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """``a_x_b`` for each pair whose columns both exist."""
    there = set(df.columns)
    return df.select(
        "*", *[(F.col(a) * F.col(b)).alias(f"{a}_x_{b}") for a, b in pairs if {a, b} <= there]
    )


def sequence_windows(
    df: DataFrame, keys: Sequence[str], idx: str, cols: Sequence[str], target: str,
    seq_len: int, horizon: int,
) -> DataFrame:
    """Sliding windows: ``seq_len`` input rows and the next ``horizon`` targets.

    One row per complete window, stamped with its last input row, holding
    ``x`` (array of arrays) and ``targets`` (array).
    """
    row = F.array(*[F.col(c).cast("double") for c in cols])

    def build(w: Window) -> dict[str, Column]:
        past = w.rowsBetween(-(seq_len - 1), 0)
        ahead = w.rowsBetween(1, horizon)
        return {
            "x": F.collect_list(row).over(past),
            "targets": F.collect_list(target).over(ahead),
        }

    out = over_chunks(df, keys, idx, seq_len - 1, build, lookahead=horizon)
    return out.filter((F.size("x") == seq_len) & (F.size("targets") == horizon))


def scatter_lagged(
    df: DataFrame, keys: Sequence[str], idx: str, x: str, y: str, lag: int, colour: Column | None = None
) -> DataFrame:
    """Pairs (x ``lag`` steps earlier, y), without incomplete pairs."""
    out = over_chunks(df, keys, idx, lag, lambda w: {"x_lagged": F.lag(x, lag).over(w)})
    pairs = out.filter(F.col("x_lagged").isNotNull() & F.col(y).isNotNull())
    extra = [colour.alias("colour")] if colour is not None else []
    return pairs.select(*keys, idx, "x_lagged", F.col(y).alias("y_now"), *extra)


#: Feature builders by name; a plug-in adds an entry ``name -> f(df, **options)``.
FEATURES: dict[str, Callable[..., DataFrame]] = {
    "calendar": add_calendar, "fourier": add_fourier, "season": add_season, "lags": add_lags,
    "diffs": add_diffs, "rolling": add_rolling, "moments": add_moments,
    "interactions": add_interactions,
}


def build_features(df: DataFrame, steps: Sequence[tuple[str, dict]]) -> DataFrame:
    """Apply registered feature builders in order."""
    for name, options in steps:
        if name not in FEATURES:
            raise ValueError(f"unknown feature {name!r}")
        df = FEATURES[name](df, **options)
    return df
