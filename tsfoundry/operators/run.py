"""Runs of a whole forecast: scale, fit, forecast recursively, and the quantiles around the forecast."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tsfoundry.operators.forecast import other_quantiles, recursive_forecast, rolling_cv
from tsfoundry.operators.scale import scale_by_group


def run_split(
    df: DataFrame, keys: Sequence[str], idx: str, ts: str, target: str, features: Sequence[str], lags: Sequence[int],
    model, cut: Column, groups: dict[str, dict] | None = None, window: Column | None = None,
) -> tuple[object, DataFrame]:
    """One train and test split: the fitted model and the long forecasts (keys, ts, target, q, yhat) of the rows after ``cut``.

    Column groups are scaled by what the training rows hold. Lags that lie
    inside the forecast are forecasts themselves; ``window`` limits the rows
    returned, not those forecast on the way.
    """
    marked = df.withColumn("part", F.when(F.col(ts) <= cut, "train").otherwise("test"))
    scaled = scale_by_group(marked, "part", groups)[0] if groups else marked
    fitted = model.fit(scaled.filter(F.col("part") == "train"))
    filled = recursive_forecast(scaled.filter(F.col("part") == "test"), keys, idx, ts, target, lags, fitted.expression(0.5))
    long = other_quantiles(filled, [*keys, ts, target], {q: fitted.expression(q) for q in fitted.quantiles}, features)
    return fitted, long if window is None else long.filter(window)


def run_rolling_cv(
    df: DataFrame, folds: DataFrame, keys: Sequence[str], idx: str, ts: str, target: str, lags: Sequence[int],
    make_model: Callable[[], object], window: Column | None = None, out: str = "yhat",
) -> DataFrame:
    """Rows of every fold's test window with its recursive median forecast; one fit per fold."""

    def score(model, test: DataFrame) -> DataFrame:
        filled = recursive_forecast(test, keys, idx, ts, target, lags, model.expression(0.5))
        return filled.withColumnRenamed("pred", out)

    scored = rolling_cv(df, folds, ts, make_model, score=score)
    return scored if window is None else scored.filter(window)
