"""Seasonal naive quantile forecast."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tsfoundry.operators.chunking import over_chunks, row_numbers
from tsfoundry.operators.models.base import register

DEFAULT_QUANTILES = (0.025, 0.25, 0.5, 0.75, 0.975)


def quantile_column(q: float) -> str:
    return "pred_" + str(q).replace(".", "_")


def seasonal_quantiles(
    df: DataFrame, keys: Sequence[str], season: Sequence[str], idx: str, value: str,
    last_t: int, probs: Sequence[float] = DEFAULT_QUANTILES,
) -> DataFrame:
    """Quantiles of the previous ``last_t`` observations of the same season.

    Null until ``last_t`` observations precede a row. Rows get their number
    within series and season, and windows run over chunks of it that see
    ``last_t`` rows back, so a season that holds most rows is no single group.
    """
    place = "__occurrence"
    rows = row_numbers(df, [*keys, *season], idx, out=place)

    def build(w: Window) -> dict[str, Column]:
        past = w.rowsBetween(-last_t, -1)
        row = F.percentile(value, F.array(*[F.lit(float(p)) for p in probs])).over(past)
        return {"__q": F.when(F.count(value).over(past) == last_t, row)}

    held = over_chunks(rows, [*keys, *season], place, last_t, build)
    return held.select(
        *df.columns, *[F.col("__q")[i].alias(quantile_column(p)) for i, p in enumerate(probs)]
    )


@register("baseline")
class SeasonalQuantile:
    """Observed values outside the forecast window, seasonal quantiles inside it."""

    def __init__(
        self, keys: Sequence[str], season: Sequence[str], last_t: int = 25,
        quantiles: Sequence[float] = DEFAULT_QUANTILES, window: Column | None = None,
    ) -> None:
        self.keys, self.season, self.last_t = list(keys), list(season), last_t
        self.quantiles, self.window = tuple(quantiles), window

    def fit(self, df: DataFrame) -> "SeasonalQuantile":
        return self

    def transform(self, df: DataFrame, idx: str = "idx", value: str = "y") -> DataFrame:
        scored = seasonal_quantiles(df, self.keys, self.season, idx, value, self.last_t, self.quantiles)
        if self.window is None:
            return scored
        inside = self.window
        return scored.withColumns({
            quantile_column(q): F.when(inside, F.col(quantile_column(q))).otherwise(F.col(value))
            for q in self.quantiles
        })
