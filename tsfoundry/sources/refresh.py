"""Refresh of covariates from landed files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tsfoundry.operators.align import append_dedupe, station_mean


def load_panel(spark, path: str, schema: T.StructType, ts: str, series_id: str | Column) -> DataFrame:
    """A CSV of one or more value columns as (series_id, ts, values...)."""
    raw = spark.read.schema(schema).csv(path, header=True)
    sid = F.lit(series_id) if isinstance(series_id, str) else series_id
    return raw.select(sid.alias("series_id"), F.col(ts).alias("ts"), *[c for c in raw.columns if c != ts])


def refresh(
    history: DataFrame, landed: Sequence[DataFrame], on: Sequence[str], ts: str, as_of: Column
) -> tuple[DataFrame, DataFrame]:
    """New (history, forecast) after one landing.

    Stations are averaged per time; rows before ``as_of`` extend the history,
    where rows already stored win, and later rows are the new forecast.
    """
    mean = station_mean(landed, on)
    past, future = mean.filter(F.col(ts) < as_of), mean.filter(F.col(ts) >= as_of)
    return append_dedupe(history, past, on), future
