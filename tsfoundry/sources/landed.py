"""Landed JSON payloads turned into (ts, value) rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tsfoundry.functions.time import DAY, HOUR, epoch, from_epoch
from tsfoundry.operators.ranking import numbered


def parse_epoch_series(df: DataFrame, payload: str, keep: Sequence[str] = ()) -> DataFrame:
    """Explode ``{"series": [[epoch_ms, value], ...]}``; milliseconds are truncated."""
    doc = F.from_json(payload, "series array<array<double>>")
    points = df.select(*keep, F.explode(doc["series"]).alias("p"))
    seconds = F.floor(F.col("p")[0] / 1000).cast("long")
    return points.select(*keep, from_epoch(seconds).alias("ts"), F.col("p")[1].alias("value"))


def within_day_counter(
    df: DataFrame, day: str, order: str, out: str = "n", keys: Sequence[str] = ()
) -> DataFrame:
    """0-based position of each row within its day, in ``order``, whatever the order's values are.

    A day that holds most of the rows is numbered in as many tasks as it needs.
    """
    return numbered(df, [*keys, day], [order], out="__rn").withColumn(
        out, F.col("__rn") - 1
    ).drop("__rn")


def parse_daily_rows(df: DataFrame, date_text: str, value: str, order: str) -> DataFrame:
    """The n-th row of a ``MM/dd/yyyy`` day becomes hour n of that day."""
    day = F.to_date(date_text, "MM/dd/yyyy").cast("timestamp_ntz")
    dated = df.select(day.alias("day"), F.col(value).cast("double").alias("value"), order)
    counted = within_day_counter(dated, "day", order)
    return counted.select(from_epoch(epoch("day") + F.col("n") * HOUR).alias("ts"), "value", order)


def tail_slices(df: DataFrame, slice_ts: str, newest: Column, as_of: Column) -> DataFrame:
    """Landed weekly slices needed to catch up from ``newest`` to ``as_of``.

    That is one slice per started week since the newest row, plus two.
    """
    weeks = F.floor((epoch(as_of) - epoch(newest)) / (7 * DAY)) + 2
    rank = F.floor((epoch(as_of) - epoch(slice_ts)) / (7 * DAY))
    return df.filter((rank >= 0) & (rank < weeks))
