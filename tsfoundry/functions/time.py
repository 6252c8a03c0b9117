"""Time arithmetic on zone-less UTC timestamps.

All panels hold UTC wall-clock time as ``timestamp_ntz``, so nothing here
depends on the session time zone. A regular grid is addressed by an integer
step index ``idx = floor(epoch_seconds / step)``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HOUR = 3600
DAY = 86400
WEEK = 7 * DAY

MON, TUE, WED, THU, FRI, SAT, SUN = range(7)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def epoch(ts: Column | str) -> Column:
    """Whole seconds since 1970-01-01 UTC."""
    return F.unix_timestamp(_col(ts))


def from_epoch(seconds: Column | str) -> Column:
    return F.timestamp_add("SECOND", _col(seconds), F.lit("1970-01-01").cast("timestamp_ntz"))


def ts_lit(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def floor_div(value: Column, step: int) -> Column:
    return F.floor(value / F.lit(step)).cast("long")


def step_index(ts: Column | str, step: int) -> Column:
    return floor_div(epoch(ts), step)


def index_ts(idx: Column | str, step: int) -> Column:
    return from_epoch(_col(idx) * F.lit(step).cast("long"))


def floor_ts(ts: Column | str, step: int) -> Column:
    return index_ts(step_index(ts, step), step)


def shift_ts(ts: Column | str, seconds: Column | int) -> Column:
    quantity = seconds if isinstance(seconds, Column) else F.lit(seconds)
    return F.timestamp_add("SECOND", quantity.cast("long"), _col(ts))


def hour(ts: Column | str) -> Column:
    return F.hour(_col(ts))


def weekday(ts: Column | str) -> Column:
    """Monday = 0 ... Sunday = 6."""
    return F.weekday(_col(ts))


def forecast_window(ts: Column | str, last_saturday_hour: int = 23) -> Column:
    """Wednesday 23:00 up to Saturday ``last_saturday_hour`` inclusive."""
    wd, h = weekday(ts), hour(ts)
    return (
        ((wd == WED) & (h >= 23))
        | wd.isin(THU, FRI)
        | ((wd == SAT) & (h <= last_saturday_hour))
    )


def target_times(
    ts: Column | str, days: tuple[int, ...] = (FRI, SAT), hours: tuple[int, ...] = (11, 15, 19)
) -> Column:
    return weekday(ts).isin(*days) & hour(ts).isin(*hours)


def day_flag(ts: Column | str, first: int = 6, end: int = 18) -> Column:
    """1 by day (``first <= hour < end``), else 0."""
    h = hour(ts)
    return F.when((h >= first) & (h < end), 1).otherwise(0)


def week_anchor(ts: Column | str, day: int, hour_of_day: int) -> Column:
    """The given weekday and hour of the Monday-based week holding ``ts``."""
    e = epoch(ts)
    midnight = e - F.pmod(e, F.lit(DAY))
    monday = midnight - weekday(ts).cast("long") * DAY
    return from_epoch(monday + F.lit(day * DAY + hour_of_day * HOUR).cast("long"))
