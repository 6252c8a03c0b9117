"""Small column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tsfoundry.functions.time import DAY, HOUR, WEEK, shift_ts


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dms_to_decimal(degrees: Column | str, minutes: Column | str) -> Column:
    return _col(degrees) + _col(minutes) / 60.0


def duration_seconds(text: Column | str) -> Column:
    """'125W', '10D' or '5H' in seconds; an unknown unit, or a number beyond 64 bits, fails the query."""
    t = _col(text)
    number = F.regexp_extract(t, r"^(\d+)[WDH]$", 1)
    unit = F.regexp_extract(t, r"^\d+([WDH])$", 1)
    factor = F.when(unit == "W", WEEK).when(unit == "D", DAY).when(unit == "H", HOUR)
    bad = F.raise_error(F.concat(F.lit("invalid duration: "), t)).cast("bigint")
    return F.when(unit == "", bad).otherwise(F.coalesce(number.try_cast("bigint"), bad) * factor)


def duration_interval(text: Column | str) -> Column:
    return F.make_dt_interval(secs=duration_seconds(text))


def polynomial(c: Column | str, degree: int) -> Column:
    return F.pow(_col(c), F.lit(float(degree)))


def hour24(date: Column | str, clock: Column | str, date_format: str = "dd.MM.yyyy") -> Column:
    """Timestamp of a date and an 'HH:mm' clock that runs from 01:00 to 24:00."""
    h = F.substring(_col(clock), 1, 2).cast("int")
    day = F.to_date(_col(date), date_format).cast("timestamp_ntz")
    return shift_ts(day, h * HOUR)


def version_number(version: Column | str) -> Column:
    """Numeric suffix of a ``v1.0.x`` version."""
    return F.regexp_extract(_col(version), r"^v\d+\.\d+\.(\d+)$", 1).cast("int")
