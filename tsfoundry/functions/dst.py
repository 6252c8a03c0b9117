"""Local wall-clock time to UTC."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tsfoundry.functions.time import HOUR, shift_ts
from tsfoundry.operators.align import mark_all_but_last
from tsfoundry.operators.lookup import attach


def localize(
    df: DataFrame, keys: Sequence[str], local: str, order: str, zone: str = "Europe/Berlin", out: str = "ts"
) -> DataFrame:
    """Add the UTC time of a local time.

    A time skipped in spring becomes null. Of a time that occurs twice in
    autumn the first row by ``order`` is summer time and later ones are
    standard time; a single row is taken as summer time. The session time
    zone must be UTC, as ``configure`` sets it.
    """
    def to_utc(c: Column) -> Column:
        return F.to_utc_timestamp(c, zone).cast("timestamp_ntz")

    def to_local(c: Column) -> Column:
        return F.from_utc_timestamp(c, zone).cast("timestamp_ntz")

    # each conversion is evaluated once and kept as a column
    df = df.withColumn("__early", to_utc(F.col(local)))
    df = df.withColumn("__exists", to_local(F.col("__early")) == F.col(local))
    df = df.withColumn("__twice", to_local(shift_ts("__early", HOUR)) == F.col(local))
    early, exists, late = F.col("__early"), F.col("__exists"), shift_ts("__early", HOUR)
    twice = exists & F.col("__twice")
    first = df.filter(twice).groupBy(*keys, local).agg(F.min(order).alias("__first"))
    joined = attach(df, first, [*keys, local], "left", [order])
    again = F.col("__first").isNotNull() & (F.col(order) > F.col("__first"))
    return joined.withColumn(out, F.when(exists, F.when(again, late).otherwise(early))).drop(
        "__first", "__early", "__exists", "__twice"
    )


def last_sunday_of_march(ts: Column | str) -> Column:
    c = F.col(ts) if isinstance(ts, str) else ts
    march = F.make_date(F.year(c), F.lit(3), F.lit(24))
    return F.next_day(march, "SUN")


def shift_transitions(df: DataFrame, keys: Sequence[str], local: str, order: str) -> DataFrame:
    """Repair the clock of exports that name the repeated hour 03:00 twice.

    In October every 03:00 row with a later duplicate moves back an hour; on
    the last Sunday of March 02:00 rows move forward an hour.
    """
    marked = mark_all_but_last(df, [*keys, local], [F.col(order)], "__dup")
    t = F.col(local)
    fall = F.col("__dup") & (F.month(t) == 10) & (F.hour(t) == 3)
    spring = (F.to_date(t) == last_sunday_of_march(t)) & (F.hour(t) == 2)
    moved = F.when(fall, shift_ts(t, -HOUR)).when(spring, shift_ts(t, HOUR)).otherwise(t)
    return marked.withColumn(local, moved).drop("__dup")
