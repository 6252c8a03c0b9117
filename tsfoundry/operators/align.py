"""Joins and unions that align series with each other."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F



def left_join_exog(target: DataFrame, exog: DataFrame, on: Sequence[str]) -> DataFrame:
    return target.join(exog, list(on), "left")


def outer_align(frames: Sequence[DataFrame], on: Sequence[str]) -> DataFrame:
    return reduce(lambda a, b: a.join(b, list(on), "full"), frames)


def combine_first(first: DataFrame, second: DataFrame, on: Sequence[str]) -> DataFrame:
    """Values of ``first``; nulls, missing rows and columns come from ``second``.

    Both sides have at most one row per ``on``. One grouping of their union
    replaces the full outer join.
    """
    values = list(dict.fromkeys(c for c in [*first.columns, *second.columns] if c not in on))
    both = first.withColumn("__rank", F.lit(0)).unionByName(
        second.withColumn("__rank", F.lit(1)), allowMissingColumns=True
    )
    pick = [
        F.min_by(c, F.when(F.col(c).isNotNull(), F.col("__rank"))).alias(c) for c in values
    ]
    return both.groupBy(*on).agg(*pick)


def append_dedupe(
    old: DataFrame, new: DataFrame, on: Sequence[str], prefer: str = "old",
    tiebreak: Sequence[Column] = (),
) -> DataFrame:
    """Union of both; on conflict the whole row of the preferred side is kept.

    Within one side the row first by ``tiebreak``, then by its other columns, is kept.
    """
    ranks = {"old": (0, 1), "new": (1, 0)}[prefer]
    both = old.withColumn("__rank", F.lit(ranks[0])).unionByName(
        new.withColumn("__rank", F.lit(ranks[1])), allowMissingColumns=True
    )
    rest = [F.col(c) for c, t in both.dtypes if c not in on and c != "__rank" and not t.startswith("map")]
    return keep_first(both, on, [F.col("__rank"), *tiebreak, *rest]).drop("__rank")


def keep_first(df: DataFrame, on: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per ``on``: the first by ``order``.

    Written as ``min_by``, which combines before the shuffle, so a key repeated
    very often never travels whole to one task.
    """
    rest = [c for c in df.columns if c not in on]
    row = F.struct(*rest)
    best = df.groupBy(*on).agg(F.min_by(row, F.struct(*order)).alias("__row"))
    return best.select(*on, *[F.col("__row")[c].alias(c) for c in rest])


def mark_all_but_last(df: DataFrame, on: Sequence[str], order: Sequence[Column], out: str) -> DataFrame:
    """True for each row that has a later row with the same ``on``.

    The last rows are about as many as the rows, so they are joined as they
    are: copies for salts would multiply a table of that size.
    """
    last = df.groupBy(*on).agg(F.max(F.struct(*order)).alias("__last"))
    joined = df.join(last, list(on))
    return joined.withColumn(out, F.struct(*order) < F.col("__last")).drop("__last")


def inner_align_range(
    a: DataFrame, b: DataFrame, on: Sequence[str], ts: str, start: Column, end: Column
) -> DataFrame:
    inside = F.col(ts).between(start, end)
    return a.filter(inside).join(b.filter(inside), list(on), "inner")


def semi_align(a: DataFrame, b: DataFrame, on: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Both sides restricted to the keys they share."""
    keys = list(on)
    return a.join(b, keys, "left_semi"), b.join(a, keys, "left_semi")


def lag_join(df: DataFrame, keys: Sequence[str], idx: str, value: str, steps: int, out: str) -> DataFrame:
    """Value ``steps`` earlier in time; needs no gap-free grid and no window."""
    earlier = df.select(*keys, (F.col(idx) + steps).alias(idx), F.col(value).alias(out))
    return df.join(earlier, [*keys, idx], "left")


def station_mean(frames: Sequence[DataFrame], on: Sequence[str]) -> DataFrame:
    """Mean of every numeric column over the union of stations."""
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    numeric = [n for n, t in both.dtypes if t in ("double", "float", "int", "bigint") and n not in on]
    return both.groupBy(*on).agg(*[F.avg(c).alias(c) for c in numeric])


def band_counts(
    df: DataFrame, keys: Sequence[str], value: str, eps: float
) -> DataFrame:
    """Per key: number of ordered pairs ``i != j`` with ``|xi - xj| < eps``.

    Counted, never listed: values are reduced to (key, value, count) and each
    value's matches are a difference of cumulative counts, found by merging
    the band edges ``x - eps`` and ``x + eps`` into the ranking.
    """
    from tsfoundry.operators.quantiles import value_cumcounts

    probes = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("v")).agg(
        F.count(F.lit(1)).alias("c")
    )
    side = F.explode(F.array(
        F.struct(F.col("v").alias("p"), F.col("c").alias("w"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("m")),
        F.struct((F.col("v") - eps).alias("p"), F.lit(0).cast("long").alias("w"), F.lit(1).alias("kind"), (-F.col("c")).alias("m")),
        F.struct((F.col("v") + eps).alias("p"), F.lit(0).cast("long").alias("w"), F.lit(2).alias("kind"), F.col("c").alias("m")),
    ))
    marks = probes.select(*keys, side.alias("s")).select(*keys, "s.*")
    edges = (
        marks.groupBy(*keys, "p")
        .agg(
            F.sum("w").alias("w"),
            F.coalesce(F.sum(F.when(F.col("kind") == 1, F.col("m"))), F.lit(0)).alias("low"),
            F.coalesce(F.sum(F.when(F.col("kind") == 2, F.col("m"))), F.lit(0)).alias("high"),
        )
    )
    ranked = value_cumcounts(edges, keys, "p", weight=F.col("w"))
    placed = ranked.join(edges.select(*keys, F.col("p").alias("v"), "low", "high"), [*keys, "v"])
    # strictly inside the band: below the upper edge, above the lower edge
    pairs = F.sum(F.col("high") * F.col("below") + F.col("low") * (F.col("below") + F.col("c")))
    return placed.groupBy(*keys).agg(
        (pairs - F.max("n")).cast("long").alias("pairs"), F.max("n").cast("long").alias("n")
    )


def holiday_table(spark, first_year: int, last_year: int) -> DataFrame:
    """National holidays of Germany: fixed dates and offsets from Easter Sunday.

    The number of rows is at most ten per year.
    """
    # Fixed values: (month, day) of holidays on a fixed date.
    fixed = [(1, 1), (5, 1), (10, 3), (12, 25), (12, 26)]
    # Days after Easter Sunday (Good Friday, Easter Monday,
    # Ascension Day, Whit Monday).
    movable = [-2, 1, 39, 50]
    years = spark.range(first_year, last_year + 1).select(F.col("id").cast("int").alias("y"))
    easter = easter_sunday(F.col("y"))
    days = F.array(
        *[F.make_date(F.col("y"), F.lit(m), F.lit(d)) for m, d in fixed],
        *[F.date_add(easter, k) for k in movable],
    )
    # Fixed value: Reformation Day was a national holiday once, in 2017.
    extra = F.when(F.col("y") == 2017, F.array(F.make_date(F.col("y"), F.lit(10), F.lit(31))))
    both = F.concat(days, F.coalesce(extra, F.array().cast("array<date>")))
    return years.select(F.explode(both).alias("holiday")).distinct()


def holidays_around(df: DataFrame, ts: str) -> DataFrame:
    """Holidays of the years of ``ts`` and of one year before and after; none for an empty table."""
    span = df.agg(F.year(F.min(ts)).alias("lo"), F.year(F.max(ts)).alias("hi")).first()
    first, last = (span.lo - 1, span.hi + 1) if span.lo is not None else (1, 0)
    return holiday_table(df.sparkSession, first, last)


def easter_sunday(year: Column) -> Column:
    """Gregorian Easter by the anonymous computus, in integer arithmetic."""

    def div(a: Column, b: int) -> Column:
        return F.floor(a / b).cast("int")

    golden = year % 19
    century, rest = div(year, 100), year % 100
    skipped = div(century + 8, 25)
    moon = (golden * 19 + century - div(century, 4) - div(century - skipped + 1, 3) + 15) % 30
    sunday = ((century % 4) * 2 + div(rest, 4) * 2 - moon - rest % 4 + 32) % 7
    late = div(golden + moon * 11 + sunday * 22, 451)
    total = moon + sunday - late * 7 + 114
    return F.make_date(year, div(total, 31), total % 31 + 1)


def holiday_flag(df: DataFrame, holidays: DataFrame, ts: str, out: str = "is_holiday") -> DataFrame:
    """1 on a holiday. The holiday table is bounded by ten rows per year."""
    days = holidays.select(F.col("holiday").alias("__d"), F.lit(1).alias(out))
    return (
        df.withColumn("__d", F.to_date(ts)).join(F.broadcast(days), "__d", "left")
        .drop("__d").withColumn(out, F.coalesce(out, F.lit(0)))
    )


def holiday_proximity(
    df: DataFrame, holidays: DataFrame, ts: str,
    since: str = "days_since_holiday", until: str = "days_until_holiday",
) -> DataFrame:
    """Days since the last and until the next holiday; 0 where there is none.

    The gaps between holidays are listed day by day (at most 366 rows per year
    of the table), so the as-of lookup is a broadcast equality join on the
    date. Days outside the table only need its two ends.
    """
    w = Window.orderBy("holiday")  # ten rows per year
    gaps = holidays.select(F.col("holiday").alias("__from"), F.lead("holiday").over(w).alias("__to"))
    last_day = F.coalesce(F.date_sub("__to", 1), F.col("__from"))
    days = gaps.select(F.explode(F.sequence("__from", last_day)).alias("__d"), "__from", "__to")
    ends = holidays.agg(F.min("holiday").alias("__lo"), F.max("holiday").alias("__hi"))
    d = F.col("__d")
    joined = df.withColumn("__d", F.to_date(ts)).join(F.broadcast(days), "__d", "left").crossJoin(F.broadcast(ends))
    before, after = d < F.col("__lo"), d > F.col("__hi")
    return joined.withColumn(
        since, F.when(before, 0).when(after, F.datediff(d, "__hi")).otherwise(F.datediff(d, "__from"))
    ).withColumn(
        until, F.when(after | (d == F.col("__from")), 0).when(before, F.datediff("__lo", d))
        .otherwise(F.coalesce(F.datediff("__to", d), F.lit(0)))
    ).drop("__d", "__from", "__to", "__lo", "__hi")
