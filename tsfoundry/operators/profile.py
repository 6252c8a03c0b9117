"""Descriptive tables: summaries, calendars, histograms, densities, importances."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tsfoundry.operators.quantiles import exact_quantiles, value_cumcounts


def _melt(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in cols])
    return df.select(F.explode(pairs).alias("p")).select("p.*")


def column_summary(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Mean, sample deviation and quartiles, one row per column."""
    moments = df.agg(*[f(c).alias(f"{c}__{k}") for c in cols for k, f in (("m", F.avg), ("s", F.stddev_samp))])
    rows = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"{c}__m").alias("mean"), F.col(f"{c}__s").alias("std")) for c in cols
    ]))
    quartiles = exact_quantiles(_melt(df, cols), ["column"], "v", [0.25, 0.5, 0.75], ["q25", "q50", "q75"])
    return moments.select(rows.alias("r")).select("r.*").join(quartiles, "column")


def target_summary(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"), F.max(value).alias("max"),
    )


def box_stats(df: DataFrame, ts: str, value: str, k: float = 1.5) -> DataFrame:
    """Box-plot statistics by month, weekday and hour.

    Quartiles, whiskers and outlier counts all come from the ranked distinct
    values of each slot, so no slot's rows meet in one task.
    """
    parts = {"month": F.month(ts), "weekday": F.weekday(ts), "hour": F.hour(ts)}
    slots = F.explode(F.array(*[F.struct(F.lit(p).alias("part"), c.alias("slot")) for p, c in parts.items()]))
    long = df.select(slots.alias("s"), value).select("s.*", value)
    by = ["part", "slot"]
    counts = long.groupBy(*by, value).agg(F.count(F.lit(1)).alias("c"))
    q = exact_quantiles(long, by, value, [0.25, 0.5, 0.75], ["q1", "med", "q3"])
    lo = F.col("q1") - k * (F.col("q3") - F.col("q1"))
    hi = F.col("q3") + k * (F.col("q3") - F.col("q1"))
    v = F.col(value)
    joined = counts.join(F.broadcast(q), by)  # 12 months, 7 weekdays, 24 hours
    return joined.groupBy(*by, "q1", "med", "q3").agg(
        F.sum("c").alias("n"), F.min(F.when(v >= lo, v)).alias("low"), F.max(F.when(v <= hi, v)).alias("high"),
        F.coalesce(F.sum(F.when((v < lo) | (v > hi), F.col("c"))), F.lit(0)).alias("fliers"),
    )


def profile_by_month(df: DataFrame, ts: str, slot: Column, value: str, months: Sequence[int]) -> DataFrame:
    kept = df.filter(F.month(ts).isin(*months))
    return kept.groupBy(F.month(ts).alias("month"), slot.alias("slot")).agg(F.avg(value).alias("mean"))


def correlation_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pearson correlation of all pairs, pairwise complete, from one aggregate."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    row = df.agg(*[F.corr(a, b).alias(f"{a}__{b}") for a, b in pairs])
    both = [(a, b, f"{a}__{b}") for a, b in pairs] + [(b, a, f"{a}__{b}") for a, b in pairs if a != b]
    cells = F.explode(F.array(*[
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(c).alias("r")) for a, b, c in both
    ]))
    return row.select(cells.alias("c")).select("c.*")


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """Counts per equal-width bin between minimum and maximum, the last bin closed.

    Nulls are not counted; a constant column is all in the first bin.
    """
    df = df.filter(F.col(value).isNotNull())
    span = df.agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    width = (F.col("__hi") - F.col("__lo")) / bins
    step = F.coalesce((F.col(value) - F.col("__lo")) / F.nullif(width, F.lit(0.0)), F.lit(0.0))
    slot = F.least(F.floor(step).cast("int"), F.lit(bins - 1))
    joined = df.select(value).crossJoin(F.broadcast(span))  # one row
    return joined.groupBy(slot.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def kde(df: DataFrame, value: str, points: int, cut: float = 3.0) -> DataFrame:
    """Gaussian density on a grid, Scott bandwidth; a constant column has a null density.

    Equal values are counted first. Each of them adds to every grid point
    within its own stage, so only the grid's sums are shuffled.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    stats = df.agg(
        F.nullif(F.stddev_samp(value) * F.pow(F.count(value), F.lit(-0.2)), F.lit(0.0)).alias("h"),
        F.min(value).alias("lo"), F.max(value).alias("hi"), F.count(value).alias("n"),
    )
    joined = counts.crossJoin(F.broadcast(stats))  # one row
    start, step = F.col("lo") - cut * F.col("h"), (F.col("hi") - F.col("lo") + 2 * cut * F.col("h")) / (points - 1)
    cells = joined.select("*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i"))
    x = start + step * F.col("i")
    term = F.col("c") * F.exp(-0.5 * F.pow((x - F.col("v")) / F.col("h"), F.lit(2.0)))
    scale = F.first("n") * F.first("h") * math.sqrt(2 * math.pi)
    return cells.groupBy("i").agg(F.first(x).alias("x"), (F.sum(term) / scale).alias("density"))


def importance_aggregate(df: DataFrame, value: str = "importance") -> DataFrame:
    """Mean, median, population deviation and number of runs per feature."""
    stats = df.groupBy("feature").agg(
        F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.count(F.lit(1)).alias("runs")
    )
    medians = exact_quantiles(df, ["feature"], value, [0.5], ["median"])
    return stats.join(medians, "feature").orderBy(F.desc("mean"), "feature")


def importance_trend(df: DataFrame, fold: str, value: str = "importance") -> DataFrame:
    return df.groupBy(fold, "feature").agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))


def rank_features(df: DataFrame, value: str, keys: Sequence[str]) -> DataFrame:
    """Position by falling importance, then name; one row per feature and model."""
    if keys:
        w = Window.partitionBy(*keys).orderBy(F.desc(value), "feature")
        return df.withColumn("rank", F.row_number().over(w).cast("long"))
    ranked = value_cumcounts(df, [], -F.col(value))
    tied = Window.partitionBy(value).orderBy("feature")
    placed = df.join(ranked, F.col("v") == -F.col(value) + F.lit(0.0))
    return placed.withColumn("rank", (F.col("below") + F.row_number().over(tied)).cast("long")).drop("v", "c", "below", "n")


def top_features(df: DataFrame, value: str, n: int, chunk: int) -> DataFrame:
    """The ``n`` most important features, numbered in chunks."""
    top = df.orderBy(F.desc(value), "feature").limit(n)
    w = Window.orderBy(F.desc(value), "feature")  # at most n rows
    return top.withColumn("chunk", F.floor((F.row_number().over(w) - 1) / chunk).cast("long"))
