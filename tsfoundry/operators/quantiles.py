"""Exact ranks and quantiles without collecting a group into one task.

Rows are first reduced to (key, value, count), which removes ties. Values then
fall into buckets given by a fixed monotone function, so that running counts
need only a window per (key, bucket) plus an offset per bucket. A bucket with
too many distinct values is cut again between its own minimum and maximum.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

B1, B2 = "__b1", "__b2"
RESOLUTION = 256
SPLIT_ABOVE = 200_000
SUB_BUCKETS = 4096


def _bucket(v: Column) -> Column:
    # infinite values have the outermost buckets, beyond the largest finite number's
    magnitude = F.floor(F.least(F.log1p(F.abs(v)), F.lit(1000.0)) * RESOLUTION)
    return (F.signum(v) * magnitude).cast("int")


def _ranks(p: float) -> tuple[Column, Column]:
    """0-based ranks whose values enclose the quantile ``p``."""
    position = (F.col("n") - 1) * F.lit(float(p))
    return F.floor(position), F.ceil(position)


def value_cumcounts(
    df: DataFrame, keys: Sequence[str], value: Column | str, weight: Column | None = None,
    split_above: int = SPLIT_ABOVE, probs: Sequence[float] | None = None,
) -> DataFrame:
    """One row per (keys, v): its count ``c``, rows ``below`` it and the total ``n``.

    Null and NaN values are ignored, infinite ones come first and last. With ``probs`` only the buckets holding the ranks
    of those probabilities are ranked and returned.
    """
    v = F.col(value) if isinstance(value, str) else value
    w = weight if weight is not None else F.lit(1)
    rows = df.select(*keys, (v.cast("double") + F.lit(0.0)).alias("v"), w.cast("long").alias("__w"))
    vc = (
        rows.filter(F.col("v").isNotNull() & ~F.isnan("v")).groupBy(*keys, "v").agg(F.sum("__w").alias("c"))
        .withColumn(B1, _bucket(F.col("v")))
    )
    axis = Window.partitionBy(*keys).orderBy(B1)
    buckets = vc.groupBy(*keys, B1).agg(
        F.sum("c").alias("__cnt"), F.count(F.lit(1)).alias("__distinct"),
        F.min("v").alias("__lo"), F.max("v").alias("__hi"),
    ).select(
        *keys, B1, "__distinct", "__lo", "__hi",
        F.coalesce(F.sum("__cnt").over(axis.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__off1"),
        F.sum("__cnt").over(Window.partitionBy(*keys)).alias("n"), "__cnt",
    )
    if probs is not None:
        wanted = F.lit(False)
        for p in probs:
            low, high = _ranks(p)
            wanted = wanted | ((F.col("__off1") <= high) & (F.col("__off1") + F.col("__cnt") > low))
        buckets = buckets.filter(wanted)
    buckets = buckets.drop("__cnt")
    big = F.col("__distinct") > split_above
    share = (F.col("v") - F.col("__lo")) / (F.col("__hi") - F.col("__lo"))
    placed = vc.join(buckets, [*keys, B1]).withColumn(
        B2, F.when(big, F.floor(share * SUB_BUCKETS).cast("int")).otherwise(F.lit(0))
    )
    sub_axis = Window.partitionBy(*keys, B1).orderBy(B2).rowsBetween(Window.unboundedPreceding, -1)
    sub = (
        placed.filter(big).groupBy(*keys, B1, B2).agg(F.sum("c").alias("__cnt2"))
        .select(*keys, B1, B2, F.coalesce(F.sum("__cnt2").over(sub_axis), F.lit(0)).alias("__off2"))
    )
    w = (
        Window.partitionBy(*keys, B1, B2).orderBy("v")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return placed.join(sub, [*keys, B1, B2], "left").select(
        *keys, "v", "c",
        (
            F.col("__off1") + F.coalesce(F.col("__off2"), F.lit(0))
            + F.coalesce(F.sum("c").over(w), F.lit(0))
        ).cast("long").alias("below"),
        "n",
    )


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: Column | str, probs: Sequence[float],
    names: Sequence[str] | None = None,
) -> DataFrame:
    """Linear-interpolated quantiles per key, one column per probability."""
    names = names or [f"q{p}" for p in probs]
    ranked = value_cumcounts(df, keys, value, probs=probs)
    aggs = []
    for p, name in zip(probs, names):
        low, high = _ranks(p)

        def at(rank: Column) -> Column:
            inside = (rank >= F.col("below")) & (rank < F.col("below") + F.col("c"))
            return F.max(F.when(inside, F.col("v")))

        frac = F.max((F.col("n") - 1) * F.lit(float(p)) - low)
        a, b = at(low), at(high)
        aggs.append(F.when(a == b, a).otherwise(a + (b - a) * frac).alias(name))
    return ranked.groupBy(*keys).agg(*aggs)
