"""Positions in a global order, however the order's values are spread.

Rows are dealt by sampled splitters into ranges of (key, order), numbered inside
each range, and shifted by the counts of the ranges before. A key or an order
value that holds most rows spreads over as many ranges as it needs, unlike a
window over the key or chunks of equal width.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tsfoundry.session import cut_lineage

#: Bits of a row's place inside its range in the ids below.
_INSIDE = 33


def null_safe(a: str, b: str, columns: Sequence[str]) -> Column:
    same = F.lit(True)
    for c in columns:
        same = same & F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return same


def numbered(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], out: str = "rn", total: str | None = None
) -> DataFrame:
    """1-based position of each row of a key along ``order``; ``total`` names a column for the key's rows.

    Rows equal in keys and order are numbered as they were read. Nulls come
    first; a null key is a key. The numbered rows are written once, so that a
    lost executor can't number them in another way.
    """
    read = df.withColumn("__read", F.monotonically_increasing_id())
    by = [*[F.col(k) for k in keys], *[F.col(c) if isinstance(c, str) else c for c in order], F.col("__read")]
    names = [f"__by{i}" for i in range(len(by))]
    sorted_ = read.withColumns(dict(zip(names, by))).repartitionByRange(*names).sortWithinPartitions(*names).drop(*names, "__read")
    placed = cut_lineage(sorted_.withColumn("__id", F.monotonically_increasing_id()))
    placed = placed.withColumn("__range", F.shiftright("__id", _INSIDE))
    # one row for each key of a range: at most the ranges and the keys together
    runs = placed.groupBy(*keys, "__range").agg(F.min("__id").alias("__first"), F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    if total:
        runs = runs.withColumn(total, F.sum("__n").over(Window.partitionBy(*keys)))
    joined = placed.alias("p").join(runs.alias("r"), null_safe("p", "r", [*keys, "__range"]))
    rn = F.col("p.__id") - F.col("r.__first") + F.col("r.__before") + 1
    return joined.select(*[F.col(f"p.`{c}`") for c in df.columns], rn.cast("long").alias(out), *([F.col(total)] if total else []))
