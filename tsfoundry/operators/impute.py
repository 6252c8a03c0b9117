"""Filling gaps in series."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tsfoundry.functions.time import floor_div
from tsfoundry.operators.chunking import CHUNK, DEFAULT_CHUNK, OWN, known_neighbours, row_numbers
from tsfoundry.operators.lookup import attach


def _linear(t: Column, direction: str) -> Column:
    p, n = F.col("prev"), F.col("next")
    span = F.nullif(n["i"] - p["i"], F.lit(0).cast("long"))
    inner = F.coalesce(p["v"] + (n["v"] - p["v"]) * (t - p["i"]) / span, p["v"])
    between = F.when(p.isNotNull() & n.isNotNull(), inner)
    trailing = F.when(n.isNull(), p["v"]) if direction in ("forward", "both") else F.lit(None)
    leading = F.when(p.isNull(), n["v"]) if direction in ("backward", "both") else F.lit(None)
    return F.coalesce(between, trailing, leading)


def interpolate_time(
    df: DataFrame, keys: Sequence[str], idx: str, value: str, direction: str = "forward", out: str | None = None
) -> DataFrame:
    """Linear in time between known neighbours.

    Forward: a trailing gap repeats the last value, a leading gap stays null.
    """
    filled = known_neighbours(df, keys, idx, value)
    return filled.withColumn(out or value, _linear(F.col(idx), direction)).drop("prev", "next")


def interpolate_linear(
    df: DataFrame, keys: Sequence[str], idx: str, value: str, direction: str = "forward", out: str | None = None
) -> DataFrame:
    """Linear in row position, whatever the time between rows."""
    numbered = row_numbers(df, keys, idx, out="__pos")
    return interpolate_time(numbered, keys, "__pos", value, direction, out).drop("__pos")


def _edge_points(rows: DataFrame, keys: Sequence[str], idx: str, value: str) -> DataFrame:
    """Copies of known points for every other chunk that has them among the two before or the two after it.

    Only the first two and last two points of a chunk can be. A point reaches
    forward to the chunk of the second point after it, or to its key's last
    row, and backward to that of the second point before it.
    """
    cols = [*keys, idx, value, CHUNK]
    known = rows.filter(F.col(value).isNotNull()).select(*cols)
    inside = Window.partitionBy(*keys, CHUNK).orderBy(idx, value)
    edges = known.select(
        *cols, F.lag(idx, 2).over(inside).alias("__b"), F.lead(idx, 2).over(inside).alias("__a")
    ).filter(F.col("__b").isNull() | F.col("__a").isNull()).select(*cols)
    ends = rows.groupBy(*keys).agg(F.max(CHUNK).alias("__end"))
    along = Window.partitionBy(*keys).orderBy(idx, value)
    reach = edges.unionByName(ends, allowMissingColumns=True).select(
        *cols,
        # the row of "ends" lies before all points and has no chunk: lags see it as no point
        F.max("__end").over(along).alias("__end"),
        *[F.lag(CHUNK, k).over(along).alias(f"__b{k}") for k in (1, 2)], F.lead(CHUNK, 2).over(along).alias("__a2"),
    ).filter(F.col(CHUNK).isNotNull())
    chunks = F.sequence(F.coalesce("__b2", "__b1", CHUNK), F.coalesce("__a2", "__end"))
    others = reach.withColumn("__own_chunk", F.col(CHUNK)).select(
        *keys, idx, value, "__own_chunk", F.explode(chunks).alias(CHUNK)
    )
    return others.filter(F.col(CHUNK) != F.col("__own_chunk")).drop("__own_chunk")


def interpolate_cubic(
    df: DataFrame, keys: Sequence[str], idx: str, value: str, out: str | None = None, chunk: int = DEFAULT_CHUNK
) -> DataFrame:
    """Cubic through the two known points on either side of a gap.

    Where fewer than two lie on a side the gap is filled linearly. This is a
    local curve, not one global spline. Rows are dealt and sorted once, by
    chunk, with the known points next to the chunk beside them.
    """
    placed = [F.col(c).isNotNull() for c in (*keys, idx)]
    rows = df.filter(reduce(and_, placed)).withColumn(CHUNK, floor_div(F.col(idx), chunk))
    halo = _edge_points(rows, keys, idx, value).withColumn(OWN, F.lit(False))
    spread = rows.withColumn(OWN, F.lit(True)).unionByName(halo, allowMissingColumns=True)
    here = F.when(F.col(value).isNotNull(), F.struct(F.col(idx).cast("double").alias("i"), F.col(value).alias("v")))
    by = ", ".join(f"`{c}`" for c in (*keys, CHUNK))

    def known(side: str, k: int) -> Column:
        """The k-th known point before or after a gap row; a known row beside it at the same index lies before."""
        return F.expr(f"{side}(__pt, {k}) IGNORE NULLS OVER (PARTITION BY {by} ORDER BY `{idx}`, `{value}` NULLS LAST)")

    seen = spread.repartition(*keys, CHUNK).withColumn("__pt", here).select(
        "*", known("lag", 2).alias("__p0"), known("lag", 1).alias("__p1"),
        known("lead", 1).alias("__p2"), known("lead", 2).alias("__p3"),
    ).filter(OWN)
    x = F.col(idx).cast("double")
    pts = [F.col(f"__p{k}") for k in range(4)]

    def basis(j: int) -> Column:
        term = pts[j]["v"]
        for m in range(4):
            if m != j:
                term = term * (x - pts[m]["i"]) / (pts[j]["i"] - pts[m]["i"])
        return term

    cubic = basis(0) + basis(1) + basis(2) + basis(3)
    a, b = pts[1], pts[2]
    linear = a["v"] + (b["v"] - a["v"]) * (x - a["i"]) / (b["i"] - a["i"])
    # a gap before the first known point stays null
    filled = F.coalesce(F.col(value), F.when(a.isNotNull(), F.coalesce(cubic, linear, a["v"])))
    return seen.withColumn(out or value, filled).drop(CHUNK, OWN, "__pt", *[f"__p{k}" for k in range(4)])


def fill(df: DataFrame, keys: Sequence[str], idx: str, value: str, methods: Sequence[str] = ("ffill", "bfill"),
         out: str | None = None) -> DataFrame:
    """Carry the last value forward and/or the next one backward, in the order given."""
    seen = known_neighbours(df, keys, idx, value)
    side = {"ffill": F.col("prev")["v"], "bfill": F.col("next")["v"]}
    return seen.withColumn(out or value, F.coalesce(*[side[m] for m in methods])).drop("prev", "next")


def mean_impute(df: DataFrame, keys: Sequence[str], value: str, out: str | None = None) -> DataFrame:
    means = df.groupBy(*keys).agg(F.avg(value).alias("__m"))
    return attach(df, means, keys).withColumn(out or value, F.coalesce(value, "__m")).drop("__m")
