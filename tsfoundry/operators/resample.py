"""Regular grids: resampling, gap filling, calendars."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tsfoundry.functions.time import floor_div, index_ts, step_index

GRID_CHUNK = 4096


def grid_index(rows: DataFrame, keys: Sequence[str], idx: str = "idx") -> DataFrame:
    """Every step index between the first and last one of each key.

    Generated in two levels, so no array is longer than a chunk. The chunks are
    dealt to a few tasks per core first: by their own few bytes adaptive
    execution would leave them, and so the whole grid, to one or a few in all.
    """
    spark = rows.sparkSession
    tasks = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    span = rows.groupBy(*keys).agg(F.min(idx).alias("__lo"), F.max(idx).alias("__hi"))
    chunks = span.select(
        *keys, "__lo", "__hi",
        F.explode(
            F.sequence(floor_div(F.col("__lo"), GRID_CHUNK), floor_div(F.col("__hi"), GRID_CHUNK))
        ).alias("__g"),
    ).repartition(tasks, *keys, "__g")
    start = F.greatest(F.col("__lo"), F.col("__g") * GRID_CHUNK)
    stop = F.least(F.col("__hi"), F.col("__g") * GRID_CHUNK + (GRID_CHUNK - 1))
    return chunks.select(*keys, F.explode(F.sequence(start, stop)).alias(idx))


def resample(
    df: DataFrame, keys: Sequence[str], ts: str, step: int,
    aggs: dict[str, tuple[str, str]], fill: float | None = 0.0,
) -> DataFrame:
    """Aggregate irregular rows onto a gap-free grid of ``step`` seconds.

    ``aggs`` maps an output name to (function, column). Grid rows are added as
    empty rows before the single grouping, so filling gaps costs no join.
    """
    columns = sorted({c for _, c in aggs.values()})
    rows = df.select(*keys, step_index(ts, step).alias("idx"), *columns)
    grid = grid_index(rows.select(*keys, "idx"), keys)
    empty = [F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in columns]
    both = rows.unionByName(grid.select(*keys, "idx", *empty))

    def build(fn: str, c: str, name: str) -> Column:
        value = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "count": F.count}[fn](c)
        return (F.coalesce(value, F.lit(fill)) if fill is not None else value).alias(name)

    return (
        both.groupBy(*keys, "idx")
        .agg(*[build(fn, c, name) for name, (fn, c) in aggs.items()])
        .select(*keys, "idx", index_ts("idx", step).alias("ts"), *aggs)
    )


def regular_grid(df: DataFrame, keys: Sequence[str], idx: str, step: int) -> DataFrame:
    """Left join rows onto the gap-free grid between their first and last step."""
    grid = grid_index(df.select(*keys, idx), keys, idx)
    return grid.join(df.drop("ts"), [*keys, idx], "left").withColumn("ts", index_ts(idx, step))
