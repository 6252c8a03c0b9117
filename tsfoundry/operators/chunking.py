"""Time-chunked windows and scans.

A window partitioned by series alone puts a whole series into one task. Here a
series is cut into fixed chunks of its step index, so one dominant series is
spread over many tasks:

* finite look-back: each chunk is given a halo of the rows it needs from its
  neighbours, the window runs per (series, chunk), halo rows are dropped;
* unbounded look-back: each chunk is summarised to one row, the summaries are
  combined along the (short) chunk axis and joined back as a carry.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tsfoundry.functions.time import floor_div

CHUNK = "__chunk"
OWN = "__own"
DEFAULT_CHUNK = 4096


def chunk_size(reach: int) -> int:
    """Large enough that the halo adds at most about an eighth of the rows."""
    return max(DEFAULT_CHUNK, 8 * reach)


def with_halo(
    df: DataFrame, idx: str, lookback: int | Column, lookahead: int = 0, chunk: int | None = None
) -> DataFrame:
    """Copy every row into each chunk whose rows can see it; a column as ``lookback`` differs by key."""
    size = chunk or (DEFAULT_CHUNK if isinstance(lookback, Column) else chunk_size(lookback + lookahead))
    i = F.col(idx)
    targets = F.sequence(floor_div(i - lookahead, size), floor_div(i + lookback, size))
    return df.select("*", F.explode(targets).alias(CHUNK)).withColumn(
        OWN, F.col(CHUNK) == floor_div(i, size)
    )


def plain_objects(pdf, columns: Sequence[str]):
    """Key columns as plain objects: pandas may hold strings in several Arrow
    chunks, which cannot be sent back as one column."""
    return pdf.assign(**{c: pdf[c].astype(object) for c in columns})


def over_chunks(
    df: DataFrame,
    keys: Sequence[str],
    idx: str,
    lookback: int,
    build: Callable[[Window], dict[str, Column]],
    lookahead: int = 0,
    chunk: int | None = None,
) -> DataFrame:
    """Add the window columns ``build(w)`` returns for the ordered window ``w``.

    ``idx`` must be a gap-free step index per key, so that a row distance is
    also an index distance.
    """
    spread = with_halo(df, idx, lookback, lookahead, chunk)
    w = Window.partitionBy(*keys, CHUNK).orderBy(idx)
    built = [c.alias(name) for name, c in build(w).items()]
    return spread.select("*", *built).filter(OWN).drop(CHUNK, OWN)


def _with_chunk(df: DataFrame, idx: str, chunk: int) -> DataFrame:
    return df.withColumn(CHUNK, floor_div(F.col(idx), chunk))


def running_sum(
    df: DataFrame, keys: Sequence[str], idx: str, values: dict[str, Column],
    chunk: int = DEFAULT_CHUNK,
) -> DataFrame:
    """Add running totals ``name -> sum(value)`` from the first row up to each row."""
    d = _with_chunk(df, idx, chunk)
    axis = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    totals = d.groupBy(*keys, CHUNK).agg(*[F.sum(v).alias(f"__t_{n}") for n, v in values.items()])
    carry = totals.select(
        *keys, CHUNK,
        *[F.coalesce(F.sum(f"__t_{n}").over(axis), F.lit(0)).alias(f"__c_{n}") for n in values],
    )
    w = Window.partitionBy(*keys, CHUNK).orderBy(idx).rowsBetween(Window.unboundedPreceding, 0)
    joined = d.join(carry, [*keys, CHUNK])
    out = joined.select(
        *df.columns, *[(F.col(f"__c_{n}") + F.sum(v).over(w)).alias(n) for n, v in values.items()]
    )
    return out


def row_numbers(
    df: DataFrame, keys: Sequence[str], idx: str, order: Sequence[Column | str] = (),
    out: str = "rn", total: str | None = None, chunk: int = DEFAULT_CHUNK,
) -> DataFrame:
    """1-based position of each row along ``idx`` (then ``order``) within its key.

    ``total`` optionally names a column holding the number of rows of the key.
    """
    d = _with_chunk(df, idx, chunk)
    axis = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    counts = d.groupBy(*keys, CHUNK).agg(F.count(F.lit(1)).alias("__n"))
    cols = [F.coalesce(F.sum("__n").over(axis), F.lit(0)).alias("__off")]
    if total:
        cols.append(F.sum("__n").over(whole).alias(total))
    carry = counts.select(*keys, CHUNK, *cols)
    w = Window.partitionBy(*keys, CHUNK).orderBy(idx, *order)
    joined = d.join(carry, [*keys, CHUNK])
    return joined.select(
        *df.columns,
        (F.col("__off") + F.row_number().over(w)).cast("long").alias(out),
        *([F.col(total)] if total else []),
    )


def known_neighbours(
    df: DataFrame, keys: Sequence[str], idx: str, value: str, chunk: int = DEFAULT_CHUNK,
    prefix: str = "",
) -> DataFrame:
    """Add the nearest known (index, value) at or before and at or after each row.

    New columns: ``{prefix}prev`` and ``{prefix}next``, structs ``(i, v)``, null
    where no known value exists on that side.
    """
    d = _with_chunk(df, idx, chunk)
    at = F.when(F.col(value).isNotNull(), F.col(idx))
    ends = d.groupBy(*keys, CHUNK).agg(
        F.max(at).alias("__li"), F.max_by(value, at).alias("__lv"),
        F.min(at).alias("__fi"), F.min_by(value, at).alias("__fv"),
    )
    # "after" is a running frame over the reversed order: a frame that ends
    # unbounded would be evaluated anew for every row.
    before = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(*keys).orderBy(F.desc(CHUNK)).rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select(
        *keys, CHUNK,
        *[F.last(c, ignorenulls=True).over(before).alias(f"__in{c[-1]}") for c in ("__li", "__lv")],
        *[F.last(c, ignorenulls=True).over(after).alias(f"__out{c[-1]}") for c in ("__fi", "__fv")],
    )
    back = Window.partitionBy(*keys, CHUNK).orderBy(idx).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*keys, CHUNK).orderBy(F.desc(idx)).rowsBetween(Window.unboundedPreceding, 0)
    seen = d.join(carry, [*keys, CHUNK]).select(
        *df.columns,
        F.coalesce(F.max(at).over(back), F.col("__ini")).alias("__pi"),
        F.coalesce(F.last(value, ignorenulls=True).over(back), F.col("__inv")).alias("__pv"),
        F.coalesce(F.min(at).over(ahead), F.col("__outi")).alias("__ni"),
        F.coalesce(F.last(value, ignorenulls=True).over(ahead), F.col("__outv")).alias("__nv"),
    )

    def pair(i: str, v: str) -> Column:
        return F.when(F.col(i).isNotNull(), F.struct(F.col(i).alias("i"), F.col(v).alias("v")))

    return seen.select(
        *df.columns, pair("__pi", "__pv").alias(f"{prefix}prev"), pair("__ni", "__nv").alias(f"{prefix}next")
    )
