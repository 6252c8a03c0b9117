"""Data quality: null handling, outliers, coverage and staleness checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tsfoundry.functions.time import HOUR, epoch
from tsfoundry.operators.lookup import attach
from tsfoundry.operators.quantiles import exact_quantiles

NUMERIC = ("double", "float", "tinyint", "smallint", "int", "bigint")


def numeric_columns(df: DataFrame) -> list[str]:
    return [n for n, t in df.dtypes if t in NUMERIC or t.startswith("decimal")]


def select_numeric(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    names = set(numeric_columns(df))
    return df.select(*[c for c in df.columns if c in names or c in keep])


def null_rates(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, nulls, total), one row per column, from one aggregate."""
    counts = df.agg(
        F.count(F.lit(1)).alias("total"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns]
    )
    return counts.unpivot(["total"], list(columns), "column", "nulls")


def missing_report(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns having nulls, with their count and percentage."""
    return (
        null_rates(df, columns).filter(F.col("nulls") > 0)
        .select("column", "nulls", (F.col("nulls") * 100.0 / F.col("total")).alias("percent"))
    )


def drop_sparse_columns(df: DataFrame, columns: Sequence[str], max_rate: float = 0.5) -> DataFrame:
    """Drop columns with a null rate above ``max_rate``; reads one row of counts."""
    sparse = [
        r["column"]
        for r in null_rates(df, columns).collect()
        if r["total"] and r["nulls"] / r["total"] > max_rate
    ]
    return df.drop(*sparse)


def assert_no_nulls(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The frame itself, or ValueError naming the columns that hold nulls."""
    bad = [r["column"] for r in null_rates(df, columns).collect() if r["nulls"]]
    if bad:
        raise ValueError(f"null values in features: {sorted(bad)}")
    return df


def missing_by_bucket(df: DataFrame, bucket: Column, columns: Sequence[str]) -> DataFrame:
    """Null counts per time bucket and column."""
    counts = df.groupBy(bucket.alias("bucket")).agg(
        *[F.count_if(F.col(c).isNull()).alias(c) for c in columns]
    )
    return counts.unpivot(["bucket"], list(columns), "column", "nulls")


def handle_missing(df: DataFrame, method: str, columns: Sequence[str] | None = None) -> DataFrame:
    """``drop`` rows with a null, or replace nulls by the column ``mean``."""
    cols = list(columns or numeric_columns(df))
    if method == "drop":
        return df.na.drop(subset=cols)
    if method == "mean":
        means = df.agg(*[F.avg(c).alias(f"__m_{c}") for c in cols])
        filled = [F.coalesce(c, f"__m_{c}").alias(c) if c in cols else F.col(c) for c in df.columns]
        return df.crossJoin(F.broadcast(means)).select(*filled)  # one row of means
    raise ValueError(f"unknown method {method!r}")


def iqr_bounds(df: DataFrame, keys: Sequence[str], column: str, k: float = 1.5) -> DataFrame:
    q = exact_quantiles(df, keys, column, [0.25, 0.75], ["__q1", "__q3"])
    spread = (F.col("__q3") - F.col("__q1")) * k
    return q.select(*keys, (F.col("__q1") - spread).alias("__lo"), (F.col("__q3") + spread).alias("__hi"))


def with_iqr_bounds(df: DataFrame, keys: Sequence[str], column: str, k: float = 1.5) -> DataFrame:
    return attach(df, iqr_bounds(df, keys, column, k), keys)


def iqr_outliers(df: DataFrame, keys: Sequence[str], column: str, k: float = 1.5) -> DataFrame:
    marked = with_iqr_bounds(df, keys, column, k)
    outside = (F.col(column) < F.col("__lo")) | (F.col(column) > F.col("__hi"))
    return marked.filter(outside).drop("__lo", "__hi")


def iqr_filter(df: DataFrame, keys: Sequence[str], column: str, k: float = 1.5) -> DataFrame:
    marked = with_iqr_bounds(df, keys, column, k)
    return marked.filter(F.col(column).between(F.col("__lo"), F.col("__hi"))).drop("__lo", "__hi")


def zscores(df: DataFrame, keys: Sequence[str], column: str, ddof: int = 1) -> DataFrame:
    """Add ``z``; null where the deviation is zero. ``ddof`` is 1 (EDA) or 0 (cleaning)."""
    deviation = {1: F.stddev_samp, 0: F.stddev_pop}[ddof]
    stats = df.groupBy(*keys).agg(F.avg(column).alias("__m"), deviation(column).alias("__s"))
    scored = attach(df, stats, keys)
    z = (F.col(column) - F.col("__m")) / F.nullif(F.col("__s"), F.lit(0.0))
    return scored.withColumn("z", z).drop("__m", "__s")


def zscore_outliers(
    df: DataFrame, keys: Sequence[str], column: str, limit: float = 3.0, ddof: int = 1
) -> DataFrame:
    return zscores(df, keys, column, ddof).filter(F.abs("z") > limit)


def outliers(df: DataFrame, keys: Sequence[str], column: str, method: str = "iqr", ddof: int = 0) -> DataFrame:
    if method == "iqr":
        return iqr_outliers(df, keys, column)
    if method == "zscore":
        return zscore_outliers(df, keys, column, 3.0, ddof)
    raise ValueError(f"unknown method {method!r}")


def remove_outliers(df: DataFrame, keys: Sequence[str], column: str, method: str = "iqr", ddof: int = 0) -> DataFrame:
    """The rows ``outliers`` does not return; a constant column loses no row."""
    if method == "iqr":
        return iqr_filter(df, keys, column)
    if method == "zscore":
        scored = zscores(df, keys, column, ddof)
        return scored.filter(F.col("z").isNull() | (F.abs("z") <= 3.0)).drop("z")
    raise ValueError(f"unknown method {method!r}")


def residual_outliers(df: DataFrame, keys: Sequence[str], residual: str, limit: float = 3.0) -> DataFrame:
    """Rows whose uncentred residual exceeds ``limit`` sample deviations."""
    stats = df.groupBy(*keys).agg(F.stddev_samp(residual).alias("__s"))
    return attach(df, stats, keys).filter(F.abs(residual) > limit * F.col("__s")).drop("__s")


def staleness(df: DataFrame, source: str, ts: str, as_of: Column, max_hours: int = 3) -> DataFrame:
    """Per source: its newest row and whether it needs a refresh."""
    newest = df.groupBy(source).agg(F.max(ts).alias("newest"))
    return newest.withColumn("stale", epoch(as_of) - epoch("newest") > max_hours * HOUR)


def coverage(df: DataFrame, source: str, ts: str, start: Column) -> DataFrame:
    """Per source: its oldest row and whether it reaches back to ``start``."""
    oldest = df.groupBy(source).agg(F.min(ts).alias("oldest"))
    return oldest.withColumn("covered", F.col("oldest") <= start)


def assert_coverage(df: DataFrame, source: str, ts: str, start: Column) -> DataFrame:
    """The rows; an error with the number of sources that start too late and the first ten by name."""
    late = coverage(df, source, ts, start).filter(~F.col("covered")).select(source)
    n = late.count()
    if n:
        raise ValueError(f"{n} covariates start too late: {[r[0] for r in late.orderBy(source).take(10)]}")
    return df
