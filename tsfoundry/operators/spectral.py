"""Correlation over time and decompositions."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tsfoundry.functions.loess import stl, stl_reach
from tsfoundry.operators.chunking import CHUNK, OWN, chunk_size, over_chunks, plain_objects, with_halo
from tsfoundry.operators.lookup import attach


def centred(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    means = df.groupBy(*keys).agg(*[F.avg(c).alias(f"__m_{c}") for c in cols])
    joined = attach(df, means, keys)
    return joined.withColumns({f"__d_{c}": F.col(c) - F.col(f"__m_{c}") for c in cols})


def lag_sums_of_block(x: np.ndarray, own: np.ndarray, lags: int) -> np.ndarray:
    """Sums of ``x[t] * x[t - k]`` over the block's own places t, for k = 0 .. lags; unknown values count as zero."""
    z = np.where(np.isfinite(x), x, 0.0)
    mine = np.where(own, z, 0.0)
    return np.array([mine[k:] @ z[: len(z) - k] if k < len(z) else 0.0 for k in range(lags + 1)])


def lagged_sums(df: DataFrame, keys: Sequence[str], idx: str, value: str, max_lag: int | Column) -> DataFrame:
    """Long (keys, lag, n, g): sums of lagged products of the centred series / n.

    A chunk with a halo of ``max_lag`` rows gives one vector of sums, so no
    more than chunks x lags numbers are shuffled after the chunks are made.
    ``max_lag`` may be a column that is constant in each key. ``n`` counts
    known values; lags that reach beyond the series are left out.
    """
    reach = max_lag if isinstance(max_lag, Column) else F.lit(max_lag)
    d = centred(df.select(*keys, idx, value, reach.cast("int").alias("__lags")), keys, [value])
    rows = d.select(*keys, idx, "__lags", F.col(f"__d_{value}").alias("__x"))
    halo = with_halo(rows, idx, F.col("__lags") if isinstance(max_lag, Column) else max_lag)
    schema = T.StructType([
        *[df.schema[k] for k in keys], T.StructField("n", T.LongType()), T.StructField("s", T.ArrayType(T.DoubleType())),
    ])

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf[OWN].to_numpy()
        at = pdf[idx].to_numpy() - pdf[idx].min()
        x, mine = np.full(at.max() + 1, np.nan), np.zeros(at.max() + 1, bool)
        x[at], mine[at] = pdf["__x"].to_numpy(dtype=float), own
        sums = lag_sums_of_block(x, mine, int(pdf["__lags"].iloc[0]))
        return plain_objects(pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in keys}, "n": [int((mine & np.isfinite(x)).sum())], "s": [sums]}), keys)

    parts = halo.groupBy(*keys, CHUNK).applyInPandas(block, schema)
    sums = parts.select(*keys, "n", F.posexplode("s").alias("lag", "__s")).groupBy(*keys, "lag").agg(
        F.sum("__s").alias("__s"), F.sum("n").alias("n")
    )
    return sums.filter(F.col("lag") < F.greatest("n", F.lit(1))).select(*keys, "lag", "n", (F.col("__s") / F.nullif("n", F.lit(0))).alias("g"))


def autocovariances(
    df: DataFrame, keys: Sequence[str], idx: str, value: str, max_lag: int | Column
) -> DataFrame:
    """One row per key: ``n`` and ``gamma``, autocovariances of lag 0 and on, up to ``max_lag``; beyond the series they are zero."""
    long = lagged_sums(df, keys, idx, value, max_lag)
    one = long.groupBy(*keys).agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("lag", "g"))).alias("__m"))  # max_lag + 1 values
    gamma = F.transform("__m", lambda p: F.coalesce(p["g"], F.lit(0.0)))
    if not isinstance(max_lag, Column):
        gamma = F.concat(gamma, F.array_repeat(F.lit(0.0), F.greatest(F.lit(0), F.lit(max_lag + 1) - F.size("__m"))))
    return one.select(*keys, "n", gamma.alias("gamma"))


def acf(df: DataFrame, keys: Sequence[str], idx: str, value: str, max_lag: int) -> DataFrame:
    """Long (keys, n, lag, acf), lags 0..max_lag; global mean, divided by n."""
    long = lagged_sums(df, keys, idx, value, max_lag)
    g0 = F.max(F.when(F.col("lag") == 0, F.col("g"))).over(Window.partitionBy(*keys))  # max_lag + 1 rows
    return long.select(*keys, "n", "lag", (F.col("g") / F.nullif(g0, F.lit(0.0))).alias("acf"))


def acf_outer(df: DataFrame, keys: Sequence[str], idx: str, value: str, max_lag: int) -> DataFrame:
    """Outer product of the autocorrelations: (max_lag + 1)^2 rows per key."""
    cov = autocovariances(df, keys, idx, value, max_lag)
    r = F.transform("gamma", lambda g: g / F.nullif(F.element_at("gamma", 1), F.lit(0.0)))
    one = cov.select(*keys, r.alias("r"))
    rows = one.select(*keys, "r", F.posexplode("r").alias("lag_a", "a"))
    cells = rows.select(*keys, "lag_a", "a", F.posexplode("r").alias("lag_b", "b"))
    return cells.select(*keys, "lag_a", "lag_b", (F.col("a") * F.col("b")).alias("product"))


def cross_correlations(
    df: DataFrame, keys: Sequence[str], idx: str, target: str, exog: Sequence[str], max_lag: int = 24
) -> DataFrame:
    """Long (keys, variable, lag, r): target at t + lag against the covariate at t."""
    cols = [target, *exog]
    d = centred(df.select(*keys, idx, *cols), keys, cols)
    spread = over_chunks(
        d, keys, idx, max_lag,
        lambda w: {f"__l_{c}_{k}": F.lag(f"__d_{c}", k).over(w) for c in exog for k in range(1, max_lag + 1)},
    )
    y = F.col(f"__d_{target}")
    n = F.count(y)
    aggs = [n.alias("n"), F.stddev_pop(target).alias("__sy")]
    for c in exog:
        sums = [F.sum(y * F.col(f"__d_{c}"))] + [F.sum(y * F.col(f"__l_{c}_{k}")) for k in range(1, max_lag + 1)]
        aggs += [F.stddev_pop(c).alias(f"__s_{c}"), F.array(*sums).alias(f"__p_{c}")]
    row = spread.groupBy(*keys).agg(*aggs)
    per_var = F.explode(F.array(*[
        F.struct(F.lit(c).alias("variable"), F.col(f"__s_{c}").alias("s"), F.col(f"__p_{c}").alias("p")) for c in exog
    ]))
    long = row.select(*keys, "n", "__sy", per_var.alias("v")).select(
        *keys, "n", "__sy", F.col("v.variable").alias("variable"), F.col("v.s").alias("s"),
        F.posexplode("v.p").alias("lag", "p"),
    )
    scale = F.nullif(F.col("n") * F.col("__sy") * F.col("s"), F.lit(0.0))
    return long.select(*keys, "variable", "lag", (F.col("p") / scale).alias("r"))


def best_lag(ccf: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Lag of the largest absolute correlation; the smaller lag wins a tie."""
    order = F.struct(F.abs("r").alias("a"), (-F.col("lag")).alias("b"))
    return ccf.groupBy(*keys, "variable").agg(
        F.max_by("lag", order).alias("lag"), F.max_by("r", order).alias("r")
    )


def seasonal_decompose(
    df: DataFrame, keys: Sequence[str], idx: str, value: str, period: int
) -> DataFrame:
    """Additive decomposition: centred moving average, seasonal means, residual."""
    half = period // 2

    def build(w: Window) -> dict:
        v = F.col(value)
        first, last = F.lag(v, half).over(w), F.lead(v, half).over(w)
        if period % 2:
            total = F.sum(v).over(w.rowsBetween(-half, half))
            return {"trend": F.when(first.isNotNull() & last.isNotNull(), total / period)}
        inner = F.sum(v).over(w.rowsBetween(-half + 1, half - 1))
        return {"trend": (inner + 0.5 * (first + last)) / period}

    start = df.groupBy(*keys).agg(F.min(idx).alias("__first"))
    smooth = attach(over_chunks(df, keys, idx, half, build, lookahead=half), start, keys, spread=[idx])
    placed = smooth.withColumn("__pos", F.pmod(F.col(idx) - F.col("__first"), F.lit(period)))
    means = placed.groupBy(*keys, "__pos").agg(F.avg(F.col(value) - F.col("trend")).alias("__s"))
    level = F.avg("__s").over(Window.partitionBy(*keys))  # `period` rows per key
    seasonal = means.select(*keys, "__pos", (F.col("__s") - level).alias("seasonal"))
    return (
        attach(placed, seasonal, [*keys, "__pos"], spread=[idx]).drop("__pos", "__first")
        .withColumn("resid", F.col(value) - F.col("trend") - F.col("seasonal"))
    )


def stl_decompose(
    df: DataFrame, keys: Sequence[str], idx: str, value: str, period: int = 24, seasonal: int = 7,
    chunk: int | None = None,
) -> DataFrame:
    """Seasonal-trend decomposition: (keys, idx, value, trend, seasonal, resid).

    Every smoother is local, so a chunk with a halo as wide as all passes can
    see gives the same values as the whole series. A series of less than two
    periods has null parts.
    """
    reach = stl_reach(period, seasonal)
    size = chunk or chunk_size(2 * reach)
    size = -(-size // period) * period
    plain = df.select(*keys, idx, F.col(value).cast("double").alias(value))
    schema = T.StructType([*plain.schema.fields, *[T.StructField(c, T.DoubleType()) for c in ("trend", "seasonal", "resid")]])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(idx)
        y = pdf[value].to_numpy(dtype=float)
        trend = season = np.full(len(y), np.nan)
        if len(y) >= 2 * period:
            trend, season = stl(y, period, seasonal)
        out = pdf[[*keys, idx, value]].assign(trend=trend, seasonal=season, resid=y - trend - season)
        return plain_objects(out[pdf[OWN].to_numpy()], keys)

    halo = with_halo(plain, idx, reach, reach, size)
    # a chunk that owns no row of the series has only halo rows: nothing to do
    owned = halo.withColumn("__any", F.max(F.col(OWN).cast("int")).over(Window.partitionBy(*keys, CHUNK)))
    return owned.filter(F.col("__any") == 1).drop("__any").groupBy(*keys, CHUNK).applyInPandas(run, schema)
