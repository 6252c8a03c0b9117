"""Least squares from Gram matrices.

The data pass is one Spark aggregate giving the k x k matrix of cross products
per key (k is the number of columns, never the number of rows). Only such
matrices reach Python, one row per key, inside executor tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tsfoundry.operators.chunking import CHUNK, OWN, with_halo


def gram(df: DataFrame, keys: Sequence[str], cols: Sequence[Column]) -> DataFrame:
    """(keys, n, g): upper triangle of the cross products, row by row.

    Rows with a null in any column are left out.
    """
    names = [f"__x{i}" for i in range(len(cols))]
    known = df.select(*keys, *[c.cast("double").alias(n) for c, n in zip(cols, names)]).na.drop(subset=names)
    sums = [F.sum(F.col(a) * F.col(b)) for i, a in enumerate(names) for b in names[i:]]
    return known.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.array(*sums).alias("g"))


def centred_gram(df: DataFrame, keys: Sequence[str], cols: Sequence[Column]) -> DataFrame:
    """(keys, n, g, mean): cross products of a constant and the deviations of ``cols`` from their means.

    For regressions with a constant: far from zero, the products of the columns
    themselves lose the digits that matter. Covariances are added up stably and
    in one pass. Rows with a null in any column are left out.
    """
    names = [f"__x{i}" for i in range(len(cols))]
    known = df.select(*keys, *[c.cast("double").alias(n) for c, n in zip(cols, names)]).na.drop(subset=names)
    n = F.count(F.lit(1))
    products = [F.covar_pop(a, b) * n for i, a in enumerate(names) for b in names[i:]]
    constant = [n.cast("double"), *[F.lit(0.0) for _ in names]]
    return known.groupBy(*keys).agg(n.alias("n"), F.array(*constant, *products).alias("g"), F.array(*[F.avg(c) for c in names]).alias("mean"))


def from_zero(b: np.ndarray, inv: np.ndarray, mean: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients and inverse matrix of a regression on deviations, with the constant of the columns themselves.

    ``mean`` holds the means of the regressors, then of the target.
    """
    b, inv, x = b.copy(), inv.copy(), mean[: len(b) - 1]
    b[0] += mean[-1] - b[1:] @ x
    inv[0, 0] += x @ inv[1:, 1:] @ x
    return b, inv


def lag_gram(
    df: DataFrame, keys: Sequence[str], idx: str, cols: Sequence[str], lookback: int | Column,
    design: Callable[[dict[str, np.ndarray]], np.ndarray],
) -> DataFrame:
    """Gram matrix of a design that looks back over ``lookback`` rows.

    ``design`` maps the column arrays of one ordered chunk (halo included) to
    a matrix with one line per row; lines holding NaN are left out. Partial
    matrices per (key, chunk), one per 4096 or more rows, are added up per key.
    Where ``lookback`` is a column, the matrix may differ in size by key.
    """
    key_fields = [df.schema[k] for k in keys]
    schema = T.StructType([
        *key_fields, T.StructField("n", T.LongType()), T.StructField("g", T.ArrayType(T.DoubleType())),
    ])

    def partial(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(idx)
        arrays = {c: pdf[c].to_numpy(dtype=float) for c in cols}
        x = design(arrays)
        keep = pdf[OWN].to_numpy() & np.isfinite(x).all(axis=1)
        x = x[keep]
        g = x.T @ x
        out = {k: [pdf[k].iloc[0]] for k in keys}
        return pd.DataFrame({**out, "n": [int(len(x))], "g": [g[np.triu_indices(g.shape[0])]]})

    halo = with_halo(df.select(*keys, idx, *cols), idx, lookback)
    parts = halo.groupBy(*keys, CHUNK).applyInPandas(partial, schema)
    # Cells are added up one by one, with map-side combine; a key ends with one row per cell of its matrix.
    cells = parts.select(*keys, "n", F.posexplode("g").alias("__i", "__v")).groupBy(*keys, "__i").agg(
        F.sum("n").alias("n"), F.sum("__v").alias("__v")
    )
    line = F.array_sort(F.collect_list(F.struct("__i", "__v")))
    return cells.groupBy(*keys).agg(F.max("n").alias("n"), F.transform(line, lambda c: c["__v"]).alias("g"))


def lagged(x: np.ndarray, k: int) -> np.ndarray:
    out = np.full(len(x), np.nan)
    if k < len(x):
        out[k:] = x[: len(x) - k] if k else x
    return out


def unpack(g: np.ndarray) -> np.ndarray:
    """Symmetric matrix of an upper triangle."""
    k = int((np.sqrt(8 * len(g) + 1) - 1) / 2)
    m = np.zeros((k, k))
    m[np.triu_indices(k)] = g
    return m + np.triu(m, 1).T


def solve(m: np.ndarray, xs: Sequence[int], y: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Coefficients, inverse cross-product matrix and residual sum of squares."""
    xs = list(xs)
    a = m[np.ix_(xs, xs)]
    d = np.sqrt(np.where(np.diag(a) > 0, np.diag(a), 1.0))
    inv = np.linalg.pinv(a / np.outer(d, d), hermitian=True) / np.outer(d, d)
    b = inv @ m[xs, y]
    return b, inv, float(m[y, y] - m[xs, y] @ b)


def finish(
    grams: DataFrame, keys: Sequence[str], fn: Callable[..., dict | list[dict]], schema: str
) -> DataFrame:
    """Turn every (n, g) row, or (n, g, mean) row, into result rows of ``schema`` (keys come first)."""
    more = ["mean"] if "mean" in grams.columns else []
    fields = ", ".join(f"`{k}` {grams.schema[k].dataType.simpleString()}" for k in keys)
    full = f"{fields}, {schema}" if keys else schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                record = r._asdict()
                means = [np.asarray(record[c], dtype=float) for c in more]
                result = fn(unpack(np.asarray(record["g"], dtype=float)), int(record["n"]), *means)
                for res in result if isinstance(result, list) else [result]:
                    rows.append({**{k: record[k] for k in keys}, **res})
            yield pd.DataFrame(rows, columns=[f.strip().split()[0].strip("`") for f in full.split(", ")])

    return grams.select(*keys, "n", "g", *more).mapInPandas(run, full)


def lasso(m: np.ndarray, n: float, xs: Sequence[int], y: int, alpha: float, free: Sequence[int] = (),
          sweeps: int = 10_000, tol: float = 1e-12) -> np.ndarray:
    """Minimise RSS / (2 n) + alpha * |b|_1 by coordinate descent on a Gram matrix.

    Columns in ``free`` (such as the intercept) are not penalised.
    """
    xs, free = list(xs), set(free)
    a, c = m[np.ix_(xs, xs)] / n, m[xs, y] / n
    b = np.zeros(len(xs))
    for _ in range(sweeps):
        move = 0.0
        for j, col in enumerate(xs):
            if a[j, j] <= 0:
                continue
            rho = c[j] - a[j] @ b + a[j, j] * b[j]
            limit = 0.0 if col in free else alpha
            new = np.sign(rho) * max(abs(rho) - limit, 0.0) / a[j, j]
            move = max(move, abs(new - b[j]) * np.sqrt(a[j, j]))
            b[j] = new
        if move < tol * (1 + np.sqrt(m[y, y] / n)):
            break
    return b
