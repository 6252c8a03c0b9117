"""Scalers: statistics are a one-row table fitted on training rows only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsfoundry.operators.quantiles import exact_quantiles


def fit_scaler(train: DataFrame, cols: Sequence[str], method: str) -> DataFrame:
    """Per column its ``center`` and ``scale``; a zero scale becomes 1."""
    if method == "robust":
        long = train.unpivot([], list(cols), "column", "v") if len(cols) > 1 else train.select(
            F.lit(cols[0]).alias("column"), F.col(cols[0]).alias("v")
        )
        q = exact_quantiles(long, ["column"], "v", [0.25, 0.5, 0.75], ["q1", "med", "q3"])
        stats = q.select("column", F.col("med").alias("center"), (F.col("q3") - F.col("q1")).alias("scale"))
    else:
        pick = {
            "standard": (F.avg, F.stddev_pop),
            "minmax": (F.min, lambda c: F.max(c) - F.min(c)),
        }[method]
        row = train.agg(*[f(c).cast("double").alias(f"{c}__{k}") for c in cols for k, f in zip("cs", pick)])
        stats = row.select(F.explode(F.array(*[
            F.struct(F.lit(c).alias("column"), F.col(f"{c}__c").alias("center"), F.col(f"{c}__s").alias("scale"))
            for c in cols
        ])).alias("s")).select("s.*")
    return stats.withColumn("scale", F.when(F.col("scale") == 0, 1.0).otherwise(F.col("scale")))


def apply_scaler(df: DataFrame, stats: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(x - center) / scale. The statistics collapse to a single broadcast row."""
    one = stats.groupBy().agg(*[
        F.max(F.when(F.col("column") == c, F.col(k))).alias(f"__{k}_{c}")
        for c in cols for k in ("center", "scale")
    ])
    scaled = {c: (F.col(c) - F.col(f"__center_{c}")) / F.col(f"__scale_{c}") for c in cols}
    joined = df.crossJoin(F.broadcast(one))  # exactly one row
    return joined.select(*[scaled[c].alias(c) if c in scaled else F.col(c) for c in df.columns])


def scale_by_group(
    df: DataFrame, part: str, groups: dict[str, dict]
) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Scale feature groups, each with its own method, fitted where ``part`` is train.

    ``groups`` maps a group name to ``{"columns": [...], "method": ..., "enabled": bool}``.
    """
    train = df.filter(F.col(part) == "train")
    fitted: dict[str, DataFrame] = {}
    by_method: dict[str, list[str]] = {}
    for name, g in groups.items():
        if g.get("enabled", True) and g["columns"]:
            by_method.setdefault(g["method"], []).extend(g["columns"])
    tables = {m: fit_scaler(train, cols, m) for m, cols in by_method.items()}
    for name, g in groups.items():
        if g.get("enabled", True) and g["columns"]:
            fitted[name] = tables[g["method"]].filter(F.col("column").isin(*g["columns"]))
    for method, cols in by_method.items():
        df = apply_scaler(df, tables[method], cols)
    return df, fitted
