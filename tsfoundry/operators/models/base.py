"""Forecaster protocol, registry and the partition-wise sums models are fitted from."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class QuantileForecaster(Protocol):
    def fit(self, df: DataFrame) -> "QuantileForecaster": ...

    def transform(self, df: DataFrame) -> DataFrame: ...


REGISTRY: dict[str, Callable[..., QuantileForecaster]] = {}


def register(name: str) -> Callable:
    def add(cls: Callable[..., QuantileForecaster]) -> Callable[..., QuantileForecaster]:
        REGISTRY[name] = cls
        return cls

    return add


def make(name: str, **options) -> QuantileForecaster:
    if name not in REGISTRY:
        raise ValueError(f"unknown model {name!r}; known: {sorted(REGISTRY)}")
    return REGISTRY[name](**options)


def save(model, spark: SparkSession, path: str) -> None:
    """Write a model that gives its state as plain values: one row below ``path``, in the storage Spark writes to."""
    name = next(n for n, cls in REGISTRY.items() if cls is type(model))
    row = [(name, json.dumps(model.state(), sort_keys=True))]
    spark.createDataFrame(row, "model string, state string").coalesce(1).write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str):
    """The model that ``save`` wrote, ready to score."""
    row = spark.read.parquet(path).first()
    if row["model"] not in REGISTRY:
        raise ValueError(f"unknown model {row['model']!r}; known: {sorted(REGISTRY)}")
    return REGISTRY[row["model"]].from_state(json.loads(row["state"]))


def partition_sums(
    df: DataFrame, cols: Sequence[str], fn: Callable[[np.ndarray], np.ndarray]
) -> np.ndarray:
    """Sum of ``fn(rows)`` over all rows, for a fixed-length vector ``fn``.

    Each partition adds up its own vector; vectors are then summed element by
    element with map-side combine. Only the final vector reaches the driver.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for pdf in batches:
            part = fn(pdf.to_numpy(dtype=float))
            total = part if total is None else total + part
        if total is not None:
            yield pd.DataFrame({"i": np.arange(len(total)), "s": total})

    sums = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).mapInPandas(run, "i int, s double")
    rows = sums.groupBy("i").agg(F.sum("s").alias("s")).collect()
    out = np.zeros(len(rows))
    for r in rows:
        out[r["i"]] = r["s"]
    return out
