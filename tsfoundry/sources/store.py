"""Parquet stores for features, forecasts, metrics and finished runs."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession


def config_key(config: dict) -> str:
    return hashlib.sha256(json.dumps(config, sort_keys=True).encode()).hexdigest()[:16]


def path_exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def exists(spark: SparkSession, path: str) -> bool:
    """True when a completely written parquet table lies at ``path``."""
    return path_exists(spark, f"{path}/_SUCCESS")


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite") -> DataFrame:
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_or_build(
    spark: SparkSession, path: str, build: Callable[[], DataFrame], partition_by: Sequence[str] = ()
) -> DataFrame:
    """Read the table at ``path``; build and write it first if it is not there."""
    if exists(spark, path):
        return spark.read.parquet(path)
    return write_table(build(), path, partition_by)


def feature_store(
    spark: SparkSession, root: str, config: dict, build: Callable[[], DataFrame],
    partition_by: Sequence[str] = (),
) -> DataFrame:
    return read_or_build(spark, f"{root}/features/{config_key(config)}", build, partition_by)


def pending_runs(planned: DataFrame, finished: DataFrame, on: Sequence[str]) -> DataFrame:
    """Planned runs without a finished marker."""
    return planned.join(finished, list(on), "left_anti")
