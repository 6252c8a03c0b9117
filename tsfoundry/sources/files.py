"""Landed text files: target series, covariate files, semicolon exports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tsfoundry.operators.align import combine_first, outer_align


def target_schema(ts: str, value: str) -> T.StructType:
    return T.StructType([
        T.StructField(ts, T.TimestampNTZType()), T.StructField(value, T.DoubleType()),
    ])


def read_target_csv(
    spark: SparkSession, path: str, schema: T.StructType, ts: str, value: str
) -> DataFrame:
    """Target series as (ts, y). A missing path raises Spark's AnalysisException."""
    raw = spark.read.schema(schema).csv(path, header=True)
    return raw.select(F.col(ts).alias("ts"), F.col(value).alias("y"))


def read_covariates(
    spark: SparkSession, paths: Sequence[str], schemas: Sequence[T.StructType], ts: str
) -> DataFrame:
    """History and forecast of two covariate families, as one wide frame.

    ``paths`` holds exactly four files in the order history, forecast,
    history, forecast. History wins over forecast within a family.
    """
    if len(paths) != 4 or len(schemas) != 4:
        raise ValueError(f"expected exactly 4 covariate files, got {len(paths)}")
    frames = [
        spark.read.schema(schema).csv(path, header=True).withColumnRenamed(ts, "ts")
        for path, schema in zip(paths, schemas)
    ]
    return outer_align(
        [combine_first(frames[0], frames[1], ["ts"]), combine_first(frames[2], frames[3], ["ts"])],
        ["ts"],
    )


DELIMITED_SCHEMA = "`date` string, `time` string, `value` double"


def parse_delimited(lines: Column) -> Column:
    """Parse one ``date;'hh:mm';value`` line where ``-`` stands for null."""
    return F.from_csv(lines, DELIMITED_SCHEMA, {"sep": ";", "nullValue": "-", "quote": '"'})


def tidy_delimited(parsed: DataFrame) -> DataFrame:
    """Strip quotes from the time and drop lines without one, such as the footer."""
    clock = F.regexp_replace("time", "'", "")
    return parsed.withColumn("time", clock).filter(F.col("time").rlike(r"^\d{2}:\d{2}$"))


def read_delimited(spark: SparkSession, path: str) -> DataFrame:
    raw = (
        spark.read.schema(DELIMITED_SCHEMA)
        .csv(path, header=True, sep=";", nullValue="-")
    )
    return tidy_delimited(raw)
