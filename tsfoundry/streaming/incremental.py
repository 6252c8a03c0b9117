"""Streaming twins of the refresh operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tsfoundry.operators.align import append_dedupe, keep_first
from tsfoundry.sources.store import path_exists


def stream_table(spark: SparkSession, sf_dir: str, name: str, schema: StructType) -> DataFrame:
    """Files of one table as a stream."""
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/{name}*")


def hourly_totals(events: DataFrame, keys: Sequence[str], ts: str, value: str, late: str = "2 hours") -> DataFrame:
    """Hourly sums; an hour is final once the watermark has passed its end."""
    marked = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    sums = marked.groupBy(*keys, F.window(ts, "1 hour").alias("w")).agg(F.sum(value).alias("y"))
    return sums.select(*keys, F.col("w.start").alias("ts"), "y")


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Process everything available into a parquet table and return it."""
    stream.writeStream.format("parquet").outputMode(mode).option("path", path).option(
        "checkpointLocation", checkpoint
    ).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def upsert(
    stream: DataFrame, keys: Sequence[str], ts: str, root: str, checkpoint: str,
    tiebreak: Sequence[Column] = (),
) -> DataFrame:
    """Merge batches into a table partitioned by day; rows already there win.

    A batch reads and rewrites only the days it touches. Merging a batch a
    second time, as after a failure, changes nothing.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fresh = batch.withColumn("day", F.to_date(ts))
        merged = keep_first(fresh, ["day", *keys, ts], list(tiebreak) or [F.col(ts)])
        # overwriting single partitions leaves no completion marker at the root
        if path_exists(spark, root):
            old = spark.read.schema(fresh.schema).parquet(root)
            touched = old.join(fresh.select("day").distinct(), "day", "left_semi")
            merged = append_dedupe(touched, merged, ["day", *keys, ts], tiebreak=tiebreak)
        writer = merged.select(*fresh.columns).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("day").parquet(root)

    q = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.parquet(root)


def split_by(stream: DataFrame, ts: str, as_of: Column) -> DataFrame:
    return stream.withColumn("part", F.when(F.col(ts) < as_of, "history").otherwise("forecast"))
