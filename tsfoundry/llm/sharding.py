"""Shards of bounded size by extendible hashing, in DataFrame operations."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tsfoundry.llm.common import load
from tsfoundry.operators.ranking import numbered
from tsfoundry.session import configure, cut_lineage

NAME = "op6_sharding"
ORACLE = None

#: Most bytes of text in a shard.
SHARD_BYTES = 4 << 20
#: Bits of the hash.
BITS = 60
#: Rows are summed in cells of the hash, about 2^CELL_BITS to a shard and 2^LEAST_BITS at least.
CELL_BITS = 6
LEAST_BITS = 12
#: Down to this depth the full buckets, at most 2^depth short strings, are broadcast; below it their keys are spread.
BROADCAST_DEPTH = 16


def cells_of(rows: DataFrame, limit: int) -> DataFrame:
    """Add ``cell``: leading bits of the hash that no shard's border needs to cut, or all bits where a cell is over the limit."""
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    fine = min(max(LEAST_BITS, math.ceil(math.log2(max(total / limit, 1))) + CELL_BITS), BITS)
    rows = rows.withColumn("cell", F.col("bits").substr(1, fine))
    over = rows.groupBy("cell").agg(F.sum("n_bytes").alias("all_bytes"), F.min("bits").alias("low"), F.max("bits").alias("high"))
    over = over.where((F.col("all_bytes") > limit) & (F.col("low") < F.col("high"))).select("cell", F.lit(True).alias("over"))
    return rows.join(over, "cell", "left").withColumn("cell", F.when(F.col("over"), F.col("bits")).otherwise(F.col("cell"))).drop("over")


def depths(cells: DataFrame, limit: int) -> DataFrame:
    """``cell, depth``: split buckets over the limit on one more bit, round by round, until all fit."""
    cells = cells.withColumn("depth", F.lit(0))
    for depth in range(BITS):
        at = F.when(F.col("depth") == depth, F.col("cell").substr(1, depth))
        full = cells.where(F.col("depth") == depth).groupBy(at.alias("bucket")).agg(F.sum("n_bytes").alias("all_bytes"), F.min("low").alias("low"), F.max("high").alias("high"))
        full = cut_lineage(full.where((F.col("all_bytes") > limit) & (F.col("low") < F.col("high"))).select("bucket", F.lit(1).alias("more")))
        if full.isEmpty():
            break
        full = F.broadcast(full) if depth <= BROADCAST_DEPTH else full
        grown = cells.withColumn("bucket", at).join(full, "bucket", "left").withColumn("depth", F.col("depth") + F.coalesce("more", F.lit(0)))
        cells = cut_lineage(grown.drop("bucket", "more"))
    return cells.select("cell", "depth")


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = SHARD_BYTES) -> DataFrame:
    """``id_col, shard, depth, n_bytes``: the directory entry, leading hash bits, of every row.

    Only buckets over the limit split on one more bit. The rounds read and write
    the directory, sums of bytes in cells finer than shards, not the rows; texts
    are read once. Rows of equal id and text are numbered and hashed with their
    number, so copies of one row spread like others; only a single text over
    the limit stays as a shard of its own size. Null and empty texts have no
    bytes, a null id is hashed as nothing; an empty table gives no rows; other
    columns are ignored.
    """
    bits = F.lpad(F.bin(F.xxhash64(F.col(id_col), F.col(text_col))), 64, "0").substr(1, BITS)
    n_bytes = F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long")
    rows = numbered(docs.select(F.col(id_col).alias("id"), n_bytes.alias("n_bytes"), bits.alias("bits")), ["bits"], [], out="copy")
    again = F.lpad(F.bin(F.xxhash64("bits", "copy")), 64, "0").substr(1, BITS)
    rows = cut_lineage(rows.select("id", "n_bytes", F.when(F.col("copy") > 1, again).otherwise(F.col("bits")).alias("bits")))
    rows = cut_lineage(cells_of(rows, limit))
    cells = cut_lineage(rows.groupBy("cell").agg(F.sum("n_bytes").alias("n_bytes"), F.min("bits").alias("low"), F.max("bits").alias("high")))
    return rows.join(depths(cells, limit), "cell").select(F.col("id").alias(id_col), F.expr("substr(bits, 1, depth)").alias("shard"), "depth", "n_bytes")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(load(configure(spark), sf_dir, "documents"))
