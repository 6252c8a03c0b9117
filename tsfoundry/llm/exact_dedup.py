"""Exact duplicates by content sort, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tsfoundry.llm.common import load
from tsfoundry.session import configure, cut_lineage

NAME = "op9_exact_dedup"

#: A group of copies with more rows or bytes is dealt over several sort groups.
GROUP_ROWS = 1_000
GROUP_BYTES = 8 << 20
#: So many of the largest groups are split. Any other group has less than this part of the parts that all groups together would have.
SPLIT_GROUPS = 10_000
#: Leading bytes of a text that, with its digest, place it in the order.
PREFIX_BYTES = 32


def normalised(text) -> F.Column:
    """Each run of space, tab and line ends becomes one space; null is empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def split_groups(base: DataFrame) -> DataFrame:
    """``sha, parts`` of the groups of ``base(sha, norm)`` that need most parts, by rows or by bytes."""
    groups = base.groupBy("sha").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("norm")).alias("bytes"))
    size = F.greatest(F.col("n") / GROUP_ROWS, F.col("bytes") / GROUP_BYTES)
    large = groups.withColumn("size", size).where("size > 1").orderBy(F.desc("size"), "sha").limit(SPLIT_GROUPS)
    return large.select("sha", F.ceil("size").cast("int").alias("parts"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Group rows of equal normalised text and keep the smallest id of each group.

    Texts are range-partitioned by sampled splitters on their leading bytes and
    digest, sorted externally within each range, and every text is compared in
    full with its neighbour. A large group is sorted in several parts; the head
    of each part, one row, meets the other heads in a second grouping. Digests
    only place rows: texts that differ are never merged.

    Returns ``id_col, keep_id, group_size, kept, text_sha256`` per input row.
    Null and empty texts are equal to each other and to nothing else, unless
    white space is all another text has: that is one space. A null id sorts
    last. Of rows with equal id and text the first is kept, all count in
    ``group_size``. Other columns are ignored; an empty table gives no rows.
    """
    base = docs.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("norm"))
    base = base.select("id", "norm", F.sha2(F.col("norm").cast("binary"), 256).alias("sha"), F.substring(F.col("norm").cast("binary"), 1, PREFIX_BYTES).alias("prefix"))

    large = split_groups(base)
    # At most SPLIT_GROUPS rows of 80 bytes.
    placed = base.join(F.broadcast(large), "sha", "left").withColumn("part", F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64("id"), F.col("parts"))).otherwise(0))

    ordered = placed.repartitionByRange("prefix", "sha", "part")
    run = Window.partitionBy("prefix", "sha", "part").orderBy("norm", F.asc_nulls_last("id"))
    before = F.lag("norm").over(run)
    marked = ordered.withColumn("head", before.isNull() | (before != F.col("norm")))
    marked = marked.withColumn("first", F.last(F.when(F.col("head"), F.struct("id")), ignorenulls=True).over(run.rowsBetween(Window.unboundedPreceding, 0)))
    local = marked.select("id", "prefix", "sha", "part", "head", "first", F.col("parts").isNotNull().alias("large"), F.when(F.col("head") & F.col("parts").isNotNull(), F.col("norm")).alias("head_text"))
    local = local.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("prefix", "sha", "part", "first"))).drop("prefix")
    local = cut_lineage(local)

    # Heads of the parts of large groups meet: equal texts combine before they are shuffled.
    heads = local.where("large AND head")
    whole = heads.groupBy("sha", "head_text").agg(F.min_by("first", F.struct(F.col("first.id").isNull(), F.col("first.id"))).alias("all_first"), F.sum("n").alias("all_n"))
    joined = heads.join(whole, ["sha", "head_text"]).select("sha", "part", "first", "all_first", "all_n")
    out = local.drop("head_text").join(joined, ["sha", "part", "first"], "left")
    first, size = F.coalesce("all_first", "first"), F.coalesce("all_n", "n")
    return out.select(
        F.col("id").alias(id_col), first["id"].alias("keep_id"), size.alias("group_size"),
        (F.col("head") & F.col("first").eqNullSafe(first)).alias("kept"), F.col("sha").alias("text_sha256"),
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents whose row stays, with all their columns; of rows of equal id and text one."""
    kept = exact_dedup(docs, id_col, text_col).where("kept").select(F.col(id_col).alias("__id"), F.col("text_sha256").alias("__sha"))
    marked = docs.withColumn("__own", F.sha2(normalised(F.col(text_col)).cast("binary"), 256))
    rows = marked.join(kept, marked[id_col].eqNullSafe(kept["__id"]) & (F.col("__own") == F.col("__sha")), "left_semi")
    one = Window.partitionBy(id_col, "__own").orderBy(F.length(text_col), text_col)
    return rows.withColumn("__place", F.row_number().over(one)).where("__place = 1").drop("__own", "__place")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(load(configure(spark), sf_dir, "documents"))


ORACLE = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM n
"""
