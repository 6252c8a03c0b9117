"""The corpus pipeline: documents to packed token sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tsfoundry.llm import exact_dedup, language, near_dedup, packing, suffix_dedup
from tsfoundry.llm.common import load
from tsfoundry.session import configure, scratch_path


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a known language; texts without letters go."""
    configure(spark)
    return language.keep_known(docs, language.fit(docs))


def no_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    configure(spark)
    return exact_dedup.keep_first(docs)


def no_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of similar texts."""
    configure(spark)
    return near_dedup.keep_one(docs)


def no_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings that occur earlier in the corpus; ``n_chars`` follows the text."""
    configure(spark)
    cut = suffix_dedup.remove_repeats(docs)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the texts and their places in the training sequences."""
    import public_tokenizers

    configure(spark)
    return packing.pack(packing.pieces(docs, public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [
    ("language_id", known_language),
    ("exact_dedup", no_copies),
    ("near_dedup", no_near_copies),
    ("suffix_dedup", no_repeats),
    ("packing", packed),
]

#: Tokens and learned languages are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read by the next."""
    docs = load(configure(spark), sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
