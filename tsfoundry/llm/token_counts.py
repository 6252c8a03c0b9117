"""Token counts from a cache of content digests."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tsfoundry.llm import bpe
from tsfoundry.llm.common import chunks, load
from tsfoundry.session import configure, scratch_path

NAME = "op12_token_counts"
ORACLE = None

#: Texts with more tokens are over the limit.
LIMIT = 512
#: Names the folder of a cache that lasts; without it a query fills one of its own.
CACHE_SETTING = "tsfoundry.tokenCache"
#: Bytes of text encoded together.
CHUNK_BYTES = 4 << 20

_SCHEMA = "tokenizer string, digest binary, n_tokens long"


def version(path: str) -> str:
    """Digest of the tokenizer: its file, and the library that reads it with its version."""
    import sentencepiece
    import tokenizers

    library = f"sentencepiece {sentencepiece.__version__}" if path.endswith(".model") else f"tokenizers {tokenizers.__version__}"
    with open(path, "rb") as f:
        return hashlib.sha256(hashlib.sha256(f.read()).digest() + library.encode()).hexdigest()


@lru_cache(maxsize=4)
def counter(path: str):
    """A function from a string column to the texts' numbers of tokens."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda col: np.array([len(x) for x in model.encode(col.to_pylist(), num_threads=1)], np.int64)
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    if tokenizer.normalizer is None and type(tokenizer.pre_tokenizer).__name__ == "ByteLevel" and not tokenizer.pre_tokenizer.add_prefix_space:
        voc = bpe.vocabulary(path)
        merge = bpe.merge_with_tiktoken if bpe.id_is_rank(voc) else bpe.merge_words
        return lambda col: np.diff(bpe.encode_texts(col, voc, merge)[1])
    return lambda col: np.array([len(x.ids) for x in tokenizer.encode_batch(col.to_pylist(), add_special_tokens=False)], np.int64)


def content(text) -> F.Column:
    """What is digested: the text in UTF-8, a null as an empty one.

    Nothing else is safe to normalise for every tokenizer: white space and case
    change byte-level counts, and lower case may turn text into a special token.
    """
    return F.coalesce(text.cast("string"), F.lit(""))


def stored(spark: SparkSession, cache: str, tokenizer: str) -> DataFrame:
    """``digest, n_tokens`` of one tokenizer; runs that appended at the same time may have stored a digest twice."""
    path = spark._jvm.org.apache.hadoop.fs.Path(cache)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)  # the first run finds an empty folder
    rows = spark.read.schema(_SCHEMA).parquet(cache).where(F.col("tokenizer") == tokenizer)
    return rows.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def misses(rows: DataFrame, known: DataFrame) -> DataFrame:
    """``digest, text``: one text of each digest in ``rows(id, digest, text)`` that ``known`` lacks.

    Digests alone are grouped and looked up. Texts follow by the id of one
    row for each missing digest, so copies of a text neither travel nor meet;
    rows that repeat an id with its text leave the last few duplicates.
    """
    first = rows.groupBy("digest").agg(F.min("id").alias("id")).join(known, "digest", "left_anti")
    own = (F.col("r.digest") == F.col("f.digest")) & F.col("r.id").eqNullSafe(F.col("f.id"))
    return rows.alias("r").join(first.alias("f"), own, "left_semi").select("digest", "text")


def fill(docs: DataFrame, path: str, cache: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes each distinct text without a stored count once, and appends the counts to the cache.

    The append is one job whose files appear when it ends, so a lost executor
    or a failed run leaves no half of it; a later run finds what earlier ones stored.
    """
    tokenizer = version(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for b in chunks(batches, limit=CHUNK_BYTES):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(count(b.column(1)))], ["digest", "n_tokens"])

    text = content(F.col(text_col))
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), text.alias("text"))
    found = misses(rows, stored(docs.sparkSession, cache, tokenizer)).mapInArrow(run, "digest binary, n_tokens long")
    one = found.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    one.select(F.lit(tokenizer).alias("tokenizer"), "digest", "n_tokens").write.mode("append").partitionBy("tokenizer").parquet(cache)


def token_counts(docs: DataFrame, path: str, cache: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_bytes, n_tokens, over_limit`` of every text, counts coming from the cache after it has been filled.

    ``path`` is a ``.json`` file of the tokenizers library or a ``.model`` of
    sentencepiece; nothing is added, cut or padded. ``cache`` is a folder that
    executors share; another file or library version has counts of its own
    there. A null text is empty. Rows with equal texts, ids or both each have
    a row; null ids stay; other columns are ignored; an empty table gives no rows.
    """
    fill(docs, path, cache, id_col, text_col)
    known = stored(docs.sparkSession, cache, version(path))
    text = content(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("id"), F.octet_length(text).cast("long").alias("n_bytes"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"))
    out = rows.join(known, "digest", "left")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    spark = configure(spark)
    cache = spark.conf.get(CACHE_SETTING, None) or scratch_path(spark, "token-cache")
    return token_counts(load(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), cache)
