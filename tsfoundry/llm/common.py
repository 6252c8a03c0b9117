"""Helpers that the operators of this package share."""

from __future__ import annotations

import ctypes
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that numpy work looks at together inside a task.
CHUNK_BYTES = 2 << 20


def give_back() -> None:
    """Memory that Arrow and the C heap hold from the last group goes back to the system; a worker serves many groups, and many stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def id_and_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns an operator needs, under names of its own; a null text is empty."""
    return docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def partitions(df: DataFrame, bytes_: int = 0, each: int = 1) -> int:
    """Shuffle partitions of the session, or more where ``bytes_`` need more parts of ``each`` bytes."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1, -(-bytes_ // each))


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column end to end, and the n+1 offsets of its rows; a null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col, "") if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else col
    col = col.cast(pa.large_binary())
    _, offsets, data = col.buffers()
    offsets = np.frombuffer(offsets, np.int64)[col.offset : col.offset + len(col) + 1] if offsets is not None and len(col) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches into runs of rows with about ``limit`` bytes of text; a longer text is a run of its own."""
    for batch in batches:
        give_back()
        if not batch.num_rows:
            continue
        _, off = text_buffer(batch.column(batch.schema.get_field_index(text)))
        start = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(off, off[start] + limit, side="right")) - 1
            stop = min(max(stop, start + 1), batch.num_rows)
            # A copy without an offset: some Arrow kernels mistake that of a slice.
            yield batch if stop - start == batch.num_rows else batch.take(pa.array(np.arange(start, stop)))
            start = stop
    give_back()


def words(col: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of each row.

    Returns the code of every word, the distinct words, and the n+1 offsets of
    the rows in the codes.
    """
    split = pc.ascii_split_whitespace(col.cast(pa.large_string()) if len(col) else pa.array([], pa.large_string()))
    flat = split.flatten().dictionary_encode()
    codes = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    counts = np.asarray(pc.list_value_length(split).to_numpy(zero_copy_only=False), dtype=np.int64)
    row = np.repeat(np.arange(len(col)), counts)
    empty = pc.index(flat.dictionary, pa.scalar("", flat.dictionary.type)).as_py() if len(flat.dictionary) else -1
    if empty >= 0:
        keep = codes != empty
        codes, row = codes[keep], row[keep]
    offsets = np.searchsorted(row, np.arange(len(col) + 1))
    return codes, flat.dictionary, offsets


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All of start, start+1, ... start+length-1 for each pair, end to end."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) - np.repeat(first - starts, lengths)


def split_count(n: float, per: float) -> int:
    return max(1, math.ceil(n / per))
