"""What packing's program places, what the label filter lets through, and how large groups get."""

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tsfoundry.llm import packing, suffix_dedup, token_counts, toxicity
from tsfoundry.llm.common import partitions

PATH = public_tokenizers.path("byte_bpe_50k.json")


def histogram(sf):
    text = pq.read_table(f"/root/testdata/{sf}/documents.parquet", columns=["text"])["text"].combine_chunks().fill_null("")
    count = token_counts.counter(PATH)
    n = np.concatenate([count(pa.array(text.slice(i, 500))) for i in range(0, len(text), 500)]) + 1
    first = n - (n - 1) // 1024 * 1024
    counts = np.bincount(first, minlength=1025)
    counts[1024] += ((n - 1) // 1024).sum()
    return counts


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_configurations_place_nine_tenths_of_the_pieces(sf):
    counts = histogram(sf)
    short = counts.copy()
    short[1024] = 0
    used, left = packing.place_configurations(short, 1024)
    assert left.sum() <= 0.1 * short.sum()
    placed = np.zeros(1025, int)
    for config, times in used:
        assert times > 0 and sum(n * k for n, k in config) <= 1024
        for n, k in config:
            placed[n] += k * times
    assert (placed + left == short).all()
    assert sum(t for _, t in packing.solve(counts, 1024)) <= 1.007 * np.ceil(counts @ np.arange(1025) / 1024)


def test_the_program_bounds_the_sequences():
    """The dual value is a lower bound, and the shares cover no piece twice."""
    counts = np.bincount(np.random.default_rng(5).integers(1, 64, 900), minlength=65)
    shares, bound = packing.fractional(counts, 64)
    covered = np.zeros(65)
    for config, x in shares:
        for n, k in config:
            covered[n] += k * x
    assert (covered <= counts + 1e-6).all()
    assert bound <= sum(t for _, t in packing.solve(counts, 64)) and bound >= 0.95 * counts @ np.arange(65) / 64


def test_knapsack_uses_what_is_there():
    r = np.random.default_rng(6)
    for _ in range(40):
        lengths = np.sort(r.choice(np.arange(1, 20), 5, replace=False))
        counts, values = r.integers(1, 4, 5), r.random(5)
        sack = packing.Knapsack(lengths, counts, values, 30)
        best = max(
            values @ k for k in np.ndindex(*(counts + 1)) if np.array(k) @ lengths <= 30
        )
        assert sack.value == pytest.approx(best)
        got = sack.configuration(int(np.argmax(sack.worth)))
        assert all(k <= counts[i] for i, k in got.items()) and sum(lengths[i] * k for i, k in got.items()) <= 30
        assert sum(values[i] * k for i, k in got.items()) == pytest.approx(best)


@pytest.mark.parametrize("bits", [1 << 15, 1 << 25])
def test_labelled_texts_are_those_of_the_join(spark, monkeypatch, bits):
    monkeypatch.setattr(toxicity, "FILTER_BITS", bits)
    texts = spark.range(6000).select("id", F.concat(F.lit("t"), "id").alias("text")).unionAll(spark.createDataFrame([(None, "x"), (7, "again")], "id long, text string"))
    marks = spark.range(0, 9000, 7).select("id", (F.col("id") % 2).cast("int").alias("toxic"))
    got = sorted(tuple(x) for x in toxicity.labelled(texts, marks).select("id", "text", "toxic").collect())
    assert got == sorted(tuple(x) for x in texts.join(marks, "id").select("id", "text", "toxic").collect()) and len(got) == 859
    assert toxicity.labelled(texts, marks.where("false")).count() == 0


def test_groups_grow_in_number_not_in_size(spark):
    """Twice the text makes twice the groups where bytes decide, so the greatest group stays."""
    df = spark.range(20_000).select(F.col("id"), F.repeat(F.lit("x"), 1000).alias("text"))
    each = 1 << 20

    def greatest(docs):
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0]
        n = partitions(docs, size, each)
        sums = docs.groupBy(F.pmod(F.xxhash64("id"), F.lit(n))).agg(F.sum(F.octet_length("text")).alias("b"))
        return n, sums.agg(F.max("b")).first()[0]

    one, two = greatest(df), greatest(df.unionAll(df.withColumn("id", F.col("id") + 20_000)))
    assert two[0] in (2 * one[0], 2 * one[0] - 1) and two[1] <= 1.15 * one[1] and one[1] <= 1.25 * each
    assert suffix_dedup.GROUP_BYTES < suffix_dedup.SHARD_BYTES
