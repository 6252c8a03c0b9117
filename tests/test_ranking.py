"""Positions in a global order, and counts in boxes of ranks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tsfoundry.operators.neighbours import box_counts, close_counts, prefix_below
from tsfoundry.operators.ranking import numbered

K = ["series_id"]


def test_numbered_over_ranges(spark):
    rng = np.random.default_rng(0)
    rows = [(k, None if rng.random() < 0.1 else int(rng.integers(0, 5)), i) for i, k in enumerate(rng.choice(["a", "b", None], p=[0.9, 0.05, 0.05], size=500).tolist())]
    df = spark.createDataFrame(rows, "series_id string, v int, i int").repartition(7)
    got = numbered(df, K, ["v", "i"], total="n").collect()
    for key in ("a", "b", None):
        own = sorted((r.rn, r.v, r.i, r.n) for r in got if r.series_id == key)
        want = sorted(((v is not None, v or 0, i) for k, v, i in rows if k == key))
        assert [r[0] for r in own] == list(range(1, len(want) + 1))
        assert [(r[1] is not None, r[1] or 0, r[2]) for r in own] == want and {r[3] for r in own} == {len(want)}
    assert numbered(df.where("false"), K, ["v"]).count() == 0


def test_one_value_spreads_over_tasks(spark):
    """95 % of the rows in one key with one value: no range holds more than twice the median's rows."""
    df = spark.range(8000).select(F.when(F.col("id") % 20 == 0, "b").otherwise("a").alias("series_id"), F.lit(1).alias("v"), "id")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would share a task
    try:
        out = numbered(df, K, ["v"])
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    parts = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert out.groupBy("series_id").agg(F.count_distinct("rn").alias("d"), F.max("rn").alias("m"), F.count("*").alias("n")).filter("d <> n OR m <> n").count() == 0
    assert len(parts) >= 4 and max(parts) <= 2 * np.median(parts)


def test_prefix_below():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 7, 64, 301):
        v = rng.integers(0, 20, n)
        p, b = rng.integers(0, n + 1, 50), rng.integers(-1, 22, 50)
        assert prefix_below(v, p, b).tolist() == [int((v[:i] < j).sum()) for i, j in zip(p, b)]


@pytest.mark.parametrize("ties", [False, True])
def test_close_counts(spark, ties):
    rng = np.random.default_rng(2)
    x = rng.integers(0, 6, 120).astype(float) if ties else rng.normal(size=120)
    df = spark.createDataFrame([("a", i, float(v), 1.3) for i, v in enumerate(x)], "series_id string, idx long, y double, e double")
    for r in close_counts(df, K, "idx", "y", "e").collect():
        v = x[r.idx]
        assert (r.below, r.upto) == (int((x <= v - 1.3).sum()), int((x < v + 1.3).sum())) and r.below <= r["rank"] < r.upto


@pytest.mark.parametrize("size", [4, 16, 4096])
@pytest.mark.parametrize("kind", ["spread", "one corner"])
def test_box_counts(spark, size, kind):
    rng = np.random.default_rng(3)
    n = 150
    x, z = rng.permutation(n)[: n - 1], rng.permutation(n)[: n - 1]
    lo, hi = (np.zeros((2, n - 1), int), np.full((2, n - 1), 3 * n // 4)) if kind == "one corner" else np.sort(rng.integers(0, n + 1, (2, 2, n - 1)), axis=0)
    rows = [("a", n, *map(int, (x[i], z[i], lo[0, i], hi[0, i], lo[1, i], hi[1, i]))) for i in range(n - 1)]
    df = spark.createDataFrame(rows, "series_id string, total long, x long, z long, x_lo long, x_hi long, z_lo long, z_hi long")
    want = sum(int(((x >= r[4]) & (x < r[5]) & (z >= r[6]) & (z < r[7])).sum()) for r in rows)
    assert box_counts(df, K, size).first().joint == want
