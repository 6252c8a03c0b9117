import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from tsfoundry.operators import chunking as ch
from tsfoundry.operators.impute import fill, interpolate_cubic, interpolate_linear, interpolate_time
from tsfoundry.operators.resample import grid_index, resample

K = ["series_id"]


def test_halo_windows_equal_plain_windows(spark, series):
    rng = np.random.default_rng(1)
    df = series({"y": rng.normal(size=200)}, "a", -37).union(series({"y": rng.normal(size=90)}, "b", 5))

    def build(w):
        return {
            "lag": F.lag("y", 9).over(w), "mean": F.avg("y").over(w.rowsBetween(-6, 0)),
            "ahead": F.lead("y", 4).over(w),
        }

    got = ch.over_chunks(df, K, "idx", 9, build, lookahead=4, chunk=16)
    w = Window.partitionBy(*K).orderBy("idx")
    want = df.select("*", *[c.alias(n) for n, c in build(w).items()])
    assert sorted(got.collect()) == sorted(want.collect())


def test_running_sum_and_row_numbers(spark, series):
    rng = np.random.default_rng(2)
    y = rng.normal(size=150)
    df = series({"y": y}).filter(F.col("idx") % 3 != 1)
    got = {r.idx: (r.s, r.rn, r.n) for r in ch.row_numbers(
        ch.running_sum(df, K, "idx", {"s": F.col("y")}, chunk=8), K, "idx", out="rn", total="n", chunk=8).collect()}
    kept = [i for i in range(150) if i % 3 != 1]
    total = 0.0
    for pos, i in enumerate(kept):
        total += y[i]
        assert abs(got[i][0] - total) < 1e-9
        assert got[i][1:] == (pos + 1, len(kept))


def test_known_neighbours_over_empty_chunks(spark, series):
    y = [None] * 5 + [1.0] + [None] * 40 + [9.0, None] + [4.0] + [None] * 20
    rows = ch.known_neighbours(series({"y": y}), K, "idx", "y", chunk=8).collect()
    for r in rows:
        before = [(i, v) for i, v in enumerate(y) if v is not None and i <= r.idx]
        after = [(i, v) for i, v in enumerate(y) if v is not None and i >= r.idx]
        assert (r.prev and tuple(r.prev)) == (before[-1] if before else None)
        assert (r.next and tuple(r.next)) == (after[0] if after else None)


def _values(df, col="y"):
    return [r[col] for r in df.orderBy("idx").collect()]


def test_interpolation_edges(spark, series):
    df = series({"y": [None, 1, None, None, 4, None]})
    assert _values(interpolate_time(df, K, "idx", "y")) == [None, 1, 2, 3, 4, 4]
    assert _values(interpolate_time(df, K, "idx", "y", "backward")) == [1, 1, 2, 3, 4, None]
    assert _values(interpolate_time(df, K, "idx", "y", "both")) == [1, 1, 2, 3, 4, 4]
    assert _values(fill(df, K, "idx", "y")) == [1, 1, 1, 1, 4, 4]
    sparse = df.filter(F.col("idx") != 2)
    assert _values(interpolate_linear(sparse, K, "idx", "y")) == [None, 1, 2.5, 4, 4]


def test_all_null_and_single_row(spark, series):
    assert _values(interpolate_time(series({"y": [None, None]}), K, "idx", "y")) == [None, None]
    assert _values(fill(series({"y": [3]}), K, "idx", "y")) == [3]


def test_cubic_reproduces_a_cubic(spark, series):
    f = [0.5 * x**3 - 2 * x + 1 for x in range(12)]
    y = [v if i in (0, 1, 2, 5, 6, 9, 10, 11) else None for i, v in enumerate(f)]
    got = _values(interpolate_cubic(series({"y": y}), K, "idx", "y"))
    assert np.allclose(got, f)


def _cubic(known, x):
    """Brute force: known points sorted by index, one row's index."""
    before, after = [p for p in known if p[0] <= x], [p for p in known if p[0] > x]
    if not before or before[-1][0] == x or not after:
        return before[-1][1] if before else None
    pts = before[-2:] + after[:2]
    if len(before) < 2 or len(after) < 2:
        pts = [before[-1], after[0]]
    return sum(v * np.prod([(x - j) / (i - j) for j, _ in pts if j != i]) for i, v in pts)


def test_cubic_over_chunks_equals_brute_force(spark, series):
    rng = np.random.default_rng(5)
    y = [None] * 20 + [1.0] + [None] * 30 + [2.0, 5.0] + [None] * 11 + [7.0, None, 3.0, 4.0, 1.0] + [None] * 40
    panels = {"a": y, "b": [None if u < 0.8 else u for u in rng.random(120)], "c": [None] * 30, "d": [2.0] + [None] * 40}
    df = series({"y": []})
    for sid, v in panels.items():
        df = df.union(series({"y": v}, sid, -13))
    df = df.filter("idx % 5 != 1 OR y IS NOT NULL").withColumn("note", F.concat("series_id", F.col("idx").cast("string")))
    out = interpolate_cubic(df, K, "idx", "y", out="z", chunk=8)
    assert out.columns == [*df.columns, "z"]
    rows = out.collect()
    assert sorted((r.series_id, r.idx, r.note) for r in rows) == sorted((r.series_id, r.idx, r.note) for r in df.collect())
    for r in rows:
        want = _cubic([(i - 13, v) for i, v in enumerate(panels[r.series_id]) if v is not None], r.idx)
        assert r.z == want if r.y is not None or want is None else abs(r.z - want) < 1e-9 * max(1, abs(want)), r


def test_cubic_sorts_rows_once_and_joins_none(series):
    out = interpolate_cubic(series({"y": [1.0, None, 3.0]}).withColumn("note", F.lit("x")), K, "idx", "y")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
    assert plan.count("Sort [") == 3  # known points, those at the ends of chunks, all rows


def test_resample_fills_gaps(spark):
    df = spark.sql("""SELECT 'a' series_id, timestamp_ntz'2024-01-01 00:10:00' ts, 2.0D v
        UNION ALL SELECT 'a', timestamp_ntz'2024-01-01 00:50:00', 3.0D
        UNION ALL SELECT 'a', timestamp_ntz'2024-01-01 03:00:00', null""")
    got = resample(df, K, "ts", 3600, {"y": ("sum", "v")}).orderBy("idx").collect()
    assert [r.y for r in got] == [5.0, 0.0, 0.0, 0.0]
    kept = resample(df, K, "ts", 3600, {"y": ("sum", "v")}, None).orderBy("idx").collect()
    assert [r.y for r in kept] == [5.0, None, None, None]


def test_grid_spans_several_chunks(spark):
    df = spark.createDataFrame([("a", -5000), ("a", 9000)], "series_id string, idx long")
    got = sorted(r.idx for r in grid_index(df, K).collect())
    assert got == list(range(-5000, 9001))


def test_grid_is_dealt_before_its_rows_are_made(spark):
    rows = [(str(k), i) for k in range(40) for i in (0, 9999)]
    grid = grid_index(spark.createDataFrame(rows, "series_id string, idx long"), K)
    parts = [r["count"] for r in grid.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(parts) == 400_000 and len(parts) == 4 and max(parts) < 200_000


def test_empty_input(spark, series):
    none = series({"y": [1.0]}).filter("idx > 5")
    assert interpolate_time(none, K, "idx", "y").count() == 0
    assert ch.over_chunks(none, K, "idx", 1, lambda w: {"l": F.lag("y").over(w)}).count() == 0
