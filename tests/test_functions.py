from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tsfoundry.functions import dst, scalar
from tsfoundry.functions import time as tm
from tsfoundry.operators import align, metrics, split
from tsfoundry.sources import files, landed, store


def ts(text):
    return datetime.fromisoformat(text)


def test_dst_spring_and_fall(spark):
    rows = [
        (1, "2024-03-31 01:30:00"), (2, "2024-03-31 02:30:00"), (3, "2024-03-31 03:30:00"),
        (4, "2024-10-27 02:30:00"), (5, "2024-10-27 02:30:00"), (6, "2024-10-27 03:00:00"),
    ]
    df = spark.createDataFrame(rows, "id int, t string").withColumn("local", F.col("t").cast("timestamp_ntz"))
    got = [r.ts for r in dst.localize(df, [], "local", "id").orderBy("id").collect()]
    assert got == [
        ts("2024-03-31T00:30:00"), None, ts("2024-03-31T01:30:00"),
        ts("2024-10-27T00:30:00"), ts("2024-10-27T01:30:00"), ts("2024-10-27T02:00:00"),
    ]


def test_shift_transitions(spark):
    rows = [(1, "2024-10-27 03:00:00"), (2, "2024-10-27 03:00:00"), (3, "2024-03-31 02:00:00"), (4, "2024-03-30 02:00:00")]
    df = spark.createDataFrame(rows, "id int, t string").select("id", F.col("t").cast("timestamp_ntz").alias("local"))
    got = [r.local for r in dst.shift_transitions(df, [], "local", "id").orderBy("id").collect()]
    assert got == [ts("2024-10-27T02:00:00"), ts("2024-10-27T03:00:00"), ts("2024-03-31T03:00:00"), ts("2024-03-30T02:00:00")]


def test_hour24_and_durations(spark):
    row = spark.range(1).select(
        scalar.hour24(F.lit("31.12.2023"), F.lit("24:00")).alias("a"), scalar.duration_seconds(F.lit("125W")).alias("w"),
        scalar.duration_seconds(F.lit("10D")).alias("d"), scalar.duration_seconds(F.lit("5H")).alias("h"),
    ).first()
    assert row == (ts("2024-01-01T00:00:00"), 125 * 604800, 864000, 18000)
    with pytest.raises(Exception, match="invalid duration"):
        spark.range(1).select(scalar.duration_seconds(F.lit("5X"))).collect()


def test_easter_and_holidays(spark):
    known = {1999: date(1999, 4, 4), 2008: date(2008, 3, 23), 2011: date(2011, 4, 24), 2024: date(2024, 3, 31), 2025: date(2025, 4, 20)}
    for y, d in known.items():
        assert spark.range(1).select(align.easter_sunday(F.lit(y))).first()[0] == d
    table = {r.holiday for r in align.holiday_table(spark, 2017, 2018).collect()}
    assert len(table) == 19 and date(2017, 10, 31) in table and date(2018, 10, 31) not in table


def test_holiday_proximity_edges(spark):
    hol = spark.createDataFrame([(date(2024, 1, 10),), (date(2024, 1, 20),)], "holiday date")
    days = ["2024-01-05", "2024-01-10", "2024-01-12", "2024-01-20", "2024-01-25"]
    df = spark.createDataFrame([(d,) for d in days], "t string").select(F.col("t").cast("timestamp_ntz").alias("ts"))
    got = align.holiday_proximity(df, hol, "ts").orderBy("ts").collect()
    assert [(r.days_since_holiday, r.days_until_holiday) for r in got] == [(0, 5), (0, 0), (2, 8), (0, 0), (5, 0)]


Q = {0.25: "a", 0.5: "b", 0.75: "c"}


@pytest.mark.parametrize("y, a, b, c, want", [
    (0.0, 1.0, 2.0, 3.0, 0.0), (4.0, 1.0, 2.0, 3.0, 1.0), (1.5, 1.0, 2.0, 3.0, 0.375), (2.0, 1.0, 2.0, 3.0, 0.5),
    (1.0, 1.0, 2.0, 3.0, 0.0), (2.5, 2.0, 1.0, 3.0, 0.5 + 0.75 * 0.25), (2.0, 1.0, 2.0, 2.0, 1.0), (1.5, None, 2.0, 3.0, None),
    (1.5, 1.0, None, 3.0, None), (1.2, 1.0, 1.2, 3.0, 0.5),
])
def test_pit(spark, y, a, b, c, want):
    df = spark.createDataFrame([(y, a, b, c)], "y double, a double, b double, c double")
    got = df.select(metrics.pit_value("y", Q)).first()[0]
    assert got == (pytest.approx(want) if want is not None else None)


def test_pit_needs_two_quantiles():
    with pytest.raises(ValueError):
        metrics.pit_value("y", {0.5: "b"})


def test_mape_of_zero_actual(spark):
    df = spark.createDataFrame([(0.0, 1.0)], "y double, f double")
    assert metrics.point_errors(df, [], "y", "f").first().mape == pytest.approx(1 / metrics.EPS)


def _folds(spark, train_end, last):
    df = spark.createDataFrame([("a", train_end, last)], "series_id string, e string, l string").select(
        "series_id", F.col("e").cast("timestamp_ntz").alias("train_end"), F.col("l").cast("timestamp_ntz").alias("last_ts")
    )
    return [(r.fold_train_end, r.test_start, r.test_end) for r in split.fold_table(df, ["series_id"]).orderBy("fold").collect()]


def test_folds_on_and_off_the_anchor(spark):
    on = _folds(spark, "2024-01-10 22:00:00", "2024-01-26 00:00:00")
    assert on[0] == (ts("2024-01-10T22:00:00"), ts("2024-01-10T23:00:00"), ts("2024-01-17T22:00:00"))
    assert len(on) == 2 and on[1][0] == ts("2024-01-17T22:00:00")
    off = _folds(spark, "2024-01-09 13:00:00", "2024-01-26 00:00:00")
    assert off == on
    short = _folds(spark, "2024-01-10 22:00:00", "2024-01-12 22:00:00")
    assert short == [(ts("2024-01-10T22:00:00"), ts("2024-01-10T23:00:00"), ts("2024-01-12T22:00:00"))]
    assert _folds(spark, "2024-01-09 13:00:00", "2024-01-12 22:00:00") == []


def test_sliding_folds(spark):
    df = spark.range(0, 400).select(F.lit("a").alias("series_id"), tm.from_epoch(F.lit(1704924000).cast("long") - 200 * 3600 + F.col("id") * 3600).alias("ts"))
    folds = split.fold_table(df.groupBy("series_id").agg(tm.ts_lit("2024-01-10 22:00:00").alias("train_end"), F.max("ts").alias("last_ts")), ["series_id"])
    out = split.assign_folds(df, folds, ["series_id"], "ts", "sliding", 100)
    counts = {(r.fold, r.role): r["count"] for r in out.groupBy("fold", "role").count().collect()}
    assert counts[(0, "train")] == 100 and counts[(0, "test")] == 168


def test_append_dedupe_and_keep_last(spark):
    old = spark.createDataFrame([(1, "old")], "k int, v string")
    new = spark.createDataFrame([(1, "new"), (2, "new")], "k int, v string")
    assert sorted(align.append_dedupe(old, new, ["k"]).collect()) == [(1, "old"), (2, "new")]
    assert sorted(align.append_dedupe(old, new, ["k"], prefer="new").collect()) == [(1, "new"), (2, "new")]


def test_missing_file_and_wrong_count(spark):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        files.read_target_csv(spark, "/nonexistent", files.target_schema("t", "v"), "t", "v").collect()
    with pytest.raises(ValueError, match="exactly 4"):
        files.read_covariates(spark, ["a"], [], "t")


def test_semicolon_export(spark, tmp_path):
    (tmp_path / "x.csv").write_text("Date;Time;Measure value\n01.02.2024;'01:00';12.5\n01.02.2024;'24:00';-\nprovided by;;\n")
    got = files.read_delimited(spark, str(tmp_path / "x.csv")).collect()
    assert [(r.date, r.time, r.value) for r in got] == [("01.02.2024", "01:00", 12.5), ("01.02.2024", "24:00", None)]


def test_epoch_series(spark):
    df = spark.createDataFrame([('{"series":[[1704070800123,1.5],[1704074400999,null]]}',)], "p string")
    got = landed.parse_epoch_series(df, "p").collect()
    assert [(r.ts, r.value) for r in got] == [(ts("2024-01-01T01:00:00"), 1.5), (ts("2024-01-01T02:00:00"), None)]


def test_store_builds_once(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    for _ in range(2):
        assert store.feature_store(spark, str(tmp_path), {"lags": [1]}, build).count() == 3
    assert len(calls) == 1
    store.feature_store(spark, str(tmp_path), {"lags": [2]}, build)
    assert len(calls) == 2
