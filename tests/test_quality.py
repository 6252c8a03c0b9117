from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tsfoundry.functions.time import ts_lit
from tsfoundry.operators import quality, scale
from tsfoundry.operators.models import base
from tsfoundry.sources.refresh import refresh

K = ["series_id"]


def test_null_reports(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None), (None, 3.0), (4.0, 1.0)], "a double, b double")
    got = {r.column: (r.nulls, r.percent) for r in quality.missing_report(df, ["a", "b"]).collect()}
    assert got == {"a": (1, 25.0), "b": (2, 50.0)}
    # a column at exactly one half stays
    assert quality.drop_sparse_columns(df, ["a", "b"]).columns == ["a", "b"]
    assert quality.drop_sparse_columns(df, ["a", "b"], 0.4).columns == ["a"]
    with pytest.raises(ValueError, match="'a', 'b'"):
        quality.assert_no_nulls(df, ["a", "b"])
    filled = quality.handle_missing(df, "mean").collect()
    assert filled[2].a == pytest.approx(7 / 3) and filled[0].b == 2.0
    assert quality.handle_missing(df, "drop").count() == 1
    with pytest.raises(ValueError):
        quality.handle_missing(df, "guess")


def test_outliers_and_their_removal(series):
    values = [0.0] * 10 + [1.0] * 10 + [50.0]
    df = series({"y": values})
    for method in ("iqr", "zscore"):
        assert [r.y for r in quality.outliers(df, K, "y", method).collect()] == [50.0]
        assert quality.remove_outliers(df, K, "y", method).count() == 20
    with pytest.raises(ValueError):
        quality.outliers(df, K, "y", "guess")


def test_constant_series(series):
    df = series({"y": [5.0] * 6})
    assert quality.outliers(df, K, "y", "zscore").count() == 0
    assert quality.remove_outliers(df, K, "y", "zscore").count() == 6
    for method in ("standard", "minmax", "robust"):
        stats = scale.fit_scaler(df, ["y"], method)
        assert {r.y for r in scale.apply_scaler(df, stats, ["y"]).collect()} == {0.0}


def test_coverage_error(spark):
    df = spark.createDataFrame([("w", "2024-01-05")], "source string, t string").select("source", F.col("t").cast("timestamp_ntz").alias("ts"))
    with pytest.raises(ValueError, match="too late"):
        quality.assert_coverage(df, "source", "ts", ts_lit("2024-01-01"))
    assert quality.assert_coverage(df, "source", "ts", ts_lit("2024-02-01")) is df


def test_refresh(spark):
    def frame(rows):
        return spark.createDataFrame(rows, "t string, x double").select(F.col("t").cast("timestamp_ntz").alias("ts"), "x")

    old = frame([("2024-01-01", 1.0)])
    one, two = frame([("2024-01-01", 5.0), ("2024-01-02", 2.0), ("2024-01-03", 3.0)]), frame([("2024-01-02", 4.0)])
    history, forecast = refresh(old, [one, two], ["ts"], "ts", ts_lit("2024-01-03"))
    assert sorted((r.ts.day, r.x) for r in history.collect()) == [(1, 1.0), (2, 3.0)]
    assert [(r.ts, r.x) for r in forecast.collect()] == [(datetime(2024, 1, 3), 3.0)]


def test_baseline_is_registered():
    from tsfoundry.operators.models import naive  # noqa: F401

    model = base.make("baseline", keys=K, season=["wd"], last_t=2)
    assert model.last_t == 2
