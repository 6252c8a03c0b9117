"""One bad series gives null for itself and leaves the others' answers as they are."""

import random

import pytest
from pyspark.errors import PySparkException

from tsfoundry.functions.scalar import duration_seconds
from tsfoundry.operators import hypothesis as hy
from tsfoundry.operators import profile
from tsfoundry.operators.models.linear_quantile import LinearQuantile
from tsfoundry.operators.quantiles import exact_quantiles
from tsfoundry.operators.spectral import stl_decompose


@pytest.fixture(scope="module")
def panels(spark):
    good = [("a", i, float((i * 37) % 23) + i / 50) for i in range(60)]
    bad = [("flat", i, 5.0) for i in range(30)] + [("two", 0, 1.0), ("two", 1, 2.0)]
    schema = "series_id string, idx long, y double"
    return spark.createDataFrame(good, schema), spark.createDataFrame(good + bad, schema)


@pytest.mark.parametrize("test", [
    lambda d: hy.dagostino_k2(d, ["series_id"], "y"), lambda d: hy.anderson_darling(d, ["series_id"], "y"),
    lambda d: hy.shapiro_wilk(d, ["series_id"], "y"), lambda d: hy.goldfeld_quandt(d, ["series_id"], "idx", "y"),
], ids=["dagostino", "anderson", "shapiro", "goldfeld"])
def test_bad_series(panels, test):
    alone, mixed = panels
    want = test(alone).first().statistic
    got = {r.series_id: r.statistic for r in test(mixed).collect()}
    assert got["a"] == pytest.approx(want, rel=1e-12)


def test_kpss_of_a_constant(panels):
    rows = {r.series_id: r for r in hy.kpss(panels[1].filter("series_id <> 'two'"), ["series_id"], "idx", "y").collect()}
    assert rows["a"].statistic > 0 and rows["flat"].p_value != rows["flat"].p_value or rows["flat"].p_value is None


def test_equal_forecasts_and_perfect_correlation(spark):
    df = spark.createDataFrame([("s", float(i), float(i), float(i)) for i in range(9)], "s string, y double, a double, b double")
    assert hy.diebold_mariano(df, ["s"], "y", "a", "b").first().statistic is None
    hy.f_regression(df, ["s"], "y", ["a"]).collect()


def test_histogram_and_density(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (None,), (None,)], "y double")
    assert {r.bin: r.n for r in profile.histogram(df, "y", 4).collect()} == {0: 1, 3: 1}
    flat = spark.createDataFrame([(2.0,)] * 3, "y double")
    assert [tuple(r) for r in profile.histogram(flat, "y", 4).collect()] == [(0, 3)]
    profile.kde(flat, "y", 5).collect()


def test_long_durations(spark):
    df = spark.createDataFrame([("1234567890H",)], "t string")
    assert df.select(duration_seconds("t").alias("s")).first().s == 1234567890 * 3600
    with pytest.raises(PySparkException):
        spark.createDataFrame([("9" * 30 + "H",)], "t string").select(duration_seconds("t")).collect()


def test_regressions_far_from_zero(spark):
    r = random.Random(3)
    rows = [(i, float(r.random()), r.random()) for i in range(400)]
    near = spark.createDataFrame([("s", i, x, 2 * x + e / 5) for i, x, e in rows], "s string, i long, x double, y double")
    far = near.withColumn("x", near.x + 1e8)
    for test in (lambda d: hy.chow(d, ["s"], "i", "y", ["x"]), lambda d: hy.anova_nested(d, ["s"], "y", [], ["x"])):
        assert test(far).first().statistic == pytest.approx(test(near).first().statistic, rel=1e-4)
    a, b = ({x.term: x for x in hy.ols_summary(d, ["s"], "y", ["x"]).collect()} for d in (near, far))
    assert b["x"].coef == pytest.approx(a["x"].coef, rel=1e-6) and b["x"].se == pytest.approx(a["x"].se, rel=1e-6)
    assert b["const"].coef == pytest.approx(a["const"].coef - 1e8 * a["x"].coef, rel=1e-6) and b["x"].r2 == pytest.approx(a["x"].r2)
    models = [LinearQuantile(["x"], quantiles=(0.5,)).fit(d) for d in (near, far)]
    assert models[1].loss[0.5] == pytest.approx(models[0].loss[0.5], rel=1e-4)


def test_tests_of_short_and_constant_series(panels):
    alone, mixed = panels
    for test in (
        lambda d: hy.adf(d, ["series_id"], "idx", "y"), lambda d: hy.arch_lm(d, ["series_id"], "idx", "y", 2),
        lambda d: hy.chow(d.withColumn("x", d.idx % 7), ["series_id"], "idx", "y", ["x"]),
        lambda d: hy.granger(d.withColumn("x", d.idx % 7), ["series_id"], "idx", "y", ["x"], 2),
    ):
        got = {r.series_id: r for r in test(mixed).collect()}
        assert got["two"].statistic is None and got["two"].p_value is None
        if test(alone).columns.count("lags") == 0:  # the lag order follows the longest series' samples
            assert got["a"].statistic == pytest.approx(test(alone).first().statistic, rel=1e-9)
        assert got["a"].statistic is not None


def test_short_series_have_no_decomposition(panels):
    rows = stl_decompose(panels[1], ["series_id"], "idx", "y", period=12).collect()
    assert all((r.trend is None) == (r.series_id == "two") for r in rows) and len(rows) == 92


def test_quantiles_of_odd_numbers(spark):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([(v,) for v in (nan, None, -inf, 1.0, 2.0, 3.0, inf)], "v double")
    assert tuple(exact_quantiles(df, [], "v", [0.0, 0.5, 1.0]).first()) == (-inf, 2.0, inf)


def test_entry_without_training_data_operators(tmp_path):
    """The registry works where the folder is gone, and where it is an empty one."""
    import os
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    for empty in (False, True):
        copy = tmp_path / str(empty)
        shutil.copytree(root / "tsfoundry", copy / "tsfoundry", ignore=shutil.ignore_patterns("llm", "__pycache__"))
        shutil.copy(root / "__spark_entry__.py", copy)
        if empty:
            (copy / "tsfoundry" / "llm" / "__pycache__").mkdir(parents=True)
        code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert len(q) > 150 and set(o) <= set(q) and 'pipeline' not in q"
        subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, env={**os.environ, "PYTHONPATH": str(copy)})
