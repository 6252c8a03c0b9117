import numpy as np
import pytest
from pyspark.sql import functions as F

from tsfoundry.functions import time as tm
from tsfoundry.operators import forecast, tune
from tsfoundry.operators.features import add_lags, build_features, sequence_windows
from tsfoundry.operators.models import base
from tsfoundry.operators.models.linear_quantile import LinearQuantile
from tsfoundry.operators.models.naive import quantile_column
from tsfoundry.operators.models.quantile_gbt import QuantileGBT
from tsfoundry.operators.resample import index_ts
from tsfoundry.plans import q_models

K = ["series_id"]


def pin(y, f, q):
    e = y - f
    return np.maximum(q * e, (q - 1) * e).mean()


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(0)
    n = 400
    x, z = rng.uniform(0, 10, n), rng.normal(size=n)
    y = 3 + 2 * x + (0.5 + 0.3 * x) * rng.normal(size=n)
    rows = [("a", i, float(a), float(b), float(c)) for i, (a, b, c) in enumerate(zip(x, z, y))]
    return spark.createDataFrame(rows, "series_id string, idx long, x double, z double, y double"), x, z, y


def test_linear_quantiles_are_optimal(data):
    df, x, z, y = data
    qs = (0.1, 0.5, 0.9)
    m = LinearQuantile(["x", "z"], quantiles=qs, steps=30).fit(df)
    design = np.column_stack([np.ones(len(x)), x, z])
    rng = np.random.default_rng(1)
    for q in qs:
        loss = pin(y, design @ m.coef[q], q)
        assert loss == pytest.approx(m.loss[q], rel=1e-6)
        assert ((y < design @ m.coef[q]).mean()) == pytest.approx(q, abs=0.02)
        for _ in range(200):
            nearby = m.coef[q] + rng.normal(size=3) * [0.05, 0.01, 0.02]
            assert pin(y, design @ nearby, q) > loss - 1e-3 * loss


def test_penalty_shrinks_coefficients(data):
    df, *_ = data
    free = LinearQuantile(["x", "z"], quantiles=(0.5,), steps=15).fit(df)
    bound = LinearQuantile(["x", "z"], alpha=0.5, quantiles=(0.5,), steps=15).fit(df)
    heavy = LinearQuantile(["x", "z"], alpha=50.0, quantiles=(0.5,), steps=15).fit(df)
    assert abs(bound.coef[0.5][1]) < abs(free.coef[0.5][1])
    assert np.allclose(heavy.coef[0.5][1:], 0, atol=1e-9)


def test_gbt_loss_falls_and_importance_finds_the_driver(data):
    df, *_ = data
    m = QuantileGBT(["x", "z"], quantiles=(0.5,), rounds=4, depth=3, rate=0.5, checkpoint_every=2, row_key=["idx"]).fit(df)
    train = [loss for q, part, step, loss in m.curve if part == "train"]
    assert all(b <= a + 1e-12 for a, b in zip(train, train[1:]))
    assert m.importances(0.5)["x"] > m.importances(0.5)["z"]
    scored = m.transform(df).agg(F.avg(F.greatest(0.5 * (F.col("y") - F.col("pred_0_5")), -0.5 * (F.col("y") - F.col("pred_0_5"))))).first()[0]
    assert scored == pytest.approx(train[-1], rel=1e-9)


def test_permutation_importance(data):
    df, *_ = data
    m = LinearQuantile(["x", "z"], quantiles=(0.5,), steps=8).fit(df)
    got = {r.feature: r.importance for r in tune.permutation_importance(m, df, K, "idx", ["x", "z"]).collect()}
    assert got["x"] > 1.0 and abs(got["z"]) < 0.2


def test_blocked_recursion_equals_row_by_row(spark):
    rng = np.random.default_rng(3)
    n, start = 24 * 16, 1704067200 // 3600  # Monday 2024-01-01
    y = 50 + 10 * np.sin(np.arange(n) / 24) + rng.normal(size=n)
    rows = [("a", start + i, float(v)) for i, v in enumerate(y)]
    df = spark.createDataFrame(rows, "series_id string, idx long, y double").withColumn("ts", index_ts("idx", 3600))
    lags = [5, 24, 168]
    feats = add_lags(df, K, "idx", "y", lags).filter(F.col("lag_168").isNotNull())
    expr = F.lit(1.0) + 0.5 * F.col("lag_5") + 0.3 * F.col("lag_24") + 0.1 * F.col("lag_168")
    got = {r.idx - start: r.pred for r in forecast.recursive_forecast(feats, K, "idx", "ts", "y", lags, expr).collect()}

    anchor = next(i for i in range(168, n) if (i // 24) % 7 == 2 and i % 24 >= 18)
    pred = y.copy()
    for i in range(anchor, n):
        day, hour = (i // 24) % 7, i % 24
        opening = (i // 24 - day + 2) * 24 + 23
        inside = (day == 2 and hour == 23) or day in (3, 4, 5)
        if inside:
            vals = [pred[i - k] if i - k >= opening else y[i - k] for k in lags]
            pred[i] = 1 + 0.5 * vals[0] + 0.3 * vals[1] + 0.1 * vals[2]
    assert set(got) == set(range(anchor, n))
    assert all(got[i] == pytest.approx(pred[i], rel=1e-12) for i in got)


def test_other_quantiles_reject_nulls(spark):
    df = spark.createDataFrame([("a", 1.0, None)], "series_id string, pred double, f double")
    out = forecast.other_quantiles(df, ["series_id"], {0.5: F.col("f"), 0.9: F.col("f")}, ["f"])
    with pytest.raises(Exception, match="null feature"):
        out.collect()


def test_sequence_windows_count(series):
    df = series({"y": range(30)})
    rows = sequence_windows(df, K, "idx", ["y"], "y", 8, 3).orderBy("idx").collect()
    assert len(rows) == 30 - 8 - 3 + 1
    assert rows[0].idx == 7 and [v[0] for v in rows[0].x] == list(range(8)) and rows[0].targets == [8, 9, 10]


def test_registries(series):
    assert {"quantile_regression", "quantile_gbt"} <= set(base.REGISTRY)
    with pytest.raises(ValueError):
        base.make("nothing")
    with pytest.raises(ValueError):
        build_features(series({"y": [1]}), [("nothing", {})])


def test_sampler_is_seeded():
    import random

    space = {"a": {"type": "int", "low": 1, "high": 9}, "b": {"type": "float", "low": 1e-3, "high": 1.0, "log": True},
             "c": {"type": "categorical", "choices": ["x", "y"]}}
    one, two = [tune.sample_space(space, random.Random(4)) for _ in range(2)]
    assert one == two and 1 <= one["a"] <= 9 and 1e-3 <= one["b"] <= 1.0


def test_time_series_split_gap(series):
    from tsfoundry.operators.split import time_series_split

    out = time_series_split(series({"y": range(20)}), K, "idx", 2, 3, gap=2).collect()
    fold0 = [(r.idx, r.part) for r in out if r.fold == 0]
    assert sorted(i for i, p in fold0 if p == "test") == [14, 15, 16]
    assert max(i for i, p in fold0 if p == "train") == 11


def test_weekly_window_predicates(spark):
    hours = spark.range(0, 168).select(tm.from_epoch(F.lit(1704067200).cast("long") + F.col("id") * 3600).alias("ts"))
    assert hours.filter(tm.forecast_window("ts")).count() == 73
    assert hours.filter(tm.forecast_window("ts", 20)).count() == 70
    assert hours.filter(tm.target_times("ts")).count() == 6
    assert quantile_column(0.025) == "pred_0_025"


def test_registered_models_are_fitted_whole(spark, monkeypatch):
    rows = [("a", i, float(i % 24)) for i in range(24 * 28)]
    panel = spark.createDataFrame(rows, "series_id string, idx long, y double").withColumn("ts", index_ts(F.col("idx") + 473_352, 3600))  # from 2024-01-01
    monkeypatch.setattr(q_models, "hourly", lambda spark, sf: panel)
    train, test = q_models.train_test(spark, "")
    assert str(train.agg(F.max("ts")).first()[0]) == "2024-01-24 22:00:00" and test.count() == 97
    fitted = {}

    class Done(Exception):
        pass

    class Spy(QuantileGBT):
        def fit(self, df, valid=None):
            fitted[name] = (self.rounds, self.depth, self.rate, bool(self.patience), valid is not None and df.count() > valid.count() > 0)
            raise Done

    def spy(*args, **kwargs):
        fitted[name] = kwargs
        raise Done

    monkeypatch.setattr(q_models, "QuantileGBT", Spy)
    for name in ("quantile_gbt", "loss_curve", "gain_importance"):
        with pytest.raises(Done):
            getattr(q_models, name)(spark, "")
        default = QuantileGBT([])
        assert fitted[name] == (default.rounds, default.depth, default.rate, True, True), name
    monkeypatch.setattr(q_models, "daily_exog", lambda spark, sf: panel)
    for name, called, wanted in (("tune_random", "tune", {"n_trials": 50}), ("gain_importance", "gain_importance", {"num_models": 5}), ("forest_importance", "forest_importance", {"depth": 30})):
        monkeypatch.setattr(tune, called, spy)
        with pytest.raises(Done):
            getattr(q_models, name)(spark, "")
        assert fitted[name].items() >= wanted.items()


def test_models_fitted_together_equal_single_fits(spark, data, monkeypatch):
    """Every model takes the steps it would take alone, in as many passes as the slowest needs."""
    from tsfoundry.operators.models import linear_quantile

    df, *_ = data
    members = [F.lit(True), F.col("idx") < 200, (F.col("idx") >= 100) & (F.col("idx") < 300)]
    make = lambda a, qs: LinearQuantile(["x", "z"], alpha=a, quantiles=qs)
    asked = [(0.0, (0.5,), 0), (0.3, (0.1, 0.9), 1), (50.0, (0.5,), 1), (0.02, (0.5,), 2), (0.0, (0.25,), 2)]
    passes = []
    plain = linear_quantile.partition_sums
    monkeypatch.setattr(linear_quantile, "partition_sums", lambda *a: passes.append(1) or plain(*a))
    alone, longest = [], 0
    for a, qs, g in asked:
        passes.clear()
        alone.append(make(a, qs).fit(df.filter(members[g])))
        longest = max(longest, len(passes))
    passes.clear()
    together = [make(a, qs) for a, qs, _ in asked]
    LinearQuantile.fit_together(together, [g for *_, g in asked], members, df)
    assert len(passes) == longest
    for one, other in zip(alone, together):
        for q in one.quantiles:
            assert np.allclose(one.coef[q], other.coef[q], rtol=1e-6, atol=1e-9) and one.loss[q] == pytest.approx(other.loss[q], rel=1e-9)


def test_tune_losses_equal_single_fits(spark):
    rng = np.random.default_rng(3)
    rows = [(s, i, float(x), float(2 * x + rng.normal())) for s, n in (("a", 90), ("b", 61)) for i, x in enumerate(rng.normal(size=n))]
    df = spark.createDataFrame(rows, "series_id string, idx long, x double, y double")
    make = lambda p: LinearQuantile(["x"], alpha=p["alpha"], quantiles=(0.5,))
    space = {"alpha": {"type": "float", "low": 0.0, "high": 2.0}}
    got = {(r.trial, r.fold): (r.params, r.loss) for r in tune.tune(make, space, df, K, "idx", 2, 2, 10, scored_rows=F.col("idx") % 3 != 0).collect()}
    assert len(got) == 4
    import json

    from tsfoundry.operators.split import TESTS_IN, TRAINS_FROM, fold_rows

    marked = fold_rows(df, K, "idx", 2, 10)
    spans = {(r.series_id, r.f): (r.n, r.last) for r in marked.filter(f"{TESTS_IN} IS NOT NULL").groupBy("series_id", F.col(TESTS_IN).alias("f")).agg(F.count("*").alias("n"), F.max("idx").alias("last")).collect()}
    assert spans == {("a", 0): (10, 79), ("a", 1): (10, 89), ("b", 0): (10, 50), ("b", 1): (10, 60)}
    for (trial, fold), (params, loss) in got.items():
        ends = {"a": 90 - (2 - fold) * 10, "b": 61 - (2 - fold) * 10}  # an odd number of rows, so that a median is one value
        train = marked.filter(F.col(TRAINS_FROM) <= fold)
        assert {r.series_id: r.m + 1 for r in train.groupBy("series_id").agg(F.max("idx").alias("m")).collect()} == ends
        model = make(json.loads(params)).fit(train)
        test = [(x, y) for s, i, x, y in rows if ends[s] <= i < ends[s] + 10 and i % 3]
        b = model.coef[0.5]
        want = np.mean([0.5 * abs(y - b[0] - b[1] * x) for x, y in test])
        assert loss == pytest.approx(want, rel=1e-5)


def test_fit_leaves_a_shared_cache_alone(spark, data):
    df = data[0].filter("idx < 300").persist()
    df.count()
    LinearQuantile(["x"], quantiles=(0.5,), steps=2).fit(df)
    assert "InMemoryTableScan" in df.groupBy("series_id").count()._jdf.queryExecution().executedPlan().toString()
    df.unpersist()


def test_saved_model_scores_alike(spark, data, tmp_path):
    df, *_ = data
    model = LinearQuantile(["x", "z"], alpha=0.01, quantiles=(0.1, 0.5), steps=40).fit(df)
    base.save(model, spark, f"{tmp_path}/m")
    again = base.load(spark, f"{tmp_path}/m")
    assert again.state() == model.state() and again.transform(df).collect() == model.transform(df).collect()
    spark.createDataFrame([("nobody", "{}")], "model string, state string").write.parquet(f"{tmp_path}/n")
    with pytest.raises(ValueError):
        base.load(spark, f"{tmp_path}/n")
