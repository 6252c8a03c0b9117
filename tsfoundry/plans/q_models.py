"""Forecast models, backtests, tuning and importances."""

from __future__ import annotations

from pyspark.sql import functions as F

from tsfoundry.functions import time as tm
from tsfoundry.operators import forecast, metrics, run, split, tune
from tsfoundry.operators.features import add_calendar, add_lags
from tsfoundry.operators.models.linear_quantile import LinearQuantile
from tsfoundry.operators.models.naive import quantile_column, seasonal_quantiles
from tsfoundry.operators.models.quantile_gbt import QuantileGBT
from tsfoundry.plans.panels import DAILY, DAILY_EXOG, HOURLY, KEY, daily_exog, hourly
from tsfoundry.plans.q_metrics import COLS, HI, LO, MED, QS
from tsfoundry.plans.q_scalars import _FOLDS, hourly_folds
from tsfoundry.plans.registry import query, rnd

FEATURES = ["lag_24", "lag_168", "hour_sin", "hour_cos"]
#: Hours of a forecast, and rounds without a better loss on the validation tail before boosting stops.
FORECAST_HOURS = 73
PATIENCE = 7


def features(spark, sf):
    lagged = add_lags(hourly(spark, sf), KEY, "idx", "y", [24, 168])
    return add_calendar(lagged, "ts", ["hour", "weekday"], fourier=True).filter(F.col("lag_168").isNotNull())


def cut_of(df):
    """The last Wednesday 22:00 with a whole forecast after it."""
    latest = (df.agg(F.max(tm.epoch("ts"))).first()[0] or 0) - FORECAST_HOURS * tm.HOUR
    # 1970-01-01 was a Thursday: Monday-based week offset of an epoch second
    past = (latest + 3 * tm.DAY - (tm.WED * tm.DAY + 22 * tm.HOUR)) % tm.WEEK
    return tm.from_epoch(F.lit(latest - past))


def train_test(spark, sf):
    df = features(spark, sf)
    cut = cut_of(df)
    return df.filter(F.col("ts") <= cut), df.filter(F.col("ts") > cut)


def fit_valid(train):
    """The training rows without and with the last fifth of their time, on which boosting is stopped."""
    first, last = train.agg(F.min(tm.epoch("ts")), F.max(tm.epoch("ts"))).first()
    edge = tm.from_epoch(F.lit((last or 0) - ((last or 0) - (first or 0)) // 5))
    return train.filter(F.col("ts") <= edge), train.filter(F.col("ts") > edge)


@query("rolling_cv_run", sql=_FOLDS + f""",
s AS (SELECT *, isodow(ts) AS wd, hour(ts) AS h FROM hourly),
f AS (SELECT series_id, ts, y, {", ".join(f"CASE WHEN count(*) OVER w = 1 THEN quantile_cont(y, {q}) OVER w END AS {c}" for q, c in COLS.items())}
 FROM s WINDOW w AS (PARTITION BY series_id, wd, h ORDER BY ts ROWS BETWEEN 1 PRECEDING AND 1 PRECEDING))
SELECT f.series_id, fold, count(*) AS n, round(avg(abs({MED} - y)), 7) + 0.0 AS mae FROM f JOIN fo ON fo.series_id = f.series_id
WHERE ts BETWEEN test_start AND test_end AND {MED} IS NOT NULL GROUP BY 1, 2""")
def rolling_cv_run(spark, sf):
    """Rolling-origin backtest of the seasonal baseline; folds are a column."""
    panel = hourly(spark, sf)
    scored = seasonal_quantiles(panel.withColumns({"wd": F.weekday("ts"), "h": F.hour("ts")}), KEY, ["wd", "h"], "idx", "y", 1, QS)
    tested = split.test_fold(scored, hourly_folds(panel), KEY, "ts").filter(F.col(MED).isNotNull())
    out = metrics.point_errors(tested, [*KEY, "fold"], "y", MED)
    counts = tested.groupBy(*KEY, "fold").agg(F.count(F.lit(1)).alias("n"))
    return out.join(counts, [*KEY, "fold"]).select("series_id", "fold", "n", rnd("mae", 7).alias("mae"))


@query("linear_quantile_regression")
def linear_quantile_regression(spark, sf):
    """Pinball loss per quantile on train and test, next to the constant forecast."""
    train, test = train_test(spark, sf)
    model = LinearQuantile(FEATURES, quantiles=QS).fit(train)
    both = train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
    scored = model.transform(both)
    terms = [F.avg(metrics.pinball_term(F.lit(q), "y", c)).alias(c) for q, c in COLS.items()]
    return metrics.to_long(scored.groupBy("part").agg(*terms), ["part"], COLS, yhat="pinball")


@query("quantile_gbt")
def quantile_gbt(spark, sf):
    train, test = train_test(spark, sf)
    cols = ["lag_24", "lag_168", "hour", "weekday"]
    model = QuantileGBT(cols, quantiles=(0.25, 0.5, 0.75), patience=PATIENCE, row_key=["series_id", "idx"]).fit(*fit_valid(train))
    scored = model.transform(test)
    names = {q: quantile_column(q) for q in model.quantiles}
    terms = [F.avg(metrics.pinball_term(F.lit(q), "y", c)).alias(c) for q, c in names.items()]
    return metrics.to_long(scored.groupBy("series_id").agg(*terms), KEY, names, yhat="pinball")


@query("loss_curve")
def loss_curve(spark, sf):
    train, _ = train_test(spark, sf)
    cols = ["lag_24", "lag_168", "hour", "weekday"]
    model = QuantileGBT(
        cols, quantiles=(0.5,), patience=PATIENCE, bagging_fraction=0.8, row_key=["series_id", "idx"]
    ).fit(*fit_valid(train))
    return tune.loss_curve(spark, "quantile_gbt", model.curve)


_RULE = "5.0 + 0.5 * {a} + 0.3 * lag_168"


@query("recursive_forecast", sql=f"""WITH {HOURLY},
l AS (SELECT series_id, ts, y, lag(y, 24) OVER w AS lag_24, lag(y, 168) OVER w AS lag_168 FROM hourly WINDOW w AS (PARTITION BY series_id ORDER BY ts)),
f AS (SELECT * FROM l WHERE lag_168 IS NOT NULL),
a AS (SELECT series_id, min(ts) AS anchor FROM f WHERE isodow(ts) = 3 AND hour(ts) >= 18 GROUP BY 1),
r AS (SELECT f.*, CAST((epoch(ts) - epoch(date_trunc('week', ts) + INTERVAL 71 HOUR)) / 3600 AS INTEGER) AS o FROM f JOIN a ON a.series_id = f.series_id WHERE ts >= anchor),
p0 AS (SELECT series_id, ts, {_RULE.format(a="lag_24")} AS p FROM r WHERE o >= 0 AND o < 24),
p1 AS (SELECT r.series_id, r.ts, {_RULE.format(a="q.p")} AS p FROM r JOIN p0 q ON q.series_id = r.series_id AND q.ts = r.ts - INTERVAL 24 HOUR WHERE o >= 24 AND o < 48),
p2 AS (SELECT r.series_id, r.ts, {_RULE.format(a="q.p")} AS p FROM r JOIN p1 q ON q.series_id = r.series_id AND q.ts = r.ts - INTERVAL 24 HOUR WHERE o >= 48 AND o < 72),
p3 AS (SELECT r.series_id, r.ts, {_RULE.format(a="q.p")} AS p FROM r JOIN p2 q ON q.series_id = r.series_id AND q.ts = r.ts - INTERVAL 24 HOUR WHERE o = 72),
p AS (SELECT * FROM p0 UNION ALL SELECT * FROM p1 UNION ALL SELECT * FROM p2 UNION ALL SELECT * FROM p3)
SELECT r.series_id, r.ts, round(coalesce(g.p, lag_24), 8) + 0.0 AS lag_24, round(coalesce(p.p, y), 8) + 0.0 AS pred FROM r
LEFT JOIN p ON p.series_id = r.series_id AND p.ts = r.ts
LEFT JOIN p g ON g.series_id = r.series_id AND g.ts = r.ts - INTERVAL 24 HOUR AND r.o >= 24""")
def recursive_forecast(spark, sf):
    """Blocked recursion with a linear rule of known coefficients."""
    median = F.lit(5.0) + 0.5 * F.col("lag_24") + 0.3 * F.col("lag_168")
    out = forecast.recursive_forecast(features(spark, sf), KEY, "idx", "ts", "y", [24, 168], median)
    return out.select("series_id", "ts", rnd("lag_24", 8).alias("lag_24"), rnd("pred", 8).alias("pred"))


def _fitted_forecast(spark, sf):
    train, test = train_test(spark, sf)
    model = LinearQuantile(FEATURES, quantiles=QS).fit(train)
    filled = forecast.recursive_forecast(test, KEY, "idx", "ts", "y", [24, 168], model.expression(0.5))
    return model, train, filled


@query("other_quantiles")
def other_quantiles(spark, sf):
    model, _, filled = _fitted_forecast(spark, sf)
    expressions = {q: model.expression(q) for q in QS}
    return forecast.other_quantiles(filled, ["series_id", "ts", "y"], expressions, FEATURES)


@query("simple_split_run")
def simple_split_run(spark, sf):
    """Scale, fit, forecast recursively and evaluate one train/test split."""
    known = features(spark, sf)
    groups = {"time": {"columns": ["hour_sin", "hour_cos"], "method": "standard"}}
    model = LinearQuantile(FEATURES, quantiles=QS)
    _, inside = run.run_split(known, KEY, "idx", "ts", "y", FEATURES, [24, 168], model, cut_of(known), groups, tm.forecast_window("ts"))
    wide = metrics.to_wide(inside, ["series_id", "ts", "y"], COLS)
    point = metrics.point_errors(wide, KEY, "y", MED)
    cover = metrics.coverage(wide, KEY, "y", LO, HI)
    width = metrics.sharpness(wide, KEY, LO, HI)
    return point.join(cover, KEY).join(width, KEY)


@query("model_cv_run")
def model_cv_run(spark, sf):
    """Rolling-origin backtest of the linear model, one concurrent fit per fold; lags a forecast would not know are forecasts."""
    df = features(spark, sf)
    spans = df.agg(F.min("ts").alias("first"), F.max("ts").alias("last_ts")).withColumn(
        "train_end", tm.shift_ts("first", 48 * tm.HOUR)
    )
    folds = forecast.calendar_folds(split.fold_table(spans, [], window_hours=168))

    make = lambda: LinearQuantile(FEATURES, quantiles=(0.5,))
    out = run.run_rolling_cv(df, folds, KEY, "idx", "ts", "y", [24, 168], make, tm.forecast_window("ts"), out=MED)
    return metrics.point_errors(out, [*KEY, "fold"], "y", MED)


@query("tune_random")
def tune_random(spark, sf):
    df = features(spark, sf)
    trials = tune.tune(
        lambda p: LinearQuantile(FEATURES, alpha=p["alpha"], quantiles=(0.5,)),
        {"alpha": {"type": "float", "low": 0.0, "high": 1.0}}, df, KEY, "idx",
        n_trials=50, n_splits=2, test_size=FORECAST_HOURS, scored_rows=tm.forecast_window("ts"),
    )
    return tune.trial_summary(trials)


@query("gain_importance")
def gain_importance(spark, sf):
    train, valid = fit_valid(train_test(spark, sf)[0])
    cols = ["lag_24", "lag_168", "hour", "weekday"]
    return tune.gain_importance(
        lambda f, seed: QuantileGBT(f, quantiles=(0.5,), patience=PATIENCE, seed=seed, bagging_fraction=0.8, row_key=["series_id", "idx"]),
        train, cols, num_models=5, subset_fraction=0.5, mandatory=["hour", "weekday"], valid=valid,
    )


def _info(spark, sf):
    train, _ = train_test(spark, sf)
    model = LinearQuantile(FEATURES, quantiles=(0.25, 0.5, 0.75)).fit(train)
    return tune.training_info("quantile_regression", model, train, FEATURES, model.quantiles, params={"alpha": 0.0})


@query("training_info")
def training_info(spark, sf):
    return _info(spark, sf).withColumn("importances", F.to_json("importances"))


@query("training_summary")
def training_summary(spark, sf):
    return tune.training_summary(_info(spark, sf))


@query("permutation_importance")
def permutation_importance(spark, sf):
    train, test = train_test(spark, sf)
    model = LinearQuantile(FEATURES, quantiles=(0.5,)).fit(train)
    return tune.permutation_importance(model, test, KEY, "idx", FEATURES)


@query("forest_importance")
def forest_importance(spark, sf):
    return tune.forest_importance(daily_exog(spark, sf), "y", ["qty", "disc", "tax"], trees=100, depth=30)  # Spark's limit; the reference has none
