"""Forecast evaluation, the seasonal baseline and aggregate reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from tsfoundry.functions import time as tm
from tsfoundry.functions.time import HOUR, floor_ts
from tsfoundry.operators import metrics, profile, quality
from tsfoundry.operators.chunking import row_numbers
from tsfoundry.operators.features import add_lags
from tsfoundry.operators.models.naive import SeasonalQuantile, quantile_column, seasonal_quantiles
from tsfoundry.plans.panels import DAILY, DAILY_EXOG, HOURLY, KEY, daily, daily_exog, hourly, table
from tsfoundry.plans.q_filters import _window_sql
from tsfoundry.plans.registry import query, rnd

QS = (0.025, 0.25, 0.5, 0.75, 0.975)
COLS = {q: quantile_column(q) for q in QS}
LO, MED, HI = COLS[0.025], COLS[0.5], COLS[0.975]


def _forecast_sql(name: str, last_t: int) -> str:
    cols = ", ".join(
        f"CASE WHEN count(*) OVER f = {last_t} THEN quantile_cont(y, {q}) OVER f END AS {c}" for q, c in COLS.items()
    )
    return f"""{name} AS (SELECT * FROM (SELECT series_id, ts, y, {cols} FROM (SELECT *, isodow(ts) AS wd FROM daily)
 WINDOW f AS (PARTITION BY series_id, wd ORDER BY ts ROWS BETWEEN {last_t} PRECEDING AND 1 PRECEDING)) WHERE {MED} IS NOT NULL)"""


def _long_sql(name: str, src: str) -> str:
    parts = " UNION ALL ".join(f"SELECT series_id, ts, y, CAST({q} AS DOUBLE) AS q, {c} AS yhat FROM {src}" for q, c in COLS.items())
    return f"{name} AS ({parts})"


#: Wide daily forecasts ``fc`` (25 weeks) and ``base`` (8 weeks), long as ``fl`` and ``bl``.
FC = f"WITH {DAILY}, {_forecast_sql('fc', 25)}, {_long_sql('fl', 'fc')}"
FCB = f"{FC}, {_forecast_sql('base', 8)}, {_long_sql('bl', 'base')}"


def forecast(spark, sf, last_t=25):
    d = daily(spark, sf).withColumn("wd", F.weekday("ts"))
    out = seasonal_quantiles(d, KEY, ["wd"], "idx", "y", last_t, QS)
    return out.filter(F.col(MED).isNotNull()).drop("wd")


def long_forecast(spark, sf, last_t=25):
    return metrics.to_long(forecast(spark, sf, last_t), ["series_id", "ts", "idx", "y"], COLS)


@query("entry_slice", sql=f"""WITH {HOURLY}, s AS (SELECT *, isodow(ts) AS wd, hour(ts) AS h FROM hourly),
f AS (SELECT series_id, ts, y, {", ".join(f"CASE WHEN count(*) OVER w = 2 THEN quantile_cont(y, {q}) OVER w END AS {c}" for q, c in COLS.items())}
 FROM s WINDOW w AS (PARTITION BY series_id, wd, h ORDER BY ts ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING)),
k AS (SELECT * FROM f WHERE {MED} IS NOT NULL AND {_window_sql(23)}), {_long_sql("l", "k")},
c AS (SELECT series_id, avg(CASE WHEN y BETWEEN {LO} AND {HI} THEN 1.0 ELSE 0.0 END) AS cov FROM k GROUP BY 1)
SELECT l.series_id, q, round(avg(greatest(q * (y - yhat), (q - 1) * (y - yhat))), 8) + 0.0 AS pinball, round(any_value(cov), 8) + 0.0 AS coverage
FROM l JOIN c ON c.series_id = l.series_id GROUP BY 1, 2""")
def entry_slice(spark, sf):
    """Hourly resample, seasonal quantiles, forecast window, pinball and coverage."""
    panel = hourly(spark, sf).withColumns({"wd": F.weekday("ts"), "h": F.hour("ts")})
    scored = seasonal_quantiles(panel, KEY, ["wd", "h"], "idx", "y", 2, QS)
    inside = scored.filter(F.col(MED).isNotNull() & tm.forecast_window("ts"))
    # pinball of every quantile and the coverage come from one aggregate
    terms = [F.avg(metrics.pinball_term(F.lit(q), "y", c)).alias(c) for q, c in COLS.items()]
    covered = F.avg(F.col("y").between(F.col(LO), F.col(HI)).cast("double")).alias("coverage")
    wide = inside.groupBy("series_id").agg(*terms, covered)
    long = metrics.to_long(wide, ["series_id", "coverage"], COLS, yhat="pinball")
    return long.select("series_id", "q", rnd("pinball", 8).alias("pinball"), rnd("coverage", 8).alias("coverage"))


@query("mae_rmse_mape", sql=FC + f"""
SELECT series_id, round(avg(abs({MED} - y)), 6) + 0.0 AS mae, round(sqrt(avg(pow({MED} - y, 2))), 6) + 0.0 AS rmse,
 round(log10(avg(abs({MED} - y) / greatest(abs(y), 2.220446049250313e-16))), 6) + 0.0 AS log10_mape FROM fc GROUP BY 1""")
def mae_rmse_mape(spark, sf):
    # near-zero actual values make the last error huge: it is compared by its order of magnitude
    out = metrics.point_errors(forecast(spark, sf), KEY, "y", MED)
    return out.select("series_id", rnd("mae").alias("mae"), rnd("rmse").alias("rmse"), rnd(F.log10("mape")).alias("log10_mape"))


@query("pinball_loss", sql=FC + """
SELECT series_id, q, round(avg(greatest(q * (y - yhat), (q - 1) * (y - yhat))), 6) + 0.0 AS pinball FROM fl GROUP BY 1, 2""")
def pinball_loss(spark, sf):
    return metrics.pinball(long_forecast(spark, sf), KEY).select("series_id", "q", rnd("pinball").alias("pinball"))


_JOIN = " FROM fl f JOIN bl b ON b.series_id = f.series_id AND b.ts = f.ts AND b.q = f.q"


def compared(spark, sf):
    """Both forecasts side by side, by series, time and quantile."""
    a = long_forecast(spark, sf, 25)
    b = long_forecast(spark, sf, 8).select("series_id", "idx", "q", F.col("yhat").alias("yhat_base"))
    return a.join(b, ["series_id", "idx", "q"])


@query("baseline_compare_join", sql=FCB + """
SELECT f.series_id, f.ts, f.q, round(f.yhat, 9) + 0.0 AS yhat, round(b.yhat, 9) + 0.0 AS yhat_base""" + _JOIN)
def baseline_compare_join(spark, sf):
    return compared(spark, sf).select("series_id", "ts", "q", rnd("yhat", 9).alias("yhat"), rnd("yhat_base", 9).alias("yhat_base"))


@query("d2_pinball", sql=FCB + f""", p AS (SELECT f.series_id, f.q, avg(greatest(f.q * (f.y - f.yhat), (f.q - 1) * (f.y - f.yhat))) AS a,
 avg(greatest(f.q * (f.y - b.yhat), (f.q - 1) * (f.y - b.yhat))) AS b{_JOIN} GROUP BY 1, 2)
SELECT series_id, q, round(1 - a / b, 8) + 0.0 AS d2 FROM p""")
def d2_pinball(spark, sf):
    return metrics.d2_pinball(compared(spark, sf), KEY).select("series_id", "q", rnd("d2", 8).alias("d2"))


@query("interval_coverage", sql=FC + f"""
SELECT series_id, round(avg(CASE WHEN y BETWEEN {LO} AND {HI} THEN 1.0 ELSE 0.0 END), 8) + 0.0 AS coverage, count(*) AS n FROM fc GROUP BY 1""")
def interval_coverage(spark, sf):
    out = metrics.coverage(forecast(spark, sf), KEY, "y", LO, HI)
    return out.select("series_id", rnd("coverage", 8).alias("coverage"), "n")


@query("sharpness", sql=FC + f" SELECT series_id, round(avg({HI} - {LO}), 6) + 0.0 AS sharpness FROM fc GROUP BY 1")
def sharpness(spark, sf):
    return metrics.sharpness(forecast(spark, sf), KEY, LO, HI).select("series_id", rnd("sharpness").alias("sharpness"))


def _pit_sql() -> str:
    segs = " ".join(
        f"WHEN y BETWEEN {COLS[a]} AND {COLS[b]} THEN CASE WHEN {COLS[b]} - {COLS[a]} < 1e-9 THEN 0.5 * ({a} + {b}) "
        f"ELSE {a} + (y - {COLS[a]}) / ({COLS[b]} - {COLS[a]}) * {round(b - a, 6)} END" for a, b in zip(QS, QS[1:])
    )
    return f"CASE WHEN y <= {LO} THEN 0.0 WHEN y >= {HI} THEN 1.0 {segs} END"


PIT = FC + f", pit AS (SELECT series_id, ts, CAST({_pit_sql()} AS DOUBLE) AS pit FROM fc)"


def pits(spark, sf):
    return forecast(spark, sf).withColumn("pit", metrics.pit_value("y", COLS))


@query("pit_values", sql=PIT + " SELECT series_id, ts, round(pit, 7) + 0.0 AS pit FROM pit")
def pit_values(spark, sf):
    return pits(spark, sf).select("series_id", "ts", rnd("pit", 7).alias("pit"))


@query("pit_histogram", sql=PIT + """, b AS (SELECT series_id, least(CAST(floor(pit * 5) AS INTEGER), 4) AS bin FROM pit),
g AS (SELECT DISTINCT series_id, unnest([0, 1, 2, 3, 4]) AS bin FROM b), t AS (SELECT series_id, count(*) AS n FROM b GROUP BY 1)
SELECT g.series_id, g.bin, count(b.bin) AS n, round(count(b.bin) / CAST(any_value(t.n) AS DOUBLE), 8) + 0.0 AS frequency
FROM g JOIN t ON t.series_id = g.series_id LEFT JOIN b ON b.series_id = g.series_id AND b.bin = g.bin GROUP BY 1, 2""")
def pit_histogram(spark, sf):
    out = metrics.pit_histogram(pits(spark, sf), KEY, "pit")
    return out.select("series_id", "bin", "n", rnd("frequency", 8).alias("frequency"))


@query("pit_ecdf", sql=PIT + """, r AS (SELECT series_id, round(pit, 7) + 0.0 AS pit FROM pit)
SELECT DISTINCT series_id, pit, round(cume_dist() OVER (PARTITION BY series_id ORDER BY pit), 8) + 0.0 AS ecdf FROM r""")
def pit_ecdf(spark, sf):
    rounded = pits(spark, sf).select("series_id", rnd("pit", 7).alias("pit"))
    return metrics.pit_ecdf(rounded, KEY, "pit").select("series_id", "pit", rnd("ecdf", 8).alias("ecdf"))


@query("naive_seasonal_forecast", sql=f"""WITH {HOURLY}, s AS (SELECT *, isodow(ts) AS wd, hour(ts) AS h FROM hourly)
SELECT series_id, ts, {", ".join(f"round(CASE WHEN {_window_sql(20)} THEN CASE WHEN count(*) OVER w = 3 THEN quantile_cont(y, {q}) OVER w END ELSE y END, 6) + 0.0 AS {c}" for q, c in COLS.items())}
FROM s WINDOW w AS (PARTITION BY series_id, wd, h ORDER BY ts ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)""")
def naive_seasonal_forecast(spark, sf):
    panel = hourly(spark, sf).withColumns({"wd": F.weekday("ts"), "h": F.hour("ts")})
    model = SeasonalQuantile(KEY, ["wd", "h"], 3, QS, tm.forecast_window("ts", 20))
    out = model.fit(panel).transform(panel)
    return out.select("series_id", "ts", *[rnd(c).alias(c) for c in COLS.values()])


@query("hour_weekday_pivot", sql=f"""WITH {HOURLY}, m AS (SELECT hour(ts) AS h, isodow(ts) AS d, avg(y) AS v FROM hourly WHERE isodow(ts) IN (4, 5, 6) GROUP BY 1, 2)
SELECT CAST(h AS INTEGER) AS hour, round(max(v) FILTER (d = 4), 7) + 0.0 AS thu, round(max(v) FILTER (d = 5), 7) + 0.0 AS fri, round(max(v) FILTER (d = 6), 7) + 0.0 AS sat,
 round(avg(v), 7) + 0.0 AS mean, round(quantile_cont(v, 0.25), 7) + 0.0 AS q25, round(quantile_cont(v, 0.75), 7) + 0.0 AS q75 FROM m GROUP BY 1""")
def hour_weekday_pivot(spark, sf):
    days = {tm.THU: "thu", tm.FRI: "fri", tm.SAT: "sat"}
    out = metrics.hour_weekday_pivot(hourly(spark, sf), "ts", "y", days, [0.25, 0.75])
    return out.select("hour", *[rnd(c, 7).alias(c) for c in ("thu", "fri", "sat", "mean")],
                      rnd(F.col("`q0.25`"), 7).alias("q25"), rnd(F.col("`q0.75`"), 7).alias("q75"))


@query("residual_outliers", sql=FC + f""", e AS (SELECT series_id, ts, {MED} - y AS e FROM fc), s AS (SELECT series_id, stddev_samp(e) AS s FROM e GROUP BY 1)
SELECT e.series_id, ts, round(e, 6) + 0.0 AS residual FROM e JOIN s ON s.series_id = e.series_id WHERE abs(e) > 3 * s ORDER BY 1, 2""")
def residual_outliers(spark, sf):
    errors = forecast(spark, sf).withColumn("residual", metrics.residual("y", MED))
    out = quality.residual_outliers(errors, KEY, "residual")
    return out.select("series_id", "ts", rnd("residual").alias("residual")).orderBy("series_id", "ts")


@query("mincer_zarnowitz", sql=FC + f"""
SELECT series_id, round(regr_intercept(y, {MED}), 6) + 0.0 AS intercept, round(regr_slope(y, {MED}), 8) + 0.0 AS slope,
 round(regr_r2(y, {MED}), 8) + 0.0 AS r2, count(*) AS n FROM fc GROUP BY 1""")
def mincer_zarnowitz(spark, sf):
    out = metrics.mincer_zarnowitz(forecast(spark, sf), KEY, "y", MED)
    return out.select("series_id", rnd("intercept").alias("intercept"), rnd("slope", 8).alias("slope"), rnd("r2", 8).alias("r2"), "n")


@query("single_forecast_row", sql=FC + " SELECT series_id, q, round(yhat, 6) + 0.0 AS yhat FROM fl WHERE ts = TIMESTAMP '2000-06-15 00:00:00'")
def single_forecast_row(spark, sf):
    at = long_forecast(spark, sf).filter(F.col("ts") == tm.ts_lit("2000-06-15 00:00:00"))
    return at.select("series_id", "q", rnd("yhat").alias("yhat"))


@query("union_folds", sql=f"""WITH {DAILY}, f AS (SELECT series_id, ts, y, lag(y, 7) OVER (PARTITION BY series_id ORDER BY ts) AS yhat FROM daily)
SELECT CAST(year(ts) AS INTEGER) AS fold, count(*) AS n, round(avg(abs(yhat - y)), 6) + 0.0 AS mae FROM f WHERE yhat IS NOT NULL GROUP BY 1""")
def union_folds(spark, sf):
    f = add_lags(daily(spark, sf), KEY, "idx", "y", [7]).filter(F.col("lag_7").isNotNull())
    out = f.groupBy(F.year("ts").alias("fold")).agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(F.col("lag_7") - F.col("y"))).alias("mae"))
    return out.select("fold", "n", rnd("mae").alias("mae"))


@query("cv_mean_loss", sql=FC + """, t AS (SELECT q, CAST(year(ts) AS INTEGER) AS fold, avg(greatest(q * (y - yhat), (q - 1) * (y - yhat))) AS loss FROM fl GROUP BY 1, 2)
SELECT q AS trial, round(avg(loss), 6) + 0.0 AS loss, count(*) AS folds FROM t GROUP BY 1""")
def cv_mean_loss(spark, sf):
    long = long_forecast(spark, sf).withColumn("fold", F.year("ts"))
    losses = metrics.pinball(long, ["fold"])
    out = losses.groupBy(F.col("q").alias("trial")).agg(F.avg("pinball").alias("loss"), F.count(F.lit(1)).alias("folds"))
    return out.select("trial", rnd("loss").alias("loss"), "folds")


# --- aggregate reports ------------------------------------------------------


@query("missing_report", sql="""
WITH e AS (SELECT CASE WHEN event_type <> 'error' THEN value END AS a, CASE WHEN event_type = 'view' THEN value END AS b, value AS c FROM events),
u AS (SELECT 'a' AS column, count(*) - count(a) AS nulls, count(*) AS n FROM e UNION ALL SELECT 'b', count(*) - count(b), count(*) FROM e
 UNION ALL SELECT 'c', count(*) - count(c), count(*) FROM e)
SELECT "column", nulls, round(nulls * 100.0 / n, 6) + 0.0 AS percent FROM u WHERE nulls > 0""")
def missing_report(spark, sf):
    e = table(spark, sf, "events").select(
        F.when(F.col("event_type") != "error", F.col("value")).alias("a"),
        F.when(F.col("event_type") == "view", F.col("value")).alias("b"), F.col("value").alias("c"),
    )
    return quality.missing_report(e, ["a", "b", "c"]).select("column", "nulls", rnd("percent").alias("percent"))


@query("missing_heatmap_counts", sql="""
WITH e AS (SELECT date_trunc('day', ts) AS bucket, CASE WHEN event_type <> 'error' THEN value END AS a, CASE WHEN event_type = 'view' THEN value END AS b FROM events)
SELECT bucket, 'a' AS column, count(*) - count(a) AS nulls FROM e GROUP BY 1 UNION ALL SELECT bucket, 'b', count(*) - count(b) FROM e GROUP BY 1""")
def missing_heatmap_counts(spark, sf):
    e = table(spark, sf, "events").select(
        "ts", F.when(F.col("event_type") != "error", F.col("value")).alias("a"),
        F.when(F.col("event_type") == "view", F.col("value")).alias("b"),
    )
    return quality.missing_by_bucket(e, floor_ts("ts", tm.DAY), ["a", "b"])


_NUM = ["l_quantity", "l_extendedprice", "l_discount"]


@query("column_summary", sql=" UNION ALL ".join(f"""
SELECT '{c}' AS column, round(avg({c}), 7) + 0.0 AS mean, round(stddev_samp({c}), 7) + 0.0 AS std, round(quantile_cont({c}, 0.25), 6) + 0.0 AS q25,
 round(quantile_cont({c}, 0.5), 6) + 0.0 AS q50, round(quantile_cont({c}, 0.75), 6) + 0.0 AS q75 FROM lineitem""" for c in _NUM))
def column_summary(spark, sf):
    out = profile.column_summary(table(spark, sf, "lineitem").select(*_NUM), _NUM)
    return out.select("column", rnd("mean", 7).alias("mean"), rnd("std", 7).alias("std"), *[rnd(c).alias(c) for c in ("q25", "q50", "q75")])


@query("target_summary", sql=f"""WITH {HOURLY}
SELECT series_id, round(avg(y), 7) + 0.0 AS mean, round(stddev_samp(y), 7) + 0.0 AS std, round(min(y), 6) + 0.0 AS min, round(max(y), 6) + 0.0 AS max FROM hourly GROUP BY 1""")
def target_summary(spark, sf):
    out = profile.target_summary(hourly(spark, sf), KEY, "y")
    return out.select("series_id", rnd("mean", 7).alias("mean"), rnd("std", 7).alias("std"), rnd("min").alias("min"), rnd("max").alias("max"))


def _box_sql(part: str, expr: str) -> str:
    return f"""SELECT '{part}' AS part, CAST({expr} AS INTEGER) AS slot, y FROM hourly"""


@query("box_stats_by_calendar", sql=f"""WITH {HOURLY},
l AS ({_box_sql("month", "month(ts)")} UNION ALL {_box_sql("weekday", "isodow(ts) - 1")} UNION ALL {_box_sql("hour", "hour(ts)")}),
q AS (SELECT part, slot, quantile_cont(y, 0.25) AS q1, quantile_cont(y, 0.5) AS med, quantile_cont(y, 0.75) AS q3, count(*) AS n FROM l GROUP BY 1, 2)
SELECT q.part, q.slot, any_value(n) AS n, round(any_value(q1), 6) + 0.0 AS q1, round(any_value(med), 6) + 0.0 AS med, round(any_value(q3), 6) + 0.0 AS q3,
 round(min(y) FILTER (y >= q1 - 1.5 * (q3 - q1)), 6) + 0.0 AS low, round(max(y) FILTER (y <= q3 + 1.5 * (q3 - q1)), 6) + 0.0 AS high,
 count(*) FILTER (y < q1 - 1.5 * (q3 - q1) OR y > q3 + 1.5 * (q3 - q1)) AS fliers
FROM q JOIN l ON l.part = q.part AND l.slot = q.slot GROUP BY 1, 2""")
def box_stats_by_calendar(spark, sf):
    out = profile.box_stats(hourly(spark, sf), "ts", "y")
    return out.select("part", "slot", "n", *[rnd(c).alias(c) for c in ("q1", "med", "q3", "low", "high")], "fliers")


@query("hourly_profile_by_month", sql="""
SELECT CAST(month(l_shipdate) AS INTEGER) AS month, l_linenumber AS slot, round(avg(l_extendedprice), 7) + 0.0 AS mean FROM lineitem WHERE month(l_shipdate) IN (1, 7) GROUP BY 1, 2""")
def hourly_profile_by_month(spark, sf):
    out = profile.profile_by_month(table(spark, sf, "lineitem"), "l_shipdate", F.col("l_linenumber"), "l_extendedprice", [1, 7])
    return out.select("month", "slot", rnd("mean", 7).alias("mean"))


_C = ["y", "qty", "disc", "tax"]


@query("correlation_matrix", sql=f"WITH {DAILY_EXOG} " + " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 8) + 0.0 AS r FROM daily_exog" for a in _C for b in _C))
def correlation_matrix(spark, sf):
    return profile.correlation_matrix(daily_exog(spark, sf), _C).select("a", "b", rnd("r", 8).alias("r"))


@query("histogram_fixed_bins", sql=f"""WITH {HOURLY}, m AS (SELECT min(y) AS lo, max(y) AS hi FROM hourly),
b AS (SELECT least(CAST(floor((y - lo) / ((hi - lo) / 24)) AS INTEGER), 23) AS bin FROM hourly, m)
SELECT bin, count(*) AS n FROM b GROUP BY 1""")
def histogram_fixed_bins(spark, sf):
    return profile.histogram(hourly(spark, sf), "y", 24)


@query("kde_grid", sql="""
WITH v AS (SELECT value AS y FROM events), s AS (SELECT stddev_samp(y) * pow(count(*), -0.2) AS h, min(y) AS lo, max(y) AS hi, count(*) AS n FROM v),
b AS (SELECT y, count(*) AS c FROM v GROUP BY 1),
g AS (SELECT CAST(k AS INTEGER) AS i, lo - 3 * h + (hi - lo + 6 * h) * k / 49 AS x FROM s, (SELECT unnest(generate_series(0, 49)) AS k))
SELECT i, round(x, 6) + 0.0 AS x, round(sum(c * exp(-0.5 * pow((x - y) / h, 2))) / any_value(n * h * sqrt(2 * pi())), 9) + 0.0 AS density FROM g, b, s GROUP BY 1, 2""")
def kde_grid(spark, sf):
    out = profile.kde(table(spark, sf, "events"), "value", 50)
    return out.select("i", rnd("x").alias("x"), rnd("density", 9).alias("density"))


_IQR = f"""WITH {HOURLY}, q AS (SELECT series_id, quantile_cont(y, 0.25) AS q1, quantile_cont(y, 0.75) AS q3 FROM hourly GROUP BY 1),
j AS (SELECT h.series_id, ts, y, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM hourly h JOIN q ON q.series_id = h.series_id)"""


@query("iqr_outliers", sql=_IQR + " SELECT series_id, ts, round(y, 6) + 0.0 AS y FROM j WHERE y < lo OR y > hi")
def iqr_outliers(spark, sf):
    return quality.iqr_outliers(hourly(spark, sf), KEY, "y").select("series_id", "ts", rnd("y").alias("y"))


@query("iqr_filter", sql=_IQR + " SELECT series_id, ts, round(y, 6) + 0.0 AS y FROM j WHERE y BETWEEN lo AND hi")
def iqr_filter(spark, sf):
    return quality.iqr_filter(hourly(spark, sf), KEY, "y").select("series_id", "ts", rnd("y").alias("y"))


@query("zscore_outliers", sql=f"""WITH {HOURLY}, s AS (SELECT series_id, avg(y) AS m, stddev_samp(y) AS s1, stddev_pop(y) AS s0 FROM hourly GROUP BY 1)
SELECT 1 AS ddof, h.series_id, ts, round((y - m) / s1, 7) + 0.0 AS z FROM hourly h JOIN s ON s.series_id = h.series_id WHERE abs((y - m) / s1) > 3
UNION ALL SELECT 0, h.series_id, ts, round((y - m) / s0, 7) + 0.0 FROM hourly h JOIN s ON s.series_id = h.series_id WHERE abs((y - m) / s0) > 3""")
def zscore_outliers(spark, sf):
    parts = [
        quality.zscore_outliers(hourly(spark, sf), KEY, "y", 3.0, d).select(F.lit(d).alias("ddof"), "series_id", "ts", rnd("z", 7).alias("z"))
        for d in (1, 0)
    ]
    return parts[0].unionByName(parts[1])


@query("breakpoint_markers", sql=f"""WITH {DAILY}, n AS (SELECT series_id, ts, row_number() OVER (PARTITION BY series_id ORDER BY ts) AS rn, count(*) OVER (PARTITION BY series_id) AS n FROM daily)
SELECT series_id, max(ts) FILTER (rn = floor(n * 0.33) + 1) AS first_break, max(ts) FILTER (rn = floor(n * 0.66) + 1) AS second_break FROM n GROUP BY 1""")
def breakpoint_markers(spark, sf):
    n = row_numbers(daily(spark, sf), KEY, "idx", out="rn", total="n")

    def at(p):
        return F.max(F.when(F.col("rn") == F.floor(F.col("n") * p) + 1, F.col("ts")))

    return n.groupBy("series_id").agg(at(0.33).alias("first_break"), at(0.66).alias("second_break"))


# --- importance tables ------------------------------------------------------

#: Importances derived from the tables: model = nation, feature = segment.
_IMP = """WITH imp AS (SELECT n.n_name AS model, c.c_mktsegment AS feature, CAST(n.n_regionkey AS INTEGER) AS fold, sum(c.c_acctbal) AS importance
 FROM customer c JOIN nation n ON n.n_nationkey = c.c_nationkey GROUP BY 1, 2, 3)"""


def importances(spark, sf):
    c, n = table(spark, sf, "customer"), table(spark, sf, "nation")
    joined = c.join(n, c.c_nationkey == n.n_nationkey)
    return joined.groupBy(
        F.col("n_name").alias("model"), F.col("c_mktsegment").alias("feature"), F.col("n_regionkey").alias("fold")
    ).agg(F.sum("c_acctbal").alias("importance"))


@query("importance_aggregate", sql=_IMP + """
SELECT feature, round(avg(importance), 5) + 0.0 AS mean, round(median(importance), 5) + 0.0 AS median, round(stddev_pop(importance), 5) + 0.0 AS std, count(*) AS runs FROM imp GROUP BY 1 ORDER BY mean DESC""")
def importance_aggregate(spark, sf):
    out = profile.importance_aggregate(importances(spark, sf))
    return out.select("feature", *[rnd(c, 5).alias(c) for c in ("mean", "median", "std")], "runs")


@query("importance_trend", sql=_IMP + """
SELECT fold, feature, round(avg(importance), 5) + 0.0 AS mean, round(stddev_pop(importance), 5) + 0.0 AS std FROM imp GROUP BY 1, 2""")
def importance_trend(spark, sf):
    out = profile.importance_trend(importances(spark, sf), "fold")
    return out.select("fold", "feature", rnd("mean", 5).alias("mean"), rnd("std", 5).alias("std"))


@query("importance_by_model", sql=_IMP + """
SELECT model, feature, round(importance, 4) + 0.0 AS importance, CAST(row_number() OVER (PARTITION BY model ORDER BY importance DESC, feature) AS BIGINT) AS rank FROM imp""")
def importance_by_model(spark, sf):
    out = profile.rank_features(importances(spark, sf), "importance", ["model"])
    return out.select("model", "feature", rnd("importance", 4).alias("importance"), "rank")


_PART_IMP = "WITH imp AS (SELECT p_name AS feature, avg(p_retailprice) AS importance FROM part GROUP BY 1)"


def part_importances(spark, sf):
    return table(spark, sf, "part").groupBy(F.col("p_name").alias("feature")).agg(F.avg("p_retailprice").alias("importance"))


@query("rank_importance", sql=_PART_IMP + """
SELECT feature, CAST(row_number() OVER (ORDER BY importance DESC, feature) AS BIGINT) AS rank FROM imp""")
def rank_importance(spark, sf):
    return profile.rank_features(part_importances(spark, sf), "importance", []).select("feature", "rank")


@query("top_n_features", sql=_PART_IMP + """, r AS (SELECT feature, importance, row_number() OVER (ORDER BY importance DESC, feature) AS rank FROM imp)
SELECT feature, round(importance, 5) + 0.0 AS importance, CAST((rank - 1) // 15 AS BIGINT) AS chunk FROM r WHERE rank <= 200""")
def top_n_features(spark, sf):
    out = profile.top_features(part_importances(spark, sf), "importance", 200, 15)
    return out.select("feature", rnd("importance", 5).alias("importance"), "chunk")
