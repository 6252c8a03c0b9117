"""Window features, imputation, decompositions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tsfoundry.functions.time import HOUR, ts_lit
from tsfoundry.operators import features, impute, spectral
from tsfoundry.operators.chunking import over_chunks, running_sum
from tsfoundry.operators.lookup import attach
from tsfoundry.operators.models.naive import quantile_column, seasonal_quantiles
from tsfoundry.operators.resample import resample
from tsfoundry.plans.panels import (
    DAILY, DAILY_EXOG, HOURLY, HOURLY_NULL, KEY, USER_HOURLY, daily, daily_exog, hourly, table, user_hourly,
)
from tsfoundry.plans.registry import query, rnd
from tsfoundry.sources.landed import within_day_counter

W = "PARTITION BY series_id ORDER BY ts"


def _pick(df, cols, digits=6, keep=("series_id", "ts")):
    return df.select(*keep, *[rnd(c, digits).alias(c) for c in cols])


@query("resample_hourly_sum", sql=f"WITH {HOURLY} SELECT series_id, ts, round(y, 6) + 0.0 AS y FROM hourly")
def resample_hourly_sum(spark, sf):
    return _pick(hourly(spark, sf), ["y"])


@query("asfreq_gapfill", sql=f"WITH {USER_HOURLY} SELECT series_id, ts, round(y, 6) + 0.0 AS y FROM user_hourly")
def asfreq_gapfill(spark, sf):
    return _pick(user_hourly(spark, sf), ["y"])


@query("lag_features", sql=f"""WITH {HOURLY} SELECT series_id, ts,
 {", ".join(f"round(lag(y, {k}) OVER ({W}), 6) + 0.0 AS lag_{k}" for k in (1, 24, 168))} FROM hourly""")
def lag_features(spark, sf):
    out = features.add_lags(hourly(spark, sf), KEY, "idx", "y", [1, 24, 168])
    return _pick(out, ["lag_1", "lag_24", "lag_168"])


@query("diff_features", sql=f"""WITH {DAILY_EXOG} SELECT series_id, ts,
 {", ".join(f"round({c} - lag({c}, {k}) OVER ({W}), 6) + 0.0 AS {c}_diff_{k}d" for c in ("y", "qty") for k in (1, 7))} FROM daily_exog""")
def diff_features(spark, sf):
    out = features.add_diffs(daily_exog(spark, sf), KEY, "idx", ["y", "qty"], [1, 7], "d")
    return _pick(out, [f"{c}_diff_{k}d" for c in ("y", "qty") for k in (1, 7)])


def _roll_sql(stat: str, n: int) -> str:
    frame = f"OVER ({W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    fn = {
        "mean": "avg(y)", "std": "stddev_samp(y)", "min": "min(y)", "max": "max(y)",
        "median": "quantile_cont(y, 0.5)", "q0.9": "quantile_cont(y, 0.9)",
    }[stat]
    return f"round({fn} {frame}, 6) + 0.0 AS y_{stat.replace('.', '_')}_{n}h"


_STATS = ["mean", "std", "min", "max", "median", "q0.9"]


@query("rolling_stats", sql=f"""WITH {HOURLY} SELECT series_id, ts, {", ".join(_roll_sql(s, n) for n in (9, 24) for s in _STATS)} FROM hourly""")
def rolling_stats(spark, sf):
    out = features.add_rolling(hourly(spark, sf), KEY, "idx", ["y"], [9, 24], _STATS)
    return _pick(out, [f"y_{s}_{n}h".replace(".", "_") for n in (9, 24) for s in _STATS])


@query("rolling_moments", sql=f"""WITH {HOURLY},
d AS (SELECT h.series_id, ts, y - m AS x FROM hourly h JOIN (SELECT series_id, avg(y) AS m FROM hourly GROUP BY 1) g ON g.series_id = h.series_id),
s AS (SELECT series_id, ts, count(*) OVER f AS n, avg(x) OVER f AS a1, avg(x * x) OVER f AS a2, avg(x * x * x) OVER f AS a3,
 avg(x * x * x * x) OVER f AS a4 FROM d WINDOW f AS ({W} ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)),
c AS (SELECT *, a2 - a1 * a1 AS m2, a3 - 3 * a1 * a2 + 2 * a1 * a1 * a1 AS m3,
 a4 - 4 * a1 * a3 + 6 * a1 * a1 * a2 - 3 * a1 * a1 * a1 * a1 AS m4 FROM s)
SELECT series_id, ts, CASE WHEN n = 24 AND m2 > 1e-9 THEN round(m3 / pow(m2, 1.5), 5) + 0.0 END AS y_skew_24h,
 CASE WHEN n = 24 AND m2 > 1e-9 THEN round(m4 / (m2 * m2) - 3, 5) + 0.0 END AS y_kurtosis_24h FROM c""")
def rolling_moments(spark, sf):
    out = features.add_moments(hourly(spark, sf), KEY, "idx", ["y"], [24])
    return _pick(out, ["y_skew_24h", "y_kurtosis_24h"], 5)


_QS = (0.025, 0.25, 0.5, 0.75, 0.975)


@query("rolling_quantile_seasonal", sql=f"""WITH {DAILY},
s AS (SELECT *, isodow(ts) AS wd FROM daily)
SELECT series_id, ts, {", ".join(f"CASE WHEN count(*) OVER f = 25 THEN round(quantile_cont(y, {q}) OVER f, 6) + 0.0 END AS {quantile_column(q)}" for q in _QS)}
FROM s WINDOW f AS (PARTITION BY series_id, wd ORDER BY ts ROWS BETWEEN 25 PRECEDING AND 1 PRECEDING)""")
def rolling_quantile_seasonal(spark, sf):
    d = daily(spark, sf).withColumn("wd", F.weekday("ts"))
    out = seasonal_quantiles(d, KEY, ["wd"], "idx", "y", 25)
    return _pick(out, [quantile_column(q) for q in _QS])


@query("rolling_mean_std_full", sql=f"""WITH {HOURLY}
SELECT series_id, ts, CASE WHEN count(*) OVER f = 24 THEN round(avg(y) OVER f, 6) + 0.0 END AS y_mean_24h,
 CASE WHEN count(*) OVER f = 24 THEN round(stddev_samp(y) OVER f, 6) + 0.0 END AS y_std_24h
FROM hourly WINDOW f AS ({W} ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)""")
def rolling_mean_std_full(spark, sf):
    out = features.add_rolling(hourly(spark, sf), KEY, "idx", ["y"], [24], ["mean", "std"], min_periods=24)
    return _pick(out, ["y_mean_24h", "y_std_24h"])


#: Gappy user series with a step index and its known neighbours, in SQL.
_GAPS = f"""WITH {USER_HOURLY},
u AS (SELECT *, CAST(epoch(ts) AS BIGINT) // 3600 AS i, row_number() OVER ({W}) AS pos FROM user_hourly),
z AS (SELECT *, last_value(CASE WHEN y IS NOT NULL THEN i END IGNORE NULLS) OVER b AS pi, last_value(y IGNORE NULLS) OVER b AS pv,
 first_value(CASE WHEN y IS NOT NULL THEN i END IGNORE NULLS) OVER a AS ni, first_value(y IGNORE NULLS) OVER a AS nv
 FROM u WINDOW b AS ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS ({W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""


@query("interpolate_time", sql=_GAPS + """
SELECT series_id, ts, round(CASE WHEN pi IS NULL THEN NULL WHEN ni IS NULL OR ni = pi THEN pv ELSE pv + (nv - pv) * (i - pi) / (ni - pi) END, 8) + 0.0 AS y FROM z""")
def interpolate_time(spark, sf):
    return _pick(impute.interpolate_time(user_hourly(spark, sf), KEY, "idx", "y"), ["y"], 8)


@query("ffill_bfill", sql=_GAPS + " SELECT series_id, ts, round(coalesce(pv, nv), 6) + 0.0 AS y FROM z")
def ffill_bfill(spark, sf):
    return _pick(impute.fill(user_hourly(spark, sf), KEY, "idx", "y"), ["y"])


_ROWPOS = f"""WITH e AS (SELECT CAST(user_id AS VARCHAR) AS series_id, event_id, CASE WHEN event_type IN ('click', 'view') THEN value END AS y FROM events),
u AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY event_id) AS i FROM e),
z AS (SELECT *, last_value(CASE WHEN y IS NOT NULL THEN i END IGNORE NULLS) OVER b AS pi, last_value(y IGNORE NULLS) OVER b AS pv,
 first_value(CASE WHEN y IS NOT NULL THEN i END IGNORE NULLS) OVER a AS ni, first_value(y IGNORE NULLS) OVER a AS nv
 FROM u WINDOW b AS (PARTITION BY series_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
 a AS (PARTITION BY series_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""


@query("interpolate_linear", sql=_ROWPOS + """
SELECT series_id, event_id, round(CASE WHEN pi IS NULL THEN NULL WHEN ni IS NULL OR ni = pi THEN pv ELSE pv + (nv - pv) * (i - pi) / (ni - pi) END, 8) + 0.0 AS y FROM z""")
def interpolate_linear(spark, sf):
    rows = table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("series_id"), "event_id",
        F.when(F.col("event_type").isin("click", "view"), F.col("value")).alias("y"),
    )
    out = impute.interpolate_linear(rows, KEY, "event_id", "y")
    return _pick(out, ["y"], 8, ("series_id", "event_id"))


def _lagrange(j: int) -> str:
    terms = "".join(f" * (i - i{m}) / (i{j} - i{m})" for m in range(4) if m != j)
    return f"y{j}{terms}"


@query("interpolate_spline", sql=f"""WITH {USER_HOURLY},
u AS (SELECT *, CAST(CAST(epoch(ts) AS BIGINT) // 3600 AS DOUBLE) AS i FROM user_hourly),
k AS (SELECT series_id, i AS i1, y AS y1, lag(i) OVER w AS i0, lag(y) OVER w AS y0, lead(i) OVER w AS i2, lead(y) OVER w AS y2,
 lead(i, 2) OVER w AS i3, lead(y, 2) OVER w AS y3 FROM u WHERE y IS NOT NULL WINDOW w AS (PARTITION BY series_id ORDER BY i)),
j AS (SELECT u.series_id, ts, y, i, i0, i1, i2, i3, y0, y1, y2, y3 FROM u ASOF LEFT JOIN k ON u.series_id = k.series_id AND u.i >= k.i1)
SELECT series_id, ts, round(1e-10 + coalesce(y, {" + ".join(_lagrange(j) for j in range(4))},
 y1 + (y2 - y1) * (i - i1) / (i2 - i1), y1), 7) + 0.0 AS y FROM j""")
def interpolate_spline(spark, sf):
    out = impute.interpolate_cubic(user_hourly(spark, sf), KEY, "idx", "y")
    # gaps of 2^k steps give exact decimal ties: both sides move off the tie
    return out.select("series_id", "ts", rnd(F.col("y") + 1e-10, 7).alias("y"))


@query("mean_impute", sql=f"""WITH {USER_HOURLY}, m AS (SELECT series_id, avg(y) AS m FROM user_hourly GROUP BY 1)
SELECT u.series_id, ts, round(coalesce(y, m), 9) + 0.0 AS y FROM user_hourly u JOIN m ON m.series_id = u.series_id""")
def mean_impute(spark, sf):
    return _pick(impute.mean_impute(user_hourly(spark, sf), KEY, "y"), ["y"], 9)


@query("within_day_counter", sql="""
SELECT event_id, row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY event_id) - 1 AS n FROM events""")
def within_day_counter_q(spark, sf):
    ev = table(spark, sf, "events").select("event_id", F.to_date("ts").alias("day"))
    return within_day_counter(ev, "day", "event_id").select("event_id", "n")


@query("cusum", sql=f"""WITH {DAILY}, f AS (SELECT series_id, ts, lag(y, 7) OVER ({W}) - y AS e FROM daily)
SELECT series_id, ts, round(sum(e) OVER ({W} ROWS UNBOUNDED PRECEDING), 6) + 0.0 AS cusum FROM f""")
def cusum(spark, sf):
    lagged = features.add_lags(daily(spark, sf), KEY, "idx", "y", [7])
    errors = lagged.withColumn("e", F.col("lag_7") - F.col("y"))
    out = running_sum(errors, KEY, "idx", {"cusum": F.coalesce(F.col("e"), F.lit(0.0))})
    started = F.when(F.col("idx") >= F.col("first_idx") + 7, F.col("cusum"))
    first = errors.groupBy(*KEY).agg(F.min("idx").alias("first_idx"))
    return attach(out, first, KEY).select("series_id", "ts", rnd(started).alias("cusum"))


_ACF = f"""WITH {HOURLY},
d AS (SELECT h.series_id, ts, y - m AS x FROM hourly h JOIN (SELECT series_id, avg(y) AS m FROM hourly GROUP BY 1) g ON g.series_id = h.series_id),
k AS (SELECT unnest(generate_series(0, 48)) AS lag),
p AS (SELECT a.series_id, lag, sum(a.x * b.x) AS s FROM d a JOIN k ON true JOIN d b ON b.series_id = a.series_id
 AND b.ts = a.ts - to_hours(CAST(lag AS INTEGER)) GROUP BY 1, 2),
acf AS (SELECT p.series_id, CAST(p.lag AS INTEGER) AS lag, p.s / z.s AS r FROM p JOIN p z ON z.series_id = p.series_id AND z.lag = 0)"""


@query("acf", sql=_ACF + " SELECT series_id, lag, round(r, 8) + 0.0 AS acf FROM acf")
def acf(spark, sf):
    out = spectral.acf(hourly(spark, sf), KEY, "idx", "y", 48)
    return out.select("series_id", "lag", rnd("acf", 8).alias("acf"))


@query("acf_outer", sql=_ACF + """
SELECT a.series_id, a.lag AS lag_a, b.lag AS lag_b, round(a.r * b.r, 8) + 0.0 AS product FROM acf a JOIN acf b ON a.series_id = b.series_id""")
def acf_outer(spark, sf):
    out = spectral.acf_outer(hourly(spark, sf), KEY, "idx", "y", 48)
    return out.select("series_id", "lag_a", "lag_b", rnd("product", 8).alias("product"))


@query("ccf_best_lag", sql=f"""WITH {DAILY_EXOG},
l AS (SELECT series_id, ts, y, unnest(['qty', 'disc', 'tax']) AS variable, unnest([qty, disc, tax]) AS x FROM daily_exog),
c AS (SELECT series_id, variable, avg(y) AS my, avg(x) AS mx, stddev_pop(y) AS sy, stddev_pop(x) AS sx, count(*) AS n FROM l GROUP BY 1, 2),
k AS (SELECT unnest(generate_series(0, 24)) AS lag),
p AS (SELECT a.series_id, a.variable, lag, sum((a.y - my) * (b.x - mx)) / any_value(n * sy * sx) AS r FROM l a JOIN k ON true
 JOIN l b ON b.series_id = a.series_id AND b.variable = a.variable AND b.ts = a.ts - to_days(CAST(lag AS INTEGER))
 JOIN c ON c.series_id = a.series_id AND c.variable = a.variable GROUP BY 1, 2, 3)
SELECT series_id, variable, CAST(lag AS INTEGER) AS lag, round(r, 8) + 0.0 AS r FROM p
QUALIFY row_number() OVER (PARTITION BY series_id, variable ORDER BY abs(r) DESC, lag) = 1""")
def ccf_best_lag(spark, sf):
    ccf = spectral.cross_correlations(daily_exog(spark, sf), KEY, "idx", "y", ["qty", "disc", "tax"], 24)
    return spectral.best_lag(ccf, KEY).select("series_id", "variable", "lag", rnd("r", 8).alias("r"))


@query("seasonal_decompose", sql=f"""WITH {HOURLY},
t AS (SELECT series_id, ts, y, row_number() OVER ({W}) AS rn, (sum(y) OVER ({W} ROWS BETWEEN 11 PRECEDING AND 11 FOLLOWING)
 + 0.5 * (lag(y, 12) OVER ({W}) + lead(y, 12) OVER ({W}))) / 24 AS trend FROM hourly),
p AS (SELECT *, (rn - 1) % 24 AS pos FROM t),
s AS (SELECT series_id, pos, avg(y - trend) AS s FROM p GROUP BY 1, 2),
c AS (SELECT series_id, pos, s - avg(s) OVER (PARTITION BY series_id) AS seasonal FROM s)
SELECT p.series_id, ts, round(trend, 7) + 0.0 AS trend, round(seasonal, 7) + 0.0 AS seasonal, round(y - trend - seasonal, 7) + 0.0 AS resid
FROM p JOIN c ON c.series_id = p.series_id AND c.pos = p.pos""")
def seasonal_decompose(spark, sf):
    out = spectral.seasonal_decompose(hourly(spark, sf), KEY, "idx", "y", 24)
    return _pick(out, ["trend", "seasonal", "resid"], 7)


@query("sequence_windows", sql=f"""WITH {HOURLY},
n AS (SELECT *, row_number() OVER ({W}) AS rn, count(*) OVER (PARTITION BY series_id) AS n,
 sum(y) OVER ({W} ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) AS s, lag(y, 23) OVER ({W}) AS f, lead(y, 1) OVER ({W}) AS t1, lead(y, 3) OVER ({W}) AS t3 FROM hourly)
SELECT series_id, ts, round(s, 6) + 0.0 AS x_sum, round(f, 6) + 0.0 AS x_first, round(y, 6) + 0.0 AS x_last, round(t1, 6) + 0.0 AS t_1, round(t3, 6) + 0.0 AS t_3
FROM n WHERE rn >= 24 AND rn <= n - 3""")
def sequence_windows(spark, sf):
    out = features.sequence_windows(hourly(spark, sf), KEY, "idx", ["y"], "y", 24, 3)
    total = F.aggregate("x", F.lit(0.0), lambda a, r: a + r[0])
    return out.select(
        "series_id", "ts", rnd(total).alias("x_sum"), rnd(F.col("x")[0][0]).alias("x_first"),
        rnd(F.col("x")[23][0]).alias("x_last"), rnd(F.col("targets")[0]).alias("t_1"), rnd(F.col("targets")[2]).alias("t_3"),
    )


@query("scatter_lagged", sql=f"""WITH {DAILY_EXOG}, l AS (SELECT series_id, ts, lag(qty, 7) OVER ({W}) AS x, y, month(ts) AS m FROM daily_exog)
SELECT series_id, ts, round(x, 6) + 0.0 AS x_lagged, round(y, 6) + 0.0 AS y_now, CAST(m AS INTEGER) AS colour FROM l WHERE x IS NOT NULL""")
def scatter_lagged(spark, sf):
    from tsfoundry.functions.time import DAY, index_ts

    out = features.scatter_lagged(daily_exog(spark, sf), KEY, "idx", "qty", "y", 7, F.month("ts"))
    return out.select(
        "series_id", index_ts("idx", DAY).alias("ts"), rnd("x_lagged").alias("x_lagged"), rnd("y_now").alias("y_now"), "colour"
    )
