"""Scalar expressions, scaling and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from tsfoundry.functions import dst, scalar
from tsfoundry.functions.time import HOUR, shift_ts, ts_lit
from tsfoundry.operators import features, metrics, scale, split
from tsfoundry.operators.lookup import attach
from tsfoundry.plans.panels import DAILY, DAILY_EXOG, HOURLY, KEY, daily, daily_exog, hourly, table
from tsfoundry.plans.registry import query, rnd


@query("calendar_features", sql=f"""WITH {HOURLY}
SELECT series_id, ts, CAST(hour(ts) AS INTEGER) AS hour, CAST(isodow(ts) - 1 AS INTEGER) AS weekday, CAST(month(ts) AS INTEGER) AS month,
 CASE WHEN isodow(ts) >= 6 THEN 1 ELSE 0 END AS is_weekend FROM hourly""")
def calendar_features(spark, sf):
    return features.add_calendar(hourly(spark, sf), "ts", list(features.CALENDAR)).drop("idx", "y")


@query("season_dummies", sql=f"""WITH {DAILY}
SELECT series_id, ts, CASE WHEN month(ts) BETWEEN 4 AND 9 THEN 1 ELSE 0 END AS summer_dummy,
 CASE WHEN month(ts) BETWEEN 4 AND 9 THEN 0 ELSE 1 END AS winter_dummy FROM daily""")
def season_dummies(spark, sf):
    return features.add_season(daily(spark, sf), "ts").drop("idx", "y")


@query("fourier_terms", sql=f"""WITH {HOURLY}
SELECT series_id, ts, round(sin(2 * pi() * hour(ts) / 24), 9) + 0.0 AS hour_sin, round(cos(2 * pi() * hour(ts) / 24), 9) + 0.0 AS hour_cos,
 round(sin(2 * pi() * (isodow(ts) - 1) / 7), 9) + 0.0 AS weekday_sin, round(cos(2 * pi() * (isodow(ts) - 1) / 7), 9) + 0.0 AS weekday_cos FROM hourly""")
def fourier_terms(spark, sf):
    out = features.add_fourier(hourly(spark, sf), "ts")
    return out.select("series_id", "ts", *[rnd(c, 9).alias(c) for c in ("hour_sin", "hour_cos", "weekday_sin", "weekday_cos")])


@query("interactions", sql="""
SELECT l_orderkey, l_linenumber, l_partkey, round(l_quantity * l_discount, 6) + 0.0 AS l_quantity_x_l_discount,
 round(l_quantity * l_tax, 6) + 0.0 AS l_quantity_x_l_tax FROM lineitem""")
def interactions(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_discount", "l_tax")
    pairs = [("l_quantity", "l_discount"), ("l_quantity", "l_tax"), ("l_quantity", "absent")]
    out = features.add_interactions(li, pairs)
    names = ["l_quantity_x_l_discount", "l_quantity_x_l_tax"]
    return out.select("l_orderkey", "l_linenumber", "l_partkey", *[rnd(c).alias(c) for c in names])


def _last_sunday(month_end: str) -> str:
    return f"CAST({month_end} AS DATE) - CAST(isodow({month_end}) % 7 AS INTEGER)"


#: European summer time by rule; until 1995 it ended in September.
_DST = f"""
l AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_shipdate + to_hours(l_linenumber) AS t FROM lineitem),
b AS (SELECT *, ({_last_sunday("make_date(year(t), 3, 31)")}) + INTERVAL 2 HOUR AS spring,
 (CASE WHEN year(t) <= 1995 THEN {_last_sunday("make_date(year(t), 9, 30)")} ELSE {_last_sunday("make_date(year(t), 10, 31)")} END) + INTERVAL 2 HOUR AS fall FROM l)"""


@query("dst_localize", sql=f"""WITH {_DST},
r AS (SELECT *, t >= fall AND t < fall + INTERVAL 1 HOUR AS twice, min(id) OVER (PARTITION BY t) AS first_id FROM b)
SELECT id, t AS local, CASE WHEN t >= spring AND t < spring + INTERVAL 1 HOUR THEN NULL
 WHEN t >= spring + INTERVAL 1 HOUR AND t < fall THEN t - INTERVAL 2 HOUR
 WHEN twice AND id = first_id THEN t - INTERVAL 2 HOUR ELSE t - INTERVAL 1 HOUR END AS ts FROM r""")
def dst_localize(spark, sf):
    li = table(spark, sf, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
        shift_ts("l_shipdate", F.col("l_linenumber") * HOUR).alias("local"),
    )
    return dst.localize(li, [], "local", "id").select("id", "local", "ts")


@query("hour24_roll", sql="""
SELECT l_orderkey, l_linenumber, l_partkey, l_shipdate + to_hours(CAST(least(l_quantity, 24) AS INTEGER)) AS ts FROM lineitem""")
def hour24_roll(spark, sf):
    li = table(spark, sf, "lineitem")
    clock = F.concat(F.lpad(F.least(F.col("l_quantity"), F.lit(24.0)).cast("int").cast("string"), 2, "0"), F.lit(":00"))
    text = li.select("l_orderkey", "l_linenumber", "l_partkey", F.date_format("l_shipdate", "dd.MM.yyyy").alias("d"), clock.alias("c"))
    return text.select("l_orderkey", "l_linenumber", "l_partkey", scalar.hour24("d", "c").alias("ts"))


@query("fall_spring_shift", sql=f"""WITH {_DST},
m AS (SELECT id, t, count(*) OVER (PARTITION BY t, id) AS same, max(id) OVER (PARTITION BY t) AS last_id FROM l)
SELECT id, CASE WHEN id < last_id AND month(t) = 10 AND hour(t) = 3 THEN t - INTERVAL 1 HOUR
 WHEN CAST(t AS DATE) = {_last_sunday("make_date(year(t), 3, 31)")} AND hour(t) = 2 THEN t + INTERVAL 1 HOUR ELSE t END AS local FROM m""")
def fall_spring_shift(spark, sf):
    li = table(spark, sf, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
        shift_ts("l_shipdate", F.col("l_linenumber") * HOUR).alias("local"),
    )
    return dst.shift_transitions(li, [], "local", "id").select("id", "local")


@query("dms_to_decimal", sql="SELECT p_partkey, round(p_size + (p_retailprice - floor(p_retailprice)) * 100 / 60.0, 6) + 0.0 AS lat FROM part")
def dms_to_decimal(spark, sf):
    minutes = (F.col("p_retailprice") - F.floor("p_retailprice")) * 100
    return table(spark, sf, "part").select("p_partkey", rnd(scalar.dms_to_decimal("p_size", minutes)).alias("lat"))


@query("parse_duration", sql="""
SELECT p_partkey, p_size * CASE WHEN p_type LIKE 'E%' THEN 604800 WHEN p_type LIKE 'S%' THEN 86400 ELSE 3600 END::BIGINT AS seconds FROM part""")
def parse_duration(spark, sf):
    unit = F.when(F.col("p_type").like("E%"), "W").when(F.col("p_type").like("S%"), "D").otherwise("H")
    part = table(spark, sf, "part").select("p_partkey", F.concat(F.col("p_size").cast("string"), unit).alias("text"))
    return part.select("p_partkey", scalar.duration_seconds("text").alias("seconds"))


@query("poly_transforms", sql="SELECT event_id, round(value * value, 4) + 0.0 AS y2, round(value * value * value, 3) + 0.0 AS y3 FROM events")
def poly_transforms(spark, sf):
    return table(spark, sf, "events").select(
        "event_id", rnd(scalar.polynomial("value", 2), 4).alias("y2"), rnd(scalar.polynomial("value", 3), 3).alias("y3")
    )


@query("minmax_unit", sql=f"""WITH {HOURLY}, m AS (SELECT series_id, min(y) AS lo, max(y) AS hi FROM hourly GROUP BY 1)
SELECT h.series_id, ts, round((y - lo) / (hi - lo), 9) + 0.0 AS x FROM hourly h JOIN m ON m.series_id = h.series_id""")
def minmax_unit(spark, sf):
    panel = hourly(spark, sf)
    span = panel.groupBy("series_id").agg(F.min("y").alias("lo"), F.max("y").alias("hi"))
    unit = (F.col("y") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0))
    return attach(panel, span, KEY).select("series_id", "ts", rnd(unit, 9).alias("x"))


@query("residual", sql=f"""WITH {HOURLY}, f AS (SELECT series_id, ts, y, lag(y, 24) OVER (PARTITION BY series_id ORDER BY ts) AS yhat FROM hourly)
SELECT series_id, ts, round(yhat - y, 6) + 0.0 AS residual FROM f WHERE yhat IS NOT NULL""")
def residual(spark, sf):
    f = features.add_lags(hourly(spark, sf), KEY, "idx", "y", [24]).filter(F.col("lag_24").isNotNull())
    return f.select("series_id", "ts", rnd(metrics.residual("y", "lag_24")).alias("residual"))


@query("version_pick_max", sql="""
SELECT c_mktsegment AS model, 'v1.0.' || CAST(max(c_nationkey) AS VARCHAR) AS version FROM customer GROUP BY 1""")
def version_pick_max(spark, sf):
    runs = table(spark, sf, "customer").select(
        F.col("c_mktsegment").alias("model"), F.concat(F.lit("v1.0."), F.col("c_nationkey").cast("string")).alias("version")
    )
    return runs.groupBy("model").agg(F.max_by("version", scalar.version_number("version")).alias("version"))


_SPLIT = f"""WITH {DAILY_EXOG},
tr AS (SELECT * FROM daily_exog WHERE ts < TIMESTAMP '2000-01-01')"""


def _marked(spark, sf):
    return daily_exog(spark, sf).withColumn(
        "part", F.when(F.col("ts") < ts_lit("2000-01-01"), "train").otherwise("test")
    )


def _scaled(spark, sf, method):
    df = _marked(spark, sf)
    stats = scale.fit_scaler(df.filter(F.col("part") == "train"), ["y", "qty"], method)
    out = scale.apply_scaler(df, stats, ["y", "qty"])
    return out.select("series_id", "ts", rnd("y", 7).alias("y"), rnd("qty", 7).alias("qty"))


@query("scale_standard", sql=_SPLIT + """
SELECT series_id, ts, round((y - (SELECT avg(y) FROM tr)) / (SELECT stddev_pop(y) FROM tr), 7) + 0.0 AS y,
 round((qty - (SELECT avg(qty) FROM tr)) / (SELECT stddev_pop(qty) FROM tr), 7) + 0.0 AS qty FROM daily_exog""")
def scale_standard(spark, sf):
    return _scaled(spark, sf, "standard")


@query("scale_minmax", sql=_SPLIT + """
SELECT series_id, ts, round((y - (SELECT min(y) FROM tr)) / (SELECT max(y) - min(y) FROM tr), 7) + 0.0 AS y,
 round((qty - (SELECT min(qty) FROM tr)) / (SELECT max(qty) - min(qty) FROM tr), 7) + 0.0 AS qty FROM daily_exog""")
def scale_minmax(spark, sf):
    return _scaled(spark, sf, "minmax")


@query("scale_robust", sql=_SPLIT + """
SELECT series_id, ts, round((y - (SELECT quantile_cont(y, 0.5) FROM tr)) / (SELECT quantile_cont(y, 0.75) - quantile_cont(y, 0.25) FROM tr), 7) + 0.0 AS y,
 round((qty - (SELECT quantile_cont(qty, 0.5) FROM tr)) / (SELECT quantile_cont(qty, 0.75) - quantile_cont(qty, 0.25) FROM tr), 7) + 0.0 AS qty FROM daily_exog""")
def scale_robust(spark, sf):
    return _scaled(spark, sf, "robust")


@query("scale_by_group", sql=_SPLIT + """
SELECT series_id, ts, round(y, 7) + 0.0 AS y, round((qty - (SELECT avg(qty) FROM tr)) / (SELECT stddev_pop(qty) FROM tr), 7) + 0.0 AS qty,
 round((disc - (SELECT min(disc) FROM tr)) / (SELECT max(disc) - min(disc) FROM tr), 7) + 0.0 AS disc,
 round((tax - (SELECT quantile_cont(tax, 0.5) FROM tr)) / (SELECT quantile_cont(tax, 0.75) - quantile_cont(tax, 0.25) FROM tr), 7) + 0.0 AS tax
FROM daily_exog""")
def scale_by_group(spark, sf):
    groups = {
        "base": {"columns": ["qty"], "method": "standard"},
        "exog": {"columns": ["disc"], "method": "minmax"},
        "advanced": {"columns": ["tax"], "method": "robust"},
        "lag": {"columns": ["y"], "method": "standard", "enabled": False},
    }
    out, _ = scale.scale_by_group(_marked(spark, sf), "part", groups)
    return out.select("series_id", "ts", *[rnd(c, 7).alias(c) for c in ("y", "qty", "disc", "tax")])


@query("train_stats_join", sql=_SPLIT + """
SELECT 'y' AS column, round(avg(y), 7) + 0.0 AS center, round(stddev_pop(y), 7) + 0.0 AS scale FROM tr
UNION ALL SELECT 'qty', round(avg(qty), 7) + 0.0, round(stddev_pop(qty), 7) + 0.0 FROM tr""")
def train_stats_join(spark, sf):
    stats = scale.fit_scaler(_marked(spark, sf).filter(F.col("part") == "train"), ["y", "qty"], "standard")
    return stats.select("column", rnd("center", 7).alias("center"), rnd("scale", 7).alias("scale"))


@query("time_series_split", sql=f"""WITH {HOURLY},
n AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts) AS rn, count(*) OVER (PARTITION BY series_id) AS n FROM hourly),
f AS (SELECT series_id, ts, rn, n - (3 - fold) * 73 AS start, fold FROM n, (SELECT unnest([0, 1, 2]) AS fold))
SELECT series_id, ts, CAST(fold AS INTEGER) AS fold, CASE WHEN rn <= start THEN 'train' ELSE 'test' END AS part FROM f WHERE rn <= start + 73""")
def time_series_split(spark, sf):
    return split.time_series_split(hourly(spark, sf), KEY, "idx", 3, 73).select("series_id", "ts", "fold", "part")


@query("tail_validation", sql=f"""WITH {HOURLY},
n AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts) AS rn, count(*) OVER (PARTITION BY series_id) AS n FROM hourly)
SELECT series_id, ts, CASE WHEN rn <= floor(n * CAST(0.9 AS DOUBLE)) THEN 'train' ELSE 'valid' END AS part FROM n""")
def tail_validation(spark, sf):
    return split.tail_validation(hourly(spark, sf), KEY, "idx", 0.1).select("series_id", "ts", "part")


_FOLDS = f"""WITH {HOURLY},
sp AS (SELECT series_id, TIMESTAMP '2024-01-09 13:00:00' AS train_end, max(ts) AS last_ts FROM hourly GROUP BY 1),
an AS (SELECT *, (SELECT min(h) FROM (SELECT train_end + to_hours(CAST(k AS INTEGER)) AS h FROM (SELECT unnest(generate_series(0, 167)) AS k))
 WHERE isodow(h) = 3 AND hour(h) = 22) AS anchor FROM sp),
fo AS (SELECT series_id, CAST(f AS INTEGER) AS fold, anchor + to_hours(CAST(168 * f AS INTEGER)) AS fold_train_end,
 anchor + to_hours(CAST(168 * f + 1 AS INTEGER)) AS test_start, anchor + to_hours(CAST(168 * (f + 1) AS INTEGER)) AS test_end
 FROM an, (SELECT unnest(generate_series(0, 9)) AS f) WHERE anchor + to_hours(CAST(168 * (f + 1) AS INTEGER)) <= last_ts)"""


def hourly_folds(panel):
    spans = panel.groupBy("series_id").agg(
        ts_lit("2024-01-09 13:00:00").alias("train_end"), F.max("ts").alias("last_ts")
    )
    return split.fold_table(spans, KEY)


@query("rolling_origin_folds", sql=_FOLDS + """
SELECT h.series_id, ts, fold, CASE WHEN ts <= fold_train_end THEN 'train' ELSE 'test' END AS role FROM hourly h JOIN fo ON fo.series_id = h.series_id
WHERE ts <= test_end""")
def rolling_origin_folds(spark, sf):
    panel = hourly(spark, sf)
    out = split.assign_folds(panel, hourly_folds(panel), KEY, "ts")
    return out.select("series_id", "ts", "fold", "role")
