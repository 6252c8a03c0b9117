"""Projections, filters and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from tsfoundry.functions import time as tm
from tsfoundry.functions.time import DAY, HOUR, ts_lit
from tsfoundry.operators import quality, split
from tsfoundry.operators.features import add_calendar, add_lags
from tsfoundry.operators.lookup import attach
from tsfoundry.operators.resample import resample
from tsfoundry.plans.panels import DAILY, DAILY_EXOG, HOURLY, KEY, daily, daily_exog, hourly, table
from tsfoundry.plans.registry import query, rnd

START = "1998-01-01 00:00:00"


@query("filter_start_with_buffer", sql=f"""
WITH r AS (SELECT o_orderpriority AS series_id, date_trunc('day', o_orderdate) AS ts, o_totalprice / 1000 AS v
 FROM orders WHERE o_orderdate >= TIMESTAMP '{START}' - INTERVAL 1600 HOUR),
a AS (SELECT series_id, ts, sum(v) AS y FROM r GROUP BY 1, 2),
b AS (SELECT series_id, min(ts) AS lo, max(ts) AS hi FROM r GROUP BY 1),
g AS (SELECT series_id, unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS ts FROM b),
d AS (SELECT g.series_id, g.ts, coalesce(a.y, 0.0) AS y FROM g LEFT JOIN a ON a.series_id = g.series_id AND a.ts = g.ts),
l AS (SELECT *, lag(y, 28) OVER (PARTITION BY series_id ORDER BY ts) AS lag_28 FROM d)
SELECT series_id, ts, round(y, 6) + 0.0 AS y, round(lag_28, 6) + 0.0 AS lag_28 FROM l WHERE ts >= TIMESTAMP '{START}'""")
def filter_start_with_buffer(spark, sf):
    start = ts_lit(START)
    early = table(spark, sf, "orders").filter(F.col("o_orderdate") >= F.expr(f"timestamp_ntz'{START}' - interval 1600 hours"))
    rows = early.select(
        F.col("o_orderpriority").alias("series_id"), F.col("o_orderdate").alias("ts"),
        (F.col("o_totalprice") / 1000).alias("v"),
    )
    panel = resample(rows, KEY, "ts", DAY, {"y": ("sum", "v")})
    out = add_lags(panel, KEY, "idx", "y", [28]).filter(F.col("ts") >= start)
    return out.select("series_id", "ts", rnd("y").alias("y"), rnd("lag_28").alias("lag_28"))


_WD = "(isodow(ts) - 1)"


def _window_sql(last_hour: int) -> str:
    return (
        f"(({_WD} = 2 AND hour(ts) >= 23) OR {_WD} IN (3, 4) OR ({_WD} = 5 AND hour(ts) <= {last_hour}))"
    )


@query("filter_forecast_window", sql=f"""WITH {HOURLY}
SELECT series_id, ts, round(y, 6) + 0.0 AS y FROM hourly WHERE {_window_sql(23)}""")
def filter_forecast_window(spark, sf):
    return hourly(spark, sf).filter(tm.forecast_window("ts")).select("series_id", "ts", rnd("y").alias("y"))


@query("filter_baseline_window", sql=f"""WITH {HOURLY}, f AS (SELECT series_id, min(ts) AS first_ts FROM hourly GROUP BY 1)
SELECT h.series_id, ts, round(y, 6) + 0.0 AS y FROM hourly h JOIN f ON f.series_id = h.series_id
WHERE {_window_sql(20)} AND ts > first_ts""")
def filter_baseline_window(spark, sf):
    panel = hourly(spark, sf)
    first = panel.groupBy("series_id").agg(F.min("ts").alias("first_ts"))
    kept = attach(panel, first, KEY).filter(tm.forecast_window("ts", 20) & (F.col("ts") > F.col("first_ts")))
    return kept.select("series_id", "ts", rnd("y").alias("y"))


@query("filter_target_times", sql=f"""WITH {HOURLY}
SELECT series_id, ts, round(y, 6) + 0.0 AS y FROM hourly WHERE {_WD} IN (4, 5) AND hour(ts) IN (11, 15, 19)""")
def filter_target_times(spark, sf):
    return hourly(spark, sf).filter(tm.target_times("ts")).select("series_id", "ts", rnd("y").alias("y"))


@query("anchor_first_match", sql=f"""WITH {HOURLY},
a AS (SELECT series_id, min(ts) AS anchor FROM hourly WHERE {_WD} = 2 AND hour(ts) >= 18 GROUP BY 1)
SELECT h.series_id, ts, round(y, 6) + 0.0 AS y FROM hourly h JOIN a ON a.series_id = h.series_id WHERE ts >= anchor""")
def anchor_first_match(spark, sf):
    panel = hourly(spark, sf)
    match = (tm.weekday("ts") == tm.WED) & (tm.hour("ts") >= 18)
    anchors = panel.filter(match).groupBy("series_id").agg(F.min("ts").alias("anchor"))
    kept = attach(panel, anchors, KEY).filter(F.col("ts") >= F.col("anchor"))
    return kept.select("series_id", "ts", rnd("y").alias("y"))


@query("assert_no_nulls", sql=f"""WITH {HOURLY}
SELECT 'y' AS column, count(*) FILTER (WHERE y IS NULL) AS nulls, count(*) AS total FROM hourly
UNION ALL SELECT 'ts', count(*) FILTER (WHERE ts IS NULL), count(*) FROM hourly""")
def assert_no_nulls(spark, sf):
    checked = quality.assert_no_nulls(hourly(spark, sf), ["y", "ts"])
    return quality.null_rates(checked, ["y", "ts"])


@query("project_features", sql=f"""WITH {DAILY_EXOG} SELECT series_id, ts, round(y, 6) + 0.0 AS y, round(qty, 6) + 0.0 AS qty FROM daily_exog""")
def project_features(spark, sf):
    wanted = ["y", "qty"]
    return daily_exog(spark, sf).select("series_id", "ts", *[rnd(c).alias(c) for c in wanted])


@query("drop_sparse_columns", sql="""
SELECT event_id, value, CASE WHEN event_type <> 'error' THEN value END AS v_not_error FROM events""")
def drop_sparse_columns(spark, sf):
    ev = table(spark, sf, "events").select(
        "event_id", "value", F.when(F.col("event_type") == "error", F.col("value")).alias("v_error"),
        F.when(F.col("event_type") != "error", F.col("value")).alias("v_not_error"),
    )
    return quality.drop_sparse_columns(ev, ["value", "v_error", "v_not_error"])


@query("select_numeric", sql="SELECT event_id, user_id, value FROM events")
def select_numeric(spark, sf):
    return quality.select_numeric(table(spark, sf, "events"))


@query("rename_scale", sql="SELECT o_orderkey, round(o_totalprice / 1000, 6) + 0.0 AS load FROM orders")
def rename_scale(spark, sf):
    od = table(spark, sf, "orders").withColumnRenamed("o_totalprice", "load")
    return od.select("o_orderkey", rnd(F.col("load") / 1000).alias("load"))


@query("split_history_forecast", sql="""
SELECT event_id, ts, CASE WHEN ts < TIMESTAMP '2024-01-20 00:00:00' THEN 'history' ELSE 'forecast' END AS part FROM events""")
def split_history_forecast(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "ts")
    return split.split_history_forecast(ev, "ts", ts_lit("2024-01-20 00:00:00"))


@query("drop_null_rows", sql="""
WITH e AS (SELECT event_id, CASE WHEN event_type <> 'error' THEN value END AS a,
 CASE WHEN event_type IN ('click', 'view') THEN value END AS b FROM events)
SELECT 'any' AS how, event_id FROM e WHERE a IS NOT NULL AND b IS NOT NULL
UNION ALL SELECT 'all', event_id FROM e WHERE a IS NOT NULL OR b IS NOT NULL
UNION ALL SELECT 'subset', event_id FROM e WHERE b IS NOT NULL""")
def drop_null_rows(spark, sf):
    e = table(spark, sf, "events").select(
        "event_id", F.when(F.col("event_type") != "error", F.col("value")).alias("a"),
        F.when(F.col("event_type").isin("click", "view"), F.col("value")).alias("b"),
    )
    kept = {
        "any": e.na.drop("any", subset=["a", "b"]), "all": e.na.drop("all", subset=["a", "b"]),
        "subset": e.na.drop(subset=["b"]),
    }
    parts = [df.select(F.lit(how).alias("how"), "event_id") for how, df in kept.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("split_fraction", sql=f"""WITH {HOURLY},
n AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts) AS rn, count(*) OVER (PARTITION BY series_id) AS n FROM hourly)
SELECT series_id, ts, CASE WHEN rn <= floor(n * CAST(0.8 AS DOUBLE)) THEN 'train' ELSE 'test' END AS part FROM n""")
def split_fraction(spark, sf):
    return split.split_fraction(hourly(spark, sf), KEY, "idx", 0.8).select("series_id", "ts", "part")


@query("split_dates", sql=f"""WITH {HOURLY}
SELECT series_id, ts, CASE WHEN ts <= TIMESTAMP '2024-01-17 22:00:00' THEN 'train' ELSE 'test' END AS part FROM hourly
WHERE ts <= TIMESTAMP '2024-01-17 22:00:00' OR (ts >= TIMESTAMP '2024-01-18 00:00:00' AND ts <= TIMESTAMP '2024-01-21 00:00:00')""")
def split_dates(spark, sf):
    out = split.split_dates(
        hourly(spark, sf), "ts", ts_lit("2024-01-17 22:00:00"), ts_lit("2024-01-18 00:00:00"), 72
    )
    return out.select("series_id", "ts", "part")


@query("day_night_flag", sql=f"""WITH {HOURLY}
SELECT series_id, ts, CASE WHEN hour(ts) >= 6 AND hour(ts) < 18 THEN 1 ELSE 0 END AS day FROM hourly""")
def day_night_flag(spark, sf):
    return hourly(spark, sf).select("series_id", "ts", tm.day_flag("ts").alias("day"))


@query("staleness_check", sql="""
SELECT user_id, max(ts) AS newest, epoch(TIMESTAMP '2024-01-31 00:00:00') - floor(epoch(max(ts))) > 3 * 3600 AS stale
FROM events GROUP BY 1""")
def staleness_check(spark, sf):
    return quality.staleness(table(spark, sf, "events"), "user_id", "ts", ts_lit("2024-01-31 00:00:00"))


@query("coverage_check", sql="""
SELECT user_id, min(ts) AS oldest, min(ts) <= TIMESTAMP '2024-01-02 00:00:00' AS covered FROM events GROUP BY 1""")
def coverage_check(spark, sf):
    return quality.coverage(table(spark, sf, "events"), "user_id", "ts", ts_lit("2024-01-02 00:00:00"))
