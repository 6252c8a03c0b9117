"""Scans, sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tsfoundry.functions.time import DAY, HOUR, epoch, floor_ts, shift_ts, ts_lit
from tsfoundry.operators.features import add_calendar, add_lags
from tsfoundry.operators.metrics import pinball, point_errors
from tsfoundry.plans.panels import DAILY, HOURLY, KEY, daily, hourly, table
from tsfoundry.plans.registry import query, rnd
from tsfoundry.sources import files, landed, store
from tsfoundry.session import scratch_path

AS_OF = "1999-01-01 00:00:00"


@query("scan_target_csv", sql="""
SELECT date_trunc('hour', ts) AS ts, round(sum(value), 6) + 0.0 AS y FROM events GROUP BY 1""")
def scan_target_csv(spark, sf):
    ev = table(spark, sf, "events")
    path = scratch_path(spark, "target")
    series = ev.groupBy(floor_ts("ts", HOUR).alias("date_time_utc")).agg(F.sum("value").alias("total"))
    series.write.csv(path, header=True)
    schema = files.target_schema("date_time_utc", "total")
    return files.read_target_csv(spark, path, schema, "date_time_utc", "total").select("ts", rnd("y").alias("y"))


@query("scan_exog_csvs", sql=f"""
SELECT l_shipdate AS ts, round(sum(l_quantity), 6) + 0.0 AS qty, round(sum(l_discount), 6) + 0.0 AS disc,
 round(sum(l_tax), 6) + 0.0 AS tax, round(sum(l_extendedprice), 6) + 0.0 AS price
FROM lineitem GROUP BY 1""")
def scan_exog_csvs(spark, sf):
    li = table(spark, sf, "lineitem")
    by_day = li.groupBy(F.col("l_shipdate").alias("date"))
    parts = [
        ("w", by_day.agg(F.sum("l_quantity").alias("qty"), F.sum("l_discount").alias("disc"))),
        ("a", by_day.agg(F.sum("l_tax").alias("tax"), F.sum("l_extendedprice").alias("price"))),
    ]
    paths, schemas = [], []
    for name, df in parts:
        for side, keep in (("hist", F.col("date") < ts_lit(AS_OF)), ("fcst", F.col("date") >= ts_lit(AS_OF))):
            path = scratch_path(spark, f"{name}-{side}")
            df.filter(keep).write.csv(path, header=True)
            paths.append(path)
            schemas.append(T.StructType([
                T.StructField("date", T.TimestampNTZType()),
                *[T.StructField(c, T.DoubleType()) for c in df.columns[1:]],
            ]))
    wide = files.read_covariates(spark, paths, schemas, "date")
    return wide.select("ts", rnd("qty").alias("qty"), rnd("disc").alias("disc"), rnd("tax").alias("tax"), rnd("price").alias("price"))


@query("parse_epoch_series_json", sql="""
SELECT event_id, date_trunc('second', ts) AS ts, value FROM events
UNION ALL SELECT event_id, date_trunc('second', ts) + INTERVAL 1 HOUR, NULL FROM events""")
def parse_epoch_series_json(spark, sf):
    ms = (epoch("ts") * 1000 + 123).cast("string")
    later = ((epoch("ts") + HOUR) * 1000 + 999).cast("string")
    payload = F.concat(
        F.lit('{"series":[['), ms, F.lit(","), F.col("value").cast("string"), F.lit("],["),
        later, F.lit(",null]]}"),
    )
    docs = table(spark, sf, "events").select("event_id", payload.alias("payload"))
    return landed.parse_epoch_series(docs, "payload", ["event_id"])


@query("parse_props_json", sql="""
SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events""")
def parse_props_json(spark, sf):
    return table(spark, sf, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("parse_delimited_null", sql="""
SELECT o_orderkey, strftime(o_orderdate, '%d.%m.%Y') AS date, lpad(CAST(l_linenumber AS VARCHAR), 2, '0') || ':00' AS time,
 CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice END AS value
FROM orders JOIN lineitem ON o_orderkey = l_orderkey""")
def parse_delimited_null(spark, sf):
    od, li = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    rows = od.join(li, od.o_orderkey == li.l_orderkey)
    value = F.when(F.col("o_orderstatus") == "P", "-").otherwise(F.col("o_totalprice").cast("string"))
    line = F.concat_ws(
        ";", F.date_format("o_orderdate", "dd.MM.yyyy"),
        F.concat(F.lit("'"), F.lpad(F.col("l_linenumber").cast("string"), 2, "0"), F.lit(":00'")), value,
    )
    footer = od.groupBy("o_orderkey").agg(F.lit("generated;on request;-").alias("line"))
    lines = rows.select("o_orderkey", line.alias("line")).unionByName(footer)
    parsed = lines.select("o_orderkey", files.parse_delimited(F.col("line")).alias("p")).select("o_orderkey", "p.*")
    return files.tidy_delimited(parsed)


@query("parse_daily_rows_json", sql="""
SELECT o_orderkey, o_orderdate + to_hours(row_number() OVER (PARTITION BY o_orderdate ORDER BY o_orderkey) - 1) AS ts,
 o_totalprice AS value FROM orders""")
def parse_daily_rows_json(spark, sf):
    row = F.concat(
        F.lit('["'), F.date_format("o_orderdate", "MM/dd/yyyy"), F.lit('","'),
        F.col("o_totalprice").cast("string"), F.lit('"]'),
    )
    docs = table(spark, sf, "orders").select("o_orderkey", F.from_json(row, "array<string>").alias("r"))
    rows = docs.select("o_orderkey", F.col("r")[0].alias("date"), F.col("r")[1].alias("count"))
    return landed.parse_daily_rows(rows, "date", "count", "o_orderkey")


@query("parquet_roundtrip", sql=f"WITH {HOURLY} SELECT series_id, ts, round(y, 6) + 0.0 AS y FROM hourly")
def parquet_roundtrip(spark, sf):
    back = store.write_table(hourly(spark, sf), scratch_path(spark, "roundtrip"))
    return back.select("series_id", "ts", rnd("y").alias("y"))


@query("write_feature_store", sql=f"""WITH {DAILY}
SELECT series_id, ts, round(y, 6) + 0.0 AS y, CAST(isodow(ts) - 1 AS INTEGER) AS weekday,
 round(lag(y, 7) OVER (PARTITION BY series_id ORDER BY ts), 6) + 0.0 AS lag_7 FROM daily""")
def write_feature_store(spark, sf):
    root, config = scratch_path(spark, "features"), {"lags": [7], "calendar": ["weekday"]}

    def build():
        lagged = add_lags(daily(spark, sf), KEY, "idx", "y", [7])
        return add_calendar(lagged, "ts", ["weekday"])

    store.feature_store(spark, root, config, build, ["series_id"])
    reused = store.feature_store(spark, root, config, build, ["series_id"])
    return reused.select("series_id", "ts", rnd("y").alias("y"), "weekday", rnd("lag_7").alias("lag_7"))


_NAIVE = f"""WITH {DAILY},
f AS (SELECT series_id, ts, y, lag(y, 7) OVER (PARTITION BY series_id ORDER BY ts) AS yhat FROM daily)"""


def _lag_forecast(spark, sf):
    lagged = add_lags(daily(spark, sf), KEY, "idx", "y", [7])
    return lagged.select("series_id", "ts", "y", F.col("lag_7").alias("yhat"))


@query("write_stats_tables", sql=_NAIVE + """
SELECT 'mae' AS metric, series_id, round(avg(abs(yhat - y)), 6) + 0.0 AS value FROM f WHERE yhat IS NOT NULL GROUP BY series_id
UNION ALL SELECT 'rmse', series_id, round(sqrt(avg((yhat - y) * (yhat - y))), 6) + 0.0 FROM f WHERE yhat IS NOT NULL GROUP BY series_id""")
def write_stats_tables(spark, sf):
    errors = point_errors(_lag_forecast(spark, sf), KEY, "y", "yhat")
    long = errors.unpivot(["series_id"], ["mae", "rmse"], "metric", "value")
    back = store.write_table(long, scratch_path(spark, "stats"), ["metric"])
    return back.select("metric", "series_id", rnd("value").alias("value"))


@query("write_predictions", sql=_NAIVE + """
SELECT 'naive' AS run_id, series_id, ts, round(y, 6) + 0.0 AS y, round(yhat, 6) + 0.0 AS yhat, CAST(isodow(ts) - 1 AS INTEGER) AS fold
FROM f WHERE yhat IS NOT NULL""")
def write_predictions(spark, sf):
    path = scratch_path(spark, "predictions")

    def build():
        return _lag_forecast(spark, sf).filter(F.col("yhat").isNotNull()).select(
            F.lit("naive").alias("run_id"), "series_id", "ts", "y", "yhat", F.weekday("ts").alias("fold")
        )

    store.read_or_build(spark, path, build, ["run_id", "fold"])
    kept = store.read_or_build(spark, path, build, ["run_id", "fold"])
    return kept.select("run_id", "series_id", "ts", rnd("y").alias("y"), rnd("yhat").alias("yhat"), "fold")


@query("idempotent_runs", sql="""
SELECT DISTINCT o_orderpriority AS dataset, o_orderstatus AS model, CAST(year(o_orderdate) AS INTEGER) AS version
FROM orders o WHERE NOT EXISTS (SELECT 1 FROM orders p WHERE p.o_orderpriority = o.o_orderpriority
 AND p.o_orderstatus = o.o_orderstatus AND year(p.o_orderdate) = year(o.o_orderdate) AND p.o_totalprice > 499000)""")
def idempotent_runs(spark, sf):
    od = table(spark, sf, "orders")
    runs = od.select(
        F.col("o_orderpriority").alias("dataset"), F.col("o_orderstatus").alias("model"),
        F.year("o_orderdate").alias("version"), "o_totalprice",
    )
    on = ["dataset", "model", "version"]
    finished = runs.filter(F.col("o_totalprice") > 499000).select(*on).distinct()
    return store.pending_runs(runs.select(*on).distinct(), finished, on)


@query("tail_weeks", sql="""
WITH s AS (SELECT date_trunc('week', o_orderdate) AS slice, max(o_orderdate) AS newest, count(*) AS n FROM orders GROUP BY 1),
p AS (SELECT max(o_orderdate) AS as_of FROM orders),
q AS (SELECT max(o_orderdate) AS newest FROM orders WHERE o_totalprice > 499000),
w AS (SELECT *, CAST(floor((epoch(as_of) - epoch(q.newest)) / 604800) AS BIGINT) + 2 AS weeks,
 CAST(floor((epoch(as_of) - epoch(slice)) / 604800) AS BIGINT) AS r FROM s, p, q)
SELECT slice, n FROM w WHERE r >= 0 AND r < weeks""")
def tail_weeks(spark, sf):
    od = table(spark, sf, "orders")
    monday = shift_ts("o_orderdate", -(F.weekday("o_orderdate").cast("long") * DAY))
    slices = od.groupBy(monday.alias("slice")).agg(F.count(F.lit(1)).alias("n"))
    bounds = od.agg(
        F.max("o_orderdate").alias("as_of"),
        F.max(F.when(F.col("o_totalprice") > 499000, F.col("o_orderdate"))).alias("newest"),
    )
    joined = slices.crossJoin(F.broadcast(bounds))  # one row of bounds
    return landed.tail_slices(joined, "slice", F.col("newest"), F.col("as_of")).select("slice", "n")
