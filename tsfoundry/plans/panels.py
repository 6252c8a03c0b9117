"""Panels derived from the given tables, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tsfoundry.functions.time import DAY, HOUR
from tsfoundry.operators.resample import resample

KEY = ["series_id"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hourly(spark: SparkSession, sf_dir: str, fill: float | None = 0.0) -> DataFrame:
    """Hourly event value per event type."""
    ev = table(spark, sf_dir, "events").select(F.col("event_type").alias("series_id"), "ts", "value")
    return resample(ev, KEY, "ts", HOUR, {"y": ("sum", "value")}, fill)


def user_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly event value per user, with gaps left null."""
    ev = table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("series_id"), "ts", "value"
    )
    return resample(ev, KEY, "ts", HOUR, {"y": ("sum", "value")}, None)


def daily(spark: SparkSession, sf_dir: str, fill: float | None = 0.0) -> DataFrame:
    """Daily order value per order priority, in thousands."""
    od = table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("series_id"), F.col("o_orderdate").alias("ts"),
        (F.col("o_totalprice") / 1000).alias("v"),
    )
    return resample(od, KEY, "ts", DAY, {"y": ("sum", "v")}, fill)


def daily_exog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily price total with quantity, discount and tax totals as covariates, per return flag."""
    li = table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("series_id"), F.col("l_shipdate").alias("ts"),
        (F.col("l_extendedprice") / 1000).alias("price"), "l_quantity", "l_discount", "l_tax",
    )
    aggs = {
        "y": ("sum", "price"), "qty": ("sum", "l_quantity"),
        "disc": ("sum", "l_discount"), "tax": ("sum", "l_tax"),
    }
    return resample(li, KEY, "ts", DAY, aggs, 0.0)


def _grid_sql(name: str, src: str, sid: str, ts: str, unit: str, value: str, fill: bool) -> str:
    y = "coalesce(a.y, 0.0)" if fill else "a.y"
    return f"""
{name}_r AS (SELECT {sid} AS series_id, date_trunc('{unit}', {ts}) AS ts, {value} AS v FROM {src}),
{name}_a AS (SELECT series_id, ts, sum(v) AS y FROM {name}_r GROUP BY 1, 2),
{name}_b AS (SELECT series_id, min(ts) AS lo, max(ts) AS hi FROM {name}_r GROUP BY 1),
{name}_g AS (SELECT series_id, unnest(generate_series(lo, hi, INTERVAL 1 {unit})) AS ts FROM {name}_b),
{name} AS (SELECT g.series_id, g.ts, {y} AS y FROM {name}_g g LEFT JOIN {name}_a a
           ON a.series_id = g.series_id AND a.ts = g.ts)"""


#: Common table expressions; start a query with ``WITH`` and join them by commas.
HOURLY = _grid_sql("hourly", "events", "event_type", "ts", "hour", "value", True)
HOURLY_NULL = _grid_sql("hourly", "events", "event_type", "ts", "hour", "value", False)
USER_HOURLY = _grid_sql("user_hourly", "events", "CAST(user_id AS VARCHAR)", "ts", "hour", "value", False)
DAILY = _grid_sql("daily", "orders", "o_orderpriority", "o_orderdate", "day", "o_totalprice / 1000", True)
DAILY_NULL = _grid_sql("daily", "orders", "o_orderpriority", "o_orderdate", "day", "o_totalprice / 1000", False)
DAILY_EXOG = """
dx_a AS (SELECT l_returnflag AS series_id, date_trunc('day', l_shipdate) AS ts,
         sum(l_extendedprice / 1000) AS y, sum(l_quantity) AS qty, sum(l_discount) AS disc, sum(l_tax) AS tax
         FROM lineitem GROUP BY 1, 2),
dx_b AS (SELECT series_id, min(ts) AS lo, max(ts) AS hi FROM dx_a GROUP BY 1),
dx_g AS (SELECT series_id, unnest(generate_series(lo, hi, INTERVAL 1 day)) AS ts FROM dx_b),
daily_exog AS (SELECT g.series_id, g.ts, coalesce(a.y, 0.0) AS y, coalesce(a.qty, 0.0) AS qty,
         coalesce(a.disc, 0.0) AS disc, coalesce(a.tax, 0.0) AS tax
         FROM dx_g g LEFT JOIN dx_a a ON a.series_id = g.series_id AND a.ts = g.ts)"""
