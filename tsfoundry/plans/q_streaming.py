"""Streaming queries: each drains its stream into a table in the shared folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from tsfoundry.functions.time import HOUR, floor_ts, ts_lit
from tsfoundry.operators.models.linear_quantile import LinearQuantile
from tsfoundry.operators.models.naive import quantile_column
from tsfoundry.plans.panels import table
from tsfoundry.plans.q_models import FEATURES, train_test
from tsfoundry.plans.registry import query, rnd
from tsfoundry.session import scratch_path
from tsfoundry.sources.store import write_table
from tsfoundry.streaming import incremental as inc


def _events(spark, sf):
    return inc.stream_table(spark, sf, "events", table(spark, sf, "events").schema)


@query("stream_hourly", sql="""
WITH m AS (SELECT max(ts) - INTERVAL 2 HOUR AS w FROM events)
SELECT event_type AS series_id, date_trunc('hour', ts) AS ts, round(sum(value), 6) + 0.0 AS y FROM events, m
GROUP BY 1, 2 HAVING date_trunc('hour', events.ts) + INTERVAL 1 HOUR <= any_value(w)""")
def stream_hourly(spark, sf):
    sums = inc.hourly_totals(_events(spark, sf), ["event_type"], "ts", "value")
    out = inc.run_to_table(sums, scratch_path(spark, "hourly"), scratch_path(spark, "hourly-ck"))
    return out.select(F.col("event_type").alias("series_id"), F.col("ts").cast("timestamp_ntz").alias("ts"), rnd("y").alias("y"))


@query("stream_upsert", sql="""
SELECT event_type, date_trunc('hour', ts) AS hour, min(event_id) AS event_id, arg_min(value, event_id) AS value FROM events GROUP BY 1, 2""")
def stream_upsert(spark, sf):
    rows = _events(spark, sf).select("event_type", floor_ts("ts", HOUR).alias("hour"), "event_id", "value")
    root, checkpoint = scratch_path(spark, "upsert"), scratch_path(spark, "upsert-ck")
    merged = inc.upsert(rows, ["event_type"], "hour", root, checkpoint, tiebreak=[F.col("event_id")])
    return merged.select("event_type", "hour", "event_id", "value")


@query("stream_split", sql="""
SELECT event_id, CASE WHEN ts < TIMESTAMP '2024-01-20 00:00:00' THEN 'history' ELSE 'forecast' END AS part FROM events""")
def stream_split(spark, sf):
    marked = inc.split_by(_events(spark, sf), "ts", ts_lit("2024-01-20 00:00:00")).select("event_id", "part")
    return inc.run_to_table(marked, scratch_path(spark, "split"), scratch_path(spark, "split-ck"))


@query("stream_score")
def stream_score(spark, sf):
    """A fitted model applied to a stream of feature rows: no state, no join."""
    train, test = train_test(spark, sf)
    model = LinearQuantile(FEATURES, quantiles=(0.25, 0.5, 0.75)).fit(train)
    landed = scratch_path(spark, "features")
    written = write_table(test, landed)
    stream = spark.readStream.schema(written.schema).parquet(landed)
    scored = model.transform(stream).select("series_id", "ts", "y", *[quantile_column(q) for q in model.quantiles])
    return inc.run_to_table(scored, scratch_path(spark, "scored"), scratch_path(spark, "scored-ck"))
