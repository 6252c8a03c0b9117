"""Joins, set operations and incremental merges."""

from __future__ import annotations

from pyspark.sql import functions as F

from tsfoundry.functions.time import DAY, ts_lit
from tsfoundry.operators import align
from tsfoundry.operators.lookup import attach
from tsfoundry.operators.resample import regular_grid, resample
from tsfoundry.plans.panels import (
    DAILY, DAILY_EXOG, HOURLY, KEY, daily, daily_exog, hourly, table,
)
from tsfoundry.plans.registry import query, rnd

ON = ["series_id", "ts"]
AS_OF = "1998-06-01 00:00:00"


@query("left_join_exog", sql="""
WITH t AS (SELECT o_orderstatus AS series_id, o_orderdate AS ts, sum(o_totalprice) AS y FROM orders GROUP BY 1, 2),
x AS (SELECT l_linestatus AS series_id, l_shipdate AS ts, sum(l_quantity) AS qty FROM lineitem GROUP BY 1, 2)
SELECT t.series_id, t.ts, round(y, 4) + 0.0 AS y, round(qty, 4) + 0.0 AS qty FROM t LEFT JOIN x ON x.series_id = t.series_id AND x.ts = t.ts""")
def left_join_exog(spark, sf):
    target = table(spark, sf, "orders").groupBy(
        F.col("o_orderstatus").alias("series_id"), F.col("o_orderdate").alias("ts")
    ).agg(F.sum("o_totalprice").alias("y"))
    exog = table(spark, sf, "lineitem").groupBy(
        F.col("l_linestatus").alias("series_id"), F.col("l_shipdate").alias("ts")
    ).agg(F.sum("l_quantity").alias("qty"))
    return align.left_join_exog(target, exog, ON).select("series_id", "ts", rnd("y", 4).alias("y"), rnd("qty", 4).alias("qty"))


@query("outer_align", sql="""
WITH a AS (SELECT o_orderdate AS ts, sum(o_totalprice) AS a FROM orders GROUP BY 1),
b AS (SELECT l_shipdate AS ts, sum(l_quantity) AS b FROM lineitem GROUP BY 1),
c AS (SELECT date_trunc('day', ts) AS ts, sum(value) AS c FROM events GROUP BY 1)
SELECT ts, round(a, 4) + 0.0 AS a, round(b, 4) + 0.0 AS b, round(c, 4) + 0.0 AS c
FROM a FULL JOIN b USING (ts) FULL JOIN c USING (ts)""")
def outer_align(spark, sf):
    a = table(spark, sf, "orders").groupBy(F.col("o_orderdate").alias("ts")).agg(F.sum("o_totalprice").alias("a"))
    b = table(spark, sf, "lineitem").groupBy(F.col("l_shipdate").alias("ts")).agg(F.sum("l_quantity").alias("b"))
    ev = table(spark, sf, "events").select("ts", "value")
    c = resample(ev, [], "ts", DAY, {"c": ("sum", "value")}, None).select("ts", "c")
    out = align.outer_align([a, b, c], ["ts"])
    return out.select("ts", *[rnd(x, 4).alias(x) for x in "abc"])


_HIST_FCST = f"""WITH {DAILY_EXOG},
hist AS (SELECT series_id, ts, CASE WHEN day(ts) = 15 THEN NULL ELSE qty END AS qty, tax FROM daily_exog WHERE ts < TIMESTAMP '{AS_OF}' + INTERVAL 7 DAY),
fcst AS (SELECT series_id, ts, qty + 1 AS qty, y AS price FROM daily_exog WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY)"""


def _hist_fcst(spark, sf):
    x = daily_exog(spark, sf)
    hist = x.filter(F.col("ts") < F.expr(f"timestamp_ntz'{AS_OF}' + interval 7 days")).select(
        "series_id", "ts", F.when(F.dayofmonth("ts") != 15, F.col("qty")).alias("qty"), "tax"
    )
    fcst = x.filter(F.col("ts") >= F.expr(f"timestamp_ntz'{AS_OF}' - interval 30 days")).select(
        "series_id", "ts", (F.col("qty") + 1).alias("qty"), F.col("y").alias("price")
    )
    return hist, fcst


@query("combine_first", sql=_HIST_FCST + """
SELECT series_id, ts, round(coalesce(h.qty, f.qty), 6) + 0.0 AS qty, round(h.tax, 6) + 0.0 AS tax, round(f.price, 6) + 0.0 AS price
FROM hist h FULL JOIN fcst f USING (series_id, ts)""")
def combine_first(spark, sf):
    hist, fcst = _hist_fcst(spark, sf)
    out = align.combine_first(hist, fcst, ON)
    return out.select(*ON, *[rnd(c).alias(c) for c in ("qty", "tax", "price")])


@query("inner_align_range", sql=f"""WITH {DAILY}, {DAILY_EXOG},
o AS (SELECT ts, sum(y) AS y FROM daily GROUP BY 1), x AS (SELECT ts, sum(qty) AS qty FROM daily_exog GROUP BY 1)
SELECT o.ts, round(y, 6) + 0.0 AS y, round(qty, 6) + 0.0 AS qty FROM o JOIN x ON x.ts = o.ts
WHERE o.ts BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1999-12-31'""")
def inner_align_range(spark, sf):
    o = daily(spark, sf).groupBy("ts").agg(F.sum("y").alias("y"))
    x = daily_exog(spark, sf).groupBy("ts").agg(F.sum("qty").alias("qty"))
    out = align.inner_align_range(o, x, ["ts"], "ts", ts_lit("1996-01-01"), ts_lit("1999-12-31"))
    return out.select("ts", rnd("y").alias("y"), rnd("qty").alias("qty"))


_TWO_DATES = """WITH a AS (SELECT o_orderstatus AS series_id, o_orderdate AS ts, count(*) AS n FROM orders GROUP BY 1, 2),
b AS (SELECT l_linestatus AS series_id, l_shipdate AS ts, count(*) AS n FROM lineitem GROUP BY 1, 2)"""


def _two_sides(spark, sf):
    a = table(spark, sf, "orders").groupBy(
        F.col("o_orderstatus").alias("series_id"), F.col("o_orderdate").alias("ts")
    ).agg(F.count(F.lit(1)).alias("n"))
    b = table(spark, sf, "lineitem").groupBy(
        F.col("l_linestatus").alias("series_id"), F.col("l_shipdate").alias("ts")
    ).agg(F.count(F.lit(1)).alias("n"))
    return a, b


@query("semi_align", sql=_TWO_DATES + """
SELECT 'left' AS side, a.* FROM a WHERE EXISTS (SELECT 1 FROM b WHERE b.series_id = a.series_id AND b.ts = a.ts)
UNION ALL SELECT 'right', b.* FROM b WHERE EXISTS (SELECT 1 FROM a WHERE b.series_id = a.series_id AND b.ts = a.ts)""")
def semi_align(spark, sf):
    left, right = align.semi_align(*_two_sides(spark, sf), ON)
    return left.select(F.lit("left").alias("side"), *ON, "n").unionByName(
        right.select(F.lit("right").alias("side"), *ON, "n")
    )


@query("intersect_ts", sql=_TWO_DATES + " SELECT series_id, ts FROM a INTERSECT SELECT series_id, ts FROM b")
def intersect_ts(spark, sf):
    a, b = _two_sides(spark, sf)
    return a.select(*ON).intersect(b.select(*ON))


@query("calendar_reindex", sql="""
WITH a AS (SELECT user_id, date_trunc('hour', ts) AS ts, sum(value) AS y FROM events GROUP BY 1, 2),
b AS (SELECT user_id, min(ts) AS lo, max(ts) AS hi FROM a GROUP BY 1),
g AS (SELECT user_id, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS ts FROM b)
SELECT user_id, ts, round(y, 6) + 0.0 AS y FROM g LEFT JOIN a USING (user_id, ts)""")
def calendar_reindex(spark, sf):
    from tsfoundry.functions.time import HOUR, step_index

    rows = table(spark, sf, "events").groupBy("user_id", step_index("ts", HOUR).alias("idx")).agg(
        F.sum("value").alias("y")
    )
    return regular_grid(rows, ["user_id"], "idx", HOUR).select("user_id", "ts", rnd("y").alias("y"))


#: German national holidays for the span of the orders table, as a SQL table.
HOLIDAYS = """
yr AS (SELECT unnest(generate_series((SELECT year(min(ts)) - 1 FROM daily), (SELECT year(max(ts)) + 1 FROM daily))) AS y),
c1 AS (SELECT y, y % 19 AS a, y // 100 AS b, y % 100 AS c FROM yr),
c2 AS (SELECT *, (19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30 AS h FROM c1),
c3 AS (SELECT *, (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7 AS l FROM c2),
c4 AS (SELECT *, h + l - 7 * ((a + 11 * h + 22 * l) // 451) + 114 AS t FROM c3),
c5 AS (SELECT y, make_date(y, t // 31, t % 31 + 1) AS easter FROM c4),
hol AS (SELECT DISTINCT unnest([make_date(y, 1, 1), make_date(y, 5, 1), make_date(y, 10, 3), make_date(y, 12, 25),
  make_date(y, 12, 26), easter - 2, easter + 1, easter + 39, easter + 50]) AS d FROM c5)"""


@query("holiday_flag", sql=f"""WITH {DAILY}, {HOLIDAYS}
SELECT series_id, ts, CASE WHEN d IS NULL THEN 0 ELSE 1 END AS is_holiday FROM daily LEFT JOIN hol ON d = CAST(ts AS DATE)""")
def holiday_flag(spark, sf):
    panel = daily(spark, sf)
    return align.holiday_flag(panel, align.holidays_around(panel, "ts"), "ts").select("series_id", "ts", "is_holiday")


@query("holiday_proximity", sql=f"""WITH {DAILY}, {HOLIDAYS},
dd AS (SELECT series_id, ts, CAST(ts AS DATE) AS day FROM daily),
p AS (SELECT dd.*, hol.d AS prev FROM dd ASOF LEFT JOIN hol ON dd.day >= hol.d),
n AS (SELECT p.*, hol.d AS nxt FROM p ASOF LEFT JOIN hol ON p.day <= hol.d)
SELECT series_id, ts, CAST(coalesce(day - prev, 0) AS INTEGER) AS days_since_holiday,
 CAST(coalesce(nxt - day, 0) AS INTEGER) AS days_until_holiday FROM n""")
def holiday_proximity(spark, sf):
    panel = daily(spark, sf)
    out = align.holiday_proximity(panel, align.holidays_around(panel, "ts"), "ts")
    return out.select("series_id", "ts", "days_since_holiday", "days_until_holiday")


@query("lag_join", sql=f"""WITH {HOURLY}
SELECT a.series_id, a.ts, round(b.y, 6) + 0.0 AS lag_24, round(c.y, 6) + 0.0 AS lag_168 FROM hourly a
LEFT JOIN hourly b ON b.series_id = a.series_id AND b.ts = a.ts - INTERVAL 24 HOUR
LEFT JOIN hourly c ON c.series_id = a.series_id AND c.ts = a.ts - INTERVAL 168 HOUR""")
def lag_join(spark, sf):
    panel = hourly(spark, sf)
    out = align.lag_join(align.lag_join(panel, KEY, "idx", "y", 24, "lag_24"), KEY, "idx", "y", 168, "lag_168")
    return out.select("series_id", "ts", rnd("lag_24").alias("lag_24"), rnd("lag_168").alias("lag_168"))


@query("recurrence_band_join", sql=f"""WITH {HOURLY},
m AS (SELECT series_id, min(y) AS lo, max(y) AS hi FROM hourly GROUP BY 1),
s AS (SELECT h.series_id, ts, (y - lo) / (hi - lo) AS x FROM hourly h JOIN m ON m.series_id = h.series_id),
n AS (SELECT series_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.series_id, count(*) AS pairs FROM s a JOIN s b ON a.series_id = b.series_id AND a.ts <> b.ts
 AND b.x > a.x - CAST(0.1 AS DOUBLE) AND b.x < a.x + CAST(0.1 AS DOUBLE) GROUP BY 1)
SELECT n.series_id, pairs, n, round(pairs / (CAST(n AS DOUBLE) * (n - 1)), 9) + 0.0 AS rate FROM n JOIN p ON p.series_id = n.series_id""")
def recurrence_band_join(spark, sf):
    panel = hourly(spark, sf)
    span = panel.groupBy("series_id").agg(F.min("y").alias("lo"), F.max("y").alias("hi"))
    unit = attach(panel, span, KEY).select(
        "series_id", ((F.col("y") - F.col("lo")) / (F.col("hi") - F.col("lo"))).alias("x")
    )
    out = align.band_counts(unit, KEY, "x", 0.1)
    rate = F.col("pairs") / (F.col("n").cast("double") * (F.col("n") - 1))
    return out.select("series_id", "pairs", "n", rnd(rate, 9).alias("rate"))


@query("station_hourly_mean", sql="""
WITH u AS (SELECT o_orderdate AS ts, o_totalprice AS price, NULL::DOUBLE AS qty FROM orders
 UNION ALL SELECT l_shipdate, l_extendedprice, l_quantity FROM lineitem)
SELECT ts, round(avg(price), 7) + 0.0 AS price, round(avg(qty), 7) + 0.0 AS qty FROM u GROUP BY 1""")
def station_hourly_mean(spark, sf):
    a = table(spark, sf, "orders").select(F.col("o_orderdate").alias("ts"), F.col("o_totalprice").alias("price"))
    b = table(spark, sf, "lineitem").select(
        F.col("l_shipdate").alias("ts"), F.col("l_extendedprice").alias("price"), F.col("l_quantity").alias("qty")
    )
    out = align.station_mean([a, b], ["ts"])
    return out.select("ts", rnd("price", 7).alias("price"), rnd("qty", 7).alias("qty"))


@query("union_stations", sql="""
SELECT 'customer' AS source, c_custkey AS id, c_acctbal AS bal, c_mktsegment AS segment FROM customer
UNION ALL SELECT 'supplier', s_suppkey, s_acctbal, NULL FROM supplier""")
def union_stations(spark, sf):
    c = table(spark, sf, "customer").select(
        F.lit("customer").alias("source"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("bal"),
        F.col("c_mktsegment").alias("segment"),
    )
    s = table(spark, sf, "supplier").select(
        F.lit("supplier").alias("source"), F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("bal")
    )
    return c.unionByName(s, allowMissingColumns=True)


@query("append_dedupe", sql=_HIST_FCST + """
SELECT series_id, ts, round(h.qty, 6) + 0.0 AS qty FROM hist h
UNION ALL SELECT series_id, ts, round(f.qty, 6) + 0.0 FROM fcst f WHERE NOT EXISTS
 (SELECT 1 FROM hist h WHERE h.series_id = f.series_id AND h.ts = f.ts)""")
def append_dedupe(spark, sf):
    hist, fcst = _hist_fcst(spark, sf)
    out = align.append_dedupe(hist.select(*ON, "qty"), fcst.select(*ON, "qty"), ON)
    return out.select(*ON, rnd("qty").alias("qty"))


@query("dedupe_keep_first", sql="""
SELECT o_orderpriority AS series_id, o_orderdate AS ts, o_orderkey, o_totalprice AS y FROM orders
QUALIFY row_number() OVER (PARTITION BY o_orderpriority, o_orderdate ORDER BY o_orderkey) = 1""")
def dedupe_keep_first(spark, sf):
    rows = table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("series_id"), F.col("o_orderdate").alias("ts"), "o_orderkey",
        F.col("o_totalprice").alias("y"),
    )
    return align.keep_first(rows, ON, [F.col("o_orderkey")])


@query("dup_keep_last_mask", sql="""
SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderpriority, o_orderdate ORDER BY o_orderkey DESC) > 1 AS duplicate FROM orders""")
def dup_keep_last_mask(spark, sf):
    rows = table(spark, sf, "orders")
    marked = align.mark_all_but_last(rows, ["o_orderpriority", "o_orderdate"], [F.col("o_orderkey")], "duplicate")
    return marked.select("o_orderkey", "duplicate")


@query("missing_columns", sql="""
SELECT DISTINCT p_brand AS feature FROM part WHERE p_size > 25 EXCEPT SELECT p_brand FROM part WHERE p_retailprice > 1900""")
def missing_columns(spark, sf):
    part = table(spark, sf, "part")
    required = part.filter(F.col("p_size") > 25).select(F.col("p_brand").alias("feature")).distinct()
    present = part.filter(F.col("p_retailprice") > 1900).select(F.col("p_brand").alias("feature")).distinct()
    return required.exceptAll(present)


@query("sort_ts", sql=f"WITH {HOURLY} SELECT series_id, ts, round(y, 6) + 0.0 AS y FROM hourly ORDER BY series_id, ts")
def sort_ts(spark, sf):
    return hourly(spark, sf).select("series_id", "ts", rnd("y").alias("y")).orderBy("series_id", "ts")


@query("first_last_ts", sql=f"WITH {HOURLY} SELECT series_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM hourly GROUP BY 1")
def first_last_ts(spark, sf):
    return hourly(spark, sf).groupBy("series_id").agg(
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("n")
    )
