from pyspark.sql import functions as F

from tsfoundry.streaming import incremental as inc

SCHEMA = "sid string, ts timestamp_ntz, n int, v double"


def land(spark, path, rows):
    df = spark.createDataFrame(rows, "sid string, t string, n int, v double")
    df.select("sid", F.col("t").cast("timestamp_ntz").alias("ts"), "n", "v").coalesce(1).write.mode("append").parquet(path)


def test_upsert_keeps_old_rows_and_other_days(spark, tmp_path):
    src, root, ck = [str(tmp_path / d) for d in ("src", "root", "ck")]
    land(spark, src, [("a", "2024-01-01 00:00:00", 1, 1.0), ("a", "2024-01-02 00:00:00", 2, 2.0)])

    def run():
        stream = spark.readStream.schema(SCHEMA).parquet(src)
        out = inc.upsert(stream, ["sid"], "ts", root, ck, tiebreak=[F.col("n")])
        return sorted((r.sid, r.n, r.v) for r in out.collect())

    assert run() == [("a", 1, 1.0), ("a", 2, 2.0)]
    land(spark, src, [("a", "2024-01-02 00:00:00", 3, 9.0), ("b", "2024-01-02 00:00:00", 5, 5.0), ("b", "2024-01-02 00:00:00", 4, 4.0)])
    assert run() == [("a", 1, 1.0), ("a", 2, 2.0), ("b", 4, 4.0)]
    assert run() == [("a", 1, 1.0), ("a", 2, 2.0), ("b", 4, 4.0)]


def test_only_closed_hours_are_final(spark, tmp_path):
    src = str(tmp_path / "src")
    land(spark, src, [("a", "2024-01-01 00:10:00", 1, 1.0), ("a", "2024-01-01 00:50:00", 2, 2.0), ("a", "2024-01-01 03:30:00", 3, 9.0)])
    sums = inc.hourly_totals(spark.readStream.schema(SCHEMA).parquet(src), ["sid"], "ts", "v")
    out = inc.run_to_table(sums, str(tmp_path / "out"), str(tmp_path / "ck"))
    assert [(r.sid, r.y) for r in out.collect()] == [("a", 3.0)]
