"""Streams over small files: deduplication, alerts, debounce and the rate limiter."""

import datetime as dt

from pyspark.sql import functions as F

from quarrylens.streaming import watch


def stream(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(schema).parquet(str(folder))


def run(spark, df, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name).collect()


T0 = dt.datetime(2024, 1, 1)


def at(s):
    return T0 + dt.timedelta(seconds=s)


def test_repeats_are_dropped_and_alerts_filtered(spark, tmp_path):
    lines = stream(spark, tmp_path / "in", [("8.8.8.8 seen", at(1)), ("8.8.8.8 again 8.8.8.8", at(2)), ("visit evil.com", at(3))], "value string, ts timestamp")
    got = []
    judge = lambda df: df.withColumn("verdict", F.when(F.col("value") == "evil.com", "malicious").otherwise("benign"))
    q = watch.alerts(lines, judge, "suspicious", lambda df, _: got.extend(df.collect()), str(tmp_path / "cp"), trigger="0 seconds")
    q.processAllAvailable()
    q.stop()
    assert [(r["value"], r["line"]) for r in got] == [("evil.com", "visit evil.com")]
    found = run(spark, watch.indicators(lines), "found")
    assert sorted(r["value"] for r in found) == ["8.8.8.8", "evil.com"]


def test_debounce_by_silence_and_by_number(spark, tmp_path):
    rows = [("ipv4", f"v{i}", at(i * 0.1)) for i in range(5)] + [("ipv4", "late", at(60))]
    found = stream(spark, tmp_path / "in", rows, "type string, value string, ts timestamp").withWatermark("ts", "0 seconds")
    assert [r["values"] for r in run(spark, watch.debounce(found), "quiet")][0] == [f"v{i}" for i in range(5)]
    assert [r["n"] for r in run(spark, watch.debounce(found, most=2), "full")][:2] == [2, 2]


def test_rate_limit_window_starts_at_the_first_request(spark, tmp_path):
    rows = [("a", at(s)) for s in (5, 10, 20, 64, 66)] + [("b", at(7))]
    requests = stream(spark, tmp_path / "in", rows, "id string, ts timestamp").withWatermark("ts", "0 seconds")
    got = sorted((r["id"], (r["ts"] - T0).seconds, r["allowed"]) for r in run(spark, watch.rate_limited(requests, limit=2), "limited"))
    assert got == [("a", 5, True), ("a", 10, True), ("a", 20, False), ("a", 64, False), ("a", 66, True), ("b", 7, True)]
