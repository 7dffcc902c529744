"""Queries that run as streams over the table of events; see ``catalog`` for how tables are derived."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from quarrylens.plans.registry import query, table
from quarrylens.sources import logs
from quarrylens.storage import fresh_path
from quarrylens.streaming import debounce, watch
from quarrylens.streaming.replay import replay, stream_of

_FOUND = """f AS (SELECT 'ipv4' AS type, '10.0.' || (event_id % 50) || '.' || (event_id % 7) AS value FROM events UNION SELECT 'email', 'u' || user_id || '@h' || (event_id % 20) || '.org' FROM events
 UNION SELECT 'domain', 'h' || (event_id % 20) || '.org' FROM events)"""


def _lines(spark, sf_dir):
    text = lambda n: n.cast("string")
    n = F.col("event_id")
    line = F.concat(F.lit("hit from 10.0."), text(n % 50), F.lit("."), text(n % 7), F.lit(" by u"), text(F.col("user_id")), F.lit("@h"), text(n % 20), F.lit(".org"))
    return stream_of(spark, sf_dir, "events.parquet").select(line.alias("value"), F.col("ts").cast("timestamp").alias("ts"))


@query(f"WITH {_FOUND} SELECT type, value FROM f")
def watch_indicators(spark, sf_dir):
    """Each indicator once, though very many lines hold it."""
    return replay(watch.indicators(_lines(spark, sf_dir)).select("type", "value"))


@query(f"WITH {_FOUND} SELECT type, value, 'malicious' AS verdict FROM f WHERE type = 'domain' AND value LIKE 'h1%'")
def watch_alerts(spark, sf_dir):
    path = fresh_path(spark, "alerts")
    judge = lambda df: df.withColumn("verdict", F.when((F.col("type") == "domain") & F.col("value").startswith("h1"), "malicious").otherwise("benign"))
    sink = lambda df, epoch: df.select("type", "value", "verdict").write.mode("overwrite").parquet(f"{path}/epoch={epoch}")
    alerts = watch.alerts(_lines(spark, sf_dir), judge, "suspicious", sink, path + "-state", trigger="0 seconds")
    alerts.processAllAvailable()
    alerts.stop()
    return spark.read.schema("type string, value string, verdict string").parquet(path).select("type", "value", "verdict")


_RATE_SECONDS = 86_400 * 3


@query(
    f"""WITH RECURSIVE w AS (SELECT user_id, min(ts) AS began FROM events GROUP BY user_id
UNION ALL SELECT w.user_id, min(e.ts) FROM w JOIN events e ON e.user_id = w.user_id AND e.ts >= w.began + INTERVAL {_RATE_SECONDS} SECOND GROUP BY w.user_id, w.began),
n AS (SELECT w.user_id AS user_id, w.began AS began, count(*) AS n FROM w JOIN events e ON e.user_id = w.user_id AND e.ts >= w.began AND e.ts < w.began + INTERVAL {_RATE_SECONDS} SECOND GROUP BY 1, 2)
SELECT CAST(user_id AS VARCHAR) AS id, CAST(sum(least(n, 5)) AS BIGINT) AS allowed, CAST(sum(greatest(n - 5, 0)) AS BIGINT) AS denied FROM n GROUP BY user_id"""
)
def rate_windows(spark, sf_dir):
    """At most five requests a client in windows of three days, each of which starts with the first request after the one before."""
    requests = stream_of(spark, sf_dir, "events.parquet").select(F.col("user_id").cast("string").alias("id"), F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", "1 day")
    rows = replay(watch.rate_limited(requests, limit=5, seconds=_RATE_SECONDS))
    return rows.groupBy("id").agg(F.count_if("allowed").alias("allowed"), F.count_if(~F.col("allowed")).alias("denied"))


@query("SELECT event_type, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids, CAST(count(DISTINCT event_id) AS BIGINT) AS n_ids FROM events GROUP BY event_type")
def followed_logs(spark, sf_dir):
    """Events as log files that grow and are rotated between two runs of the stream: each line is read once."""
    top = fresh_path(spark, "logs")
    folder = top.removeprefix("file://")
    lines = table(spark, sf_dir, "events").select("event_id", F.concat_ws(" ", "event_id", "event_type", "props").alias("value"))
    stream = lambda: logs.log_lines(spark, f"{top}/*.txt")
    lines.where("event_id % 2 = 0").select("value").write.mode("append").text(top)
    replay(stream(), top + "-rows")
    for name in os.listdir(folder):  # one a task of the writer
        if name.endswith(".txt"):
            os.rename(f"{folder}/{name}", f"{folder}/{name}.1")
    lines.where("event_id % 2 = 1").select("value").write.mode("append").text(top)
    read = replay(stream(), top + "-rows")
    fields = F.split("line", " ")
    found = read.select(F.get(fields, F.lit(0)).cast("long").alias("event_id"), F.get(fields, F.lit(1)).alias("event_type"))
    return found.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"), F.count_distinct("event_id").alias("n_ids"))


_SILENCE, _MOST = 600, 4


@query(
    f"""WITH e AS (SELECT event_type AS key, event_id, ts, CASE WHEN date_diff('microsecond', lag(ts) OVER w, ts) <= {_SILENCE} * 1000000 THEN 0 ELSE 1 END AS opens FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)),
g AS (SELECT *, sum(opens) OVER (PARTITION BY key ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM e),
c AS (SELECT *, (row_number() OVER (PARTITION BY key, g ORDER BY ts, event_id) - 1) // {_MOST} AS c FROM g),
b AS (SELECT key, g, c, count(*) AS n, min(event_id) AS least, max(ts) AS last FROM c GROUP BY key, g, c)
SELECT key, CAST(n AS INTEGER) AS n, count(*) AS batches, CAST(sum(least) AS BIGINT) AS leasts FROM b WHERE n = {_MOST} OR last + INTERVAL {_SILENCE} SECOND <= (SELECT max(ts) FROM events) GROUP BY key, n"""
)
def debounced_batches(spark, sf_dir):
    """Events of a type in batches of four, or fewer after ten minutes of silence; the last ones wait for their timers."""
    name, provider = debounce.PROVIDER
    before = spark.conf.get(name, None)
    events = stream_of(spark, sf_dir, "events.parquet").select(F.col("event_type").alias("key"), F.format_string("%012d", "event_id").alias("value"), F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", "0 seconds")
    spark.conf.set(name, provider)
    try:
        rows = replay(debounce.debounced(events, _SILENCE, _MOST))
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
    least = F.array_min("values").cast("long")
    return rows.groupBy("key", "n").agg(F.count("*").alias("batches"), F.sum(least).alias("leasts"))
