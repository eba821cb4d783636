"""Queries of the streaming operators' batch twins (I rows)."""

from __future__ import annotations

from pyspark.sql import functions as F

from planlake.plans.registry import query
from planlake.session import new_folder
from planlake.streaming import job_state, streams

US = "epoch_us(ts)"


def events(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.withColumn("us", F.unix_micros("ts")).withColumn("key", F.col("user_id").cast("long"))


@query("i01_rate_limit")
def i01(spark, sf):
    """No plain SQL: a request's fate depends on the fate of earlier ones. Tested against a direct simulation."""
    return streams.rate_limit_batch(events(spark, sf), 2, 20)


@query("i02_request_rate", f"SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY {US} RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW) AS minute, count(*) OVER (PARTITION BY user_id ORDER BY {US} RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) AS hour FROM events")
def i02(spark, sf):
    return streams.request_rate(events(spark, sf)).select("event_id", "minute", "hour")


@query("i03_job_state", "SELECT CAST(user_id AS VARCHAR) AS job_id, arg_max(event_type, (ts, event_id)) AS status, max(event_id) >= 0 AS known FROM events GROUP BY user_id")
def i03(spark, sf):
    """All events as a batch of the state table, and once more as a replay under another number; then parts are merged and read."""
    path = new_folder(spark, "job-state")
    e = events(spark, sf).select(F.col("user_id").alias("job_id"), "ts", "event_id", F.col("event_type").alias("status"))
    for number in range(2):
        job_state.upsert(e, path, number, buckets=8, parts=2)
    return job_state.read(spark, path).select("job_id", "status", (F.col("event_id") >= 0).alias("known"))


@query("i04_tumbling_counts", "SELECT epoch_us(time_bucket(INTERVAL '1 hour', ts)) AS start_us, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def i04(spark, sf):
    return streams.windowed_counts(events(spark, sf), watermark=False).select(F.unix_micros("start").alias("start_us"), "event_type", "n")


@query("i04_sliding_counts", "SELECT s AS start_us, event_type, count(*) AS n FROM (SELECT event_type, unnest([epoch_us(time_bucket(INTERVAL '15 minutes', ts)) - CAST(k AS BIGINT) * 900000000 FOR k IN [0, 1, 2, 3]]) AS s FROM events) GROUP BY 1, 2")
def i04s(spark, sf):
    return streams.windowed_counts(events(spark, sf), "1 hour", "15 minutes", watermark=False).select(F.unix_micros("start").alias("start_us"), "event_type", "n")


@query("i05_step_sessions", f"WITH e AS (SELECT user_id, {US} AS us, lag({US}) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before, event_id FROM events), g AS (SELECT *, sum(CASE WHEN before IS NULL OR us - before > 1800000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS s FROM e) SELECT user_id, min(us) AS start_us, count(*) AS n FROM g GROUP BY user_id, s")
def i05(spark, sf):
    return streams.sessions(events(spark, sf), watermark=False).select("user_id", F.unix_micros("start").alias("start_us"), "n")
