"""Queries over the event table, and a stream of it."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ticketloom.session import shared_folder
from ticketloom.streaming import events as W


def _e(spark, sf):
    return spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling_windows(spark, sf):
    return W.tumbling(_e(spark, sf), "ts", "event_type", "value").select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "events", F.round("total", 6).alias("total"))


def sliding_windows(spark, sf):
    return W.sliding(_e(spark, sf), "ts", "event_type", "value").select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "events", F.round("total", 6).alias("total"))


def session_windows(spark, sf):
    return W.sessions(_e(spark, sf), "ts", "user_id").select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("start"), "events")


def streamed_windows(spark, sf):
    """The tumbling windows once more, by a stream with a watermark that runs until all files are read; the last windows stay open."""
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    folder = f"{base}/in"
    _e(spark, sf).select([F.col(f.name).cast(f.dataType) for f in schema.fields]).write.parquet(folder)
    W.run_once(W.tumbling(W.read_events(spark, folder, schema, 100), "ts", "event_type", "value"), f"{base}/out", f"{base}/state")
    return spark.read.parquet(f"{base}/out").select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "events", F.round("total", 6).alias("total"))


QUERIES = {f.__name__: f for f in (tumbling_windows, sliding_windows, session_windows, streamed_windows)}
_WIN = "SELECT strftime({start}, '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS events, round(sum(value), 6) AS total FROM {source} GROUP BY 1, 2"
ORACLES = {
    "tumbling_windows": _WIN.format(start="date_trunc('hour', ts)", source="events"),
    "streamed_windows": _WIN.format(start="date_trunc('hour', ts)", source="events WHERE date_trunc('hour', ts) + INTERVAL '1 hour' <= (SELECT max(ts) FROM events) - INTERVAL '2 hours'"),
    "sliding_windows": _WIN.format(start="s", source="(SELECT *, time_bucket(INTERVAL '3 hours', ts, TIMESTAMP '1970-01-01') - INTERVAL '3 hours' * k AS s FROM events, (SELECT unnest([0, 1]) AS k))"),
    "session_windows": "WITH a AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), b AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM a) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS start, count(*) AS events FROM b GROUP BY user_id, s",
}
