"""Queries of the streaming forms: each runs over all of its table as a stream, and ends."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.operators import graph
from plinth.plans.registry import query, table
from plinth.streaming import counts as streaming
from plinth.streaming import freshness, retention

_DAILY = "dl AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) FILTER (WHERE event_type = 'purchase') AS n FROM events GROUP BY 1, 2)"


def _events(spark, sf_dir) -> DataFrame:
    """The events as a stream, whether the table is a file or a folder."""
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(path if _is_dir(spark, path) else f"{path}*")


@query("""WITH w AS (SELECT event_type, time_bucket(INTERVAL '15 minutes', ts) AS slot, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2)
SELECT * FROM w WHERE slot + INTERVAL 15 MINUTE <= (SELECT date_trunc('millisecond', max(ts)) FROM events) - INTERVAL 30 MINUTE""")
def stream_window(spark, sf_dir):
    stream = _events(spark, sf_dir).select("event_type", F.col("ts").cast("timestamp").alias("ts"), "value")
    out = streaming.run_available(streaming.grid(stream, ["event_type"], "ts", "value"), _folder(spark))
    return out.select("event_type", F.col("slot").cast("timestamp_ntz").alias("slot"), "n", F.round("total", 4).alias("total"))


@query(f"WITH {_DAILY}, s AS (SELECT *, sum(CASE WHEN n > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY day DESC) AS stops FROM dl) SELECT user_id, max(day) AS day, count(*) FILTER (WHERE stops = 0) AS fault_days FROM s GROUP BY 1")
def stream_fault_state(spark, sf_dir):
    folder = _folder(spark)
    daily = table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count_if(F.col("event_type") == "purchase").alias("n"))
    daily.write.parquet(f"{folder}/daily")
    stream = streaming.source(spark, f"{folder}/daily", daily.schema)
    return streaming.run_updates(streaming.fault_state(stream, "user_id", "day", "n"), folder, ["user_id"], "day")


@query("""WITH l AS (SELECT user_id AS key, date_trunc('millisecond', max(ts)) AS seen FROM events GROUP BY 1), w AS (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 30 MINUTE AS mark FROM events)
SELECT key, seen, CASE WHEN seen + INTERVAL 168 HOUR < mark THEN 'offline' WHEN seen + INTERVAL 30 HOUR < mark THEN 'stale' ELSE 'fresh' END AS state FROM l, w""")
def stream_freshness(spark, sf_dir):
    """Counters that fall silent turn stale and offline by timers when the watermark, which the others drive, has passed their age."""
    stream = _events(spark, sf_dir).select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", freshness.PROVIDER)
    try:
        out = streaming.run_updates(freshness.freshness(stream, "user_id", "ts"), _folder(spark), ["key"], "at")
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    return out.select("key", F.col("seen").cast("timestamp_ntz").alias("seen"), "state")


@query("""WITH e AS (SELECT user_id, event_type, date_trunc('hour', ts) AS hour, event_id, value, ts FROM events), c AS (SELECT max(ts) - INTERVAL 14 DAY AS cut FROM events),
k AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type, hour ORDER BY event_id) AS i FROM e, c WHERE ts >= cut) SELECT user_id, event_type, hour, event_id, round(value, 6) AS value FROM k WHERE i = 1""")
def stream_retained(spark, sf_dir):
    """One reading a user, kind and hour, the first; of the last two weeks of the table."""
    ts = F.col("ts").cast("timestamp")
    stream = _events(spark, sf_dir).select("user_id", "event_type", F.date_trunc("hour", ts).alias("hour"), ts.alias("ts"), "event_id", "value")
    folder = _folder(spark)
    kept = retention.Retained(f"{folder}/table", ("user_id", "event_type", "hour"), "ts", ("event_id",), days=14)
    out = retention.run_retained(stream, kept, f"{folder}/state")
    return out.select("user_id", "event_type", F.col("hour").cast("timestamp_ntz").alias("hour"), "event_id", F.round("value", 6).alias("value"))


@query("""WITH m AS (SELECT max(ts) AS newest FROM events), k AS (SELECT count(DISTINCT (user_id, event_type, date_trunc('hour', ts))) AS written, count(*) AS inside FROM events, m WHERE ts >= newest - INTERVAL 14 DAY)
SELECT (SELECT count(*) FROM events) AS "read", inside - written AS repeats, (SELECT count(*) FROM events) - inside AS late, 0::BIGINT AS unreadable, written, newest AS watermark, newest - INTERVAL 30 MINUTE AS next_start FROM m, k""")
def stream_sidecar(spark, sf_dir):
    """What a run says of itself, and where the next one starts."""
    ts = F.col("ts").cast("timestamp")
    stream = _events(spark, sf_dir).select("user_id", "event_type", F.date_trunc("hour", ts).alias("hour"), ts.alias("ts"), "event_id", "value")
    folder = _folder(spark)
    kept = retention.Retained(f"{folder}/table", ("user_id", "event_type", "hour"), "ts", ("event_id",), days=14)
    retention.run_retained(stream, kept, f"{folder}/state")
    start = kept.window(spark, datetime(2100, 1, 1)).start
    told = kept.sidecar(spark).agg(*(F.sum(c).alias(c) for c in ("read", "repeats", "late", "unreadable", "written")), F.max("watermark").cast("timestamp_ntz").alias("watermark"))
    return told.withColumn("next_start", F.lit(start).cast("timestamp_ntz"))


def _is_dir(spark, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def _folder(spark) -> str:
    return f"{graph.shared_folder(spark)}/stream-{uuid.uuid4().hex}"
