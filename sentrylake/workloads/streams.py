"""Registered streaming queries: the events table is read as a stream and drained."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sentrylake.session import shared_folder
from sentrylake.streaming import rules as sr
from sentrylake.workloads.base import Case

DAY = 86400


def source(spark, sf):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    df = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    return df.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type",
                     F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))").alias("ts_us"))


def drained(spark, frame, mode="append"):
    work = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    return sr.drain(frame, f"{work}/state", f"{work}/rows", mode)


def fails(spark, sf):
    return source(spark, sf).where("event_type = 'error'")


def in_batches(spark, sf, files=6):
    """The failures as a stream of several batches, dealt out so that every batch has late rows."""
    path = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}/in"
    rows = spark.read.parquet(f"{sf}/events.parquet").where("event_type = 'error'")
    rows = rows.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))").alias("ts_us"))
    rows.repartition(files, "event_id").write.parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


def stored_once(spark, sf):
    """Failures as findings, one per user and day, in several batches that repeat each other; what the sink has stored."""
    work = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    rows = in_batches(spark, sf, 3).select(F.concat_ws(":", "user_id", F.date_format("ts", "yyyy-MM-dd")).alias("finding_id"), "user_id")
    rows.writeStream.foreachBatch(sr.append_findings(f"{work}/rows", 16)).option("checkpointLocation", f"{work}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("finding_id string, user_id bigint").parquet(f"{work}/rows")


CASES = [
    Case("stream_sink", stored_once, "finding_id:s user_id:i", """SELECT DISTINCT user_id || ':' || strftime(ts, '%Y-%m-%d') AS finding_id, user_id FROM events WHERE event_type = 'error'"""),
    Case("stream_bruteforce", lambda s, d: drained(s, sr.sliding_counts(fails(s, d), ["user_id"], "2 days", "1 day", 3, "1 day")).select(
        "user_id", F.unix_micros("start").alias("start_us"), "n"), "user_id:i start_us:i n:i"),
    Case("stream_exact_window", lambda s, d: sr.settled(drained(s, sr.exact_windows(in_batches(s, d), "user_id", 2 * DAY * 1_000_000, 3, "60 days"))), "key:s run_end:i run_n:i", f"""
SELECT CAST(a.user_id AS VARCHAR) AS key, epoch_us(a.ts) AS run_end, count(*) AS run_n FROM events a JOIN events b ON a.user_id = b.user_id AND b.event_type = 'error' AND b.ts <= a.ts AND b.ts >= a.ts - INTERVAL 2 DAY
WHERE a.event_type = 'error' GROUP BY a.user_id, a.ts HAVING count(*) >= 3"""),
    Case("stream_pivot", lambda s, d: drained(s, sr.interval_join(source(s, d).where("event_type = 'signup'").select("ts", "user_id", F.col("event_id").alias("login_id")),
                                                                 source(s, d).where("event_type = 'purchase'").select("ts", "user_id", F.col("event_id").alias("act_id")), ["user_id"], "12 HOURS", "1 hour").select("login_id", "act_id")), "login_id:i act_id:i", """
SELECT a.event_id AS login_id, b.event_id AS act_id FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'signup' AND b.event_type = 'purchase' AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 12 HOUR"""),
    Case("stream_dedup", lambda s, d: drained(s, sr.dedup(source(s, d), ["user_id", "event_type"], "60 days").select("user_id", "event_type")), "user_id:i event_type:s",
         "SELECT DISTINCT user_id, event_type FROM events"),
    Case("stream_sessions", lambda s, d: drained(s, sr.sessions(source(s, d), "user_id", "4 hours", "1 hour")).select("user_id", F.unix_micros("start").alias("start_us"), "n"), "user_id:i start_us:i n:i"),
]
