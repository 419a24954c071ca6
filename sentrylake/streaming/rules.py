"""Rules on streams. Sources are any streaming DataFrame with the event columns and a TIMESTAMP
column ts; late rows beyond the watermark are dropped by Spark and counted in its progress."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sentrylake.session import staged
from sentrylake.sources.netlogs import PARSERS
from sentrylake.functions.text import compute_once


def stream_lines(spark: SparkSession, path: str, grammar: str) -> DataFrame:
    """Log lines arriving as files, parsed with one grammar."""
    raw = spark.readStream.text(path).select(F.col("value").alias("line"))
    out = compute_once(raw, e=PARSERS[grammar](F.col("line"))).where(F.col("e.ts_us").isNotNull())
    return out.select(F.timestamp_micros("e.ts_us").alias("ts"), "e.*")


def sliding_counts(events: DataFrame, keys: list[str], window: str, slide: str, minimum: int, late: str = "10 minutes") -> DataFrame:
    """Keys with at least `minimum` rows in a sliding window. The windows lie on a grid, so a burst
    across two grid steps counts at most one slide less than the exact rule."""
    out = events.withWatermark("ts", late).groupBy(*keys, F.window("ts", window, slide)).agg(F.count(F.lit(1)).alias("n"))
    return out.where(F.col("n") >= minimum).select(*keys, F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n")


def exact_windows(events: DataFrame, key: str, window_us: int, minimum: int, late: str = "10 minutes") -> DataFrame:
    """Exact trailing counts per key: (key, run_end, run_n) for every instant whose window reaches the minimum.

    A count is emitted at once and again whenever a later row lifts it, so the rows of an instant are revisions
    of which the greatest counts: settled() keeps it. The result doesn't depend on how rows fall into batches.
    State holds (instant, rows) of the window and of what may still be late, and goes when the watermark has
    passed a key. Rows later than that are dropped and counted in the progress of the query."""
    def update(k, batches: Iterator[pd.DataFrame], state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        times, counts = (np.array(x, dtype=np.int64) for x in (state.get if state.exists else ([], [])))
        fresh = np.concatenate([pdf["ts_us"].to_numpy(np.int64) for pdf in batches])
        before = np.concatenate([[0], np.cumsum(counts)])
        every, at = np.unique(np.concatenate([times, fresh]), return_inverse=True)
        rows = np.bincount(at, weights=np.concatenate([counts, np.ones(len(fresh), np.int64)])).astype(np.int64)
        running = np.concatenate([[0], np.cumsum(rows)])
        count = running[1:] - running[np.searchsorted(every, every - window_us)]
        old = before[np.searchsorted(times, every, "right")] - before[np.searchsorted(times, every - window_us)]
        lifted = (count >= minimum) & (count > np.where(np.isin(every, times), old, 0))
        kept = every >= state.getCurrentWatermarkMs() * 1000 - window_us
        if kept.any():
            state.update((every[kept].tolist(), rows[kept].tolist()))
            state.setTimeoutTimestamp(max(int(every[-1] + window_us) // 1000, state.getCurrentWatermarkMs()) + 1)
        elif state.exists:
            state.remove()
        if lifted.any():
            yield pd.DataFrame({"key": k[0], "run_end": every[lifted], "run_n": count[lifted].astype(np.int32)})
    marked = events.where(F.col("ts").isNotNull()).withWatermark("ts", late).select(F.col(key).cast("string").alias("key"), "ts", "ts_us")
    return marked.groupBy("key").applyInPandasWithState(
        update, "key string, run_end bigint, run_n int", "times array<bigint>, rows array<bigint>", "append", GroupStateTimeout.EventTimeTimeout)


def settled(revisions: DataFrame) -> DataFrame:
    """The last revision of every instant that exact_windows has emitted."""
    return revisions.groupBy("key", "run_end").agg(F.max("run_n").alias("run_n"))


def interval_join(left: DataFrame, right: DataFrame, keys: list[str], length: str, late: str = "10 minutes") -> DataFrame:
    """Rows of right that follow a left row of the same key within the interval (pivot, transfer and
    logon joins). Both sides carry a watermark, so state is bounded by the interval."""
    a = left.withWatermark("ts", late).alias("a")
    b = right.withWatermark("ts", late).alias("b")
    cond = F.expr(f"b.ts >= a.ts AND b.ts <= a.ts + INTERVAL {length}")
    for k in keys:
        cond = cond & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    return a.join(b, cond)


def dedup(events: DataFrame, keys: list[str], late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def sessions(events: DataFrame, key: str, gap: str, late: str = "10 minutes") -> DataFrame:
    out = events.withWatermark("ts", late).groupBy(key, F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("n"))
    return out.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def append_findings(path: str, buckets: int = 256, keep: int | None = None):
    """foreachBatch sink that stores a finding once: a batch replaces its own folders, so a repeated batch adds
    nothing twice, and leaves out what earlier batches have stored.

    Beside the findings (path/epoch=n) the ids are stored by bucket (path/_ids/epoch=n/bucket=b), and a batch reads only the
    buckets that its own ids fall into, one narrow column of them. With keep, only the ids of so many batches
    back are looked at, so the store may be cleared of older ones; a finding that comes again later is then new."""
    bucket = F.pmod(F.xxhash64("finding_id"), F.lit(buckets)).cast("int").alias("bucket")

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        new = staged(batch.dropDuplicates(["finding_id"]))
        ids = new.select("finding_id", bucket)
        if epoch > 0:
            own = [r.bucket for r in ids.select("bucket").distinct().collect()]  # at most `buckets` numbers
            told = stored_ids(spark, path, own, epoch, keep).select("finding_id", "bucket")
            ids = staged(ids.join(told, ["bucket", "finding_id"], "left_anti").select("finding_id", "bucket"))
            new = new.join(ids.select("finding_id"), "finding_id", "left_semi").select(*batch.columns)
        new.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")
        ids.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/_ids/epoch={epoch}")
    return write


def stored_ids(spark: SparkSession, path: str, buckets: list[int], epoch: int, keep: int | None = None) -> DataFrame:
    """The ids that batches before this one have stored in these buckets, by partition pruning."""
    told = spark.read.schema("finding_id string, epoch bigint, bucket int").parquet(f"{path}/_ids")
    told = told.where((F.col("epoch") < epoch) & F.col("bucket").isin(buckets))
    return told if keep is None else told.where(F.col("epoch") >= epoch - keep)


def drain(stream: DataFrame, checkpoint: str, out: str, mode: str = "append") -> DataFrame:
    """Run a stream over everything available and return what it wrote."""
    q = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).option("path", out).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)
