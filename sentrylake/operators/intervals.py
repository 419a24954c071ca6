"""Interval lookups that never form all left/right pairs of a key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sentrylake.operators.windows import bucket_of


def first_in_interval(left: DataFrame, right: DataFrame, keys: list[str], length_us: int, columns: list[str],
                      offset_us: int = 0, ts: str = "ts_us", order_id: str = "event_id", out: str = "match") -> DataFrame:
    """For each left row the right row with the lowest order_id whose time lies in
    [t + offset, t + offset + length]; NULL when there is none.

    An interval of that length touches at most two time buckets: the tail of one and the head of
    the next. Running minima from both ends of each bucket answer both parts, so the work is two
    sorts and every key is spread over its buckets.
    """
    wide = length_us + 1
    best = F.struct(F.col(order_id), F.col(ts), *columns)
    rights = right.select(*keys, bucket_of(F.col(ts), wide).alias("b"), F.col(ts).alias("p"), best.alias("m"))
    start = F.col(ts) + offset_us
    b0, b1 = bucket_of(start, wide), bucket_of(start + length_us, wide)
    ends = F.array_compact(F.array(
        F.struct(b0.alias("b"), start.alias("p"), F.lit(True).alias("tail")),
        F.when(b1 > b0, F.struct(b1.alias("b"), (start + length_us).alias("p"), F.lit(False).alias("tail")))))
    probes = left.select(*keys, F.col(order_id).alias("lid"), F.explode(ends).alias("e")).select(*keys, "lid", "e.*")
    both = rights.unionByName(probes, allowMissingColumns=True)
    part = Window.partitionBy(*keys, "b")
    found = (both.withColumn("hit", F.when(F.col("tail"), F.min("m").over(part.orderBy(F.desc("p"))))
                             .otherwise(F.min("m").over(part.orderBy("p"))))
             .where(F.col("lid").isNotNull()).groupBy("lid").agg(F.min("hit").alias(out)))
    return left.join(found.withColumnRenamed("lid", order_id), order_id, "left")
