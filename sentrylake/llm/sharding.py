"""Sharding by rendezvous hashing: every record goes to the shard that scores highest for its key.

A shard's score depends on the key and on that shard only, so another shard takes records into itself
and moves no record between the old ones; a shard's share of the keys is proportional to its weight.
Everything is built-in SQL functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentrylake.llm.common import cut_hash, running_before
from sentrylake.session import staged


def rendezvous(key: Column, weights: list[float], seed: str = "shard") -> Column:
    """The shard of a key, from 0. Shard i draws a uniform number u from a hash of (seed, i, key) and
    the smallest -ln(u) / weight wins, which is the largest of the weighted rendezvous scores. Ties go
    to the smaller shard.

    A null key is a key of its own. Weights must be positive."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    name = F.coalesce(F.concat(F.lit("="), key.cast("string")), F.lit("null"))
    draws = F.transform(F.array(*[F.lit(float(w)) for w in weights]), lambda w, i: F.struct(
        (-F.log((cut_hash(F.concat_ws(":", F.lit(seed), i.cast("string"), name)) + F.lit(0.5)) / F.lit(float(2 ** 52))) / w).alias("cost"),
        i.cast("int").alias("shard")))
    return F.array_min(draws)["shard"]


def shard(df: DataFrame, key: str, text: str, weights: list[float], seed: str = "shard") -> DataFrame:
    """One row per input row: key, size (UTF-8 bytes of the text plus 1), text_crc32, shard, slot (from
    0 without gaps inside a shard, in the order of the key's hash) and grown_shard (the shard if one
    more shard of mean weight were added).

    Null text has size 1 and the checksum of nothing; null keys stay together on one shard; repeated
    rows each get a slot; an empty table gives an empty table; other columns of the input are not
    carried and may have any name."""
    grown = [*weights, sum(weights) / len(weights)]
    text_bytes = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = df.select(F.col(key).alias("key"), (F.octet_length(text_bytes) + 1).cast("bigint").alias("size"), F.crc32(text_bytes).alias("text_crc32"))
    rows = staged(rows.select("*", rendezvous(F.col("key"), weights, seed).alias("shard"), rendezvous(F.col("key"), grown, seed).alias("grown_shard"),
                              F.md5(F.coalesce(F.col("key").cast("string"), F.lit(""))).alias("_hex"), F.lit(1).cast("bigint").alias("_one")))
    placed = running_before(rows, ["shard"], "_hex", ["key", "size", "text_crc32"], "_one", "slot")
    return placed.select(F.col("key").alias(key), "size", "text_crc32", "shard", "slot", "grown_shard")
