"""Exact deduplication with two passes over a Bloom filter.

The first pass sets, for each text's digest, a few bits of a filter that counts to two. The second pass
asks the filter: a text whose bits were not all set twice is unique beyond doubt and passes straight
through. Only the rest, the repeats and a small share of false alarms, is shuffled and settled exactly.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sentrylake.llm.common import SPACES, bounded, inner_utf8, utf8
from sentrylake.session import staged

SEGMENT_BITS = 1 << 16
HASHES = 3


def normal_digest(text: bytes) -> bytes:
    return hashlib.sha256(text.translate(None, SPACES)).digest()


def _bits(digests: list[bytes], n_bits: int) -> np.ndarray:
    """HASHES different bit numbers per digest; SHA-256 supplies them as independent words."""
    words = np.frombuffer(b"".join(digests), dtype="<u8").reshape(-1, 4)[:, :HASHES]
    return (words % np.uint64(n_bits)).astype(np.int64)


def filter_bits(rows: int, max_filter_bits: int) -> int:
    """16 bits for each row, as a power of two between one segment and the bound."""
    wanted = 1 << max(16, (16 * max(rows, 1) - 1).bit_length())
    return min(wanted, max_filter_bits)


def _twice(digests: DataFrame, n_bits: int) -> np.ndarray:
    """The bits set at least twice, as n_bits / 8 bytes. Each task counts its own bits to two; the
    counts of a segment meet in one task as bit numbers, two bytes each."""
    def local(batches):
        for batch in batches:
            got = batch.column(0).to_pylist()
            if not got:
                continue
            bits = _bits(got, n_bits)
            bits = np.concatenate([bits[:, 0], bits[bits[:, 1] != bits[:, 0], 1],
                                   bits[(bits[:, 2] != bits[:, 0]) & (bits[:, 2] != bits[:, 1]), 2]])
            at, n = np.unique(bits, return_counts=True)
            cuts = np.flatnonzero(np.diff(at // SEGMENT_BITS)) + 1
            starts = np.concatenate([[0], cuts])
            low = (at % SEGMENT_BITS).astype("<u2")
            once = [x.tobytes() for x in np.split(low, cuts)]
            again = [x[m].tobytes() for x, m in zip(np.split(low, cuts), np.split(n > 1, cuts))]
            yield pa.RecordBatch.from_arrays([pa.array((at[starts] // SEGMENT_BITS).astype(np.int32)), pa.array(once, pa.binary()), pa.array(again, pa.binary())],
                                             ["segment", "once", "again"])

    def merged(batches):
        counts: dict[int, np.ndarray] = {}
        for batch in batches:
            for segment, once, again in zip(*(c.to_pylist() for c in batch.columns)):
                n = counts.setdefault(segment, np.zeros(SEGMENT_BITS, dtype=np.uint8))
                for part in (once, again):
                    at = np.frombuffer(part, dtype="<u2")
                    n[at] = np.minimum(n[at] + 1, 2)  # a part names a bit once
        if counts:
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int32()), pa.array([np.packbits(n > 1).tobytes() for n in counts.values()], pa.binary())], ["segment", "bits"])

    segments = max(1, n_bits // SEGMENT_BITS)
    parts = digests.select("digest").mapInArrow(local, "segment int, once binary, again binary").repartition(min(segments, 256), "segment")
    out = np.zeros(n_bits // 8, dtype=np.uint8)
    # At most max_filter_bits / 8 bytes in all, whatever the size of the input.
    for row in parts.mapInArrow(merged, "segment int, bits binary").toLocalIterator():
        out[row["segment"] * SEGMENT_BITS // 8:(row["segment"] + 1) * SEGMENT_BITS // 8] = np.frombuffer(row["bits"], dtype=np.uint8)
    return out


def digested(df: DataFrame, text: str, inside: str | None = None) -> DataFrame:
    """The columns of df but the text, with digest (SHA-256 of the text without white space) and
    points (code points of the original text). inside: the struct column that has the text and stays."""
    df = bounded(df)
    keep = [c for c in df.columns if inside or c != text]
    schema = T.StructType([*df.select(*keep).schema.fields, T.StructField("digest", T.BinaryType()), T.StructField("points", T.LongType())])

    def run(batches):
        for batch in batches:
            texts = inner_utf8(batch, inside, text) if inside else utf8(batch, text)
            points = [len(x) if x.isascii() else len(x.decode("utf-8", "replace")) for x in texts]
            kept = [c for c, n in zip(batch.columns, batch.schema.names) if n in keep]
            yield pa.RecordBatch.from_arrays([*kept, pa.array([normal_digest(x) for x in texts], pa.binary()), pa.array(points, pa.int64())], [*keep, "digest", "points"])

    return df.mapInArrow(run, schema)


def repeat_filter(digests: DataFrame, max_filter_bits: int):
    """The broadcast filter of a table with a column `digest`, and its number of bits."""
    n_bits = filter_bits(digests.count(), max_filter_bits)
    return digests.sparkSession.sparkContext.broadcast(_twice(digests, n_bits).tobytes()), n_bits


def flagged(df: DataFrame, shared, n_bits: int) -> DataFrame:
    """df and a column `maybe`: false only where no other row has the same digest."""
    names = df.columns

    def run(batches):
        twice = np.frombuffer(shared.value, dtype=np.uint8)
        for batch in batches:
            bits = _bits(batch.column(batch.schema.get_field_index("digest")).to_pylist(), n_bits)
            hit = ((twice[bits >> 3] >> (7 - (bits & 7)).astype(np.uint8)) & 1).astype(bool).all(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hit, pa.bool_())], [*names, "maybe"])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("maybe", T.BooleanType())]))


def exact_copies(df: DataFrame, id_col: str, text: str, max_filter_bits: int = 1 << 30) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical without the white space \\x20 and \\x09 to \\x0D. The row
    with the most code points stays, then the smallest id (null last); of rows equal in both exactly one
    stays. Null text counts as empty, and all texts without other characters are copies of each other.
    Repeated rows count as copies. An empty table gives an empty table. Other columns may have any name.

    The filter has 16 bits a row and at most max_filter_bits (1 << 30: 128 MiB in every executor), so
    what is broadcast has that bound at every size of the input. A fuller filter lets more unique rows
    into the shuffle; it never changes the result. Only ids, digests and lengths are shuffled, never texts;
    groups are counted before the shuffle, so one with a third of all rows is one row per task."""
    rows = df.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    rows = staged(digested(rows, "text").withColumn("row", F.monotonically_increasing_id()))
    rows = staged(flagged(rows, *repeat_filter(rows, max_filter_bits)))
    alone = rows.where(~F.col("maybe")).select("id", F.col("id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("kept"), "digest")
    again = rows.where("maybe")
    # Written, so that both sides of the join are plain and the planner can split a large group's rows.
    groups = staged(again.groupBy("digest").agg(F.min(F.struct((-F.col("points")).alias("p"), F.col("id").isNull().alias("n"), F.col("id"), F.col("row"))).alias("best"),
                                                F.count(F.lit(1)).alias("group_size")))
    settled = again.join(groups, "digest").select("id", F.col("best.id").alias("keep_id"), "group_size", (F.col("row") == F.col("best.row")).alias("kept"), "digest")
    return alone.unionByName(settled).select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def drop_copies(df: DataFrame, id_col: str, text: str, max_filter_bits: int = 1 << 30) -> DataFrame:
    """df without the rows that exact_copies doesn't keep, with its columns. Rows that the filter clears
    are never shuffled; of the others each task sends one row per digest at most, because a row
    number of 1 is pushed below the shuffle."""
    texts = digested(df.select(F.col(f"`{text}`").alias("text")), "text")
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("doc"))
    rows = flagged(digested(rows, text, "doc"), *repeat_filter(texts, max_filter_bits))
    best = Window.partitionBy("digest").orderBy(F.desc("points"), F.asc_nulls_last(F.col("doc").getField(id_col)))
    again = rows.where("maybe").withColumn("_rank", F.row_number().over(best)).where("_rank = 1")
    return rows.where(~F.col("maybe")).select("doc.*").unionByName(again.select("doc.*"))
