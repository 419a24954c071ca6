"""Small helpers that several operators of this package share."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The white space of all contracts: \x20 and \x09 to \x0D, as a class for both regex engines.
WORD = r"[^\x20\x09-\x0D]+"
#: A-Z to a-z in UTF-8 bytes; every other byte stays.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
SPACES = b" \t\n\x0b\x0c\r"


def cut_hash(value: Column, *, digits: int = 13) -> Column:
    """The first hexadecimal digits of an MD5 as a number; other SQL engines give the same."""
    return F.conv(F.substring(F.md5(value), 1, digits), 16, 10).cast("bigint")


def remainder(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n. A null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % n


def running_before(df: DataFrame, keys: list[str], hex_col: str, order: list, amount: str, out: str, *, digits: int = 3) -> DataFrame:
    """For each row the sum of `amount` over the rows before it in its group, ordered by the hex
    digest `hex_col` and then `order`. A group is cut into 16**digits slices of the digest: slices are
    summed first, the slice offsets are a small table, and only rows of one slice are sorted together,
    so a group with a third of all rows is still spread over thousands of tasks.

    keys must not be null. Rows equal in every ordering column are interchangeable."""
    df = df.withColumn("_slice", F.substring(hex_col, 1, digits))
    sums = df.groupBy(*keys, "_slice").agg(F.sum(amount).alias("_sum"))
    ahead = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*keys, "_slice", F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_ahead"))
    inside = Window.partitionBy(*keys, "_slice").orderBy(hex_col, *order).rowsBetween(Window.unboundedPreceding, -1)
    joined = df.join(sums, [*keys, "_slice"])
    return joined.withColumn(out, F.col("_ahead") + F.coalesce(F.sum(amount).over(inside), F.lit(0))).drop("_slice", "_ahead")


def utf8(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """A text column of an Arrow batch as UTF-8 bytes; null counts as empty."""
    column = batch.column(batch.schema.get_field_index(name))
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def bounded(df: DataFrame, rows: int = 1024) -> DataFrame:
    """df, with at most so many rows in an Arrow batch that goes to Python from now on in this session. The default of
    10,000 is made for numbers; with texts it takes hundreds of megabytes in each worker."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name, "10000")) <= rows:
        conf.set(name, str(rows))
    return df


def inner_utf8(batch: pa.RecordBatch, struct: str, field: str) -> list[bytes]:
    """A text field of a struct column as UTF-8 bytes; null counts as empty."""
    column = batch.column(batch.schema.get_field_index(struct)).field(field)
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]
