"""One document of each group of near copies, by the exact Jaccard similarity of their word shingles.

SimHash groups (operator 8: byte-position index, count filter, three bits) come first: nodes of one group ask each
other. A similarity of 0.8 changes some ten bits of 64, so no byte of a fingerprint is surely equal and SimHash
alone can't find all such pairs; lists from tensored min-hash tables bring the others together. Every link of
either kind is confirmed on whole shingle sets.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentrylake.llm import jaccard, simhash, tensorhash
from sentrylake.llm.exactdedup import flagged, repeat_filter
from sentrylake.session import staged


def _marks(hashes: np.ndarray) -> bytes:
    """The SimHash of a set (a bit is 1 if set in over half the hashes), then its half keys."""
    ones = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes)).tobytes() + tensorhash.halves(hashes)


def _number(name: str, start: int) -> Column:
    """Eight bytes of a binary column as a long."""
    high, low = (F.conv(F.hex(F.substring(name, at, 4)), 16, 10).cast("bigint") for at in (start, start + 4))
    return F.shiftleft(high, 32).bitwiseOR(low)


def grouped(nodes: DataFrame, df: DataFrame, text: str, width: int, part: int, whole: int) -> DataFrame:
    """(node, component) of the nodes that similar pairs reach. nodes: distinct node, n, table, marks, digest."""
    prints = staged(nodes.where("length(marks) > 0").select("node", _number("marks", 1).alias("fingerprint")))
    named = prints.join(simhash.grouped(prints), "fingerprint").select(F.col("component").alias("key"), "node")
    several = staged(named.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("key"))
    close = staged(named.join(several, "key", "left_semi").select("key", F.lit(True).alias("early"), "node"))
    tables = tensorhash.lists(nodes.withColumn("marks", F.expr("substring(marks, 9)"))).withColumn("early", F.lit(False))
    return jaccard.linked(close.unionByName(tables), nodes, df, text, width, part, whole)


def one_of_similar(df: DataFrame, id_col: str, text: str, width: int = 5, part: int = 4, whole: int = 5) -> DataFrame:
    """df with one row of each group of rows that chains of pairs with a Jaccard similarity of part / whole or more
    reach: the one with the smallest id (null last), then the smallest hash of its text. Texts with equal
    shingles are one node. Null texts count as empty, and texts without words are one group. Repeated
    rows (same id and text) leave one. An empty table gives an empty table. Other columns may have any name.

    Texts are not shuffled: a filter of bounded size holds the rows that go, and only what it points at is
    looked up. A fuller filter lets more rows move; it never changes the result."""
    mark = F.xxhash64(F.col(f"`{text}`"))
    keyed = df.select(F.struct(F.col(f"`{id_col}`").alias("i"), mark.alias("m")).alias("id"), F.col(f"`{text}`").alias("text"))
    rows = staged(jaccard.nodes_of(keyed, "id", "text", width, _marks))
    best = F.min(F.struct(F.col("id.i").isNull().alias("z"), "id")).alias("first")
    nodes = staged(rows.groupBy("node").agg(best, *[F.first(c).alias(c) for c in ("n", "table", "marks", "digest")]))
    found = grouped(nodes.drop("first"), df, text, width, part, whole)
    named = nodes.select("node", "first").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    kept = staged(named.groupBy("component").agg(F.min("first").alias("first")).select(F.col("first.id.i").alias("_i"), F.col("first.id.m").alias("_m")))

    def same(left: DataFrame, i: Column, m: Column, how: str) -> DataFrame:
        return left.join(kept, i.eqNullSafe(F.col("_i")) & (m == F.col("_m")), how)

    def digest(i: Column, m: Column) -> Column:
        return F.unhex(F.sha2(F.concat_ws("|", F.hex(m), i.cast("string")), 256))

    ids = rows.select(F.col("id.i").alias("i"), F.col("id.m").alias("m"))
    gone = same(ids, F.col("i"), F.col("m"), "left_anti")
    again = ids.groupBy("i", "m").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("i", "m")
    open_ = staged(gone.unionByName(again).distinct().select(digest(F.col("i"), F.col("m")).alias("digest")))
    whole_rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("doc"))
    i, m = F.col("doc").getField(id_col), F.xxhash64(F.col("doc").getField(text))
    dealt = flagged(whole_rows.withColumn("digest", digest(i, m)), *repeat_filter(open_.unionAll(open_), 1 << 30))
    asked = same(dealt.where("maybe").select("doc"), i, m, "left_semi").select("doc.*").dropDuplicates()
    return dealt.where("NOT maybe").select("doc.*").unionByName(asked)
