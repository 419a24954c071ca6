"""Near-duplicate documents by min-hashes in tensored tables.

A table's key is made of one half from each of two small collections of half keys. SIDE halves on either side give
SIDE * SIDE tables, so the min-hashes to work out are about the square root of what as many independent
tables need. All of it is done TIMES times over, as the tables of one collection fail together.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sentrylake.llm import jaccard
from sentrylake.session import staged

#: Min-hashes of a half key, half keys on a side, and repetitions: 45 tables of four minima from 60 min-hashes.
HALF, SIDE, TIMES = 2, 3, 5
_N = HALF * SIDE * 2 * TIMES
_SEEDS = np.random.default_rng(42).integers(0, 1 << 64, (2, _N, 1), dtype=np.uint64)
_SEEDS[1] |= np.uint64(1)


def missed(similarity: float, half: int = HALF, side: int = SIDE, times: int = TIMES) -> float:
    """The chance that a pair of this similarity shares no table: in every repetition a side has no equal half."""
    return (1 - (1 - (1 - similarity ** half) ** side) ** 2) ** times


def halves(hashes: np.ndarray) -> bytes:
    """The half keys, four bytes each: TIMES x two sides x SIDE."""
    low = np.full(_N, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(hashes), 1024):
        low = np.minimum(low, ((hashes[at:at + 1024] ^ _SEEDS[0]) * _SEEDS[1]).min(axis=1))
    return b"".join(xxhash.xxh32_digest(x.tobytes()) for x in low.reshape(-1, HALF))


def lists(nodes: DataFrame) -> DataFrame:
    """(key, early, node) of the tables' entries with more than one node; early marks those of the first repetition.
    nodes: node, marks (see halves). The last bit of a key says early, so an entry is a key and a node. Entries move
    once: they are counted where they meet, and what a task holds of a key beyond some thousand entries goes to disk."""
    def half(t: int, side: int, i: int):
        return F.substring("marks", 1 + 4 * ((2 * t + side) * SIDE + i), 4)

    keys = [F.xxhash64(F.lit((t * SIDE + i) * SIDE + j), half(t, 0, i), half(t, 1, j)) for t in range(TIMES) for i in range(SIDE) for j in range(SIDE)]
    keys = [k.bitwiseAND(F.lit(-2)).bitwiseOR(F.lit(int(at < SIDE * SIDE))) for at, k in enumerate(keys)]
    entries = nodes.where("length(marks) > 0").select("node", F.explode(F.array(*keys)).alias("key"))
    counted = entries.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("key"))).where("_n > 1")
    return staged(counted.select("key", (F.col("key").bitwiseAND(F.lit(1)) == 1).alias("early"), "node"))


def grouped(nodes: DataFrame, df: DataFrame, text: str, width: int, part: int, whole: int) -> DataFrame:
    """(node, component) of the nodes that similar pairs reach. nodes: distinct node, n, table, marks, digest."""
    return jaccard.linked(lists(nodes), nodes, df, text, width, part, whole)


def distinct_nodes(rows: DataFrame) -> DataFrame:
    return rows.groupBy("node").agg(*[F.first(c).alias(c) for c in ("n", "table", "marks", "digest")])


def near_sets(df: DataFrame, id_col: str, text: str, width: int = 2, part: int = 80, whole: int = 100) -> DataFrame:
    """One row per input row: id, n_shingles, component_id, kept.

    A document is the set of its shingles of `width` words, A-Z lower-cased (fewer words: one shingle). Documents
    link when their sets have a Jaccard similarity of part / whole or more, confirmed on whole sets; component_id is the
    smallest id that links reach (null last), its own included, and kept says that it is the row's own. Null and
    empty texts and texts without words have an empty set and link with nothing, so each is its own component;
    rows with equal sets are linked, repeated rows too. An empty table gives an empty table. Other columns may have any name.

    Rows with equal sets are one node, so exact copies never form pairs. A pair of nodes at exactly 0.8 shares no
    table with a chance of 0.000006 (see `missed`)."""
    rows = staged(jaccard.nodes_of(df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").alias("text")), "id", "text", width, halves))
    nodes = staged(distinct_nodes(rows.where("n > 0")))
    found = grouped(nodes, df, text, width, part, whole)
    lows = rows.where("n > 0").groupBy("node").agg(F.min("id").alias("low"))
    named = staged(lows.join(found, "node", "left").withColumn("component", F.coalesce("component", "node")))
    lowest = named.groupBy("component").agg(F.min("low").alias("component_id"))
    labels = staged(named.join(lowest, "component").select("node", "component_id"))
    some = rows.where("n > 0").select("id", "n", "node").join(labels, "node").select("id", "n", "component_id")
    alone = rows.where("n = 0").select("id", "n", F.col("id").alias("component_id"))
    return some.unionByName(alone).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
