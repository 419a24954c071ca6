"""Near-duplicate documents by SimHash fingerprints.

Fingerprints are 64 bits in eight byte positions. Two that differ in at most three bits differ in at most
three bytes, so they share at least five positional bytes. An inverted index on sets of four positional
bytes brings such pairs together, a count of shared bytes filters them, and the bit distance decides.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentrylake.llm.common import LOWER, bounded, utf8
from sentrylake.llm.graph import components
from sentrylake.session import staged

MAX_BITS = 3
#: Equal bytes that MAX_BITS differing bits leave at least.
MIN_SHARED = 8 - MAX_BITS


def covering() -> list[tuple[int, ...]]:
    """Sets of four byte positions such that any five positions contain one of them, chosen greedily:
    always the set that serves most of the fives not yet served."""
    fives, fours, chosen = set(combinations(range(8), 5)), list(combinations(range(8), 4)), []
    while fives:
        best = max(fours, key=lambda s: (sum(set(s) <= set(f) for f in fives), [-x for x in s]))
        chosen.append(best)
        fives = {f for f in fives if not set(best) <= set(f)}
    return chosen


#: Bytes of a posting list's key.
KEYS = covering()


def simhash(text: bytes, width: int = 3) -> int:
    """Bit b is 1 if it is set in over half of the XXH64 (seed 42) of the shingles of `width` words,
    repeats included. Fewer words are one shingle; no words give 0."""
    words = text.translate(LOWER).split()
    if not words:
        return 0
    line = b" ".join(words)
    n = max(1, len(words) - width + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[:n].tolist()
    ends = ends[min(width, len(words)) - 1:].tolist()
    counts, digest = np.zeros(64, dtype=np.int64), xxhash.xxh64_intdigest
    for at in range(0, n, 1 << 16):
        hashes = np.array([digest(line[a:b], 42) for a, b in zip(starts[at:at + (1 << 16)], ends[at:at + (1 << 16)])], dtype=">u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprints(df: DataFrame, id_col: str, text: str, width: int = 3) -> DataFrame:
    """id and fingerprint (a signed long with the 64 bits) of every row."""
    rows = bounded(df).select(F.col(id_col).alias("id"), F.col(text).alias("text"))

    def run(batches):
        for batch in batches:
            prints = np.array([simhash(x, width) for x in utf8(batch, "text")], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints)], ["id", "fingerprint"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, fingerprint bigint")


def _masked(value: Column, positions) -> Column:
    mask = sum(0xFF << 8 * p for p in positions)
    return value.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("bigint"))


def _listed(prints: DataFrame) -> DataFrame:
    """Posting lists: (list, key, fingerprint), a row per key set."""
    return prints.select("fingerprint", F.explode(F.array(*[F.struct(F.lit(i).alias("list"), _masked(F.col("fingerprint"), s).alias("key")) for i, s in enumerate(KEYS)])).alias("k")).select(
        "k.list", "k.key", "fingerprint")


def _refined(rows: DataFrame, step: int) -> DataFrame:
    """The same lists cut finer, without losing a pair. Step 0 adds one more shared byte (the pairs
    share five). Then three bytes or 24 bits are free and differ in at most three bits, so one
    quarter of them is equal: step 1 adds a quarter. The lists left can hold 2 ** 18 fingerprints at most."""
    options = []
    for i, s in enumerate(KEYS):
        rest = [p for p in range(8) if p not in s]
        if step == 0:
            for extra in rest:
                options.append((i, len(KEYS) * (extra + 1) + i, sum(0xFF << 8 * p for p in (*s, extra))))
        else:
            for extra in rest:
                free = [8 * p + b for p in rest if p != extra for b in range(8)]
                base = sum(0xFF << 8 * p for p in (*s, extra))
                for q in range(4):
                    options.append((len(KEYS) * (extra + 1) + i, 1000 * (q + 1) + len(KEYS) * (extra + 1) + i, base | sum(1 << b for b in free[6 * q:6 * q + 6])))
    by_list: dict[int, list] = {}
    for old, new, mask in options:
        by_list.setdefault(old, []).append((new, mask - (1 << 64) if mask >> 63 else mask))
    table = F.create_map(*[x for old, cuts in by_list.items() for x in (F.lit(old), F.array(*[F.struct(F.lit(n).alias("list"), F.lit(m).cast("bigint").alias("mask")) for n, m in cuts]))])
    return rows.select("fingerprint", F.explode(table[F.col("list")]).alias("o")).select("o.list", F.col("fingerprint").bitwiseAND(F.col("o.mask")).alias("key"), "fingerprint")


def _forest(keys: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) that connect, within each run of equal keys, what pairs at MAX_BITS or fewer would:
    at most one link per row. Element i meets i + d for growing d, all runs at once, in arrays."""
    n = len(prints)
    root = np.arange(n)
    ends = np.concatenate([np.flatnonzero(np.any(keys[1:] != keys[:-1], axis=1)) + 1, [n]])
    left = np.repeat(ends, np.diff(np.concatenate([[0], ends]))) - np.arange(n) - 1  # how many follow in the run
    alive, d = np.flatnonzero(left > 0), 1
    view = prints.view(np.uint8).reshape(-1, 8)
    while len(alive):
        at = alive[np.bitwise_count(prints[alive] ^ prints[alive + d]) <= MAX_BITS]
        at = at[(view[at] == view[at + d]).sum(axis=1) >= MIN_SHARED]
        at = at[root[at] != root[at + d]]
        while len(at):
            low, high = np.minimum(root[at], root[at + d]), np.maximum(root[at], root[at + d])
            np.minimum.at(root, high, low)
            while not np.array_equal(root, nxt := root[root]):
                root = nxt
            at = at[root[at] != root[at + d]]
        d += 1
        alive = alive[left[alive] >= d]
    moved = np.flatnonzero(root != np.arange(n))
    return prints[moved], prints[root[moved]]


def _links(lists: DataFrame) -> DataFrame:
    """The links of each posting list, found while its rows stream by in key order."""
    def run(batches):
        kept_keys, kept = np.empty((0, 2), np.int64), np.empty(0, np.uint64)
        def out(keys, prints):
            a, b = _forest(keys, prints)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])
        for batch in batches:
            keys = np.stack([batch.column(0).to_numpy().astype(np.int64), batch.column(1).to_numpy()], axis=1)
            keys, prints = np.concatenate([kept_keys, keys]), np.concatenate([kept, batch.column(2).to_numpy().view(np.uint64)])
            last = np.flatnonzero(np.any(keys != keys[-1], axis=1))
            cut = last[-1] + 1 if len(last) else 0  # the last run may go on in the next batch
            if cut:
                yield out(keys[:cut], prints[:cut])
            kept_keys, kept = keys[cut:], prints[cut:]
        if len(kept):
            yield out(kept_keys, kept)

    return lists.repartition("list", "key").sortWithinPartitions("list", "key", "fingerprint").mapInArrow(run, "a bigint, b bigint")


def near_links(prints: DataFrame, max_list: int = 4096) -> DataFrame:
    """Links (a, b) between distinct fingerprints, enough to connect all that differ in MAX_BITS bits or
    fewer. prints: distinct fingerprints.

    Posting lists of one row are dropped before they move a second time. Lists of more than max_list rows
    are cut finer twice (see _refined), which loses no pair, so the work per row is bounded however many
    fingerprints crowd together, and a list that would hold a third of all is spread."""
    lists = staged(_listed(prints))
    found = []
    for step in range(3):
        sizes = lists.groupBy("list", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        sizes = staged(sizes)
        crowded = step < 2 and not sizes.where(F.col("n") > max_list).isEmpty()
        found.append(_links(lists.join(sizes.where(F.col("n") <= max_list) if crowded else sizes, ["list", "key"]).select("list", "key", "fingerprint")))
        if not crowded:
            break
        lists = staged(_refined(lists.join(sizes.where(F.col("n") > max_list), ["list", "key"], "left_semi"), step).distinct())
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def grouped(rows: DataFrame, max_list: int = 4096) -> DataFrame:
    """(fingerprint, component): the smallest fingerprint that chains of links reach. rows: fingerprint."""
    nodes = staged(rows.select("fingerprint").distinct())
    found = components(near_links(nodes, max_list)).withColumnRenamed("node", "fingerprint")
    return nodes.join(found, "fingerprint", "left").withColumn("component", F.coalesce("component", "fingerprint"))


def near_groups(df: DataFrame, id_col: str, text: str, width: int = 3, max_list: int = 4096) -> DataFrame:
    """One row per input row: id, fingerprint (16 hex digits) and component_id, the smallest id that
    chains of links (MAX_BITS or fewer differing bits) reach, its own included.

    Null and empty texts have fingerprint zero and link like any other. A null id is reached by others
    but never the smallest; a group with null ids only has a null component_id. Repeated rows link with each other.
    An empty table gives an empty table. Other columns may have any name.

    Rows with one fingerprint are one node, so exact copies never form pairs."""
    rows = staged(fingerprints(df, id_col, text, width))
    lows = rows.groupBy("fingerprint").agg(F.min("id").alias("low"))
    named = staged(grouped(rows, max_list).join(lows, "fingerprint"))
    lowest = named.groupBy("component").agg(F.min("low").alias("component_id"))
    labels = named.join(lowest, "component").select("fingerprint", "component_id")
    return rows.join(labels, "fingerprint").select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(df: DataFrame, id_col: str, text: str, width: int = 3, max_list: int = 4096) -> DataFrame:
    """df with one row of each group: the one with the smallest id (null last), then the smallest hash
    of its text. Ids, hashes and fingerprints decide; only rows repeated whole (same id and
    text) are shuffled to keep one of them."""
    mark = F.xxhash64(F.col(f"`{text}`"))
    rows = df.select(F.struct(F.col(f"`{id_col}`").alias("i"), mark.alias("m")).alias("id"), F.col(f"`{text}`").alias("text"))
    rows = staged(fingerprints(rows, "id", "text", width))
    nodes = rows.groupBy("fingerprint", "id").agg(F.count(F.lit(1)).alias("n"))
    first = nodes.groupBy("fingerprint").agg(F.min(F.struct(F.col("id.i").isNull().alias("z"), "id", "n")).alias("first"))
    lasting = grouped(rows, max_list).join(first, "fingerprint").groupBy("component").agg(F.min("first").alias("first"))
    lasting = staged(lasting.select(F.col("first.id.i").alias("_i"), F.col("first.id.m").alias("_m"), (F.col("first.n") > 1).alias("_again")))

    def of(keys):
        return df.join(keys, F.col(f"`{id_col}`").eqNullSafe(keys["_i"]) & (mark == keys["_m"]), "left_semi")

    return of(lasting.where("NOT _again")).unionByName(of(lasting.where("_again")).dropDuplicates())
