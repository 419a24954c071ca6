"""Groups of texts whose word shingles reach a Jaccard similarity, from lists of candidates.

A node is a distinct shingle set. A list holds nodes that may be similar. Nodes of a list ask each other in tasks that
see no sets but short tables of counts, which bound an overlap from above, so no similar pair is passed over. What
is asked is then compared on the whole sets. Nodes that links connect by then don't ask each other again.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentrylake.llm.common import LOWER, bounded, utf8
from sentrylake.llm.exactdedup import flagged, repeat_filter
from sentrylake.llm.graph import components
from sentrylake.session import staged

#: Counters of a set's table; lists of more than CROWD nodes are met in blocks of half as many, and a pair that shares
#: several lists of more than SHARED nodes is asked in one of them.
COUNTERS, CROWD, SHARED = 256, 1024, 128
#: Tables of ids up to this number of rows (some 64 bytes each) are broadcast, larger ones are joined by a shuffle.
FEW = 1 << 14
_ODD = np.random.default_rng(7).integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: bytes, width: int) -> np.ndarray:
    """64-bit numbers of the distinct shingles of `width` words, A-Z lower-cased, ascending. Fewer words are one
    shingle; no words give none. A shingle's number is mixed from its words' XXH64 and their places."""
    words = text.translate(LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    if len(words) < width:
        return np.array([digest(b" ".join(words), 1)], np.uint64)
    one = np.fromiter(map(digest, words), np.uint64, len(words))
    n = len(words) - width + 1
    total = np.zeros(n, np.uint64)
    for i in range(width):
        total += (one[i:i + n] ^ (one[i:i + n] >> np.uint64(29))) * _ODD[i]
    # Two rounds of multiply and shift, so that every bit of a number depends on every word.
    total = (total ^ (total >> np.uint64(32))) * _ODD[62]
    total = (total ^ (total >> np.uint64(29))) * _ODD[63]
    return np.unique(total ^ (total >> np.uint64(32)))


def table(hashes: np.ndarray) -> bytes:
    """How many of the hashes fall to each counter, halved and rounded up until a byte holds them; the first byte says how often."""
    counts, shift = np.bincount((hashes >> np.uint64(56)).astype(np.int64), minlength=COUNTERS), 0
    while counts.max(initial=0) > 255:
        counts, shift = (counts + 1) >> 1, shift + 1
    return bytes([shift]) + counts.astype(np.uint8).tobytes()


def _short(table: bytes) -> bytes:
    """A table whose counts are all below 16 in half a byte each; any other as it is."""
    counts = np.frombuffer(table, np.uint8)
    if counts[0] or counts.max() > 15:
        return table
    low, high = counts[1:].reshape(2, -1)
    return (low | high << 4).tobytes()


def _counts(tables: list[bytes]) -> np.ndarray:
    """The counts of tables, short ones or not, a row each."""
    short = np.array([len(x) == COUNTERS // 2 for x in tables])
    counts = np.zeros((len(tables), COUNTERS), np.uint8)
    halves = np.frombuffer(b"".join(x for x in tables if len(x) == COUNTERS // 2), np.uint8).reshape(-1, COUNTERS // 2)
    counts[short] = np.hstack([halves & 15, halves >> 4])
    if not short.all():
        raw = np.frombuffer(b"".join(x for x in tables if len(x) != COUNTERS // 2), np.uint8).reshape(-1, COUNTERS + 1)
        counts[~short] = raw[:, 1:]
        if raw[:, 0].any():
            shifts = np.zeros((len(tables), 1), np.int64)
            shifts[~short] = raw[:, :1]
            counts = counts.astype(np.int64) << shifts
    return counts


def nodes_of(df: DataFrame, id_col: str, text: str, width: int, marks: Callable[[np.ndarray], bytes]) -> DataFrame:
    """(id, node, n, table, marks, digest) of every row: the digest of its shingle set, its size, table and marks
    (min-hashes or the like; empty without shingles) and the digest of its text."""
    rows = bounded(df).select(F.col(id_col).alias("id"), F.col(text).alias("text"))

    def run(batches):
        for batch in batches:
            texts = utf8(batch, "text")
            sets = [shingles(x, width) for x in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([_short(table(s)) for s in sets], pa.binary()), pa.array([marks(s) if len(s) else b"" for s in sets], pa.binary()), pa.array([_digest(x) for x in texts], pa.binary())],
                ["id", "node", "n", "table", "marks", "digest"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, node binary, n bigint, table binary, marks binary, digest binary")


def _digest(text: bytes) -> bytes:
    """Thirty-two bytes, as the filter of exactdedup takes them."""
    return xxhash.xxh3_128_digest(text) + xxhash.xxh3_128_digest(text, 1)


def _sets(df: DataFrame, text: str, width: int, digests: DataFrame) -> DataFrame:
    """(node, hashes) of the texts with one of these digests, and of a few others. A filter of bounded size (see
    exactdedup) is broadcast, so no text is shuffled."""
    shared, n_bits = repeat_filter(digests.unionAll(digests), 1 << 30)
    rows = bounded(df).select(F.col(text).alias("text"))

    def run(batches):
        twice, seen = np.frombuffer(shared.value, dtype=np.uint8), set()
        for batch in batches:
            texts = utf8(batch, "text")
            keys = [_digest(x) for x in texts]
            words = np.frombuffer(b"".join(keys), dtype="<u8").reshape(-1, 4)[:, :3] % np.uint64(n_bits)
            hit = ((twice[words >> np.uint64(3)] >> (np.uint64(7) - (words & np.uint64(7))).astype(np.uint8)) & 1).all(axis=1)
            sets = []
            for i in np.flatnonzero(hit):
                if keys[i] not in seen:
                    seen.add(keys[i])
                    sets.append(shingles(texts[i], width).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(s) for s in sets], pa.binary()), pa.array(sets, pa.binary())], ["node", "hashes"])

    found = staged(rows.mapInArrow(run, "node binary, hashes binary"))
    shared.unpersist()
    # Tasks may have met copies of one text; only such sets move to leave one of each.
    again = staged(found.groupBy("node").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("node"))
    if again.isEmpty():
        return found
    several = again.count() > FEW
    again = again if several else F.broadcast(again)
    once = found.join(again, "node", "left_anti").unionByName(staged(found.join(again, "node", "left_semi").dropDuplicates(["node"])))
    return staged(once) if several else once


def _asked(rows: DataFrame, most: int, part: int, whole: int, tasks: int) -> DataFrame:
    """(a, b, ca, cb, score, more, key): for nodes b of a group, nodes a before it, of other components, that the tables allow
    to be as similar as part / whole and that `no` doesn't name. With most = 1 the one whose tables agree best, otherwise
    the first `most`; more says that b may have others in this list. big: the large lists of a node; nodes that share
    several ask in the one with the smallest key only. rows: key, i, j, block, node, n, table, c, no, big."""
    def ask(key, block, node, n, tables, c, no, big):
        """One or several whole groups, sorted by group and node."""
        size = len(n)
        starts = np.concatenate([[0], np.flatnonzero(np.any(key[1:] != key[:-1], axis=1)) + 1])
        before = np.arange(size) - np.repeat(starts, np.diff(np.concatenate([starts, [size]])))
        counts = _counts(tables)
        inside = key[:, 1] == key[:, 2]
        found, best, out = np.zeros(size, np.int64), np.zeros(size), {}
        alive, d = np.flatnonzero(before > 0), 1
        while len(alive):
            other = alive - d
            low, high = np.minimum(n[alive], n[other]), np.maximum(n[alive], n[other])
            may = (whole * low >= part * high) & (c[alive] != c[other]) & (inside[alive] | (block[alive] != block[other]))
            for at in np.array_split(alive[may], max(1, may.sum() // 4096)):
                shared, both = np.minimum(counts[at], counts[at - d]).sum(axis=1, dtype=np.int64), n[at] + n[at - d]
                passed, score = (part + whole) * shared >= part * both, shared / both
                if most == 1:
                    passed &= score > best[at]
                for b, x in zip(at[passed].tolist(), score[passed].tolist()):
                    if node[b - d] not in no[b] and node[b] not in no[b - d] and not any(k < key[b, 0] for k in big[b] & big[b - d]):
                        if most == 1:
                            best[b], out[b] = x, (b - d, b, x)
                        else:
                            out[b, found[b]] = b - d, b, x
                            found[b] += 1
            d += 1
            alive = alive[(before[alive] >= d) & (found[alive] < most)]
        return [(a, b, x, bool(found[b] >= most or most == 1)) for a, b, x in out.values()]

    def run(batches):
        kept, held = [], 0

        def emit(last):
            merged = pa.Table.from_batches(kept).combine_chunks()
            key = np.stack([merged.column(x).to_numpy().astype(np.int64) for x in ("key", "i", "j")], axis=1)
            cut = merged.num_rows
            if not last:  # the last group may go on in the next batch
                ends = np.flatnonzero(np.any(key[1:] != key[:-1], axis=1))
                cut = int(ends[-1]) + 1 if len(ends) else 0
            now, answer = merged.slice(0, cut), None
            if cut:
                node, c = now.column("node").to_pylist(), now.column("c").to_pylist()
                numbers = {x: i for i, x in enumerate(dict.fromkeys(c))}
                pairs = ask(key[:cut], now.column("block").to_numpy(), node, now.column("n").to_numpy(), now.column("table").to_pylist(), np.array([numbers[x] for x in c]), [x or () for x in now.column("no").to_pylist()],
                            [frozenset(x or ()) for x in now.column("big").to_pylist()])
                if pairs:
                    a, b, score, more = zip(*pairs)
                    answer = pa.RecordBatch.from_arrays([*[pa.array([x[i] for i in at], pa.binary()) for x in (node, c) for at in (a, b)], pa.array(score), pa.array(more), pa.array(key[list(b), 0])],
                                                        ["a", "b", "ca", "cb", "score", "more", "key"])
            return answer, merged.slice(cut).to_batches()

        for batch in batches:
            kept.append(batch)
            held += batch.num_rows
            if held >= 8192:
                answer, kept = emit(False)
                held = sum(b.num_rows for b in kept)
                if answer:
                    yield answer
        if held:
            answer, _ = emit(True)
            if answer:
                yield answer

    grouped = rows.repartition("key", "i", "j").coalesce(tasks).sortWithinPartitions("key", "i", "j", "node")
    return grouped.select("key", "i", "j", "block", "node", "n", "table", "c", "no", "big").mapInArrow(run, "a binary, b binary, ca binary, cb binary, score double, more boolean, key bigint")


def _few(df: DataFrame) -> DataFrame:
    """df, to be broadcast if it has at most FEW rows; a larger one is joined as it comes."""
    return F.broadcast(df) if df.count() <= FEW else df


def _compared(pairs: DataFrame, sets: DataFrame, part: int, whole: int, tasks: int) -> DataFrame:
    """pairs (a, b, ca, cb) and `good`: whether their sets are as similar as part / whole."""
    def run(batches):
        for batch in batches:
            good = []
            for x, y in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                same = len(np.intersect1d(x, y, assume_unique=True))
                good.append((part + whole) * same >= part * (len(x) + len(y)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(good, pa.bool_())], ["a", "b", "ca", "cb", "good"])

    own = sets.join(_few(pairs.select(F.col("a").alias("node"))), "node", "left_semi").select(F.col("node").alias("a"), F.col("hashes").alias("x"))
    asking = sets.select(F.col("node").alias("b"), F.col("hashes").alias("y")).join(_few(pairs), "b")
    return asking.join(own, "a").select("a", "b", "ca", "cb", "x", "y").coalesce(tasks).mapInArrow(run, "a binary, b binary, ca binary, cb binary, good boolean")


def _merged(links: DataFrame) -> DataFrame:
    """(node, component) of links (a, b). Up to FEW links (32 bytes each) are united in one task, more in rounds of joins."""
    if links.count() > FEW:
        return components(links)

    def run(batches):
        root: dict[bytes, bytes] = {}

        def find(x):
            while root.setdefault(x, x) != x:
                root[x] = x = root[root[x]]
            return x
        for batch in batches:
            for a, b in zip(*(c.to_pylist() for c in batch.columns)):
                low, high = sorted((find(a), find(b)))
                root[high] = low
        if root:
            nodes = list(root)
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array([find(x) for x in nodes], pa.binary())], ["node", "component"])

    return staged(links.select("a", "b").coalesce(1).mapInArrow(run, "node binary, component binary"))


def _met(rows: DataFrame, crowded: DataFrame | None, first: bool) -> DataFrame:
    """rows (key, node, c) dealt into groups (key, i, j). A list of up to CROWD nodes is one group. Longer ones (crowded:
    key, size) are cut into blocks by a hash: at first a block meets itself; then every two blocks meet, but
    those that hold only nodes of the list's main component."""
    if crowded is None:
        return rows.select("*", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("block"))
    half, mark = CROWD // 2, F.xxhash64("node")
    plain = rows.join(_few(crowded.select("key")), "key", "left_anti").select("*", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("block"))
    dense = rows.join(_few(crowded), "key")
    if first:
        dense = dense.withColumn("block", F.pmod(mark, F.ceil(F.col("size") / half)).cast("int"))
        dense = dense.withColumn("i", F.col("block")).withColumn("j", F.col("block"))
    else:
        mains = dense.groupBy("key", "c").agg(F.count(F.lit(1)).alias("k")).groupBy("key").agg(F.max(F.struct("k", "c")).alias("m"))
        dense = dense.join(_few(staged(mains.select("key", F.col("m.k").alias("mains"), F.col("m.c").alias("main")))), "key")
        front = F.ceil(F.col("mains") / half).cast("int")
        back = F.ceil((F.col("size") - F.col("mains")) / half).cast("int")
        inner = F.col("c") == F.col("main")
        dense = dense.withColumn("block", F.when(inner, F.pmod(mark, front)).otherwise(front + F.pmod(mark, back)).cast("int"))
        met = F.when(inner, F.sequence(front, front + back - 1)).otherwise(F.sequence(F.lit(0), front + back - 1))
        dense = dense.withColumn("with", F.explode(met)).withColumn("i", F.least("block", "with")).withColumn("j", F.greatest("block", "with"))
    return plain.unionByName(dense.select(*plain.columns))


def linked(lists: DataFrame, nodes: DataFrame, df: DataFrame, text: str, width: int, part: int, whole: int) -> DataFrame:
    """(node, component) of the nodes that lists hold, by the pairs of one list as similar as part / whole: each such
    pair is in one component or was compared.

    lists: key, early, node; early marks the lists of the first round, with all their nodes. nodes: node, n, table, digest.
    In a round each node asks the one other of its lists that may be closest (from the third round on 64 a list, then
    4,096 ...), whole sets are compared for what was asked, and components join. Lists within one component are left out
    from then on, and so are those that were met whole and in which nobody may have others to ask. Pairs that
    fail are remembered at their nodes and not asked again, so rounds end: with one in which all that is left was asked.
    From the second round on a pair that shares several large lists is asked in one of them, so that near copies, which
    share most of their lists, don't make a row for each list and pair."""
    nodes = staged(nodes.join(lists.select("node").distinct(), "node", "left_semi").select("node", "n", "table", "digest"))
    sets = _sets(df, text, width, nodes.select("digest"))
    labels = nodes.select("node", F.col("node").alias("component"))
    large = staged(lists.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > SHARED))
    big = staged(lists.join(_few(large.select("key")), "key", "left_semi").groupBy("node").agg(F.collect_set("key").alias("big")))
    crowded = large.where(F.col("size") > CROWD)
    crowded = None if crowded.isEmpty() else crowded
    left, failed = lists.select("key", "early", "node"), None
    # Rounds handle fewer rows than there are shuffle partitions for; a task of Python has some thousands of rows at least.
    size = lists.count()
    few, tasks = max(8, size // 50_000), max(8, size // 10_000)
    turn, most = 0, 1
    while True:
        if turn == 0:  # each node is its own component
            rows = left.where("early").withColumn("c", F.col("node"))
        else:
            named = staged(left.join(_few(labels.select("node", F.col("component").alias("c"))), "node").coalesce(few))
            several = named.groupBy("key").agg(F.min("c").alias("_a"), F.max("c").alias("_b")).where("_a != _b").select("key")
            left = rows = staged(named.join(several, "key", "left_semi").coalesce(few))
            left = left.drop("c")
        facts = nodes.select("node", "n", "table")
        if failed is None:
            facts = facts.withColumn("no", F.lit(None).cast("array<binary>"))
        else:  # as many as a node was refused
            facts = facts.join(_few(staged(failed.groupBy("node").agg(F.collect_set("other").alias("no")))), "node", "left")
        # The first round sees some lists only, so a pair's smallest list may not be among them.
        facts = facts.withColumn("big", F.lit(None).cast("array<bigint>")) if turn == 0 else facts.join(_few(big), "node", "left")
        asked = _asked(_met(rows.select("key", "node", "c"), crowded, turn == 0).join(facts, "node"), most, part, whole, tasks)
        if most == 1:
            asked = asked.groupBy("b").agg(F.max(F.struct("score", "a", "ca", "cb")).alias("m"), F.collect_set("key").alias("open")).select("m.a", "b", "m.ca", "m.cb", "open")
        else:
            asked = asked.groupBy("a", "b", "ca", "cb").agg(F.collect_set(F.when(F.col("more"), F.col("key"))).alias("open"))
        pairs = staged(asked.coalesce(few))
        # The lists in which a node may have others to ask; elsewhere no pair is left to compare.
        again = staged(pairs.select(F.explode("open").alias("key")).distinct().coalesce(few))
        last = turn > 0 and again.isEmpty()
        if turn == 0:  # early lists that were cut into blocks were not met whole
            again = again if crowded is None else again.unionByName(crowded.select("key")).distinct()
            early = left.where("early").join(_few(again), "key", "left_semi")
            left = left.where("NOT early").unionByName(early.select(*left.columns))
        else:
            left = left.join(_few(again), "key", "left_semi")
        if not pairs.isEmpty():
            result = staged(_compared(pairs.drop("open"), sets, part, whole, tasks))
            good = result.where("good").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
            if not good.isEmpty():
                joined = _merged(good).select(F.col("node").alias("component"), F.col("component").alias("to"))
                labels = staged(labels.join(_few(joined), "component", "left").select("node", F.coalesce("to", "component").alias("component")).coalesce(few))
            refused = result.where("NOT good").select(F.col("b").alias("node"), F.col("a").alias("other"))
            if not refused.isEmpty():
                failed = refused if failed is None else failed.unionByName(refused)
        if last:
            return labels
        turn += 1
        most = 1 if turn < 2 else most * 64
