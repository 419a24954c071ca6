"""Time-window operators that stay parallel inside one hot key.

All four work on integer microseconds. Rows are first reduced to one row per
(key, instant) or (key, value, time bucket) with map-side partial aggregation, then
a sweep line runs over signed changes. The sweep is cut into time buckets one window
wide, so a single key is spread over as many tasks as it has buckets.
"""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sentrylake.session import FREED, held, removed, staged, staged_at

SECOND = 1_000_000


def bucket_of(pos: Column, width: int) -> Column:
    """Index of the time bucket holding pos (integer arithmetic, also below zero)."""
    return ((pos - F.pmod(pos, F.lit(width))) / F.lit(width)).cast("bigint")


def running_total(changes: DataFrame, keys: list[str], pos: str, delta: str, width: int,
                  out: str = "running") -> DataFrame:
    """Sum of delta over all rows of the key with position <= pos.

    Each (key, bucket) is summed on its own; the total of the earlier buckets enters it
    as one carry row, so no task holds more than one bucket of a key.
    """
    rows = changes.withColumn("_b", bucket_of(F.col(pos), width))
    totals = rows.groupBy(*keys, "_b").agg(F.sum(delta).alias("_t"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(
        *keys, "_b", (F.col("_b") * width - 1).alias(pos),
        F.coalesce(F.sum("_t").over(before), F.lit(0)).alias(delta), F.lit(True).alias("_carry"))
    both = rows.withColumn("_carry", F.lit(False)).unionByName(carry, allowMissingColumns=True)
    upto = Window.partitionBy(*keys, "_b").orderBy(pos)
    return (both.withColumn(out, F.sum(delta).over(upto))
            .where(~F.col("_carry")).drop("_b", "_carry"))


def window_counts(rows: DataFrame, keys: list[str], window_us: int, ts: str = "ts_us",
                  weight: Column | None = None) -> DataFrame:
    """For every instant t of a key: number of rows in [t - window, t] as run_n."""
    wide = window_us + 1
    w = F.lit(1) if weight is None else weight
    instants = rows.groupBy(*keys, ts).agg(F.sum(w).cast("bigint").alias("_n"))
    b = bucket_of(F.col(ts), wide)
    # One entry where it happens, one carried to the start of the next bucket, and its
    # removal there; a window never reaches back further than the previous bucket.
    entries = F.array(
        F.struct(b.alias("b"), F.col(ts).alias("p"), F.col("_n").alias("d"), F.lit(True).alias("h")),
        F.struct((b + 1).alias("b"), ((b + 1) * wide - 1).alias("p"), F.col("_n").alias("d"), F.lit(False).alias("h")),
        F.struct((b + 1).alias("b"), (F.col(ts) + wide).alias("p"), (-F.col("_n")).alias("d"), F.lit(False).alias("h")),
    )
    flat = instants.select(*keys, F.explode(entries).alias("e")).select(*keys, "e.*")
    upto = Window.partitionBy(*keys, "b").orderBy("p")
    return (flat.withColumn("run_n", F.sum("d").over(upto)).where("h")
            .select(*keys, F.col("p").alias("run_end"), "run_n"))


def densest_run(rows: DataFrame, keys: list[str], window_us: int, min_n: int = 1,
                ts: str = "ts_us") -> DataFrame:
    """Largest set of rows spanning at most the window, first one on ties: run_n, run_end."""
    counts = window_counts(rows, keys, window_us, ts)
    best = counts.groupBy(*keys).agg(
        F.max(F.struct(F.col("run_n"), (-F.col("run_end")).alias("neg"))).alias("m"))
    return (best.select(*keys, F.col("m.run_n").alias("run_n"), (-F.col("m.neg")).alias("run_end"))
            .where(F.col("run_n") >= min_n))


def _value_buckets(rows: DataFrame, keys: list[str], value: str, window_us: int, ts: str) -> DataFrame:
    """A row per key, value and bucket: two occurrences in one bucket are never more than a window apart, so only the first
    and the last one of a bucket can open or close the presence of a value."""
    return (rows.where(F.col(ts).isNotNull()).withColumn("_vb", bucket_of(F.col(ts), window_us + 1)).groupBy(*keys, value, "_vb")
            .agg(F.min(ts).alias("_lo"), F.max(ts).alias("_hi")))


def distinct_sweep(rows: DataFrame, keys: list[str], value: str, window_us: int,
                   ts: str = "ts_us") -> DataFrame:
    """Number of distinct values in [t - window, t], at each t where it can change: run_end, run_k.

    Rows meet by key and a span of 16 buckets. What the last bucket of a span holds is seen by the next span too, as
    a window reaches no further back, so spans need no totals of each other. Rows without a time are left out."""
    return _swept(_value_buckets(rows, keys, value, window_us, ts), keys, value, window_us)


def _swept(seen: DataFrame, keys: list[str], value: str, window_us: int) -> DataFrame:
    wide = window_us + 1
    span = bucket_of(F.col("_lo"), wide * 16)
    spans = F.when(F.pmod(F.col("_vb"), F.lit(16)) == 15, F.array(span, span + 1)).otherwise(F.array(span))
    # The three steps below need rows of a key and span together, so they share this one shuffle.
    seen = seen.select(*keys, value, "_lo", "_hi", F.explode(spans).alias("_b")).repartition(*keys, "_b")
    order = Window.partitionBy(*keys, "_b", value).orderBy("_lo")
    seen = seen.withColumn("_prev", F.lag("_hi").over(order)).withColumn("_next", F.lead("_lo").over(order))
    opens = F.when(F.col("_prev").isNull() | (F.col("_lo") - F.col("_prev") > window_us),
                   F.struct(F.col("_lo").alias("p"), F.lit(1).alias("d")))
    closes = F.when(F.col("_next").isNull() | (F.col("_next") - F.col("_hi") > window_us),
                    F.struct((F.col("_hi") + wide).alias("p"), F.lit(-1).alias("d")))
    changes = (seen.select(*keys, "_b", F.explode(F.array_compact(F.array(opens, closes))).alias("e"))
               .select(*keys, "_b", F.col("e.p").alias("run_end"), F.col("e.d").alias("_d")))
    upto = Window.partitionBy(*keys, "_b").orderBy("run_end")
    return (changes.withColumn("run_k", F.sum("_d").over(upto))
            .where(bucket_of(F.col("run_end"), wide * 16) == F.col("_b")).select(*keys, "run_end", "run_k"))


def most_distinct_run(rows: DataFrame, keys: list[str], value: str, window_us: int,
                      min_k: int = 1, ts: str = "ts_us") -> DataFrame:
    """End of the first window holding the most distinct values: run_k, run_end.

    A value that also has rows without a time counts once more in run_k: such a row may lie in any window."""
    return _best(_value_buckets(rows, keys, value, window_us, ts), rows, keys, value, window_us, min_k, ts)


def written_distinct_run(rows: DataFrame, keys: list[str], value: str, window_us: int,
                         min_k: int = 1, ts: str = "ts_us") -> DataFrame:
    """most_distinct_run, written. The value buckets are written between the two large shuffles and deleted afterwards, so
    that these are not on disk at the same time."""
    spark = rows.sparkSession
    with held(spark, FREED):
        seen, folder = staged_at(_value_buckets(rows, keys, value, window_us, ts))
        best = staged(_best(seen, rows, keys, value, window_us, min_k, ts))
        removed(spark, folder)
    return best


def _best(seen: DataFrame, rows: DataFrame, keys: list[str], value: str, window_us: int, min_k: int, ts: str) -> DataFrame:
    sweep = _swept(seen, keys, value, window_us)
    undated = staged(rows.where(F.col(ts).isNull()).select(*keys, value).distinct())
    if not undated.isEmpty():
        dated = rows.where(F.col(ts).isNotNull()).select(*keys, value)
        both = undated.join(dated, same_keys(undated, dated, [*keys, value], [*keys, value]), "left_semi")
        more = both.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.count(F.lit(1)).alias("_more"))
        met = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
        sweep = sweep.join(more, met, "left").select(*keys, (F.col("run_k") + F.coalesce("_more", F.lit(0))).alias("run_k"), "run_end")
    # Before the rows meet by key, as most have too few values wherever they are.
    best = sweep.where(F.col("run_k") >= min_k).groupBy(*keys).agg(
        F.max(F.struct(F.col("run_k"), (-F.col("run_end")).alias("neg"))).alias("m"))
    return best.select(*keys, F.col("m.run_k").alias("run_k"), (-F.col("m.neg")).alias("run_end"))


def same_keys(left: DataFrame, right: DataFrame, keys: list[str], nullable=()) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & (left[k].eqNullSafe(right[k]) if k in nullable else left[k] == right[k])
    return cond


def run_rows(rows: DataFrame, best: DataFrame, keys: list[str], window_us: int,
             ts: str = "ts_us") -> DataFrame:
    """Rows of each best run. `best` has one row per qualifying key. They meet by key and time bucket, of which a
    run touches two at most, so a key with most of the rows is spread over its buckets."""
    first, last = (bucket_of(x, window_us + 1) for x in (F.col("run_end") - window_us, F.col("run_end")))
    r = rows.withColumn("_vb", bucket_of(F.col(ts), window_us + 1)).alias("r")
    b = best.withColumn("_vb", F.explode(F.array_distinct(F.array(first, last)))).alias("b")
    cond = [F.col(f"r.{k}") == F.col(f"b.{k}") for k in [*keys, "_vb"]]
    inside = F.col(f"r.{ts}").between(F.col("b.run_end") - window_us, F.col("b.run_end"))
    extra = [F.col(f"b.{c}") for c in best.columns if c not in keys]
    return r.join(b, cond + [inside], "inner").select(*[F.col(f"r.`{c}`") for c in rows.columns], *extra)


def distinct_run_rows(rows: DataFrame, best: DataFrame, keys: list[str], value: str,
                      window_us: int, order_id: str = "event_id", ts: str = "ts_us") -> DataFrame:
    """Rows of each most-distinct run, cut at the row that completes the distinct set.

    Only rows sharing the last instant can lie behind that row, and they are told apart
    by order_id; only they move to meet the cut.
    """
    inside = staged(run_rows(rows, best, keys, window_us, ts))
    firsts = inside.groupBy(*keys, value).agg(F.min(F.struct(ts, order_id)).alias("_f"))
    cut = firsts.groupBy(*keys).agg(F.max("_f").alias("_cut"))
    at_end = inside.where(F.col(ts) == F.col("run_end")).join(cut, keys)
    return inside.where(F.col(ts) < F.col("run_end")).unionByName(at_end.where(F.struct(ts, order_id) <= F.col("_cut")).drop("_cut"))


def largest_mixed_run(rows: DataFrame, keys: list[str], value: str, window_us: int,
                      ts: str = "ts_us") -> DataFrame:
    """Largest window holding more than one distinct value: run_n, run_end."""
    wide = window_us + 1
    inst = rows.groupBy(*keys, ts).agg(
        F.count(F.lit(1)).alias("_n"), F.min(value).alias("_mn"), F.max(value).alias("_mx"))
    b = bucket_of(F.col(ts), wide)
    none = F.lit(None)

    def entry(bucket, pos, delta, live, home):
        keep = F.lit(live)
        return F.struct(bucket.alias("b"), pos.alias("p"), delta.alias("d"),
                        F.when(keep, F.col("_mn")).alias("mn"), F.when(keep, F.col("_mx")).alias("mx"),
                        F.when(keep, F.col(ts)).alias("t"), F.lit(home).alias("h"))
    entries = F.array(entry(b, F.col(ts), F.col("_n"), True, True),
                      entry(b + 1, F.col(ts), F.col("_n"), True, False),
                      entry(b + 1, F.col(ts) + wide, -F.col("_n"), False, False))
    flat = inst.select(*keys, F.explode(entries).alias("e")).select(*keys, "e.*")
    part = Window.partitionBy(*keys, "b").orderBy("p", F.col("t").isNull())
    before = part.rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*keys, "b").orderBy("p")
    prev_t = F.last("t", True).over(before)
    differs = (F.last("mn", True).over(before) != F.col("mn")) | (F.last("mx", True).over(before) != F.col("mn"))
    pair = F.when(F.col("t").isNull(), none).when(F.col("mn") != F.col("mx"), F.col("t")).when(differs, prev_t)
    out = (flat.withColumn("_pair", pair)
           .withColumn("run_n", F.sum("d").over(upto))
           .withColumn("_mixed", F.max("_pair").over(upto))
           .where("h").where(F.col("_mixed") >= F.col("p") - window_us))
    best = out.groupBy(*keys).agg(F.max(F.struct(F.col("run_n"), (-F.col("p")).alias("neg"))).alias("m"))
    return best.select(*keys, F.col("m.run_n").alias("run_n"), (-F.col("m.neg")).alias("run_end"))


def previous_instant(instants: DataFrame, keys: list[str], ts: str = "ts_us",
                     width: int = 86_400 * SECOND, out: str = "prev_us") -> DataFrame:
    """Position of the preceding row of the key, split into time buckets."""
    rows = instants.withColumn("_b", bucket_of(F.col(ts), width))
    last = rows.groupBy(*keys, "_b").agg(F.max(ts).alias("_last"))
    order = Window.partitionBy(*keys).orderBy("_b")
    carry = (last.withColumn(ts, F.lag("_last").over(order)).drop("_last")
             .where(F.col(ts).isNotNull()).withColumn("_carry", F.lit(True)))
    both = rows.withColumn("_carry", F.lit(False)).unionByName(carry, allowMissingColumns=True)
    part = Window.partitionBy(*keys, "_b").orderBy(ts)
    return both.withColumn(out, F.lag(ts).over(part)).where(~F.col("_carry")).drop("_b", "_carry")


def exact_median(values: DataFrame, keys: list[str], value: str, width: int,
                 out: str = "median2") -> DataFrame:
    """Twice the exact median of an integer column per key (twice, so it stays an integer)."""
    freq = values.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    totals = freq.groupBy(*keys).agg(F.sum("_c").alias("_n"))
    ranked = running_total(freq, keys, value, "_c", width, "_cum").join(totals, keys)
    lower = F.min(F.when(F.col("_cum") > F.floor((F.col("_n") - 1) / 2), F.col(value)))
    upper = F.min(F.when(F.col("_cum") > F.floor(F.col("_n") / 2), F.col(value)))
    return ranked.groupBy(*keys).agg((lower + upper).alias(out))


def exact_percentile(values: DataFrame, keys: list[str], value: str, share: float, width: int, out: str = "percentile") -> DataFrame:
    """The exact percentile (share of 0 to 1) of an integer column per key, between two neighbours in proportion to
    their distance. Values are counted first, so a key with most of the rows is one row per distinct value."""
    freq = values.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    totals = freq.groupBy(*keys).agg(((F.sum("_c") - 1) * share).alias("_k"))
    ranked = running_total(freq, keys, value, "_c", width, "_cum").join(totals, keys)
    lower = F.min(F.when(F.col("_cum") > F.floor("_k"), F.col(value)))
    upper = F.min(F.when(F.col("_cum") > F.ceil("_k"), F.col(value)))
    part = F.max(F.col("_k") - F.floor("_k"))
    return ranked.groupBy(*keys).agg((lower + (upper - lower) * part).cast("double").alias(out))


# --- consecutive batches -------------------------------------------------------------

def _chain_ends(keys: list[str], wide: int, chunk_us: int):
    """Per (key, chunk): where a chain of batches entering at each possible first row leaves."""
    def finish(head, chains):
        ends = [(hi, anchor + wide) for anchor, his in chains for hi in his]
        return pd.DataFrame([(*head, hi, leave) for hi, leave in sorted(ends)],
                            columns=[*keys, "_chunk", "cand", "leave"])

    def work(batches):
        head, chains, limit, closed = None, deque(), 0, False
        for pdf in batches:
            for row in zip(*[pdf[c] for c in [*keys, "_chunk", "_ts"]]):
                t, this = row[-1], row[:-1]
                if this != head:
                    if head is not None:
                        yield finish(head, chains)
                    head, chains, closed = this, deque(), False
                    limit = this[-1] * chunk_us + wide
                if not closed:
                    closed = t >= limit
                    entering = [t]
                else:
                    entering = []
                moved = []
                while chains and chains[0][0] + wide <= t:
                    moved.extend(chains.popleft()[1])
                if moved or entering:
                    chains.append((t, moved + entering))
        if head is not None:
            yield finish(head, chains)
    return work


def _assign_anchor(keys: list[str], wide: int):
    def work(batches):
        head, anchor = None, None
        for pdf in batches:
            anchors = []
            for row in zip(*[pdf[c] for c in [*keys, "_chunk", "_ts", "_ready", "_open"]]):
                t, ready, opened, this = row[-3], row[-2], row[-1], row[:-3]
                if this != head:
                    head, anchor = this, opened
                if t >= ready and (anchor < ready or anchor + wide <= t):
                    anchor = t
                anchors.append(anchor)
            out = pdf[[*keys, "_ts"]].copy()
            out["anchor"] = anchors
            yield out
    return work


def _entries(ends: DataFrame, keys: list[str], wide: int, chunk_us: int) -> DataFrame:
    """(keys, _chunk, _ready): the earliest instant at which a new batch may start in each chunk.

    ends has a row per possible entry: keys, _chunk, cand, leave. The entry after it is the first one at or after leave.
    A chunk that all its entries leave at one point, and that no open batch can cover, leaves there in any case;
    the entries after such chunks and the first of a key are certain. From them marks travel along the pointers, which
    double in reach each round, so a run of n undecided chunks takes log2(n) rounds."""
    part = Window.partitionBy(*keys, "_chunk")
    firsts = ends.groupBy(*keys, "_chunk").agg(F.min("cand").alias("first"), F.max("cand").alias("last"), F.min("leave").alias("lo"), F.max("leave").alias("hi"))
    # One row per chunk of a key: as many as a key has spans of time.
    order = Window.partitionBy(*keys).orderBy("_chunk")
    chunks = staged(firsts.withColumn("follow", F.lead("first").over(order)).withColumn("begin", F.row_number().over(order) == 1))
    asks = ends.select(*keys, bucket_of(F.col("leave"), chunk_us).alias("_chunk"), F.col("leave").alias("at"), F.col("cand").alias("asker"), F.col("_chunk").alias("home"))
    both = asks.unionByName(ends.select(*keys, "_chunk", F.col("cand").alias("at"), F.lit(None).cast("bigint").alias("asker"), F.lit(None).cast("bigint").alias("home")))
    # Read backwards, the last entry seen is the first one at or after; an entry at the same instant counts.
    back = part.orderBy(F.desc("at"), F.col("asker").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    seen = F.last(F.when(F.col("asker").isNull(), F.col("at")), True).over(back)
    same = both.withColumn("there", seen).where(F.col("asker").isNotNull()).select(*keys, F.col("home").alias("_chunk"), F.col("asker").alias("cand"), "there")
    # Without an entry in the chunk that leave falls into, the next chunk with rows follows.
    beyond = chunks.select(*keys, F.col("_chunk").alias("_into"), F.col("follow").alias("_then"), F.lit(True).alias("_filled"))
    nodes = ends.join(same, [*keys, "_chunk", "cand"]).join(chunks.select(*keys, "_chunk", "follow"), [*keys, "_chunk"])
    nodes = nodes.withColumn("_into", bucket_of(F.col("leave"), chunk_us)).join(beyond, [*keys, "_into"], "left")
    after = F.when(F.col("there").isNotNull(), F.col("there")).when(F.col("_filled"), F.col("_then")).otherwise(F.col("follow"))
    nodes = staged(nodes.select(*keys, "cand", "leave", "_chunk", after.alias("next")))
    certain = chunks.where((F.col("lo") == F.col("hi")) & (F.col("last") >= F.col("_chunk") * chunk_us + wide)).select(*keys, "_chunk")
    marks = nodes.join(certain, [*keys, "_chunk"], "left_semi").select(*keys, F.col("next").alias("cand")).where("cand IS NOT NULL")
    marks = staged(marks.unionByName(chunks.where("begin").select(*keys, F.col("first").alias("cand"))).distinct())
    jump = nodes.select(*keys, "cand", "next").where("next IS NOT NULL")
    while True:
        new = marks.join(jump, [*keys, "cand"]).select(*keys, F.col("next").alias("cand")).distinct().join(marks, [*keys, "cand"], "left_anti")
        new = staged(new)
        if new.isEmpty():
            break
        marks = staged(marks.unionByName(new))
        far = jump.select(*keys, F.col("cand").alias("next"), F.col("next").alias("far"))
        jump = staged(jump.join(far, [*keys, "next"]).select(*keys, "cand", F.col("far").alias("next")))
    taken = nodes.join(marks, [*keys, "cand"], "left_semi").groupBy(*keys, "_chunk").agg(F.max("leave").alias("_leave"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    low = F.lit(-(2 ** 62)).cast("bigint")
    return chunks.select(*keys, "_chunk").join(taken, [*keys, "_chunk"], "left").select(
        *keys, "_chunk", F.coalesce(F.last("_leave", True).over(before), low).alias("_ready"))


def consecutive_batches(rows: DataFrame, keys: list[str], window_us: int,
                        ts: str = "ts_us", chunk_windows: int = 256) -> DataFrame:
    """Batch anchor of every (key, instant): a batch is all rows within the window after its
    first row, and the next batch starts with the first row behind it.

    The chain of anchors is sequential, so time is cut into chunks: each chunk first maps every possible entry row
    to the point where its chain leaves the chunk (a row each). The entries that the key's chain really takes are found
    by pointer doubling over those rows, and a second parallel pass assigns anchors. No row holds more than one entry, so
    a key with most of the rows is spread like any other. Returns keys, ts, anchor (one row per distinct instant).
    """
    wide = window_us + 1
    chunk_us = wide * chunk_windows
    inst = rows.select(*keys, F.col(ts).alias("_ts")).distinct()
    inst = staged(inst.withColumn("_chunk", bucket_of(F.col("_ts"), chunk_us)))
    types = {f.name: f.dataType.simpleString() for f in inst.schema}
    kcols = ", ".join(f"{k} {types[k]}" for k in keys)
    ordered = inst.repartition(*keys, "_chunk").sortWithinPartitions(*keys, "_chunk", "_ts")
    ends = ordered.mapInPandas(
        _chain_ends(keys, wide, chunk_us), f"{kcols}, _chunk bigint, cand bigint, leave bigint")
    ends = staged(ends)
    entries = _entries(ends, keys, wide, chunk_us)
    # Rows before the entry point still belong to the batch opened in an earlier chunk.
    entries = entries.withColumn("_open", F.col("_ready") - wide)
    tagged = (inst.join(entries, [*keys, "_chunk"]).repartition(*keys, "_chunk")
              .sortWithinPartitions(*keys, "_chunk", "_ts"))
    out = tagged.mapInPandas(_assign_anchor(keys, wide), f"{kcols}, _ts bigint, anchor bigint")
    return out.select(*keys, F.col("_ts").alias(ts), "anchor")


def previous_row(rows: DataFrame, keys: list[str], columns: list[str], ts: str = "ts_us", order_id: str = "event_id",
                 width: int = 3600 * SECOND, out: str = "prev") -> DataFrame:
    """The given columns of the row just before, in (ts, id) order, split into time buckets."""
    packed = F.struct(ts, order_id, *columns)
    tagged = rows.withColumn("_b", bucket_of(F.col(ts), width)).withColumn("_s", packed)
    last = tagged.groupBy(*keys, "_b").agg(F.max(F.struct(ts, order_id, "_s")).alias("_m"))
    order = Window.partitionBy(*keys).orderBy("_b")
    carry = (last.withColumn("_s", F.lag("_m._s").over(order)).where(F.col("_s").isNotNull())
             .select(*keys, "_b", "_s", F.col(f"_s.{ts}").alias(ts), F.lit(True).alias("_carry")))
    both = tagged.withColumn("_carry", F.lit(False)).unionByName(carry, allowMissingColumns=True)
    part = Window.partitionBy(*keys, "_b").orderBy(ts, F.desc("_carry"), order_id)
    return both.withColumn(out, F.lag("_s").over(part)).where(~F.col("_carry")).drop("_b", "_s", "_carry")
