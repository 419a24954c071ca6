"""Window operators against their plain definition on random, tie-heavy groups."""

import random
from collections import Counter

import pytest

from sentrylake.operators import windows as w

GROUPS = 120


def _rows():
    rnd = random.Random(7)
    rows, eid = [], 0
    for g in range(GROUPS):
        span = rnd.choice([3, 10, 60, 400])
        for _ in range(rnd.randint(1, 40)):
            rows.append((g, rnd.randint(-5, span), rnd.choice("abcd"), eid))
            eid += 1
    return rows


ROWS = _rows()


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(ROWS, "g long, ts_us long, v string, event_id long").cache()


def grouped():
    out = {}
    for g, t, v, e in ROWS:
        out.setdefault(g, []).append((t, e, v))
    return {g: sorted(x) for g, x in out.items()}


def windows_of(items, span):
    for hi in range(len(items)):
        yield [x for x in items[: hi + 1] if x[0] >= items[hi][0] - span]


@pytest.mark.parametrize("span", [0, 1, 5, 20])
def test_densest_and_distinct(frame, span):
    dense = {r.g: (r.run_n, r.run_end) for r in w.densest_run(frame, ["g"], span).collect()}
    mixed = {r.g: (r.run_n, r.run_end) for r in w.largest_mixed_run(frame, ["g"], "v", span).collect()}
    best = w.most_distinct_run(frame, ["g"], "v", span)
    picked = {}
    for r in w.distinct_run_rows(frame, best, ["g"], "v", span).collect():
        picked.setdefault(r.g, set()).add(r.event_id)
    for g, items in grouped().items():
        runs = list(windows_of(items, span))
        top = max(runs, key=len)
        assert dense[g] == (len(top), top[-1][0])
        multi = [r for r in runs if len({x[2] for x in r}) > 1]
        if multi:
            m = max(multi, key=len)
            assert mixed[g] == (len(m), m[-1][0])
        else:
            assert g not in mixed
        k = max(runs, key=lambda r: len({x[2] for x in r}))
        assert picked[g] == {x[1] for x in k}


@pytest.mark.parametrize("span,chunk", [(0, 2), (3, 2), (10, 3), (50, 256)])
def test_consecutive_batches(frame, span, chunk):
    got = {(r.g, r.ts_us): r.anchor
           for r in w.consecutive_batches(frame, ["g"], span, chunk_windows=chunk).collect()}
    for g, items in grouped().items():
        anchor = None
        for t, _, _ in items:
            if anchor is None or t - anchor > span:
                anchor = t
            assert got[(g, t)] == anchor


def test_median(spark, frame):
    got = {r.g: r.median2 for r in w.exact_median(frame, ["g"], "ts_us", 7).collect()}
    for g, items in grouped().items():
        v = sorted(x[0] for x in items)
        assert got[g] == v[(len(v) - 1) // 2] + v[len(v) // 2]


def test_previous(frame):
    inst = frame.select("g", "ts_us").distinct()
    got = {(r.g, r.ts_us): r.prev_us for r in w.previous_instant(inst, ["g"], width=9).collect()}
    for g, items in grouped().items():
        prev = None
        for t in sorted({x[0] for x in items}):
            assert got[(g, t)] == prev
            prev = t


def test_running_total(frame):
    one = frame.groupBy("g", "ts_us").count()
    got = {(r.g, r.ts_us): r.running for r in w.running_total(one, ["g"], "ts_us", "count", 4).collect()}
    for g, items in grouped().items():
        c = Counter(x[0] for x in items)
        for t in c:
            assert got[(g, t)] == sum(n for u, n in c.items() if u <= t)


def test_most_distinct_moves_rows_twice(frame, capsys):
    """Buckets of a value, then spans of a key; the third shuffle has a row per key and span."""
    best = w.most_distinct_run(frame, ["g"], "v", 5)
    capsys.readouterr()
    best.explain()
    assert capsys.readouterr().out.count("Exchange hashpartitioning") == 3


def test_rows_without_time(spark):
    """A value seen in a window and also without a time counts once more; rows without a time are in no window."""
    rows = [("a", 0, "x", 1), ("a", 3, "y", 2), ("a", None, "x", 3), ("a", None, "z", 4), ("b", None, "x", 5), ("c", 7, "x", 6), ("c", 7, "y", None)]
    frame = spark.createDataFrame(rows, "g string, ts_us bigint, v string, event_id bigint")
    best = w.most_distinct_run(frame, ["g"], "v", 5)
    assert {tuple(r) for r in best.collect()} == {("a", 3, 3), ("c", 2, 7)}
    got = sorted(((r.g, r.event_id) for r in w.distinct_run_rows(frame, best, ["g"], "v", 5).collect()), key=str)
    assert got == [("a", 1), ("a", 2), ("c", 6), ("c", None)]


def test_large_files_are_read_in_place(spark, tmp_path):
    """A table of one file that Spark reads in parts is not shuffled to spread it; a small one is."""
    from sentrylake.workloads.base import table
    spark.range(40_000).coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    assert table(spark, str(tmp_path), "orders")._jdf.queryExecution().toString().count("RoundRobin") > 0
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1024")
        df = table(spark, str(tmp_path), "orders")
        assert "RoundRobin" not in df._jdf.queryExecution().toString() and df.count() == 40_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
