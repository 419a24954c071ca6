"""Queries over all rules that need every rule, shuffles that leave the disk, routes and votes at size."""

from __future__ import annotations

import glob
import random

import pytest
from pyspark.sql import functions as F
from test_rules import CFG, auth, flow, frame

from sentrylake.operators import rulebook as rb
from sentrylake.operators import windows as wn
from sentrylake.operators.routes import dealt
from sentrylake.plans import analyze
from sentrylake.session import FREED, held
from sentrylake.sources import netlogs as nl
from sentrylake.workloads import cases, everything

QUERIES = {c.name: c for c in cases.CASES}


@pytest.fixture
def few(spark, monkeypatch):
    """The queries over findings, on fifteen failed logins and the named rules."""
    def some(*names):
        monkeypatch.setattr(everything, "net_rows", lambda s, sf: frame(spark, [auth("203.0.113.1", "a", i) for i in range(15)]))
        monkeypatch.setattr(everything, "network_rules", lambda rows, cfg, items=True: rb.run_all("net", rows, CFG, names, items=items))
    return some


@pytest.mark.parametrize("name", ["acl_iptables", "finding_items", "ids_notes"])
def test_a_failed_rule_fails_the_queries_over_all_rules(spark, monkeypatch, few, name):
    bad = rb.Rule("net", "bad", "X-1", "bad", "Impact", (), lambda e, c: e.select("src_ip", F.raise_error(F.lit("broken")).alias("entity")))
    monkeypatch.setitem(rb.REGISTRY, "net", [*rb.REGISTRY["net"], bad])
    few("cred_bruteforce")
    assert QUERIES[name].run(spark, "").count() == {"acl_iptables": 2, "finding_items": 1, "ids_notes": 0}[name]
    few("bad", "cred_bruteforce")
    with pytest.raises(RuntimeError, match="bad"):
        QUERIES[name].run(spark, "").count()


def test_failed_items_fail_the_queries_that_need_them(spark, monkeypatch, few):
    few("cred_bruteforce")
    monkeypatch.setattr(rb, "as_items", lambda *_: 1 / 0)
    assert QUERIES["acl_iptables"].run(spark, "").count() == 2
    with pytest.raises(RuntimeError, match="cred_bruteforce"):
        QUERIES["finding_items"].run(spark, "").count()
    several = analyze.joined(everything.network_rules(everything.net_rows(spark, ""), CFG))
    assert several.failed == [] and several.items.isEmpty() and several.failed == ["cred_bruteforce"]


def test_routes_take_no_shuffle_and_go_when_they_are_spent(spark, monkeypatch):
    ev = frame(spark, [auth("203.0.113.1", "a", i) for i in range(15)] + [flow("10.0.0.1", "203.0.113.9", 4444, i, "allow") for i in range(5)])
    plans = []
    monkeypatch.setattr(rb, "LARGE_MB", 0)
    plain = type(ev).hint
    monkeypatch.setattr(type(ev), "hint", lambda df, *a: plans.append(a) or plain(df, *a))
    routes = dealt(ev, CFG, {"auth", "tool", "flow"})
    assert not plans and set(routes.mb) == {"auth", "tool", "flow"}
    got = rb.run_all("net", routes, CFG, ["cred_bruteforce", "c2_bad_port"], items=False)
    assert sorted(r.rule_id for r in got.findings.collect()) == ["NSM-C2-002", "NSM-CRED-001"] and not got.failed
    assert glob.glob(f"{routes.path}/route=*") == [f"{routes.path}/route=flow"]
    with pytest.raises(ValueError, match="without items"):
        got.items  # noqa: B018
    # Without events no route has a file.
    none = dealt(ev.limit(0), CFG, {"auth", "tool"})
    assert none.mb == {} and rb.run_all("net", none, CFG, ["cred_bruteforce", "c2_bad_port"], items=False).findings.isEmpty()


def test_shuffles_leave_the_disk_with_their_query(spark):
    key, = FREED
    was = spark.conf.get(key, None)
    with held(spark, FREED):
        with held(spark, FREED):
            assert spark.conf.get(key) == "true"
        assert spark.conf.get(key) == "true"
    assert spark.conf.get(key, None) == was
    inside = []
    bad = rb.Rule("net", "looks", "X-2", "looks", "Impact", (), lambda e, c: inside.append(spark.conf.get(key)) or e.select("src_ip"))
    rb.REGISTRY["net"].append(bad)
    try:
        rb.run_all("net", frame(spark, [auth("203.0.113.1", "a", 1)]), CFG, ["looks"])
    finally:
        rb.REGISTRY["net"].remove(bad)
    assert inside == ["true"]


@pytest.mark.parametrize("undated", [False, True])
def test_written_runs_are_the_best_runs(spark, monkeypatch, undated):
    r = random.Random(3)
    rows = [(r.choice(["a", "b", None]), None if undated and r.random() < 0.1 else r.randint(0, 60), r.choice("uvwxyz"), i) for i in range(150)]
    ev = spark.createDataFrame(rows, "g string, ts_us bigint, v string, event_id bigint")
    kept, plain = [], wn.staged_at
    monkeypatch.setattr(wn, "staged_at", lambda df: kept.append(plain(df)) or kept[-1])
    every = {x.g: x for x in wn.most_distinct_run(ev, ["g"], "v", 5).collect()}
    for k in (1, 4, 5, 9):
        want = {tuple(x) for x in every.values() if x.run_k >= k}
        assert {tuple(x) for x in wn.most_distinct_run(ev, ["g"], "v", 5, k).collect()} == want
        assert {tuple(x) for x in wn.written_distinct_run(ev, ["g"], "v", 5, k).collect()} == want
    # Value buckets are gone.
    assert len(kept) == 4 and not any(glob.glob(folder) for _, folder in kept)



def test_lines_are_cut_only_where_a_grammar_may_read_them(spark, monkeypatch):
    """Guards before the cut into words change no reading."""
    lines = ["2024-01-02 03:04:05 aLLow tcp 10.0.0.1:5 -> 10.0.0.2:80", "2024-01-02 03:04:05.5Z deny UDP 1.1.1.1:5->2.2.2.2:53 bytes=9", "2024-01-02T03:04:05. PASS IP a -> b", "2024-01-02 03:04:05 ALLOW TCP a b c",
             "2024-01-02 03:04:05x ALLOW TCP a -> b", "2024-01-02 03:04:05 10.0.0.1 bob Success", "2024-01-02 03:04:05 failed_auth TCP 1.1.1.1:1 -> 2.2.2.2:2 (user 'x')", "2024-01-02 03:04:05 10.0.0.1 bob login", "a [**] b"]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, line string")
    cut = []
    plain = nl.words
    monkeypatch.setattr(nl, "words", lambda c: cut.append(1) or plain(c))
    read = {g: [r.i for r in rows.where(nl._reads(nl.PARSERS[g], F.col("line")).isNotNull()).orderBy("i").collect()] for g in ("firewall", "vpn", "ids")}
    assert read == {"firewall": [0, 1, 2], "vpn": [5, 6], "ids": []} and cut
    for g in ("firewall", "vpn"):
        assert "RLIKE" in str(nl._reads(nl.PARSERS[g], F.col("line"))).upper().split("TRANSFORM")[0]
