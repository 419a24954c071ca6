"""Findings, the items behind them, routes, failures of single rules, and incidents over long lists."""

import random

import pytest
from pyspark.sql import functions as F
from test_rules import CFG, auth, flow, frame

from sentrylake.operators import correlate as co
from sentrylake.operators import mail_rules as mr
from sentrylake.operators import rulebook as rb
from sentrylake.operators import win_rules as wr
from sentrylake.operators.routes import COLUMNS, dealt
from sentrylake.plans import analyze
from sentrylake.workloads import everything, mail, netviews, packets, winviews
from sentrylake.workloads import net as netq

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def direct(spark):
    """All network rules, each over all events."""
    return rb.run_all("net", everything.net_rows(spark, SF), netq.CFG)


def sweep(src, hosts, start):
    return [flow(src, f"10.1.0.{h}", 445, start + i, "allow") for i, h in enumerate(hosts)]


def test_a_long_list_links_to_its_end(spark):
    """Two sweeps of 60 hosts share one host only, the last of the first in sort order."""
    hosts = sorted(range(100, 160), key=lambda h: f"10.1.0.{h}")
    other = [hosts[-1], *range(200, 245)]
    ev = frame(spark, sweep("10.0.0.1", hosts, 0) + sweep("10.0.0.2", other, 10_000) + sweep("10.0.0.3", range(1, 50), 20_000))
    got = rb.run_all("net", ev, CFG, ["scan_horizontal"])
    assert {r.src_ip: r.metrics["distinct_hosts"] for r in got.findings.collect()} == {"10.0.0.1": "60", "10.0.0.2": "46", "10.0.0.3": "49"}
    assert got.items.where("kind = 'hosts'").count() == 155
    ids = {r.finding_id: r.src_ip for r in got.findings.collect()}
    # The port is an entity of all three; as shared infrastructure it links nothing.
    _, members = co.incidents(got.findings, got.items, ["445/smb"])
    groups = {}
    for m in members.collect():
        groups.setdefault(m.incident_id, set()).add(ids[m.finding_id])
    assert sorted(map(sorted, groups.values())) == [["10.0.0.1", "10.0.0.2"], ["10.0.0.3"]]
    short = rb.previewed(got.findings, got.items, "hosts", 3, "some_hosts").where("src_ip = '10.0.0.1'").first()
    assert short.some_hosts == [f"10.1.0.{h}" for h in hosts[:3]]


def test_a_failure_at_run_time_costs_one_rule(spark):
    ev = frame(spark, [auth("203.0.113.1", "a", i) for i in range(15)])
    bad = rb.Rule("net", "bad", "X-1", "bad", "Impact", (), lambda e, c: e.select("src_ip", F.raise_error(F.lit("broken")).alias("entity")))
    rb.REGISTRY["net"].append(bad)
    try:
        got = rb.run_all("net", ev, CFG, ["bad", "cred_bruteforce"])
    finally:
        rb.REGISTRY["net"].remove(bad)
    assert got.failed == ["bad"]
    assert sorted(r.rule_id for r in got.findings.collect()) == ["NSM-CRED-001", "NSM-ERR-001"]
    assert {r.rule_id for r in got.items.collect()} == {"NSM-CRED-001"}


def test_routes_change_no_result(spark, direct):
    routed = everything.net_results(spark, SF)
    assert not direct.failed and not routed.failed
    key = ["rule_id", "finding_id"]
    assert sorted(direct.findings.select(*key).collect()) == sorted(routed.findings.select(*key).collect())
    cols = ["finding_id", "kind", "value", "event_id", "ts_us"]
    assert sorted(direct.items.select(*cols).collect(), key=str) == sorted(routed.items.select(*cols).collect(), key=str)
    assert direct.findings.select("finding_id").distinct().count() == direct.findings.count()
    every = {r.reads for r in rb.REGISTRY["net"]}
    assert every == set(COLUMNS)


def test_events_are_read_once(spark):
    """One scan for all routes; the rules read the routes."""
    ev = frame(spark, [flow("10.0.0.1", "203.0.113.9", 4444, i, "allow") for i in range(5)])
    routes = dealt(ev, CFG)
    assert {n: df.count() for n, df in routes.items() if df.count()} == {"flow": 5, "tool": 5, "egress": 5}
    plan = routes["tool"]._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(route" in plan and "signature" not in plan


def test_every_rule_tells_its_events(spark, direct):
    """An event that a finding refers to exists, and every finding with events in its rule refers to one."""
    ev, got = everything.net_rows(spark, SF), direct
    refs = got.items.where("kind = 'event'")
    assert refs.join(ev.select("event_id"), "event_id", "left_anti").isEmpty()
    assert got.findings.join(refs.select("finding_id"), "finding_id", "left_anti").isEmpty()
    times = refs.groupBy("finding_id").agg(F.min("ts_us").alias("lo")).join(got.findings, "finding_id")
    assert times.where("first_us IS NOT NULL AND lo IS NOT NULL AND lo > first_us").isEmpty()


@pytest.mark.parametrize("q", [1, 3])
def test_names_inside_texts(spark, q):
    r = random.Random(q)
    word = lambda n: "".join(r.choice("abé ") for _ in range(n))
    names = [(k, word(r.randint(0, 5))) for k in "xy" for _ in range(40)] + [("x", None)]
    texts = [(k, i, word(r.randint(0, 12))) for i, k in enumerate("xyz" * 30)] + [("x", 999, None)]
    got = wr.containing(spark.createDataFrame(names, "k string, name string"), spark.createDataFrame(texts, "k string, i int, text string"), ["k"], "name", "text", q)
    want = {(k, i, n) for k, i, t in texts for c, n in names if c == k and n and t and n in t}
    rows = got.select("k", "i", "name").collect()
    assert {tuple(x) for x in rows} == want and len(rows) == len(want)


def test_mail_rules_are_findings(spark):
    whole = mail.joined(spark, SF)
    got = mr.run(whole)
    want = sorted((str(r.message_id), r.rule_id, r.severity, r.score) for r in mr.findings(whole).collect())
    rows = got.findings.collect()
    assert sorted((r.case_key, r.rule_id, r.severity, r.score) for r in rows) == want
    assert len({r.finding_id for r in rows}) == len(rows) and all(r.title == mr.CATALOGUE[r.rule_id] for r in rows)
    some = mr.run(whole, ["PH-HDR-009", "ph-att-001"])
    assert {r.rule_id for r in some.findings.collect()} == {"PH-HDR-009", "PH-ATT-001"}
    # Without a column of the attachments only their rules fail, each as one row.
    broken = mr.run(whole.drop("a1"), ["PH-HDR-009", "PH-ATT-001", "PH-ATT-002"])
    assert broken.failed == ["ph-att-001"]
    assert {r.rule_id for r in broken.findings.collect()} == {"PH-HDR-009", "PH-ATT-002", "PH-ERR-001"}


def test_plans(spark):
    """The calls per kind of evidence, over the given tables."""
    out = analyze.network(everything.net_rows(spark, SF), netq.CFG)
    assert out["findings"].count() > 100 and out["incidents"].count() > 0 and out["members"].count() == out["findings"].count()
    assert out["pivots"].count() == 0 and out["pivot_items"].count() == 0 and out["summary_counts"].count() > 0
    assert out["evidence"].where("size(evidence) > 10 OR size(evidence) = 0").isEmpty() and not out["evidence"].isEmpty()
    win = analyze.windows(winviews.raw_events(spark, SF), everything.win.CFG)
    assert win["findings"].count() == win["timeline"].count() > 100 and win["overview"].count() > 10
    assert {r.level for r in win["cases"].collect()} <= {"clean", "info", "low", "medium", "high", "critical"}
    cap = analyze.capture(packets.events(spark, SF), packets.CFG, netq.CFG)
    assert {r.kit for r in cap["findings"].select("kit").distinct().collect()} == {"pkt", "net"} and cap["hosts"].count() > 10
    msgs, _, att = mail.tables(spark, SF)
    post = analyze.mail(msgs, att)
    assert post["findings"].count() > 100 and post["verdicts"].count() == msgs.count() and post["indicators"].count() > 10
    known = spark.createDataFrame([("urls", post["indicators"].where("kind = 'urls'").first().value.upper(), "data", "bad")], "type string, value string, status string, detail string")
    told = analyze.with_reputation(post["indicators"].withColumnRenamed("kind", "type"), known)
    assert {r.status: r.n for r in told.groupBy("status").agg(F.count("*").alias("n")).collect()}["data"] == 1
