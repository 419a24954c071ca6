"""Positive and negative pairs per rule family, clean and empty input, isolation."""

import dataclasses

from pyspark.sql import functions as F

from sentrylake.config import NetConfig
from sentrylake.operators import net_access as na
from sentrylake.operators import net_channels as nc
from sentrylake.operators import rulebook as rb
from sentrylake.schema import NET_COLUMNS, net_events

S = 1_000_000
CFG = NetConfig()


def frame(spark, rows):
    cols = sorted({k for r in rows for k in r} | {"event_id"})
    ddl = ", ".join(f"`{c}` {NET_COLUMNS[c]}" for c in cols)
    return net_events(spark.createDataFrame([tuple({"event_id": i, **r}.get(c) for c in cols) for i, r in enumerate(rows)], ddl))


def auth(src, user, t, action="failure"):
    return {"kind": "auth", "src_ip": src, "user": user, "ts_us": t * S, "action": action}


def flow(src, dst, port, t, action="block", **more):
    return {"kind": "network_flow", "src_ip": src, "dst_ip": dst, "dst_port": port, "ts_us": t * S, "action": action, **more}


def test_credentials(spark):
    rows = [auth("203.0.113.1", "a", i * 5) for i in range(12)] + [auth("203.0.113.1", "a", 70, "success")]
    rows += [auth("203.0.113.2", f"u{i}", i * 60) for i in range(9)] + [auth("203.0.113.3", "b", i * 900) for i in range(3)]
    ev = frame(spark, rows)
    brute = na.cred_bruteforce(ev, CFG).collect()
    assert [(r.src_ip, r.failures, r.user, r.confidence) for r in brute] == [("203.0.113.1", 12, "a", "high")]
    assert [(r.src_ip, r.distinct_users, r.max_per_user) for r in na.cred_spray(ev, CFG).collect()] == [("203.0.113.2", 9, 1)]
    assert [(r.src_ip, r.preceding_failures) for r in na.cred_success_after_failures(ev, CFG).collect()] == [("203.0.113.1", 12)]


def test_nameless_success(spark):
    rows = [auth("203.0.113.1", f"u{i}", i) for i in range(5)] + [auth("203.0.113.1", None, 9, "success"), auth("203.0.113.1", "u1", 9, "success")]
    got = na.cred_success_after_failures(frame(spark, rows), CFG).collect()
    assert [(r.user, r.preceding_failures) for r in got] == [(None, 5)]


def test_scans(spark):
    rows = [flow("203.0.113.1", "10.0.0.5", 1000 + i, i) for i in range(12)] + [flow("203.0.113.9", "10.0.0.5", 443, i, "allow") for i in range(50)]
    rows += [flow("10.0.0.8", f"10.0.1.{i}", 445, i, "allow") for i in range(6)]
    ev = frame(spark, rows)
    assert [(r.src_ip, r.distinct_ports, r.severity) for r in na.scan_vertical(ev, CFG).collect()] == [("203.0.113.1", 12, "medium")]
    assert [(r.src_ip, r.distinct_hosts, r.severity) for r in na.scan_horizontal(ev, CFG).collect()] == [("10.0.0.8", 6, "high")]
    lat = na.lateral_move(ev, CFG).collect()
    assert [(r.src_ip, r.target_count) for r in lat] == [("10.0.0.8", 6)]


def test_beacon(spark):
    rows = [flow("10.0.0.1", "203.0.113.5", 4444, i * 60, "allow", bytes_out=500) for i in range(20)]
    rows += [flow("10.0.0.1", "203.0.113.5", None, i * 60, "allow", bytes_out=500) for i in range(20)]
    rows += [flow("10.0.0.2", "203.0.113.6", 443, i * i * 37 % 5000, "allow", bytes_out=i) for i in range(20)]
    got = nc.c2_beacon(frame(spark, rows), CFG).collect()
    assert [(r.src_ip, r.dst_port, r.period_seconds, r.severity) for r in got] == [("10.0.0.1", 4444, 60.0, "critical")]


def test_run_is_isolated_and_empty_is_clean(spark):
    ev = frame(spark, [flow("10.0.0.1", "10.0.0.2", 443, 1, "allow")])
    assert rb.run_rules("net", ev, CFG, ["cred_bruteforce", "exfil_volume", "arp_conflict"]).count() == 0
    broken = rb.Rule("net", "broken", "X-1", "broken", "Impact", (), lambda e, c: 1 / 0)
    rb.REGISTRY["net"].append(broken)
    try:
        rows = rb.run_rules("net", ev, CFG, ["broken", "exposed_service"]).collect()
    finally:
        rb.REGISTRY["net"].remove(broken)
    assert [(r.rule_id, r.severity) for r in rows] == [("NSM-ERR-001", "info")]
    assert rb.list_rules(spark, "net").count() == 26 and rb.list_rules(spark, "win").count() == 24 and rb.list_rules(spark, "pkt").count() == 16 and rb.list_rules(spark).count() == 111


def test_findings_and_evidence(spark):
    ev = frame(spark, [{**auth("203.0.113.1", "a", i), "raw": f" line {i} " if i != 3 else "  "} for i in range(15)])
    got = rb.run_all("net", ev, CFG, ["cred_bruteforce"])
    r = got.findings.first()
    assert r.metrics["failures"] == "15" and r.severity_rank == 3 and r.mitre == ["T1110.001"]
    assert got.items.where("kind = 'event'").count() == 15 and [x.value for x in got.items.where("kind = 'users'").collect()] == ["a"]
    assert {x.finding_id for x in got.items.collect()} == {r.finding_id}
    lines = rb.evidence(got.items, ev).first().evidence
    assert lines == [f"line {i}" for i in range(11) if i != 3]


def test_config_lists():
    """Every setting is read somewhere; a profile with others loads all the same."""
    import pathlib

    from sentrylake import config
    text = "".join(f.read_text() for f in pathlib.Path(config.__file__).parent.rglob("*.py") if f.name != "config.py")
    for kind in (NetConfig, config.WinConfig, config.PacketConfig):
        assert [f.name for f in dataclasses.fields(kind) if f.name not in text] == []
    assert NetConfig.from_json('{"dmz_nets": ["10.9.0.0/16"], "min_severity": "high"}').min_severity == "high"


def test_service_names(spark):
    from sentrylake.functions.net import service_name
    got = spark.createDataFrame([(22,), (9,), (None,)], "p int").select(service_name(F.col("p"))).collect()
    assert [r[0] for r in got] == ["ssh", "port-9", "unknown"]
