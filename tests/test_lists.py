"""Findings with their lists whole, as columns of the registered queries."""

import pytest
from test_rules import CFG, flow, frame

from sentrylake.operators import net_access as na
from sentrylake.operators.rulebook import found, listed, with_lists
from sentrylake.workloads import all_cases

WHOLE = {
    "scan_vertical": ["ports"],
    "scan_horizontal": ["hosts"],
    "scan_ping_sweep": ["hosts"],
    "exposed_service": ["sources"],
    "cred_spray": ["users"],
    "cred_odd_sessions": ["sources"],
    "lateral_move": ["targets"],
    "internal_exploit": ["signatures"],
    "vpn_pivot": ["internal_targets", "ports_touched"],
    "exfil_dns": ["internal_hosts"],
    "exfil_ftp": ["sensitive_files"],
    "web_attack": ["attack_types"],
    "arp_conflict": ["suspect_macs"],
    "arp_burst": ["claimed_ips"],
    "dns_rogue": ["answers", "ttls"],
    "dns_race": ["distinct_answers"],
    "tls_downgrade": ["clients"],
    "logon_brute": ["usernames_tried"],
    "pkt_scan_vertical": ["ports_probed"],
    "pkt_scan_horizontal": ["hosts_probed"],
    "pkt_scan_udp": ["closed_ports"],
    "pkt_arp_spoof": ["claiming_macs"],
    "pkt_arp_relay": ["victims"],
    "pkt_arp_flood": ["targets_probed"],
    "pkt_ftp_spray": ["usernames_tried"],
    "pkt_dhcp_nak": ["reasons"],
    "pkt_scanner_agent": ["paths"],
    "pkt_agent_rotation": ["user_agents"],
    # next
}


@pytest.mark.parametrize("name", WHOLE)
def test_query_returns_its_lists(name):
    case = next(c for c in all_cases() if c.name == name)
    assert [x for x in WHOLE[name] if [x, "l"] not in case.spec()] == []


def test_a_list_is_not_cut(spark):
    """60 hosts: an earlier form returned 40 of them, a later one none."""
    hosts = [f"10.1.0.{h}" for h in range(100, 160)]
    ev = frame(spark, [flow("10.0.0.1", h, 445, i, "allow") for i, h in enumerate(hosts)])
    got = with_lists(na.scan_horizontal.found(ev, CFG), "hosts").first()
    assert (got.distinct_hosts, got.hosts) == (60, sorted(hosts))


def test_null_keys_order_and_missing_lists(spark):
    rows = spark.createDataFrame([(1,), (None,), (3,)], "k int")
    seen = spark.createDataFrame([(1, 9, "a"), (1, 5, "b"), (1, 5, "b"), (1, 11, "b"), (1, 7, None), (None, 1, "z")], "k int, t int, v string")
    out = found(rows, listed("vs", seen, ["k"], "v"))
    assert {r.k: r.vs for r in with_lists(out, "vs").collect()} == {1: ["a", "b"], None: ["z"], 3: None}
    assert {r.k: r.vs for r in with_lists(out, "vs", order="t").collect()} == {1: ["b", "a"], None: ["z"], 3: None}
    assert with_lists(out).columns == ["k"]
