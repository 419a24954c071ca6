"""All rules of a kit over all stand-in events, and the same in SQL: the statements of the single rules, united."""

from __future__ import annotations

from pyspark.sql import functions as F

from sentrylake.functions.net import PORT_SERVICES
from sentrylake.operators import rulebook as rb
from sentrylake.plans.analyze import network_rules
from sentrylake.session import staged
from sentrylake.workloads import net, netviews, winviews
from sentrylake.workloads import windows as win
from sentrylake.workloads.base import DUCK

VIEWS = ["auth", "flow", "dns", "http", "misc", "beat"]
RULES = {kit: {r.name: r for r in rb.REGISTRY[kit]} for kit in ("net", "win")}


def net_rows(spark, sf):
    """The events of all views, with ids that differ and keep their order."""
    parts = [netviews.events(spark, sf, v).withColumn("event_id", F.col("event_id") * 8 + i) for i, v in enumerate(VIEWS)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("raw", F.concat_ws("|", F.lit(" l"), F.col("event_id").cast("string")))


def net_results(spark, sf, items: bool = True):
    return network_rules(net_rows(spark, sf), net.CFG, items=items).whole()


def win_results(spark, sf):
    # Parsed once, as all rules read the same columns.
    return rb.run_all("win", staged(winviews.events(spark, sf)), win.CFG).whole()


ALL = "WITH every AS (" + " UNION ALL BY NAME ".join(f"SELECT event_id * 8 + {i} AS event_id, * EXCLUDE event_id FROM ({netviews.VIEWS[v](DUCK)})" for i, v in enumerate(VIEWS)) + """),
allev AS MATERIALIZED (SELECT * REPLACE (coalesce(bytes_out, 0) AS bytes_out, coalesce(bytes_in, 0) AS bytes_in) FROM every)"""
# Where a rule's own statement relies on its view having no other rows.
SCOPES = {"c2_beacon": "kind IN ('network_flow', 'http', 'dns', 'ids_alert')", "exfil_dns": "dns_query IS NOT NULL", "exfil_direct_dns": "(dst_port = 53 OR kind = 'dns') AND dst_ip NOT LIKE '10.%'",
          "web_attack": "signature IS NOT NULL AND src_ip IS NOT NULL"}
SWAPS = {"exfil_ftp": [("kind = 'ftp'", "(kind = 'ftp' OR dst_port IN (20, 21))")],
         "web_attack": [("lower(signature) LIKE '%sql injection%' OR lower(signature) LIKE '%directory traversal%'", "regexp_matches(lower(signature), 'sql injection|directory traversal|xss')"),
                        ("action = 'block'", "action IN ('block', 'drop')"), ("action <> 'block'", "action NOT IN ('block', 'drop')")]}
# What a statement leaves out because the rule always says the same.
SEVERITY = {"cred_bruteforce": "high", "cred_spray": "high", "exposed_service": "high", "exfil_direct_dns": "medium", "exfil_volume": "high", "arp_burst": "high", "dns_race": "high",
            "dns_short_ttl": "medium", "tls_downgrade": "critical", "cred_success_after_failures": "critical"}
SERVICE = "CASE dst_port " + " ".join(f"WHEN {p} THEN '{s}'" for p, s in PORT_SERVICES.items()) + " ELSE 'port-' || dst_port END"
ENTITY = {"c2_beacon": "dst_ip || CASE WHEN dst_port IS NULL THEN '' ELSE ':' || dst_port END", "scan_horizontal": f"dst_port || '/' || {SERVICE}"}
#: The lists of each rule, as its statement names them.
LISTS = {"scan_vertical": ["ports"], "scan_horizontal": ["hosts"], "scan_ping_sweep": ["hosts"], "exposed_service": ["sources"], "cred_bruteforce": ["users"], "cred_spray": ["users"],
         "cred_odd_sessions": ["sources"], "lateral_move": ["targets"], "internal_exploit": ["signatures"], "exfil_dns": ["internal_hosts"], "exfil_ftp": ["sensitive_files"], "web_attack": ["attack_types"],
         "arp_conflict": ["suspect_macs"], "arp_burst": ["claimed_ips"], "dns_rogue": ["answers", "ttls"], "dns_race": ["distinct_answers"], "tls_downgrade": ["clients"], "cleartext_creds": ["clients"]}
CASES = {c.name: c for c in net.CASES}


def rule_sql(name: str) -> str:
    """A rule's statement, over the events of all views."""
    text = CASES[name].sql
    head = next(net.w(v) for v in netviews.VIEWS if text.startswith(net.w(v)))
    text = text[len(head):]
    for old, new in SWAPS.get(name, ()):
        assert old in text
        text = text.replace(old, new)
    return f"(WITH ev AS (SELECT * FROM allev WHERE {SCOPES.get(name, 'true')}){text})"


def columns(case) -> set:
    return {n for n, _ in case.spec()}


def findings_sql() -> str:
    """CTEs: allev, and fi with the findings of all network rules."""
    parts = []
    for name, r in RULES["net"].items():
        have = columns(CASES[name])

        def col(c, other="NULL"):
            return f'CAST("{c}" AS VARCHAR)' if c in have else f"CAST({other} AS VARCHAR)"
        category = "CASE WHEN internal_source THEN 'Discovery' ELSE 'Reconnaissance' END" if "internal_source" in have else f"'{r.category}'"
        severity = "severity" if "severity" in have else f"'{SEVERITY[name]}'"
        times = ", ".join(c if c in have else f"CAST(NULL AS BIGINT) AS {c}" for c in ("first_us", "last_us"))
        port = "dst_port" if "dst_port" in have else "CAST(NULL AS INT)"
        lists = "map {" + ", ".join(f"'{x}': list_transform(coalesce({x}, []), lambda v: CAST(v AS VARCHAR))" for x in LISTS.get(name, [])) + "}" if name in LISTS else "CAST(NULL AS MAP(VARCHAR, VARCHAR[]))"
        parts.append(f"SELECT '{r.rule_id}' AS rule_id, '{r.title}' AS title, {category} AS category, {severity} AS severity, {col('src_ip')} AS src_ip, {col('dst_ip')} AS dst_ip, {col('user')} AS usr, "
                     f"{col('entity', ENTITY.get(name, 'NULL'))} AS entity, {col('assigned_ip')} AS assigned_ip, {port} AS dst_port, {times}, {lists} AS lists FROM {rule_sql(name)} AS t")
    return ALL + ",\nfi AS MATERIALIZED (SELECT row_number() OVER () AS id, * FROM (" + "\nUNION ALL BY NAME ".join(parts) + "))"


def windows_sql() -> str:
    """CTE wf: case_key, rule_id, severity and first_us of the findings of all Windows rules."""
    parts = []
    cases = {c.name: c for c in win.CASES}
    for name, r in RULES["win"].items():
        have = columns(cases[name])
        severity = "severity" if "severity" in have else f"'{WIN_SEVERITY[name]}'"
        parts.append(f"SELECT case_key, '{r.rule_id}' AS rule_id, {severity} AS severity, first_us FROM (WITH RECURSIVE _z AS (SELECT 1){cases[name].sql[len(win.W):]}) AS t")
    return win.W + ",\nwf AS MATERIALIZED (" + "\nUNION ALL ".join(parts) + ")"


WIN_SEVERITY = {"logon_brute": "high", "user_new": "low", "user_backdoor_admin": "critical", "user_group": "medium", "user_password_reset": "medium", "persist_startup": "high", "persist_runkey": "high",
                "exec_double_ext": "critical", "exec_downloaded": "high", "exec_lnk": "critical", "exec_removable": "medium", "exec_encoded_ps": "high", "log_cleared": "high", "collect_sensitive": "high",
                "collect_archive": "medium", "collect_credential_search": "high", "collect_stealer": "critical", "c2_suspicious_network": "medium"}
