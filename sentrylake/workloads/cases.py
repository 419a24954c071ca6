"""Registered queries over findings: summaries, incidents, indicators, exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from sentrylake.operators import correlate as co
from sentrylake.operators import exports as ex
from sentrylake.operators import rulebook as rb
from sentrylake.operators import win_rules as wr
from sentrylake.plans.analyze import network_rules
from sentrylake.schema import KILL_CHAIN
from sentrylake.sources.packets import to_events
from sentrylake.workloads import everything as ev
from sentrylake.workloads import mail, netviews, packets
from sentrylake.workloads.base import Case
from sentrylake.workloads.net import CFG, HOME, TIMES, w

FI = ev.findings_sql()
SEV = "CASE severity WHEN 'info' THEN 0 WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 ELSE 4 END"
IPS = FI + ", ip AS (SELECT DISTINCT src_ip AS ip FROM fi WHERE src_ip <> '' AND severity IN ('medium', 'high', 'critical'))"
ITEMS = "it AS (SELECT * EXCLUDE (lists, x), x.key AS kind, unnest(x.value) AS value FROM (SELECT *, unnest(map_entries(lists)) AS x FROM fi))"
ROUNDS = 14


def findings(spark, sf):
    return ev.net_results(spark, sf, items=False).findings


def indicator_table(spark, sf):
    got = ev.net_results(spark, sf)
    return co.finding_indicators(got.findings, got.items)


def summary(name, *keys):
    return lambda s, sf: co.net_summary(netviews.events(s, sf, "flow"), CFG.home_nets)[name]


def top10(where, key, value="count(*)"):
    return w("flow") + f" SELECT {key}, {value} AS n FROM ev WHERE {where} GROUP BY {key} ORDER BY n DESC, {key} LIMIT 10"


def incident_rows(spark, sf):
    got = ev.net_results(spark, sf)
    return co.incidents(got.findings, got.items, CFG.known_resolvers)[0]


def item_rows(spark, sf):
    got = ev.net_results(spark, sf)
    return got.items.where(F.col("kind") != "event").join(got.findings.select("finding_id", "src_ip", "dst_ip", "user", "entity"), "finding_id")


def evidence_rows(spark, sf):
    """The first lines of findings of rules whose events are a plain group."""
    rows = ev.net_rows(spark, sf)
    got = network_rules(rows, CFG, ["c2_bad_port", "exposed_service", "exfil_volume", "internal_exploit", "scan_ping_sweep"]).whole()
    return got.findings.join(rb.evidence(got.items, rows), "finding_id")


def timeline_rows(spark, sf):
    got = ev.win_results(spark, sf)
    return wr.timeline(got.findings, got.items)


def spread_labels() -> str:
    """Labels of linked findings: in each round the smallest label of an entity's findings becomes that of all."""
    out = "l0 AS (SELECT id, id AS label FROM fi)"
    for k in range(1, ROUNDS + 1):
        out += f""",
m{k} AS MATERIALIZED (SELECT ent, min(label) AS m FROM le JOIN l{k - 1} USING (id) GROUP BY ent),
l{k} AS MATERIALIZED (SELECT l.id, least(l.label, coalesce(min(x.m), l.label)) AS label FROM l{k - 1} l LEFT JOIN (SELECT id, m FROM le JOIN m{k} USING (ent)) x ON x.id = l.id GROUP BY l.id, l.label)"""
    return out


def first_lines(rule: str, keys: str, where: str) -> str:
    ks = [k.strip() for k in keys.split(",")]
    named = ", ".join(k if k in ks else f"NULL AS {k}" for k in ("src_ip", "dst_ip"))
    return f"""SELECT '{rule}' AS rule_id, {named}, {'dst_port' if 'dst_port' in ks else 'NULL'} AS port, list('l|' || event_id ORDER BY rn) AS evidence
FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY ts_us, event_id) AS rn FROM (SELECT DISTINCT {keys}, ts_us, event_id FROM allev WHERE {where})) WHERE rn <= 10 GROUP BY {keys}"""


RISK = "(21, 22, 23, 135, 139, 445, 1433, 3306, 3389, 5432, 5900, 6379, 27017)"
BAD = "(4444, 4445, 1337, 31337, 8081, 9001, 9002, 50050)"
EVIDENCE = FI + ", g AS (" + " UNION ALL ".join([
    first_lines("NSM-C2-002", "src_ip, dst_ip, dst_port", f"dst_port IN {BAD}"),
    first_lines("NSM-PERIM-001", "dst_ip, dst_port", f"kind IN ('network_flow', 'ids_alert') AND action = 'allow' AND dst_port IN {RISK} AND src_ip NOT LIKE '10.%' AND dst_ip LIKE '10.%'"),
    first_lines("NSM-EXFIL-004", "src_ip, dst_ip", f"{HOME} AND dst_ip NOT LIKE '10.%' AND (bytes_out <> 0 OR bytes_in <> 0)"),
    first_lines("NSM-LAT-002", "src_ip, dst_ip", f"kind = 'ids_alert' AND (lower(signature) LIKE '%exploit%' OR lower(coalesce(classification, '')) LIKE '%unauthorized%') AND {HOME} AND dst_ip LIKE '10.%'"),
    first_lines("NSM-SCAN-003", "src_ip", "kind = 'icmp' AND (icmp_type IS NULL OR icmp_type = 8)")]) + """)
SELECT g.rule_id, g.src_ip, g.dst_ip, fi.entity, g.evidence FROM g JOIN fi ON fi.rule_id = g.rule_id AND fi.src_ip IS NOT DISTINCT FROM g.src_ip AND fi.dst_ip IS NOT DISTINCT FROM g.dst_ip
  AND (g.port IS NULL OR g.port = fi.dst_port)"""
ESC = "replace(replace(replace({}, '\"', ' '), ';', ','), '|', '/')"
PORT = "coalesce(CAST(dst_port AS VARCHAR), 'any')"
LABELS = f"list_aggregate(list_transform(string_split({ESC.format('entity')}, '.'), lambda l: '|' || printf('%02x', length(l)) || '|' || l), 'string_agg', '')"
INDICATORS = FI + ", " + ITEMS + """,
x AS (SELECT 'ip' AS type, src_ip AS v, regexp_matches(rule_id, '^NSM-(SCAN|CRED|WEB|PERIM)') AND src_ip NOT LIKE '10.%' AS b FROM fi WHERE regexp_matches(src_ip, '^[0-9.]+$')
  UNION ALL SELECT 'ip', dst_ip, regexp_matches(rule_id, '^NSM-(C2|EXFIL)') AND dst_ip NOT LIKE '10.%' FROM fi WHERE regexp_matches(dst_ip, '^[0-9.]+$')
  UNION ALL SELECT 'domain', entity, true FROM fi WHERE rule_id = 'NSM-EXFIL-001' OR (rule_id = 'NSM-EXFIL-003' AND NOT regexp_matches(entity, '^[0-9.]+$'))
  UNION ALL SELECT 'account', usr, false FROM fi WHERE usr <> '' UNION ALL SELECT 'mac', value, false FROM it WHERE kind = 'suspect_macs'),
ind AS (SELECT type, min(v) AS value, bool_or(b) AS block FROM x GROUP BY type, lower(v))"""


CASES = [
    Case("net_summary_counts", summary("counts"), "kind:s key:s n:i", w("flow") + " SELECT 'source_type' AS kind, source_type AS key, count(*) AS n FROM ev GROUP BY 2 UNION ALL SELECT 'action', action, count(*) FROM ev GROUP BY 2"),
    Case("net_summary_total", summary("total"), "event_count:i first_us:i last_us:i", w("flow") + f" SELECT count(*) AS event_count, {TIMES} FROM ev"),
    Case("net_summary_blocked", summary("blocked_sources"), "src_ip:s n:i", top10("action IN ('block', 'drop', 'reset')", "src_ip")),
    Case("net_summary_allowed", summary("allowed_sources"), "src_ip:s n:i", top10("action = 'allow'", "src_ip")),
    Case("net_summary_auth_failures", lambda s, sf: co.net_summary(netviews.events(s, sf, "auth"), CFG.home_nets)["auth_failure_sources"], "src_ip:s n:i",
         w("auth") + " SELECT src_ip, count(*) AS n FROM ev WHERE action = 'failure' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"),
    Case("net_summary_signatures", summary("signatures"), "signature:s n:i", top10("signature IS NOT NULL", "signature")),
    Case("net_summary_uploads", summary("upload_pairs"), "src_ip:s dst_ip:s n:i", top10("bytes_out > 0", "src_ip, dst_ip", "sum(bytes_out)")),
    Case("net_summary_external", summary("external_sources"), "address:s", w("flow") + " SELECT DISTINCT src_ip AS address FROM ev WHERE src_ip NOT LIKE '10.%' ORDER BY 1"),
    Case("net_summary_internal", summary("internal_hosts"), "address:s", w("flow") + " SELECT DISTINCT dst_ip AS address FROM ev WHERE dst_ip LIKE '10.%' ORDER BY 1"),
    Case("learned_resolvers", lambda s, sf: co.learned_resolvers(netviews.events(s, sf, "dns").withColumn("src_ip", F.regexp_replace("src_ip", r"^10\.1\..*", "10.1.0.1")), CFG.known_resolvers), "src_ip:s",
         w("dns") + """, a AS (SELECT CASE WHEN src_ip LIKE '10.%' THEN '10.1.0.1' ELSE src_ip END AS ip FROM ev WHERE dns_is_response)
SELECT ip AS src_ip FROM a GROUP BY 1 HAVING count(*) >= 3 AND count(*) / (SELECT count(*) FROM a) >= 0.3 UNION SELECT unnest(['8.8.8.8', '8.8.4.4', '1.1.1.1'])"""),
    Case("findings_union", lambda s, sf: rb.severity_floor(findings(s, sf), "medium"), "rule_id:s title:s category:s severity:s severity_rank:i src_ip:s dst_ip:s user:s entity:s first_us:i last_us:i",
         FI + f" SELECT rule_id, title, category, severity, {SEV} AS severity_rank, src_ip, dst_ip, usr AS \"user\", entity, first_us, last_us FROM fi WHERE {SEV} >= 2"),
    Case("finding_items", item_rows, "rule_id:s src_ip:s dst_ip:s user:s entity:s kind:s value:s", FI + ", " + ITEMS + " SELECT rule_id, src_ip, dst_ip, usr AS \"user\", entity, kind, value FROM it"),
    Case("finding_evidence", evidence_rows, "rule_id:s src_ip:s dst_ip:s entity:s evidence:l", EVIDENCE),
    Case("incidents", incident_rows, "finding_count:i severity:s stages:l entity_count:i first_us:i last_us:i", FI + ", " + ITEMS + f""",
e AS MATERIALIZED (SELECT DISTINCT id, ent FROM (SELECT id, unnest([src_ip, dst_ip, usr, entity, assigned_ip]) AS ent FROM fi UNION ALL SELECT id, value FROM it WHERE kind IN {tuple(co.ENTITY_LISTS)}) WHERE ent <> ''),
le AS MATERIALIZED (SELECT * FROM e WHERE ent NOT IN {tuple(CFG.known_resolvers)}),
{spread_labels()},
c AS (SELECT fi.*, {SEV} AS sev, label FROM fi JOIN l{ROUNDS} USING (id)), n AS (SELECT label, count(DISTINCT ent) AS entity_count FROM e JOIN c USING (id) GROUP BY label)
SELECT count(*) AS finding_count, CASE max(sev) WHEN 4 THEN 'critical' WHEN 3 THEN 'high' WHEN 2 THEN 'medium' WHEN 1 THEN 'low' ELSE 'info' END AS severity,
  list_filter({KILL_CHAIN}, lambda s: list_contains(list(category), s)) AS stages, any_value(entity_count) AS entity_count, min(first_us) AS first_us, max(last_us) AS last_us FROM c LEFT JOIN n USING (label) GROUP BY label"""),
    Case("indicators", indicator_table, "type:s value:s defanged:s block:b", INDICATORS + " SELECT type, value, CASE WHEN type IN ('account', 'mac') THEN value ELSE replace(value, '.', '[.]') END AS defanged, block FROM ind"),
    Case("indicator_blocklist", lambda s, sf: ex.blocklist_from_indicators(indicator_table(s, sf)), "type:s value:s", INDICATORS + " SELECT DISTINCT type, value FROM ind WHERE block"),
    Case("ids_rules", lambda s, sf: ex.ids_rules(findings(s, sf)), "sid:i rule:s", FI + f""",
k AS (SELECT '1src:' || src_ip AS key, 'alert ip ' || src_ip || ' any -> $HOME_NET any (msg:"LOCAL ' || {ESC.format('title')} || '"; metadata:policy security-ips drop, finding ' || rule_id || '; classtype:attempted-recon;' AS body
    FROM fi WHERE src_ip <> '' AND regexp_matches(rule_id, '^NSM-(SCAN|CRED|WEB)')
  UNION ALL SELECT '2dst:' || dst_ip || ':' || {PORT}, 'alert ip $HOME_NET any -> ' || dst_ip || ' ' || {PORT} || ' (msg:"LOCAL C2/Exfil destination contacted - ' || {ESC.format('title')} || '"; metadata:finding ' || rule_id
    || '; classtype:trojan-activity; priority:' || CASE {SEV} WHEN 4 THEN 1 WHEN 3 THEN 1 WHEN 2 THEN 2 WHEN 1 THEN 3 ELSE 4 END || ';' FROM fi WHERE dst_ip <> '' AND regexp_matches(rule_id, '^NSM-(C2|EXFIL)')
  UNION ALL SELECT '3dns:' || entity || ':a', 'alert udp $HOME_NET any -> any 53 (msg:"LOCAL DNS tunnelling domain ' || {ESC.format('entity')} || '"; content:"' || {LABELS} || '"; nocase; metadata:finding ' || rule_id
    || '; classtype:trojan-activity; priority:1;' FROM fi WHERE rule_id = 'NSM-EXFIL-001'
  UNION ALL SELECT '3dns:' || entity || ':b', 'alert udp $HOME_NET any -> any 53 (msg:"LOCAL Oversized DNS query name - possible tunnelling"; dsize:>150; threshold:type threshold, track by_src, count 20, seconds 60; classtype:policy-violation; priority:2;'
    FROM fi WHERE rule_id = 'NSM-EXFIL-001'
  UNION ALL SELECT '4perim:' || dst_ip || ':' || dst_port, 'alert tcp $EXTERNAL_NET any -> ' || dst_ip || ' ' || dst_port || ' (msg:"LOCAL Inbound to exposed ' || {ev.SERVICE}
    || '"; flags:S; threshold:type limit, track by_src, count 1, seconds 300; classtype:attempted-admin; priority:1;' FROM fi WHERE rule_id = 'NSM-PERIM-001'
  UNION ALL SELECT unnest({[f'9{i}' for i in range(5)]}), unnest({ex.COMPANIONS})), o AS (SELECT key, min(body) AS body FROM k GROUP BY key), n AS (SELECT 1000000 + row_number() OVER (ORDER BY key) AS sid, body FROM o)
SELECT sid, body || ' sid:' || sid || '; rev:1;)' AS rule FROM n"""),
    Case("ids_notes", lambda s, sf: ex.ids_notes(findings(s, sf)), "rule_id:s line:s", FI + " SELECT DISTINCT rule_id, '# ' || rule_id || ': ' || title || ' -- not a matter for sensor rules; compare ARP replies with the authoritative list of hosts and MACs' AS line FROM fi WHERE rule_id LIKE 'NSM-MITM%'"),
    Case("case_verdict", lambda s, sf: co.case_verdicts(ev.win_results(s, sf).findings), "case_key:s findings:i level:s worst_count:i info:i low:i medium:i high:i critical:i", ev.windows_sql() + """,
g AS (SELECT case_key, count(*) AS findings, count(*) FILTER (WHERE severity = 'info') AS info, count(*) FILTER (WHERE severity = 'low') AS low, count(*) FILTER (WHERE severity = 'medium') AS medium,
  count(*) FILTER (WHERE severity = 'high') AS high, count(*) FILTER (WHERE severity = 'critical') AS critical FROM wf GROUP BY 1)
SELECT *, CASE WHEN critical > 0 THEN 'critical' WHEN high > 0 THEN 'high' WHEN medium > 0 THEN 'medium' WHEN low > 0 THEN 'low' ELSE 'info' END AS level,
  CASE WHEN critical > 0 THEN critical WHEN high > 0 THEN high WHEN medium > 0 THEN medium WHEN low > 0 THEN low ELSE info END AS worst_count FROM g"""),
    Case("timeline", timeline_rows, "rule_id:s case_key:s severity:s at_us:i", ev.windows_sql() + " SELECT rule_id, case_key, severity, CASE WHEN first_us > 0 THEN first_us END AS at_us FROM wf"),
    Case("packet_events", lambda s, sf: to_events(packets.events(s, sf)).groupBy("kind", "protocol").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes_out").alias("bytes"), F.count_if("arp_is_gratuitous").alias("gratuitous")), "kind:s protocol:s n:i bytes:i gratuitous:i",
         packets.W + """, k AS (SELECT *, CASE WHEN proto = 'arp' THEN 'arp' WHEN proto = 'icmp' THEN 'icmp' WHEN f_qr IS NOT NULL THEN 'dns' WHEN f_req = '1' OR f_resp = '1' THEN 'http' WHEN f_cmd IS NOT NULL THEN 'ftp' WHEN dst_port = 443 OR f_tls IS NOT NULL THEN 'tls' ELSE 'network_flow' END AS kind FROM ev)
SELECT kind, CASE WHEN proto IN ('arp', 'icmp', 'tcp', 'udp') THEN proto ELSE 'ip' END AS protocol, count(*) AS n, sum(CASE WHEN kind IN ('arp', 'http', 'ftp') THEN 0 ELSE length END) AS bytes, count(*) FILTER (WHERE f_op = '2' AND f_sip = f_tip) AS gratuitous FROM k WHERE src_ip IS NOT NULL OR proto = 'arp' GROUP BY 1, 2"""),
    Case("blocklist", lambda s, sf: ex.blocklist(mail.iocs(s, sf)), "type:s value:s"), Case("ioc_csv", lambda s, sf: ex.indicator_rows(mail.iocs(s, sf)), "type:s external_type:s value:s"),
    Case("misp_json", lambda s, sf: ex.attribute_json(mail.iocs(s, sf)), "kind:s attribute:s"), Case("stix_json", lambda s, sf: ex.pattern_rows(mail.iocs(s, sf)), "id:s name:s pattern:s"),
]
ACL = {"iptables": "SELECT unnest(['iptables -A INPUT -s ' || ip || ' -j DROP', 'iptables -A FORWARD -s ' || ip || ' -j DROP']) AS line FROM ip", "pf": "SELECT 'block drop in quick from ' || ip || ' to any' AS line FROM ip",
       "cisco_ios": "SELECT ' deny ip host ' || ip || ' any' AS line FROM ip UNION ALL SELECT unnest(['ip access-list extended BLOCK', ' permit ip any any', 'interface <apply-to-interface>', ' ip access-group BLOCK in'])",
       "netsh": "SELECT 'netsh advfirewall firewall add rule name=\"block-' || row_number() OVER (ORDER BY ip) || '\" dir=in action=block remoteip=' || ip AS line FROM ip"}
CASES += [Case(f"acl_{t}", (lambda t: lambda s, sf: ex.acl_rules(findings(s, sf), t))(t), "line:s", IPS + " " + q) for t, q in ACL.items()]
