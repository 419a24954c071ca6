"""Registered queries over network events, with their independent SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sentrylake.config import NetConfig
from sentrylake.operators import net_access as na
from sentrylake.operators import net_channels as nc
from sentrylake.operators.rulebook import found, listed, with_lists
from sentrylake.operators.windows import exact_percentile
from sentrylake.workloads.base import DUCK, Case
from sentrylake.workloads.netviews import VIEWS, events

HOUR, DAY = 3600, 86400

# The given tables are much thinner in time than a real sensor, so windows are wider here.
CFG = NetConfig(
    vertical_scan_window_s=60 * DAY, vertical_scan_min_ports=3, internal_scan_min_ports=3,
    horizontal_scan_window_s=20 * DAY, horizontal_scan_min_hosts=3, internal_scan_min_hosts=3,
    ping_sweep_min_hosts=3, bruteforce_window_s=2 * DAY, bruteforce_min_failures=4,
    spray_window_s=4 * DAY, spray_min_users=4, success_after_failures=2, success_after_window_s=4 * DAY,
    beacon_max_jitter=0.75, beacon_max_mad_ratio=0.60, beacon_max_period_s=400.0 * DAY, beacon_min_events=4,
    dns_min_queries_per_domain=30, exfil_min_total_bytes=150_000, http_post_large_bytes=1500,
    icmp_min_packets=4, lateral_window_s=30 * DAY, arp_window_s=4 * DAY, arp_gratuitous_burst=3,
    dns_spoof_race_window_s=6.0 * HOUR, service_accounts=["u3"])


def w(view: str) -> str:
    return f"WITH ev AS ({VIEWS[view](DUCK)})"


def best_run(src: str, keys: str, window_s: int, measure: str, minimum: str, where: str = "true") -> str:
    """CTEs r, best, hit: the plain definition of the best window, by self join."""
    ks = [k.strip() for k in keys.split(",")]
    on = " AND ".join(f"a.{k} = b.{k}" for k in ks)
    out = ", ".join(f"a.{k}" for k in ks)
    return f""",
r AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY ts_us, event_id) AS rn FROM {src} WHERE {where}),
m AS (SELECT {out}, a.rn, {measure} AS m, min(b.rn) AS lo FROM r a JOIN r b ON {on} AND b.rn <= a.rn
  AND b.ts_us >= a.ts_us - CAST({window_s} AS BIGINT) * 1000000 GROUP BY {out}, a.rn),
best AS (SELECT * FROM m WHERE m >= {minimum} QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY m DESC, rn) = 1),
hit AS (SELECT a.* FROM r a JOIN best b ON {on} AND a.rn BETWEEN b.lo AND b.rn)"""


def whole(value: str, cond: str = "true") -> str:
    """Every distinct value, in order."""
    return f"list_sort(list(DISTINCT {value}) FILTER (WHERE {value} IS NOT NULL AND {cond}))"


HOME = "src_ip LIKE '10.%'"
FLOW = "kind IN ('network_flow', 'ids_alert') AND dst_port IS NOT NULL"
SCAN_OUT = """count(*) AS attempts, count(*) FILTER (WHERE action IN ('block', 'drop', 'reset')) AS blocked,
  round(count(*) FILTER (WHERE action IN ('block', 'drop', 'reset')) / count(*), 3) AS block_ratio,
  src_ip LIKE '10.%' AS internal_source, min(ts_us) AS first_us, max(ts_us) AS last_us,
  CASE WHEN count(*) FILTER (WHERE action IN ('block', 'drop', 'reset')) / count(*) >= 0.6 THEN 'high' ELSE 'medium' END AS confidence"""
TIMES = "min(ts_us) AS first_us, max(ts_us) AS last_us"


def q(view, rule, *lists, order=None):
    """A rule over a view; its findings have the named lists whole."""
    if not lists:
        return lambda spark, sf: rule(events(spark, sf, view), CFG)
    return lambda spark, sf: with_lists(rule.found(events(spark, sf, view), CFG), *lists, order=order)


def pivot_events(spark, sf):
    """Logins, and web requests from the addresses that they were given."""
    return events(spark, sf, "auth").unionByName(events(spark, sf, "http").withColumn("src_ip", F.regexp_replace("src_ip", "^10\\.1\\.", "10.8.")))


def pivots(spark, sf):
    """The pivots with their targets and ports whole."""
    rows, items = na.vpn_pivots(pivot_events(spark, sf), CFG)
    ports = items.where("kind = 'port'").withColumn("value", F.col("value").cast("int"))
    return with_lists(found(rows, listed("internal_targets", items.where("kind = 'target'"), ["login_id"], "value"), listed("ports_touched", ports, ["login_id"], "value")),
                      "internal_targets", "ports_touched").orderBy(F.desc("suspicious"), F.desc("target_count"), "login_id")


CASES = [
    Case("scan_vertical", q("dense_flow", na.scan_vertical, "ports"),
         "src_ip:s dst_ip:s distinct_ports:i attempts:i blocked:i block_ratio:d internal_source:b severity:s confidence:s ports:l first_us:i last_us:i",
         w("dense_flow") + best_run("ev", "src_ip, dst_ip", 60 * DAY, "count(DISTINCT b.dst_port)", "3", FLOW) + f"""
SELECT *, CASE WHEN internal_source THEN 'high' WHEN confidence = 'high' THEN 'medium' ELSE 'low' END AS severity FROM (
SELECT src_ip, dst_ip, count(DISTINCT dst_port) AS distinct_ports, {whole('dst_port')} AS ports, {SCAN_OUT}
FROM hit GROUP BY src_ip, dst_ip)"""),
    Case("scan_horizontal", q("flow", na.scan_horizontal, "hosts"),
         "src_ip:s dst_port:i distinct_hosts:i attempts:i blocked:i block_ratio:d internal_source:b severity:s confidence:s hosts:l first_us:i last_us:i",
         w("flow") + best_run("ev", "src_ip, dst_port", 20 * DAY, "count(DISTINCT b.dst_ip)", "3", FLOW) + f"""
SELECT *, CASE WHEN internal_source THEN 'high' ELSE 'medium' END AS severity FROM (
SELECT src_ip, dst_port, count(DISTINCT dst_ip) AS distinct_hosts, {whole('dst_ip')} AS hosts, {SCAN_OUT}
FROM hit GROUP BY src_ip, dst_port)"""),
    Case("scan_ping_sweep", q("misc", na.scan_ping_sweep, "hosts"),
         "src_ip:s distinct_hosts:i packets:i internal_source:b severity:s category:s hosts:l first_us:i last_us:i",
         w("misc") + f"""
SELECT src_ip, count(DISTINCT dst_ip) AS distinct_hosts, count(*) AS packets, {HOME} AS internal_source,
  CASE WHEN {HOME} THEN 'high' ELSE 'low' END AS severity, CASE WHEN {HOME} THEN 'Discovery' ELSE 'Reconnaissance' END AS category,
  {whole('dst_ip')} AS hosts, {TIMES}
FROM ev WHERE kind = 'icmp' AND (icmp_type IS NULL OR icmp_type = 8) GROUP BY src_ip HAVING count(DISTINCT dst_ip) >= 3"""),
    Case("exposed_service", q("flow", na.exposed_service, "sources"),
         "dst_ip:s dst_port:i allowed_connections:i distinct_sources:i sources:l entity:s first_us:i last_us:i",
         w("flow") + f"""
SELECT dst_ip, dst_port, count(*) AS allowed_connections, count(DISTINCT src_ip) AS distinct_sources, {whole('src_ip')} AS sources,
  dst_ip || ':' || dst_port AS entity, {TIMES}
FROM ev WHERE action = 'allow' AND dst_port IN (21, 22, 23, 135, 139, 445, 1433, 3306, 3389, 5432, 5900, 6379, 27017)
  AND src_ip NOT LIKE '10.%' AND dst_ip LIKE '10.%' GROUP BY dst_ip, dst_port"""),
    Case("cred_bruteforce", q("auth", na.cred_bruteforce),
         "src_ip:s failures:i distinct_users:i user:s window_seconds:i attempts_per_min:d external_source:b confidence:s first_us:i last_us:i",
         w("auth") + best_run("ev", "src_ip", 2 * DAY, "count(*)", "4", "action = 'failure'") + f"""
SELECT *, CASE WHEN distinct_users = 1 THEN u END AS "user", round(span) AS window_seconds, round(failures / span * 60, 2) AS attempts_per_min,
  CASE WHEN distinct_users <= 2 THEN 'high' ELSE 'medium' END AS confidence FROM (
SELECT src_ip, {whole('usr')} AS users, count(*) AS failures, count(DISTINCT usr) AS distinct_users, min(usr) AS u, src_ip NOT LIKE '10.%' AS external_source,
  CASE WHEN max(ts_us) = min(ts_us) THEN 1.0 ELSE (max(ts_us) - min(ts_us)) / 1000000 END AS span, {TIMES} FROM hit GROUP BY src_ip)"""),
    Case("cred_spray", q("auth", na.cred_spray, "users"),
         "src_ip:s distinct_users:i total_attempts:i max_per_user:i users:l first_us:i last_us:i",
         w("auth") + best_run("ev", "src_ip", 4 * DAY, "count(DISTINCT b.usr)", "4", "action = 'failure' AND usr IS NOT NULL") + """
SELECT src_ip, count(*) AS distinct_users, sum(n) AS total_attempts, max(n) AS max_per_user, list_sort(list(usr)) AS users,
  min(f) AS first_us, max(l) AS last_us
FROM (SELECT src_ip, usr, count(*) AS n, min(ts_us) AS f, max(ts_us) AS l FROM hit GROUP BY src_ip, usr) GROUP BY src_ip HAVING max(n) <= 3"""),
    Case("cred_success_after_failures", q("auth", na.cred_success_after_failures),
         "event_id:i src_ip:s user:s assigned_ip:s preceding_failures:i last_us:i service_account:b",
         w("auth") + f"""
SELECT s.event_id, s.src_ip, s.usr AS "user", s.assigned_ip, count(*) AS preceding_failures, s.ts_us AS last_us,
  coalesce(s.usr = 'u3', false) AS service_account
FROM ev s JOIN ev f ON f.src_ip = s.src_ip AND f.action = 'failure' AND (f.usr = s.usr OR s.usr IS NULL)
  AND f.ts_us >= s.ts_us - CAST({4 * DAY} AS BIGINT) * 1000000 AND (f.ts_us, f.event_id) < (s.ts_us, s.event_id)
WHERE s.action = 'success' GROUP BY ALL HAVING count(*) >= 2"""),
    Case("cred_odd_sessions", q("auth", na.cred_odd_sessions, "sources"),
         "user:s distinct_sources:i sessions:i off_hours_sessions:i severity:s sources:l first_us:i last_us:i",
         w("auth") + f"""
SELECT usr AS "user", count(DISTINCT src_ip) AS distinct_sources, count(*) AS sessions,
  count(*) FILTER (WHERE (ts_us // 3600000000) % 24 NOT BETWEEN 8 AND 17) AS off_hours_sessions,
  CASE WHEN usr = 'u3' THEN 'high' ELSE 'medium' END AS severity, {whole('src_ip')} AS sources, {TIMES}
FROM ev WHERE action = 'success' AND usr IS NOT NULL GROUP BY usr
HAVING distinct_sources >= 3 OR off_hours_sessions >= 3"""),
    Case("lateral_move", q("flow", na.lateral_move, "targets"),
         "src_ip:s target_count:i attempts:i allowed:i ids_exploit_alerts:i ports:l score:i severity:s confidence:s targets:l first_us:i last_us:i",
         w("flow") + best_run("ev", "src_ip", 30 * DAY, "count(DISTINCT b.dst_ip)", "3",
                              f"{HOME} AND dst_ip LIKE '10.%' AND dst_port IN (22, 135, 139, 445, 3389, 5985, 5986)") + f"""
SELECT *, CASE WHEN score >= 8 THEN 'critical' ELSE 'high' END AS severity,
  CASE WHEN ids_exploit_alerts > 0 THEN 'high' ELSE 'medium' END AS confidence FROM (
SELECT *, 2 + CASE WHEN len(ports) >= 2 THEN 2 ELSE 0 END + CASE WHEN ids_exploit_alerts > 0 THEN 3 ELSE 0 END
  + CASE WHEN allowed > 0 THEN 2 ELSE 0 END + CASE WHEN target_count >= 5 THEN 1 ELSE 0 END AS score FROM (
SELECT src_ip, count(DISTINCT dst_ip) AS target_count, count(*) AS attempts, count(*) FILTER (WHERE action = 'allow') AS allowed,
  count(*) FILTER (WHERE kind = 'ids_alert' AND regexp_matches(lower(signature), 'exploit|lateral|brute|psexec|smb')) AS ids_exploit_alerts,
  {whole('dst_port')} AS ports, {whole('dst_ip')} AS targets, {TIMES} FROM hit GROUP BY src_ip))"""),
    Case("internal_exploit", q("flow", na.internal_exploit, "signatures"),
         "src_ip:s dst_ip:s alerts:i signatures:l signature_count:i severity:s first_us:i last_us:i",
         w("flow") + f"""
SELECT src_ip, dst_ip, count(*) AS alerts, {whole('signature')} AS signatures, count(DISTINCT signature) AS signature_count, 'critical' AS severity, {TIMES}
FROM ev WHERE kind = 'ids_alert' AND (lower(signature) LIKE '%exploit%' OR lower(coalesce(classification, '')) LIKE '%unauthorized%')
  AND {HOME} AND dst_ip LIKE '10.%' GROUP BY src_ip, dst_ip"""),
    Case("vpn_pivot", pivots,
         "login_id:i user:s external_ip:s assigned_ip:s login_us:i post_login_events:i target_count:i suspicious:b internal_targets:l ports_touched:l port_count:i signature_count:i first_us:i last_us:i",
         f"""WITH au AS ({VIEWS['auth'](DUCK)}), ht AS ({VIEWS['http'](DUCK)}),
act AS (SELECT *, regexp_replace(src_ip, '^10\\.1\\.', '10.8.') AS ip FROM ht)
SELECT a.event_id AS login_id, a.usr AS "user", a.src_ip AS external_ip, a.assigned_ip, a.ts_us AS login_us, count(*) AS post_login_events,
  count(DISTINCT h.dst_ip) AS target_count, count(DISTINCT h.dst_ip) >= 3 AS suspicious, {whole('h.dst_ip')} AS internal_targets, {whole('h.dst_port')} AS ports_touched,
  count(DISTINCT h.dst_port) AS port_count, 0 AS signature_count, min(h.ts_us) AS first_us, max(h.ts_us) AS last_us
FROM au a JOIN act h ON h.ip = a.assigned_ip AND h.ts_us BETWEEN a.ts_us AND a.ts_us + 7 * 86400 * CAST(1000000 AS BIGINT)
WHERE a.action = 'success' AND a.assigned_ip IS NOT NULL GROUP BY 1, 2, 3, 4, 5"""),
    Case("vpn_pivot_items", lambda spark, sf: na.vpn_pivots(pivot_events(spark, sf), CFG)[1], "login_id:i kind:s value:s n:i first_us:i last_us:i",
         f"""WITH au AS ({VIEWS['auth'](DUCK)}), ht AS ({VIEWS['http'](DUCK)}),
act AS (SELECT *, regexp_replace(src_ip, '^10\\.1\\.', '10.8.') AS ip FROM ht),
met AS (SELECT a.event_id AS login_id, h.dst_ip, h.dst_port, h.ts_us FROM au a JOIN act h ON h.ip = a.assigned_ip AND h.ts_us BETWEEN a.ts_us AND a.ts_us + 7 * 86400 * CAST(1000000 AS BIGINT)
  WHERE a.action = 'success' AND a.assigned_ip IS NOT NULL)
SELECT login_id, 'target' AS kind, dst_ip AS value, count(*) AS n, {TIMES} FROM met GROUP BY 1, 3
UNION ALL SELECT login_id, 'port', CAST(dst_port AS VARCHAR), count(*), min(ts_us), max(ts_us) FROM met WHERE dst_port IS NOT NULL GROUP BY 1, 3"""),
    Case("flow_percentiles", lambda spark, sf: exact_percentile(events(spark, sf, "flow"), ["src_ip"], "bytes_out", 0.95, 1 << 14), "src_ip:s percentile:d",
         w("flow") + " SELECT src_ip, quantile_cont(bytes_out, 0.95) AS percentile FROM ev GROUP BY src_ip"),
    Case("c2_beacon", q("beat", nc.c2_beacon),
         "src_ip:s dst_ip:s dst_port:i connections:i period_seconds:d jitter_ratio:d mad_ratio:d size_cv:d ids_confirmed:b score:i severity:s confidence:s first_us:i last_us:i",
         w("beat") + f""",
e AS (SELECT *, coalesce(dst_port, -1) AS port FROM ev WHERE {HOME} AND dst_ip NOT LIKE '10.%'
  QUALIFY row_number() OVER (PARTITION BY src_ip, dst_ip, coalesce(dst_port, -1), ts_us ORDER BY event_id) = 1),
g AS (SELECT *, (ts_us - lag(ts_us) OVER (PARTITION BY src_ip, dst_ip, port ORDER BY ts_us)) / 1000000 AS gap FROM e),
s AS (SELECT src_ip, dst_ip, port, count(*) AS connections, median(gap) AS med, stddev_pop(gap) / avg(gap) AS jr,
  CASE WHEN count(*) FILTER (WHERE bytes_out > 0) >= 3 THEN stddev_pop(bytes_out) FILTER (WHERE bytes_out > 0) / avg(bytes_out) FILTER (WHERE bytes_out > 0) END AS cv,
  mad(gap) / median(gap) AS mr, bool_or(regexp_matches(lower(coalesce(signature, '')), 'c2|trojan|beacon')) AS ids, {TIMES}
  FROM g GROUP BY src_ip, dst_ip, port HAVING count(*) >= 4),
n AS (SELECT s.*, (SELECT avg(CASE WHEN abs(g.gap - s.med) <= 0.2 * s.med THEN 1.0 ELSE 0.0 END) FROM g
  WHERE g.src_ip = s.src_ip AND g.dst_ip = s.dst_ip AND g.port = s.port AND g.gap IS NOT NULL) AS near FROM s),
f AS (SELECT *, CASE WHEN jr <= 0.1 THEN 3 WHEN jr <= 0.75 THEN 2 ELSE 0 END + CASE WHEN mr <= 0.6 THEN 1 ELSE 0 END
  + CASE WHEN cv <= 0.3 THEN 2 ELSE 0 END + CASE WHEN port IN (4444, 4445, 1337, 31337, 8081, 9001, 9002, 50050) THEN 3 ELSE 0 END
  + CASE WHEN connections >= 20 THEN 1 ELSE 0 END + CASE WHEN ids THEN 3 ELSE 0 END AS score
  FROM n WHERE near >= 0.7 AND (jr <= 0.75 OR mr <= 0.6) AND med BETWEEN 30 AND {400 * DAY})
SELECT src_ip, dst_ip, CASE WHEN port >= 0 THEN port END AS dst_port, connections, round(med, 1) AS period_seconds, round(jr, 4) AS jitter_ratio,
  round(mr, 4) AS mad_ratio, round(cv, 4) AS size_cv, ids AS ids_confirmed, score, first_us, last_us,
  CASE WHEN score >= 7 THEN 'critical' WHEN score >= 5 THEN 'high' ELSE 'medium' END AS severity,
  CASE WHEN score >= 6 THEN 'high' WHEN score >= 4 THEN 'medium' ELSE 'low' END AS confidence
FROM f WHERE port >= 0 OR NOT EXISTS (SELECT 1 FROM f o WHERE o.src_ip = f.src_ip AND o.dst_ip = f.dst_ip AND o.port >= 0)"""),
    Case("c2_bad_port", q("flow", nc.c2_bad_port), "src_ip:s dst_ip:s dst_port:i events:i outbound:b severity:s entity:s first_us:i last_us:i",
         w("flow") + f"""
SELECT src_ip, dst_ip, dst_port, count(*) AS events, {HOME} AND dst_ip NOT LIKE '10.%' AS outbound,
  CASE WHEN {HOME} AND dst_ip NOT LIKE '10.%' THEN 'high' ELSE 'medium' END AS severity, dst_ip || ':' || dst_port AS entity, {TIMES}
FROM ev WHERE dst_port IN (4444, 4445, 1337, 31337, 8081, 9001, 9002, 50050) GROUP BY src_ip, dst_ip, dst_port"""),
    Case("exfil_dns", q("dns", nc.exfil_dns, "internal_hosts"),
         "entity:s queries:i unique_subdomains:i max_qname_len:i mean_qname_len:d max_label_len:i mean_entropy:d encoded_labels:i nxdomain_ratio:d internal_hosts:l host_count:i src_ip:s estimated_bytes:i score:i severity:s confidence:s first_us:i last_us:i",
         w("dns") + f""",
a AS (SELECT *, string_split(lower(dns_query), '.') AS p FROM ev),
b AS (SELECT *, CASE WHEN len(p) >= 3 AND array_to_string(p[-2:], '.') = 'co.uk' THEN array_to_string(p[-3:], '.') ELSE array_to_string(p[-2:], '.') END AS domain FROM a),
c AS (SELECT *, CASE WHEN length(dns_query) > length(domain) THEN left(lower(dns_query), length(dns_query) - length(domain) - 1) END AS sub FROM b
  WHERE domain <> 'spotify.com'),
d AS (SELECT *, replace(sub, '.', '') AS flat, list_max(list_transform(string_split(dns_query, '.'), lambda x: length(x))) AS lab,
  len(list_filter(string_split(sub, '.'), lambda x: regexp_matches(x, '^[0-9a-fA-F]{{16,}}$') OR (regexp_matches(x, '^[A-Z2-7=]{{16,}}$') AND regexp_matches(x, '[A-Z]')) OR regexp_matches(x, '^[A-Za-z0-9+/=_-]{{16,}}$'))) AS enc,
  list_max(list_transform(regexp_extract_all(sub, '[b-df-hj-np-tv-z]+'), lambda x: length(x))) AS run,
  length(regexp_replace(sub, '[^0-9]', '', 'g')) / length(sub) AS dig FROM c),
e AS (SELECT *, list_entropy(string_split(flat, '')) AS ent FROM d),
g AS (SELECT domain, count(*) AS queries, count(DISTINCT sub) AS us, max(length(dns_query)) AS ml, avg(length(dns_query)) AS mq, max(lab) AS lab,
  coalesce(avg(ent) FILTER (WHERE length(sub) >= 8), 0) AS me, sum(coalesce(enc, 0)) AS enc,
  count(*) FILTER (WHERE upper(dns_qtype) IN ('TXT', 'NULL', 'CNAME', 'MX', 'ANY')) AS odd, count(*) FILTER (WHERE dns_rcode = 'NXDOMAIN') AS nx,
  count(*) FILTER (WHERE dns_is_response) AS resp, count(DISTINCT src_ip) AS hc, {whole('src_ip')} AS hosts,
  avg(CASE WHEN sub IS NOT NULL THEN coalesce(run, 0) END) AS mr, avg(dig) AS md, sum(length(flat)) AS chars, {TIMES} FROM e GROUP BY domain),
h AS (SELECT *, CASE WHEN ml >= 60 THEN 2 ELSE 0 END + CASE WHEN lab >= 30 THEN 2 ELSE 0 END + CASE WHEN me >= 3.8 THEN 3 ELSE 0 END
  + CASE WHEN queries >= 30 THEN 2 ELSE 0 END + CASE WHEN us >= 25 THEN 2 ELSE 0 END + CASE WHEN enc >= 3 THEN 2 ELSE 0 END
  + CASE WHEN odd >= 3 THEN 1 ELSE 0 END + CASE WHEN queries >= 10 AND nx / queries >= 0.5 THEN 2 ELSE 0 END
  + CASE WHEN queries >= 10 AND 1.0 - resp / queries >= 0.8 THEN 1 ELSE 0 END + CASE WHEN hc >= 2 THEN 1 ELSE 0 END
  + CASE WHEN mr >= 8 THEN 1 ELSE 0 END + CASE WHEN md >= 0.25 THEN 1 ELSE 0 END AS score FROM g)
SELECT domain AS entity, queries, us AS unique_subdomains, ml AS max_qname_len, round(mq, 1) AS mean_qname_len, lab AS max_label_len, round(me, 3) AS mean_entropy,
  enc AS encoded_labels, round(nx / queries, 3) AS nxdomain_ratio, hosts AS internal_hosts, hc AS host_count, first_us, last_us, CASE WHEN hc = 1 THEN hosts[1] END AS src_ip,
  floor(chars * 5 / 8) AS estimated_bytes, score, CASE WHEN score >= 10 THEN 'critical' WHEN score >= 7 THEN 'high' ELSE 'medium' END AS severity,
  CASE WHEN score >= 8 THEN 'high' ELSE 'medium' END AS confidence FROM h WHERE score >= 5"""),
    Case("exfil_direct_dns", q("dns", nc.exfil_direct_dns), "src_ip:s dst_ip:s queries:i first_us:i last_us:i",
         w("dns") + f"""
SELECT src_ip, dst_ip, count(*) AS queries, {TIMES} FROM ev WHERE {HOME} AND dst_ip NOT IN ('8.8.8.8', '8.8.4.4', '1.1.1.1')
GROUP BY src_ip, dst_ip HAVING count(*) >= 5"""),
    Case("exfil_http", q("http", nc.exfil_http),
         "src_ip:s entity:s posts:i total_bytes:i largest_bytes:i baseline_median_bytes:d score:i severity:s confidence:s first_us:i last_us:i",
         w("http") + f""",
p AS (SELECT *, coalesce(http_host, dst_ip) AS dest FROM ev WHERE upper(http_method) = 'POST' AND {HOME}),
g AS (SELECT src_ip, dest, count(*) AS posts, sum(bytes_out) AS total_bytes, max(bytes_out) AS largest_bytes,
  (SELECT median(bytes_out) FROM p WHERE bytes_out > 0) AS base, bool_or(lower(coalesce(signature, '')) LIKE '%exfil%' OR lower(coalesce(signature, '')) LIKE '%post large%') AS sig, {TIMES} FROM p GROUP BY src_ip, dest),
s AS (SELECT *, CASE WHEN total_bytes >= 150000 THEN 3 ELSE 0 END + CASE WHEN largest_bytes >= 3000 THEN 2 ELSE 0 END + CASE WHEN posts >= 5 THEN 1 ELSE 0 END
  + CASE WHEN largest_bytes > 20 * base THEN 2 ELSE 0 END + CASE WHEN sig THEN 3 ELSE 0 END + 1 AS score
  FROM g WHERE total_bytes >= 150000 OR largest_bytes >= 1500 OR (posts >= 5 AND largest_bytes > 10 * base))
SELECT src_ip, dest AS entity, posts, total_bytes, largest_bytes, base AS baseline_median_bytes, score,
  CASE WHEN score >= 7 THEN 'critical' WHEN score >= 4 THEN 'high' ELSE 'medium' END AS severity,
  CASE WHEN score >= 6 THEN 'high' ELSE 'medium' END AS confidence, first_us, last_us FROM s"""),
    Case("exfil_volume", q("flow", nc.exfil_volume), "src_ip:s dst_ip:s bytes_out:i bytes_in:i flows:i ratio:d first_us:i last_us:i",
         w("flow") + f"""
SELECT *, CASE WHEN bytes_in > 0 THEN round(bytes_out / bytes_in, 2) END AS ratio FROM (
SELECT src_ip, dst_ip, sum(bytes_out) AS bytes_out, sum(bytes_in) AS bytes_in, count(*) AS flows, {TIMES}
FROM ev WHERE {HOME} AND dst_ip NOT LIKE '10.%' AND (bytes_out <> 0 OR bytes_in <> 0) GROUP BY src_ip, dst_ip)
WHERE bytes_out >= 150000 AND (bytes_in = 0 OR bytes_out / bytes_in >= 5)"""),
    Case("exfil_icmp", q("misc", nc.exfil_icmp),
         "src_ip:s dst_ip:s packets:i max_payload:i oversized_packets:i mean_payload:d external_destination:b score:i severity:s first_us:i last_us:i",
         w("misc") + """,
g AS (SELECT src_ip, dst_ip, count(*) AS packets, max(icmp_payload_len) AS max_payload, count(*) FILTER (WHERE icmp_payload_len > 64) AS oversized_packets,
  round(avg(icmp_payload_len) FILTER (WHERE icmp_payload_len > 0), 1) AS mean_payload, dst_ip NOT LIKE '10.%' AS external_destination, min(ts_us) AS first_us, max(ts_us) AS last_us
  FROM ev WHERE kind = 'icmp' GROUP BY src_ip, dst_ip HAVING max(icmp_payload_len) > 0),
s AS (SELECT *, CASE WHEN max_payload > 64 THEN 3 ELSE 0 END + CASE WHEN max_payload > 256 THEN 2 ELSE 0 END + CASE WHEN packets >= 4 THEN 1 ELSE 0 END
  + CASE WHEN external_destination THEN 2 ELSE 0 END AS score FROM g WHERE oversized_packets >= 3 OR packets >= 4)
SELECT *, CASE WHEN score >= 6 THEN 'high' ELSE 'medium' END AS severity FROM s WHERE score >= 4"""),
    Case("exfil_ftp", q("misc", nc.exfil_ftp, "sensitive_files"),
         "src_ip:s dst_ip:s stor_count:i sensitive_count:i user:s cleartext_password_observed:b external_destination:b score:i severity:s confidence:s sensitive_files:l sensitive_file_count:i first_us:i last_us:i",
         w("misc") + f""",
g AS (SELECT src_ip, dst_ip, count(*) FILTER (WHERE upper(ftp_command) = 'STOR') AS stor_count,
  count(*) FILTER (WHERE upper(ftp_command) = 'STOR' AND lower(ftp_arg) LIKE '%.zip') AS sensitive_count,
  min(ftp_arg) FILTER (WHERE ftp_command = 'USER') AS "user", bool_or(ftp_command = 'PASS') AS pw, {whole('ftp_arg', "lower(ftp_arg) LIKE '%.zip'")} AS f, {TIMES}
  FROM ev WHERE kind = 'ftp' GROUP BY src_ip, dst_ip),
s AS (SELECT *, dst_ip NOT LIKE '10.%' AS external_destination, CASE WHEN stor_count > 0 THEN 2 ELSE 0 END + CASE WHEN sensitive_count > 0 THEN 3 ELSE 0 END
  + CASE WHEN dst_ip NOT LIKE '10.%' THEN 3 ELSE 0 END + CASE WHEN pw THEN 1 ELSE 0 END AS score FROM g WHERE sensitive_count > 0 OR stor_count >= 3)
SELECT *, pw AS cleartext_password_observed, f AS sensitive_files, coalesce(len(f), 0) AS sensitive_file_count,
  CASE WHEN score >= 7 THEN 'critical' WHEN score >= 5 THEN 'high' ELSE 'medium' END AS severity,
  CASE WHEN sensitive_count > 0 THEN 'high' ELSE 'medium' END AS confidence FROM s"""),
    Case("web_attack", q("http", nc.web_attack, "attack_types"),
         "src_ip:s type_count:i alerts:i blocked:i unblocked:i severity:s attack_types:l first_us:i last_us:i",
         w("http") + f"""
SELECT src_ip, count(DISTINCT trim(signature)) AS type_count, count(*) AS alerts, count(*) FILTER (WHERE action = 'block') AS blocked,
  count(*) FILTER (WHERE action <> 'block') AS unblocked, {whole('trim(signature)')} AS attack_types, {TIMES},
  CASE WHEN type_count >= 2 OR blocked < alerts THEN 'high' ELSE 'medium' END AS severity
FROM ev WHERE lower(signature) LIKE '%sql injection%' OR lower(signature) LIKE '%directory traversal%' GROUP BY src_ip"""),
    Case("arp_conflict", q("misc", nc.arp_conflict, "suspect_macs", order="first_us"),
         "entity:s mac_count:i likely_legitimate_mac:s suspect_macs:l suspect_count:i is_gateway:b severity:s first_us:i last_us:i",
         w("misc") + """,
p AS (SELECT arp_sender_ip AS ip, arp_sender_mac AS mac, min(ts_us) AS f, max(ts_us) AS l FROM ev WHERE kind = 'arp' GROUP BY 1, 2)
SELECT ip AS entity, count(*) AS mac_count, (list(mac ORDER BY f, mac))[1] AS likely_legitimate_mac, (list(mac ORDER BY f, mac))[2:] AS suspect_macs, count(*) - 1 AS suspect_count,
  false AS is_gateway, 'high' AS severity, min(f) AS first_us, max(l) AS last_us FROM p GROUP BY ip HAVING count(*) >= 2"""),
    Case("arp_burst", q("misc", nc.arp_burst, "claimed_ips"), "entity:s replies:i claimed_count:i claimed_ips:l first_us:i last_us:i",
         w("misc") + best_run("ev", "arp_sender_mac", 4 * DAY, "count(*)", "3", "kind = 'arp' AND arp_is_gratuitous") + f"""
SELECT arp_sender_mac AS entity, count(*) AS replies, count(DISTINCT arp_sender_ip) AS claimed_count, {whole('arp_sender_ip')} AS claimed_ips, {TIMES}
FROM hit GROUP BY arp_sender_mac"""),
    Case("dns_rogue", q("dns", nc.dns_rogue, "answers", "ttls"), "src_ip:s entity:s responses:i answers:l ttls:l answer_count:i ttl_count:i severity:s first_us:i last_us:i",
         w("dns") + f"""
SELECT src_ip, dns_query AS entity, count(*) AS responses, {whole('dns_answer')} AS answers, {whole('dns_ttl')} AS ttls, count(DISTINCT dns_answer) AS answer_count, count(DISTINCT dns_ttl) AS ttl_count,
  'critical' AS severity, {TIMES} FROM ev WHERE dns_is_response AND src_ip <> '8.8.8.8' GROUP BY src_ip, dns_query"""),
    Case("dns_race", q("dns", nc.dns_race, "distinct_answers"), "entity:s conflicts:i answer_count:i distinct_answers:l first_us:i last_us:i",
         w("dns") + f""",
r AS (SELECT *, lead(ts_us) OVER o AS nt, lead(dns_answer) OVER o AS na FROM ev WHERE dns_is_response WINDOW o AS (PARTITION BY dns_query ORDER BY ts_us, event_id)),
p AS (SELECT dns_query, count(*) AS conflicts, min(ts_us) AS first_us, max(nt) AS last_us FROM r
  WHERE nt - ts_us <= {6 * HOUR} * CAST(1000000 AS BIGINT) AND dns_answer IS DISTINCT FROM na GROUP BY 1)
SELECT p.dns_query AS entity, conflicts, count(DISTINCT dns_answer) AS answer_count, {whole('dns_answer')} AS distinct_answers, p.first_us, p.last_us
FROM p JOIN r USING (dns_query) GROUP BY 1, 2, 5, 6 HAVING count(DISTINCT dns_answer) >= 2"""),
    Case("dns_short_ttl", q("dns", nc.dns_short_ttl), "entity:s responses:i min_ttl:i max_ttl:i first_us:i last_us:i",
         w("dns") + f"""
SELECT dns_query AS entity, count(*) AS responses, min(dns_ttl) AS min_ttl, max(dns_ttl) AS max_ttl, {TIMES}
FROM ev WHERE dns_is_response AND dns_ttl BETWEEN 0 AND 60 GROUP BY dns_query HAVING count(*) >= 3"""),
    Case("tls_downgrade", q("http", nc.tls_downgrade, "clients"), "entity:s cleartext_requests:i dst_ip:s clients:l client_count:i first_us:i last_us:i",
         w("http") + f"""
SELECT lower(http_host) AS entity, count(*) AS cleartext_requests, arg_min(dst_ip, (ts_us, event_id)) AS dst_ip, {whole('src_ip')} AS clients, count(DISTINCT src_ip) AS client_count, {TIMES}
FROM ev WHERE kind = 'http' AND (dst_port IS NULL OR dst_port IN (80, 8080))
  AND lower(http_host) IN (SELECT lower(http_host) FROM ev WHERE (kind = 'tls' OR dst_port = 443) AND http_host IS NOT NULL) GROUP BY 1"""),
    Case("cleartext_creds", q("http", nc.cleartext_creds), "requests:i client_count:i severity:s first_us:i last_us:i",
         w("http") + f"""
SELECT count(*) AS requests, count(DISTINCT src_ip) AS client_count, {whole('src_ip')} AS clients, 'critical' AS severity, {TIMES} FROM ev
WHERE kind = 'http' AND (dst_port IS NULL OR dst_port IN (80, 8080)) AND upper(http_method) = 'POST' AND action <> 'block' AND signature IS NULL AND {HOME}
  AND regexp_matches(lower(http_uri), 'password|passwd|pwd|pass=|user=|username|login|token|session|auth') HAVING count(*) > 0"""),
]
