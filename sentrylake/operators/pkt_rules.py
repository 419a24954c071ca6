"""Rules over packet rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentrylake.functions import packet as pk
from sentrylake.functions import text as tx
from sentrylake.operators.rulebook import Found, bounds, found, listed, points, rule
from sentrylake.session import staged
from sentrylake.operators.windows import SECOND, densest_run, largest_mixed_run, previous_row, run_rows
from sentrylake.operators.win_rules import graded

# Ports where a TLS handshake is expected, tunnel tool names.
TLS_PORTS = [443, 465, 587, 636, 853, 989, 990, 993, 995, 3269, 5061, 5223, 5228, 8443, 8883, 9443]
TUNNEL_TOOLS = ["dnscat", "dns2tcp", "iodine", "dnscat2"]


def _syn(p: DataFrame) -> DataFrame:
    return p.where((F.col("proto") == "tcp") & (pk.number("tcp.flags.syn") == 1) & (pk.number("tcp.flags.ack") == 0))


def _run_summary(rows, keys, value, window_s, minimum, count_name, list_name, *extra) -> Found:
    """Largest run per key, then its distinct values of one column."""
    window = window_s * SECOND
    best = densest_run(rows, keys, window, minimum)
    hit = run_rows(rows, best, keys, window)
    per = staged(hit.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"), *bounds(), *extra))
    sums = [F.sum(c).alias(c) for c in per.columns if c not in (*keys, value, "n", "first_us", "last_us")]
    out = per.groupBy(*keys).agg(
        F.count(value).alias(count_name), F.sum("n").alias("packets"), *sums,
        F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"))
    return found(out.where(F.col(count_name) >= minimum), listed(list_name, per, keys, value), events=hit, keys=keys)


def _graded(out: Found, severity, confidence, rows: DataFrame | None = None) -> Found:
    return Found(graded(out.rows if rows is None else rows, severity, confidence), out.lists, out.events, out.event_keys)


@rule("pkt", "SCAN-NMAP-01", "TCP port scan", "Reconnaissance", ["T1046"])
def pkt_scan_vertical(p, cfg):
    rows = _syn(p).select("event_id", "src_ip", "dst_ip", "dst_port", "ts_us",
                          (F.coalesce(pk.number("tcp.window_size"), F.lit(0)) > cfg.scan_connect_window_floor).cast("int").alias("big"))
    out = _run_summary(rows, ["src_ip", "dst_ip"], "dst_port", cfg.vertical_scan_window_seconds, cfg.vertical_scan_min_ports,
                       "distinct_ports", "ports_probed", F.sum("big").alias("connect_n"))
    typed = out.rows.withColumn("scan_type", F.when(2 * F.col("connect_n") >= F.col("packets"), "connect").otherwise("syn")).drop("connect_n")
    return _graded(out, F.when(F.col("distinct_ports") >= 2 * cfg.vertical_scan_min_ports, "high").otherwise("medium"), "high", typed)


@rule("pkt", "SCAN-NMAP-02", "One port swept across hosts", "Reconnaissance", ["T1046"])
def pkt_scan_horizontal(p, cfg):
    rows = _syn(p).select("event_id", "src_ip", "dst_port", "dst_ip", "ts_us")
    return _graded(_run_summary(rows, ["src_ip", "dst_port"], "dst_ip", cfg.horizontal_scan_window_seconds, cfg.horizontal_scan_min_hosts,
                                "distinct_hosts", "hosts_probed"), "medium", "high")


@rule("pkt", "SCAN-NMAP-03", "UDP port scan", "Reconnaissance", ["T1046"])
def pkt_scan_udp(p, cfg):
    rows = p.where((F.col("proto") == "icmp") & (pk.number("icmp.type") == 3) & (pk.number("icmp.code") == 3)).select(
        "event_id", F.coalesce(pk.field("icmp.orig.ip.src"), "dst_ip").alias("src_ip"), F.col("src_ip").alias("dst_ip"),
        pk.number("icmp.orig.udp.dstport").alias("port"), "ts_us").where(F.col("port").isNotNull())
    return _graded(_run_summary(rows, ["src_ip", "dst_ip"], "port", cfg.udp_scan_window_seconds, cfg.udp_scan_min_unreachables,
                                "distinct_ports", "closed_ports"), "medium", "high")


def _spoofed(p, cfg):
    rows = p.where((F.col("proto") == "arp") & (pk.number("arp.opcode") == 2)).select(
        "event_id", pk.field("arp.src.proto_ipv4").alias("entity"), pk.field("arp.src.hw_mac").alias("mac"), "ts_us")
    rows = rows.where((F.col("entity") != "") & (F.col("mac") != ""))
    window = cfg.arp_conflict_window_seconds * SECOND
    best = largest_mixed_run(rows, ["entity"], "mac", window)
    hit = run_rows(rows, best, ["entity"], window)
    return hit, hit.groupBy("entity", "mac").agg(F.count(F.lit(1)).alias("n"), *bounds())


@rule("pkt", "ARP-SPOOF-01", "Conflicting ARP claims", "Credential Access", ["T1557.002"])
def pkt_arp_spoof(p, cfg):
    hit, per = _spoofed(p, cfg)
    out = per.groupBy("entity").agg(
        F.count(F.lit(1)).alias("mac_count"), F.sum("n").alias("replies"), F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"))
    return found(graded(out, "critical", "high"), listed("claiming_macs", per, ["entity"], "mac"), events=hit, keys=["entity"])


@rule("pkt", "ARP-SPOOF-02", "Traffic relayed by a spoofing host", "Credential Access", ["T1557.002"])
def pkt_arp_relay(p, cfg):
    macs = _spoofed(p, cfg)[1].select(F.col("mac").alias("dst_mac")).distinct()
    rows = p.where((F.col("dst_ip") != "") & (F.col("src_ip") != "")).join(macs, "dst_mac", "left_semi").withColumnRenamed("dst_mac", "entity")
    per = rows.groupBy("entity", "src_ip").agg(F.count(F.lit(1)).alias("n"), *bounds())
    out = per.groupBy("entity").agg(
        F.sum("n").alias("packets"), F.count(F.lit(1)).alias("victim_count"), F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"))
    return found(graded(out.where(F.col("packets") >= 3), "critical", "high"), listed("victims", per, ["entity"], "src_ip"), events=rows, keys=["entity"])


@rule("pkt", "ARP-FLOOD-01", "ARP request flood", "Reconnaissance", ["T1046"])
def pkt_arp_flood(p, cfg):
    rows = p.where((F.col("proto") == "arp") & (pk.number("arp.opcode") == 1)).select(
        "event_id", pk.field("arp.src.hw_mac").alias("entity"), pk.field("arp.dst.proto_ipv4").alias("target"), "ts_us").where(F.col("entity") != "")
    return _graded(_run_summary(rows, ["entity"], "target", cfg.arp_flood_window_seconds, cfg.arp_flood_min_targets,
                                "target_count", "targets_probed"), "medium", "high")


@rule("pkt", "FTP-BRUTE-01", "FTP password guessing", "Credential Access", ["T1110.001"])
def pkt_ftp_brute(p, cfg):
    rows = p.where(pk.number("ftp.response.code") == 530).select("event_id", F.col("dst_ip").alias("src_ip"), F.col("src_ip").alias("dst_ip"), "ts_us")
    keys, window = ["src_ip", "dst_ip"], cfg.bruteforce_window_seconds * SECOND
    best = densest_run(rows, keys, window, cfg.bruteforce_min_failures)
    out = best.select(*keys, F.col("run_n").alias("failure_count"), F.col("run_end").alias("last_us"))
    return found(graded(out, "high", "high"), events=run_rows(rows, best, keys, window), keys=keys)


def ftp_logins(p: DataFrame) -> DataFrame:
    """PASS commands with the USER just before them in the same client/server stream."""
    rows = p.where(pk.field("ftp.request.command").isin("USER", "PASS")).select(
        "event_id", "frame_number", "ts_us", "src_ip", "dst_ip", pk.field("ftp.request.command").alias("cmd"), pk.field("ftp.request.arg").alias("arg"))
    before = previous_row(rows, ["src_ip", "dst_ip"], ["cmd", "arg"])
    return before.where(F.col("cmd") == "PASS").withColumn("login", F.when(F.col("prev.cmd") == "USER", F.col("prev.arg"))).drop("prev", "cmd")


@rule("pkt", "FTP-BRUTE-02", "FTP password spray", "Credential Access", ["T1110.003"])
def pkt_ftp_spray(p, cfg):
    rows = ftp_logins(p).where(F.col("login") != "").withColumnRenamed("arg", "password")
    key = ["dst_ip", "password"]
    per = rows.groupBy(*key, "login").agg(F.count(F.lit(1)).alias("n"), *bounds())
    out = per.groupBy(*key).agg(F.count(F.lit(1)).alias("distinct_users"), F.sum("n").alias("attempts"),
                                F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"))
    out = out.where(F.col("distinct_users") >= cfg.spray_min_targets)
    return found(graded(out, "high", "medium"), listed("usernames_tried", per, key, "login"), events=rows, keys=key)


@rule("pkt", "DHCP-ANOM-01", "DHCP starvation", "Impact", ["T1557"])
def pkt_dhcp_starvation(p, cfg):
    rows = p.where(pk.number("dhcp.option.dhcp").isin(1, 3) & (pk.field("dhcp.hw.mac_addr") != ""))
    out = rows.groupBy("src_ip", pk.field("dhcp.hw.mac_addr").alias("mac")).agg(*bounds()).groupBy("src_ip").agg(
        F.count(F.lit(1)).alias("distinct_client_macs"), F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"))
    return graded(out.where(F.col("distinct_client_macs") >= 10), "high", "medium")


@rule("pkt", "DHCP-ANOM-02", "Many DHCP refusals", "Impact")
def pkt_dhcp_nak(p, cfg):
    rows = p.where(pk.number("dhcp.option.dhcp") == 6).select(
        "event_id", "ts_us", F.lit("all").alias("scope"), F.coalesce(pk.field("dhcp.option.message"), F.lit("unspecified")).alias("reason"))
    per = rows.groupBy("scope", "reason").agg(F.count(F.lit(1)).alias("n"), *bounds()).withColumn("reason", F.concat_ws("=", "reason", F.col("n").cast("string")))
    out = per.groupBy("scope").agg(F.sum("n").alias("nak_count"), F.count(F.lit(1)).alias("reason_count"), F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"))
    return found(graded(out.where(F.col("nak_count") >= 5), "low", "low"), listed("reasons", per, ["scope"], "reason"), events=rows, keys=["scope"])


@rule("pkt", "HTTP-UA-01", "Scanner user agent", "Reconnaissance", ["T1595.002"])
def pkt_scanner_agent(p, cfg):
    ua = pk.field("http.user_agent")
    rows = p.where(tx.any_hit(ua, cfg.scanner_user_agents)).withColumn("tool", tx.first_hit(ua, cfg.scanner_user_agents))
    rows = rows.withColumn("ua", ua).withColumn("path", F.nullif(pk.field("http.request.uri"), F.lit("")))
    key = ["src_ip", "dst_ip", "tool"]
    out = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("requests"), F.countDistinct("path").alias("path_count"), F.min("ua").alias("user_agent"), *bounds())
    return found(graded(out, "medium", "high"), listed("paths", rows, key, "path"), events=rows, keys=key)


@rule("pkt", "HTTP-UA-02", "Rotating user agents", "Reconnaissance")
def pkt_agent_rotation(p, cfg):
    rows = p.where(pk.field("http.user_agent") != "")
    per = rows.groupBy("src_ip", pk.field("http.user_agent").alias("ua")).agg(*bounds())
    out = per.groupBy("src_ip").agg(F.count(F.lit(1)).alias("agent_count"), F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"))
    return found(graded(out.where(F.col("agent_count") >= 3), "low", "low"), listed("user_agents", per, ["src_ip"], "ua"), events=rows, keys=["src_ip"])


@rule("pkt", "HTTP-LOG4J-01", "Log4Shell lookup in a request", "Initial Access", ["T1190"])
def pkt_log4j(p, cfg):
    names = {"user_agent": "http.user_agent", "uri": "http.request.uri", "host": "http.host", "referer": "http.referer",
             "x_forwarded_for": "http.x_forwarded_for", "cookie": "http.cookie", "body": "http.file_data"}
    # The cheap literal gate keeps the ten rewrite rounds away from ordinary requests.
    gate = F.lit(False)
    for f in names.values():
        gate = gate | F.coalesce(pk.field(f).contains("${") | pk.field(f).contains("Exploit.class"), F.lit(False))
    parts = F.array(*[F.struct(F.lit(n).alias("field"), pk.field(f).alias("value")) for n, f in names.items()])
    hit = F.get(F.filter(parts, lambda s: pk.has_jndi(s["value"])), F.lit(0))
    rows = tx.compute_once(p.where(gate), hit=hit).where(F.col("hit").isNotNull())
    out = rows.groupBy("src_ip", "dst_ip").agg(F.count(F.lit(1)).alias("requests"), F.min_by("hit", "event_id").alias("h"), *bounds())
    plain = pk.jndi_plain(F.col("h.value"))
    return graded(out.select("src_ip", "dst_ip", "requests", F.col("h.field").alias("field"), F.col("h.value").alias("payload"),
                             F.when(plain != F.col("h.value"), plain).alias("deobfuscated"), "first_us", "last_us"), "critical", "high")


@rule("pkt", "TLS-PORT-01", "TLS on an unexpected port", "Command & Control", ["T1571"])
def pkt_tls_port(p, cfg):
    rows = p.where((pk.number("tls.handshake.type") == 1) & ~F.coalesce(F.col("dst_port").isin(TLS_PORTS), F.lit(False)))
    out = rows.groupBy("src_ip", "dst_ip", "dst_port").agg(
        F.count(F.lit(1)).alias("hellos"), F.min_by(pk.field("tls.handshake.extensions_server_name"), "event_id").alias("sni"), *bounds())
    return graded(out, "medium", "medium")


@rule("pkt", "TUNNEL-ICMP-01", "Oversized ICMP payloads", "Exfiltration", ["T1095"])
def pkt_icmp_tunnel(p, cfg):
    size = pk.number("data.len")
    rows = p.where((F.col("proto") == "icmp") & pk.number("icmp.type").isin(0, 8) & (size > cfg.icmp_tunnel_payload_len_floor)).select(
        F.least("src_ip", "dst_ip").alias("src_ip"), F.greatest("src_ip", "dst_ip").alias("dst_ip"), "ts_us", size.alias("size"))
    key, window = ["src_ip", "dst_ip"], cfg.icmp_tunnel_window_seconds * SECOND
    best = densest_run(rows, key, window, cfg.icmp_tunnel_min_packets)
    out = run_rows(rows, best, key, window).groupBy(*key).agg(
        F.count(F.lit(1)).alias("packet_count"), F.min("size").alias("min_size"), F.max("size").alias("max_size"), *bounds())
    return graded(out, "high", "medium")


def dns_name_score(name, cfg):
    label = F.split_part(name, F.lit("."), F.lit(1))
    encoded = (F.length(label) >= 16) & (label.rlike("^[0-9a-fA-F]+$") | F.upper(label).rlike("^[A-Z2-7]+=*$") | label.rlike("^[A-Za-z0-9+/]+=*$"))
    return points((tx.any_hit(name, TUNNEL_TOOLS), 5), (F.length(name) >= cfg.dns_tunnel_qname_len_floor, 1), (encoded, 2),
                  (tx.entropy(label) >= 3.5, 1), (tx.digit_ratio(label) > 0.4, 1))


@rule("pkt", "TUNNEL-DNS-01", "DNS tunnel", "Exfiltration", ["T1071.004"])
def pkt_dns_tunnel(p, cfg):
    name = pk.field("dns.qry.name")
    asked = F.coalesce(pk.field("dns.flags.response"), F.lit("0")).isin("0", "false", "False", "")
    rows = p.where((name != "") & asked & ~tx.has_suffix(F.regexp_replace(F.lower(name), r"\.+$", ""), cfg.dns_tunnel_allowlist))
    rows = rows.select("src_ip", "ts_us", "event_id", name.alias("name"))
    window = cfg.dns_tunnel_window_seconds * SECOND
    best = densest_run(rows, ["src_ip"], window, cfg.dns_tunnel_min_queries)
    inside = run_rows(rows, best, ["src_ip"], window).withColumn("s", dns_name_score(F.col("name"), cfg)).where(F.col("s") >= 2)
    out = inside.groupBy("src_ip").agg(F.count(F.lit(1)).alias("query_count"), F.round(F.avg(F.length("name")), 1).alias("avg_query_len"), *bounds())
    return graded(out.where(F.col("query_count") >= cfg.dns_tunnel_min_queries), "high", "medium")
