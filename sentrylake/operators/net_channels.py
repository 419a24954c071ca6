"""Beacon, exfiltration, web-attack and man-in-the-middle rules over network events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sentrylake.functions import text as tx
from sentrylake.functions.net import SUSPICIOUS_PORTS, in_networks, present, service_name
from sentrylake.operators.net_access import BLOCKED, not_listed
from sentrylake.operators.rulebook import band, bounds, found, listed, points, rule
from sentrylake.session import removed, staged, staged_at
from sentrylake.operators.windows import (SECOND, bucket_of, densest_run, exact_median, previous_instant,
                                          run_rows)

# File endings that count as sensitive in an upload.
SENSITIVE_EXT = [".csv", ".xlsx", ".xls", ".pdf", ".doc", ".docx", ".sql", ".db", ".bak", ".zip", ".rar",
                 ".7z", ".tar", ".gz", ".pst", ".key", ".pem"]
# Signature terms of web attacks, and credential field names.
WEB_TERMS = ["sql injection", "sqli", "xss", "directory traversal", "path traversal", "command injection",
             "rfi", "lfi", "web_server", "web-application"]
CREDENTIAL_TOKENS = ["password", "passwd", "pwd", "pass=", "user=", "username", "login", "token", "session", "auth"]


def egress(ev: DataFrame, cfg) -> DataFrame:
    return ev.where(present(F.col("src_ip")) & present(F.col("dst_ip"))
                    & in_networks(F.col("src_ip"), cfg.home_nets) & ~in_networks(F.col("dst_ip"), cfg.home_nets))


def gap_statistics(instants: DataFrame, keys: list[str]) -> DataFrame:
    """Per key over distinct instants: gap count, jitter (stdev/mean), median, MAD/median and the
    share of gaps within 20 % of the median. Gaps are integer microseconds, medians are exact."""
    gaps = previous_instant(instants, keys).where(F.col("prev_us").isNotNull())
    gaps = staged(gaps.select(*keys, (F.col("ts_us") - F.col("prev_us")).alias("gap")))
    basic = gaps.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("gaps"), (F.stddev_pop(F.col("gap") / SECOND) / F.avg(F.col("gap") / SECOND)).alias("jitter"))
    med = staged(exact_median(gaps, keys, "gap", 60 * SECOND, "med2"))
    dev = gaps.join(med, keys).withColumn("dev", F.abs(2 * F.col("gap") - F.col("med2")))
    near = dev.groupBy(*keys).agg(F.avg((F.col("dev") <= 0.2 * F.col("med2")).cast("double")).alias("near"))
    mad = exact_median(dev.select(*keys, "dev"), keys, "dev", 60 * SECOND, "mad2")
    return (basic.join(med, keys).join(near, keys).join(mad, keys)
            .withColumn("period", F.col("med2") / (2.0 * SECOND))
            .withColumn("mad_ratio", F.col("mad2") / (2.0 * F.col("med2"))))


@rule("net", "NSM-C2-001", "Regular call-home traffic", "Command & Control", ["T1071.001", "T1573"], reads="egress")
def c2_beacon(ev, cfg):
    rows = egress(ev.where(F.col("kind").isin("network_flow", "http", "dns", "ids_alert")
                           & F.col("ts_us").isNotNull()), cfg)
    key = ["src_ip", "dst_ip", "port"]
    rows = rows.withColumn("port", F.coalesce("dst_port", F.lit(-1)))
    hint = tx.any_hit(F.col("signature"), ["c2", "trojan", "beacon"])
    # Read twice, and shuffled again each time: written, so that the first shuffle is gone by then.
    uniq, folder = staged_at(rows.groupBy(*key, "ts_us").agg(
        F.min_by(F.struct("bytes_out", hint.alias("hint")), "event_id").alias("f")))
    enough = uniq.groupBy(*key).agg(
        F.count(F.lit(1)).alias("connections"), F.max(F.col("f.hint")).alias("ids_confirmed"),
        F.count_if(F.col("f.bytes_out") > 0).alias("sizes"),
        F.stddev_pop(F.when(F.col("f.bytes_out") > 0, F.col("f.bytes_out"))).alias("size_sd"),
        F.avg(F.when(F.col("f.bytes_out") > 0, F.col("f.bytes_out"))).alias("size_avg"),
        *bounds()).where(F.col("connections") >= cfg.beacon_min_events)
    enough = staged(enough)
    stats = gap_statistics(uniq.select(*key, "ts_us").join(enough.select(*key), key, "left_semi"), key)
    removed(ev.sparkSession, folder)  # the gaps are written
    regular = (F.col("jitter") <= cfg.beacon_max_jitter) | (F.col("mad_ratio") <= cfg.beacon_max_mad_ratio)
    hit = stats.where((F.col("gaps") >= 3) & (F.col("near") >= 0.70) & regular
                      & F.col("period").between(cfg.beacon_min_period_s, cfg.beacon_max_period_s))
    out = hit.join(enough, key).withColumn(
        "size_cv", F.when(F.col("sizes") >= 3, F.col("size_sd") / F.col("size_avg")))
    bad_port = F.col("port").isin(SUSPICIOUS_PORTS)
    score = points(
        (F.col("jitter") <= 0.10, 3), ((F.col("jitter") > 0.10) & (F.col("jitter") <= cfg.beacon_max_jitter), 2),
        (F.col("mad_ratio") <= cfg.beacon_max_mad_ratio, 1), (F.col("size_cv") <= cfg.beacon_size_cv_max, 2),
        (bad_port, 3), (F.col("connections") >= 20, 1), (F.col("ids_confirmed"), 3))
    # A channel without a port repeats one that is reported with its port.
    ported = F.max((F.col("port") >= 0).cast("int")).over(Window.partitionBy("src_ip", "dst_ip"))
    out = out.withColumn("_p", ported).where((F.col("port") >= 0) | (F.col("_p") == 0))
    port = F.when(F.col("port") >= 0, F.col("port"))
    out = out.select(
        "src_ip", "dst_ip", F.col("port").alias("channel"), port.alias("dst_port"), "connections", F.round("period", 1).alias("period_seconds"),
        F.round("jitter", 4).alias("jitter_ratio"), F.round("mad_ratio", 4).alias("mad_ratio"),
        F.round("size_cv", 4).alias("size_cv"), service_name(port).alias("service"),
        F.coalesce(bad_port, F.lit(False)).alias("suspicious_port"), "ids_confirmed", score.alias("score"),
        band(score, (7, "critical"), (5, "high"), default="medium").alias("severity"),
        band(score, (6, "high"), (4, "medium"), default="low").alias("confidence"),
        F.round((F.col("last_us") - F.col("first_us")) / (3600.0 * SECOND), 1).alias("duration_hours"),
        F.concat_ws(":", "dst_ip", port.cast("string")).alias("entity"), "first_us", "last_us")
    return found(out, events=rows.withColumnRenamed("port", "channel"), keys=["src_ip", "dst_ip", "channel"])


@rule("net", "NSM-C2-002", "Traffic on an attack-tool port", "Command & Control", ["T1571"], reads="tool")
def c2_bad_port(ev, cfg):
    rows = ev.where(F.col("dst_port").isin(SUSPICIOUS_PORTS) & present(F.col("src_ip")) & present(F.col("dst_ip")))
    out = rows.groupBy("src_ip", "dst_ip", "dst_port").agg(F.count(F.lit(1)).alias("events"), *bounds())
    outbound = in_networks(F.col("src_ip"), cfg.home_nets) & ~in_networks(F.col("dst_ip"), cfg.home_nets)
    out = (out.withColumn("outbound", outbound)
           .withColumn("severity", F.when(F.col("outbound"), "high").otherwise("medium"))
           .withColumn("confidence", F.lit("medium"))
           .withColumn("entity", F.concat_ws(":", "dst_ip", F.col("dst_port").cast("string"))))
    return found(out, events=rows, keys=["src_ip", "dst_ip", "dst_port"])


@rule("net", "NSM-EXFIL-001", "Data carried in DNS names", "Exfiltration", ["T1071.004", "T1048.003"], reads="dns")
def exfil_dns(ev, cfg):
    q = F.col("dns_query")
    rows = tx.compute_once(ev.where(present(q)), domain=tx.registered_domain(q), sub=tx.subdomain_part(q))
    rows = rows.where(F.col("domain").isNotNull() & (F.col("domain") != "") & ~tx.has_suffix(F.col("domain"), cfg.domain_allowlist))
    sub = F.when(F.col("sub") != "", F.col("sub"))
    flat = F.replace(sub, F.lit("."), F.lit(""))
    labels = F.split(sub, r"\.")
    qtype = F.upper("dns_qtype")
    feats = rows.select(
        "domain", "src_ip", "ts_us", sub.alias("sub"), F.length(q).alias("qlen"), tx.longest_label(q).alias("label"),
        F.when(F.length(sub) >= 8, tx.entropy(flat)).alias("ent"),
        F.coalesce(F.size(F.filter(labels, lambda x: tx.encoded_label(x).isNotNull())), F.lit(0)).alias("enc"),
        F.coalesce(qtype.isin(cfg.dns_suspicious_qtypes), F.lit(False)).alias("odd"),
        F.coalesce(F.upper("dns_rcode").isin("NXDOMAIN", "3"), F.lit(False)).alias("nx"),
        F.coalesce("dns_is_response", F.lit(False)).alias("resp"), F.length(flat).alias("chars"),
        tx.consonant_run(sub).alias("run"), tx.digit_ratio(sub).alias("dig"))
    feats = feats.withColumn("run", F.when(F.col("sub").isNotNull(), F.col("run"))).withColumn(
        "dig", F.when(F.col("sub").isNotNull(), F.col("dig"))).withColumn(
        "enc", F.when(F.col("sub").isNotNull(), F.col("enc")).otherwise(0))
    out = feats.groupBy("domain").agg(
        F.count(F.lit(1)).alias("queries"), F.max("qlen").alias("max_qname_len"), F.avg("qlen").alias("mq"),
        F.max("label").alias("max_label_len"), F.coalesce(F.avg("ent"), F.lit(0.0)).alias("me"),
        F.countDistinct("sub").alias("unique_subdomains"), F.sum("enc").alias("encoded_labels"),
        F.count_if("odd").alias("odd_qtypes"), F.count_if("nx").alias("nx"), F.count_if("resp").alias("resp"),
        F.countDistinct(F.when(present(F.col("src_ip")), F.col("src_ip"))).alias("host_count"),
        F.min(F.when(present(F.col("src_ip")), F.col("src_ip"))).alias("one_host"),
        F.coalesce(F.avg("run"), F.lit(0.0)).alias("mr"), F.coalesce(F.avg("dig"), F.lit(0.0)).alias("md"),
        F.coalesce(F.sum("chars"), F.lit(0)).alias("chars"), *bounds())
    many = F.col("queries") >= 10
    score = points(
        (F.col("max_qname_len") >= cfg.dns_min_qname_len, 2), (F.col("max_label_len") >= cfg.dns_min_label_len, 2),
        (F.col("me") >= cfg.dns_min_entropy, 3), (F.col("queries") >= cfg.dns_min_queries_per_domain, 2),
        (F.col("unique_subdomains") >= cfg.dns_min_unique_subdomains, 2), (F.col("encoded_labels") >= 3, 2),
        (F.col("odd_qtypes") >= 3, 1), (many & (F.col("nx") / F.col("queries") >= cfg.dns_nxdomain_ratio), 2),
        (many & (1.0 - F.col("resp") / F.col("queries") >= 0.8), 1),
        (F.col("host_count") >= cfg.dns_min_hosts_for_campaign, 1), (F.col("mr") >= 8, 1), (F.col("md") >= 0.25, 1))
    out = staged(out.withColumn("score", score).where(F.col("score") >= 5))
    hit = rows.join(out.select("domain"), "domain", "left_semi").withColumnRenamed("domain", "entity")
    out = out.select(
        F.col("domain").alias("entity"), "queries", "unique_subdomains", "max_qname_len",
        F.round("mq", 1).alias("mean_qname_len"), "max_label_len", F.round("me", 3).alias("mean_entropy"),
        "encoded_labels", F.round(F.col("nx") / F.col("queries"), 3).alias("nxdomain_ratio"), "host_count",
        F.when(F.col("host_count") == 1, F.col("one_host")).alias("src_ip"),
        F.floor(F.col("chars") * 5 / 8).alias("estimated_bytes"), "score",
        band(F.col("score"), (10, "critical"), (7, "high"), default="medium").alias("severity"),
        band(F.col("score"), (8, "high"), default="medium").alias("confidence"), "first_us", "last_us")
    return found(out, listed("internal_hosts", hit.where(present(F.col("src_ip"))), ["entity"], "src_ip"), events=hit, keys=["entity"])


@rule("net", "NSM-EXFIL-002", "DNS sent to an unapproved resolver", "Command & Control", ["T1071.004"], reads="port53")
def exfil_direct_dns(ev, cfg):
    rows = egress(ev.where((F.col("dst_port") == 53) | (F.col("kind") == "dns")), cfg)
    rows = not_listed(rows, "dst_ip", cfg.known_resolvers)
    out = rows.groupBy("src_ip", "dst_ip").agg(F.count(F.lit(1)).alias("queries"), *bounds())
    out = out.where(F.col("queries") >= 5).withColumn("severity", F.lit("medium")).withColumn("confidence", F.lit("medium"))
    return found(out, events=rows, keys=["src_ip", "dst_ip"])


@rule("net", "NSM-EXFIL-003", "Bulk upload over HTTP", "Exfiltration", ["T1041", "T1048.003", "T1567.002"], reads="http")
def exfil_http(ev, cfg):
    posts = ev.where((F.upper("http_method") == "POST") & present(F.col("src_ip")) & in_networks(F.col("src_ip"), cfg.home_nets))
    dest = F.coalesce(F.when(present(F.col("http_host")), F.col("http_host")),
                      F.when(present(F.col("dst_ip")), F.col("dst_ip")), F.lit("unknown"))
    posts = posts.withColumn("dest", dest)
    sig = tx.any_hit(F.col("signature"), ["exfil", "post large"])
    out = not_listed(posts, "dest", cfg.upload_destination_allowlist).groupBy("src_ip", "dest").agg(
        F.count(F.lit(1)).alias("posts"), F.sum("bytes_out").alias("total_bytes"), F.max("bytes_out").alias("largest_bytes"),
        F.max(sig).alias("sig"), *bounds())
    one = posts.where(F.col("bytes_out") > 0).select(F.lit(1).alias("_one"), "bytes_out")
    base = exact_median(one, ["_one"], "bytes_out", 1 << 16, "b2")
    # The baseline is a single row.
    out = out.withColumn("_one", F.lit(1)).join(F.broadcast(base), "_one", "left").drop("_one")
    baseline = F.coalesce(F.col("b2") / 2.0, F.lit(0.0))
    total_hit = F.col("total_bytes") >= cfg.exfil_min_total_bytes
    out = out.where(total_hit | (F.col("largest_bytes") >= cfg.http_post_large_bytes) | (
        (F.col("posts") >= cfg.http_min_posts_to_new_domain) & (baseline > 0) & (F.col("largest_bytes") > 10 * baseline)))
    score = points(
        (total_hit, 3), (F.col("largest_bytes") >= 2 * cfg.http_post_large_bytes, 2),
        (F.col("posts") >= cfg.http_min_posts_to_new_domain, 1),
        ((baseline > 0) & (F.col("largest_bytes") > 20 * baseline), 2), (F.col("sig"), 3),
        (~in_networks(F.col("dest"), cfg.home_nets) & F.col("dest").contains("."), 1))
    out = out.select(
        "src_ip", F.col("dest").alias("entity"), "posts", "total_bytes", "largest_bytes",
        baseline.alias("baseline_median_bytes"), score.alias("score"),
        band(score, (7, "critical"), (4, "high"), default="medium").alias("severity"),
        band(score, (6, "high"), default="medium").alias("confidence"), "first_us", "last_us")
    return found(out, events=posts.withColumnRenamed("dest", "entity"), keys=["src_ip", "entity"])


@rule("net", "NSM-EXFIL-004", "Lopsided outbound volume", "Exfiltration", ["T1041"], reads="egress")
def exfil_volume(ev, cfg, window_s: int | None = None):
    rows = egress(ev, cfg).where((F.col("bytes_out") != 0) | (F.col("bytes_in") != 0))
    keys = ["src_ip", "dst_ip"]
    if window_s:
        rows = rows.withColumn("window_start_us", bucket_of(F.col("ts_us"), window_s * SECOND) * (window_s * SECOND))
        keys = keys + ["window_start_us"]
    out = rows.groupBy(*keys).agg(
        F.sum("bytes_out").alias("bytes_out"), F.sum("bytes_in").alias("bytes_in"), F.count(F.lit(1)).alias("flows"), *bounds())
    ratio = F.when(F.col("bytes_in") > 0, F.col("bytes_out") / F.col("bytes_in"))
    out = (out.where((F.col("bytes_out") >= cfg.exfil_min_total_bytes)
                     & F.coalesce(ratio >= cfg.exfil_out_in_ratio, F.lit(True)))
           .withColumn("ratio", F.round(ratio, 2)).withColumn("severity", F.lit("high"))
           .withColumn("confidence", F.lit("medium")))
    return found(out, events=rows, keys=keys)


@rule("net", "NSM-EXFIL-005", "Data carried in ICMP", "Exfiltration", ["T1095", "T1048.003"], reads="icmp")
def exfil_icmp(ev, cfg):
    rows = ev.where(((F.col("protocol") == "icmp") | (F.col("kind") == "icmp"))
                    & present(F.col("src_ip")) & present(F.col("dst_ip")))
    pay = F.when(F.col("icmp_payload_len") > 0, F.col("icmp_payload_len").cast("bigint"))
    byt = F.when(F.col("bytes_out") > 0, F.col("bytes_out"))
    limit = cfg.icmp_payload_suspicious_bytes
    body = F.col("extra")["payload"]
    out = rows.groupBy("src_ip", "dst_ip").agg(
        F.count(F.lit(1)).alias("packets"), F.max(pay).alias("mp"), F.max(byt).alias("mb"),
        F.count_if(pay > limit).alias("bp"), F.count_if(byt > limit).alias("bb"),
        F.avg(pay).alias("ap"), F.avg(byt).alias("ab"),
        F.avg(F.when(present(body), tx.entropy(body))).alias("ent"), *bounds())
    out = (out.withColumn("max_payload", F.coalesce("mp", "mb"))
           .withColumn("oversized_packets", F.when(F.col("mp").isNotNull(), F.col("bp")).otherwise(F.col("bb")))
           .withColumn("mean_payload", F.round(F.coalesce("ap", "ab"), 1)))
    out = out.where(F.col("max_payload").isNotNull() & (
        (F.col("oversized_packets") >= 3) | (F.col("packets") >= cfg.icmp_min_packets)))
    outside = ~in_networks(F.col("dst_ip"), cfg.home_nets)
    score = points((F.col("max_payload") > limit, 3), (F.col("max_payload") > 256, 2),
                   (F.col("packets") >= cfg.icmp_min_packets, 1), (outside, 2), (F.col("ent") >= 4.5, 3))
    out = out.withColumn("score", score).where(F.col("score") >= 4).select(
        "src_ip", "dst_ip", "packets", "max_payload", "oversized_packets", "mean_payload",
        outside.alias("external_destination"), "score", band(F.col("score"), (6, "high"), default="medium").alias("severity"),
        F.lit("medium").alias("confidence"), "first_us", "last_us")
    return found(out, events=rows, keys=["src_ip", "dst_ip"])


@rule("net", "NSM-EXFIL-006", "Upload over FTP", "Exfiltration", ["T1048.003"], reads="ftp")
def exfil_ftp(ev, cfg):
    rows = ev.where(((F.col("kind") == "ftp") | F.col("dst_port").isin(20, 21))
                    & present(F.col("src_ip")) & present(F.col("dst_ip")))
    cmd, arg = F.upper("ftp_command"), F.col("ftp_arg")
    low = F.lower(arg)
    ends = F.lit(False)
    for e in SENSITIVE_EXT:
        ends = ends | low.endswith(e)
    stor = cmd == "STOR"
    user = F.when((cmd == "USER") & present(arg), arg)
    sensitive = F.coalesce(stor & present(arg) & ends, F.lit(False))
    out = rows.groupBy("src_ip", "dst_ip").agg(
        F.count_if(stor).alias("stor_count"), F.count_if(sensitive).alias("sensitive_count"), F.countDistinct(F.when(sensitive, arg)).alias("sensitive_file_count"), F.min(user).alias("user"),
        F.coalesce(F.max(F.lower(user).isin("anonymous", "guest", "ftp", "test")), F.lit(False)).alias("guest"),
        F.coalesce(F.max(cmd == "PASS"), F.lit(False)).alias("cleartext_password_observed"), *bounds())
    out = out.where((F.col("sensitive_count") > 0) | (F.col("stor_count") >= F.greatest(F.lit(1), F.lit(cfg.ftp_stor_min_transfers))))
    outside = ~in_networks(F.col("dst_ip"), cfg.home_nets)
    score = points((F.col("stor_count") > 0, 2), (F.col("sensitive_count") > 0, 3), (outside, 3),
                   (F.col("guest"), 2), (F.col("cleartext_password_observed"), 1))
    out = (out.withColumn("external_destination", outside).withColumn("score", score).drop("guest")
           .withColumn("severity", band(F.col("score"), (7, "critical"), (5, "high"), default="medium"))
           .withColumn("confidence", F.when(F.col("sensitive_count") > 0, "high").otherwise("medium")))
    keys = ["src_ip", "dst_ip"]
    return found(out, listed("sensitive_files", rows.where(sensitive), keys, "ftp_arg"), events=rows, keys=keys)


@rule("net", "NSM-WEB-001", "Web application attack", "Exploitation", ["T1190", "T1059"], reads="alert")
def web_attack(ev, cfg):
    rows = ev.where(tx.any_hit(F.col("signature"), WEB_TERMS) & present(F.col("src_ip")))
    rows = rows.withColumn("attack", F.trim("signature"))
    per = rows.groupBy("src_ip", "attack").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("action").isin("block", "drop")).alias("b"), *bounds())
    out = per.groupBy("src_ip").agg(
        F.count(F.lit(1)).alias("type_count"), F.sum("n").alias("alerts"), F.sum("b").alias("blocked"),
        F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"))
    severe = (F.col("type_count") >= 2) | (F.col("blocked") < F.col("alerts"))
    out = (out.withColumn("unblocked", F.col("alerts") - F.col("blocked"))
           .withColumn("severity", F.when(severe, "high").otherwise("medium")).withColumn("confidence", F.lit("high")))
    return found(out, listed("attack_types", per, ["src_ip"], "attack"), events=rows, keys=["src_ip"])


@rule("net", "NSM-MITM-001", "One address claimed by several MACs", "Exploitation", ["T1557.002"], reads="arp")
def arp_conflict(ev, cfg):
    rows = ev.where((F.col("kind") == "arp") & present(F.col("arp_sender_ip")) & (F.col("arp_opcode") == 2)
                    & present(F.col("arp_sender_mac")))
    rows = rows.withColumnRenamed("arp_sender_ip", "entity")
    per = staged(rows.groupBy("entity", "arp_sender_mac").agg(F.count(F.lit(1)).alias("replies"), *bounds()))
    # Who claimed the address first is taken for its owner; the others are a list of any length.
    out = per.groupBy("entity").agg(
        F.count(F.lit(1)).alias("mac_count"), F.min(F.struct("first_us", "arp_sender_mac"))["arp_sender_mac"].alias("likely_legitimate_mac"),
        F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"))
    gateway = F.col("entity").isin(list(cfg.gateway_ips)) if cfg.gateway_ips else F.lit(False)
    out = (out.where(F.col("mac_count") >= cfg.arp_min_conflicting_macs)
           .withColumn("suspect_count", F.col("mac_count") - 1).withColumn("is_gateway", gateway)
           .withColumn("severity", F.when(F.col("is_gateway"), "critical").otherwise("high"))
           .withColumn("confidence", F.lit("high")))
    suspects = per.join(out.select("entity", "likely_legitimate_mac"), "entity").where(F.col("arp_sender_mac") != F.col("likely_legitimate_mac"))
    return found(out, listed("suspect_macs", suspects, ["entity"], "arp_sender_mac"), events=rows, keys=["entity"])


@rule("net", "NSM-MITM-002", "Burst of unsolicited ARP replies", "Exploitation", ["T1557.002"], reads="arp")
def arp_burst(ev, cfg):
    rows = ev.where((F.col("kind") == "arp") & present(F.col("arp_sender_ip")) & F.col("arp_is_gratuitous")
                    & present(F.col("arp_sender_mac"))).select(
        "event_id", F.col("arp_sender_mac").alias("entity"), "arp_sender_ip", "ts_us")
    window = cfg.arp_window_s * SECOND
    best = densest_run(rows, ["entity"], window, cfg.arp_gratuitous_burst)
    hit = run_rows(rows, best, ["entity"], window)
    per = hit.groupBy("entity", "arp_sender_ip").agg(F.count(F.lit(1)).alias("n"), *bounds())
    out = per.groupBy("entity").agg(
        F.sum("n").alias("replies"), F.count(F.lit(1)).alias("claimed_count"),
        F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"))
    out = out.withColumn("severity", F.lit("high")).withColumn("confidence", F.lit("medium"))
    return found(out, listed("claimed_ips", per, ["entity"], "arp_sender_ip"), events=hit, keys=["entity"])


def dns_answers(ev: DataFrame) -> DataFrame:
    return ev.where(F.col("dns_is_response") & present(F.col("dns_query")) & F.col("ts_us").isNotNull())


@rule("net", "NSM-MITM-003", "DNS answer from an unapproved responder", "Exploitation", ["T1557", "T1071.004"], reads="dns")
def dns_rogue(ev, cfg):
    rows = not_listed(dns_answers(ev).where(present(F.col("src_ip"))), "src_ip", cfg.known_resolvers)
    if cfg.gateway_ips:
        rows = rows.where(~(F.col("src_ip").isin(list(cfg.gateway_ips)) & in_networks(F.col("src_ip"), cfg.home_nets)))
    rows, key = rows.withColumnRenamed("dns_query", "entity"), ["src_ip", "entity"]
    out = rows.groupBy(*key).agg(
        F.count(F.lit(1)).alias("responses"), F.countDistinct(F.when(present(F.col("dns_answer")), F.col("dns_answer"))).alias("answer_count"),
        F.countDistinct("dns_ttl").alias("ttl_count"), *bounds())
    out = out.withColumn("severity", F.lit("critical")).withColumn("confidence", F.lit("high"))
    return found(out, listed("answers", rows, key, "dns_answer"), listed("ttls", rows, key, "dns_ttl"), events=rows, keys=key)


@rule("net", "NSM-MITM-004", "Conflicting DNS answers in quick succession", "Exploitation", ["T1557"], reads="dns")
def dns_race(ev, cfg):
    gap = int(cfg.dns_spoof_race_window_s * SECOND)
    rows = dns_answers(ev).select("event_id", "ts_us", "dns_query", "dns_answer", "src_ip")
    # A neighbour further away than the race window does not matter, so each time bucket only
    # needs the rows just behind its start.
    width = max(600 * SECOND, gap)
    home = bucket_of(F.col("ts_us"), width)
    spread = rows.withColumn("b", F.explode(F.array_distinct(F.array(home, bucket_of(F.col("ts_us") - gap, width)))))
    order = Window.partitionBy("dns_query", "b").orderBy("ts_us", "event_id")
    after = F.lead(F.struct("ts_us", "dns_answer")).over(order)
    pairs = spread.withColumn("nx", after).where(
        (F.col("b") == home) & (F.col("nx.ts_us") - F.col("ts_us") <= gap)
        & ~F.col("nx.dns_answer").eqNullSafe(F.col("dns_answer")))
    racing = pairs.groupBy("dns_query").agg(
        F.count(F.lit(1)).alias("conflicts"), F.min("ts_us").alias("first_us"), F.max("nx.ts_us").alias("last_us"))
    racing = staged(racing)
    told = rows.where(present(F.col("dns_answer"))).join(racing.select("dns_query"), "dns_query", "left_semi")
    n = told.groupBy("dns_query").agg(F.countDistinct("dns_answer").alias("answer_count")).where(F.col("answer_count") >= 2)
    out = (racing.join(n, "dns_query").withColumn("severity", F.lit("high")).withColumn("confidence", F.lit("high"))
           .withColumnRenamed("dns_query", "entity"))
    rows = rows.withColumnRenamed("dns_query", "entity").join(out.select("entity"), "entity", "left_semi")
    return found(out, listed("distinct_answers", rows, ["entity"], "dns_answer"), events=rows, keys=["entity"])


@rule("net", "NSM-MITM-005", "Very short DNS lifetimes", "Command & Control", ["T1557", "T1568.001"], reads="dns")
def dns_short_ttl(ev, cfg):
    rows = dns_answers(ev).where(F.col("dns_ttl").between(0, cfg.dns_spoof_ttl_max))
    out = rows.groupBy(F.col("dns_query").alias("entity")).agg(
        F.count(F.lit(1)).alias("responses"), F.min("dns_ttl").alias("min_ttl"), F.max("dns_ttl").alias("max_ttl"), *bounds())
    out = out.where(F.col("responses") >= 3).withColumn("severity", F.lit("medium")).withColumn("confidence", F.lit("low"))
    return found(out, events=rows.withColumnRenamed("dns_query", "entity"), keys=["entity"])


def _clear_http(ev: DataFrame) -> DataFrame:
    return ev.where((F.col("kind") == "http") & (F.col("dst_port").isNull() | F.col("dst_port").isin(80, 8080)))


@rule("net", "NSM-MITM-006", "TLS host served in clear text", "Exploitation", ["T1557", "T1040"], reads="http")
def tls_downgrade(ev, cfg):
    host = F.lower("http_host")
    tls = ev.where(((F.col("kind") == "tls") | (F.col("dst_port") == 443)) & present(F.col("http_host"))).select(
        host.alias("entity")).distinct()
    rows = _clear_http(ev).where(present(F.col("http_host"))).withColumn("entity", host).join(tls, "entity", "left_semi")
    out = rows.groupBy("entity").agg(
        F.count(F.lit(1)).alias("cleartext_requests"), F.countDistinct(F.when(present(F.col("src_ip")), F.col("src_ip"))).alias("client_count"),
        F.min_by("dst_ip", F.struct("ts_us", "event_id")).alias("dst_ip"), *bounds())
    out = out.withColumn("severity", F.lit("critical")).withColumn("confidence", F.lit("high"))
    return found(out, listed("clients", rows, ["entity"], "src_ip"), events=rows, keys=["entity"])


@rule("net", "NSM-MITM-007", "Credentials sent in clear text", "Credential Access", ["T1040", "T1552.001"], reads="http")
def cleartext_creds(ev, cfg):
    extra = F.col("extra")
    blob = F.concat_ws(" ", "http_uri", extra["body"], extra["post_data"], extra["request"])
    rows = _clear_http(ev).where(
        (F.upper("http_method") == "POST") & ~F.coalesce(F.col("action").isin(BLOCKED), F.lit(False))
        & ~present(F.col("signature")) & ~present(F.col("classification"))
        & (~present(F.col("src_ip")) | in_networks(F.col("src_ip"), cfg.home_nets)) & tx.any_hit(blob, CREDENTIAL_TOKENS))
    per = rows.groupBy("src_ip").agg(F.count(F.lit(1)).alias("n"), *bounds())
    out = per.agg(F.sum("n").alias("requests"), F.count_if(present(F.col("src_ip"))).alias("client_count"),
                  F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"))
    out = out.where(F.col("requests") > 0).withColumn("severity", F.lit("critical")).withColumn("confidence", F.lit("high"))
    # One finding for the whole table.
    everything = F.lit("all").alias("scope")
    return found(out.withColumn("scope", everything), listed("clients", per.withColumn("scope", everything), ["scope"], "src_ip"),
                 events=rows.withColumn("scope", everything), keys=["scope"])
