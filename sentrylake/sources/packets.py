"""Exported packet rows, and packets as network events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentrylake.functions import packet as pk
from sentrylake.schema import PACKET_COLUMNS, conform, net_events


def read_packets(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Exported dissections: promoted columns plus either a fields map or dotted columns."""
    df = spark.read.format(fmt).load(path)
    if "fields" not in df.columns:
        dotted = [c for c in df.columns if c not in PACKET_COLUMNS]
        pairs = [x for c in dotted for x in (F.lit(c), F.col(f"`{c}`").cast("string"))]
        df = df.withColumn("fields", F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull()))
    if "event_id" not in df.columns:
        df = df.withColumn("event_id", F.monotonically_increasing_id())
    return conform(df, PACKET_COLUMNS)


def to_events(p: DataFrame) -> DataFrame:
    """Each packet becomes one network event; the first fitting protocol wins."""
    f, n = pk.field, pk.number
    arp = (F.col("proto") == "arp") & f("arp.src.proto_ipv4").isNotNull()
    truth = lambda c: F.coalesce(c, F.lit("0")).isin("", "0", "false", "False") == F.lit(False)
    kind = (F.when(arp, "arp").when(F.col("proto") == "icmp", "icmp").when(f("dns.flags.response").isNotNull(), "dns")
            .when(truth(f("http.request")) | truth(f("http.response")), "http").when(truth(f("ftp.request.command")), "ftp")
            .when((F.col("src_port") == 443) | (F.col("dst_port") == 443) | f("tls.handshake.type").isNotNull(), "tls").otherwise("network_flow"))
    rows = p.where(arp | (~F.coalesce(F.col("proto") == "arp", F.lit(False)) & (F.col("src_ip") != ""))).withColumn("kind", kind)
    k = F.col("kind")
    only = lambda name, c: F.when(k == name, c)
    payload = F.coalesce(n("data.len"), F.lit(0))
    ports = k.isin("arp", "icmp") == F.lit(False)
    answer = F.coalesce(F.nullif(f("dns.a"), F.lit("")), f("dns.answer"))
    extra = (F.when((k == "icmp") & (f("data.data") != ""), F.create_map(F.lit("payload"), f("data.data")))
             .when(k == "http", F.create_map(F.lit("body"), F.coalesce(f("http.file_data"), F.lit("")))).otherwise(F.create_map().cast("map<string,string>")))
    grat = (n("arp.opcode") == 2) & ((f("arp.src.proto_ipv4") == f("arp.dst.proto_ipv4")) | (F.lower("dst_mac") == "ff:ff:ff:ff:ff:ff"))
    return net_events(rows.select(
        "event_id", "ts_us", "kind", F.lit("unknown").alias("action"), F.lit("pcap").alias("source_type"), "src_mac", "dst_mac",
        F.when(k == "arp", f("arp.src.proto_ipv4")).otherwise(F.col("src_ip")).alias("src_ip"), F.when(k == "arp", f("arp.dst.proto_ipv4")).otherwise(F.col("dst_ip")).alias("dst_ip"),
        F.when(ports, F.col("src_port")).alias("src_port"), F.when(ports, F.col("dst_port")).alias("dst_port"),
        F.when(k.isin("arp", "icmp"), k).when(F.col("proto").isin("tcp", "udp"), F.col("proto")).otherwise("ip").alias("protocol"),
        F.when(k.isin("http", "ftp"), payload).when(k == "arp", 0).otherwise(F.col("length")).alias("bytes_out"),
        only("arp", n("arp.opcode")).alias("arp_opcode"), only("arp", f("arp.src.proto_ipv4")).alias("arp_sender_ip"), only("arp", f("arp.src.hw_mac")).alias("arp_sender_mac"),
        only("arp", f("arp.dst.proto_ipv4")).alias("arp_target_ip"), only("arp", F.coalesce(grat, F.lit(False))).alias("arp_is_gratuitous"),
        only("icmp", n("icmp.type")).alias("icmp_type"), only("icmp", payload).alias("icmp_payload_len"),
        only("dns", f("dns.qry.name")).alias("dns_query"), only("dns", f("dns.qry.type.name")).alias("dns_qtype"), only("dns", answer).alias("dns_answer"), only("dns", n("dns.resp.ttl")).alias("dns_ttl"),
        only("dns", f("dns.rcode")).alias("dns_rcode"), only("dns", truth(f("dns.flags.response"))).alias("dns_is_response"),
        only("http", f("http.request.method")).alias("http_method"), only("http", f("http.request.uri")).alias("http_uri"),
        F.when(k == "http", f("http.host")).when(k == "tls", f("tls.handshake.extensions_server_name")).alias("http_host"), only("http", n("http.response.code")).alias("http_status"),
        only("http", f("http.user_agent")).alias("user_agent"), only("ftp", f("ftp.request.command")).alias("ftp_command"), only("ftp", F.nullif(f("ftp.request.arg"), F.lit(""))).alias("ftp_arg"), extra.alias("extra")))
