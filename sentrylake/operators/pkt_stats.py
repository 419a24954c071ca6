"""Triage tables over packet rows: hierarchy, endpoints, hosts, conversations, inventories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentrylake.functions import packet as pk
from sentrylake.operators.pkt_rules import ftp_logins
from sentrylake.operators.rulebook import bounds
from sentrylake.session import staged

# Fields the keyword search looks into.
KEYWORD_FIELDS = ["http.request.uri", "http.host", "http.user_agent", "http.file_data", "ftp.request.arg", "ftp.response.arg",
                  "dns.qry.name", "kerberos.realm", "kerberos.CNameString", "nbns.name", "dhcp.option.hostname"]


def filled(name: str):
    return F.coalesce(pk.field(name), F.lit("")).isin("", "0", "false", "False") == F.lit(False)


def protocols(p: DataFrame) -> DataFrame:
    """Packets per protocol; one packet counts in every layer it carries."""
    marks = [(filled("http.request") | filled("http.response"), "tcp.http"), (filled("ftp.request.command") | filled("ftp.response.code"), "tcp.ftp"),
             (pk.field("tls.handshake.type").isNotNull(), "tcp.tls"), (pk.field("dns.qry.name").isNotNull(), "udp.dns"),
             (pk.field("dhcp.option.dhcp").isNotNull(), "udp.dhcp"), (filled("nbns.name"), "udp.nbns"), (filled("kerberos"), "udp.kerberos")]
    layers = F.when(F.col("proto").isNull(), F.array(F.lit("ip (unrecognised transport)"))).otherwise(
        F.array_compact(F.array(F.col("proto"), *[F.when(c, n) for c, n in marks])))
    return p.select(F.explode(layers).alias("protocol")).groupBy("protocol").agg(F.count(F.lit(1)).alias("packets"))


def endpoints(p: DataFrame) -> DataFrame:
    both = p.select(F.explode(F.array("src_ip", "dst_ip")).alias("address"), "length").where(F.col("address") != "")
    return both.groupBy("address").agg(F.count(F.lit(1)).alias("packets"), F.sum("length").alias("bytes"))


def largest(df: DataFrame, by: str, n: int, tie: str) -> DataFrame:
    return df.orderBy(F.desc(by), tie).limit(n)


def _counter(df: DataFrame, kind: str, value, top: int | None = None) -> DataFrame:
    out = df.where(value.isNotNull() & (value != "")).groupBy(value.alias("key")).agg(F.count(F.lit(1)).alias("n"))
    if top:
        out = largest(out, "n", top, "key")
    return out.select(F.lit(kind).alias("kind"), "key", "n")


def dns_stats(p: DataFrame) -> DataFrame:
    rows = p.where(pk.field("dns.qry.name").isNotNull())
    resp = filled("dns.flags.response")
    asked = rows.where(~resp)
    total = rows.agg(F.count_if(~resp).alias("queries"), F.count_if(resp).alias("responses"),
                     F.count_if(resp & (pk.number("dns.rcode") == 3)).alias("nxdomain"))
    names = asked.select(pk.field("dns.qry.name").alias("q")).distinct().agg(F.count(F.lit(1)).alias("n"))
    totals = total.select(F.lit("total").alias("kind"), F.expr("stack(3, 'queries', queries, 'responses', responses, 'nxdomain', nxdomain) AS (key, n)"))
    return (totals.unionByName(names.select(F.lit("total").alias("kind"), F.lit("unique_query_names").alias("key"), "n"))
            .unionByName(_counter(asked, "name", pk.field("dns.qry.name"), 10))
            .unionByName(_counter(rows, "qtype", F.coalesce(pk.field("dns.qry.type.name"), F.lit("?")))))


def http_stats(p: DataFrame) -> DataFrame:
    req, resp = p.where(filled("http.request")), p.where(filled("http.response"))
    totals = p.agg(F.count_if(filled("http.request")).alias("requests"), F.count_if(filled("http.response")).alias("responses")).select(
        F.lit("total").alias("kind"), F.expr("stack(2, 'requests', requests, 'responses', responses) AS (key, n)"))
    return (totals.unionByName(_counter(req, "method", pk.field("http.request.method")))
            .unionByName(_counter(resp, "status", pk.field("http.response.code")))
            .unionByName(_counter(req, "host", pk.field("http.host"), 10))
            .unionByName(_counter(req, "user_agent", pk.field("http.user_agent"), 10)))


def capture_summary(p: DataFrame) -> DataFrame:
    return p.agg(F.count(F.lit(1)).alias("packet_count"), F.coalesce(F.sum("length"), F.lit(0)).alias("total_bytes"),
                 F.round((F.max("ts_us") - F.min("ts_us")) / 1e6, 3).alias("duration_seconds"))


def conversations(p: DataFrame) -> DataFrame:
    rows = p.where(F.col("proto").isin("tcp", "udp") & (F.col("src_ip") != "") & (F.col("dst_ip") != ""))
    a = F.struct(F.col("src_ip").alias("addr"), F.col("src_port").alias("port"))
    b = F.struct(F.col("dst_ip").alias("addr"), F.col("dst_port").alias("port"))
    return rows.groupBy("proto", F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).agg(
        F.count(F.lit(1)).alias("packets"), F.sum("length").alias("bytes"), *bounds()).select(
        "proto", F.col("a.addr").alias("a_addr"), F.col("a.port").alias("a_port"), F.col("b.addr").alias("b_addr"),
        F.col("b.port").alias("b_port"), "packets", "bytes", "first_us", "last_us")


def resolved(p: DataFrame) -> DataFrame:
    """Address to names, every A record of an answer."""
    rows = p.where((pk.field("dns.qry.name") != "") & (pk.number("dns.qry.type") == 1))
    every = F.split(F.coalesce(F.nullif(pk.field("dns.a_all"), F.lit("")), pk.field("dns.a")), r"\s*,\s*")
    pairs = rows.select(F.explode(every).alias("address"), pk.field("dns.qry.name").alias("name")).where(F.col("address") != "").distinct()
    return pairs.groupBy("address").agg(F.array_sort(F.collect_list("name")).alias("names"))


def _leases(p: DataFrame):
    mac = pk.field("dhcp.hw.mac_addr")
    rows = p.where(mac != "")
    leased = rows.where((pk.number("dhcp.option.dhcp") == 5) & (pk.field("dhcp.yiaddr") != "")).groupBy(mac.alias("mac")).agg(
        F.max_by(pk.field("dhcp.yiaddr"), "event_id").alias("leased"))
    return rows, leased


def host_facts(p: DataFrame) -> DataFrame:
    """What packets say of hosts, from one pass: key, kind, value, n, bytes, first_us, last_us, last_event and syn.

    The key is an address, with kinds sent, recv, seen, owner, syn, mac, name and port, or a hardware address,
    with kinds lease and claim. Each packet gives a row for each fact; facts are counted before they are shuffled, so a
    host with most of the traffic is a few rows a task, and one with very many names is only many rows."""
    src, dst, arp_ip, owner = F.col("src_ip"), F.col("dst_ip"), pk.field("arp.src.proto_ipv4"), pk.nbns_owner()
    arp = F.coalesce(F.col("proto") == "arp", F.lit(False))
    plain = ~arp & (src != "")
    arp = arp & (arp_ip != "")
    to = plain & (dst != "")
    syn = plain & (F.col("proto") == "tcp") & (pk.number("tcp.flags.syn") == 1)
    ttl, mac = F.coalesce(pk.number("ip.ttl"), pk.number("ipv6.hlim")), pk.field("dhcp.hw.mac_addr")
    none, zero = F.lit(None).cast("string"), F.lit(0).cast("bigint")

    def fact(when, key, kind, value=none, size=zero, timed=False, said=False):
        ok = when if not said else when & (value != "") & key.isNotNull()
        stamp = F.col("ts_us") if timed else F.lit(None).cast("bigint")
        first = kind == "syn"
        return F.when(ok, F.struct(key.alias("key"), F.lit(kind).alias("kind"), value.alias("value"), size.cast("bigint").alias("bytes"), stamp.alias("ts_us"),
                                   (ttl if first else F.lit(None)).cast("int").alias("ttl"), (pk.number("tcp.window_size") if first else F.lit(None)).cast("int").alias("win")))
    every = [
        fact(plain, src, "sent", size=F.col("length"), timed=True), fact(to, dst, "recv", size=F.col("length"), timed=True), fact(arp, arp_ip, "seen", timed=True),
        fact(owner.isNotNull(), owner, "owner"), fact(syn & (pk.number("tcp.flags.ack") == 0) & ttl.isNotNull(), src, "syn"),
        fact(arp, arp_ip, "mac", pk.field("arp.src.hw_mac"), said=True), fact(plain & pk.unicast_mac(F.col("src_mac")), src, "mac", F.col("src_mac"), said=True),
        fact(to & pk.unicast_mac(F.col("dst_mac")), dst, "mac", F.col("dst_mac"), said=True),
        fact(plain, src, "name", pk.field("dhcp.option.hostname"), said=True), fact(plain & owner.isNotNull(), owner, "name", pk.field("nbns.name"), said=True),
        fact(to, dst, "name", pk.field("http.host"), said=True), fact(plain, src, "name", F.regexp_replace(pk.field("kerberos.hostname"), r"\$+$", ""), said=True),
        fact(syn & (pk.number("tcp.flags.ack") == 1), src, "port", F.lpad(F.col("src_port").cast("string"), 5, "0"), said=True),
        fact((mac != "") & (pk.number("dhcp.option.dhcp") == 5), mac, "lease", pk.field("dhcp.yiaddr"), said=True), fact(mac != "", mac, "claim", pk.field("dhcp.option.hostname"), said=True)]
    flat = p.select("event_id", F.explode(F.array_compact(F.array(*every))).alias("f")).select("event_id", "f.*")
    return flat.groupBy("key", "kind", "value").agg(
        F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"), F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"), F.max("event_id").alias("last_event"),
        F.min(F.when(F.col("kind") == "syn", F.struct("event_id", "ttl", "win"))).alias("syn"))


def hosts(p: DataFrame) -> DataFrame:
    """One row per address: MACs, names, ports answering SYN, system guess, traffic both ways."""
    facts = staged(host_facts(p))

    def latest(kind, out):
        return facts.where(F.col("kind") == kind).groupBy("key").agg(F.max_by("value", "last_event").alias(out))
    # A name that a client gave belongs to the address that it was leased.
    named = latest("claim", "name").join(latest("lease", "leased"), "key")
    given = F.array(F.struct(F.lit("owner").alias("kind"), F.lit(None).cast("string").alias("value")), F.struct(F.lit("mac").alias("kind"), F.col("key").alias("value")),
                    F.struct(F.lit("name").alias("kind"), F.col("name").alias("value")))
    more = named.select(F.col("leased").alias("key"), F.explode(given).alias("x")).select("key", "x.*")
    rows = facts.where(~F.col("kind").isin("lease", "claim")).unionByName(more, allowMissingColumns=True)

    def total(kind, what):
        return F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col(what))), F.lit(0))

    def values(kind):
        return F.when(F.max(F.col("kind").isin("mac", "name", "port")), F.array_sort(F.collect_set(F.when(F.col("kind") == kind, F.col("value")))))
    out = rows.groupBy(F.col("key").alias("ip")).agg(
        total("sent", "n").alias("packets_sent"), total("sent", "bytes").alias("bytes_sent"), total("recv", "n").alias("packets_recv"), total("recv", "bytes").alias("bytes_recv"),
        F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"), F.min("syn").alias("syn"),
        values("mac").alias("macs"), values("name").alias("hostnames"), F.transform(values("port"), lambda x: x.cast("int")).alias("open_ports"))
    hint = pk.window_hint(F.col("syn.win"))
    return out.withColumn("os_guess", F.when(F.col("syn").isNotNull(), F.concat(pk.ttl_bucket(F.col("syn.ttl")), F.coalesce(
        F.concat(F.lit(" -- consistent with "), hint), F.lit(""))))).withColumn(
        "os_confidence", F.when(F.col("syn").isNotNull(), F.when(hint.isNotNull(), "medium").otherwise("low"))).drop("syn")


def top_hosts(found: DataFrame, n: int = 25) -> DataFrame:
    """The hosts with most traffic, sent and received: a report's ranking of the whole table."""
    return largest(found.withColumn("bytes", F.col("bytes_sent") + F.col("bytes_recv")), "bytes", n, "ip")


def top_conversations(found: DataFrame, n: int = 15) -> DataFrame:
    """The conversations with most bytes, the longer first if equal."""
    ordered = found.withColumn("duration_us", F.col("last_us") - F.col("first_us"))
    return ordered.orderBy(F.desc("bytes"), F.desc("duration_us"), "proto", "a_addr", "a_port", "b_addr", "b_port").limit(n)


def identity(p: DataFrame) -> DataFrame:
    """Names learned from DHCP, NBNS and Kerberos: (kind, key, name)."""
    rows, leased = _leases(p)
    mac = F.nullif(pk.field("dhcp.hw.mac_addr"), F.lit(""))
    dhcp = p.where(pk.field("dhcp.option.hostname") != "").withColumn("mac", mac).join(leased, "mac", "left").select(
        F.lit("dhcp").alias("kind"), F.coalesce(F.when(F.col("src_ip") != "0.0.0.0", F.col("src_ip")), "leased", F.nullif(pk.field("dhcp.option.requested_ip_address"), F.lit("")),
                                                F.concat(F.lit("(MAC "), "mac", F.lit(")")), F.lit("0.0.0.0")).alias("key"),
        pk.field("dhcp.option.hostname").alias("name"))
    nbns = p.select(F.lit("nbns").alias("kind"), pk.nbns_owner().alias("key"), pk.field("nbns.name").alias("name")).where(F.col("key").isNotNull())
    parts = p.select(F.explode(F.split(pk.field("kerberos.CNameString"), "/")).alias("x")).where(F.col("x") != "")
    krb = parts.select(F.when(F.col("x").endswith("$"), "kerberos_host").otherwise("kerberos_user").alias("kind"), F.lit(None).cast("string").alias("key"),
                       F.regexp_replace("x", r"\$+$", "").alias("name"))
    named = p.where(pk.field("kerberos.hostname") != "").select(F.lit("kerberos_host").alias("kind"), F.lit(None).cast("string").alias("key"),
                                                                F.regexp_replace(pk.field("kerberos.hostname"), r"\$+$", "").alias("name"))
    return dhcp.unionByName(nbns).unionByName(krb).unionByName(named).distinct()


def mask(secret):
    """First character, then stars."""
    return F.when(F.length(secret) <= 2, F.repeat(F.lit("*"), F.length(secret))).otherwise(
        F.concat(F.substring(secret, 1, 1), F.repeat(F.lit("*"), F.length(secret) - 1)))


def credentials(p: DataFrame) -> DataFrame:
    """Logins seen in clear text: FTP pairs, HTTP Basic, form posts."""
    ftp = ftp_logins(p).select(F.lit("ftp").alias("protocol"), "frame_number", "src_ip", "dst_ip", F.col("login").alias("username"), F.col("arg").alias("secret"))
    auth = pk.field("http.authorization")
    blob = F.try_to_binary(F.regexp_extract(auth, r"(?i)^basic\s+(\S+)", 1), F.lit("base64"))
    text = F.try_validate_utf8(blob.cast("string"))
    basic = p.where(F.lower(auth).startswith("basic ")).withColumn("t", text).where(F.col("t").isNotNull()).select(
        F.lit("http-basic").alias("protocol"), "frame_number", "src_ip", "dst_ip", F.split_part("t", F.lit(":"), F.lit(1)).alias("username"),
        F.when(F.col("t").contains(":"), F.regexp_replace("t", "^[^:]*:", "")).otherwise("").alias("secret"))
    body = pk.field("http.file_data")
    pairs = F.transform(F.filter(F.split(body, "&"), lambda x: x.contains("=")), lambda x: F.struct(
        F.lower(F.trim(F.split_part(x, F.lit("="), F.lit(1)))).alias("k"), F.trim(F.regexp_replace(x, "^[^=]*=", "")).alias("v")))

    def first(names):
        return F.get(F.filter("pairs", lambda s: s["k"].isin(names)), F.lit(0))["v"]
    form = p.where(body.rlike("password=|passwd=|pwd=")).withColumn("pairs", pairs).select(
        F.lit("http-form").alias("protocol"), "frame_number", "src_ip", "dst_ip", first(["username", "user", "email", "login"]).alias("username"),
        first(["password", "passwd", "pwd"]).alias("secret")).where(F.coalesce("secret", F.lit("")) != "")
    return ftp.unionByName(basic).unionByName(form).withColumn("masked", mask(F.col("secret")))


def files(p: DataFrame) -> DataFrame:
    """Files announced by response headers."""
    cd, ct = F.coalesce(pk.field("http.content_disposition"), F.lit("")), F.coalesce(pk.field("http.content_type"), F.lit(""))
    name = F.when(cd.contains("filename="), F.regexp_replace(F.trim(F.regexp_replace(cd, "^.*?filename=", "")), r"^\x22+|\x22+$", "")).when(
        ct.contains("/") & ~ct.isin("text/html", "text/plain"), F.concat(F.lit("(unnamed)."), F.regexp_extract(ct, "([^/]*)$", 1)))
    return p.where(filled("http.response")).select(
        "frame_number", name.alias("filename"), ct.alias("content_type"), F.col("dst_ip").alias("src_ip"), F.col("src_ip").alias("dst_ip")).where(F.col("filename") != "")


def tls_hellos(p: DataFrame) -> DataFrame:
    t = pk.number("tls.handshake.type")
    return p.where(t.isNotNull()).select(
        "frame_number", F.when(t == 1, "ClientHello").when(t == 2, "ServerHello").otherwise(F.concat(F.lit("type "), t.cast("string"))).alias("type"),
        "src_ip", "dst_ip", "dst_port", pk.field("tls.handshake.extensions_server_name").alias("sni"))


def sni_counts(p: DataFrame, n: int = 30) -> DataFrame:
    return largest(tls_hellos(p).where(F.col("sni") != "").groupBy("sni").agg(F.count(F.lit(1)).alias("n")), "n", n, "sni")


def keyword_hits(p: DataFrame, keywords: list[str]) -> DataFrame:
    """One row per packet, field and keyword."""
    texts = F.array_compact(F.array(*[F.when(pk.field(f) != "", F.struct(F.lit(f).alias("field"), pk.field(f).alias("value"))) for f in KEYWORD_FIELDS]))
    flat = p.select("frame_number", "src_ip", "dst_ip", F.explode(texts).alias("t")).select("frame_number", "src_ip", "dst_ip", "t.*")
    found = F.filter(F.array(*[F.lit(k) for k in keywords]), lambda k: F.contains(F.lower("value"), F.lower(k)))
    return flat.select("frame_number", "src_ip", "dst_ip", "field", F.explode(found).alias("keyword"), F.col("value").alias("context"))
