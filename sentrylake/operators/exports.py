"""Exports as tables of rows or lines; write them with write_lines or the DataFrame writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentrylake.functions.net import is_address
from sentrylake.functions.url import refang
from sentrylake.operators.correlate import numbered
from sentrylake.schema import severity_rank
from sentrylake.session import staged

# Exchange types, and pattern templates per indicator kind.
EXCHANGE_TYPES = {"sender_addresses": "email-src", "reply_to": "email-reply-to", "sender_domains": "domain", "url_domains": "domain", "originating_ips": "ip-src", "urls": "url",
                  "attachment_names": "filename", "attachment_sha256": "sha256", "attachment_md5": "md5", "attachment_sha1": "sha1", "subjects": "email-subject", "message_ids": "email-message-id"}
PATTERNS = {"urls": "[url:value = '%s']", "url_domains": "[domain-name:value = '%s']", "sender_domains": "[domain-name:value = '%s']", "originating_ips": "[ipv4-addr:value = '%s']",
            "attachment_sha256": "[file:hashes.'SHA-256' = '%s']", "attachment_md5": "[file:hashes.MD5 = '%s']", "sender_addresses": "[email-addr:value = '%s']", "reply_to": "[email-addr:value = '%s']"}
BLOCK_GROUPS = {"url_domains": "domain", "sender_domains": "domain", "urls": "url", "originating_ips": "ip", "attachment_sha256": "sha256", "sender_addresses": "email", "reply_to": "email"}
ACL_TARGETS = ["iptables", "cisco_ios", "pf", "netsh"]


def _lookup(table: dict, key: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key]


def indicator_rows(iocs: DataFrame) -> DataFrame:
    """type, exchange type, value; context kinds stay out."""
    rows = iocs.where(~F.col("kind").startswith("context_"))
    return rows.select(F.col("kind").alias("type"), F.coalesce(_lookup(EXCHANGE_TYPES, F.col("kind")), F.lit("text")).alias("external_type"), "value")


def attribute_json(iocs: DataFrame) -> DataFrame:
    """One attribute object per row, values live again."""
    t = _lookup(EXCHANGE_TYPES, F.col("kind"))
    rows = iocs.withColumn("t", t).where(F.col("t").isNotNull())
    return rows.select("kind", F.to_json(F.struct(
        F.col("t").alias("type"), F.when(F.col("kind").contains("attachment"), "Payload delivery").otherwise("Network activity").alias("category"), refang(F.col("value")).alias("value"),
        F.col("t").isin("url", "domain", "sha256", "md5", "sha1", "ip-src").alias("to_ids"))).alias("attribute"))


def event_json(iocs: DataFrame, info: str = "Phishing email") -> DataFrame:
    """case_key and one event object per case, holding its attributes in order; without a column case_key all are one case."""
    own = "case_key" in iocs.columns
    t = _lookup(EXCHANGE_TYPES, F.col("kind"))
    rows = iocs.select(F.col("case_key") if own else F.lit("").alias("case_key"), "kind", "value", t.alias("t")).where(F.col("t").isNotNull()).distinct()
    attribute = F.struct(
        F.col("t").alias("type"), F.when(F.col("kind").contains("attachment"), "Payload delivery").otherwise("Network activity").alias("category"), refang(F.col("value")).alias("value"),
        F.col("t").isin("url", "domain", "sha256", "md5", "sha1", "ip-src").alias("to_ids"), F.col("kind").alias("comment"))
    event = F.struct(F.lit(info).alias("info"), F.lit("2").alias("analysis"), F.lit("2").alias("threat_level_id"), F.array_sort(F.collect_list(attribute)).alias("Attribute"))
    return rows.groupBy("case_key").agg(F.to_json(F.struct(event.alias("Event"))).alias("event"))


def pattern_rows(iocs: DataFrame) -> DataFrame:
    """Indicator patterns with sequential ids."""
    rows = iocs.where(F.col("kind").isin(list(PATTERNS)))
    pattern = F.lit(None).cast("string")
    for k, p in PATTERNS.items():
        a, b = p.split("%s")
        pattern = F.when(F.col("kind") == k, F.concat(F.lit(a), refang(F.col("value")), F.lit(b))).otherwise(pattern)
    # Written first: a range sort reads its input twice, and the indicators would be derived twice.
    out = numbered(staged(rows.select("kind", "value", pattern.alias("pattern"))), [F.asc("kind"), F.asc("value")], "n")
    return out.withColumn("id", F.format_string("indicator--%04d", "n")).withColumn("name", F.concat_ws(": ", "kind", "value"))


def blocklist(iocs: DataFrame) -> DataFrame:
    """Block-worthy values by group, live, distinct."""
    rows = iocs.select(_lookup(BLOCK_GROUPS, F.col("kind")).alias("type"), refang(F.col("value")).alias("value")).where(F.col("type").isNotNull()).distinct()
    # Written first: a range sort reads its input twice, and the indicators would be derived twice.
    return staged(rows).orderBy("type", "value")


def blocklist_from_indicators(indicators: DataFrame) -> DataFrame:
    return indicators.where("block").select("type", "value").distinct().orderBy("type", "value")


def _esc(c: Column) -> Column:
    for ch in ('"', ";", "|"):
        c = F.replace(c, F.lit(ch), F.lit(" " if ch == '"' else ("," if ch == ";" else "/")))
    return c


# Companion rules appended to every export.
COMPANIONS = [
    'alert tcp $EXTERNAL_NET any -> $HOME_NET any (msg:"LOCAL Horizontal scan - many hosts one port"; flags:S; threshold:type threshold, track by_src, count 20, seconds 60; classtype:attempted-recon;',
    'alert tcp $EXTERNAL_NET any -> $HOME_NET any (msg:"LOCAL Vertical scan - many ports one host"; flags:S; detection_filter:track by_src, count 15, seconds 60; classtype:attempted-recon;',
    'alert icmp $HOME_NET any -> $EXTERNAL_NET any (msg:"LOCAL Oversized ICMP payload - possible tunnel"; itype:8; dsize:>100; classtype:policy-violation;',
    'alert tcp $HOME_NET any -> $EXTERNAL_NET 4444 (msg:"LOCAL Egress to default Metasploit port"; flags:S; classtype:trojan-activity; priority:1;',
    'alert tcp $HOME_NET any -> $EXTERNAL_NET 21 (msg:"LOCAL FTP STOR upload to external host"; content:"STOR"; nocase; depth:4; classtype:policy-violation;',
]


# Sensor lines of each finding family, and the note for what a sensor cannot match.
SOURCE_LINE = 'alert ip {src} any -> $HOME_NET any (msg:"LOCAL {title}"; metadata:policy security-ips drop, finding {rule}; classtype:attempted-recon;'
DESTINATION_LINE = ('alert ip $HOME_NET any -> {dst} {port} (msg:"LOCAL C2/Exfil destination contacted - {title}"; metadata:finding {rule}; classtype:trojan-activity; '
                    'priority:{priority};')
DOMAIN_LINE = ('alert udp $HOME_NET any -> any 53 (msg:"LOCAL DNS tunnelling domain {entity}"; content:"{labels}"; nocase; metadata:finding {rule}; '
               'classtype:trojan-activity; priority:1;')
LONG_NAME_LINE = ('alert udp $HOME_NET any -> any 53 (msg:"LOCAL Oversized DNS query name - possible tunnelling"; dsize:>150; '
                  'threshold:type threshold, track by_src, count 20, seconds 60; classtype:policy-violation; priority:2;')
EXPOSED_LINE = ('alert tcp $EXTERNAL_NET any -> {dst} {port} (msg:"LOCAL Inbound to exposed {service}"; flags:S; threshold:type limit, track by_src, count 1, seconds 300; '
                'classtype:attempted-admin; priority:1;')
MITM_NOTE = "# {rule}: {title} -- not a matter for sensor rules; compare ARP replies with the authoritative list of hosts and MACs"


def _line(template: str, **columns: Column) -> Column:
    """A template with its named places filled from columns."""
    parts = []
    for piece in template.replace("}", "{").split("{"):
        parts.append(columns[piece] if len(parts) % 2 else F.lit(piece))
    return F.concat(*parts)


def ids_rules(findings: DataFrame, start_sid: int = 1000001) -> DataFrame:
    """Sensor rule lines per finding family, one per key, numbered from start_sid: sid, rule."""
    rid, m = F.col("rule_id"), F.col("metrics")
    rank = F.col("severity_rank")
    port = F.coalesce(m["port"], m["dst_port"])
    known = {"rule": rid, "title": _esc(F.col("title")), "src": F.col("src_ip"), "dst": F.col("dst_ip"), "entity": _esc(F.col("entity")),
             "priority": F.when(rank >= 3, 1).when(rank == 2, 2).when(rank == 1, 3).otherwise(4).cast("string")}

    def line(key, template, **more):
        return F.struct(key.alias("key"), _line(template, **known, **more).alias("body"))
    any_port = F.coalesce(port, F.lit("any"))
    src = F.when((F.col("src_ip") != "") & rid.rlike("^NSM-(?:SCAN|CRED|WEB)"), F.array(line(F.concat(F.lit("1src:"), "src_ip"), SOURCE_LINE)))
    dst = F.when((F.col("dst_ip") != "") & rid.rlike("^NSM-(?:C2|EXFIL)"), F.array(line(F.concat_ws(":", F.lit("2dst"), "dst_ip", any_port), DESTINATION_LINE, port=any_port)))
    labels = F.transform(F.split(known["entity"], r"\."), lambda x: F.concat(F.lit("|"), F.lpad(F.lower(F.hex(F.length(x))), 2, "0"), F.lit("|"), x))
    dns = F.when(rid == "NSM-EXFIL-001", F.array(line(F.concat(F.lit("3dns:"), "entity", F.lit(":a")), DOMAIN_LINE, labels=F.array_join(labels, "")),
                                                 line(F.concat(F.lit("3dns:"), "entity", F.lit(":b")), LONG_NAME_LINE)))
    perim = F.when((rid == "NSM-PERIM-001") & port.isNotNull(), F.array(line(
        F.concat_ws(":", F.lit("4perim"), "dst_ip", port), EXPOSED_LINE, port=port, service=_esc(F.coalesce(m["service"], F.lit("service"))))))
    none = F.array().cast("array<struct<key:string,body:string>>")
    rows = findings.select(F.explode(F.concat(*[F.coalesce(x, none) for x in (src, dst, dns, perim)])).alias("x")).select("x.*")
    one = rows.groupBy("key").agg(F.min("body").alias("body"))
    tail = one.sparkSession.createDataFrame([(f"9{i}", c) for i, c in enumerate(COMPANIONS)], "key string, body string")
    out = numbered(one.unionByName(tail), [F.asc("key")], "sid", start_sid)
    return out.select("sid", F.concat("body", F.lit(" sid:"), F.col("sid").cast("string"), F.lit("; rev:1;)")).alias("rule"))


def ids_notes(findings: DataFrame) -> DataFrame:
    """Comment lines for findings that no sensor rule can express, one per rule: rule_id, line."""
    rows = findings.where(F.col("rule_id").startswith("NSM-MITM")).select("rule_id", _esc(F.col("title")).alias("title")).distinct()
    return rows.select("rule_id", _line(MITM_NOTE, rule=F.col("rule_id"), title=F.col("title")).alias("line"))


def acl_rules(findings: DataFrame, target: str, floor: str = "medium") -> DataFrame:
    """Deny lines for the attackers of the findings: pos, line. Only src_ip is an attacker address."""
    if target not in ACL_TARGETS:
        raise ValueError(f"unknown target {target!r}; known: {', '.join(ACL_TARGETS)}")
    ips = findings.where((F.col("severity_rank") >= severity_rank(F.lit(floor))) & F.coalesce(is_address(F.col("src_ip")), F.lit(False))).select(F.col("src_ip").alias("ip")).distinct()
    ips = ips.withColumn("v6", F.col("ip").contains(":"))
    if target == "netsh":
        n = numbered(ips, [F.asc("ip")], "n")
        return n.select(F.lit(1).alias("grp"), F.col("n").cast("string").alias("ord"), F.concat(
            F.lit('netsh advfirewall firewall add rule name="block-'), F.col("n").cast("string"), F.lit('" dir=in action=block remoteip='), "ip").alias("line"))
    if target == "pf":
        return ips.select(F.lit(1).alias("grp"), F.col("ip").alias("ord"), F.concat(F.lit("block drop in quick from "), "ip", F.lit(" to any")).alias("line"))
    if target == "iptables":
        tool = F.when(F.col("v6"), "ip6tables").otherwise("iptables")
        lines = F.array(*[F.concat(tool, F.lit(f" -A {chain} -s "), "ip", F.lit(" -j DROP")) for chain in ("INPUT", "FORWARD")])
        return ips.select(F.when(F.col("v6"), 2).otherwise(1).alias("grp"), "ip", F.posexplode(lines).alias("p", "line")).select("grp", F.concat_ws("#", "ip", F.col("p").cast("string")).alias("ord"), "line")
    deny = ips.select(F.when(F.col("v6"), 4).otherwise(2).alias("grp"), F.col("ip").alias("ord"), F.concat(F.when(F.col("v6"), " deny ipv6 host ").otherwise(" deny ip host "), "ip", F.lit(" any")).alias("line"))
    seen = ips.select("v6").distinct()
    frame = [(False, 1, "", "ip access-list extended BLOCK"), (False, 3, "", " permit ip any any"), (True, 3, "z", "ipv6 access-list BLOCK-V6"), (True, 5, "", " permit ipv6 any any"),
             (False, 6, "", "interface <apply-to-interface>"), (False, 7, "", " ip access-group BLOCK in"), (True, 8, "", " ipv6 traffic-filter BLOCK-V6 in")]
    fixed = ips.sparkSession.createDataFrame(frame, "v6 boolean, grp int, ord string, line string").join(seen, "v6", "left_semi")
    return deny.unionByName(fixed.drop("v6"))


def write_lines(lines: DataFrame, path: str, column: str = "line") -> None:
    lines.select(column).write.mode("overwrite").text(path)


def write_findings(findings: DataFrame, path: str, fmt: str = "parquet") -> None:
    findings.write.mode("overwrite").partitionBy("kit").format(fmt).save(path)
