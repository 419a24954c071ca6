"""One call per evidence type: what the command line of a triage tool would do, as DataFrames."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentrylake.config import NetConfig, PacketConfig, WinConfig
from sentrylake.functions import url as ul
from sentrylake.functions.win import features
from sentrylake.operators import correlate as co
from sentrylake.operators import mail_rules as mr
from sentrylake.operators import net_access, net_channels, pkt_rules, pkt_stats, win_rules  # noqa: F401 - registers rules
from sentrylake.operators.routes import dealt
from sentrylake.operators.rulebook import Results, chosen, evidence, run_all, severity_floor
from sentrylake.session import staged
from sentrylake.sources.packets import to_events

# Flow rules that also run on captures.
CAPTURE_RULES = ["scan_ping_sweep", "exfil_dns", "exfil_direct_dns", "exfil_http", "exfil_volume", "exfil_icmp", "exfil_ftp", "arp_conflict", "arp_burst",
                 "dns_rogue", "dns_race", "dns_short_ttl", "tls_downgrade", "cleartext_creds"]


def network(events: DataFrame, cfg: NetConfig | None = None, only=None, with_incidents: bool = True) -> dict[str, DataFrame]:
    """findings from cfg.min_severity on, their items and first lines, pivots and their items, summary tables and, unless
    switched off, incidents and their members. All rules together scan the events once."""
    cfg = cfg or NetConfig()
    found = network_rules(events, cfg, only)
    kept, items = found.findings, found.items
    if cfg.min_severity != "info":
        kept = severity_floor(kept, cfg.min_severity)
        items = items.join(kept.select("finding_id"), "finding_id", "left_semi")
    out = {"findings": kept, "items": items, "evidence": evidence(items, events, cfg.max_evidence_lines)}
    out["pivots"], out["pivot_items"] = net_access.vpn_pivots(events, cfg)
    out.update({f"summary_{k}": v for k, v in co.net_summary(events, cfg.home_nets).items()})
    if with_incidents:
        out["incidents"], out["members"] = co.incidents(kept, items, [*cfg.known_resolvers, *cfg.gateway_ips])
    return out


def network_rules(events: DataFrame, cfg: NetConfig, only=None, items: bool = True) -> Results:
    """The network rules over routes that one scan of the events deals out. Who needs no items saves the disk of the routes."""
    return run_all("net", dealt(events, cfg, {r.reads for r in chosen("net", only)}), cfg, only, items=items)


def joined(*results: Results) -> Results:
    """Findings and items of several runs as one."""
    def united(parts):
        first, *more = parts
        for p in more:
            first = first.unionByName(p)
        return first
    failed, raised = ([x for r in results for x in getattr(r, name)] for name in ("failed", "raised"))

    def items():
        made = united([r.items for r in results])
        # Some rules may have failed only now.
        failed[:], raised[:] = ([x for r in results for x in getattr(r, name)] for name in ("failed", "raised"))
        return made
    return Results(united([r.findings for r in results]), items, failed, raised)


def windows(events: DataFrame, cfg: WinConfig | None = None, only=None) -> dict[str, DataFrame]:
    # Parsed once, as all rules read the same columns.
    ev = staged(features(events))
    cfg = cfg or WinConfig()
    found = run_all("win", ev, cfg, only)
    cases = co.case_verdicts(found.findings, ev.groupBy("case_key").agg(F.count(F.lit(1)).alias("events")))
    return {"findings": found.findings, "items": found.items, "overview": win_rules.overview(ev), "timeline": win_rules.timeline(found.findings, found.items), "cases": cases,
            "evidence": evidence(found.items, ev, cfg.max_evidence_events)}


def capture(packets: DataFrame, cfg: PacketConfig | None = None, net: NetConfig | None = None) -> dict[str, DataFrame]:
    """Packet rules plus the flow rules on the same capture; POST sizes count per packet there, and
    beacons are looked for on connection attempts only."""
    net = replace(net or NetConfig(), http_post_large_bytes=64 * 1024)
    ev = to_events(packets)
    starts = packets.where((F.expr("try_cast(fields['tcp.flags.syn'] AS INT)") == 1) & (F.expr("try_cast(fields['tcp.flags.ack'] AS INT)") == 0))
    # A responder needs 30 % of all answers, so at most three are learned.
    learned = [r.src_ip for r in co.learned_resolvers(ev, net.known_resolvers).collect()]
    net = replace(net, known_resolvers=learned)
    found = joined(run_all("pkt", packets, cfg or PacketConfig()), network_rules(ev, net, CAPTURE_RULES), network_rules(to_events(starts), net, ["c2_beacon"]))
    return {"findings": found.findings, "items": found.items, "hosts": pkt_stats.hosts(packets), "conversations": pkt_stats.conversations(packets), "protocols": pkt_stats.protocols(packets),
            "endpoints": pkt_stats.endpoints(packets), "dns": pkt_stats.dns_stats(packets), "http": pkt_stats.http_stats(packets), "credentials": pkt_stats.credentials(packets),
            "files": pkt_stats.files(packets), "identity": pkt_stats.identity(packets), "tls": pkt_stats.tls_hellos(packets), "resolved": pkt_stats.resolved(packets)}


def mail(messages: DataFrame, attachments: DataFrame) -> dict[str, DataFrame]:
    embedded = attachments.groupBy("message_id").agg(F.flatten(F.collect_list("embedded_urls")).alias("embedded_urls"))
    urls = staged(ul.extract(messages.select("message_id", "body_text", "body_html").join(embedded, "message_id", "left")))
    flagged = ul.analyse(urls)
    whole = mr.assemble(messages, flagged, attachments)
    verdict = mr.verdicts(whole)
    return {"findings": mr.run(whole).findings, "verdicts": verdict, "urls": flagged, "attachments": mr.attachment_flags(attachments), "hops": mr.received_hops(messages),
            "indicators": mr.indicators(messages, urls, attachments, verdict)}


def with_reputation(indicators: DataFrame, reputation: DataFrame) -> DataFrame:
    """Join a caller-supplied reputation table (type, value, status, detail): data, error or skipped."""
    r = reputation.select("type", F.lower("value").alias("key"), "status", "detail")
    return indicators.withColumn("key", F.lower("value")).join(r, ["type", "key"], "left").withColumn("status", F.coalesce("status", F.lit("skipped"))).drop("key")
