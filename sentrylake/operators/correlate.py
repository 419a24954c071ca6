"""Incident correlation, network summary, indicators and case verdicts over the findings table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sentrylake.functions.net import in_networks, is_address, is_public
from sentrylake.functions.url import defang
from sentrylake.schema import KILL_CHAIN, SEVERITIES, severity_rank, stage_rank
from sentrylake.session import ensure_checkpoint_dir, staged

# Metric names that hold entities, single and as lists.
ENTITY_KEYS = ["assigned_ip", "destination", "domain", "responder", "ip", "mac"]
ENTITY_LISTS = ["targets", "hosts", "internal_hosts", "sources"]


def finding_entities(findings: DataFrame, items: DataFrame) -> DataFrame:
    """(finding_id, entity): addresses, user, entity, the entity-valued metrics, and every value of the lists that
    name hosts, however long they are."""
    m = F.col("metrics")
    own = findings.select("finding_id", F.explode(F.array("src_ip", "dst_ip", "user", "entity", *[m[k] for k in ENTITY_KEYS])).alias("entity"))
    lists = items.where(F.col("kind").isin(ENTITY_LISTS)).select("finding_id", F.col("value").alias("entity"))
    return own.unionByName(lists).where(F.col("entity") != "").distinct()


def components(edges: DataFrame) -> DataFrame:
    """Connected components of (finding_id, entity) rows: every finding gets the smallest finding id
    it can reach. Each round passes minima through the entities (a star, never all pairs) and then
    follows the label of its label, so long chains need few rounds; labels only fall, so it ends. Lineage is cut with a reliable
    checkpoint."""
    ensure_checkpoint_dir(edges.sparkSession)
    edges = edges.checkpoint()
    labels = edges.select("finding_id").distinct().withColumn("label", F.col("finding_id")).checkpoint()
    while True:
        at_entity = edges.join(labels, "finding_id").groupBy("entity").agg(F.min("label").alias("m"))
        near = edges.join(at_entity, "entity").groupBy("finding_id").agg(F.min("m").alias("m"))
        step = labels.join(near, "finding_id").select("finding_id", F.least("label", "m").alias("next"), "label")
        jump = step.select(F.col("finding_id").alias("next"), F.col("next").alias("far"))
        moved = step.join(jump, "next", "left").select("finding_id", F.least("next", F.coalesce("far", "next")).alias("next"), "label").checkpoint()
        changed = moved.where(F.col("next") != F.col("label")).limit(1).count()
        labels = moved.select("finding_id", F.col("next").alias("label"))
        if not changed:
            return labels


def numbered(df: DataFrame, order: list, out: str, start: int = 1) -> DataFrame:
    """Consecutive numbers in a global order: range partitions are numbered on their own and shifted
    by the sizes of the partitions before them. The sorted rows are checkpointed first, because a
    recomputed range partitioning may fall differently."""
    ensure_checkpoint_dir(df.sparkSession)
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = rows.withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id()).checkpoint()
    sizes = rows.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"), F.min("_i").alias("_lo"))
    shift = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    # One row per partition.
    sizes = sizes.withColumn("_s", F.coalesce(F.sum("_n").over(shift), F.lit(0))).select("_p", "_lo", "_s")
    return rows.join(F.broadcast(sizes), "_p").withColumn(out, (F.col("_s") + F.col("_i") - F.col("_lo") + start).cast("bigint")).drop("_p", "_i", "_lo", "_s")


def incidents(findings: DataFrame, items: DataFrame, hubs=()) -> tuple[DataFrame, DataFrame]:
    """(incidents, members). Findings are one incident when chains of shared entities connect them. Shared
    infrastructure (hubs) does not link findings."""
    every = staged(finding_entities(findings, items))
    links = every.where(~F.col("entity").isin(list(hubs))) if hubs else every
    labels = components(links)
    # A finding without any linking entity is an incident of its own.
    member = findings.select("finding_id", "category", "severity_rank", "title", "first_us", "last_us").join(labels, "finding_id", "left").withColumn(
        "label", F.coalesce("label", "finding_id"))
    stage = stage_rank(F.col("category"))
    per = member.groupBy("label").agg(
        F.count(F.lit(1)).alias("finding_count"), F.max("severity_rank").alias("severity_rank"), F.collect_set(F.when(stage < 99, F.col("category"))).alias("stages"),
        F.max_by("title", F.struct("severity_rank", "finding_id")).alias("top_title"), F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"))
    order = F.array(*[F.lit(s) for s in KILL_CHAIN])
    per = per.withColumn("stages", F.filter(order, lambda s: F.array_contains("stages", s)))
    count = labels.join(every, "finding_id").select("label", "entity").distinct().groupBy("label").agg(F.count(F.lit(1)).alias("entity_count"))
    per = per.join(count, "label", "left").withColumn("severity", F.element_at(F.array(*[F.lit(s) for s in SEVERITIES]), F.col("severity_rank") + 1))
    many = F.size("stages") > 1
    per = per.withColumn("title", F.when(many, F.concat(F.get("stages", F.lit(0)), F.lit(" -> "), F.element_at("stages", -1), F.lit(": "), "top_title")).otherwise(F.col("top_title")))
    per = numbered(per, [F.desc("finding_count"), F.asc("label")], "incident_no")
    per = per.withColumn("incident_id", F.format_string("INC-%03d", "incident_no")).drop("top_title")
    members = member.join(per.select("label", "incident_id"), "label").select("incident_id", "finding_id", "category", "first_us")
    return per.orderBy(F.desc(F.size("stages")), F.desc("severity_rank"), F.desc("finding_count"), "incident_no"), members


def net_summary(ev: DataFrame, home_nets) -> dict[str, DataFrame]:
    """The first counts of a triage, each as a small table."""
    has = lambda c: F.col(c).isNotNull() & (F.col(c) != "")
    blocked = F.col("action").isin("block", "drop", "reset")

    def top(rows, key, value=F.count(F.lit(1))):
        return rows.groupBy(*key).agg(value.alias("n")).orderBy(F.desc("n"), *key).limit(10)
    groups = ev.groupingSets([["source_type"], ["action"]], "source_type", "action").agg(F.grouping_id().alias("g"), F.count(F.lit(1)).alias("n"))
    counts = groups.select(F.when(F.col("g") == 1, "source_type").otherwise("action").alias("kind"), F.coalesce("source_type", "action").alias("key"), "n")
    total = ev.agg(F.count(F.lit(1)).alias("event_count"), F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"))
    outside = ev.where(has("src_ip") & ~in_networks(F.col("src_ip"), home_nets)).select(F.col("src_ip").alias("address")).distinct().orderBy("address")
    inside = ev.where(has("dst_ip") & in_networks(F.col("dst_ip"), home_nets)).select(F.col("dst_ip").alias("address")).distinct().orderBy("address")
    return {
        "counts": counts, "total": total, "blocked_sources": top(ev.where(blocked & has("src_ip")), ["src_ip"]),
        "allowed_sources": top(ev.where((F.col("action") == "allow") & has("src_ip")), ["src_ip"]),
        "auth_failure_sources": top(ev.where((F.col("action") == "failure") & has("src_ip")), ["src_ip"]), "signatures": top(ev.where(has("signature")), ["signature"]),
        "upload_pairs": top(ev.where(has("src_ip") & has("dst_ip") & (F.col("bytes_out") > 0)), ["src_ip", "dst_ip"], F.sum("bytes_out")),
        "external_sources": outside, "internal_hosts": inside}


def learned_resolvers(ev: DataFrame, configured) -> DataFrame:
    """Configured resolvers plus whoever gives at least 3 and 30 % of the answers."""
    answers = ev.where(F.col("dns_is_response") & (F.col("src_ip") != "")).groupBy("src_ip").agg(F.count(F.lit(1)).alias("n"))
    total = answers.agg(F.sum("n").alias("t"))
    # One row against one row per responder.
    share = answers.join(F.broadcast(total), F.lit(True)).where((F.col("n") >= 3) & (F.col("n") / F.col("t") >= 0.3)).select("src_ip")
    given = ev.sparkSession.createDataFrame([(c,) for c in configured], "src_ip string")
    return share.union(given).distinct()


def case_verdicts(findings: DataFrame, cases: DataFrame | None = None) -> DataFrame:
    """Worst severity per case with its count. Cases without findings count as clean only when they
    are listed with events."""
    f = findings.withColumn("case_key", F.coalesce("case_key", F.lit("")))
    per = f.groupBy("case_key").agg(F.count(F.lit(1)).alias("findings"), *[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES])
    if cases is not None:
        per = cases.select("case_key", "events").join(per, "case_key", "left").fillna(0, ["findings", *SEVERITIES])
    level = F.lit("clean")
    for s in SEVERITIES:
        level = F.when(F.col(s) > 0, s).otherwise(level)
    worst = F.lit(0).cast("bigint")
    for s in SEVERITIES:
        worst = F.when(F.col(s) > 0, F.col(s)).otherwise(worst)
    out = per.withColumn("level", level).withColumn("worst_count", worst)
    if cases is not None:
        out = out.withColumn("level", F.when((F.col("findings") == 0) & (F.coalesce("events", F.lit(0)) == 0), "error").otherwise(F.col("level")))
    return out


ATTACKER_SRC = ["NSM-SCAN", "NSM-CRED", "NSM-WEB", "NSM-PERIM"]
ATTACKER_DST = ["NSM-C2", "NSM-EXFIL"]


def finding_indicators(findings: DataFrame, items: DataFrame) -> DataFrame:
    """Distinct indicators (type, value) with a block flag: addresses only when public and in the
    attacker role of the rule family."""
    m, rid = F.col("metrics"), F.col("rule_id")
    starts = lambda families: rid.rlike("^(?:" + "|".join(families) + ")")

    def ip(c, attacker, role):
        return F.when(F.coalesce(is_address(c), F.lit(False)), F.struct(F.lit("ip").alias("type"), c.alias("value"), (attacker & is_public(c)).alias("block"), F.lit(role).alias("context")))

    def plain(kind, c, block, when=None):
        ok = (c != "") if when is None else (c != "") & when
        return F.when(ok, F.struct(F.lit(kind).alias("type"), c.alias("value"), F.lit(block).alias("block"), F.lit(kind).alias("context")))
    packet_src = F.when(F.col("kit") == "pkt", F.col("severity_rank") >= 2).otherwise(starts(ATTACKER_SRC))
    packet_dst = F.when(F.col("kit") == "pkt", starts(["TUNNEL", "TLS"])).otherwise(starts(ATTACKER_DST))
    domain = F.when(rid == "NSM-EXFIL-001", F.col("entity")).when((rid == "NSM-EXFIL-003") & ~F.coalesce(is_address(F.col("entity")), F.lit(False)), F.col("entity"))
    every = F.array_compact(F.array(
        ip(F.col("src_ip"), packet_src, "source"), ip(F.col("dst_ip"), packet_dst, "destination"), plain("domain", domain, True), plain("domain", m["sni"], True),
        plain("account", F.col("user"), False)))
    rows = findings.select("rule_id", F.explode(every).alias("x")).select("rule_id", "x.*")
    macs = items.where(F.col("kind") == "suspect_macs").select("rule_id", F.lit("mac").alias("type"), "value", F.lit(False).alias("block"), F.lit("mac").alias("context"))
    rows = rows.unionByName(macs)
    out = rows.groupBy("type", F.lower("value").alias("key")).agg(
        F.max("block").alias("block"), F.min("value").alias("value"), F.min(F.concat_ws(" ", "rule_id", "context")).alias("context"))
    return out.select("type", "value", F.when(F.col("type").isin("account", "mac"), F.col("value")).otherwise(defang(F.col("value"))).alias("defanged"), "block", "context")
