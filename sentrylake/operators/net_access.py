"""Scan, credential and lateral-movement rules over network events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sentrylake.functions.net import (HIGH_RISK_PORTS, LATERAL_PORTS, in_networks, present,
                                      service_name)
from sentrylake.functions.text import any_hit
from sentrylake.operators.rulebook import band, bounds, found, listed, points, rule
from sentrylake.session import staged
from sentrylake.operators.windows import (SECOND, bucket_of, densest_run, distinct_run_rows,
                                          run_rows, written_distinct_run)

BLOCKED = ["block", "drop", "reset"]


def flows(ev: DataFrame) -> DataFrame:
    return ev.where(F.col("kind").isin("network_flow", "ids_alert") & present(F.col("src_ip")) & present(F.col("dst_ip")))


def auth(ev: DataFrame) -> DataFrame:
    return ev.where((F.col("kind") == "auth") & F.col("ts_us").isNotNull())


def not_listed(ev: DataFrame, column: str, values) -> DataFrame:
    """Allowlist exclusion; lists come from the site profile and are short."""
    return ev.where(~F.col(column).isin(list(values))) if values else ev


def _scan(ev, cfg, keys, value, window_s, internal_min, external_min, list_name, count_name):
    """The findings, their values, and the events of the window that has most of them."""
    rows = flows(ev).where(F.col("dst_port").isNotNull())
    rows = not_listed(rows, "src_ip", cfg.scanner_allowlist + cfg.external_scanner_allowlist)
    rows = rows.select("event_id", "ts_us", "src_ip", "dst_ip", "dst_port", "action")
    window = window_s * SECOND
    inside = in_networks(F.col("src_ip"), cfg.home_nets)
    best = written_distinct_run(rows, keys, value, window, min(internal_min, external_min))
    best = staged(best.where(F.col("run_k") >= F.when(inside, internal_min).otherwise(external_min)))
    hit = distinct_run_rows(rows, best, keys, value, window)
    per = staged(hit.groupBy(*keys, value).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("action").isin(BLOCKED)).alias("b"), *bounds()))
    out = per.groupBy(*keys).agg(
        F.count(F.lit(1)).alias(count_name), F.sum("n").alias("attempts"), F.sum("b").alias("blocked"),
        F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"))
    ratio = F.col("blocked") / F.col("attempts")
    out = (out.withColumn("block_ratio", F.round(ratio, 3))
           .withColumn("internal_source", inside)
           .withColumn("confidence", F.when(ratio >= cfg.scan_block_ratio, "high").otherwise("medium"))
           .withColumn("category", F.when(F.col("internal_source"), "Discovery").otherwise("Reconnaissance"))
           .withColumn("mitre", F.when(F.col("internal_source"), F.array(F.lit("T1046"))).otherwise(
               F.array(F.lit("T1046"), F.lit("T1595.001")))))
    return out, listed(list_name, per, keys, value), hit


@rule("net", "NSM-SCAN-001", "Many ports probed on one host", "Reconnaissance", ["T1046"], reads="flow")
def scan_vertical(ev, cfg):
    keys = ["src_ip", "dst_ip"]
    out, ports, hit = _scan(ev, cfg, keys, "dst_port", cfg.vertical_scan_window_s,
                            cfg.internal_scan_min_ports, cfg.vertical_scan_min_ports, "ports", "distinct_ports")
    outside = F.when(F.col("confidence") == "high", "medium").otherwise("low")
    return found(out.withColumn("severity", F.when(F.col("internal_source"), "high").otherwise(outside)), ports, events=hit, keys=keys)


@rule("net", "NSM-SCAN-002", "One port probed on many hosts", "Reconnaissance", ["T1046"], reads="flow")
def scan_horizontal(ev, cfg):
    keys = ["src_ip", "dst_port"]
    out, hosts, hit = _scan(ev, cfg, keys, "dst_ip", cfg.horizontal_scan_window_s,
                            cfg.internal_scan_min_hosts, cfg.horizontal_scan_min_hosts, "hosts", "distinct_hosts")
    out = (out.withColumn("severity", F.when(F.col("internal_source"), "high").otherwise("medium"))
           .withColumn("service", service_name(F.col("dst_port")))
           .withColumn("entity", F.concat_ws("/", F.col("dst_port").cast("string"), "service")))
    return found(out, hosts, events=hit, keys=keys)


@rule("net", "NSM-SCAN-003", "ICMP echo sweep", "Reconnaissance", ["T1018"], reads="icmp")
def scan_ping_sweep(ev, cfg):
    icmp = ev.where(((F.col("protocol") == "icmp") | (F.col("kind") == "icmp"))
                    & present(F.col("src_ip")) & present(F.col("dst_ip"))
                    & (F.col("icmp_type").isNull() | (F.col("icmp_type") == 8)))
    icmp = not_listed(icmp, "src_ip", cfg.scanner_allowlist)
    per = icmp.groupBy("src_ip", "dst_ip").agg(F.count(F.lit(1)).alias("n"), *bounds())
    out = per.groupBy("src_ip").agg(
        F.count(F.lit(1)).alias("distinct_hosts"), F.sum("n").alias("packets"),
        F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"))
    out = out.where(F.col("distinct_hosts") >= cfg.ping_sweep_min_hosts)
    inside = in_networks(F.col("src_ip"), cfg.home_nets)
    out = (out.withColumn("internal_source", inside)
           .withColumn("severity", F.when(F.col("internal_source"), "high").otherwise("low"))
           .withColumn("category", F.when(F.col("internal_source"), "Discovery").otherwise("Reconnaissance")))
    return found(out, listed("hosts", per, ["src_ip"], "dst_ip"), events=icmp, keys=["src_ip"])


@rule("net", "NSM-PERIM-001", "Management port open to the internet", "Initial Access", ["T1133", "T1190"], reads="flow")
def exposed_service(ev, cfg):
    rows = flows(ev).where(
        (F.col("action") == "allow") & F.col("dst_port").isin(HIGH_RISK_PORTS)
        & ~in_networks(F.col("src_ip"), cfg.home_nets) & in_networks(F.col("dst_ip"), cfg.home_nets))
    per = rows.groupBy("dst_ip", "dst_port", "src_ip").agg(F.count(F.lit(1)).alias("n"), *bounds())
    out = per.groupBy("dst_ip", "dst_port").agg(
        F.sum("n").alias("allowed_connections"), F.count(F.lit(1)).alias("distinct_sources"),
        F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"))
    out = (out.withColumn("service", service_name(F.col("dst_port")))
           .withColumn("entity", F.concat_ws(":", "dst_ip", F.col("dst_port").cast("string")))
           .withColumn("severity", F.lit("high")).withColumn("confidence", F.lit("high")))
    keys = ["dst_ip", "dst_port"]
    return found(out, listed("sources", per, keys, "src_ip"), events=rows, keys=keys)


@rule("net", "NSM-CRED-001", "Password guessing from one source", "Credential Access", ["T1110.001"], reads="auth")
def cred_bruteforce(ev, cfg):
    fails = auth(ev).where((F.col("action") == "failure") & present(F.col("src_ip"))).select("event_id", "src_ip", "user", "ts_us")
    window = cfg.bruteforce_window_s * SECOND
    best = densest_run(fails, ["src_ip"], window, cfg.bruteforce_min_failures)
    hit = run_rows(fails, best, ["src_ip"], window)
    per = hit.groupBy("src_ip", "user").agg(F.count(F.lit(1)).alias("n"), *bounds())
    out = per.groupBy("src_ip").agg(
        F.sum("n").alias("failures"), F.count_if(present(F.col("user"))).alias("distinct_users"),
        F.min(F.when(present(F.col("user")), F.col("user"))).alias("first_user"),
        F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"))
    span = (F.col("last_us") - F.col("first_us")) / SECOND
    span = F.when(span == 0, 1.0).otherwise(span)
    out = (out.withColumn("window_seconds", F.round(span).cast("bigint"))
           .withColumn("attempts_per_min", F.round(F.col("failures") / span * 60, 2))
           .withColumn("external_source", ~in_networks(F.col("src_ip"), cfg.home_nets))
           .withColumn("user", F.when(F.col("distinct_users") == 1, F.col("first_user"))).drop("first_user")
           .withColumn("severity", F.lit("high"))
           .withColumn("confidence", F.when(F.col("distinct_users") <= 2, "high").otherwise("medium")))
    return found(out, listed("users", per, ["src_ip"], "user"), events=hit, keys=["src_ip"])


@rule("net", "NSM-CRED-002", "Few guesses against many accounts", "Credential Access", ["T1110.003"], reads="auth")
def cred_spray(ev, cfg):
    fails = auth(ev).where((F.col("action") == "failure") & present(F.col("src_ip")) & present(F.col("user")))
    fails = fails.select("event_id", "src_ip", "user", "ts_us")
    window = cfg.spray_window_s * SECOND
    best = written_distinct_run(fails, ["src_ip"], "user", window, cfg.spray_min_users)
    hit = distinct_run_rows(fails, best, ["src_ip"], "user", window)
    per = staged(hit.groupBy("src_ip", "user").agg(F.count(F.lit(1)).alias("n"), *bounds()))
    out = per.groupBy("src_ip").agg(
        F.count(F.lit(1)).alias("distinct_users"), F.sum("n").alias("total_attempts"),
        F.max("n").alias("max_per_user"), F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"))
    out = out.where(F.col("max_per_user") <= cfg.spray_max_attempts_per_user)
    out = out.withColumn("severity", F.lit("high")).withColumn("confidence", F.lit("high"))
    return found(out, listed("users", per, ["src_ip"], "user"), events=hit, keys=["src_ip"])


def _service_account(user, cfg):
    named = user.isin(list(cfg.service_accounts)) if cfg.service_accounts else F.lit(False)
    return F.coalesce(F.lower(user).startswith("svc") | named, F.lit(False))


def preceding_counts(marks: DataFrame, probes: DataFrame, keys: list[str], window_us: int) -> DataFrame:
    """For each probe: number of marks of the same key at most window_us earlier and ahead of
    it in (ts, id) order. Marks are carried into the next time bucket, so a key is spread over
    its buckets and no mark/probe pair is ever formed."""
    wide = window_us + 1
    b = bucket_of(F.col("ts_us"), wide)
    low = F.lit(-1).cast("bigint")
    entries = F.array(
        F.struct(b.alias("b"), F.col("ts_us").alias("p"), F.col("event_id").alias("o"), F.lit(1).alias("d")),
        F.struct((b + 1).alias("b"), ((b + 1) * wide - 1).alias("p"), low.alias("o"), F.lit(1).alias("d")),
        F.struct((b + 1).alias("b"), (F.col("ts_us") + wide).alias("p"), low.alias("o"), F.lit(-1).alias("d")))
    left = marks.select(*keys, F.explode(entries).alias("e")).select(*keys, "e.*")
    right = probes.withColumn("b", b).withColumn("p", F.col("ts_us")).withColumn("o", F.col("event_id")).withColumn("d", F.lit(0))
    both = right.unionByName(left, allowMissingColumns=True)
    upto = Window.partitionBy(*keys, "b").orderBy("p", "o").rowsBetween(Window.unboundedPreceding, 0)
    return (both.withColumn("preceding", F.sum("d").over(upto)).where(F.col("event_id").isNotNull())
            .drop("b", "p", "o", "d"))


@rule("net", "NSM-CRED-003", "Success after repeated failures", "Initial Access", ["T1110", "T1078"], reads="auth")
def cred_success_after_failures(ev, cfg):
    rows = auth(ev).where(present(F.col("src_ip"))).select(
        "event_id", "ts_us", "src_ip", "user", "action", "assigned_ip")
    window = cfg.success_after_window_s * SECOND
    good = rows.where(F.col("action") == "success").drop("action")
    bad = rows.where((F.col("action") == "failure")).select("event_id", "ts_us", "src_ip", "user")
    named = preceding_counts(bad.where(F.col("user").isNotNull()), good.where(F.col("user").isNotNull()),
                             ["src_ip", "user"], window)
    # A success without an account matches failures of any account of its source.
    nameless = good.where(F.col("user").isNull()).drop("user")
    near = bad.drop("user").join(nameless.select("src_ip").distinct(), "src_ip", "left_semi")
    anyone = preceding_counts(near, nameless, ["src_ip"], window).withColumn("user", F.lit(None).cast("string"))
    out = named.unionByName(anyone).where(F.col("preceding") >= cfg.success_after_failures)
    return out.select(
        "event_id", "src_ip", "user", "assigned_ip", F.col("preceding").alias("preceding_failures"),
        F.col("ts_us").alias("last_us"), _service_account(F.col("user"), cfg).alias("service_account"),
        F.lit("critical").alias("severity"), F.lit("high").alias("confidence"))


@rule("net", "NSM-CRED-004", "Account used from unusual places or hours", "Persistence", ["T1078"], reads="auth")
def cred_odd_sessions(ev, cfg):
    start, end = cfg.business_hours
    good = auth(ev).where((F.col("action") == "success") & present(F.col("user")))
    hour = F.pmod(F.floor(F.col("ts_us") / (3600 * SECOND)), F.lit(24))
    per = good.groupBy("user", "src_ip").agg(
        F.count(F.lit(1)).alias("n"), F.count_if((hour < start) | (hour >= end)).alias("odd"), *bounds())
    out = per.groupBy("user").agg(
        F.count_if(present(F.col("src_ip"))).alias("distinct_sources"), F.sum("n").alias("sessions"),
        F.sum("odd").alias("off_hours_sessions"),
        F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"))
    out = out.where((F.col("distinct_sources") >= 3) | (F.col("off_hours_sessions") >= 3))
    out = out.withColumn("severity", F.when(_service_account(F.col("user"), cfg), "high").otherwise("medium")).withColumn("confidence", F.lit("low"))
    return found(out, listed("sources", per, ["user"], "src_ip"), events=good, keys=["user"])


@rule("net", "NSM-LAT-001", "Internal fan-out on admin ports", "Lateral Movement",
      ["T1021.001", "T1021.002", "T1021.004", "T1210"], reads="admin")
def lateral_move(ev, cfg):
    rows = ev.where(
        F.col("dst_port").isin(LATERAL_PORTS) & present(F.col("src_ip")) & present(F.col("dst_ip"))
        & in_networks(F.col("src_ip"), cfg.home_nets + cfg.vpn_pool_nets) & in_networks(F.col("dst_ip"), cfg.home_nets))
    rows = not_listed(rows, "src_ip", cfg.scanner_allowlist).select(
        "event_id", "ts_us", "src_ip", "dst_ip", "dst_port", "action",
        ((F.col("kind") == "ids_alert")
         & any_hit(F.col("signature"), ["exploit", "lateral", "brute", "psexec", "smb"])).alias("exploit"))
    window = cfg.lateral_window_s * SECOND
    best = written_distinct_run(rows, ["src_ip"], "dst_ip", window, cfg.lateral_min_targets)
    hit = distinct_run_rows(rows, best, ["src_ip"], "dst_ip", window)
    per = hit.groupBy("src_ip", "dst_ip").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("action") == "allow").alias("allowed"),
        F.count_if("exploit").alias("exploit"), F.collect_set("dst_port").alias("ports"), *bounds())
    per = staged(per)
    # The port set has at most seven members, so flattening it stays small.
    out = per.groupBy("src_ip").agg(
        F.count(F.lit(1)).alias("target_count"), F.sum("n").alias("attempts"), F.sum("allowed").alias("allowed"),
        F.sum("exploit").alias("ids_exploit_alerts"),
        *[F.max(F.array_contains("ports", p).cast("int")).alias(f"p{p}") for p in LATERAL_PORTS],
        F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"))
    ports = F.array_compact(F.array(*[F.when(F.col(f"p{p}") == 1, p) for p in LATERAL_PORTS]))
    out = out.withColumn("ports", ports).drop(*[f"p{p}" for p in LATERAL_PORTS])
    pool = in_networks(F.col("src_ip"), cfg.vpn_pool_nets)
    alerts = F.col("ids_exploit_alerts") > 0
    score = F.lit(2) + points((F.size("ports") >= 2, 2), (pool, 3), (alerts, 3), (F.col("allowed") > 0, 2),
                              (F.col("target_count") >= 5, 1))
    out = (out.withColumn("from_vpn_pool", pool).withColumn("score", score)
           .withColumn("severity", band(F.col("score"), (8, "critical"), default="high"))
           .withColumn("confidence", F.when(alerts | F.col("from_vpn_pool"), "high").otherwise("medium")))
    return found(out, listed("targets", per, ["src_ip"], "dst_ip"), events=hit, keys=["src_ip"])


@rule("net", "NSM-LAT-002", "Exploit signature between internal hosts", "Lateral Movement", ["T1210"], reads="flow")
def internal_exploit(ev, cfg):
    rows = ev.where(
        (F.col("kind") == "ids_alert") & present(F.col("src_ip")) & present(F.col("dst_ip"))
        & (any_hit(F.col("signature"), ["exploit"]) | any_hit(F.col("classification"), ["unauthorized"]))
        & in_networks(F.col("src_ip"), cfg.home_nets + cfg.vpn_pool_nets) & in_networks(F.col("dst_ip"), cfg.home_nets))
    keys = ["src_ip", "dst_ip"]
    per = rows.groupBy(*keys, "signature").agg(F.count(F.lit(1)).alias("n"), *bounds())
    out = per.groupBy(*keys).agg(F.sum("n").alias("alerts"), F.count_if(F.col("signature") != "").alias("signature_count"),
                                 F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"))
    out = out.withColumn("severity", F.lit("critical")).withColumn("confidence", F.lit("high"))
    return found(out, listed("signatures", per, keys, "signature"), events=rows, keys=keys)


def vpn_pivots(ev: DataFrame, cfg) -> tuple[DataFrame, DataFrame]:
    """What each successful VPN login's assigned address did in the following seven days: a row per login with exact
    counts, and a row (login_id, kind, value, n, first_us, last_us) per target, port and signature.

    Activity is first reduced to one row per address, hour, target, port and signature. A login
    meets those rows, not events; only rows cut by the edge of its interval are resolved again
    from the events of that hour.
    """
    hour = 3600 * SECOND
    week = 7 * 24 * hour
    logins = ev.where((F.col("kind") == "auth") & (F.col("action") == "success") & present(F.col("assigned_ip"))).select(
        F.col("event_id").alias("login_id"), "user", F.col("src_ip").alias("external_ip"), "assigned_ip",
        F.col("ts_us").alias("login_us"))
    acts = ev.where((F.col("kind") != "auth") & present(F.col("src_ip")) & F.col("ts_us").isNotNull()).select(
        F.col("src_ip").alias("assigned_ip"), bucket_of(F.col("ts_us"), hour).alias("h"),
        F.coalesce("dst_ip", F.lit("")).alias("dst_ip"), F.coalesce("dst_port", F.lit(0)).alias("dst_port"),
        F.when((F.col("kind") == "ids_alert"), F.coalesce("signature", F.lit(""))).otherwise("").alias("sig"), "ts_us")
    acts = acts.join(logins.select("assigned_ip").distinct(), "assigned_ip", "left_semi")
    cell = ["assigned_ip", "h", "dst_ip", "dst_port", "sig"]
    hourly = acts.groupBy(*cell).agg(F.count(F.lit(1)).alias("n"), *bounds())
    # Hours and seven days divide evenly, so an hour's row lies in one week; a login meets its own week and the next.
    hourly = hourly.withColumn("week", F.floor(F.col("h") / (week // hour)))
    reach = logins.withColumn("week", F.explode(F.array(*[F.floor(F.col("login_us") / week) + i for i in (0, 1)])))
    met = reach.join(hourly, ["assigned_ip", "week"]).where(
        (F.col("last_us") >= F.col("login_us")) & (F.col("first_us") <= F.col("login_us") + week))
    whole = (F.col("first_us") >= F.col("login_us")) & (F.col("last_us") <= F.col("login_us") + week)
    edge = met.where(~whole).select("login_id", "user", "external_ip", "login_us", *cell)
    resolved = (edge.join(acts, cell)
                .where(F.col("ts_us").between(F.col("login_us"), F.col("login_us") + week))
                .groupBy("login_id", "user", "external_ip", "login_us", *cell)
                .agg(F.count(F.lit(1)).alias("n"), *bounds()))
    parts = staged(met.where(whole).select(*resolved.columns).unionByName(resolved))
    key = ["login_id", "user", "external_ip", "assigned_ip", "login_us"]
    # Targets, ports and signatures side by side: one pass, and a login with very many of one kind is only many rows.
    kinds = F.array(F.struct(F.lit("target").alias("kind"), F.col("dst_ip").alias("value")), F.struct(F.lit("port").alias("kind"), F.nullif(F.col("dst_port"), F.lit(0)).cast("string").alias("value")),
                    F.struct(F.lit("signature").alias("kind"), F.col("sig").alias("value")))
    flat = parts.select(*key, "n", "first_us", "last_us", (F.col("sig") != "").cast("int").alias("alert"), F.explode(kinds).alias("x")).select(
        *key, "n", "first_us", "last_us", "alert", "x.*")
    per = staged(flat.groupBy(*key, "kind", "value").agg(F.sum("n").alias("n"), F.max("alert").alias("alert"), F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us")))
    there = F.coalesce(F.col("value"), F.lit("")) != ""
    out = per.groupBy(*key).agg(
        F.sum(F.when(F.col("kind") == "target", F.col("n"))).alias("post_login_events"), *[F.count_if(there & (F.col("kind") == k)).alias(c) for k, c in (
            ("target", "target_count"), ("port", "port_count"), ("signature", "signature_count"))],
        F.max("alert").alias("alert"), F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"))
    out = out.withColumn("suspicious", (F.col("alert") > 0) | (F.col("target_count") >= cfg.lateral_min_targets)).drop("alert")
    return (out.orderBy(F.desc("suspicious"), F.desc("target_count"), "login_id"),
            per.where(there).select("login_id", "kind", "value", "n", "first_us", "last_us"))
