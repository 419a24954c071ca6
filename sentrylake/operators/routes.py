"""One pass over network events for all rules.

A route is the rows and columns that one or several rules look at. Events are read once, each row goes to every route
it may concern, with that route's columns only, and the routes are written side by side; a rule then
reads its own route, as a pruned partition.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentrylake.functions.net import LATERAL_PORTS, SUSPICIOUS_PORTS, in_networks, present
from sentrylake.schema import NET_COLUMNS, struct_type
from sentrylake.session import FREED, held, removed, shared_folder

BASE = ["event_id", "ts_us", "kind", "action", "src_ip", "dst_ip", "dst_port"]
#: The columns of each route besides BASE.
COLUMNS = {
    "flow": ["signature", "classification"], "icmp": ["protocol", "icmp_type", "icmp_payload_len", "bytes_out", "extra"], "auth": ["user", "assigned_ip"],
    "admin": ["signature"], "tool": [], "egress": ["bytes_out", "bytes_in", "signature"],
    "dns": ["dns_query", "dns_qtype", "dns_rcode", "dns_answer", "dns_ttl", "dns_is_response"], "port53": [],
    "http": ["http_method", "http_uri", "http_host", "bytes_out", "signature", "classification", "extra"], "ftp": ["ftp_command", "ftp_arg"], "alert": ["signature"],
    "arp": ["arp_opcode", "arp_sender_ip", "arp_sender_mac", "arp_is_gratuitous"],
}


def conditions(cfg) -> dict[str, Column]:
    """Which rows a route takes: all that any of its rules could use."""
    c, kind, port = F.col, F.col("kind"), F.col("dst_port")
    ends = present(c("src_ip")) & present(c("dst_ip"))
    return {
        "flow": kind.isin("network_flow", "ids_alert") & ends, "icmp": (c("protocol") == "icmp") | (kind == "icmp"), "auth": kind == "auth",
        "admin": port.isin(LATERAL_PORTS) & ends, "tool": port.isin(SUSPICIOUS_PORTS) & ends,
        "egress": ends & in_networks(c("src_ip"), cfg.home_nets) & ~in_networks(c("dst_ip"), cfg.home_nets),
        "dns": present(c("dns_query")), "port53": (port == 53) | (kind == "dns"), "http": kind.isin("http", "tls") | (port == 443) | (F.upper("http_method") == "POST"),
        "ftp": (kind == "ftp") | port.isin(20, 21), "alert": present(c("signature")), "arp": kind == "arp"}


class Routes(dict):
    """A table for each route, and the MB that each takes on disk, under path."""
    mb: dict[str, float]
    path: str

    def spend(self, name: str) -> None:
        """Delete a route that nothing reads any more."""
        table = self.pop(name)
        removed(table.sparkSession, f"{self.path}/route={name}")


def dealt(events: DataFrame, cfg, wanted=None) -> Routes:
    """A table for each route (or each wanted one), from one scan of the events. Each task writes the routes of its rows side
    by side, without a sort or a shuffle, so nothing but the routes takes disk; row groups are small, as a task has one open
    for each route. Ids and times take less as differences (version 2 of the format)."""
    names = [n for n in COLUMNS if wanted is None or n in wanted]
    rules = conditions(cfg)
    route = F.array_compact(F.array(*[F.when(F.coalesce(rules[n], F.lit(False)), F.lit(n)) for n in names]))
    rows = events.withColumn("route", F.explode(route))
    users = {c: [n for n in names if c in COLUMNS[n]] for c in NET_COLUMNS if c not in BASE}
    kept = [*BASE, *[c for c, ns in users.items() if ns]]
    lean = rows.select("route", *[F.col(c) if c in BASE else F.when(F.col("route").isin(users[c]), F.col(c)).alias(c) for c in kept])
    spark = events.sparkSession
    path = f"{shared_folder(spark)}/routes-{uuid.uuid4().hex}"
    with held(spark, {**FREED, "spark.sql.maxConcurrentOutputFileWriters": str(len(COLUMNS) + 1)}):
        lean.write.partitionBy("route").option("compression", "zstd").option("parquet.block.size", 16 << 20).option("parquet.writer.version", "v2").parquet(path)
    schema = struct_type({**{c: NET_COLUMNS[c] for c in kept}, "route": "string"})
    table = spark.read.schema(schema).parquet(path)
    out = Routes({n: table.where(F.col("route") == n).select(*BASE, *COLUMNS[n]) for n in names})
    # By path, as there is no column route where no event has one.
    files = spark.read.format("binaryFile").load(path).groupBy(F.regexp_extract("path", "route=([^/]+)/", 1).alias("route")).agg((F.sum("length") / 1e6).alias("mb"))
    out.mb, out.path = {r["route"]: r["mb"] for r in files.collect()}, path
    return out
