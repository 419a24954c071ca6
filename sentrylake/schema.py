"""Table schemas and the helpers that bring loose columns into them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


# Columns of the network event table.
NET_COLUMNS = {
    "event_id": "bigint", "ts_us": "bigint", "kind": "string", "action": "string",
    "source_type": "string", "raw": "string",
    "src_ip": "string", "src_port": "int", "dst_ip": "string", "dst_port": "int", "protocol": "string",
    "bytes_out": "bigint", "bytes_in": "bigint", "packets": "bigint", "duration": "double",
    "user": "string", "assigned_ip": "string",
    "signature": "string", "sid": "string", "classification": "string", "priority": "int",
    "dns_query": "string", "dns_qtype": "string", "dns_rcode": "string", "dns_answer": "string",
    "dns_ttl": "int", "dns_is_response": "boolean",
    "http_method": "string", "http_uri": "string", "http_host": "string", "http_status": "int",
    "user_agent": "string", "ftp_command": "string", "ftp_arg": "string",
    "src_mac": "string", "dst_mac": "string", "arp_opcode": "int", "arp_sender_ip": "string",
    "arp_sender_mac": "string", "arp_target_ip": "string", "arp_is_gratuitous": "boolean",
    "icmp_type": "int", "icmp_payload_len": "int", "extra": "map<string,string>",
}
# Columns of the Windows event table.
WIN_COLUMNS = {
    "event_id": "bigint", "code": "int", "channel": "string", "ts_us": "bigint",
    "computer": "string", "provider": "string", "source": "string", "raw": "string",
    "case_key": "string", "data": "map<string,string>",
}
# Columns of the packet table.
PACKET_COLUMNS = {
    "event_id": "bigint", "capture_id": "string", "frame_number": "bigint", "ts_us": "bigint",
    "length": "int", "src_mac": "string", "dst_mac": "string", "src_ip": "string", "dst_ip": "string",
    "proto": "string", "src_port": "int", "dst_port": "int", "fields": "map<string,string>",
}
SEVERITIES = ["info", "low", "medium", "high", "critical"]
KILL_CHAIN = [
    "Reconnaissance", "Weaponization", "Delivery", "Exploitation", "Initial Access", "Installation",
    "Persistence", "Credential Access", "Discovery", "Lateral Movement", "Collection",
    "Command & Control", "Exfiltration", "Impact",
]


def struct_type(columns: dict[str, str]) -> T.StructType:
    return T.StructType.fromDDL(", ".join(f"`{k}` {v}" for k, v in columns.items()))


def conform(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Cast to the table schema; columns the source lacks become NULL."""
    have = set(df.columns)
    return df.select(*[
        (F.col(f"`{c}`") if c in have else F.lit(None)).cast(t).alias(c) for c, t in columns.items()])


def net_events(df: DataFrame) -> DataFrame:
    """Network events with counters defaulting to zero."""
    out = conform(df, NET_COLUMNS)
    return (out.withColumn("bytes_out", F.coalesce("bytes_out", F.lit(0)))
            .withColumn("bytes_in", F.coalesce("bytes_in", F.lit(0)))
            .withColumn("packets", F.coalesce("packets", F.lit(0)))
            .withColumn("duration", F.coalesce("duration", F.lit(0.0))))


def severity_rank(col):
    return F.coalesce(F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), col), F.lit(1)) - 1


def stage_rank(col):
    pos = F.array_position(F.array(*[F.lit(s) for s in KILL_CHAIN]), col)
    return F.when(col.isNull() | (pos == 0), 99).otherwise(pos - 1)
