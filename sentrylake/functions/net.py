"""Address expressions. Every function takes and returns Spark columns.

A list of networks is compiled on the driver into one regular expression, so a CIDR
test is a single generated-code match that reads its column once: it stays small when
the optimizer copies it into filters, and needs no Python worker.
"""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column
from pyspark.sql import functions as F

# Networks that count as inside, and IPv4 space that is never routable.
INTERNAL_NETWORKS = [
    "10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "127.0.0.0/8", "169.254.0.0/16",
    "100.64.0.0/10", "::1/128", "fc00::/7", "fe80::/10",
]
NOT_ROUTABLE_V4 = ["0.0.0.0/8", "240.0.0.0/4"]

# Service names by port.
PORT_SERVICES = {
    20: "ftp-data", 21: "ftp", 22: "ssh", 23: "telnet", 25: "smtp", 53: "dns", 67: "dhcp",
    69: "tftp", 80: "http", 88: "kerberos", 110: "pop3", 111: "rpcbind", 123: "ntp",
    135: "msrpc", 137: "netbios-ns", 138: "netbios-dgm", 139: "netbios-ssn", 143: "imap",
    161: "snmp", 389: "ldap", 443: "https", 445: "smb", 465: "smtps", 514: "syslog",
    587: "submission", 636: "ldaps", 993: "imaps", 995: "pop3s", 1080: "socks",
    1433: "mssql", 1521: "oracle", 3128: "squid", 3306: "mysql", 3389: "rdp",
    4444: "metasploit-default", 5432: "postgres", 5900: "vnc", 5985: "winrm",
    5986: "winrm-tls", 6379: "redis", 8000: "http-alt", 8080: "http-proxy",
    8443: "https-alt", 9200: "elasticsearch", 27017: "mongodb",
}
HIGH_RISK_PORTS = [21, 22, 23, 135, 139, 445, 1433, 3306, 3389, 5432, 5900, 6379, 27017]
SUSPICIOUS_PORTS = [1337, 4444, 4445, 8081, 9001, 9002, 31337, 50050]
LATERAL_PORTS = [22, 135, 139, 445, 3389, 5985, 5986]

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_HEX = "0123456789abcdef"
_H = "[0-9a-f]{1,4}"
_V6_TEXT = (rf"(?:(?:{_H}:){{7}}{_H}|(?!.*::.*::)(?=(?:[0-9a-f]*:){{2,8}}[0-9a-f]*(?![0-9a-f:]))"
            rf"(?:{_H}(?::{_H}){{0,6}})?::(?:{_H}(?::{_H}){{0,6}})?(?![0-9a-f:]))")


def _hextet(value: int, bits: int) -> str:
    """Pattern of a 16-bit group whose leading bits are given; leading zeros may be dropped."""
    digits = []
    for i in range(4):
        have = max(0, min(4, bits - 4 * i))
        nibble = (value >> (12 - 4 * i)) & 15
        digits.append([d for d in range(16) if (d >> (4 - have)) == (nibble >> (4 - have))])

    def text(ds):
        return "[" + "".join(_HEX[d] for d in ds) + "]"

    def build(rest):
        if len(rest) == 1:
            return text(rest[0])
        ways = []
        nonzero = [d for d in rest[0] if d]
        if nonzero:
            ways.append("".join(text(d) for d in [nonzero] + rest[1:]))
        if 0 in rest[0]:
            ways.append("0?" + build(rest[1:]))
        return "(?:" + "|".join(ways) + ")"
    return build(digits)


def _v4_pattern(net) -> str:
    base, bits = int(net.network_address), net.prefixlen
    octets = []
    for i in range(4):
        have = max(0, min(8, bits - 8 * i))
        value = (base >> (24 - 8 * i)) & 255
        if have == 0:
            octets.append(_OCTET)
        else:
            octets.append("(?:" + "|".join(
                str(v) for v in range(256) if (v >> (8 - have)) == (value >> (8 - have))) + ")")
    dotted = r"\.".join(octets)
    high = _hextet(base >> 16, min(bits, 16))
    low = _hextet(base & 0xFFFF, max(0, bits - 16))
    return rf"(?:::ffff:)?{dotted}|::ffff:{high}:{low}"


def _v6_pattern(net) -> str | None:
    base, bits = int(net.network_address), net.prefixlen
    if bits == 128 and base in (0, 1):
        zeros = r"(?:(?:0{1,4}:){7}|(?:0{1,4}(?::0{1,4})*)?::(?:0{1,4}:)*)"
        return zeros + ("0{0,3}1" if base else "0{0,4}")
    if bits <= 16 and base >> 112:
        return _hextet(base >> 112, bits) + r"(?=:)(?:[0-9a-f]{0,4}:){1,8}[0-9a-f]{0,4}"
    return None


def network_pattern(networks) -> str | None:
    """One regular expression for a list of networks: bracketed and zone-scoped addresses and
    IPv4-mapped IPv6 included. IPv6 prefixes longer than 16 bits are left to long_v6."""
    parts = []
    for cidr in networks:
        try:
            net = ipaddress.ip_network(cidr, strict=False)
        except ValueError:
            continue
        part = _v4_pattern(net) if net.version == 4 else _v6_pattern(net)
        if part:
            parts.append(part)
    return r"(?i)^\s*\[?(?:" + "|".join(parts) + r")(?:%[^\]]*)?(?:\].*)?\s*$" if parts else None


def _long_v6(ip: Column, networks) -> Column | None:
    """Membership in IPv6 networks that one text pattern cannot express: the address is written
    out in full (bound once, as it is used several times) and compared as a string range."""
    nets = []
    for cidr in networks:
        try:
            net = ipaddress.ip_network(cidr, strict=False)
        except ValueError:
            continue
        if net.version == 6 and _v6_pattern(net) is None:
            nets.append((f"{int(net.network_address):032x}", f"{int(net.broadcast_address):032x}"))
    if not nets:
        return None
    core = F.regexp_extract(F.lower(F.trim(ip)), r"^\[?([0-9a-f:]+)", 1)

    def full(c):
        left = F.filter(F.split(F.split_part(c, F.lit("::"), F.lit(1)), ":"), lambda g: g != "")
        right = F.filter(F.split(F.split_part(c, F.lit("::"), F.lit(2)), ":"), lambda g: g != "")
        gap = F.greatest(F.lit(8) - F.size(left) - F.size(right), F.lit(0))
        groups = F.concat(left, F.array_repeat(F.lit("0"), gap), right)
        return F.concat_ws("", F.transform(groups, lambda g: F.lpad(g, 4, "0")))

    def any_net(k):
        test = F.lit(False)
        for lo, hi in nets:
            test = test | k.between(lo, hi)
        return test & (F.length(k) == 32)
    return is_v6(ip) & F.exists(F.transform(F.array(core), full), any_net)


def is_v4(ip: Column) -> Column:
    return ip.rlike(rf"(?i)^\s*\[?(?:::ffff:)?{_OCTET}(?:\.{_OCTET}){{3}}(?:%[^\]]*)?(?:\].*)?\s*$")


def is_v6(ip: Column) -> Column:
    return ip.rlike(rf"(?i)^\s*\[?{_V6_TEXT}(?:%[^\]]*)?(?:\].*)?\s*$")


def is_address(ip: Column) -> Column:
    return is_v4(ip) | is_v6(ip)


def in_networks(ip: Column, networks) -> Column:
    """True when the address lies in any of the networks; anything else is False."""
    pattern = network_pattern(networks)
    test = ip.rlike(pattern) if pattern else F.lit(False)
    rest = _long_v6(ip, networks)
    return F.coalesce(test if rest is None else test | rest, F.lit(False))


def is_internal(ip: Column) -> Column:
    return in_networks(ip, INTERNAL_NETWORKS)


def is_public(ip: Column) -> Column:
    """Routable unicast outside internal space (documentation ranges count as public)."""
    special = in_networks(ip, INTERNAL_NETWORKS + NOT_ROUTABLE_V4 + ["224.0.0.0/4", "ff00::/8", "::/128"])
    return F.coalesce(is_address(ip), F.lit(False)) & ~special


def private_or_unparseable(ip: Column) -> Column:
    """Not provably outside: internal, unspecified, or not an address at all."""
    return ~F.coalesce(is_address(ip), F.lit(False)) | in_networks(ip, INTERNAL_NETWORKS + ["0.0.0.0/32", "::/128"])


def direction(src: Column, dst: Column) -> Column:
    si, di = is_internal(src), is_internal(dst)
    missing = (F.coalesce(src, F.lit("")) == "") | (F.coalesce(dst, F.lit("")) == "")
    return (F.when(missing, "unknown").when(si & di, "internal").when(~si & di, "inbound")
            .when(si & ~di, "outbound").otherwise("external"))


def same_subnet(a: Column, b: Column, prefix: int = 24) -> Column:
    """Same IPv4 network of the given prefix length; False when either is not IPv4."""
    def num(c):
        parts = F.split(F.trim(c), r"\.")
        return sum((parts[i].cast("bigint") * 256 ** (3 - i) for i in range(1, 4)), parts[0].cast("bigint") * 256 ** 3)
    step = 2 ** (32 - prefix)
    return F.coalesce(is_v4(a) & is_v4(b) & (F.floor(num(a) / step) == F.floor(num(b) / step)), F.lit(False))


def service_name(port: Column) -> Column:
    pairs = [F.lit(x) for kv in PORT_SERVICES.items() for x in kv]
    known = F.create_map(*pairs)[port.cast("int")]
    return F.when(port.isNull(), "unknown").otherwise(
        F.coalesce(known, F.concat(F.lit("port-"), port.cast("string"))))


def present(c: Column) -> Column:
    """A text field that carries something."""
    return c.isNotNull() & (c != "")
