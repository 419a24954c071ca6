import ipaddress
import random

from pyspark.sql import functions as F

from sentrylake.functions import net, text

NETS = ["10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "100.64.0.0/10", "fc00::/7", "fe80::/10", "::1/128", "2001:db8:1::/48"]


def plain(v):
    if not v:
        return None
    s = v.strip()
    if s.startswith("[") and "]" in s:
        s = s[1:s.index("]")]
    try:
        a = ipaddress.ip_address(s.split("%", 1)[0])
    except ValueError:
        return None
    return a.ipv4_mapped if a.version == 6 and a.ipv4_mapped is not None else a


def test_networks(spark):
    rnd = random.Random(3)
    vals = ["10.0.0.5", "010.0.0.5", "172.15.0.1", "172.31.255.255", "192.168.1.300", "::ffff:10.1.2.3", "::ffff:0a01:2", "::ffff:a01:2",
            "[fe80::1%12]", "fe80::1", "febf::", "fec0::1", "fc00::1", "fdff:1:2:3:4:5:6:7", "::1", "0:0:0:0:0:0:0:1", "::", "1::2::3", "2001:db8:1::5",
            "2001:db8:1:0:0:0:0:5", "2001:db8:2::1", "host", "", None, "1.2.3", "100.64.0.1", "100.128.0.1", ":::", "1:2:3:4:5:6:7::", "1:2:3", "[10.1.2.3]:80", "203.0.113.9",
            "255.255.255.255", "224.0.0.1", "0.0.0.0", "127.0.0.1", "fc0::1", "12345::1"]
    for _ in range(200):
        vals.append(str(ipaddress.IPv4Address(rnd.getrandbits(32))))
        vals.append(str(ipaddress.IPv6Address(rnd.getrandbits(128))))
        vals.append("::ffff:" + str(ipaddress.IPv4Address(0x0A000000 | rnd.getrandbits(26))))
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    c = F.col("v")
    rows = df.select("v", net.in_networks(c, NETS).alias("n"), F.coalesce(net.is_address(c), F.lit(False)).alias("a"),
                     net.is_public(c).alias("p"), net.private_or_unparseable(c).alias("q")).collect()
    nets = [ipaddress.ip_network(n) for n in NETS]
    inside = [ipaddress.ip_network(n) for n in net.INTERNAL_NETWORKS]
    for r in rows:
        a = plain(r.v)
        assert r.a == (a is not None), r.v
        assert r.n == (a is not None and any(a in n for n in nets if n.version == a.version)), r.v
        internal = a is not None and any(a in n for n in inside if n.version == a.version)
        assert r.q == (a is None or a.is_unspecified or internal), r.v
        pub = a is not None and not (a.is_unspecified or a.is_multicast or internal or (
            a.version == 4 and any(a in ipaddress.ip_network(n) for n in net.NOT_ROUTABLE_V4)))
        assert r.p == pub, r.v


def test_text(spark):
    df = spark.createDataFrame([("a.b.c.example.co.uk", "abcdefgh"), ("www.example.com.", "aaaa"), ("host", ""), (None, None)], "d string, s string")
    d, s = F.col("d"), F.col("s")
    rows = df.select(text.registered_domain(d), text.subdomain_part(d), text.longest_label(d), F.round(text.entropy(s), 6)).collect()
    assert [tuple(r) for r in rows] == [("example.co.uk", "a.b.c", 7, 3.0), ("example.com", "www", 7, 0.0), ("host", "", 4, 0.0), (None, "", 0, 0.0)]
    lab = spark.createDataFrame([("deadbeefdeadbeef",), ("ABCDEFGHIJKLMNOP",), ("abcdefghijklmnop",), ("short",), ("abc-def_ghijklmno",)], "s string")
    assert [r[0] for r in lab.select(text.encoded_label(F.col("s"))).collect()] == ["hex", "base32", "base64", None, "base64"]
    assert spark.range(1).select(text.human_bytes(F.lit(1536)), text.digit_ratio(F.lit("a1b2")), text.consonant_run(F.lit("xqzwoab"))).first()[:] == ("1.5KB", 0.5, 4)
