"""Source formats on small fixtures."""

import json

import pytest
from pyspark.sql import functions as F

from sentrylake.config import NetConfig
from sentrylake.functions.win import decoded_command, features
from sentrylake.sources import mailbox, netlogs, packets, routing, winlogs


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    return tmp_path_factory.mktemp("in")


def test_windows_xml(spark, folder):
    ev = """<Events><Event xmlns="http://schemas.microsoft.com/win/2004/08/events/event"><System><Provider Name="P"/><EventID>4625</EventID><TimeCreated SystemTime="2026-01-02T03:04:05.1234567Z"/>
<EventRecordID>7</EventRecordID><Execution ProcessID="44"/><Channel>Security</Channel><Computer>H1</Computer></System><EventData><Data Name="LogonType">3</Data><Data>bare</Data></EventData></Event>
<Event><System><EventID>1102</EventID><Channel>Security</Channel><Computer>H1</Computer></System><UserData><LogFileCleared><SubjectUserName>bob</SubjectUserName></LogFileCleared></UserData></Event></Events>"""
    path = folder / "e.xml"
    path.write_text(ev)
    rows = {r.code: r for r in winlogs.read_xml(spark, str(path)).collect()}
    assert rows[4625].data["LogonType"] == "3" and rows[4625].data["Data1"] == "bare" and rows[4625].data["ExecutionProcessId"] == "44"
    assert rows[4625].ts_us == 1767323045123456
    assert rows[1102].data["SubjectUserName"] == "bob"


def test_windows_json_shapes(spark, folder):
    xml = "<Event><System><EventID>4720</EventID><Channel>Security</Channel><Computer>H3</Computer></System><EventData><Data Name='TargetUserName'>eve</Data></EventData></Event>"
    recs = [
        {"Event": {"System": {"EventID": {"#text": 4625}, "Channel": "Security", "TimeCreated": {"#attributes": {"SystemTime": "2026-01-02T03:04:05Z"}}, "Computer": "H1"}, "EventData": {"LogonType": 3}}},
        {"Xml": xml}, {"winlog": {"event_id": 1, "channel": "Microsoft-Windows-Sysmon/Operational", "computer_name": "H2", "event_data": {"Image": "a.exe"}, "process": {"pid": 9}}, "@timestamp": "2026-01-02T03:04:05Z"},
        {"EventId": 7045, "Channel": "System", "Payload": json.dumps({"EventData": {"Data": [{"@Name": "ImagePath", "#text": "C:\\x.exe"}]}}), "Computer": "H4"},
        {"EventID": 4732, "Channel": "Security", "MemberName": "m", "TimeCreated": "/Date(1767323045000)/"}, {"Id": 4624, "Properties": [{"Value": 1}]}]
    path = folder / "e.jsonl"
    path.write_text("\n".join(json.dumps(r) for r in recs))
    rows = {r.code: r for r in winlogs.read_json(spark, str(path)).collect()}
    assert set(rows) == {4625, 4720, 1, 7045, 4732}
    assert rows[4625].data == {"LogonType": "3"} and rows[4720].data["TargetUserName"] == "eve" and rows[4720].computer == "H3"
    assert rows[1].channel == "Sysmon" and rows[1].data["ExecutionProcessId"] == "9" and rows[7045].data["ImagePath"] == "C:\\x.exe"
    assert rows[4732].data["MemberName"] == "m" and rows[4732].ts_us == 1767323045000000
    lines = spark.read.text(str(path)).withColumnRenamed("value", "line")
    assert [r.reason for r in winlogs.json_rejects(lines).collect()] == ["event fields are stored by position only"]


def test_history_and_merge(spark, folder):
    path = folder / "ConsoleHost_history.txt"
    path.write_text("whoami\n\nipconfig\n")
    hist = winlogs.read_history(spark, str(path))
    assert hist.count() == 2
    ev = winlogs.read_xml(spark, str(folder / "e.xml"))
    assert {r.case_key for r in winlogs.merge_sources(ev, hist).select("case_key").distinct().collect()} == {"H1"}
    assert features(hist).where("is_command").count() == 2


def test_decoded_command(spark):
    import base64
    wide = base64.b64encode("whoami; Get-Date".encode("utf-16-le")).decode()
    rows = [(f"powershell -EncodedCommand {wide}",), (f"powershell /enc {wide.rstrip('=')}",), ("powershell -enc ####",), ("dir",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "c string").select(decoded_command(F.col("c"))).collect()]
    assert got == ["whoami; Get-Date", "whoami; Get-Date", "", "", ""]


def test_logs_and_rejects(spark, folder):
    path = folder / "mixed.log"
    path.write_text("2025-08-25 00:47:46 ALLOW TCP 203.0.113.100:62718 -> 10.0.0.50:443 bytes=9\n"
                    "07/24-10:46:52.401504 [**] [1:1000001:1] \"Ping\" [**] [Priority: 0] {ICMP} 127.0.0.1 -> 127.0.0.1\n"
                    "2025-08-25 08:25:10 203.0.113.100 svc_backup SUCCESS assigned_ip=10.8.0.131\nnonsense\n")
    rows = {r.kind: r for r in netlogs.read_logs(spark, str(path)).collect()}
    assert rows["network_flow"].bytes_out == 9 and rows["ids_alert"].signature == "Ping" and rows["auth"].assigned_ip == "10.8.0.131"
    assert rows["ids_alert"].dst_port is None
    bad = netlogs.rejects(spark.read.text(str(path)).withColumnRenamed("value", "line")).collect()
    assert [r.line for r in bad] == ["nonsense"]
    csv = folder / "z.csv"
    csv.write_text("@timestamp,src_ip,message\n2025-01-01T00:00:00Z,10.0.0.1,\"{\"\"dest_ip\"\": \"\"1.2.3.4\"\", \"\"src_ip\"\": \"\"x\"\"}\"\n")
    r = netlogs.read_csv(spark, str(csv)).first()
    assert (r.src_ip, r.dst_ip, r.kind) == ("10.0.0.1", "1.2.3.4", "network_flow")


def test_mail_and_routing(spark, folder):
    one = b"From: =?utf-8?q?P=C3=A9?= <A@X.example>\nTo: b@y.example\nDelivered-To: c@y.example\nSubject: Hi\nMessage-ID: <1>\nReceived: from a (1.2.3.4) by b; Mon, 1 Jan 2024 10:00:00 +0000\nContent-Type: multipart/mixed; boundary=q\n\n--q\nContent-Type: text/plain\n\nhello\n--q\nContent-Type: application/zip; name=a.zip\nContent-Disposition: attachment; filename=a.zip\nContent-Transfer-Encoding: base64\n\nUEs=\n--q--\n"
    (folder / "m.eml").write_bytes(one)
    (folder / "box.mbox").write_bytes(b"From x\nFrom: a@x.example\nSubject: 1\n\nfirst\nFrom y\nFrom: b@x.example\nSubject: 2\n\nsecond\n")
    r = mailbox.read_mail(spark, str(folder / "m.eml")).first()
    assert (r.from_display, r.from_address, r.is_bcc, r.body_text.strip(), r.attachments[0].filename) == ("Pé", "a@x.example", True, "hello", "a.zip")
    box = mailbox.read_mailbox(spark, str(folder / "box.mbox")).collect()
    assert sorted(x.subject for x in box) == ["1", "2"]
    (folder / "c.pcap").write_bytes(bytes.fromhex("d4c3b2a1") + b"\x00" * 20)
    (folder / "unknown.bin").write_bytes(b"\x00\x01\x02")
    got = {x.path.rsplit("/", 1)[1]: (x.kit, x.format) for x in routing.route_files(spark, str(folder)).collect()}
    assert got["m.eml"] == ("mail", "eml") and got["box.mbox"] == ("mail", "mbox") and got["e.xml"] == ("win", "xml") and got["e.jsonl"] == ("win", "json")
    assert got["c.pcap"] == ("pkt", "pcap") and got["unknown.bin"] == (None, "unknown") and got["ConsoleHost_history.txt"] == ("win", "pshistory") and got["z.csv"] == ("net", "csv")


def test_profile():
    cfg = NetConfig.from_json('{"bruteforce_min_failures": 3, "nonsense": 1}')
    assert cfg.bruteforce_min_failures == 3 and cfg.bruteforce_window_s == 600


def test_packet_reader(spark, folder):
    spark.createDataFrame([(1, 5, "tcp", "1.1.1.1", "2.2.2.2", "1")], ["frame_number", "ts_us", "proto", "src_ip", "dst_ip", "tcp.flags.syn"]).write.parquet(str(folder / "p"))
    r = packets.read_packets(spark, str(folder / "p")).first()
    assert r.fields == {"tcp.flags.syn": "1"} and r.length is None
