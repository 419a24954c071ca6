"""Derived columns of Windows events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentrylake.functions.text import compute_once

UNKNOWN = ["", "Unknown"]
_SWITCH = "encodedcommand"
# Every prefix of the switch from three letters on, plus the short forms e, ec and en.
_ENCODED = (r"(?i)(?:^|\s)[-/](?:" + "|".join(["e", "ec", "en"] + [_SWITCH[:n] for n in range(3, len(_SWITCH) + 1)])
            + r")\s+['\x22]?([A-Za-z0-9+/=]{16,})")
_DOUBLE_EXT = r"(?i)\.[A-Za-z0-9]{2,5}\.(?:exe|com|scr|cpl|bat|cmd|vbs|vbe|js|jse|wsf|ps1|hta|msi)$"


def field(*names: str) -> Column:
    """First non-empty value of the named event fields, else empty text."""
    return F.coalesce(*[F.nullif(F.col("data")[n], F.lit("")) for n in names], F.lit(""))


def norm_channel(c: Column) -> Column:
    low = F.lower(F.trim(c))
    return (F.when(low.contains("sysmon"), "Sysmon").when(low == "security", "Security").when(low == "system", "System")
            .when(low.isin("microsoft-windows-powershell/operational", "powershellcore/operational"), "PowerShell")
            .when(F.coalesce(low, F.lit("")) == "", "Unknown").otherwise(F.trim(c)))


def norm_pid(v: Column) -> Column:
    """Hex or decimal process id as decimal text; anything else unchanged."""
    t = F.trim(v)
    return (F.when(t.rlike("^0[xX][0-9a-fA-F]+$"), F.conv(F.substring(t, 3, 64), 16, 10))
            .when(t.rlike("^[0-9]+$"), F.regexp_replace(t, "^0+(?=[0-9])", "")).otherwise(t))


def norm_logon_id(v: Column) -> Column:
    """Hex or decimal logon id as 0x-prefixed lower hex."""
    t = F.lower(F.trim(v))
    return (F.when(t.rlike("^0x[0-9a-f]+$"), F.concat(F.lit("0x"), F.lower(F.conv(F.substring(t, 3, 64), 16, 16))))
            .when(t.rlike("^[0-9]+$"), F.concat(F.lit("0x"), F.lower(F.conv(t, 10, 16)))).otherwise(t))


def decoded_command(line: Column) -> Column:
    """Plain text of a base64 -EncodedCommand argument (UTF-16LE, then UTF-8), else empty."""
    blob = F.nullif(F.regexp_extract(line, _ENCODED, 1), F.lit(""))
    pad = F.pmod(-F.length(blob), F.lit(4))
    raw = F.try_to_binary(F.concat(blob, F.repeat(F.lit("="), pad)), F.lit("base64"))

    def readable(text):
        odd = F.length(F.regexp_replace(text, r"[^\p{C}\p{Z}]|[ \r\n\t]", ""))
        return F.when((F.length(text) > 0) & (1 - odd / F.length(text) > 0.9), F.regexp_replace(text, r"^\x00+|\x00+$", ""))

    def decode(b):
        paired = F.hex(b).rlike(r"^(?:..(?:[0-9A-CEF].|D[0-7])|..D[89AB]..D[C-F])*$")
        wide = F.when(paired, F.decode(b, "UTF-16LE"))
        narrow = F.when(F.is_valid_utf8(b.cast("string")), b.cast("string"))
        return F.coalesce(readable(wide), readable(narrow))
    # The bound variable keeps the decoded bytes from being computed once per use.
    return F.coalesce(F.get(F.transform(F.array(raw), decode), F.lit(0)), F.lit(""))


def features(ev: DataFrame) -> DataFrame:
    """Add the columns every Windows rule reads. Time 0 stands for 'no time'."""
    ch, code, data = F.col("channel"), F.col("code"), F.col("data")
    unknown = F.coalesce(ch, F.lit("")).isin(UNKNOWN)
    sysmon = (ch == "Sysmon") | (unknown & (F.map_contains_key(data, "UtcTime") | F.map_contains_key(data, "ProcessGuid")))
    ev = ev.withColumn("channel", F.coalesce(ch, F.lit(""))).withColumn("t_us", F.coalesce("ts_us", F.lit(0)))
    ev = ev.withColumn("case_key", F.coalesce("case_key", "computer", F.lit("")))
    ev = ev.withColumn("is_sysmon", F.coalesce(sysmon, F.lit(False)))
    ev = ev.withColumn("is_process_create", ((code == 1) & F.col("is_sysmon")) | (
        (code == 4688) & F.col("channel").isin("Security", *UNKNOWN)))
    ev = ev.withColumn("is_script_block", (code == 4104) & F.col("channel").isin("PowerShell", *UNKNOWN)
                       & F.coalesce(F.map_contains_key(data, "ScriptBlockText"), F.lit(False)))
    ev = ev.withColumn("is_command", F.col("is_process_create") | F.col("is_script_block") | (code == -1))
    ids = {n: F.nullif(F.nullif(norm_logon_id(data[n]), F.lit("")), F.lit("0x0")) for n in ("TargetLogonId", "SubjectLogonId", "LogonId")}
    ev = ev.withColumn("logon_id", F.coalesce(
        F.when(code == 4688, F.coalesce(ids["SubjectLogonId"], ids["TargetLogonId"])).otherwise(
            F.coalesce(ids["TargetLogonId"], ids["SubjectLogonId"], ids["LogonId"])), F.lit("")))
    created = code == 4688
    ev = (ev.withColumn("image", field("Image", "NewProcessName")).withColumn("parent_image", field("ParentImage", "ParentProcessName"))
          .withColumn("source_ip", field("IpAddress", "SourceNetworkAddress"))
          .withColumn("target_user", field("TargetUserName")).withColumn("subject_user", field("SubjectUserName"))
          .withColumn("target_filename", field("TargetFilename"))
          .withColumn("logon_type", F.coalesce(F.expr("try_cast(data['LogonType'] AS INT)"), F.lit(0)))
          .withColumn("command_line", F.when(F.col("is_script_block"), field("ScriptBlockText")).otherwise(field("CommandLine")))
          .withColumn("process_id", norm_pid(F.when(created, field("NewProcessId")).otherwise(
              field("ProcessId", "NewProcessId", "ExecutionProcessId"))))
          .withColumn("parent_process_id", norm_pid(F.when(created, field("ProcessId")).otherwise(field("ParentProcessId")))))
    return ev


def with_command_text(ev: DataFrame) -> DataFrame:
    """Command line plus the decoded payload, for rows that carry a command."""
    ev = compute_once(ev, decoded=decoded_command(F.col("command_line")))
    return ev.withColumn("command_text", F.when(F.col("decoded") != "", F.concat_ws("\n", "command_line", "decoded"))
                         .otherwise(F.col("command_line")))


def sysmon(code: int) -> Column:
    return (F.col("code") == code) & F.col("is_sysmon")


def norm_path(p: Column) -> Column:
    return F.lower(F.trim(p))


def has_double_extension(p: Column) -> Column:
    return p.rlike(_DOUBLE_EXT)


def on_drive(p: Column, letters) -> Column:
    return p.rlike("(?i)^[" + "".join(letters) + "]:")


def ends_with(text: Column, endings) -> Column:
    test = F.lit(False)
    for e in endings:
        test = test | text.endswith(e)
    return test
