"""Which rule set a file belongs to, from its first bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentrylake.functions.text import compute_once
from sentrylake.sources.netlogs import PARSERS

HEAD = 65536
# Magic numbers of captures, event logs and OLE containers.
CAPTURE_MAGIC = ["D4C3B2A1", "A1B2C3D4", "4D3CB2A1", "A1B23C4D"]
PCAPNG, EVTX, OLE, ZIP = "0A0D0D0A", "456C6646696C6500", "D0CF11E0A1B11AE1", "504B0304"
_MAIL_HEADER = r"(?im)^(?:from|to|subject|date|message-id|received|return-path|mime-version|reply-to|delivered-to|content-type)\s*:"


def route(files: DataFrame) -> DataFrame:
    """(path, kit, format, reason) from (path, content); unknown files stay, with kit NULL."""
    f = files.select("path", F.lower("path").alias("low"), F.substring("content", 1, HEAD).alias("h"))
    f = f.withColumn("hex", F.hex(F.substring("h", 1, 8))).withColumn("text", F.decode(F.col("h"), "ISO-8859-1"))
    body = F.regexp_replace("text", r"^[ï»¿\s]+", "")
    head = F.lower(F.substring(body, 1, 4096))
    lines = F.slice(F.filter(F.split("text", r"\r?\n"), lambda x: F.trim(x) != ""), 1, 200)
    f = f.withColumn("lines", F.when(F.length("text") == HEAD, F.slice(lines, 1, F.greatest(F.size(lines) - 1, F.lit(1)))).otherwise(lines))
    def readable(fn):
        return F.filter("lines", lambda x: fn(x)["ts_us"].isNotNull())
    # One number per grammar, computed once per file.
    f = compute_once(f, **{f"_{g}": F.size(readable(fn)) / F.greatest(F.size("lines"), F.lit(1)) for g, fn in PARSERS.items()})
    best = F.greatest(*[f"_{g}" for g in PARSERS])
    grammar = F.lit(None).cast("string")
    for g in reversed(list(PARSERS)):
        grammar = F.when((F.col(f"_{g}") == best) & (best >= 0.5), g).otherwise(grammar)
    printable = F.length(F.regexp_replace("text", r"[^\x20-\x7e\t\r\n]", "")) / F.greatest(F.length("text"), F.lit(1)) > 0.95
    mail_lines = F.size(F.regexp_extract_all(F.substring("text", 1, 16384), F.lit(f"({_MAIL_HEADER})"), F.lit(1)))
    header_first = body.rlike(r"^[A-Za-z][A-Za-z0-9-]*\s*:")
    hit = lambda cond, kit, fmt, why: (cond, F.struct(F.lit(kit).alias("kit"), F.lit(fmt).alias("format"), F.lit(why).alias("reason")))
    steps = [
        hit(F.length("h") == 0, None, "empty", "the file is empty"), hit(F.substring("hex", 1, 8).isin(CAPTURE_MAGIC), "pkt", "pcap", "capture (magic bytes)"),
        hit(F.col("hex").startswith(PCAPNG), "pkt", "pcapng", "capture (magic bytes)"), hit(F.col("hex") == EVTX, "win", "evtx", "binary Windows event log"),
        hit(F.col("low").rlike(r"consolehost_history|_history\.txt$"), "win", "pshistory", "shell history"), hit(body.startswith("<") & F.substring(body, 1, 4096).contains("<Event"), "win", "xml", "Windows event XML"),
        hit((F.col("hex") == OLE) & F.col("low").endswith(".msg"), "mail", "msg", "Outlook message"), hit(F.col("hex") == OLE, None, "ole2", "an Office document, not a message"),
        hit(body.rlike(r"^[\[{]") & head.rlike('"(?:eventid|event_id|winlog|eventcode|eventrecordid|system)"'), "win", "json", "Windows events as JSON"),
        hit(F.col("low").endswith(".mbox") | (F.col("text").startswith("From ") & F.col("text").contains("\nFrom ")), "mail", "mbox", "mailbox"),
        hit((mail_lines >= 3) & header_first, "mail", "eml", "message"), hit(F.col("low").rlike(r"\.(?:eml|msg)$") & ((mail_lines > 0) | header_first), "mail", "eml", "message with few headers"),
        hit(F.col("low").rlike(r"\.(?:eml|msg)$"), None, "not-email", "named like a message but without headers"), hit(F.col("low").rlike(r"\.(?:csv|tsv)$"), "net", "csv", "CSV export"),
        hit(F.col("hex").startswith(ZIP), None, "zip", "zip archive")]
    out = F.struct(F.lit(None).cast("string").alias("kit"), F.lit("unknown").alias("format"), F.lit("not a recognised evidence type").alias("reason"))
    out = F.when(printable & grammar.isNotNull(), F.struct(F.lit("net").alias("kit"), grammar.alias("format"), F.lit("network log").alias("reason"))).otherwise(out)
    for cond, value in reversed(steps):
        out = F.when(cond, value).otherwise(out)
    return f.select("path", F.explode(F.array(out)).alias("r")).select("path", "r.*")


def route_files(spark: SparkSession, paths) -> DataFrame:
    return route(spark.read.format("binaryFile").load(paths).select("path", "content"))
