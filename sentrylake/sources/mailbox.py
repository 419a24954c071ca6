"""Raw messages and mailboxes to the message tables. MIME decoding is the one step that needs
Python; it runs per Arrow batch on the executors and everything after it is SQL."""

from __future__ import annotations

import email
import email.policy
from email.header import decode_header, make_header
from email.utils import getaddresses

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = ("source_path string, part bigint, from_display string, from_address string, reply_to string, return_path string, subject string, msgid string, recipients int, is_bcc boolean, "
          "headers array<struct<name:string,value:string>>, body_text string, body_html string, attachments array<struct<filename:string,content_type:string,content:binary>>")


def _text(v) -> str:
    try:
        return str(make_header(decode_header(v or "")))
    except (LookupError, UnicodeError, ValueError):
        return v or ""


def _pairs(msg, *names):
    return [(_text(n), a.strip().lower()) for n, a in getaddresses([str(v) for x in names for v in msg.get_all(x, [])])]


def decode_message(path: str, part: int, raw: bytes) -> dict:
    """One message as a row of SCHEMA."""
    msg = email.message_from_bytes(raw, policy=email.policy.compat32)
    first = lambda pairs: pairs[0] if pairs else ("", "")
    display, sender = first(_pairs(msg, "From"))
    named = {a for _, a in _pairs(msg, "To", "Cc")}
    envelope = (msg.get("Delivered-To") or msg.get("X-Envelope-To") or "").strip().lower().strip("<>")
    text, html, files = [], [], []
    for p in msg.walk():
        if p.is_multipart():
            continue
        body = p.get_payload(decode=True) or b""
        name = p.get_filename()
        kind = p.get_content_type()
        if name or p.get_content_disposition() == "attachment":
            files.append({"filename": _text(name), "content_type": kind, "content": body})
        elif kind in ("text/plain", "text/html"):
            decoded = body.decode(p.get_content_charset() or "utf-8", "replace") if _known(p.get_content_charset()) else body.decode("utf-8", "replace")
            (html if kind == "text/html" else text).append(decoded)
    return {"source_path": path, "part": part, "from_display": display, "from_address": sender, "reply_to": first(_pairs(msg, "Reply-To"))[1], "return_path": first(_pairs(msg, "Return-Path"))[1],
            "subject": _text(msg.get("Subject")), "msgid": (msg.get("Message-ID") or "").strip(), "recipients": len(_pairs(msg, "To", "Cc")), "is_bcc": not named or bool(envelope and envelope not in named),
            "headers": [{"name": k, "value": str(v)} for k, v in msg.items()], "body_text": "\n".join(text), "body_html": "\n".join(html), "attachments": files}


def _known(charset) -> bool:
    try:
        "".encode(charset or "utf-8")
        return True
    except LookupError:
        return False


def _decode(batches):
    for pdf in batches:
        yield pd.DataFrame([decode_message(p, i, bytes(c)) for p, i, c in zip(pdf["path"], pdf["part"], pdf["content"])])


def read_mail(spark: SparkSession, paths) -> DataFrame:
    """Message files one by one; a mailbox is split at its 'From ' lines by the text reader, so a
    large mailbox is never held whole."""
    files = spark.read.format("binaryFile").load(paths)
    single = files.where(~F.lower("path").endswith(".mbox")).select("path", F.lit(0).cast("bigint").alias("part"), "content")
    return single.mapInPandas(_decode, SCHEMA)


def read_mailbox(spark: SparkSession, paths) -> DataFrame:
    raw = spark.read.option("lineSep", "\nFrom ").text(paths).select(
        F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("n"), F.regexp_replace("value", r"^(?:From )?[^\n]*\n", "").alias("body"))
    return raw.where(F.trim("body") != "").select("path", F.col("n").alias("part"), F.col("body").cast("binary").alias("content")).mapInPandas(_decode, SCHEMA)


def message_tables(mail: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(messages, attachments) as the mail rules read them."""
    ident = F.sha2(F.concat_ws("\u0001", "source_path", F.col("part").cast("string")), 256)
    m = mail.withColumn("message_id", ident)
    att = m.select("message_id", F.explode("attachments").alias("a")).select("message_id", "a.*").withColumn("embedded_urls", F.array().cast("array<string>"))
    return m.drop("attachments", "source_path", "part"), att
