"""Registered queries over messages, with independent SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from sentrylake.functions import brand as br
from sentrylake.functions import url as ul
from sentrylake.operators import mail_rules as mr
from sentrylake.session import staged
from sentrylake.workloads.base import DUCK, SPARK, Case, from_sql

DOMAINS = ["paypal.com", "paypa1.com", "micros0ft-login.net", "gmail.com", "mailinator.com", "shop.example", "netflix.com.evil.xyz", "acme.co.uk", "arnazon.com",
           "live-chess.org", "dhl-team.top", "gogle.com", "secure-chase.club", "good.org"]
SUBJECTS = ["Hello", "URGENT ACTION REQUIRED!!", "Your invoice payment", "Account suspended", "PayPal receipt", "Lunch?", "Netlfix billing information", "Are you available"]
NOTES = ["Dear customer, click here to verify your account within 24 hours.", "", "I need you to process this wire transfer, keep this confidential. CEO",
         "See attached, final notice: legal action.", "Nothing special", "Your micosoft password: reset your password at www.gooogle.example/login.", "Board member refund"]
LINKS = ['<a href="https://safelinks.protection.outlook.com/?url=https%3A%2F%2Fwww.google.com%2Furl%3Fq%3Dhttps%253A%252F%252Fevil.xyz%252Flogin&amp;d=1">https://paypal.com/help</a>',
         '<a href="http://bit.ly/abc">Track</a>', '<a href="http://192.0.2.7/verify">here</a>', '<img src="http://t.example/open.gif" width="1" height="1">',
         '<a href="https://x.pages.dev/account/update">paypal.com</a>', '<a href="https://paypal.com@evil.example/a">paypal</a> <a href="mailto:a@b.example">m</a>',
         '<a href="https://www.paypal.com/signin">https://www.paypal.com</a>', ""]
FILES = ["invoice.pdf.exe", "setup.js", "report.docm", "photo.png", "data.zip", "doc.pdf", "list.txt"]
AUTHS = ["spf=pass smtp.mailfrom=a@x.example; dkim=pass header.d=x.example; dmarc=pass", "spf=fail; dkim=none", "spf=softfail dkim=fail dmarc=none (p=reject)", "dmarc=fail p=quarantine", "spf=neutral; dkim=permerror"]


def pick(expr, values):
    body = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"CASE {expr} {body} END"


VIEW = f"""
SELECT doc_id AS message_id, {pick('doc_id % 5', ['PayPal Support', 'IT Helpdesk', 'Bob', 'ceo@corp.example', ''])} AS from_display,
  CASE WHEN doc_id % 23 = 0 THEN '' ELSE 'u' || CAST(doc_id % 11 AS STRING) || '@' || {pick(f'doc_id % {len(DOMAINS)}', DOMAINS)} END AS from_address,
  CASE WHEN doc_id % 3 = 0 THEN 'r@' || {pick('doc_id % 4', ['gmail.com', 'shop.example', 'x.shop.example', 'yopmail.com'])} ELSE '' END AS reply_to,
  CASE WHEN doc_id % 4 = 1 THEN 'b@shop.example' ELSE '' END AS return_path, {pick('doc_id % 8', SUBJECTS)} AS subject,
  {pick('doc_id % 7', NOTES)} || ' ' || coalesce(text, '') AS body_text,
  CASE WHEN doc_id % 3 <> 0 THEN '<p>Hi</p>' || {pick('doc_id % 8', LINKS)} ELSE '' END || coalesce(html, '') AS body_html,
  CASE WHEN doc_id % 9 = 0 THEN '' ELSE '<' || CAST(doc_id AS STRING) || '@m>' END AS msgid, CAST(doc_id % 30 AS INT) AS recipients, doc_id % 10 = 0 AS is_bcc,
  CASE WHEN doc_id % 6 = 5 THEN NULL ELSE {pick('doc_id % 6', AUTHS)} END AS auth, CAST(doc_id % 3 AS INT) AS hop_count,
  CASE WHEN doc_id % 4 = 0 THEN {pick('doc_id % 7', FILES)} END AS filename
FROM {{documents}} AS d LEFT JOIN {{pages}} AS p ON p.page_id = d.doc_id"""


def tables(spark, sf):
    m = from_sql(spark, sf, VIEW)
    hop = lambda ip, t: F.concat(F.lit("from a.example ("), ip, F.lit(") by b.example with ESMTP; Mon, 1 Jan 2024 10:00:"), F.lit(t), F.lit(" +0000"))
    ip = F.concat(F.lit("[203.0.113."), (F.col("message_id") % 250).cast("string"), F.lit("]"))
    received = F.slice(F.array(F.struct(F.lit("Received").alias("name"), hop(F.lit("[10.0.0.1]"), "30").alias("value")), F.struct(F.lit("Received").alias("name"), hop(ip, "10").alias("value"))), F.lit(1), F.col("hop_count"))
    auth = F.when(F.col("auth").isNotNull(), F.array(F.struct(F.lit("Authentication-Results").alias("name"), F.concat(F.lit("mx.example; "), "auth").alias("value")))).otherwise(
        F.array().cast("array<struct<name:string,value:string>>"))
    m = m.withColumn("headers", F.concat(received, auth))
    magic = F.when(F.col("filename").endswith(".png"), F.lit("MZ..").cast("binary")).otherwise(F.col("subject").cast("binary"))
    att = m.where(F.col("filename").isNotNull()).select("message_id", "filename", magic.alias("content"), F.when(F.col("filename").endswith(".pdf"), F.array(F.lit("http://bit.ly/pdf"))).otherwise(
        F.array().cast("array<string>")).alias("embedded_urls"))
    msgs = m.drop("auth", "hop_count", "filename")
    emb = att.groupBy("message_id").agg(F.flatten(F.collect_list("embedded_urls")).alias("embedded_urls"))
    return msgs, ul.extract(msgs.select("message_id", "body_text", "body_html").join(emb, "message_id", "left")), att


def joined(spark, sf):
    m, u, a = tables(spark, sf)
    return mr.assemble(m, ul.analyse(staged(u)), a)


def group(prefix):
    return lambda spark, sf: mr.findings(joined(spark, sf)).where(F.col("rule_id").startswith(f"PH-{prefix}"))


def url_case(spark, sf):
    m, u, _ = tables(spark, sf)
    return mr.url_findings(m, ul.analyse(staged(u)))


def att_case(spark, sf):
    m, _, a = tables(spark, sf)
    return mr.attachment_findings(m, a)


def verdict(spark, sf):
    return mr.verdicts(joined(spark, sf))


def iocs(spark, sf):
    m, u, a = tables(spark, sf)
    u = staged(u)
    return mr.indicators(m, u, a, mr.verdicts(mr.assemble(m, ul.analyse(u), a)))


def lst(values):
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


def arr(values):
    return "[" + ", ".join("'" + v.lower().replace("'", "''") + "'" for v in values) + "]"


def n_of(text, words):
    return f"len(list_filter({arr(words)}, lambda w: contains({text}, w)))"


W = f"WITH ms AS ({VIEW})"
WORDS = "|".join(w for ws in br.BRAND_WORDS.values() for w in ws)
OWNED = "|".join(d.replace(".", "[.]") for ds in br.BRANDS.values() for d in ds)
ALIKE = ["paypa1.com", "micros0ft-login.net", "netflix.com.evil.xyz", "arnazon.com", "dhl-team.top", "gogle.com", "secure-chase.club"]
HEAD = W + f""",
a AS (SELECT *, split_part(from_address, '@', 2) AS fd, split_part(reply_to, '@', 2) AS rd, split_part(return_path, '@', 2) AS pd, lower(from_display) AS ld,
  lower(subject || chr(10) || body_text) AS st FROM ms),
b AS (SELECT *, CASE fd WHEN 'netflix.com.evil.xyz' THEN 'evil.xyz' ELSE fd END AS fr, CASE rd WHEN 'x.shop.example' THEN 'shop.example' ELSE rd END AS rr, regexp_matches(fd, '(^|[.])({OWNED})$') AS own,
  regexp_matches(ld, '(^|[^a-z0-9])({WORDS})($|[^a-z0-9])') AS db, regexp_matches(st, '(^|[^a-z0-9])({WORDS})($|[^a-z0-9])') AS tb FROM a),
h AS (SELECT *, db AND NOT own AS h2, fd IN {lst(ALIKE)} AS h9, ld = 'it helpdesk' AS au FROM b),
r AS (SELECT message_id, unnest([
  CASE WHEN from_address = '' THEN {{'r': 'PH-HDR-000', 's': 'medium', 'p': 10}} END, CASE WHEN fd <> '' AND contains(ld, '@') AND ld <> from_address THEN {{'r': 'PH-HDR-001', 's': 'critical', 'p': 35}} END,
  CASE WHEN fd <> '' AND h2 THEN {{'r': 'PH-HDR-002', 's': 'critical', 'p': CASE WHEN fr IN {lst(br.FREEMAIL)} THEN 40 ELSE 30 END}} END, CASE WHEN fd <> '' AND au AND NOT own THEN {{'r': 'PH-HDR-003', 's': 'medium', 'p': 12}} END,
  CASE WHEN fd <> '' AND rd <> '' THEN CASE WHEN rr = fr AND rr NOT IN {lst(br.FREEMAIL + br.DISPOSABLE)} THEN {{'r': 'PH-HDR-004', 's': 'low', 'p': 3}} ELSE {{'r': 'PH-HDR-004', 's': 'high', 'p': 22}} END END,
  CASE WHEN fd <> '' AND pd <> '' AND pd <> fr THEN {{'r': 'PH-HDR-005', 's': 'medium', 'p': 14}} END, CASE WHEN fd <> '' AND is_bcc THEN {{'r': 'PH-HDR-006', 's': 'medium', 'p': 12}} END,
  CASE WHEN fr IN {lst(br.DISPOSABLE)} THEN {{'r': 'PH-HDR-007', 's': 'high', 'p': 20}} END, CASE WHEN fr IN {lst(br.FREEMAIL)} AND (db OR au) THEN {{'r': 'PH-HDR-008', 's': 'high', 'p': 18}} END,
  CASE WHEN fd <> '' AND h9 THEN {{'r': 'PH-HDR-009', 's': 'critical', 'p': 35}} END, CASE WHEN split_part(fd, '.', -1) IN {lst(br.ABUSED_TLDS)} THEN {{'r': 'PH-HDR-010', 's': 'low', 'p': 8}} END,
  CASE WHEN fd <> '' AND hop_count = 0 THEN {{'r': 'PH-HDR-011', 's': 'medium', 'p': 10}} WHEN fd <> '' AND hop_count = 1 THEN {{'r': 'PH-HDR-012', 's': 'low', 'p': 5}} END,
  CASE WHEN fd <> '' AND msgid = '' THEN {{'r': 'PH-HDR-013', 's': 'low', 'p': 6}} END, CASE WHEN fd <> '' AND tb AND NOT own AND NOT h2 AND NOT h9 THEN {{'r': 'PH-HDR-014', 's': 'high', 'p': 20}} END]) AS x FROM h)
SELECT message_id, x.r AS rule_id, x.s AS severity, x.p AS score FROM r WHERE x IS NOT NULL"""
AUTH = W + """, r AS (SELECT message_id, unnest(CASE doc WHEN 0 THEN [{'r': 'PH-AUTH-006', 's': 'info', 'p': -12}]
  WHEN 1 THEN [{'r': 'PH-AUTH-001', 's': 'critical', 'p': 30}, {'r': 'PH-AUTH-002', 's': 'low', 'p': 6}, {'r': 'PH-AUTH-004', 's': 'medium', 'p': 10}]
  WHEN 2 THEN [{'r': 'PH-AUTH-001', 's': 'high', 'p': 18}, {'r': 'PH-AUTH-002', 's': 'critical', 'p': 28}, {'r': 'PH-AUTH-004', 's': 'medium', 'p': 10}]
  WHEN 3 THEN [{'r': 'PH-AUTH-003', 's': 'critical', 'p': 32}] WHEN 4 THEN [{'r': 'PH-AUTH-001', 's': 'low', 'p': 5}, {'r': 'PH-AUTH-002', 's': 'high', 'p': 16}]
  ELSE [{'r': 'PH-AUTH-005', 's': 'medium', 'p': 8}] END) AS x FROM (SELECT message_id, message_id % 6 AS doc FROM ms)) SELECT message_id, x.r AS rule_id, x.s AS severity, x.p AS score FROM r"""
LANG = W + f""",
t AS (SELECT *, body_text || chr(10) || body_html AS body, lower(subject || chr(10) || body_text || chr(10) || body_html) AS tx FROM ms),
l AS (SELECT message_id, {n_of('tx', mr.URGENCY)} AS u, {n_of('tx', mr.THREAT)} AS th, {n_of('tx', mr.CREDENTIAL)} AS c, {n_of('tx', mr.FINANCIAL)} AS f, {n_of('tx', mr.BEC)} AS b, {n_of('lower(body)', mr.GREETINGS)} AS g,
  {n_of('tx', mr.ACTIONS)} AS a, len(list_filter({arr([w for w in mr.MISSPELLINGS if w != 'dhI'])}, lambda w: regexp_matches(tx, '(^|[^a-z0-9])' || w || '($|[^a-z0-9])'))) AS ms,
  length(regexp_replace(subject, '[^A-Za-z]', '', 'g')) >= 8 AND length(regexp_replace(subject, '[^A-Z]', '', 'g')) / length(regexp_replace(subject, '[^A-Za-z]', '', 'g')) > 0.6 AS caps,
  regexp_matches(subject, '[!?][!?]') AS loud, {n_of('lower(subject)', mr.URGENCY + mr.THREAT)} > 0 AS pr FROM t)
SELECT message_id, least(u, 3) * 4 + least(th, 3) * 4 + least(c, 3) * 6 + least(b, 3) * 5 + least(f, 3) * 2 + least(a, 2) * 2 + ms * 8 + CASE WHEN g > 0 THEN 3 ELSE 0 END + CASE WHEN caps THEN 3 ELSE 0 END
  + CASE WHEN loud THEN 2 ELSE 0 END + CASE WHEN pr THEN 5 ELSE 0 END AS language_score, u AS urgency, th AS threat, c AS credential, b AS bec, f AS financial FROM l"""
F4 = "message_id:i rule_id:s severity:s score:i"
HOSTS = "regexp_replace(regexp_replace(url, '^https?://', ''), '[/?#].*$', '')"

CASES = [
    Case("mail_header_rules", lambda s, d: mr.header_findings(tables(s, d)[0]), F4, HEAD),
    Case("mail_auth_rules", lambda s, d: mr.auth_findings(tables(s, d)[0]), F4, AUTH),
    Case("mail_url_rules", url_case, F4),
    Case("mail_attachment_rules", att_case, F4, W + f""", f AS (SELECT message_id, filename, length(trim(body_text)) + length(trim(body_html)) AS n FROM ms WHERE filename IS NOT NULL),
r AS (SELECT message_id, unnest([CASE filename WHEN 'invoice.pdf.exe' THEN {{'r': 'PH-ATT-001', 's': 'critical', 'p': 40}} WHEN 'setup.js' THEN {{'r': 'PH-ATT-002', 's': 'critical', 'p': 38}} WHEN 'photo.png' THEN {{'r': 'PH-ATT-002', 's': 'critical', 'p': 38}}
  WHEN 'report.docm' THEN {{'r': 'PH-ATT-003', 's': 'high', 'p': 22}} WHEN 'doc.pdf' THEN {{'r': 'PH-ATT-004', 's': 'high', 'p': 24}} WHEN 'data.zip' THEN {{'r': 'PH-ATT-006', 's': 'medium', 'p': 14}} END,
  CASE WHEN filename = 'photo.png' THEN {{'r': 'PH-ATT-005', 's': 'critical', 'p': 35}} END, CASE WHEN n < 120 THEN {{'r': 'PH-ATT-007', 's': 'high', 'p': 20}} END]) AS x FROM f)
SELECT message_id, x.r AS rule_id, x.s AS severity, x.p AS score FROM r WHERE x IS NOT NULL""".replace("{{", "{").replace("}}", "}")),
    Case("mail_social_rules", group("SOC"), F4),
    Case("mail_language_score", lambda s, d: mr.language_features(tables(s, d)[0]), "message_id:i language_score:i urgency:i threat:i credential:i bec:i financial:i", LANG),
    Case("mail_verdict", verdict, "message_id:i score:i verdict:s types:l"),
    Case("mail_iocs", iocs, "kind:s value:s"),
    Case("received_path", lambda s, d: mr.received_hops(tables(s, d)[0]), "message_id:i pos:i from_host:s by_host:s from_ip:s with_protocol:s delay_seconds:d", W + """
SELECT message_id, pos, 'a.example' AS from_host, 'b.example' AS by_host, 'ESMTP' AS with_protocol, CASE pos WHEN 0 THEN '10.0.0.1' ELSE '203.0.113.' || (message_id % 250) END AS from_ip, CASE WHEN pos = 0 AND hop_count = 2 THEN 20.0 END AS delay_seconds
FROM (SELECT message_id, hop_count, unnest(range(hop_count)) AS pos FROM ms)"""),
    Case("originating_ip", lambda s, d: mr.originating_ip(tables(s, d)[0]), "message_id:i originating_ip:s", W + " SELECT message_id, CASE hop_count WHEN 0 THEN '' WHEN 1 THEN '10.0.0.1' ELSE '203.0.113.' || (message_id % 250) END AS originating_ip FROM ms"),
    Case("lookalike", lambda s, d: br.lookalikes(mr.sender_features(tables(s, d)[0]), "from_domain"), "domain:s brand:s technique:s", W + """, d AS (SELECT DISTINCT split_part(from_address, '@', 2) AS domain FROM ms)
SELECT domain, CASE domain WHEN 'paypa1.com' THEN 'paypal' WHEN 'micros0ft-login.net' THEN 'microsoft' WHEN 'netflix.com.evil.xyz' THEN 'netflix' WHEN 'arnazon.com' THEN 'amazon' WHEN 'dhl-team.top' THEN 'dhl' WHEN 'gogle.com' THEN 'google' ELSE 'chase' END AS brand,
  CASE WHEN domain IN ('paypa1.com', 'arnazon.com') THEN 'exact-skeleton' WHEN domain = 'gogle.com' THEN 'typo' WHEN domain = 'netflix.com.evil.xyz' THEN 'brand-subdomain' ELSE 'brand-in-label' END AS technique FROM d
WHERE domain IN ('paypa1.com', 'micros0ft-login.net', 'netflix.com.evil.xyz', 'arnazon.com', 'dhl-team.top', 'gogle.com', 'secure-chase.club')"""),
    Case("url_extract", lambda s, d: tables(s, d)[1].where(F.col("source") == "html_href"), "message_id:i url:s domain:s display_text:s", W + """, u AS (SELECT message_id, unnest(regexp_extract_all(body_html, '(?s)<a [^>]*?href="([^"]+)"[^>]*>(.*?)</a>', 1)) AS u, unnest(regexp_extract_all(body_html, '(?s)<a [^>]*?href="([^"]+)"[^>]*>(.*?)</a>', 2)) AS shown FROM ms)
SELECT message_id, replace(u, '&amp;', '&') AS url, CASE WHEN contains(u, 'safelinks') THEN 'evil.xyz' WHEN contains(u, '@') THEN 'evil.example' ELSE regexp_extract(u, '://([^/?#]+)', 1) END AS domain, shown AS display_text FROM u WHERE u LIKE 'http%'"""),
    Case("url_unwrap", lambda s, d: tables(s, d)[1].where(F.size("redirect_chain") > 0), "message_id:i final_url:s redirect_chain:l", W + """
SELECT message_id, 'https://evil.xyz/login' AS final_url, ['https://safelinks.protection.outlook.com/?url=https%3A%2F%2Fwww.google.com%2Furl%3Fq%3Dhttps%253A%252F%252Fevil.xyz%252Flogin&d=1', 'https://www.google.com/url?q=https://evil.xyz/login'] AS redirect_chain
FROM ms WHERE contains(body_html, 'safelinks')"""),
    Case("page_hosts", lambda s, d: ul.analyse(from_sql(s, d, "SELECT page_id AS message_id, url FROM {pages}").select(
            "message_id", "url", F.lit("text").alias("source"), F.lit("").alias("display_text"), F.lit(False).alias("is_tracking_pixel"), F.array().cast("array<string>").alias("redirect_chain"),
            ul.host_of(F.col("url")).alias("domain"), ul.path_of(F.col("url")).alias("path"))), "message_id:i domain:s path:s reg:s deep_host:b is_ip_literal:b", f"""
SELECT page_id AS message_id, {HOSTS} AS domain, regexp_extract(url, '^https?://[^/]*([^?#]*)', 1) AS path, array_to_string(string_split({HOSTS}, '.')[-2:], '.') AS reg, len(string_split({HOSTS}, '.')) >= 5 AS deep_host, false AS is_ip_literal FROM {{pages}}"""),
    Case("defang_refang", lambda s, d: from_sql(s, d, "SELECT page_id, url FROM {pages}").select("page_id", ul.defang(F.col("url")).alias("defanged"), ul.refang(ul.defang(F.col("url"))).alias("refanged")),
         "page_id:i defanged:s refanged:s", f"SELECT page_id, replace(regexp_extract(url, '^https?'), 'tt', 'xx') || '[://]' || replace({HOSTS}, '.', '[.]') || regexp_extract(url, '^https?://[^/]*(.*)$', 1) AS defanged, url AS refanged FROM {{pages}}"),
]
