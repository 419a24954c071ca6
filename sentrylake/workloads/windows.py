"""Registered queries over Windows events, with their independent SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sentrylake.config import WinConfig
from sentrylake.operators import win_rules as wr
from sentrylake.operators.rulebook import with_lists
from sentrylake.workloads.base import DUCK, Case
from sentrylake.workloads.winviews import NARROW, WIDE, events, win

DAY = 86400
CFG = WinConfig(brute_force_window_s=6 * DAY, brute_force_attempts_threshold=4, successful_logon_correlation_window_s=2 * DAY,
                backdoor_privilege_window_s=6 * DAY, lnk_to_execution_window_s=4 * DAY, archive_to_execution_window_s=20 * DAY,
                discovery_window_s=8 * DAY, stealer_window_s=12 * DAY, transfer_to_network_window_s=3 * DAY)
S = "CAST(1000000 AS BIGINT)"
W = f"""WITH RECURSIVE raw0 AS ({win(DUCK)}),
raw1 AS (SELECT *, coalesce(ts_us, 0) AS t, CASE channel WHEN 'security' THEN 'Security' WHEN 'Microsoft-Windows-Sysmon/Operational' THEN 'Sysmon'
  WHEN 'Microsoft-Windows-PowerShell/Operational' THEN 'PowerShell' ELSE channel END AS ch, coalesce(Image, NewProcessName, '') AS img, coalesce(ParentImage, '') AS pimg,
  coalesce(CASE WHEN code = 4104 THEN ScriptBlockText ELSE CommandLine END, '') AS cl, code IN (1, 4688) AS pc, code IN (1, 4688, 4104, -1) AS cmd,
  coalesce(TargetFilename, '') AS tf, coalesce(TargetUserName, '') AS tu, coalesce(SubjectUserName, '') AS su FROM raw0),
w AS (SELECT *, computer AS case_key, CASE WHEN contains(cl, '{WIDE}') THEN 'whoami; Get-Date' WHEN contains(cl, '{NARROW}') THEN 'get-process | out-string' ELSE '' END AS decoded FROM raw1),
x AS (SELECT *, CASE WHEN decoded <> '' THEN cl || chr(10) || decoded ELSE cl END AS ct FROM w)"""


def batches(src: str, keys: str, window_s: int) -> str:
    """CTEs an, tag: chained batch anchors, then each row with its anchor."""
    ks = [k.strip() for k in keys.split(",")]
    on = " AND ".join(f"r.{k} = an.{k}" for k in ks)
    rk = ", ".join(f"r.{k}" for k in ks)
    return f""",
an AS (SELECT {keys}, min(t) AS a FROM {src} GROUP BY {keys} UNION ALL
  SELECT {rk}, min(r.t) FROM an JOIN {src} r ON {on} AND r.t > an.a + {window_s} * {S} GROUP BY {rk}),
tag AS (SELECT r.*, (SELECT max(a) FROM an WHERE {on} AND an.a <= r.t) AS anchor FROM {src} r)"""


def first_of(text: str, words) -> str:
    return "CASE " + " ".join(f"WHEN contains(lower({text}), '{w}') THEN '{w}'" for w in words) + " END"


def has(text: str, words) -> str:
    return "(" + " OR ".join(f"contains(lower({text}), '{w}')" for w in words) + ")"


FAIL = f""",
f AS (SELECT case_key, IpAddress AS ip, t, tu FROM x WHERE code = 4625 AND LogonType IN ('3', '10') AND IpAddress LIKE '198.%')""" + batches("f", "case_key, ip", 6 * DAY) + """,
bt AS (SELECT case_key, ip, anchor, count(*) AS attempts, max(t) AS last_us FROM tag GROUP BY 1, 2, 3 HAVING count(*) >= 4)"""
CAT = CFG.discovery_commands
HAY = "img || ' ' || ct"


def q(rule, *args):
    return lambda spark, sf: rule(events(spark, sf), CFG, *args)


def simple(name, rule, columns, sql, *lists):
    """A rule over the events; its findings have the named lists whole."""
    if not lists:
        return Case(name, q(rule), columns, W + sql)
    return Case(name, lambda spark, sf: with_lists(rule.found(events(spark, sf), CFG), *lists), columns, W + sql)


CASES = [
    simple("logon_brute", wr.logon_brute, "case_key:s src_ip:s first_us:i last_us:i attempts:i usernames_tried:l username_count:i", FAIL + """
SELECT b.case_key, b.ip AS src_ip, b.anchor AS first_us, b.last_us, b.attempts,
  (SELECT count(DISTINCT nullif(tu, '')) FROM tag g WHERE g.case_key = b.case_key AND g.ip = b.ip AND g.anchor = b.anchor) AS username_count,
  (SELECT list_sort(list(DISTINCT tu) FILTER (WHERE tu <> '')) FROM tag g WHERE g.case_key = b.case_key AND g.ip = b.ip AND g.anchor = b.anchor) AS usernames_tried, 'high' AS severity
FROM bt b QUALIFY row_number() OVER (PARTITION BY b.case_key, b.ip ORDER BY b.anchor) = 1""", "usernames_tried"),
    simple("logon_brute_success", wr.logon_brute_success, "event_id:i case_key:s src_ip:s target_user:s logon_id:s first_us:i severity:s", FAIL + f""",
c AS (SELECT case_key, ip, min(anchor) AS lo, max(last_us) AS hi FROM bt GROUP BY 1, 2)
SELECT event_id, x.case_key, ip AS src_ip, tu AS target_user, '0x' || ltrim(lower(substr(TargetLogonId, 3)), '0') AS logon_id, t AS first_us, 'critical' AS severity
FROM x JOIN c ON x.case_key = c.case_key AND x.IpAddress = c.ip WHERE code = 4624 AND LogonType IN ('3', '10') AND t BETWEEN lo AND hi + {2 * DAY} * {S}"""),
    simple("user_new", wr.user_new, "event_id:i case_key:s target_user:s subject_user:s creator_logon_id:s logon_event:i creator_source_ip:s creator_logon_type:i first_us:i", """,
l AS (SELECT *, '0x' || ltrim(lower(substr(TargetLogonId, 3)), '0') AS id FROM x WHERE code = 4624 QUALIFY row_number() OVER (PARTITION BY case_key, id ORDER BY event_id) = 1)
SELECT n.event_id, n.case_key, n.tu AS target_user, n.su AS subject_user, '0x' || ltrim(lower(substr(n.SubjectLogonId, 3)), '0') AS creator_logon_id, l.event_id AS logon_event,
  CASE WHEN l.event_id IS NOT NULL THEN coalesce(l.IpAddress, '') END AS creator_source_ip, l.LogonType AS creator_logon_type, n.t AS first_us
FROM x n LEFT JOIN l ON l.case_key = n.case_key AND l.id = '0x' || ltrim(lower(substr(n.SubjectLogonId, 3)), '0') WHERE n.code = 4720"""),
    simple("user_backdoor_admin", wr.user_backdoor_admin, "event_id:i case_key:s group:s member:s created_event:i new_user:s created_by:s first_us:i last_us:i", f""",
b AS (SELECT case_key, lower(tu) AS name, min(event_id) AS ord, max(event_id) AS eid FROM x WHERE code = 4720 GROUP BY 1, 2),
g AS (SELECT *, tu AS grp, string_split(lower(MemberName), chr(92))[-1] AS nm FROM x WHERE code = 4732 AND lower(tu) IN ('administrators', 'domain admins')),
m AS (SELECT g.event_id, b.eid, CASE WHEN b.name = g.nm THEN 0 ELSE 1 END AS pr, b.ord FROM g JOIN b ON b.case_key = g.case_key AND (b.name = g.nm OR contains(lower(g.MemberName), b.name))
  QUALIFY row_number() OVER (PARTITION BY g.event_id ORDER BY pr, ord) = 1)
SELECT g.event_id, g.case_key, g.grp AS "group", g.MemberName AS member, m.eid AS created_event, c.tu AS new_user, c.su AS created_by, c.t AS first_us, g.t AS last_us
FROM m JOIN g ON g.event_id = m.event_id JOIN x c ON c.event_id = m.eid WHERE g.t BETWEEN c.t AND c.t + {6 * DAY} * {S}"""),
    simple("user_group", wr.user_group, "event_id:i case_key:s group:s member:s added_by:s first_us:i", """
SELECT event_id, case_key, tu AS "group", MemberName AS member, su AS added_by, t AS first_us FROM x WHERE code = 4732 AND lower(tu) IN ('administrators', 'domain admins')"""),
    simple("user_password_reset", wr.user_password_reset, "event_id:i case_key:s target_user:s reset_by:s first_us:i", """
SELECT event_id, case_key, tu AS target_user, su AS reset_by, t AS first_us FROM x WHERE code = 4724"""),
    simple("persist_service", wr.persist_service, "event_id:i case_key:s binary_path:s installs:i in_suspicious_dir:b severity:s first_us:i", """,
s AS (SELECT *, CASE WHEN code = 7045 THEN coalesce(ServiceFileName, '') ELSE 'C:' || chr(92) || 'Temp' || chr(92) || 'a.exe' END AS p FROM x
  WHERE code = 7045 OR (pc AND lower(img) LIKE '%' || chr(92) || 'sc.exe' AND contains(lower(cl), 'create'))),
g AS (SELECT case_key, CASE WHEN p = '' THEN CAST(event_id AS VARCHAR) ELSE lower(p) END AS key, min(event_id) AS event_id, count(*) AS installs, arg_min(p, event_id) AS p, arg_min(t, event_id) AS first_us
  FROM s GROUP BY 1, 2)
SELECT event_id, case_key, p AS binary_path, installs, lower(p) LIKE 'c:' || chr(92) || 'temp%' AS in_suspicious_dir, first_us,
  CASE WHEN lower(p) LIKE 'c:' || chr(92) || 'temp%' THEN 'high' WHEN p LIKE 'C:' || chr(92) || 'Program Files%' THEN 'low' ELSE 'medium' END AS severity FROM g"""),
    simple("persist_task", wr.persist_task, "event_id:i case_key:s target:s in_suspicious_dir:b severity:s first_us:i", """,
s AS (SELECT *, CASE WHEN code = 4698 THEN TaskName ELSE 'C:' || chr(92) || 'ProgramData' || chr(92) || 'x.exe' END AS target FROM x
  WHERE code = 4698 OR (pc AND lower(img) LIKE '%schtasks.exe' AND contains(cl, '/create')))
SELECT event_id, case_key, target, code <> 4698 AS in_suspicious_dir, CASE WHEN code <> 4698 THEN 'high' ELSE 'medium' END AS severity, t AS first_us FROM s"""),
    simple("persist_startup", wr.persist_startup, "event_id:i case_key:s created_by:s target_filename:s first_us:i", """
SELECT event_id, case_key, img AS created_by, tf AS target_filename, t AS first_us FROM x WHERE code = 11 AND contains(lower(tf), 'start menu' || chr(92) || 'programs' || chr(92) || 'startup' || chr(92))"""),
    simple("persist_runkey", wr.persist_runkey, "event_id:i case_key:s set_by:s registry_key:s value:s first_us:i", """
SELECT event_id, case_key, img AS set_by, TargetObject AS registry_key, Details AS value, t AS first_us FROM x
WHERE code = 13 AND contains(lower(TargetObject), chr(92) || 'currentversion' || chr(92) || 'run')"""),
    simple("exec_double_ext", wr.exec_double_ext, "event_id:i case_key:s image:s parent_image:s first_us:i", """
SELECT event_id, case_key, img AS image, pimg AS parent_image, t AS first_us FROM x WHERE pc AND img LIKE '%.pdf.exe'"""),
    simple("exec_downloaded", wr.exec_downloaded, "event_id:i case_key:s image:s first_us:i last_us:i", f""",
d AS (SELECT case_key, lower(tf) AS path, max(event_id) AS eid FROM x WHERE code = 11 AND contains(lower(tf), chr(92) || 'downloads' || chr(92)) GROUP BY 1, 2)
SELECT p.event_id, p.case_key, p.img AS image, s.t AS first_us, p.t AS last_us FROM x p JOIN d ON d.case_key = p.case_key AND d.path = lower(p.img) JOIN x s ON s.event_id = d.eid
WHERE p.pc AND contains(lower(p.pimg), 'explorer.exe') AND p.t BETWEEN s.t AND s.t + {20 * DAY} * {S}"""),
    Case("exec_downloaded_asof", q(wr.exec_downloaded, True), "event_id:i case_key:s image:s first_us:i last_us:i", W + f""",
m AS (SELECT p.event_id, min(s.event_id) AS sid FROM x p JOIN x s ON s.case_key = p.case_key AND lower(s.tf) = lower(p.img) AND s.code = 11 AND contains(lower(s.tf), chr(92) || 'downloads' || chr(92))
WHERE p.pc AND contains(lower(p.pimg), 'explorer.exe') AND p.t BETWEEN s.t AND s.t + {20 * DAY} * {S} GROUP BY 1)
SELECT p.event_id, p.case_key, p.img AS image, s.t AS first_us, p.t AS last_us FROM m JOIN x p ON p.event_id = m.event_id JOIN x s ON s.event_id = m.sid"""),
    simple("exec_lnk", wr.exec_lnk, "event_id:i case_key:s drop_event:i lnk_path:s image:s command_line:s first_us:i last_us:i", f""",
m AS (SELECT p.event_id, min(d.event_id) AS did FROM x p JOIN x d ON d.case_key = p.case_key AND d.code = 11 AND lower(d.tf) LIKE '%downloads%.lnk' AND p.t BETWEEN d.t AND d.t + {4 * DAY} * {S}
  WHERE p.pc AND contains(lower(p.pimg), 'explorer.exe') AND regexp_matches(lower(p.img), '(powershell|pwsh|cmd|wscript|cscript|mshta).exe$') GROUP BY 1)
SELECT p.event_id, p.case_key, d.event_id AS drop_event, d.tf AS lnk_path, p.img AS image, p.cl AS command_line, d.t AS first_us, p.t AS last_us
FROM m JOIN x p ON p.event_id = m.event_id JOIN x d ON d.event_id = m.did"""),
    simple("exec_removable", wr.exec_removable, "event_id:i case_key:s image:s parent_image:s first_us:i", """
SELECT event_id, case_key, img AS image, pimg AS parent_image, t AS first_us FROM x WHERE pc AND regexp_matches(img, '^[D-Z]:')"""),
    simple("exec_encoded_ps", wr.exec_encoded_ps, "event_id:i case_key:s command_line:s decoded:s first_us:i", """
SELECT event_id, case_key, cl AS command_line, decoded, t AS first_us FROM x WHERE cmd AND decoded <> '' QUALIFY row_number() OVER (PARTITION BY case_key, decoded ORDER BY event_id) = 1"""),
    simple("exec_ps_suspicious", wr.exec_ps_suspicious, "event_id:i case_key:s strong_markers:l weak_markers:l command_line:s severity:s first_us:i", f""",
y AS (SELECT *, list_sort(list_filter({CFG.powershell_strong_markers}, lambda w: contains(lower(ct), w))) AS st, list_sort(list_filter({CFG.powershell_weak_markers}, lambda w: contains(lower(ct), w))) AS wk
  FROM x WHERE cmd)
SELECT event_id, case_key, st AS strong_markers, wk AS weak_markers, cl AS command_line, CASE WHEN len(st) > 0 THEN 'critical' ELSE 'medium' END AS severity, t AS first_us
FROM y WHERE len(st) > 0 OR len(wk) >= 3 QUALIFY row_number() OVER (PARTITION BY case_key, st, wk, cl ORDER BY event_id) = 1"""),
    simple("log_cleared", wr.log_cleared, "event_id:i case_key:s log:s cleared_by:s first_us:i", """
SELECT event_id, case_key, CASE WHEN code = 1102 THEN 'Security' ELSE 'System' END AS log, CASE WHEN SubjectDomainName IS NOT NULL THEN SubjectDomainName || chr(92) ELSE '' END || su AS cleared_by, t AS first_us
FROM x WHERE code = 1102 OR (code = 104 AND provider <> 'Other')"""),
    simple("discovery_sequence", wr.discovery_sequence, "case_key:s entity:s categories:l commands:l first_us:i last_us:i severity:s", f""",
h AS (SELECT *, CASE WHEN ParentProcessGuid IS NOT NULL THEN 'guid:' || ParentProcessGuid WHEN code = 4688 THEN 'ppid:' || (u16 * 16) WHEN code = 4104 THEN 'pshost:' || computer || ':' || ProcessId ELSE 'global' END AS grp
  FROM (SELECT *, CASE WHEN code = 4688 THEN CAST(substr(ProcessId, 3, length(ProcessId) - 3) AS INT) END AS u16 FROM x) WHERE cmd),
p AS ({" UNION ALL ".join(f"SELECT case_key, grp, t, '{c}' AS cat, {first_of(HAY, ws)} AS word FROM h WHERE {has(HAY, ws)}" for c, ws in CAT.items())})""" + batches("p", "case_key, grp", 8 * DAY) + """,
o AS (SELECT case_key, grp, anchor, list_sort(list(DISTINCT cat)) AS categories, list_sort(list(DISTINCT word)) AS commands, max(t) AS last_us FROM tag GROUP BY 1, 2, 3
  HAVING count(DISTINCT cat) >= 2 AND count(DISTINCT word) >= 3)
SELECT case_key, grp AS entity, categories, commands, anchor AS first_us, last_us, CASE WHEN len(categories) >= 3 THEN 'high' ELSE 'medium' END AS severity FROM o
QUALIFY row_number() OVER (PARTITION BY case_key, grp ORDER BY anchor) = 1"""),
    simple("collect_sensitive", wr.collect_sensitive, "event_id:i case_key:s matched_path:s command_line:s target_filename:s first_us:i", f"""
SELECT event_id, case_key, {first_of("ct || ' ' || tf", CFG.sensitive_data_paths)} AS matched_path, cl AS command_line, tf AS target_filename, t AS first_us
FROM x WHERE (cmd OR code = 11) AND {has("ct || ' ' || tf", CFG.sensitive_data_paths)}"""),
    simple("collect_archive", wr.collect_archive, "event_id:i case_key:s command_line:s first_us:i", f"""
SELECT event_id, case_key, cl AS command_line, t AS first_us FROM x WHERE cmd AND {has(HAY, CFG.archive_staging_commands)}"""),
    simple("collect_credential_search", wr.collect_credential_search, "event_id:i case_key:s command_line:s first_us:i", f"""
SELECT event_id, case_key, cl AS command_line, t AS first_us FROM x WHERE cmd AND {has("ct", CFG.credential_keyword_commands)}"""),
    simple("collect_stealer", wr.collect_stealer, "case_key:s image:s categories:l first_us:i last_us:i", f""",
s AS (SELECT case_key, img, t, {first_of("tf", CFG.sensitive_data_paths)} AS cat FROM x WHERE code = 11 AND {has("tf", CFG.sensitive_data_paths)})""" + batches("s", "case_key, img", 12 * DAY) + """,
o AS (SELECT case_key, img, anchor, list_sort(list(DISTINCT cat)) AS categories, max(t) AS last_us FROM tag GROUP BY 1, 2, 3 HAVING count(DISTINCT cat) >= 3)
SELECT case_key, img AS image, categories, anchor AS first_us, last_us FROM o QUALIFY row_number() OVER (PARTITION BY case_key, img ORDER BY anchor) = 1"""),
    simple("c2_transfer", wr.c2_transfer, "event_id:i case_key:s command_line:s pattern:s network_event:i destination:s severity:s first_us:i", f""",
z AS (SELECT *, CASE WHEN code = 4688 THEN CAST(16 * CAST(substr(NewProcessId, 3, length(NewProcessId) - 3) AS INT) AS VARCHAR) ELSE coalesce(ProcessId, '') END AS pid FROM x),
m AS (SELECT a.event_id, min(n.event_id) AS nid FROM z a JOIN z n ON n.case_key = a.case_key AND n.pid = a.pid AND n.pid <> '' AND n.code IN (3, 22) AND n.t BETWEEN a.t AND a.t + {3 * DAY} * {S} GROUP BY 1)
SELECT a.event_id, a.case_key, a.cl AS command_line, {first_of("a.img || ' ' || a.ct", CFG.tool_transfer_patterns)} AS pattern, nid AS network_event, coalesce(n.DestinationIp, n.QueryName) AS destination,
  CASE WHEN nid IS NULL THEN 'medium' ELSE 'high' END AS severity, a.t AS first_us FROM z a LEFT JOIN m ON m.event_id = a.event_id LEFT JOIN z n ON n.event_id = m.nid
WHERE a.cmd AND {has("a.img || ' ' || a.ct", CFG.tool_transfer_patterns)}"""),
    simple("c2_suspicious_network", wr.c2_suspicious_network, "event_id:i case_key:s image:s destination:s first_us:i", f"""
SELECT event_id, case_key, img AS image, coalesce(DestinationIp, QueryName) AS destination, t AS first_us FROM x WHERE code IN (3, 22) AND {has("img", CFG.suspicious_network_process_dirs)} AND NOT contains(lower(img), 'onedrive.exe')"""),
    Case("win_ancestry", lambda s, sf: wr.ancestry(wr.process_nodes(events(s, sf))), "event_id:i case_key:s depth:i path:l root:s", W + """,
n AS (SELECT event_id, case_key, CASE WHEN code = 1 THEN ProcessGuid ELSE 'pid:' || 16 * CAST(substr(NewProcessId, 3, length(NewProcessId) - 3) AS INT) END AS key,
  CASE WHEN code = 1 THEN ParentProcessGuid ELSE 'pid:' || 16 * CAST(substr(ProcessId, 3, length(ProcessId) - 3) AS INT) END AS parent FROM x WHERE pc),
k AS (SELECT case_key, key, arg_max(parent, event_id) AS parent, true AS found FROM n GROUP BY 1, 2),
r AS (SELECT event_id, case_key, parent AS up, CAST([] AS VARCHAR[]) AS path FROM n UNION ALL
  SELECT r.event_id, r.case_key, k.parent, list_append(r.path, r.up) FROM r JOIN k ON k.case_key = r.case_key AND k.key = r.up WHERE NOT list_contains(r.path, r.up))
SELECT event_id, case_key, len(path) AS depth, path, path[-1] AS root FROM r QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY len(path) DESC) = 1"""),
    Case("win_session", lambda s, sf: wr.session_events(events(s, sf), "0x3AB"), "event_id:i case_key:s code:i logon_id:s", W + """
SELECT event_id, case_key, code, '0x3ab' AS logon_id FROM x WHERE lower(coalesce(TargetLogonId, SubjectLogonId)) = '0x3ab'"""),
    Case("win_overview", lambda s, sf: wr.overview(events(s, sf)), "kind:s key:s n:i", W + """
SELECT 'event_id' AS kind, CAST(code AS VARCHAR) AS key, count(*) AS n FROM x GROUP BY code UNION ALL SELECT 'channel', ch, count(*) FROM x GROUP BY ch
UNION ALL SELECT 'host', computer, count(*) FROM x GROUP BY computer UNION ALL SELECT 'total', 'events', count(*) FROM x UNION ALL SELECT 'total', 'first_us', min(ts_us) FROM x
UNION ALL SELECT 'total', 'last_us', max(ts_us) FROM x UNION ALL SELECT 'total', 'untimed', count(*) FILTER (WHERE ts_us IS NULL) FROM x"""),
]
