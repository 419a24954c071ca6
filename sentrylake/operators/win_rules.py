"""Rules over Windows events. Input: the event table after functions.win.features; every rule
is keyed by case_key (the host)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sentrylake.functions import text as tx
from sentrylake.functions import win as wf
from sentrylake.functions.net import private_or_unparseable
from sentrylake.operators.intervals import first_in_interval
from sentrylake.operators.rulebook import found, listed, rule
from sentrylake.session import staged
from sentrylake.operators.windows import SECOND, consecutive_batches

SCRIPT_HOSTS = ["powershell.exe", "pwsh.exe", "cmd.exe", "wscript.exe", "cscript.exe", "mshta.exe"]
REMOTE_TYPES = [3, 10]
# Report order of tactics.
TACTICS = ["Initial Access", "Execution", "Persistence", "Defense Evasion", "Discovery", "Credential Access",
           "Collection", "Command and Control", "Unknown", "Internal"]


def graded(df: DataFrame, severity, confidence) -> DataFrame:
    s = F.lit(severity) if isinstance(severity, str) else severity
    c = F.lit(confidence) if isinstance(confidence, str) else confidence
    return df.withColumn("severity", s).withColumn("confidence", c)


def _failed_batches(ev: DataFrame, cfg) -> tuple[DataFrame, DataFrame]:
    """Failed remote logons grouped into consecutive batches; qualifying batches only."""
    rows = ev.where((F.col("code") == 4625) & F.col("logon_type").isin(REMOTE_TYPES))
    if cfg.external_ip_only:
        rows = rows.where(~private_or_unparseable(F.col("source_ip")))
    rows = rows.select("event_id", "case_key", F.col("source_ip").alias("src_ip"), "t_us", "target_user")
    key = ["case_key", "src_ip"]
    # A key with too few failures in total cannot qualify.
    enough = rows.groupBy(*key).count().where(F.col("count") >= cfg.brute_force_attempts_threshold).drop("count")
    rows = rows.join(enough, key, "left_semi")
    window = int(cfg.brute_force_window_s * SECOND)
    tagged = staged(rows.join(consecutive_batches(rows, key, window, "t_us"), key + ["t_us"]))
    per = tagged.groupBy(*key, "anchor").agg(F.count(F.lit(1)).alias("attempts"), F.max("t_us").alias("last_us"))
    return tagged, per.where(F.col("attempts") >= cfg.brute_force_attempts_threshold)


@rule("win", "EVTX-LOGON-BRUTE-01", "Remote logon guessing", "Initial Access", ["T1110.001", "T1133"])
def logon_brute(ev, cfg):
    tagged, batches = _failed_batches(ev, cfg)
    key = ["case_key", "src_ip", "first_us"]
    first = batches.groupBy(*key[:2]).agg(F.min_by(F.struct("anchor", "attempts", "last_us"), "anchor").alias("f")).select(*key[:2], "f.*").withColumnRenamed("anchor", "first_us")
    rows = tagged.withColumnRenamed("anchor", "first_us").withColumnRenamed("t_us", "ts_us")
    names = rows.where(F.col("target_user") != "").groupBy(*key, "target_user").agg(F.count(F.lit(1)).alias("n"))
    count = names.groupBy(*key).agg(F.count(F.lit(1)).alias("username_count"))
    out = first.join(count, key, "left").fillna(0, ["username_count"])
    return found(graded(out, "high", "high"), listed("usernames_tried", names.drop("n"), key, "target_user"), events=rows, keys=key)


@rule("win", "EVTX-LOGON-BRUTE-SUCCESS-01", "Remote logon after guessing", "Initial Access", ["T1110", "T1078", "T1021.001"])
def logon_brute_success(ev, cfg):
    _, batches = _failed_batches(ev, cfg)
    cluster = batches.groupBy("case_key", "src_ip").agg(F.min("anchor").alias("lo"), F.max("last_us").alias("hi"))
    good = ev.where((F.col("code") == 4624) & F.col("logon_type").isin(REMOTE_TYPES)).select(
        "event_id", "case_key", F.col("source_ip").alias("src_ip"), "t_us", "target_user", "logon_id")
    grace = int(cfg.successful_logon_correlation_window_s * SECOND)
    out = good.join(cluster, ["case_key", "src_ip"]).where(F.col("t_us").between(F.col("lo"), F.col("hi") + grace))
    return graded(out.drop("lo", "hi").withColumnRenamed("t_us", "first_us"), "critical", "high")


@rule("win", "EVTX-USER-NEW-01", "Local account created", "Persistence", ["T1136.001"])
def user_new(ev, cfg):
    made = ev.where(F.col("code") == 4720).select(
        "event_id", "case_key", "target_user", "subject_user", F.col("t_us").alias("first_us"),
        F.nullif(wf.norm_logon_id(wf.field("SubjectLogonId")), F.lit("")).alias("creator"))
    logons = ev.where((F.col("code") == 4624) & (F.col("logon_id") != "")).groupBy("case_key", F.col("logon_id").alias("creator")).agg(
        F.min_by(F.struct(F.col("event_id").alias("logon_event"), F.col("source_ip").alias("creator_source_ip"),
                          F.col("logon_type").alias("creator_logon_type")), "event_id").alias("l"))
    out = made.join(logons, ["case_key", "creator"], "left").select(*made.columns, "l.*")
    return graded(out.withColumnRenamed("creator", "creator_logon_id"), "low", "low")


def _group_adds(ev, cfg):
    groups = [g.lower() for g in cfg.sensitive_groups]
    rows = ev.where(F.col("code") == 4732).select(
        "event_id", "case_key", "t_us", "subject_user", wf.field("TargetUserName", "GroupName").alias("group"),
        wf.field("MemberName", "MemberSid").alias("member"))
    return rows.where(F.lower("group").isin(groups))


def _grams(text, q: int):
    """The distinct pieces of q characters of a text."""
    n = F.length(text)
    return F.when(n >= q, F.array_distinct(F.transform(F.sequence(F.lit(1), n - q + 1), lambda i: F.substr(text, i, F.lit(q))))).otherwise(F.array().cast("array<string>"))


def containing(names: DataFrame, texts: DataFrame, keys: list[str], name: str, text: str, q: int = 3) -> DataFrame:
    """The rows of texts with each name of their key that occurs in the text: an inverted index on pieces of q characters.

    A name is looked up under its rarest piece among the texts only, and a name with a piece that no text has is
    dropped before the join; names shorter than q are pieces themselves. What meets is then checked. Empty names
    and nulls meet nothing."""
    short = F.explode(F.flatten(F.array(*[_grams(F.col(text), i) for i in range(1, q + 1)])))
    pieces = texts.where(F.col(text) != "").select(*texts.columns, short.alias("_gram"))
    known = pieces.groupBy(*keys, "_gram").agg(F.count(F.lit(1)).alias("_n"))
    own = F.when(F.length(name) < q, F.array(F.col(name))).otherwise(_grams(F.col(name), q))
    asked = names.where(F.col(name) != "").select(*keys, name).distinct().withColumn("_own", own)
    asked = asked.select(*keys, name, F.size("_own").alias("_size"), F.explode("_own").alias("_gram")).join(known, [*keys, "_gram"])
    best = asked.groupBy(*keys, name, "_size").agg(F.min_by("_gram", "_n").alias("_gram"), F.count(F.lit(1)).alias("_met")).where("_met = _size")
    return pieces.join(best.select(*keys, name, "_gram"), [*keys, "_gram"]).where(F.contains(F.col(text), F.col(name))).drop("_gram")


@rule("win", "EVTX-USER-BACKDOOR-ADMIN-01", "New account made privileged", "Persistence", ["T1136.001", "T1098"])
def user_backdoor_admin(ev, cfg):
    born = ev.where((F.col("code") == 4720) & (F.col("target_user") != "")).groupBy(
        "case_key", F.lower("target_user").alias("name")).agg(
        F.min("event_id").alias("ord"),
        F.max_by(F.struct(F.col("event_id").alias("created_event"), F.col("t_us").alias("created_us"),
                          F.col("target_user").alias("new_user"), F.col("subject_user").alias("created_by")), "event_id").alias("c"))
    adds = _group_adds(ev, cfg).where(F.col("member") != "")
    low = F.lower("member")
    exact = F.element_at(F.split(F.regexp_replace(low, r"^\\+", ""), r"\\", -1), -1)
    equal = adds.withColumn("name", exact).join(born, ["case_key", "name"]).withColumn("ord", F.lit(-1).cast("bigint"))
    # The fallback is 'name occurs in member'.
    rest = adds.join(equal.select("event_id"), "event_id", "left_anti")
    texts = rest.select("case_key", "member", low.alias("text")).distinct()
    met = containing(born.select("case_key", "name"), texts, ["case_key"], "name", "text")
    inside = met.join(born, ["case_key", "name"]).groupBy("case_key", "member").agg(F.min_by("c", "ord").alias("c"))
    part = rest.join(inside, ["case_key", "member"])
    cols = ["event_id", "case_key", "group", "member", "t_us", "c"]
    both = equal.select(*cols).unionByName(part.select(*cols))
    window = int(cfg.backdoor_privilege_window_s * SECOND)
    out = both.where(F.col("t_us").between(F.col("c.created_us"), F.col("c.created_us") + window))
    return graded(out.select("event_id", "case_key", "group", "member", F.col("t_us").alias("last_us"), "c.*")
                  .withColumnRenamed("created_us", "first_us"), "critical", "high")


@rule("win", "EVTX-USER-GROUP-01", "Account added to a privileged group", "Persistence", ["T1098"])
def user_group(ev, cfg):
    return graded(_group_adds(ev, cfg).withColumnRenamed("t_us", "first_us").withColumnRenamed("subject_user", "added_by"),
                  "medium", "medium")


@rule("win", "EVTX-USER-PWRESET-01", "Password reset by another account", "Persistence", ["T1098", "T1078.003"])
def user_password_reset(ev, cfg):
    return graded(ev.where(F.col("code") == 4724).select(
        "event_id", "case_key", "target_user", F.col("subject_user").alias("reset_by"), F.col("t_us").alias("first_us")), "medium", "low")


@rule("win", "EVTX-PERSIST-SERVICE-01", "Service installed", "Persistence", ["T1543.003"])
def persist_service(ev, cfg):
    line = F.lower("command_line")
    sc = F.col("is_process_create") & F.lower("image").endswith("\\sc.exe")
    installed = ((F.col("code") == 4697) & F.col("channel").isin("Security", "Unknown")) | (
        (F.col("code") == 7045) & F.col("channel").isin("System", "Unknown"))
    rows = ev.where((sc & line.contains("create")) | (~sc & installed))
    path = F.when(sc, F.trim(F.regexp_extract("command_line", r"(?i)binpath[=\s]+\x22?([^\x22]+)", 1))).otherwise(
        wf.field("ServiceFileName", "ImagePath"))
    rows = rows.select("event_id", "case_key", "t_us", path.alias("binary_path"))
    key = F.regexp_replace(wf.norm_path(F.col("binary_path")), r"^\x22+|\x22+$", "")
    # Rows without a path stay apart: their own id is the key.
    rows = rows.withColumn("path_key", F.when(key != "", key).otherwise(F.concat(F.lit("\u0001"), F.col("event_id").cast("string"))))
    out = rows.groupBy("case_key", "path_key").agg(
        F.min("event_id").alias("event_id"), F.min_by("binary_path", "event_id").alias("binary_path"),
        F.min_by("t_us", "event_id").alias("first_us"), F.count(F.lit(1)).alias("installs")).drop("path_key")
    low = wf.norm_path(F.col("binary_path"))
    bad = tx.any_hit(low, cfg.suspicious_persistence_dirs)
    legit = F.lit(False)
    for d in cfg.legitimate_service_dirs:
        legit = legit | low.startswith(d)
    out = out.withColumn("in_suspicious_dir", bad)
    return graded(out, F.when(F.col("in_suspicious_dir"), "high").when(legit, "low").otherwise("medium"),
                  F.when(F.col("in_suspicious_dir"), "medium").otherwise("low"))


@rule("win", "EVTX-PERSIST-TASK-01", "Scheduled task created", "Persistence", ["T1053.005"])
def persist_task(ev, cfg):
    target = r"(?i)/tr\s+\x22?([^\x22]+?)(?:\x22|\s+/|\s*$)"
    tool = F.col("is_process_create") & F.lower("image").endswith("\\schtasks.exe")
    rows = ev.where((tool & F.lower("command_line").contains("/create")) | (~tool & (F.col("code") == 4698)))
    content = F.regexp_extract(wf.field("TaskContent"), target, 1)
    path = F.when(tool, F.trim(F.regexp_extract("command_line", target, 1))).otherwise(
        F.when(content != "", F.trim(content)).otherwise(wf.field("TaskName")))
    out = rows.select("event_id", "case_key", F.col("t_us").alias("first_us"), path.alias("target"))
    out = out.withColumn("in_suspicious_dir", tx.any_hit(wf.norm_path(F.col("target")), cfg.suspicious_persistence_dirs))
    return graded(out, F.when(F.col("in_suspicious_dir"), "high").otherwise("medium"),
                  F.when(F.col("in_suspicious_dir"), "medium").otherwise("low"))


@rule("win", "EVTX-PERSIST-STARTUP-01", "File placed in a startup folder", "Persistence", ["T1547.001"])
def persist_startup(ev, cfg):
    rows = ev.where(wf.sysmon(11) & tx.any_hit(F.col("target_filename"), cfg.startup_folder_markers))
    return graded(rows.select("event_id", "case_key", F.col("image").alias("created_by"), "target_filename",
                              F.col("t_us").alias("first_us")), "high", "medium")


@rule("win", "EVTX-PERSIST-RUNKEY-01", "Autorun registry value set", "Persistence", ["T1547.001"])
def persist_runkey(ev, cfg):
    rows = ev.where(wf.sysmon(13)).select(
        "event_id", "case_key", F.col("image").alias("set_by"), wf.field("TargetObject").alias("registry_key"),
        wf.field("Details").alias("value"), F.col("t_us").alias("first_us"))
    return graded(rows.where(tx.any_hit(F.col("registry_key"), cfg.run_key_markers)), "high", "medium")


@rule("win", "EVTX-EXEC-DOUBLEEXT-01", "Executable with a double extension", "Initial Access", ["T1036.007", "T1204.002"])
def exec_double_ext(ev, cfg):
    rows = ev.where(F.col("is_process_create") & wf.has_double_extension(F.col("image")))
    return graded(rows.select("event_id", "case_key", "image", "parent_image", F.col("t_us").alias("first_us")), "critical", "high")


def _by_explorer(ev):
    return ev.where(F.col("is_process_create") & F.lower("parent_image").contains("explorer.exe"))


@rule("win", "EVTX-EXEC-DOWNLOADED-ATTACHMENT-01", "Downloaded file opened by the user", "Initial Access", ["T1566.001", "T1204.002"])
def exec_downloaded(ev, cfg, as_of: bool = False):
    window = int(cfg.archive_to_execution_window_s * SECOND)
    drops = ev.where(wf.sysmon(11) & tx.any_hit(F.col("target_filename"), cfg.download_dir_markers)).select(
        "event_id", "case_key", "t_us", wf.norm_path(F.col("target_filename")).alias("path"))
    runs = _by_explorer(ev).select("event_id", "case_key", "image", F.col("t_us"), wf.norm_path(F.col("image")).alias("path"))
    if as_of:
        # Opt-in: any drop inside the interval counts, not only the last one written.
        hit = first_in_interval(runs, drops, ["case_key", "path"], window, [], -window, "t_us")
        out = hit.where(F.col("match").isNotNull()).withColumn("drop_us", F.col("match.t_us")).drop("match")
    else:
        last = drops.groupBy("case_key", "path").agg(F.max_by("t_us", "event_id").alias("drop_us"))
        out = runs.join(last, ["case_key", "path"]).where(F.col("t_us").between(F.col("drop_us"), F.col("drop_us") + window))
    return graded(out.select("event_id", "case_key", "image", F.col("drop_us").alias("first_us"), F.col("t_us").alias("last_us")), "high", "high")


@rule("win", "EVTX-EXEC-LNK-PHISHING-01", "Shortcut file started a script host", "Initial Access", ["T1566.001", "T1204.002", "T1059.001"])
def exec_lnk(ev, cfg):
    window = int(cfg.lnk_to_execution_window_s * SECOND)
    name = F.lower("target_filename")
    drops = ev.where(wf.sysmon(11) & name.endswith(cfg.lnk_extension) & tx.any_hit(name, cfg.download_dir_markers)).select(
        "event_id", "case_key", "t_us", "target_filename")
    hosts = wf.ends_with(F.lower("image"), ["\\" + h for h in SCRIPT_HOSTS])
    runs = _by_explorer(ev).where(hosts).select("event_id", "case_key", "t_us", "image", "command_line")
    hit = first_in_interval(runs, drops, ["case_key"], window, ["target_filename"], -window, "t_us")
    out = hit.where(F.col("match").isNotNull()).select(
        "event_id", "case_key", F.col("match.event_id").alias("drop_event"), F.col("match.target_filename").alias("lnk_path"), "image",
        "command_line", F.col("match.t_us").alias("first_us"), F.col("t_us").alias("last_us"))
    return graded(out, "critical", "medium")


@rule("win", "EVTX-EXEC-REMOVABLE-01", "Program started from another drive", "Initial Access", ["T1091"])
def exec_removable(ev, cfg):
    rows = ev.where(F.col("is_process_create") & wf.on_drive(F.col("image"), cfg.removable_drive_letters))
    return graded(rows.select("event_id", "case_key", "image", "parent_image", F.col("t_us").alias("first_us")), "medium", "low")


@rule("win", "EVTX-EXEC-ENCODED-PS-01", "Encoded PowerShell command", "Execution", ["T1059.001", "T1027.010"])
def exec_encoded_ps(ev, cfg):
    rows = wf.with_command_text(ev.where(F.col("is_command")))
    shell = F.lower("command_line").rlike("powershell|pwsh") | F.lower("image").rlike(r"(?:powershell|pwsh)\.exe$")
    rows = rows.where((F.col("decoded") != "") & shell)
    out = rows.groupBy("case_key", "computer", "decoded").agg(
        F.min("event_id").alias("event_id"), F.min_by(F.struct("command_line", "t_us"), "event_id").alias("f"))
    return graded(out.select("event_id", "case_key", F.col("f.command_line").alias("command_line"),
                             "decoded", F.col("f.t_us").alias("first_us")), "high", "medium")


@rule("win", "EVTX-EXEC-PSSUSPICIOUS-01", "Offensive PowerShell", "Execution", ["T1059.001"])
def exec_ps_suspicious(ev, cfg):
    gate = [m.lower() for m in cfg.powershell_strong_markers + cfg.powershell_weak_markers]
    rows = wf.with_command_text(ev.where(F.col("is_command")))
    rows = rows.where(tx.any_hit(F.col("command_text"), gate))
    rows = rows.withColumn("strong_markers", F.array_sort(tx.hits(F.col("command_text"), cfg.powershell_strong_markers)))
    rows = rows.withColumn("weak_markers", F.array_sort(tx.hits(F.col("command_text"), cfg.powershell_weak_markers)))
    rows = rows.where((F.size("strong_markers") > 0) | (F.size("weak_markers") >= cfg.powershell_weak_marker_threshold))
    out = rows.groupBy("case_key", "computer", "strong_markers", "weak_markers", "command_line").agg(
        F.min("event_id").alias("event_id"), F.min_by("t_us", "event_id").alias("first_us"))
    strong = F.size("strong_markers") > 0
    return graded(out.drop("computer"), F.when(strong, "critical").otherwise("medium"), F.when(strong, "high").otherwise("low"))


@rule("win", "EVTX-DEFENSE-LOGCLEAR-01", "Event log cleared", "Defense Evasion", ["T1070.001"])
def log_cleared(ev, cfg):
    security = (F.col("code") == 1102) & F.col("channel").isin("Security", "Unknown")
    provider = F.coalesce("provider", F.lit(""))
    system = (F.col("code") == 104) & F.col("channel").isin("System", "Unknown") & (
        (provider == "") | F.lower(provider).contains("eventlog"))
    named = wf.field("Channel")
    who = F.array_join(F.filter(F.array(wf.field("SubjectDomainName"), wf.field("SubjectUserName")), lambda x: x != ""), "\\")
    return graded(ev.where(security | system).select(
        "event_id", "case_key", F.when(security, "Security").when(named != "", named).otherwise("System").alias("log"),
        F.when(who != "", who).otherwise("(not recorded)").alias("cleared_by"), F.col("t_us").alias("first_us")), "high", "high")


def _first_batch(rows: DataFrame, keys: list[str], window_us: int, checks: dict, keep) -> DataFrame:
    """First consecutive batch per key that passes: rows carry `pairs` = array<struct<cat,cmd>>."""
    tagged = rows.join(consecutive_batches(rows, keys, window_us, "t_us"), keys + ["t_us"])
    flat = tagged.select(*keys, "anchor", "event_id", "t_us", F.explode("pairs").alias("p"))
    per = flat.groupBy(*keys, "anchor", "p.cat", "p.cmd").agg(F.max("t_us").alias("last_us"))
    out = per.groupBy(*keys, "anchor").agg(
        F.countDistinct("cat").alias("n_cat"), F.countDistinct("cmd").alias("n_cmd"),
        F.array_sort(F.collect_set("cat")).alias("categories"), F.array_sort(F.collect_set("cmd")).alias("commands"),
        F.max("last_us").alias("last_us"))
    out = staged(out.where(keep))
    first = out.groupBy(*keys).agg(F.min("anchor").alias("anchor"))
    return out.join(first, keys + ["anchor"])


@rule("win", "EVTX-DISCOVERY-SEQ-01", "Run of discovery commands", "Discovery", ["T1033", "T1087.001", "T1082", "T1016"])
def discovery_sequence(ev, cfg):
    catalogue = cfg.discovery_commands
    rows = wf.with_command_text(ev.where(F.col("is_command")))
    hay = F.concat_ws(" ", "image", "command_text")
    rows = rows.where(tx.any_hit(hay, [c for cs in catalogue.values() for c in cs]))
    pairs = F.array_compact(F.array(*[
        F.when(tx.any_hit(hay, cs), F.struct(F.lit(cat).alias("cat"), tx.first_hit(hay, cs).alias("cmd"))) for cat, cs in catalogue.items()]))
    guid = wf.field("ParentProcessGuid")
    grp = (F.when(guid != "", F.concat(F.lit("guid:"), guid))
           .when(F.col("parent_process_id") != "", F.concat(F.lit("ppid:"), F.col("parent_process_id")))
           .when(F.col("is_script_block") & (F.col("process_id") != ""), F.concat_ws(":", F.lit("pshost"), "computer", "process_id"))
           .when(F.col("logon_id") != "", F.concat(F.lit("logon:"), F.col("logon_id"))).otherwise("global"))
    rows = rows.select("event_id", "case_key", grp.alias("grp"), "t_us", pairs.alias("pairs"))
    keep = (F.col("n_cmd") >= cfg.discovery_min_distinct_commands) & (F.col("n_cat") >= cfg.discovery_min_categories)
    out = _first_batch(rows, ["case_key", "grp"], int(cfg.discovery_window_s * SECOND), {}, keep)
    return graded(out.select("case_key", F.col("grp").alias("entity"), "categories", "commands", F.col("anchor").alias("first_us"), "last_us"),
                  F.when(F.size("categories") >= 3, "high").otherwise("medium"), "medium")


@rule("win", "EVTX-COLLECT-SENSITIVE-01", "Sensitive path touched", "Collection", ["T1005", "T1555"])
def collect_sensitive(ev, cfg):
    rows = wf.with_command_text(ev.where(F.col("is_command") | wf.sysmon(11)))
    rows = rows.withColumn("hay", F.concat_ws(" ", "command_text", "target_filename")).where(tx.any_hit(F.col("hay"), cfg.sensitive_data_paths))
    return graded(rows.select("event_id", "case_key", tx.first_hit(F.col("hay"), cfg.sensitive_data_paths).alias("matched_path"),
                              "command_line", "target_filename", F.col("t_us").alias("first_us")), "high", "medium")


def _command_hits(ev, words, with_image: bool):
    rows = wf.with_command_text(ev.where(F.col("is_command")))
    hay = F.concat_ws(" ", "image", "command_text") if with_image else F.col("command_text")
    return rows.withColumn("hay", hay).where(tx.any_hit(F.col("hay"), words))


@rule("win", "EVTX-COLLECT-ARCHIVE-01", "Data packed into an archive", "Collection", ["T1560.001"])
def collect_archive(ev, cfg):
    rows = _command_hits(ev, cfg.archive_staging_commands, True)
    return graded(rows.select("event_id", "case_key", "command_line", F.col("t_us").alias("first_us")), "medium", "low")


@rule("win", "EVTX-COLLECT-CREDSEARCH-01", "Search for passwords in files", "Credential Access", ["T1552.001"])
def collect_credential_search(ev, cfg):
    rows = _command_hits(ev, cfg.credential_keyword_commands, False)
    return graded(rows.select("event_id", "case_key", "command_line", F.col("t_us").alias("first_us")), "high", "medium")


@rule("win", "EVTX-COLLECT-STEALER-01", "One process touched several data stores", "Collection", ["T1005", "T1555.003"])
def collect_stealer(ev, cfg):
    rows = ev.where(wf.sysmon(11) & tx.any_hit(F.col("target_filename"), cfg.sensitive_data_paths))
    hit = tx.first_hit(F.col("target_filename"), cfg.sensitive_data_paths)
    rows = rows.select("event_id", "case_key", "image", "t_us", F.array(F.struct(hit.alias("cat"), hit.alias("cmd"))).alias("pairs"))
    out = _first_batch(rows, ["case_key", "image"], int(cfg.stealer_window_s * SECOND), {},
                       F.col("n_cat") >= cfg.stealer_distinct_category_threshold)
    return graded(out.select("case_key", "image", "categories", F.col("anchor").alias("first_us"), "last_us"), "critical", "medium")


DESTINATION = ["DestinationIp", "DestinationHostname", "QueryName"]


@rule("win", "EVTX-C2-TRANSFER-01", "Tool downloaded from the command line", "Command and Control", ["T1105"])
def c2_transfer(ev, cfg):
    rows = _command_hits(ev, cfg.tool_transfer_patterns, True).select(
        "event_id", "case_key", "process_id", "t_us", "command_line", tx.first_hit(F.col("hay"), cfg.tool_transfer_patterns).alias("pattern"))
    net = ev.where((wf.sysmon(3) | wf.sysmon(22)) & (F.col("process_id") != "")).select(
        "event_id", "case_key", "process_id", "t_us", wf.field(*DESTINATION).alias("dest"))
    window = int(cfg.transfer_to_network_window_s * SECOND)
    out = first_in_interval(rows, net, ["case_key", "process_id"], window, ["dest"], 0, "t_us")
    out = out.select("event_id", "case_key", "command_line", "pattern", F.col("match.event_id").alias("network_event"),
                     F.col("match.dest").alias("destination"), F.col("t_us").alias("first_us"))
    grade = F.when(F.col("network_event").isNotNull(), "high").otherwise("medium")
    return graded(out, grade, grade)


@rule("win", "EVTX-C2-SUSPICIOUS-NETWORK-01", "Connection from a throw-away directory", "Command and Control", ["T1071"])
def c2_suspicious_network(ev, cfg):
    low = wf.norm_path(F.col("image"))
    rows = ev.where((wf.sysmon(3) | wf.sysmon(22)) & ~wf.ends_with(low, cfg.known_benign_network_images)
                    & tx.any_hit(low, cfg.suspicious_network_process_dirs))
    return graded(rows.select("event_id", "case_key", "image", wf.field(*DESTINATION).alias("destination"),
                              F.col("t_us").alias("first_us")), "medium", "low")


# --- user-level queries ---------------------------------------------------------------

def process_nodes(ev: DataFrame) -> DataFrame:
    """One row per process key, the last creation wins."""
    guid, parent_guid = wf.field("ProcessGuid"), wf.field("ParentProcessGuid")
    key = (F.when(guid != "", guid).when(F.col("process_id") != "", F.concat(F.lit("pid:"), F.col("process_id")))
           .otherwise(F.concat(F.lit("idx:"), F.col("event_id").cast("string"))))
    parent = (F.when(parent_guid != "", parent_guid)
              .when(F.col("parent_process_id") != "", F.concat(F.lit("pid:"), F.col("parent_process_id"))))
    return ev.where("is_process_create").select("event_id", "case_key", "image", key.alias("key"), parent.alias("parent"))


def ancestry(nodes: DataFrame) -> DataFrame:
    """Ancestors of every process, nearest first, to the root and cycle-safe.

    One hash join per level against the key table, until no chain grows. Each level is a written table, and rows whose
    chain ended drop out of the joins.
    """
    by_key = nodes.groupBy("case_key", "key").agg(F.max_by(F.struct("parent", "image"), "event_id").alias("n")).select(
        "case_key", F.col("key").alias("up"), F.col("n.parent").alias("next"), F.col("n.image").alias("up_image"))
    chain = nodes.select("event_id", "case_key", F.col("parent").alias("up"), F.array().cast("array<string>").alias("path"),
                         F.array().cast("array<string>").alias("images"))
    done = None
    while True:
        step = chain.join(by_key, ["case_key", "up"], "left")
        grow = F.col("up_image").isNotNull() & ~F.array_contains("path", F.col("up"))
        step = staged(step.select("event_id", "case_key", F.when(grow, F.col("next")).alias("up"),
                                  F.when(grow, F.concat("path", F.array("up"))).otherwise(F.col("path")).alias("path"),
                                  F.when(grow, F.concat("images", F.array("up_image"))).otherwise(F.col("images")).alias("images"),
                                  F.coalesce(grow, F.lit(False)).alias("grew")))
        ended = step.where("NOT grew").drop("grew")
        done = ended if done is None else done.unionByName(ended)
        chain = step.where("grew").drop("grew")
        if chain.isEmpty():
            break
    return done.select("event_id", "case_key", F.size("path").alias("depth"), "path", "images",
                        F.try_element_at("path", F.lit(-1)).alias("root"))


def session_events(ev: DataFrame, logon_id: str) -> DataFrame:
    """All events of one logon session."""
    return ev.where((F.col("logon_id") != "") & (F.col("logon_id") == wf.norm_logon_id(F.lit(logon_id))))


def overview(ev: DataFrame) -> DataFrame:
    """Counts by event code, channel and host plus the time range, as (kind, key, n) rows."""
    counts = ev.groupingSets([["code"], ["channel"], ["computer"]], "code", "channel", "computer").agg(
        F.grouping_id().alias("g"), F.count(F.lit(1)).alias("n"))
    named = counts.select(
        F.when(F.col("g") == 3, "event_id").when(F.col("g") == 5, "channel").otherwise("host").alias("kind"),
        F.coalesce(F.col("code").cast("string"), "channel", "computer").alias("key"), "n")
    total = ev.agg(F.count(F.lit(1)).alias("events"), F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"),
                   F.count_if(F.col("ts_us").isNull()).alias("untimed"))
    totals = total.select(F.expr("stack(4, 'events', events, 'first_us', first_us, 'last_us', last_us, 'untimed', untimed) AS (key, n)"))
    return named.where(F.col("key").isNotNull() & (F.col("key") != "")).unionByName(totals.select(F.lit("total").alias("kind"), "key", "n"))


def tactic_order(findings: DataFrame) -> DataFrame:
    pos = F.array_position(F.array(*[F.lit(t) for t in TACTICS]), F.col("category"))
    return findings.orderBy(F.desc("severity_rank"), F.when(pos == 0, len(TACTICS) + 1).otherwise(pos), "finding_id")


def timeline(findings: DataFrame, items: DataFrame) -> DataFrame:
    """Findings with at_us, the time of their earliest timed event, in that order and untimed last. The time is
    taken from the events behind a finding, and from the finding itself where none is timed."""
    first = items.where((F.col("kind") == "event") & (F.col("ts_us") > 0)).groupBy("finding_id").agg(F.min("ts_us").alias("_at"))
    at = F.coalesce("_at", F.when(F.col("first_us") > 0, F.col("first_us")))
    return findings.join(first, "finding_id", "left").withColumn("at_us", at).drop("_at").orderBy(F.asc_nulls_last("at_us"), "finding_id")
