"""Items on demand, votes that don't gather lines, guards of the grammars, logs written by all tasks."""

import glob

from pyspark.sql import functions as F
from test_rules import CFG, auth, frame

from sentrylake.operators import rulebook as rb
from sentrylake.session import shared_folder
from sentrylake.sources import netlogs as nl
from sentrylake.workloads import ingest

LINES = ["2024-01-02 03:04:05 ALLOW TCP 10.0.0.1:5 -> 10.0.0.2:80 bytes=7", " \t2024-01-02T03:04:05Z DENY UDP 10.0.0.1:5->10.0.0.2:53", "->2024-01-02 03:04:05 ALLOW TCP 1.1.1.1:1 -> 2.2.2.2:2",
         "2024-01-02 03:04:05 198.51.100.7 bob FAIL assigned_ip=10.8.0.1", "TimeStamp=2024-01-02T03:04:05Z src_ip=10.0.0.1 action=allow", "x=1 DATE='2024-01-02 03:04:05'", "time=never a=b", "a=b c=d",
         '{"ts": 1700000000, "src_ip": "10.0.0.1", "dst_ip": "10.0.0.2"}', "{broken", "2024-01-02 03:04:05 [**] [1:5:1] Odd [**] [Priority: 2] {TCP} 10.0.0.1:1 -> 10.0.0.2:2", "2024-13-99 99:99:99 ALLOW TCP 1.1.1.1:1 -> 2.2.2.2:2", "", None]


def test_items_are_made_when_asked_for(spark, monkeypatch):
    made, plain = [], rb.as_items
    monkeypatch.setattr(rb, "as_items", lambda out, rows, r: made.append(r.name) or plain(out, rows, r))
    got = rb.run_all("net", frame(spark, [auth("203.0.113.1", "a", i) for i in range(15)]), CFG, ["cred_bruteforce"])
    assert got.findings.count() == 1 and made == []
    assert got.items.where("kind = 'event'").count() == 15 and got.items.where("kind = 'users'").count() == 1
    assert made == ["cred_bruteforce"]


def test_short_readings_agree_with_events(spark):
    rows = spark.createDataFrame([(x,) for x in LINES], "line string")
    for g, fn in nl.PARSERS.items():
        whole = fn(F.col("line"))
        for r in rows.select("line", whole.isNotNull().alias("a"), nl._reads(fn, F.col("line")).isNotNull().alias("b"), whole["ts_us"].alias("t"), nl._time(fn, F.col("line")).alias("u")).collect():
            assert (r.a, r.t) == (r.b, r.u), (g, r.line)
    read = {g: [r[0] for r in rows.select(nl._reads(fn, F.col("line")).isNotNull()).collect()] for g, fn in nl.PARSERS.items()}
    assert [i for i, x in enumerate(read["firewall"]) if x] == [0, 1, 11] and [i for i, x in enumerate(read["kv"]) if x] == [4, 5]


def test_lines_are_not_gathered_by_source(spark):
    lines = spark.createDataFrame([("a", x) for x in LINES[:5]] + [(None, LINES[0])], "file string, line string")
    plan = nl.parse_mixed(lines, "file")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_logs_are_written_by_all_tasks(spark, tmp_path):
    rows = spark.range(400).selectExpr("id AS event_id", "timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, id) AS ts", "id % 9 AS user_id",
                                       "element_at(array('view', 'click', 'error', 'signup'), CAST(id % 4 AS INT) + 1) AS event_type", "1.0D AS value", "concat('{\"k\": ', id % 50, '}') AS props")
    rows.write.parquet(f"{tmp_path}/events.parquet")
    before = set(glob.glob(f"{shared_folder(spark)}/logs-*"))
    got = {r.case_key: (r.events, r.rejects, r.status) for r in ingest.reading(spark, str(tmp_path)).collect()}
    assert got == {"good": (400, 0, "good"), "damaged": (342, 58, "damaged"), "unreadable": (0, 80, "unreadable"), "empty": (0, 0, "empty")}
    (path,) = set(glob.glob(f"{shared_folder(spark)}/logs-*")) - before
    assert len(glob.glob(f"{path}/case=good/*.txt")) > 1
