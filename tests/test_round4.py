"""Work that is done once: lexicon searches, indicators behind a range sort, fields of a record."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from sentrylake.operators import exports as ex
from sentrylake.operators import mail_rules as mr
from sentrylake.functions import url as ul
from sentrylake.sources import netlogs as nl


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_lexicons_are_searched_without_lambdas_and_count_as_defined(spark):
    rnd = random.Random(5)
    words = mr.URGENCY + mr.THREAT + mr.CREDENTIAL + mr.FINANCIAL + mr.BEC + mr.GREETINGS + mr.ACTIONS + mr.MISSPELLINGS + mr.TITLES
    rows = [(i, "", "", "", "", rnd.choice(["Urgent!!", "", "INVOICE PAYMENT"]), " ".join(rnd.choices(words, k=rnd.randint(0, 9))).title(), rnd.choice(["Dear Customer é", "xnetlfix", "(netlfix)", None])) for i in range(60)]
    rows.append((99, "", "", "", "", None, None, None))
    m = spark.createDataFrame(rows, "message_id int, from_display string, from_address string, reply_to string, return_path string, subject string, body_text string, body_html string")
    out = mr.language_features(m)
    assert "lambda" not in plan(out)
    got = {r.message_id: r for r in out.collect()}
    for r in rows:
        body = "\n".join([r[6] or "", r[7] or ""])
        both = "\n".join([r[5] or "", body]).lower()
        for name, listed, text in (("urgency", mr.URGENCY, both), ("threat", mr.THREAT, both), ("credential", mr.CREDENTIAL, both), ("financial", mr.FINANCIAL, both),
                                   ("bec", mr.BEC, both), ("greeting", mr.GREETINGS, body.lower()), ("actions", mr.ACTIONS, both)):
            assert got[r[0]][name] == sum(w in text for w in listed), (name, r)
        assert got[r[0]].executive == any(w in both for w in mr.TITLES)
        padded, alnum = f" {both} ", set("abcdefghijklmnopqrstuvwxyz0123456789")
        alone = [w for w in mr.MISSPELLINGS if any(padded.startswith(w, i) and padded[i - 1] not in alnum and padded[i + len(w)] not in alnum for i in range(1, len(both) + 1))]
        assert got[r[0]].misspelled == len(alone)


def test_indicators_behind_a_range_sort_are_derived_once(spark):
    for export in (ex.pattern_rows, ex.blocklist):
        seen = spark.sparkContext.accumulator(0)

        def mark(v):
            seen.add(1)
            return v
        rows = spark.createDataFrame([("urls", f"hxxp[://]x{i}[.]example") for i in range(50)], "kind string, value string")
        iocs = rows.select("kind", F.udf(mark, "string")("value").alias("value")).repartition(3)
        assert export(iocs).count() == 50
        out = export(iocs)
        seen.value = 0
        kept = [r.value for r in out.collect()]
        assert len(set(kept)) == 50
        assert seen.value == 0  # written before the sort, which read the table only


def test_links_in_running_text(spark):
    texts = ["see HTTP://A.example/x, or WWW.b.example/y", "no link", "awww.c.example", "ftp://d.example:21/z (www2.e.example)", None]
    m = spark.createDataFrame([(i, t, None, []) for i, t in enumerate(texts)], "message_id int, body_text string, body_html string, embedded_urls array<string>")
    got = {(r.message_id, r.url) for r in ul.extract(m).collect()}
    assert got == {(0, "HTTP://A.example/x"), (0, "http://WWW.b.example/y"), (3, "ftp://d.example:21/z")}


def test_the_time_of_a_record_is_read_once(spark):
    rows = [(1, "1700000000", '{"src_ip": "1.2.3.4", "id.resp_h": "5.6.7.8", "destination": "{\\"port\\": 80}", "user": "-"}'), (2, "bad", '{"ts": "2024-01-02T03:04:05Z", "user": "u", "status": "ok"}'), (3, "", "{}"), (4, None, None)]
    df = spark.createDataFrame(rows, "event_id int, timestamp string, message string")
    out = nl.parse_records(df)
    assert plan(out).count("dd/MM/yyyy") == len(nl.TIME_KEYS)
    got = {r.event_id: r for r in out.collect()}
    assert set(got) == {1, 2}
    assert (got[1].ts_us, got[1].kind, got[1].src_ip, got[1].dst_ip, got[1].dst_port, got[1].user) == (1700000000000000, "network_flow", "1.2.3.4", "5.6.7.8", 80, None)
    assert (got[2].kind, got[2].action, got[2].user) == ("auth", "success", "u")
