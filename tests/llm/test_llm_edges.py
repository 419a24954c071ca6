"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing column names."""

import os
import sys
from collections import Counter

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
from sentrylake.llm import audit, ctw, exactdedup, gam, maxsketch, mixing, packing, pii, queries, sharding, simhash, tensorhash, urlfilter, winnow  # noqa: E402

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, digest string, id string, score string, kind string, shard string, row string, key string"
LONG = "wörd " * 60_000
ROWS = [(1, "a b c d", "en", "src0"), (1, "a b c d", "en", "src0"), (2, None, None, None), (3, "", "en", "src1"), (None, "a b c d", "de", "src2"), (None, None, None, "src0"),
        (4, LONG, "en", "src0"), (5, " a\tb c  d\n", "fr", "src9"), (6, "call +1 (017) 555-7713 now 4539578763621486.", "en", "src4"), (7, "x" * 200_000, "en", "src5")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(d, t, lang, s, None, "x", "y", "z", "k", "s", "r", "q") for d, t, lang, s in ROWS], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def outputs(df):
    """Every operator over a table."""
    labels = df.select("doc_id", F.lit(1).alias("quality"), "text")
    model = gam.fit(df, "doc_id", "text", labels, "doc_id", "quality", F.lit(True))
    return {
        "mix": queries.mixed(df), "shard": sharding.shard(df, "doc_id", "text", [1.0, 2.0]), "pack": packing.packed(df, "doc_id", "text", packing.encoder(queries.tokenizer_path()), 2),
        "winnow": winnow.fingerprints(df, "doc_id", "text"), "edited": winnow.edited_likeness(df, "doc_id", "text"), "exact": exactdedup.exact_copies(df, "doc_id", "text"),
        "drop": exactdedup.drop_copies(df, "doc_id", "text"), "ctw": ctw.score(df, "doc_id", "text"), "near": simhash.near_groups(df, "doc_id", "text"),
        "one": simhash.one_of_each(df, "doc_id", "text"), "pii": pii.personal_data(df, "doc_id", "text"),
        "sets": tensorhash.near_sets(df, "doc_id", "text"), "search": maxsketch.search(df, "doc_id", "text", df, "id", "text"),
        "audit": audit.audit(df, "doc_id", "text", "source", labels, "doc_id", "quality", "quality"),
        "good": gam.scored(df.select("doc_id", "text"), "text", model), "keep": gam.keep_good(df, "doc_id", "text", labels, "doc_id", "quality", F.lit(True)),
    }


def test_empty(none):
    for name, df in outputs(none).items():
        assert df.count() == 0, name


def test_odd_rows(docs):
    got = {k: v.collect() for k, v in outputs(docs).items()}
    for name in ("shard", "winnow", "edited", "exact", "ctw", "near", "pii", "good", "sets"):
        assert Counter(r.doc_id for r in got[name]) == Counter(d for d, *_ in ROWS), name
    assert got["drop"][0].__fields__ == got["keep"][0].__fields__ == got["one"][0].__fields__ == docs.columns
    # Five texts are "abcd" without white space; the one with most code points stays. Three are empty.
    kept = Counter((r.text_sha256, r.kept) for r in got["exact"])
    assert all(kept[h, True] == 1 for h in {r.text_sha256 for r in got["exact"]})
    assert {r.keep_id for r in got["exact"] if r.group_size == 4} == {5} and {r.keep_id for r in got["exact"] if r.group_size == 3} == {2}
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got["drop"]) == [(False, d) for d in (2, 4, 5, 6, 7)]
    assert {r.component_id for r in got["near"] if r.fingerprint == "0" * 16} == {2}
    assert sum(r.length for r in got["pack"] if r.id == 4) > 60_000 if "id" in got["pack"][0] else True
    assert {r.doc_id: r.n_phone for r in got["pii"]}[6] == 1
    slots = Counter(r.shard for r in got["shard"])
    assert sorted((r.shard, r.slot) for r in got["shard"]) == [(s, i) for s in sorted(slots) for i in range(slots[s])]
    assert all(r.score <= 0 and r.n_tokens >= 1 for r in got["ctw"])
    assert all(0 <= r.near_edited <= 1 for r in got["edited"])


def test_urls(spark):
    rules = spark.createDataFrame(queries.RULES + [(None, None, "block"), ("e.org", "/a%", "allow")], "host string, path string, verdict string")
    urls = [(1, None), (2, ""), (3, "no scheme"), (4, "http://A.E.Org/a%b?x"), (4, "http://A.E.Org/a%b?x"), (5, "x://net"), (6, "x://net/"), (7, "x://subnet/"), (8, "a://b.net/c://org/fr/"),
            (9, "x://www.example.net/en/1#y"), (None, "x://example.com/de/")]
    df = spark.createDataFrame([(i, u, "clash") for i, u in urls], "page_id bigint, url string, h string")
    got = Counter((r.page_id, r.url_host, r.url_path, r.url_rule, r.url_verdict) for r in urlfilter.judge(df, "url", rules).collect())
    assert got == Counter({(1, "", "", "", "block"): 1, (2, "", "", "", "block"): 1, (3, "", "", "", "block"): 1, (4, "a.e.org", "/a%b", "e.org/a%", "allow"): 2, (5, "net", "", None, "allow"): 1,
                           (6, "net", "/", "net/", "block"): 1, (7, "subnet", "/", None, "allow"): 1, (8, "b.net", "/c://org/fr/", "net/", "block"): 1,
                           (9, "www.example.net", "/en/1", "example.net/en/", "allow"): 1, (None, "example.com", "/de/", "example.com/de/", "block"): 1})
    assert urlfilter.judge(df.limit(0), "url", rules).count() == 0


def test_budget_runs_down_the_tree(spark):
    leaves = spark.createDataFrame([("a", "x", "1", 10), ("a", "x", "2", 100), ("a", "y", "3", 100), ("b", "x", "4", 1000)], "domain string, lang string, source string, available bigint")
    got = {r.source: r.quota for r in mixing.quotas(leaves, ["domain", "lang", "source"], {"a": 1, "b": 1}, F.lit(200), 1.0, 1).collect()}
    # a has 100: x and y 50 each; source 1 can give 10 only, its sibling takes the rest before y or b do.
    assert got == {"1": 10, "2": 40, "3": 50, "4": 100}
    got = {r.source: r.quota for r in mixing.quotas(leaves, ["domain", "lang", "source"], {"a": 9, "b": 1}, F.lit(600), 1.0, 1).collect()}
    assert got == {"1": 10, "2": 100, "3": 100, "4": 390}


def test_another_shard_takes_only_into_itself(spark):
    ids = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    rows = sharding.shard(ids, "doc_id", "text", [1.0, 1.0, 2.0]).collect()
    assert all(r.grown_shard in (r.shard, 3) for r in rows)
    share = Counter(r.shard for r in rows)
    assert abs(share[2] / 4000 - 0.5) < 0.04 and abs(share[0] / 4000 - 0.25) < 0.04


def test_crowded_lists_lose_no_link(spark):
    """Lists that are cut finer give the same groups."""
    import random
    r = random.Random(5)
    centres = [r.getrandbits(64) for _ in range(4)]
    prints = sorted({c ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 6))) for c in centres for _ in range(60)})
    df = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fingerprint bigint")
    root = {p: p for p in prints}
    changed = True
    while changed:
        changed = False
        for a in prints:
            low = min(root[b] for b in prints if bin(a ^ b).count("1") <= 3)
            if low < root[a]:
                root[a], changed = low, True
    want = Counter(Counter(root.values()).values())
    for limit in (4096, 5):
        got = Counter(x.component for x in simhash.grouped(df, limit).collect())
        assert Counter(got.values()) == want


def test_contexts_find_what_patterns_miss(spark):
    texts = [(i, f"please reach me at user{i}@mail.example.com today or tomorrow") for i in range(30)] + [(99, "please reach me at user99(at)mail.example today or tomorrow"), (100, "room 4411 is here")]
    got = {r.doc_id: r for r in pii.personal_data(spark.createDataFrame(texts, "doc_id bigint, text string"), "doc_id", "text").collect()}
    start = texts[-2][1].index("user99")
    assert got[99].spans == f"email:{start}:{start + len('user99(at)mail.example')}" and got[99].base == "" and got[99].n_email == 0
    assert got[100].spans == "" and got[3].spans == got[3].base != ""
