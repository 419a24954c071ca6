"""Process trees deeper than ten levels, with a cycle and an orphan."""

from sentrylake.operators import win_rules as wr


def test_chains_reach_their_root(spark):
    deep = [(i, "c", f"img{i}", f"k{i}", f"k{i - 1}" if i else None) for i in range(26)]
    rows = deep + [(100, "c", "a", "x", "y"), (101, "c", "b", "y", "x"), (102, "c", "o", "z", "gone")]
    df = spark.createDataFrame(rows, "event_id bigint, case_key string, image string, key string, parent string")
    got = {r.event_id: r for r in wr.ancestry(df).collect()}
    assert len(got) == len(rows)
    for i in range(26):
        assert got[i].depth == i and got[i].root == ("k0" if i else None)
        assert got[i].path == [f"k{j}" for j in range(i - 1, -1, -1)]
    assert got[100].path == ["y", "x"] and got[101].path == ["x", "y"] and got[102].path == []
