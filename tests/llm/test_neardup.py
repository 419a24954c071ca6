"""The pipeline's near copies against brute force over exact five-word Jaccard."""

import os
import random
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
import numpy as np  # noqa: E402
from sentrylake.llm import jaccard, pipeline, tensorhash  # noqa: E402

SF = "/root/testdata/sf0.01"


def grams(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {" ".join(ws[i:i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set()


def kept(texts):
    """The smallest id of each component of the pairs at 0.8 or more."""
    sets = {d: grams(t) for d, t in texts.items()}
    root = {d: d for d in texts}
    def find(d):
        while root[d] != d:
            d = root[d]
        return d
    ids, pairs = sorted(texts), 0
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            x, y = sets[a], sets[b]
            if 5 * min(len(x), len(y)) >= 4 * max(len(x), len(y)) and 5 * len(x & y) >= 4 * len(x | y):
                pairs += 1
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return sorted({find(d) for d in ids}), pairs


def stage(spark, df):
    return sorted(r.doc_id for r in pipeline.near_copies(spark, df, SF).collect())


def test_near_copies_of_the_documents(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    want, pairs = kept({r.doc_id: r.text for r in df.collect()})
    assert pairs > 12
    assert stage(spark, df) == want


def test_crowded_and_edge_texts(spark, monkeypatch):
    """Members just above and below the similarity; lists are met in blocks of 16."""
    monkeypatch.setattr(jaccard, "CROWD", 32)
    r = random.Random(3)
    core = [f"w{i}" for i in range(200)]
    texts = {0: None, 1: "", 2: "a b", 3: "A  b", 4: "a b c"}
    for d in range(10, 130):  # one group with near misses, and its members' members
        ws = list(core)
        for at in r.sample(range(200), r.randint(0, 7)):
            ws[at] = f"x{d}"
        texts[d] = " ".join(ws)
    want, _ = kept(texts)
    assert 1 < len(want) < len(texts)
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    df = spark.createDataFrame([(d, t, None, None, None) for d, t in texts.items()], schema).repartition(3)
    assert stage(spark, df) == want


def test_a_pair_of_two_large_lists_is_asked_in_one(spark):
    """Three like nodes in two lists: each pair is one row; a node that is in one large list only asks there."""
    hashes = np.arange(1, 50, dtype=np.uint64) << np.uint64(56)
    rows = [(key, 0, 0, 0, node, len(hashes), jaccard.table(hashes), node, None, big)
            for node, big in ((b"a", [5, 7]), (b"b", [5, 7]), (b"c", [7])) for key in big]
    frame = spark.createDataFrame(rows, "key bigint, i int, j int, block int, node binary, n bigint, table binary, c binary, no array<binary>, big array<bigint>")
    asked = jaccard._asked(frame, 64, 80, 100, 8)
    assert sorted((bytes(r.a), bytes(r.b)) for r in asked.collect()) == [(b"a", b"b"), (b"a", b"c"), (b"b", b"c")]


def test_lists_of_one_shuffle_say_early(spark):
    """A key's last bit says that its table is of the first repetition; nodes without company and without marks have no list."""
    marks = {b"a": tensorhash.halves(np.arange(50, dtype=np.uint64)), b"b": tensorhash.halves(np.arange(50, dtype=np.uint64)),
             b"c": tensorhash.halves(np.arange(500, 550, dtype=np.uint64)), b"d": b""}
    found = tensorhash.lists(spark.createDataFrame([*marks.items()], "node binary, marks binary")).collect()
    tables = tensorhash.SIDE ** 2 * tensorhash.TIMES
    assert all(r.early == (r.key % 2 == 1) for r in found) and {bytes(r.node) for r in found} == {b"a", b"b"}
    assert len(found) == 2 * tables and sum(r.early for r in found) == 2 * tensorhash.SIDE ** 2


def test_tables_of_half_bytes_and_bytes():
    r = np.random.default_rng(1)
    few, many = r.integers(0, 1 << 63, 300, dtype=np.uint64) << np.uint64(1), np.arange(100_000, dtype=np.uint64) << np.uint64(55)
    same = np.arange(40, dtype=np.uint64)
    tables = [jaccard._short(jaccard.table(x)) for x in (few, same, many, np.empty(0, np.uint64))]
    assert [len(t) for t in tables] == [128, 257, 257, 128]
    counts = jaccard._counts(tables)
    for row, x in zip(counts, (few, same, many)):
        exact = np.bincount((x >> np.uint64(56)).astype(np.int64), minlength=256)
        assert (row >= exact).all() and (exact.max() > 255 or (row == exact).all())
    assert not counts[3].any()


def test_a_list_with_nobody_left_to_ask_is_not_met_again(spark, monkeypatch):
    """Two texts that the tables rule out, and two that are asked once and fail: the latter's list alone is met in a third round."""
    def near(seed):
        r = random.Random(seed)
        ws = [f"w{r.random()}" for _ in range(100)]
        return " ".join(ws), " ".join("x" if i in (9, 19, 29, 39, 49, 59) else w for i, w in enumerate(ws))

    def allowed(x, y):
        counts, n = jaccard._counts([jaccard.table(x), jaccard.table(y)]).astype(int), len(x) + len(y)
        return 9 * np.minimum(*counts).sum() >= 4 * n > 9 * len(np.intersect1d(x, y))
    close = next(t for t in map(near, range(1000)) if allowed(*[jaccard.shingles(x.encode(), 2) for x in t]))
    texts = [*close, " ".join(f"a{i}" for i in range(90)), " ".join(f"b{i}" for i in range(90))]
    df = spark.createDataFrame([*enumerate(texts)], "id bigint, text string")
    rows = jaccard.nodes_of(df, "id", "text", 2, lambda _: b"")
    node = {r.id: r.node for r in rows.collect()}
    lists = spark.createDataFrame([(1, False, node[0]), (1, False, node[1]), (2, False, node[2]), (2, False, node[3])], "key bigint, early boolean, node binary")
    met, asked = [], jaccard._asked
    monkeypatch.setattr(jaccard, "_asked", lambda rows, *a: met.append(rows.count()) or asked(rows, *a))
    found = jaccard.linked(lists, rows, df, "text", 2, 80, 100).collect()
    assert met == [0, 4, 2] and all(r.node == r.component for r in found) and len(found) == 4
