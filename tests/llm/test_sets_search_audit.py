"""Tensored min-hash groups, max-sketch search and the filter audit against plain definitions."""

import math
import os
import random
import re
import sys
from collections import Counter
from itertools import permutations

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
from sentrylake.llm import audit, jaccard, maxsketch, tensorhash  # noqa: E402

LOWER = {c: c + 32 for c in range(65, 91)}


def grams(text, width=2):
    ws = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(ws[i:i + width]) for i in range(max(1, len(ws) - width + 1))} if ws else set()


def components(texts, width=2):
    """texts: (id, text), ids not null. The smallest id that pairs at 0.8 or more reach, by brute force."""
    sets = [(d, grams(t, width)) for d, t in texts]
    low = {i: d for i, (d, _) in enumerate(sets)}
    changed = True
    near = [[j for j, (_, y) in enumerate(sets) if x and y and 100 * len(x & y) >= 80 * len(x | y)] for _, x in sets]
    while changed:
        changed = False
        for i, others in enumerate(near):
            best = min([low[i], *(low[j] for j in others)])
            changed |= best < low[i]
            low[i] = best
    return Counter((d, len(s), low[i], low[i] == d) for i, (d, s) in enumerate(sets))


def edited(r, core, most, tag):
    out = list(core)
    for k, at in enumerate(r.sample(range(len(core)), r.randint(0, most))):
        out[at] = f"{tag}x{k}"
    return " ".join(out)


@pytest.mark.parametrize("crowd", [1024, 16])
def test_groups_of_equal_sets(spark, monkeypatch, crowd):
    """Groups above, at and just under the similarity, and chains; longer lists are met in blocks."""
    monkeypatch.setattr(jaccard, "CROWD", crowd)
    r = random.Random(11)
    texts = [(900, ""), (901, " \t"), (902, "one"), (903, "ONE"), (904, "one two"), (905, "one two three"), (906, "Ünder über"), (906, "Ünder über")]
    for group, most in enumerate((3, 7, 12, 25)):
        core = [f"g{group}w{i}" for i in range(120)]
        texts += [(1000 * group + 1000 + i, edited(r, core, most, f"d{group}_{i}_")) for i in range(60)]
    r.shuffle(texts)
    df = spark.createDataFrame([(d, t, "k", 1) for d, t in texts], "doc_id bigint, text string, key string, n int").repartition(5)
    got = Counter((x.doc_id, x.n_shingles, x.component_id, x.kept) for x in tensorhash.near_sets(df, "doc_id", "text").collect())
    assert got == components(texts)


def test_null_ids_and_texts(spark):
    rows = [(None, "a b c"), (None, "A b c"), (7, "a b c"), (8, None), (None, None), (None, "only one row")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = Counter((x.doc_id, x.n_shingles, x.component_id, x.kept) for x in tensorhash.near_sets(df, "doc_id", "text").collect())
    assert got == Counter([(None, 2, 7, False), (None, 2, 7, False), (7, 2, 7, True), (8, 0, 8, True), (None, 0, None, True), (None, 2, None, True)])


def test_chance_and_bound():
    assert tensorhash.missed(0.8) < 7e-6 and tensorhash.missed(0.9) < 1e-8
    r = random.Random(1)
    import numpy as np
    for _ in range(200):
        x, y = (np.unique(np.array([r.randrange(1 << 64) >> (0 if r.random() < 0.5 else 58) for _ in range(r.choice([3, 90, 9000]))], np.uint64)) for _ in range(2))
        a, b = jaccard.table(x), jaccard.table(y)
        bound = sum(min(i << a[0], j << b[0]) for i, j in zip(a[1:], b[1:]))
        assert bound >= len(np.intersect1d(x, y))


def test_shingles_count_like_strings():
    r = random.Random(4)
    for _ in range(100):
        text = " ".join(r.choice("aA bB c é\u00a0x dd".split(" ")) for _ in range(r.randint(0, 60)))
        for width in (1, 2, 5):
            assert len(jaccard.shingles(text.encode(), width)) == len(grams(text, width))


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def ranked(docs, items, k):
    """Plain scores of every document under every item."""
    found = [(d, Counter(x.translate(LOWER) for x in TERM.findall(t or ""))) for d, t in docs]
    n_docs, total = sum(bool(c) for _, c in found), sum(c.total() for _, c in found)
    df = Counter(t for _, c in found for t in c)
    out = []
    for item, text in items:
        scores = []
        for d, c in found:
            m = 100 - 25 + 25 * c.total() * n_docs // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t in (x.translate(LOWER) for x in TERM.findall(text or "")) if c[t])
            if s > 0:
                scores.append((-s, d is None, d or 0, d))
        out += [(item, i + 1, d, -s) for i, (s, _, _, d) in enumerate(sorted(scores, key=lambda x: x[:3])[:k])]
    return Counter(out)


def test_search(spark):
    """Several blocks of items, ties, repeated rows and items, nulls, and a narrow sketch full of collisions."""
    r = random.Random(2)
    vocabulary = ["w%d" % int(r.paretovariate(0.6)) for _ in range(400)] + ["É", "x_y", "Don't", "日本"]
    docs = [(i, " ".join(r.choice(vocabulary) for _ in range(r.randint(1, 60)))) for i in range(300)] + [(None, "w1 w2 É"), (None, None), (5, ""), (301, "w1 w2"), (302, "W2, w1!"), (302, "W2, w1!")]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(r.randint(1, 9)))) for i in range(20)] + [(3, "w1 w2 w2"), (None, "É unseen"), (50, None), (51, "unseen"), (52, "!")]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").withColumnRenamed("doc_id", "score").repartition(4)
    queries = spark.createDataFrame(items, "item_id bigint, text string")
    want = ranked(docs, items, 7)
    for width, most in ((4096, 200_000), (16, 12)):
        got = maxsketch.search(frame, "score", "text", queries, "item_id", "text", 7, width, most).collect()
        assert Counter((x.item_id, x["rank"], x.doc_id, x.score) for x in got) == want


def test_few_documents_are_scored():
    """Bounds leave most documents unscored."""
    r = random.Random(3)
    docs = [(i, Counter(f"t{int(r.paretovariate(0.5))}".encode() for _ in range(50))) for i in range(2000)]
    total = sum(c.total() for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    query = {t: maxsketch.weight(2000, df[t]) for t in list(docs[77][1])[:20]}
    searcher = maxsketch.Searcher([query], 2000, total, 5, 4096)
    for at in range(0, 2000, 256):
        searcher.add(docs[at:at + 256])
    assert searcher.best[0].rows[0][3] == 77 and searcher.scored < 600


def audited(rows, labels):
    """Each order applied to each row."""
    fails, first = [], {}
    for d, t, _ in rows:
        if d is not None:
            first[t or ""] = min(first.get(t or "", d), d)
    for d, t, part in rows:
        t = t or ""
        ws = re.findall(r"[^\x20\x09-\x0D]+", t)
        again = t in first and (d is None or first[t] < d)
        fails.append((part or "", [len(ws) < 50, 100 * len(set(ws)) < 65 * len(ws), 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t), bool(set(t) & set("#$%&*|")), again],
                      any(x == d and q == 1 for x, q, _ in labels if d is not None), any(x == d and q == 1 for x, _, q in labels if d is not None)))
    out = {}
    for part in {p for p, *_ in fails}:
        mine = [f for f in fails if f[0] == part]
        shapley = Counter()
        for order in permutations("ABCDE"):
            left = list(mine)
            for step, f in enumerate(order, 1):
                k = "ABCDE".index(f)
                gone = [x for x in left if x[1][k]]
                failing = [x for x in mine if x[1][k]]
                left = [x for x in left if not x[1][k]]
                shapley[f] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), len(failing) - len(gone), sum(sum(x[1]) == 1 for x in failing), sum(x[2] for x in gone), sum(x[3] for x in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def test_audit(spark):
    r = random.Random(6)
    rows = []
    for i in range(300):
        text = " ".join(r.choice(["a", "bb", f"w{r.randrange(90)}", "LOUD", "é"]) for _ in range(r.choice([3, 49, 50, 51, 80]))) + r.choice(["", "", "#", " |"])
        rows.append((r.choice([i, i, i, None]), r.choice([text, text, None, "", "same text again"]), r.choice(["s0", "s0", "s1", None, ""])))
    rows += [(7, "same text again", "s0"), (7, "same text again", "s0")]
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1, None])) for i in range(0, 300, 2)] + [(4, 1, 0), (None, 1, 1)]
    df = spark.createDataFrame([(d, t, p, 1, 2) for d, t, p in rows], "doc_id bigint, text string, source string, code int, n int").repartition(3)
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = audit.audit(df, "doc_id", "text", "source", marks, "doc_id", "quality", "toxic").collect()
    assert {(x.part, x.filter_order, x.step): tuple(x[m] for m in audit.MEASURES) for x in got} == audited(rows, labels)
