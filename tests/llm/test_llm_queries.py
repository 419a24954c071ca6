"""The ten operators over the smallest tables, against SQL or a plain definition in Python."""

import hashlib
import json
import math
import os
import re
import sys
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import test_neardup as similar  # noqa: E402

from sentrylake.llm import ctw, packing, queries, winnow  # noqa: E402

SF = os.environ.get("LLM_TEST_SF", "/root/testdata/sf0.001")
SPACE = re.compile(r"[\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.fixture(scope="module")
def docs(con):
    return {d: t or "" for d, t in con.sql("SELECT doc_id, text FROM documents").fetchall()}


def rows(spark, name):
    return queries.QUERIES[name](spark, SF).collect()


def lower(text):
    return text.translate({c: c + 32 for c in range(65, 91)})


def words(text):
    return [w for w in SPACE.split(text) if w]


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_sql(spark, con, name):
    got = queries.QUERIES[name](spark, SF)
    want = con.sql(queries.ORACLE[name])
    order = sorted(want.columns)
    assert sorted(got.columns) == order
    have = sorted([tuple(r[c] for c in order) for r in got.collect()], key=str)
    assert have == sorted([tuple(r[want.columns.index(c)] for c in order) for r in want.fetchall()], key=str)


def test_winnowing(spark, docs):
    got = {r.doc_id: r for r in rows(spark, "op4_winnowing")}
    ids = sorted(docs, reverse=True)
    assert sorted(got) == sorted(ids)

    def plain(text):
        grams = [int(h) for h in winnow.gram_hashes(np.array([ord(c) for c in text]), min(winnow.GRAM, len(text)))] if text else []
        chosen, w = [], min(winnow.WINDOW, len(grams))
        for i in range(len(grams) - w + 1 if grams else 0):
            low = min(grams[i:i + w])
            at = max(j for j in range(i, i + w) if grams[j] == low)
            if not chosen or chosen[-1] != (low, at):
                chosen.append((low, at))
        return chosen

    def alike(a, b):
        a, b = {h for h, _ in a}, {h for h, _ in b}
        return len(a & b) / len(a | b) if a | b else 1.0

    for d, after in zip(ids, ids[1:] + ids[:1]):
        own, other = docs[d], docs[after]
        half = len(own) // 2
        edited = own[:len(own) - half] + other[:half]
        r, p, e, n = got[d], plain(own), plain(edited), plain(other)
        assert r.n_chars == len(own) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.fingerprint == "".join(f"{h:08x}{at:08x}" for h, at in p) and r.edited_fingerprint == "".join(f"{h:08x}{at:08x}" for h, at in e)
        assert r.near_edited == pytest.approx(alike(p, e)) and r.near_next == pytest.approx(alike(p, n))


def test_packing(spark, docs):
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    want = {d: [*tokenizer.encode(t, add_special_tokens=False).ids, queries.END_ID] for d, t in docs.items()}
    pieces, filled = defaultdict(list), defaultdict(list)
    for r in rows(spark, "op5_vector_packing"):
        ids = want[r.doc_id]
        assert r.doc_tokens == len(ids)
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start:r.start + r.length], dtype="<u4").tobytes())
        pieces[r.doc_id].append((r.start, r.length))
        filled[r.sequence_id].append((r.offset, r.length))
    for d, ids in want.items():
        at = 0
        for start, n in sorted(pieces[d]):
            assert start == at and n > 0
            at += n
        assert at == len(ids)
    padded = 0
    for parts in filled.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 4096 and len(parts) <= 256
        padded += 0 if at & (at - 1) == 0 else 4096 - at
    assert padded <= 0.01 * sum(map(len, want.values()))


def test_packing_limits():
    rng = np.random.default_rng(1)
    packer = packing.Packer((64, 5, 30), 16)
    examples = [(k, int(n), int(rng.integers(0, n + 1))) for k, n in enumerate(rng.integers(1, 200, 300))]
    pieces = [p for k, n, loss in examples for p in packer.add((k, n, loss), n, loss)] + list(packer.finish())
    used = defaultdict(lambda: [0, 0, 0])
    covered = Counter()
    for (k, n, loss), start, length, sequence, offset in sorted(pieces, key=lambda p: (p[3], p[4])):
        assert offset == used[sequence][0]
        used[sequence][0] += length
        used[sequence][1] += 1
        used[sequence][2] += max(0, start + length - max(start, n - loss))
        covered[k] += length
    assert all(a <= 64 and b <= 5 and c <= 30 for a, b, c in used.values())
    assert covered == Counter({k: n for k, n, _ in examples})


def test_context_tree(spark, docs):
    got = {r.doc_id: r for r in rows(spark, "op7_context_tree")}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in docs}
    tokens = {d: [*words(lower(t)), None] for d, t in docs.items()}
    counts = Counter(w for d, ws in tokens.items() if not held[d] for w in ws)
    n, v = sum(counts.values()), len(counts)
    for d, ws in tokens.items():
        r = got[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[d], len(ws), sum(counts[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws), rel=1e-9)
        assert r.score < 0
    # Learning helps: the texts held out cost less than an untrained model's eight bits a byte, and less than the unigrams.
    cost = sum(-got[d].score / math.log10(2) for d in docs if held[d]) / sum(len(ctw.line(docs[d].encode())) for d in docs if held[d])
    assert cost < 3.5


def test_context_tree_is_exact():
    """Node weights and probabilities against the recursion written out."""
    lines = [b"abab\n", b"abba\n", b"ba\n"]
    depth = 2
    counts = defaultdict(lambda: [0, 0])
    for x in lines:
        padded = b"\0" * depth + x
        for i in range(depth, len(padded)):
            for d in range(depth + 1):
                for b in range(8):
                    counts[padded[i - d:i][::-1], (1 << b) | padded[i] >> 8 - b][padded[i] >> 7 - b & 1] += 1

    def kt(a, b):
        p, n = 0.0, [0, 0]
        for s in [0] * a + [1] * b:
            p += math.log((n[s] + 0.5) / (n[0] + n[1] + 1))
            n[s] += 1
        return p

    def log_pw(context, node):
        own = kt(*counts[context, node])
        if len(context) == depth:
            return own
        below = sum(log_pw(c, m) for c, m in list(counts) if m == node and len(c) == len(context) + 1 and c[:-1] == context)
        return np.logaddexp(own, below) + math.log(0.5)

    grams, n = np.unique(ctw.gram_keys(lines, depth), return_counts=True)
    levels = {}
    for d, key, n0, n1, pw, w in ctw.subtrees(grams, n.astype(float), depth, 0):
        for k, a, b, p in zip(key.tolist(), n0, n1, pw):
            context = bytes((k >> 8) >> 8 * (d - 1 - i) & 255 for i in range(d))
            assert [a, b] == counts[context, k & 255] and p == pytest.approx(log_pw(context, k & 255), rel=1e-9)
        levels[d] = key, (n1 + 0.5) / (n0 + n1 + 1), w
    # A distribution: the probabilities of all bytes after any context sum to 1.
    for context in (b"ab", b"zz", b"\0\0", b"b\n"):
        every = np.array([(context[1] << 16) | (context[0] << 8) | s for s in range(256)], dtype=np.uint64)
        assert (10 ** ctw.byte_logs(levels, depth, every)).sum() == pytest.approx(1.0)


@pytest.mark.parametrize("bound", [0, 500, 1 << 21])
def test_context_tree_at_any_bound(spark, docs, bound):
    """The scores are those of one tree over all training texts, whatever share of the grams is broadcast."""
    depth = 4
    learnt = [ctw.line(t.encode()) for d, t in docs.items() if zlib.crc32(str(d).encode()) % 7 != 2]
    grams, n = np.unique(ctw.gram_keys(learnt, depth), return_counts=True)
    levels = {d: (key, (n1 + 0.5) / (n0 + n1 + 1), w) for d, key, n0, n1, _, w in ctw.subtrees(grams, n.astype(float), depth, 0)}
    df = spark.createDataFrame(list(docs.items()), "doc_id bigint, text string").repartition(3)
    got = {r.doc_id: r for r in ctw.score(df, "doc_id", "text", depth=depth, frequent_grams=bound, frequent=bound).collect()}
    assert len(got) == len(docs)
    for d, t in docs.items():
        x = ctw.line(t.encode())
        want = ctw.byte_logs(levels, depth, ctw.gram_keys([x], depth)).sum()
        assert got[d].score == pytest.approx(want, rel=1e-6)
        assert got[d].code_length == pytest.approx(-want / math.log10(2) / len(x), rel=1e-6)


def test_simhash(spark, docs):
    def plain(text):
        ws = words(lower(text))
        grams = [" ".join(ws[i:i + 3]) for i in range(max(1, len(ws) - 2))] if ws else []
        hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))
    prints = {d: plain(t) for d, t in docs.items()}
    ids = sorted(docs)
    group = {d: d for d in ids}
    changed = True
    while changed:
        changed = False
        for a in ids:
            low = min(group[b] for b in ids if bin(prints[a] ^ prints[b]).count("1") <= 3)
            if low < group[a]:
                group[a], changed = low, True
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in rows(spark, "op8_simhash")}
    assert got == {d: (f"{prints[d]:016x}", group[d]) for d in ids}


def luhn(s):
    return sum(x if k % 2 == 0 else 2 * x - 9 * (x > 4) for k, x in enumerate(map(int, reversed(s)))) % 10 == 0


def base_spans(text):
    kinds = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
             ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
             ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(re.sub("[^0-9]", "", m)) <= 19 and luhn(re.sub("[^0-9]", "", m))),
             ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15)]
    return sorted((m.start(), k, m.end()) for k, (_, p, ok) in enumerate(kinds) for m in re.finditer(p, text) if ok(m[0]))


def test_base_personal_data(spark, docs):
    names = ["email", "ip", "card", "phone"]
    for r in rows(spark, "op9_contextual_pii"):
        want = base_spans(docs[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for _, k, _ in want) for i in range(4)]
        texts = [f"{names[k]}:{a}:{b}" for a, k, b in want]
        assert r.base_sha256 == hashlib.sha256(",".join(texts).encode()).hexdigest()
        assert set(texts) <= set(r.spans.split(",")) | {""}


def test_quality(spark, con):
    labels = dict(con.sql("SELECT doc_id, quality FROM labels").fetchall())
    right = []
    for r in rows(spark, "op10_additive_quality"):
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
        if r.held_out and r.doc_id in labels:
            right.append(r.predicted == labels[r.doc_id])
    assert right and sum(right) / len(right) >= 0.8


def test_pipeline(spark, con, tmp_path):
    """Each stage against what it must do with the rows it was given."""
    import corpus_pipeline as cp
    before = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {}
    for name, stage in cp.STAGES:
        out = stage(spark, before, SF)
        path = str(tmp_path / name.replace(" ", "_"))
        out.write.parquet(path)
        after = spark.read.parquet(path)
        if name != cp.STAGES[-1][0]:
            assert after.dtypes == before.dtypes
        kept[name] = after
        if name == "exact dedup":
            groups = defaultdict(list)
            for r in before.collect():
                groups[re.sub(r"[\x20\x09-\x0D]", "", r.text)].append((-len(r.text), r.doc_id))
            assert sorted(r.doc_id for r in after.collect()) == sorted(min(g)[1] for g in groups.values())
        if name == "simhash near-dedup":
            want, _ = similar.kept({r.doc_id: r.text for r in before.collect()})
            assert sorted(r.doc_id for r in after.collect()) == want
        if name == "source mixing":
            chosen = queries.mixed(before).collect()
            assert Counter(r.doc_id for r in after.collect()) == Counter(r.doc_id for r in chosen)
            assert sum(len(words(r.text)) for r in after.collect()) == sum(r.take_tokens for r in chosen)
        if name == "packing":
            assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect()}
        before = after
    labels = dict(con.sql("SELECT doc_id, quality FROM labels").fetchall())
    passed = {r.doc_id for r in kept["quality classifier"].select("doc_id").collect()}
    assert np.mean([d in passed for d, q in labels.items() if q == 1]) > 0.97
    assert np.mean([d in passed for d, q in labels.items() if q == 0]) < 0.2
