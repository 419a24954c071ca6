"""Token ids with any size of the workers' memory."""

import os
import random
import sys

import duckdb
import numpy as np
from tokenizers import Tokenizer

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
from sentrylake.llm import packing, queries  # noqa: E402


def test_ids_do_not_depend_on_what_is_remembered():
    path = queries.tokenizer_path()
    plain = Tokenizer.from_file(path)
    r = random.Random(8)
    marks = ["'", "'s", ",", "...", "-", "_", "/", "\t", "\r", " ", "　", "É", "ß", "日本", "ﬁ", "1,000.5", "<|", "|>", "a@b.c", "$5", "\x1c", " "]
    words = ["the", "Don", "re", "naïve", "ON", "x"] + marks
    texts = ["".join(r.choice(words) + r.choice(["", " ", "  ", "\n"]) for _ in range(r.randint(0, 40))) for _ in range(400)]
    texts += [t for t, in duckdb.sql("SELECT text FROM '/root/testdata/sf0.001/documents.parquet'").fetchall()]
    for remembered in (2, 60, 400_000):
        encoder = packing.Encoder(path, remembered)
        for t in texts:
            got = np.frombuffer(encoder.encode(t.encode()), "<u4").tolist()
            assert got == plain.encode(t, add_special_tokens=False).ids, t
        assert len(encoder.young) <= max(remembered, max(len(set(t.split(" "))) for t in texts) * 3)


def test_a_worker_keeps_its_encoder():
    path = queries.tokenizer_path()
    first = packing.encoder(path)()
    assert packing.encoder(path)().__self__ is first.__self__


def test_what_is_remembered_stays_small():
    """Several workers of an executor hold an encoder each."""
    encoder = packing.Encoder(queries.tokenizer_path())
    for block in range(40):
        encoder.encode(" ".join(f"{block}q{i}" for i in range(10_000)).encode())
    assert len(encoder.young) + len(encoder.old) <= 300_000


def test_a_waiting_rest_does_not_hold_its_whole_document():
    packer, ids = packing.Packer((8, 4, 8), 16), bytes(range(4 * 21))
    example = ["doc", ids, 0, 0, 21]
    whole = list(packer.add(example, 21, 21))
    packing.release(example, packer.waiting)
    assert [p[1:3] for p in whole] == [(0, 8), (8, 8)] and example[1:3] == [ids[64:], 16]
    assert [p[1:3] for p in packer.finish()] == [(16, 4), (20, 1)]
