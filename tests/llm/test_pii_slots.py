"""Slots beside numbers, before punctuation and with inner spaces."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
from sentrylake.llm import pii  # noqa: E402


@pytest.mark.parametrize("kind, seed, odd, frame", [
    ("email", "user{}@mail.example", "user99(at)mail.example", "x{1} write 24 {0} 7 times y{1}"),
    ("email", "user{}@mail.example", "user99(at)mail.example", "x{1} u{1} {0}, thanks again"),
    ("phone", "+4930555{:04d}", "030 555 7713", "x{1} please call {0} before noon y{1}"),
    ("phone", "+4930555{:04d}", "030 555 7713", "x{1} u{1} {0}, or so y{1}"),
])
def test_slots_meet(spark, kind, seed, odd, frame):
    texts = [(i, frame.format(seed.format(i), chr(97 + i % 26) * (1 + i // 26))) for i in range(30)] + [(99, frame.format(odd, "zzz"))]
    got = {r.doc_id: r for r in pii.personal_data(spark.createDataFrame(texts, "doc_id bigint, text string"), "doc_id", "text").collect()}
    start = texts[-1][1].index(odd)
    assert f"{kind}:{start}:{start + len(odd)}" in got[99].spans.split(",") and got[99].base == ""
